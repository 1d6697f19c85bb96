"""Ratios, rounding and the chi-square tail, all as JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL when whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL when whole is 0 or NULL."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def round_at(value: Column, digits: int) -> Column:
    """Round half away from zero in binary arithmetic: 1.005 gives 1.0, where
    Spark's own round at two digits works on the decimal text and gives 1.01."""
    scale = float(10**digits)
    return F.round(value * scale, 0) / scale


def _erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: power series near zero, the
    continued fraction beyond."""
    # Both are exact to double precision at these term counts.
    term_count, fraction_depth, switch = 80, 120, 2.0
    # F.aggregate carries (term, sum); term_n = term_{n-1} * 2 z^2 / (2n + 1).
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(term_count)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * z * z / (n * 2 + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2.0 * z * z / (n * 2 + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    near = 1.0 - series * F.exp(-z * z) * (2.0 / math.sqrt(math.pi))
    fraction = F.aggregate(
        F.sequence(F.lit(fraction_depth), F.lit(1), F.lit(-1)),
        z,
        lambda acc, k: z + k * 0.5 / acc,
    )
    far = F.exp(-z * z) / fraction / math.sqrt(math.pi)
    return F.when(z < switch, near).otherwise(far)


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) for a chi-square variable with any positive whole `dof`.

    The tail grows by (x/2)^a e^(-x/2) / Gamma(a + 1) for every two degrees of
    freedom, starting from 0 (even dof) or from erfc(sqrt(x/2)) (odd dof). The
    addends are kept as logarithms and added with the largest factored out, as
    the first of them underflow long before their sum does.
    """
    half = x / 2.0
    is_odd = dof % 2 == 1
    start = F.when(is_odd, 0.5).otherwise(0.0)
    # First addend, at a = 0 (even) or a = 1/2 (odd): Gamma(3/2) = sqrt(pi)/2.
    first = F.when(
        is_odd, F.log(half) / 2.0 - half + math.log(2.0 / math.sqrt(math.pi))
    ).otherwise(-half)
    steps = F.floor(dof / 2).cast("int")
    summed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.struct(first.alias("term"), first.alias("largest"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] + F.log(half) - F.log(start + i)).alias("term"),
            F.greatest(acc["largest"], acc["term"]).alias("largest"),
            (
                acc["total"] * F.exp(acc["largest"] - F.greatest(acc["largest"], acc["term"]))
                + F.exp(acc["term"] - F.greatest(acc["largest"], acc["term"]))
            ).alias("total"),
        ),
        lambda acc: acc["total"] * F.exp(acc["largest"]),
    )
    tail = F.when(steps >= 1, summed).otherwise(0.0)
    base = F.when(is_odd, _erfc(F.sqrt(half))).otherwise(0.0)
    return F.when((dof >= 1) & (x <= 0), 1.0).when(dof >= 1, base + tail)


def significant(value: Column, digits: int) -> Column:
    """The double nearest to a value's decimal form with so many significant digits."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits - 1}e", value).cast("double"))


# Coefficients of the rational approximations to the inverse of the normal
# distribution (algorithm AS 241, Wichura 1988), lowest power first, for the middle, the tails and the far tails.
NORMAL_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
NORMAL_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
NORMAL_FAR_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, coefficients: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def polynomial(powers: tuple[float, ...]) -> Column:
        total = F.lit(powers[-1])
        for coefficient in powers[-2::-1]:
            total = total * x + F.lit(coefficient)
        return total

    above, below = coefficients
    return polynomial(above) / polynomial(below)


def normal_quantile(p: Column) -> Column:
    """The value below which a normal variable lies with probability `p`; NULL unless 0 < p < 1."""
    p = p.cast("double")
    off = p - 0.5
    tail = F.sqrt(-F.ln(F.when(off < 0, p).otherwise(1.0 - p)))
    far = F.when(tail <= 5.0, _ratio(tail - 1.6, NORMAL_TAIL)).otherwise(_ratio(tail - 5.0, NORMAL_FAR_TAIL))
    value = F.when(F.abs(off) <= 0.425, off * _ratio(0.180625 - off * off, NORMAL_MIDDLE)).otherwise(
        F.when(off < 0, -far).otherwise(far)
    )
    return F.when((p > 0) & (p < 1), value)
