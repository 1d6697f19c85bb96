"""Secret scans: candidate strings, and a random forest that removes false findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.llm.common import ALL, SPACE, in_one, with_text, words_of
from stagepath.staging import Staging

MIN_LENGTH = 16
MIN_ASSIGNED = 8
MAX_LABELLED = 20_000
DICTIONARY = 1_000
PLACEHOLDER = "[SECRET]"
_LETTERS = r"A-Za-z0-9+/=_\-"
_VALUE = f"[{_LETTERS}]{{{MIN_LENGTH},}}"
_BORDER = f"(?<=[{_LETTERS}])(?=[^{_LETTERS}])|(?<=[^{_LETTERS}])(?=[{_LETTERS}])"
#: What stands before a secret that is assigned, and paths that hold examples.
_KEYWORDS = r"(?i)(token|secret|passw|pwd|api_?key|access|auth|credential|private|bearer)"
#: Where a value begins that is assigned to such a name, and the characters that it may have.
_WIDE = r"A-Za-z0-9+/=_\-.!:@#$%^&*~?"
_NAME = rf"{_KEYWORDS}[\w\-]{{0,20}}[\"\'`]?[{SPACE}]{{0,2}}[=:]{{1,2}}>?[{SPACE}]{{0,2}}[\"\'`]?"
_START = f"(?=[{_WIDE}]{{{MIN_ASSIGNED},}})(?![=:])"
_ASSIGNED = f"{_NAME}{_START}"
_ASSIGNED_AT = f"(?<={_NAME}){_START}"
_EXAMPLE_PATHS = r"(?i)(test|example|sample|mock|fixture|doc)"

FEATURES = [
    "length", "case_turns", "class_turns", "digit_share", "upper_share", "vowel_share",
    "distinct_share", "coverage", "keyword", "assigned", "quoted", "plain_neighbours",
    "path_depth", "example_path",
]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The `size` words of at least three letters that most often stand in all texts, lower case.

    Counted in each task first; ties go by the word, so the list is the same each time.
    """
    words = docs.select(F.explode(words_of(F.lower("text"))).alias("word"))
    top = (
        words.where(F.col("word").rlike(r"^\p{Ll}{3,12}$"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(size)
    )
    return [row.word for row in top.collect()]


#: Lengths are added up in blocks of so many, so that a place in a long list costs no more than that.
_BLOCK = 256
#: What stands before a value in its own word is looked at as far back as so many pieces.
_PIECES_BACK = 32


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_starts(parts: Column, use: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """`use` of a list of strings and of where, in code points, the one at an index begins."""

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)

    def blocks(lengths: Column) -> Column:
        last = F.greatest(F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"), F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
        )

    def within(one: Column) -> Column:
        def start(at: Column) -> Column:
            block = F.floor(at / _BLOCK).cast("int")
            return (
                total(F.slice(one.sums, F.lit(1), block))
                + total(F.slice(one.lengths, block * _BLOCK + 1, at % _BLOCK))
            ).cast("long")

        return use(one.parts, start)

    measured = _bound(
        F.struct(parts.alias("parts"), F.transform(parts, F.length).alias("lengths")),
        lambda one: F.struct(one.parts, one.lengths, blocks(one.lengths).alias("sums")),
    )
    return _bound(measured, within)


def _numbers(of: Column) -> Column:
    return F.sequence(F.lit(0), F.size(of) - 1)


def _words_of_interest(docs: DataFrame, path: str, pattern: str, look_back: int, holds: Callable[[Column], Column]) -> DataFrame:
    """A row per word of the texts that match `pattern`, if the word and the `look_back` before it
    hold what is looked for: where that stretch begins, the words before it in the
    stretch (`run_up`), the word, three words before and two after it. A row carries no more of the text."""
    read = docs.select("doc_id", F.col(path).alias("path"), F.col("text").alias("_text"))

    def around(parts: Column, start: Callable[[Column], Column]) -> Column:
        def part(at: Column) -> Column:
            return F.coalesce(F.get(parts, at), F.lit(""))

        def run_up(at: Column) -> Column:
            return F.concat(F.lit(""), *(part(at - step) for step in range(look_back, 0, -1)))

        def row(at: Column) -> Column:
            return F.struct(
                start(at).alias("start"),
                run_up(at).alias("run_up"),
                part(at).alias("word"),
                F.concat_ws(" ", *(F.trim(part(at + step)) for step in (-3, -2, -1))).alias("before"),
                F.concat_ws(" ", *(F.trim(part(at + step)) for step in (1, 2))).alias("after"),
            )

        chosen = F.filter(_numbers(parts), lambda at: holds(F.concat(run_up(at), part(at))))
        return F.transform(chosen, row)

    words = _with_starts(F.split("_text", f"(?<=[{SPACE}])(?=[^{SPACE}])"), around)
    return read.where(F.col("_text").rlike(pattern)).select(
        "doc_id", F.xxhash64("_text").alias("text_hash"), "path", F.explode(words).alias("_at")
    ).select("doc_id", "text_hash", "path", "_at.*")


def _lead(pieces: Column, at: Column) -> Column:
    first = F.greatest(at - _PIECES_BACK, F.lit(0))
    return F.array_join(F.slice(pieces, first + 1, at - first), "")


_FOUND = ("doc_id", "text_hash", "path", "start", "value", "before", "after", "lead")


def long_runs(docs: DataFrame, path: str = "source") -> DataFrame:
    """Every run of at least 16 characters as keys have them, with the words around it.

    `start` is where the run begins in the text, in code points; `lead` is what its word
    has before it, up to 32 runs and gaps back. NULL texts have none. Texts without a run are passed over
    before they are taken apart.
    """

    def holds_run(piece: Column) -> Column:
        return (F.length(piece) >= MIN_LENGTH) & piece.rlike(_VALUE)

    def runs(pieces: Column, start: Callable[[Column], Column]) -> Column:
        return F.transform(
            F.filter(_numbers(pieces), lambda at: holds_run(F.get(pieces, at))),
            lambda at: F.struct(
                start(at).alias("within"), F.get(pieces, at).alias("value"), _lead(pieces, at).alias("lead")
            ),
        )

    words = _words_of_interest(docs, path, _VALUE, 0, holds_run)
    found = words.withColumn("_run", F.explode(_with_starts(F.split("word", _BORDER), runs)))
    return found.select("*", "_run.*").withColumn("start", F.col("start") + F.col("within")).select(*_FOUND)


def assigned_values(docs: DataFrame, path: str = "source") -> DataFrame:
    """Values of at least 8 characters assigned to names of credentials that hold no long run,
    being short or broken up by punctuation, in the columns of `long_runs`.

    Stops, colons and question marks at the end are left off. Addresses are no values. A name, its sign
    and its value lie in three words at most.
    """

    def value_of(piece: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(piece, f"^[{_WIDE}]+", 0), r"[.:?]+$", "")

    def values(pieces: Column, start: Callable[[Column], Column]) -> Column:
        return F.transform(
            F.filter(_numbers(pieces), lambda at: at > 0),
            lambda at: F.struct(
                start(at).alias("within"),
                value_of(F.get(pieces, at)).alias("value"),
                _lead(pieces, at).alias("_head"),
            ),
        )

    words = _words_of_interest(docs, path, _ASSIGNED, 2, lambda text: text.rlike(_ASSIGNED))
    stretch = F.concat("run_up", "word")
    found = words.withColumn("_run", F.explode(_with_starts(F.split(stretch, _ASSIGNED_AT), values)))
    value = F.col("value")
    return (
        found.select("*", "_run.*")
        .withColumn("within", F.col("within") - F.length("run_up"))
        # Those of the words before are found with their own word.
        .where((F.col("within") >= 0) & (F.length(value) >= MIN_ASSIGNED))
        .where(~value.rlike(_VALUE) & ~F.contains(value, F.lit("://")))
        .withColumn("lead", F.right("_head", F.least(F.col("within"), F.length("_head").cast("long")).cast("int")))
        .withColumn("start", F.col("start") + F.col("within"))
        .select(*_FOUND)
    )


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Every long run, and every shorter or broken value that is assigned to a name of credentials."""
    return long_runs(docs, path).unionByName(assigned_values(docs, path))


def _turns(classes: Column) -> Column:
    """How often a string changes from one character to another."""
    return F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1


def _kinds(value: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"
    )


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds what the forest looks at: length, turns between kinds of characters, how much of the
    value dictionary words cover, its path and the words beside it. NULL paths are empty."""
    value = F.col("value")
    length = F.length(value)
    lower = F.lower(value)
    kinds = _kinds(value)
    sounds = F.regexp_replace(F.regexp_replace(lower, "[aeiou]", "a"), "[b-df-hj-np-tv-z]", "b")
    # Longer words first, so that a word is not taken for its beginning.
    known = "|".join(sorted(words, key=lambda word: (-len(word), word))) or "$^"
    path = F.coalesce("path", F.lit(""))
    plain = F.size(
        F.filter(
            F.split(F.concat_ws(" ", "before", "after"), " "),
            lambda word: word.rlike(r"^\p{L}+[.,]?$"),
        )
    )
    return found.withColumns(
        {
            "length": length.cast("double"),
            "case_turns": _turns(kinds) / length,
            "class_turns": _turns(sounds) / length,
            "digit_share": (length - F.length(F.translate(value, "0123456789", ""))) / length,
            "upper_share": (length - F.length(F.regexp_replace(value, "[A-Z]", ""))) / length,
            "vowel_share": (length - F.length(F.translate(lower, "aeiou", ""))) / length,
            "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / length,
            "coverage": (length - F.length(F.regexp_replace(lower, known, ""))) / length,
            "keyword": F.concat("before", "lead").rlike(_KEYWORDS).cast("double"),
            "assigned": F.concat("before", "lead").rlike(r"[=:]\s*[\"\']?$").cast("double"),
            "quoted": F.col("lead").rlike(r"[\"\'`]$").cast("double"),
            "plain_neighbours": plain.cast("double"),
            "path_depth": (F.length(path) - F.length(F.translate(path, "/", ""))).cast("double"),
            "example_path": path.rlike(_EXAMPLE_PATHS).cast("double"),
        }
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings that a strict rule can label: 1 for an assigned random value, 0 for plain strings.

    A value is random if it mixes letters and digits in at least a fifth of its
    length each, or small and capital letters that change kind at nearly every second
    character, as keys of 62 or 64 characters do and words do not. It is a secret if names of
    credentials stand before it. Where none does, it is plain if it is not random and has no
    digit, no letter, or stands in an address. All others get no label.
    """
    value = F.col("value")
    length = F.length(value)
    digits = length - F.length(F.translate(value, "0123456789", ""))
    letters = length - F.length(F.regexp_replace(value, "[A-Za-z]", ""))
    context = F.concat("before", "lead")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & (20 * _turns(_kinds(value)) >= 9 * length)
    random = ((5 * digits >= length) & (5 * letters >= length)) | mixed
    named = context.rlike(_KEYWORDS)
    address = F.col("lead").rlike(r"(://|www\.|@|/)")
    label = (
        F.when(random & named & ~address, 1.0)
        .when(~named & ~random & ((digits == 0) | (letters == 0) | address), 0.0)
    )
    return found.withColumn("label", label).where("label IS NOT NULL")


def seed_findings(spark: SparkSession, n: int = 200) -> DataFrame:
    """Labelled findings of both kinds, made by a rule from a counter, so that a forest can be
    fitted where the texts give too few of their own.

    Secrets are hexadecimal keys, keys of 62 and of 64 characters, and short assigned ones;
    the others are words, also assigned to names of credentials.
    """
    numbers = spark.range(n).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"), (F.col("id") % 8).alias("kind")
    )
    key = F.substring("hash", 1, 40)
    base64 = F.base64(F.unhex("hash"))
    base62 = F.translate(base64, "+/=", "")
    short = F.substr(base62, F.lit(1), (8 + F.col("id") % 7).cast("int"))
    word = F.translate(F.substring("hash", 1, 20), "0123456789", "aeiounrstl")
    kind = F.col("kind")
    secret = kind.isin(0, 1, 4, 5, 6)
    named = kind.isin(0, 2, 4, 6)
    value = (
        F.when(kind < 2, key).when(kind == 2, word).when(kind == 3, F.concat(word, F.lit("-"), word))
        .when(kind == 4, base62).when(kind == 5, base64).when(kind == 6, short)
        .otherwise(F.substr(word, F.lit(1), (8 + F.col("id") % 11).cast("int")))
    )
    return numbers.select(
        F.lit(None).cast("string").alias("path"),
        value.alias("value"),
        F.when(secret & named, "token =").when(secret | (kind == 7), "set password:")
        .otherwise("and the").alias("before"),
        F.lit("of the").alias("after"),
        F.when(secret, '"').otherwise("").alias("lead"),
        secret.cast("double").alias("label"),
    )


def train(labelled: DataFrame, words: list[str], max_rows: int = MAX_LABELLED) -> RandomForestClassificationModel:
    """A forest on at most `max_rows` labelled findings, those with the smallest hashes of value and
    context; repeats count once. The findings need both labels."""
    context = ["path", "value", "before", "after", "lead"]
    sample = (
        labelled.groupBy(*context)
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(*context), *context)
        .limit(max_rows)
    )
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        with_features(sample, words)
    )
    forest = RandomForestClassifier(numTrees=20, maxDepth=6, seed=7, minInstancesPerNode=2)
    return forest.fit(vectors.select("features", "label"))


def scan(
    docs: DataFrame,
    staging: Staging,
    labelled: DataFrame | None = None,
    path: str = "source",
    threshold: float = 0.5,
) -> DataFrame:
    """Every candidate of every text with the forest's chance that it is a secret, and its verdict.

    `labelled` holds labelled findings (path, value, before, after, lead, label). Without it
    the candidates that a strict rule can label stand in; the forest then judges
    those that no rule covers. NULL and empty texts give no rows, nor does an empty table;
    repeated rows give repeated findings.

    The texts are read for the dictionary and twice for the candidates; the shuffles
    carry word counts of each task and candidates only.
    """
    words = dictionary(docs)
    found = staging.save(candidates(docs, path), "candidates")
    seeds = seed_findings(docs.sparkSession)
    own = rule_labels(found) if labelled is None else labelled
    model = train(own.select(*seeds.columns).unionByName(seeds), words)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        with_features(found, words)
    )
    return (
        model.transform(vectors)
        .withColumn("chance", vector_to_array("probability")[1])
        .withColumn("is_secret", F.col("chance") >= threshold)
        .select(*found.columns, *FEATURES, "chance", "is_secret")
    )


def redact(docs: DataFrame, staging: Staging, path: str = "source", **options) -> DataFrame:
    """The documents with every secret replaced by a placeholder, in their own columns.

    A text's secrets are looked up by doc_id and text, so repeats are all redacted, longer ones
    first, as they may hold shorter ones.
    `n_chars` follows the text where the table has it.
    """
    secrets = (
        scan(docs, staging, path=path, **options)
        .where("is_secret")
        .groupBy(F.struct("doc_id", "text_hash").alias("_found"))
        .agg(
            F.sort_array(F.collect_set(F.struct(F.length("value"), "value")), asc=False)["value"]
            .alias("_values")
        )
    )
    before = F.col(f"{ALL}.text")
    own = F.struct(F.col(f"{ALL}.doc_id").alias("doc_id"), F.xxhash64(before).alias("text_hash"))
    text = F.when(
        F.col("_values").isNotNull(),
        F.aggregate("_values", before, lambda t, v: F.replace(t, v, F.lit(PLACEHOLDER))),
    ).otherwise(before)
    joined = in_one(docs).withColumn("_row", own).join(
        staging.save(secrets, "secrets"), F.col("_row") == F.col("_found"), "left"
    )
    return with_text(docs, joined, text)
