"""Quality rules: measures of each text, and lines that many documents of a host share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.llm.common import ALL, SPACE, in_one, with_text, words_of
from stagepath.staging import Staging

#: Characters that mark up or junk rather than prose.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """When a line is too frequent on its host, and when a document has lost too much.

    A line goes if more than `share` of the host's different texts, and more than
    `min_documents`, hold it; or, whatever the size of the host, if more than `max_documents`
    texts with different sketches do. A document is depleted if more than `max_removed`
    of its words stand in such lines.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_documents: int = 20
    share: float = 0.05
    max_removed: float = 0.5
    max_documents: int = 50


def _n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def _n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and sketch.

    The 3-word windows of a text are sorted by hash, so equal ones lie side by side and
    a text of any length and repetition takes n log n steps. NULL text has no words.
    The sketch is the smallest of these hashes, which near copies mostly have in common and
    other texts do not; it is the hash of a text of fewer words.
    """
    kept = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    words = docs.withColumn("_words", words_of(F.col(text)))
    at = F.sequence(F.lit(0), F.size("_words") - 3)
    window = F.transform(
        at,
        lambda i: F.struct(
            F.xxhash64(*(F.get("_words", i + j) for j in range(3))).alias("hash"), i.alias("at")
        ),
    )
    none = F.array().cast("array<struct<hash:bigint,at:int>>")
    windows = words.withColumn(
        "_windows", F.sort_array(F.when(F.size("_words") >= 3, window).otherwise(none))
    )
    found_twice = F.filter(
        "_windows",
        lambda x, i: (x.hash == F.get("_windows", i - 1).hash)
        | (x.hash == F.get("_windows", i + 1).hash),
    )
    repeats = windows.withColumn(
        "_repeats", F.array_sort(F.transform(found_twice, lambda x: x["at"]))
    )
    # A window covers three words, or as many as lie before the next window.
    covered = F.aggregate(
        F.transform(
            "_repeats",
            lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_repeats", i + 1) - x, F.lit(3))),
        ),
        F.lit(0),
        lambda total, n: total + n,
    )
    return repeats.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, word: n + F.length(word)).alias(
            "word_chars"
        ),
        _n_symbols(whole).cast("long").alias("n_symbols"),
        _n_dup_lines(whole).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.coalesce(F.get("_windows", F.lit(0)).hash, F.xxhash64(whole)).alias("sketch"),
    )


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )


def normalised_lines(text: Column) -> Column:
    """Each line's words in lower case, one blank apart; lines without a word are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), words_of)
    return F.transform(
        F.filter(lines, lambda words: F.size(words) > 0),
        lambda words: F.struct(
            F.xxhash64(F.lower(F.array_join(words, " "))).alias("line"),
            F.size(words).alias("n_words"),
        ),
    )


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """(host, line) of the lines above the limits.

    `lines` has host, text and line hashes and the text's sketch, a row per line of a text.
    Exact copies of a text count once, near copies of one sketch once against `max_documents`.
    Tasks send each (host, line, text) once, then counts per sketch, then counts per line.
    """
    texts = lines.select("host", "text_hash").distinct().groupBy("host").agg(
        F.count("*").alias("n_texts")
    )
    held = (
        lines.select("host", "line", "sketch", "text_hash")
        .distinct()
        .groupBy("host", "line", "sketch")
        .agg(F.count("*").alias("n"))
        .groupBy("host", "line")
        .agg(F.sum("n").alias("n_with_line"), F.count("*").alias("n_sketches"))
    )
    least = min(limits.min_documents, limits.max_documents)
    shared = (F.col("n_with_line") > limits.min_documents) & (
        F.col("n_with_line") > limits.share * F.col("n_texts")
    )
    return (
        held.where(F.col("n_with_line") > least)
        .join(texts, "host")
        .where(shared | (F.col("n_sketches") > limits.max_documents))
        .select("host", "line")
    )


def judge(
    docs: DataFrame,
    staging: Staging,
    limits: Limits = Limits(),
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
) -> DataFrame:
    """Measures and verdict of each document, by its own words and by its host's lines.

    Hosts and lines are compared as 64-bit hashes; a NULL host is a host of its own. NULL
    and empty texts have no words and fail the base rules. Rows with equal keys are
    judged each for itself. Other columns are left aside. An empty table gives no rows.

    The text is read once; what the rules need of it is written, so that counting and
    looking up lines shuffle hashes only. A line of very many documents is counted
    in each task first, and its look-up may be split.
    """
    read = docs.select(
        F.col(key).alias("_key"), F.xxhash64(host).alias("host"), F.col(text).alias("_text")
    )
    measured = base_measures(read, "_text").select(
        F.monotonically_increasing_id().alias("row"),
        "_key",
        "host",
        F.xxhash64("_text").alias("text_hash"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "sketch",
        normalised_lines(F.col("_text")).alias("lines"),
    )
    measured = staging.save(measured, "measures")
    lines = measured.select(
        "row", "host", "text_hash", "sketch", F.explode("lines").alias("_line")
    ).select("row", "host", "text_hash", "sketch", "_line.*")
    frequent = staging.save(
        frequent_lines(lines.withColumnRenamed("n_words", "_n"), limits), "frequent-lines"
    )
    removed = (
        lines.join(frequent, ["host", "line"])
        .groupBy("row")
        .agg(
            F.sum("n_words").alias("removed_words"),
            F.count("*").alias("removed_lines"),
            F.collect_set("line").alias("lines_to_remove"),
        )
    )
    depleted = F.col("removed_words") > limits.max_removed * F.col("n_words")
    return (
        measured.drop("lines", "sketch")
        .join(removed, "row", "left")
        .na.fill(0, ["removed_words", "removed_lines"])
        .withColumn("base_failed", base_failed(limits))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .withColumnRenamed("_key", key)
    )


def clean(
    docs: DataFrame, staging: Staging, limits: Limits = Limits(), host: str = "source"
) -> DataFrame:
    """The documents that are kept, without their host's frequent lines, in their own columns.

    `n_chars` follows the text where the table has it. Repeated rows stay repeated.
    """
    verdicts = (
        judge(docs, staging, limits, host=host)
        .where("kept")
        .select(
            F.struct("doc_id", "host", "text_hash").alias("_judged"), "lines_to_remove"
        )
        .dropDuplicates(["_judged"])
    )
    own = F.struct(
        F.col(f"{ALL}.doc_id").alias("doc_id"),
        F.xxhash64(F.col(ALL)[host]).alias("host"),
        F.xxhash64(F.col(f"{ALL}.text")).alias("text_hash"),
    )
    joined = in_one(docs).withColumn("_row", own).join(verdicts, F.col("_row") == F.col("_judged"))
    before = F.col(f"{ALL}.text")
    left = F.array_join(
        F.filter(
            F.split(before, "\n"),
            lambda line: ~F.array_contains(
                "lines_to_remove",
                F.xxhash64(F.lower(F.array_join(words_of(line), " "))),
            ),
        ),
        "\n",
    )
    return with_text(docs, joined, F.when(F.size("lines_to_remove") > 0, left).otherwise(before))
