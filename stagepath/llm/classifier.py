"""Quality classifier whose evidence on a text is weighed by what its host and path are like."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.llm.common import words_of
from stagepath.llm.quality import SYMBOLS
from stagepath.llm.common import ALL, in_one
from stagepath.staging import Staging

FEATURES = [
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share",
    "distinct_share", "repeat_share", "line_words",
]
MAX_LABELLED = 20_000
EDGE = 1e-6


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """What the classifier looks at in each text, with keys of its host and path.

    NULL text counts as empty, for which every share is 0. A NULL host or path is a site of
    its own. Rows with equal doc_id are kept.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        "doc_id",
        F.xxhash64(host).alias("host"),
        F.xxhash64(host, path).alias("path"),
        text.alias("_text"),
        words_of(F.col("text")).alias("_words"),
    )
    n_chars = F.greatest(F.length("_text"), F.lit(1))
    n_words = F.greatest(F.size("_words"), F.lit(1))
    whole = F.length("_text")
    same = F.filter("_words", lambda word, i: word == F.get("_words", i - 1))
    return read.select(
        "doc_id",
        "host",
        "path",
        F.log1p(F.size("_words").cast("double")).alias("log_words"),
        (_without(F.col("_text"), r"[\x20\x09-\x0D]") / n_words).alias("word_length"),
        ((whole - F.length(F.translate("_text", SYMBOLS, ""))) / n_chars).alias("symbol_share"),
        ((whole - _without(F.col("_text"), r"\p{Lu}")) / n_chars).alias("upper_share"),
        ((whole - F.length(F.translate("_text", "0123456789", ""))) / n_chars).alias("digit_share"),
        ((whole - F.length(F.translate("_text", "!?", ""))) / n_chars).alias("mark_share"),
        (F.size(F.array_distinct("_words")) / n_words).alias("distinct_share"),
        (F.size(same) / n_words).alias("repeat_share"),
        F.log1p(n_words / (1 + whole - F.length(F.translate("_text", "\n", "")))).alias("line_words"),
    )


def train(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> LogisticRegressionModel | None:
    """Fits the document classifier on at most `max_rows` labelled documents.

    They are those with the smallest hashes of their ids, so the choice does not follow the
    order of the table. Of several labels of a document the mean decides. Without
    labels of both kinds there is nothing to fit: None.
    """
    labelled = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .join(measured, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    vectors = vectors.select("features", "label").repartition(8).persist()
    try:
        if vectors.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(regParam=1e-3, maxIter=60).fit(vectors)
    finally:
        vectors.unpersist()


def _logit(share: Column) -> Column:
    inside = F.least(F.greatest(share, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(inside / (1 - inside))


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents the prior of a group is worth, from the spread of the groups' means.

    `groups` has n and total per group, and `prior` is the mean that is expected there.
    The spread beyond chance gives it (by moments); without any it is very large.
    """
    mean = F.col("total") / F.col("n")
    chance = prior * (1 - prior)
    spread = F.sum(F.col("n") * (mean - prior) ** 2)
    # Expected: the sum of chance + (n - 1) * chance / (strength + 1) over the groups.
    excess = (spread - F.sum(chance)) / F.greatest(F.sum((F.col("n") - 1) * chance), F.lit(EDGE))
    rho = groups.agg(excess.alias("rho")).first()[0]
    return 1 / min(max(rho or 0.0, 1e-4), 0.99) - 1


def classify(
    docs: DataFrame,
    labels: DataFrame,
    staging: Staging,
    host: str = "source",
    path: str = "lang",
    threshold: float = 0.5,
    max_rows: int = MAX_LABELLED,
) -> DataFrame:
    """Each document's posterior chance of being good, and whether it is kept.

    The classifier's chance is the evidence of the text. Every document counts for its
    host and for its path there, with its label if it has one and else with its
    chance. A host's mean is drawn towards the mean of all, a path's towards its
    host's, the more so the fewer documents it has; how strongly follows from the
    spread between hosts and between paths. A document's own share is taken out of its
    path and its host before its odds are multiplied by the path's odds against the prior.

    Sums per host and path are all that is gathered; a host with very many documents costs a row
    a task. Without labels of both kinds every text's evidence is the prior of 0.5.
    An empty table gives no rows; other columns are left aside.
    """
    measured = staging.save(features(docs, host, path), "features")
    model = train(measured, labels, max_rows)
    if model is None:
        scored = measured.select("doc_id", "host", "path", F.lit(0.5).alias("text_chance"))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured)
        scored = model.transform(vectors).select(
            "doc_id", "host", "path", vector_to_array("probability")[1].alias("text_chance")
        )
    known = (
        labels.where(F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    )
    evidence = staging.save(
        scored.join(known, "doc_id", "left").select(
            "doc_id", "host", "path", "text_chance",
            F.coalesce("_label", "text_chance").alias("evidence"),
        ),
        "evidence",
    )
    paths = staging.save(
        evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("total")),
        "paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    share = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    prior = min(max(0.5 if share is None else share, 0.01), 0.99)
    host_strength = _strength(hosts, F.lit(prior))
    host_means = hosts.select(
        "host",
        F.col("n").alias("host_n"),
        F.col("total").alias("host_total"),
        ((F.col("total") + host_strength * prior) / (F.col("n") + host_strength)).alias("host_mean"),
    )
    sites = staging.save(paths.join(host_means, "host").drop("host"), "sites")
    path_strength = _strength(sites, F.col("host_mean"))
    host_mean = (F.col("host_total") - F.col("evidence") + host_strength * prior) / (
        F.col("host_n") - 1 + host_strength
    )
    path_mean = (F.col("total") - F.col("evidence") + path_strength * F.col("host_mean")) / (
        F.col("n") - 1 + path_strength
    )
    odds = _logit(F.col("text_chance")) + _logit(F.col("path_mean")) - _logit(F.lit(prior))
    return (
        evidence.join(sites, "path")
        .withColumn("host_mean", host_mean)
        .withColumn("path_mean", path_mean)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .select(
            "doc_id", "text_chance", "host_mean", "path_mean", "posterior",
            (F.col("posterior") >= threshold).alias("kept"),
        )
    )


def keep_good(docs: DataFrame, labels: DataFrame, staging: Staging, **options) -> DataFrame:
    """The documents that the classifier keeps, in their own columns.

    Rows that share a doc_id stay together: one that is kept keeps all of them.
    """
    kept = classify(docs, labels, staging, **options).where("kept").select(
        F.col("doc_id").alias("_kept")
    ).distinct()
    rows = in_one(docs).join(kept, F.col(f"{ALL}.doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.select(f"{ALL}.*")
