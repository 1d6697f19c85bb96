import numpy as np
from pyspark.sql import functions as F

from stagepath.llm import classifier
from tests.conftest import TESTDATA
from tests.llm.helpers import make_docs, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def good(i):
    return f"This is the plain text number {i} of a host. It has words and ends here."


def bad(i):
    return " ".join(f"###{j}$$$%%%" for j in range(10 + i % 5))


def labelled(spark, n=200):
    texts = [good(i) if i % 2 else bad(i) for i in range(n)]
    docs = make_docs(spark, texts, sources=[f"h{i % 4}" for i in range(n)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, n - 100)], LABELS)
    return docs, labels


def test_held_out_documents_are_told_apart(spark, staging):
    docs, labels = labelled(spark)
    found = classifier.classify(with_clashes(docs), labels, staging).collect()
    held_out = [r for r in found if r.doc_id >= 100]
    assert len(found) == 200
    assert sum(r.kept == bool(r.doc_id % 2) for r in held_out) / len(held_out) > 0.97


def test_held_out_accuracy_on_the_tables(spark, staging):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    found = classifier.classify(docs, labels.where(~test), staging)
    right = found.join(labels.where(test), "doc_id").select(
        F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")),
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("double"))),
    ).first()
    assert right[0] > 0.93 and right[1] > 0.97


def test_sites_draw_sparse_evidence(spark, staging):
    """A good host's document with no evidence of its own is judged by its host."""
    rows = [("good", "g", 0.95)] * 300 + [("poor", "g", 0.1)] * 300
    docs = make_docs(spark, [None] * 600, sources=[h for h, _, _ in rows])
    labels = spark.createDataFrame([(i, int(rows[i][2] > 0.5), 0) for i in range(0, 600, 2)], LABELS)
    found = classifier.classify(docs, labels, staging).collect()
    means = {}
    for r in found:
        means.setdefault(r.doc_id < 300, []).append(r.posterior)
    assert min(means[True]) > 0.5 > max(means[False])


def test_small_sites_are_shrunk_more(spark, staging):
    docs = make_docs(spark, [good(i) for i in range(103)], sources=["a"] * 50 + ["b"] * 50 + ["tiny"] * 3)
    labels = spark.createDataFrame(
        [(i, int(i < 50), 0) for i in range(100)] + [(i, 0, 0) for i in range(100, 103)], LABELS
    )
    host = {r.doc_id: r.host_mean for r in classifier.classify(docs, labels, staging).collect()}
    assert host[0] > 0.9 and host[60] < 0.1 and host[60] < host[101] < host[0]


def test_no_labels_and_odd_rows(spark, staging):
    docs = make_docs(spark, [None, "", "x", "x"], sources=[None, "h", "h", "h"], langs=[None, "en", None, "en"],
                     ids=[None, 1, 2, 2])
    none = spark.createDataFrame([], LABELS)
    found = classifier.classify(docs, none, staging).collect()
    assert len(found) == 4 and all(abs(r.posterior - 0.5) < 1e-9 and r.kept for r in found)
    odd = spark.createDataFrame([(None, 1, 0), (2, None, 0), (1, 1, 0), (1, 0, None), (9, 0, 0)], LABELS)
    assert len(classifier.classify(docs, odd, staging).collect()) == 4
    assert classifier.keep_good(docs, none, staging).count() == 4
    assert classifier.classify(make_docs(spark, []), none, staging).collect() == []


def test_kept_documents_have_their_own_columns(spark, staging):
    docs, labels = labelled(spark)
    kept = classifier.keep_good(docs, labels, staging)
    assert kept.columns == docs.columns and 90 <= kept.count() <= 110


def test_posteriors_match_plain_arithmetic(spark, staging):
    """The chances of the texts taken as they are, all else computed again in NumPy, row by row."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet")
    found = classifier.classify(docs, labels, staging).toPandas().set_index("doc_id").sort_index()
    given = docs.select("doc_id", "source", "lang").toPandas().set_index("doc_id").sort_index()
    known = labels.toPandas().groupby("doc_id")["quality"].mean() >= 0.5
    chance = found["text_chance"].to_numpy()
    marks = known.reindex(found.index)
    share = np.where(marks.isna(), chance, marks.eq(True).astype(float))

    def groups(*names):
        return given.groupby(list(names)).ngroup().to_numpy()

    def strength(n, total, prior):
        free = prior * (1 - prior)
        excess = ((n * (total / n - prior) ** 2).sum() - free.sum()) / ((n - 1) * free).sum()
        return 1 / min(max(excess, 1e-4), 0.99) - 1

    host, path = groups("source"), groups("source", "lang")
    n_h, t_h = np.bincount(host), np.bincount(host, share)
    n_p, t_p = np.bincount(path), np.bincount(path, share)
    prior = min(max(t_h.sum() / n_h.sum(), 0.01), 0.99)
    s_h = strength(n_h, t_h, np.full(len(n_h), prior))
    mean_h = (t_h + s_h * prior) / (n_h + s_h)
    s_p = strength(n_p, t_p, np.array([mean_h[host[path == p][0]] for p in range(len(n_p))]))
    host_mean = (t_h[host] - share + s_h * prior) / (n_h[host] - 1 + s_h)
    path_mean = (t_p[path] - share + s_p * host_mean) / (n_p[path] - 1 + s_p)
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    posterior = 1 / (1 + np.exp(-(logit(chance) + logit(path_mean) - logit(prior))))
    assert np.allclose(found["posterior"], posterior, atol=1e-9)
    assert (found["kept"] == (posterior >= 0.5)).all()
