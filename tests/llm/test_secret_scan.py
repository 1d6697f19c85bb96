import base64
import hashlib
import re

from pyspark.sql import functions as F

from stagepath.llm import secret_scan
from tests.conftest import TESTDATA
from tests.llm.helpers import make_docs, with_clashes


def key(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def scanned(spark, staging, texts, **options):
    docs = make_docs(spark, texts, **options)
    return secret_scan.scan(with_clashes(docs), staging).collect()


def test_tells_keys_from_long_words(spark, staging):
    texts = [f'the config has token = "{key(i)}" in the file' for i in range(30)]
    texts += [f"the internationalisation{'s' * (i % 5)} of it and the rest" for i in range(30)]
    found = scanned(spark, staging, texts)
    assert {r.doc_id for r in found if r.is_secret} == set(range(30))
    assert {r.value for r in found if r.is_secret} == {key(i) for i in range(30)}


def test_spans_point_at_the_values(spark, staging):
    texts = [f"é漢 \n\t{key(1)}\n{key(2)};{key(3)} end", f"{key(4)}", f" {key(5)} {key(5)}", None, "", "short"]
    found = scanned(spark, staging, texts)
    assert len(found) == 6
    for r in found:
        assert texts[r.doc_id][r.start : r.start + len(r.value)] == r.value
    assert len({(r.doc_id, r.start) for r in found}) == 6


def test_planted_keys_are_found(spark, staging):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    planted = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), 1)).alias("value"))
    found = secret_scan.scan(docs, staging)
    secrets = {(r.doc_id, r.value) for r in found.where("is_secret").collect()}
    assert secrets == {(r.doc_id, r.value) for r in planted.collect()}


def test_held_out_labels(spark, staging):
    """Trained on one half of labelled findings, right on the other."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet")
    found = staging.save(secret_scan.candidates(docs), "found")
    words = secret_scan.dictionary(docs)
    labelled = secret_scan.rule_labels(found)
    half = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    model = secret_scan.train(labelled.where(half), words)
    vectors = secret_scan.VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(
        secret_scan.with_features(labelled.where(~half), words)
    )
    right = model.transform(vectors).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.98


def test_given_labels_are_used(spark, staging):
    docs = make_docs(spark, [f"id {key(i)} x" for i in range(20)])
    labels = secret_scan.candidates(docs).withColumn("label", F.lit(0.0))
    found = secret_scan.scan(docs, staging, labelled=labels).collect()
    assert len(found) == 20 and not any(r.is_secret for r in found)


def test_redacts_every_repeat(spark, staging):
    text = f'a token = "{key(1)}" and again token = "{key(1)}" here'
    docs = make_docs(spark, [text, None, "plain text", text], ids=[1, 2, 3, 1])
    rows = secret_scan.redact(docs, staging).collect()
    assert len(rows) == 4 and rows[0].__fields__ == docs.columns
    hidden = text.replace(key(1), secret_scan.PLACEHOLDER)
    assert sorted(r.text or "" for r in rows) == sorted([hidden, "", "plain text", hidden])
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)


def test_empty_table_and_null_paths(spark, staging):
    assert scanned(spark, staging, []) == []
    assert len(scanned(spark, staging, [f"x {key(1)}"], sources=[None], ids=[None])) == 1
    assert secret_scan.redact(make_docs(spark, []), staging).collect() == []


def base62(i, n=40):
    return re.sub("[+/=]", "", base64.b64encode(hashlib.sha512(str(i).encode()).digest()).decode())[:n]


def test_keys_of_few_digits_and_short_ones_are_found(spark, staging):
    keys = [base62(i) for i in range(20)]
    keys += [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode() for i in range(20)]
    keys += [base62(i, 10) for i in range(20)] + ["aB3!xY7.kL9:mQ2", "zR8.pW4!tK6"]
    texts = [f'the config has password = "{k}" in the file' for k in keys]
    texts += ["the password: internationalisation of it", "the token = required in the rest"]
    found = scanned(spark, staging, texts)
    assert all(texts[r.doc_id][r.start : r.start + len(r.value)] == r.value for r in found)
    secrets = {r.doc_id for r in found if r.is_secret and keys[r.doc_id].startswith(r.value)}
    assert len({r.doc_id for r in found} & set(range(len(keys)))) == len(keys)
    assert secrets == set(range(len(keys)))


def test_low_digit_values_after_credential_words_are_not_called_plain(spark):
    docs = make_docs(spark, [f"token = {'abcdefghij' * 2}", f"the token is /{'abcdefghij' * 2}", f"x {'abcdefghij' * 2}"])
    labelled = secret_scan.rule_labels(secret_scan.candidates(docs)).collect()
    assert [(r.doc_id, r.label) for r in labelled] == [(2, 0.0)]


def test_redacts_short_values_inside_longer_ones(spark, staging):
    short = base62(1, 10)
    docs = make_docs(spark, [f'token = "{short}" and secret = "A{short}{base62(2, 30)}" here'])
    (row,) = secret_scan.redact(docs, staging).collect()
    assert row.text == 'token = "[SECRET]" and secret = "[SECRET]" here'
