"""Small tables for the text operators' tests."""

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with what operators add.
CLASHING = {
    name: "'x'"
    for name in (
        "size shard slot row _row host path n node lines _words _text features label kept words"
        " _key text_hash component_id n_shingles task bin rank ids start length chance"
    ).split()
}


def make_docs(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    rows = [
        (
            i if ids is None else ids[i],
            texts[i],
            "en" if langs is None else langs[i],
            "s" if sources is None else sources[i],
            None if texts[i] is None else len(texts[i]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(frame):
    from pyspark.sql import functions as F

    return frame.withColumns(
        {name: F.expr(value) for name, value in CLASHING.items() if name not in frame.columns}
    )


def oracle_rows(sql, tables):
    """The rows of DuckDB SQL over pandas tables, as dicts in any order."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]


def as_set(rows):
    return sorted(repr(sorted(dict(row).items())) for row in rows)
