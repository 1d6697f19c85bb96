"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.staging import Staging

#: The white space that separates words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Runs of other than white space, in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda word: word != "")


ALL = "_all"


def in_one(docs: DataFrame) -> DataFrame:
    """The rows in one column `_all`, so that no name of theirs meets another one."""
    return docs.select(F.struct("*").alias(ALL))


def with_text(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` from `_all` with another text; `n_chars` follows it where there is one."""
    changed = rows.select(ALL, text.alias("_new"))
    row = F.col(ALL).withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_new").cast("long"))
    return changed.select(row.alias(ALL)).select(f"{ALL}.*")


_held: list[Staging] = []


def held_staging(spark: SparkSession) -> Staging:
    """A staging folder that lasts until `clean`, as what a query returns is read from it lazily."""
    _held.append(Staging(spark))
    return _held[-1]


def clean() -> None:
    """Removes everything that the text queries have written; their results cannot be read any more."""
    while _held:
        _held.pop().remove()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for functions that run there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
