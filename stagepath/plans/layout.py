"""A stored mart laid out by session, so that per-session sums and joins on the pair need no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.operators import depth

SESSION = "user_session"
#: Rows from which a session is stored apart, as one bucket would hold them all.
HOT_ROWS = 1_000_000
#: With this setting Spark takes buckets by session as they are for a join on session and product.
PARTIAL_KEYS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@dataclass(frozen=True)
class SessionLayout:
    """The mart as a table of the session catalog, bucketed and sorted by session and product.

    Sessions of very many rows lie in a second table without buckets. Both are read as one; what is
    summed per session is shuffled for the second alone, one row per session and task.
    """

    spark: SparkSession
    name: str

    @property
    def _hot(self) -> str:
        return f"{self.name}_hot"

    def store(self, mart: DataFrame, path: str, buckets: int, hot_rows: int = HOT_ROWS) -> None:
        """Stores `mart` under `path`. Rows are dealt out by bucket first, so a bucket is one file."""
        sizes = mart.groupBy(SESSION).agg(F.count("*").alias("_rows"))
        hot = sizes.where(F.col("_rows") > hot_rows).select(SESSION)
        (
            mart.join(hot, SESSION, "left_anti")
            .select(*mart.columns)
            .repartition(buckets, SESSION)
            .write.bucketBy(buckets, SESSION)
            .sortBy(SESSION, "product_id")
            .option("path", f"{path}/by_session")
            .mode("overwrite")
            .saveAsTable(self.name)
        )
        (
            mart.join(hot, SESSION, "left_semi")
            .select(*mart.columns)
            .write.option("path", f"{path}/hot")
            .mode("overwrite")
            .saveAsTable(self._hot)
        )

    def mart(self) -> DataFrame:
        """All rows of the mart."""
        return self.spark.table(self.name).unionByName(self.spark.table(self._hot))

    def sessions(self) -> DataFrame:
        """One row per session, as `depth.sessions` gives it. A session lies in one of the two tables."""
        return depth.sessions(self.spark.table(self.name)).unionByName(
            depth.sessions(self.spark.table(self._hot))
        )

    def with_pairs(self, other: SessionLayout) -> DataFrame:
        """The pairs that both marts hold, with the columns of `other` behind. Where neither session is
        hot, two tables of as many buckets meet bucket by bucket, if PARTIAL_KEYS is set."""
        keys = [SESSION, "product_id"]
        ours, theirs = self.spark.table(self.name), self.spark.table(other.name)
        our_hot, their_hot = self.spark.table(self._hot), self.spark.table(other._hot)

        def apart(frame: DataFrame) -> DataFrame:
            return frame.select(*keys, *(F.col(c).alias(f"other_{c}") for c in frame.columns if c not in keys))

        # A session may be hot in one of them only.
        parts = [(ours, theirs), (ours, their_hot), (our_hot, theirs), (our_hot, their_hot)]
        found = [a.join(apart(b), keys) for a, b in parts]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
