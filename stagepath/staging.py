"""Tables written between the steps of a build.

A written table cuts lineage, survives the loss of executors, and gives the
planner true sizes, so a later join is broadcast only when its side is small.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


class Staging:
    """A folder that every executor can reach, private to one build.

    As a context it removes the folder at the end. A build that hands back a table that is
    read lazily from here must outlive that reading, so its caller holds the
    Staging and removes it when the result is stored or no longer needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        shared = spark.conf.get(CHECKPOINT_DIR, None)
        if shared is None:
            # The warehouse is the other place that every node reaches.
            shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"
        self.root = f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self._saved: Counter[str] = Counter()
        #: What was measured of the tables while they were written, by label.
        self.measured: dict[str, dict[str, int]] = {}

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()

    def path(self, label: str) -> str:
        """A path of its own for each call, named after the label."""
        self._saved[label] += 1
        turn = self._saved[label]
        return f"{self.root}/{label}" if turn == 1 else f"{self.root}/{label}.{turn}"

    def save(
        self,
        frame: DataFrame,
        label: str,
        partition_by: str | None = None,
        measures: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Writes a table and reads it back. `measures` are counts by name, taken as its rows are
        written, in the same pass."""
        path, watched = self.path(label), frame
        if measures:
            observation = Observation(path)
            watched = frame.observe(observation, *(value.alias(n) for n, value in measures.items()))
        writer = watched.write.mode("errorifexists")
        if partition_by is not None:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        if measures:
            # Of a table known to be empty before it is computed nothing is observed.
            found = observation.get
            self.measured[label] = {name: found.get(name) or 0 for name in measures}
        # The schema is known, so reading back needs no inference job.
        return self.spark.read.schema(frame.schema).parquet(path)

    def remove(self) -> None:
        """Deletes all that was written here, on whatever store it lies."""
        remove_folder(self.spark, self.root)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables if it exists, through the store it lies on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
