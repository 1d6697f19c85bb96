"""A stored mart that grows by one log at a time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.model import FIRST_VIEW_ATTRIBUTES, FUNNEL, Funnel
from stagepath.operators import merging
from stagepath.sources.versions import VersionedFolder
from stagepath.staging import Staging


class MartStore:
    """The mart of all logs added so far, under one path.

    Adding a log reads that log and the stored pairs, never an earlier log. The outcome is that of
    one build over all logs, in whatever order they are added, also if their times
    overlap. A new state is published as a whole: a failed or lost build leaves the one
    before, and a log whose addition failed can be added again.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        attributes: dict[str, str] = FIRST_VIEW_ATTRIBUTES,
        funnel: Funnel = FUNNEL,
    ):
        self.spark, self.attributes, self.funnel = spark, attributes, funnel
        self._versions = VersionedFolder(spark, path)

    def _facts(self) -> dict[str, Any]:
        return self._versions.current() or {"number": 0, "logs": []}

    @property
    def logs(self) -> list[str]:
        """The names of the logs that the mart holds, in the order of their addition."""
        return self._facts()["logs"]

    def _tables(self, facts: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
        read = self.spark.read.parquet
        return read(f"{facts['folder']}/pairs"), read(f"{facts['folder']}/waiting")

    def mart(self) -> DataFrame:
        """The enriched mart of all logs added so far."""
        facts = self._facts()
        if not facts["number"]:
            raise ValueError("no log has been added yet")
        return merging.mart_of(self._tables(facts)[0], self.attributes, self.funnel)

    def add(self, ev: DataFrame, name: str) -> DataFrame:
        """Adds a log's events under a name of its own, and returns the mart.

        Event ids must differ between logs for views of the same time to be told apart. A log that is
        already in is an error.
        """
        facts = self._facts()
        if name in facts["logs"]:
            raise ValueError(f"the mart already holds {name}")

        def write(folder: str) -> dict[str, Any]:
            self._write(ev, facts, folder)
            return {"logs": [*facts["logs"], name]}

        self._versions.publish(write, since=facts["number"])
        return self.mart()

    def _write(self, ev: DataFrame, facts: dict[str, Any], folder: str) -> None:
        attributes, funnel = self.attributes, self.funnel
        keys = list(funnel.keys)
        if facts["number"]:
            pairs, waiting = self._tables(facts)
        else:
            pairs, waiting = merging.empty_state(ev, attributes, funnel)
        with Staging(self.spark) as staging:
            merged = staging.save(
                merging.merged_pairs(pairs, ev, attributes, funnel), "merged", partition_by="open"
            )
            decided, open_pairs = merged.where("NOT open").drop("open"), merged.where("open").drop("open")
            times = staging.save(merging.times_of(open_pairs, pairs, waiting, ev, funnel), "times")
            resolved = staging.save(
                merging.resolved_pairs(open_pairs.drop("waits"), times, funnel), "resolved"
            )
            # Pairs that had waited and have no new events keep what waits.
            rest = staging.save(
                waiting.join(open_pairs.select(*keys), keys, "left_anti").unionByName(
                    merging.still_waiting(resolved, times, funnel)
                ),
                "waiting",
            )
            held = rest.select(*keys).distinct().withColumn("_held", F.lit(True))
            marked = resolved.join(held, keys, "left").select(
                *resolved.columns, F.coalesce("_held", F.lit(False)).alias("waits")
            )
            decided.unionByName(marked).write.parquet(f"{folder}/pairs")
            rest.write.parquet(f"{folder}/waiting")
