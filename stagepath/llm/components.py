"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagepath.staging import Staging


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of them and itself, each as often as it finds so."""
    both = _both_ways(links)
    least = _smallest(both).withColumn("least", F.least("least", "a"))
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = _smallest(down)
    moved = down.join(least, "a").where("b > least").select(F.col("least").alias("a"), "b")
    own = least.select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(own).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one smaller node at most, and that one on none; links may be repeated."""
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(
        links.select(F.col("a").alias("node"), F.lit(None).alias("up"))
    )
    met = ends.groupBy("node").agg(
        F.min("up").alias("least"), F.max("up").alias("most"), F.count_if(F.col("up").isNull()).alias("down")
    )
    return met.where("least < most or least is not null and down > 0").isEmpty()


def as_links(member: DataFrame) -> DataFrame:
    """Links (a, b) of each node to its component's smallest one, in place of those that it was found by."""
    return member.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def components(links: DataFrame, staging: Staging, label: str = "component") -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternates large stars and small stars until every node hangs on its component's smallest
    one, in a number of rounds that grows with the logarithm of the longest path; links that are
    stars already take none, and two stars that are linked take a large star more than one round. A task
    sends one minimum per node, and the joins with a node of very many links may be split. Each
    half of a round is written, so a lost executor costs no more than its part.
    Links of a node to itself, repeated links and empty tables are allowed. The links are read
    several times, so they should be stored.
    """
    state = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    done, turn = _are_stars(state), 0
    if done:
        state = staging.save(state.distinct(), f"{label}-links")
    while not done:
        large = _large_star(state)
        # Repeats of the first one do the small star no harm; a later one may be the last.
        state = staging.save(large.distinct() if turn else large, f"{label}-large-{turn}")
        done = turn > 0 and _are_stars(state)
        if not done:
            state = staging.save(_small_star(state), f"{label}-small-{turn}")
            done, turn = _are_stars(state), turn + 1
    hung = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return hung.unionByName(roots)
