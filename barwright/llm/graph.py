"""Connected components of a graph whose nodes and links stay in the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with the least neighbour of u, itself included.

    The least neighbours are summed before rows move. Of a large graph they are
    written: so both sides of the join are plain exchanges, and a hub's links
    can be split.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return links.join(saved(least, "least") if large else least, F.col("u") == F.col("x")).drop("x")


def _both(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Two links for each row, without reading df twice."""
    return df.select(F.explode(F.array(first, second)).alias("x")).select("x.u", "x.v")


def _link(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(links: DataFrame, large: bool) -> DataFrame:
    m = _least(_both(links, _link("u", "v"), _link("v", "u")), large)
    return m.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, large: bool) -> DataFrame:
    m = _least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large)
    return _both(m, _link("v", "m"), _link("u", "m")).where("u <> v").distinct()


#: Links of a graph of which a task may hold all (16 bytes each).
SMALL_GRAPH = 1 << 20


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the least node of its component) for every node of links (u, v) that is not its own label.

    Alternating large-star and small-star steps until no label has a label;
    stars of any size take a round or two, a path of n nodes about log n. Each
    round is written to the shared folder, so a lost executor costs one round.
    """
    links = saved(links.select("u", "v").where("u <> v"), "links")
    large = links.count() > SMALL_GRAPH
    for _ in range(rounds):
        links = saved(_small_star(saved(_large_star(links, large), "links"), large), "links")
        if links.join(links.select(F.col("v").alias("x")), F.col("u") == F.col("x"), "left_semi").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    raise RuntimeError(f"no fixed point of the components after {rounds} rounds")
