"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.session import fresh_dir, materialize, shuffles_dropped, written

__all__ = ["documents", "fresh_dir", "materialize", "written", "drop", "components", "null_safe_text"]

# Fixed values of the contracts: words are runs of anything but a space and the controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that this run wrote."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def null_safe_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """Connected components of an edge table (u, v): one row (node, root) per node, root the smallest node.

    Alternates the large-star and the small-star step until the edges are stars, which then lie around the
    smallest node of each component; edges that are stars already take no round. Every round is two aggregations with map-side combine and
    two joins, which AQE splits where one node has very many neighbours; the round's edges are written to
    the shared folder, and those of the round before deleted. Loops and null ends are ignored; no edges give
    no rows.
    """
    links = edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"), "u", "v")
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("hi", "lo").distinct()
    links, path = written(links, label)
    while not _are_stars(links):
        last = path
        links, path = written(_small_star(_large_star(links)), label)
        drop(links.sparkSession, last)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either the smaller end of its edges or the larger end of a single one."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up")).union(links.select("lo", F.lit(0)))
    uses = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    with shuffles_dropped(links.sparkSession):
        return uses.where("up > 1 OR up = 1 AND least = 0").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Tie each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").where("v <> m")
    return out.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
