"""Ring charts of a taxonomy: each node's share of the circle lies inside its parent's, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import trees
from quern.session import scratch


def ring(paths: DataFrame, path: str = "path") -> DataFrame:
    """prefix, depth, n, a0, a1 (shares of the circle) of every node on the paths: children follow each other by name from their parent's beginning, each as
    wide as its share of the parent's rows; what ends at the parent itself leaves the rest. One aggregation, then a join with the level above for each level."""
    spark, folder = paths.sparkSession, scratch(paths.sparkSession, "ring")
    rollup = trees.prefix_rollup(paths, path).withColumn("depth", F.size("prefix"))
    rollup.write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes").withColumns({"up": F.slice("prefix", F.lit(1), F.col("depth") - 1), "name": F.element_at("prefix", -1)})
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    total = nodes.where("depth = 1").agg(F.sum("n")).first()[0]
    above = spark.createDataFrame([([], 0.0, 1.0, total or 0)], "prefix array<string>, a0 double, a1 double, n long")
    out = None
    for level in range(1, levels + 1):
        own = nodes.where(F.col("depth") == level).withColumn("before", F.sum("n").over(Window.partitionBy("up").orderBy("name")) - F.col("n"))
        parents = above.select(F.col("prefix").alias("up"), F.col("a0").alias("p0"), (F.col("a1") - F.col("a0")).alias("span"), F.col("n").alias("whole"))
        placed = own.join(parents, "up").select("prefix", "depth", "n", (F.col("p0") + F.col("span") * F.col("before") / F.col("whole")).alias("a0"), (F.col("p0") + F.col("span") * (F.col("before") + F.col("n")) / F.col("whole")).alias("a1"))
        placed.write.parquet(f"{folder}/level-{level}")
        above = spark.read.parquet(f"{folder}/level-{level}")
        out = above if out is None else out.unionByName(above)
    return out if out is not None else nodes.select("prefix", "depth", "n", F.lit(0.0).alias("a0"), F.lit(0.0).alias("a1"))


def sectors(nodes: DataFrame, inner: float = 60.0, width: float = 40.0, gap: float = 1.0) -> DataFrame:
    """prefix, title, svg: a ring's nodes as SVG elements, deeper ones further out."""
    r0 = F.lit(inner) + (F.col("depth") - 1) * (width + gap)
    title = F.concat(F.array_join("prefix", " / "), F.lit(": "), F.col("n").cast("string"))
    safe = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shape = text.sector(F.col("a0"), F.least(F.col("a1"), F.col("a0") + 0.9999), r0, r0 + width)  # an arc onto itself shows nothing
    return nodes.select("prefix", title.alias("title"), F.concat(F.lit('<path d="'), shape, F.lit('"><title>'), safe, F.lit("</title></path>")).alias("svg"))


def report(nodes: DataFrame, path: str, caption: str = "") -> None:
    """A folder with one SVG file of the ring: a line an element, in order of the path, put together by one task, as a taxonomy that people look at has few nodes."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    size = 2 * (60.0 + deepest * 41.0) + 20
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{-size / 2:.0f} {-size / 2:.0f} {size:.0f} {size:.0f}">'
    ends = nodes.sparkSession.createDataFrame([(0, [], head), (1, [], f'<text text-anchor="middle">{caption}</text>'), (3, [], "</svg>")], "part int, prefix array<string>, value string")
    lines = ends.unionByName(sectors(nodes).select(F.lit(2).alias("part"), "prefix", F.col("svg").alias("value")))
    lines.orderBy("part", "prefix").coalesce(1).select("value").write.mode("overwrite").text(path)
