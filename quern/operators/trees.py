"""Taxonomies as node tables: prefix rollups, beam search with given probabilities, plan choice, closures, referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, scratch

FLOOR = 1e-9


def prefix_rollup(paths: DataFrame, path: str = "path") -> DataFrame:
    """prefix (array) and n for every prefix of every path; summed once by path first, so that few rows are exploded."""
    sums = paths.groupBy(path).agg(F.count("*").alias("n"))
    each = sums.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))).alias("prefix"))
    return each.groupBy("prefix").agg(F.sum("n").alias("n"))


def leaves(rollup: DataFrame) -> DataFrame:
    """Prefixes that no longer prefix goes through."""
    inner = rollup.where(F.size("prefix") > 1).select(F.slice("prefix", F.lit(1), F.size("prefix") - 1).alias("prefix")).distinct()
    return rollup.join(inner, "prefix", "left_anti")


def path_score(probabilities: Column) -> Column:
    """Geometric mean, floored."""
    logs = F.transform(probabilities, lambda p: F.ln(F.greatest(p, F.lit(FLOOR))))
    return F.exp(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(probabilities))


def separation(best: Column, second: Column) -> Column:
    """best / second; null if there is one choice or the second is 0."""
    return F.when(second > 0, best / second)


def depth(nodes: DataFrame) -> int:
    """Levels of a tree (node, parent), by doubling: each round a node's ancestor is its ancestor's ancestor, so rounds grow with the logarithm."""
    now, rounds = cut(nodes.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("d"))), 0
    most = now.count().bit_length() + 1
    while not now.where("up IS NOT NULL").isEmpty():
        if rounds == most:
            raise ValueError("a node lies below itself")
        over = now.select(F.col("node").alias("_at"), F.col("up").alias("_up"), F.col("d").alias("_d"))
        now = cut(now.join(over, F.col("up") == F.col("_at"), "left").select("node", F.col("_up").alias("up"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
        rounds += 1
    return int(now.agg(F.max("d")).first()[0] or 0)


def beam(nodes: DataFrame, probabilities: DataFrame, width: int = 3, levels: int | None = None) -> DataFrame:
    """Beam search by level over nodes (node, parent, name, ord) with probabilities (item, node, p): item, rank, path, score.

    A path that reaches a node without children is finished; finished paths of all lengths compete. A single child has probability 1.
    Ties keep the order of insertion: the path's place in the frontier, then the child's order. There are as many levels as the tree is deep;
    a tree deeper than `levels` is an error.
    A level's frontier is stored where the session has a checkpoint folder, so that no level computes those above it again, and an empty one ends the search.
    """
    kids = nodes.groupBy("parent").agg(F.count("*").alias("n_siblings"))
    parents = nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    full = nodes.join(kids, "parent", "left").join(parents, "node", "left").select("node", "parent", "name", "ord", F.coalesce("n_siblings", F.lit(1)).alias("n_siblings"), F.coalesce("inner", F.lit(False)).alias("inner"))
    root = nodes.where("parent IS NULL").select(F.col("node").alias("at"))
    front = probabilities.select("item").distinct().crossJoin(F.broadcast(root)).select("item", "at", F.array().cast("array<string>").alias("path"), F.array().cast("array<double>").alias("ps"), F.lit(0).alias("seq"))
    finished, stored = None, nodes.sparkSession.sparkContext.getCheckpointDir() is not None
    deep = max(1, depth(nodes) - 1)
    if levels is not None and deep > levels:
        raise ValueError(f"the tree has {deep} levels below its root, more than {levels}")
    for level in range(deep):
        if level and stored and front.isEmpty():
            break
        step = front.join(F.broadcast(full), front["at"] == full["parent"]).join(probabilities, ["item", "node"], "left")
        p = F.when(F.col("n_siblings") == 1, 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
        step = step.select("item", "node", "inner", F.array_append("path", F.col("name")).alias("path"), F.array_append("ps", p).alias("ps"), F.struct("seq", "ord").alias("seq"))
        step = cut(step.withColumn("score", path_score(F.col("ps"))))
        done = step.where("NOT inner").select("item", "path", "score", F.lit(level).alias("level"), F.col("seq.seq").alias("s1"), F.col("seq.ord").alias("s2"))
        finished = done if finished is None else finished.unionByName(done)
        w = Window.partitionBy("item").orderBy(F.desc("score"), "seq")
        front = step.where("inner").withColumn("r", F.row_number().over(w)).where(F.col("r") <= width).select("item", F.col("node").alias("at"), "path", "ps", F.col("r").alias("seq"))
    w = Window.partitionBy("item").orderBy(F.desc("score"), "level", "s1", "s2")
    return finished.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width).select("item", "rank", "path", "score")


def plans(first: DataFrame, second: DataFrame, third: DataFrame, allowed: Column | None = None) -> DataFrame:
    """All combinations of an item's few candidates on three axes (beam width each), kept if allowed. Joined by item, so the product is per item."""
    out = first.join(second, "item").join(third, "item")
    return out.where(allowed) if allowed is not None else out


def chosen_plan(scored: DataFrame, alternatives: int = 3) -> DataFrame:
    """item, rank, plan, p, separation: the best plans and how far the first is from the second."""
    w = Window.partitionBy("item").orderBy(F.desc("p"), "plan")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("p").over(w)).where(F.col("rank") <= alternatives + 1)
    return ranked.select("item", "rank", "plan", "p", separation(F.col("p"), F.col("next")).alias("separation"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: all that start (node) reaches over edges (src, dst), itself included; a fixpoint of joins, new nodes only in each round, until there are none.
    Each round's nodes are written, so that none is computed again and nothing stays in memory."""
    spark, folder = start.sparkSession, scratch(start.sparkSession, "reached")
    shape = start.select("node").schema
    start.select("node").distinct().write.parquet(f"{folder}/round-0")
    rounds = 1
    while True:
        reached = spark.read.schema(shape).parquet(*(f"{folder}/round-{r}" for r in range(rounds)))
        front = spark.read.schema(shape).parquet(f"{folder}/round-{rounds - 1}")
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        new.write.parquet(f"{folder}/round-{rounds}")
        if spark.read.schema(shape).parquet(f"{folder}/round-{rounds}").isEmpty():
            return reached
        rounds += 1


def reachability_sql(edges: str, start: str) -> str:
    """The same as a recursive query over views, planned as one job."""
    return f"WITH RECURSIVE r(node) AS (SELECT node FROM {start} UNION ALL SELECT e.dst FROM {edges} e JOIN r ON e.src = r.node) SELECT DISTINCT node FROM r"


def dangling(links: DataFrame, nodes: DataFrame, leaves_: DataFrame) -> DataFrame:
    """name and fault: links to no node, leaves without a node, nodes that are no leaf."""
    a = links.select(F.col("to").alias("name")).distinct().join(nodes, "name", "left_anti").withColumn("fault", F.lit("link to no node"))
    b = leaves_.select("name").distinct().join(nodes, "name", "left_anti").withColumn("fault", F.lit("leaf without node"))
    c = nodes.select("name").distinct().join(leaves_, "name", "left_anti").withColumn("fault", F.lit("node without leaf"))
    return a.unionByName(b).unionByName(c)
