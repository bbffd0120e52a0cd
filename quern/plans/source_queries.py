"""Queries of readers and run records whose lines are put together from the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import code, text
from quern.operators import ledger, merge, metrics, rings, semantic, tasks
from quern.operators.python_backed import mapped
from quern.plans.registry import query
from quern.session import scratch
from quern.sources import readers


@query("SELECT event_type AS source, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS cost FROM events WHERE event_id % 13 <> 0 GROUP BY 1")
def s9_ledger(t):
    """Ledger lines, the torn ones skipped."""
    whole = F.to_json(F.struct(F.col("event_type").alias("source"), F.col("event_id").alias("cost")))
    lines = t.events.select(F.when(F.col("event_id") % 13 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("line"))
    rows = lines.select(F.from_json("line", "source string, cost long").alias("r")).select("r.*").where("cost IS NOT NULL")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def _cards(t):
    link = F.concat(F.lit("- leads to: see [x](../n"), F.expr("n_nationkey div 2"), F.lit(".md)\n- in: [r](r"), F.col("n_regionkey"), F.lit(".md)\nplain [y](z.md)\n"))
    return t.nation.select(F.concat(F.lit("/cards/n"), "n_nationkey", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "n_name", F.lit("\nkind: k"), F.col("n_nationkey") % 3, F.lit("\n"), link).alias("content"))


@query("SELECT 'n' || n_nationkey AS id, 'k' || (n_nationkey % 3) AS kind, n_name AS title FROM nation")
def s14_nodes(t):
    return readers.markdown_nodes(_cards(t))[0]


@query("SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey // 2) AS dst, 'leads to' AS label FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in' FROM nation")
def s14_edges(t):
    return readers.markdown_nodes(_cards(t))[1]


@query("SELECT n_nationkey AS ord, n_name AS path, 'Pre' AS event, 0 AS pos, 'm' || (n_nationkey % 4) AS matcher, 'run ' || n_nationkey AS command FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, n_name, 'Stop', 1, NULL, 'end' FROM nation WHERE n_nationkey % 5 <> 0")
def s19_m27_hooks(t):
    """Hooks of all settings files in scope order; a file that is no JSON and an entry without a command are set apart."""
    good = F.concat(F.lit('{"hooks": {"Pre": [{"matcher": "m'), F.col("n_nationkey") % 4, F.lit('", "command": "run '), F.col("n_nationkey"), F.lit('"}], "Stop": [{"matcher": "x"}, {"command": "end"}]}}'))
    files = t.nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, "{broken").otherwise(good).alias("content"))
    return readers.settings(files)[0]


@query("SELECT c.event_id AS denial, (SELECT max(x.event_id) FROM events x WHERE x.user_id = c.user_id AND x.event_id < c.event_id AND x.event_type = 'view') AS command FROM events c WHERE c.event_type = 'error'")
def j29_denied_command(t):
    """A denial with the command that came before it in its session."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = t.events.withColumn("command", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w))
    return seen.where("event_type = 'error'").select(F.col("event_id").alias("denial"), "command")


@query("SELECT o_orderkey, l_linenumber, 'c' || (l_partkey % 10) AS checker FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_partkey % 10 <> 3")
def j25_cached_checks(t):
    """Violations joined with the cached code of their check."""
    cached = t.spark.createDataFrame([(i, f"c{i}") for i in range(10) if i != 3], "k long, checker string")
    found = t.lineitem.where("l_returnflag = 'R'").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return found.join(F.broadcast(cached), F.col("l_partkey") % 10 == F.col("k")).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "checker")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 OR o_orderkey % 4 = 0")
def l4_resume(t):
    """What a stage still has to ask: not done, or done with an error."""
    done = t.orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "failed").alias("error"))
    return merge.not_yet(t.orders.select("o_orderkey"), done.where("error IS NULL"), ["o_orderkey"])


@query("SELECT event_id, denials < 3 OR event_id % 10 = 0 AS allowed, denials FROM (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS denials FROM events) WHERE event_type = 'purchase'")
def m21_history(t):
    """A decision that depends on what happened before: allowed until three denials, always on trial."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = t.events.withColumn("denials", F.coalesce(F.sum((F.col("event_type") == "error").cast("int")).over(w), F.lit(0)))
    return seen.where("event_type = 'purchase'").select("event_id", ((F.col("denials") < 3) | (F.col("event_id") % 10 == 0)).alias("allowed"), "denials")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE length(text) > 100 END AS passed, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def m26_three_valued(t):
    """A check that can't be made is no failure: its verdict is null."""
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return t.conversations.join(n, "conv_id").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.length("text") > 100).alias("passed"), "turns")


@query("SELECT count(*) AS n, round(greatest(0.0, 25 - sum(CASE WHEN event_id % 7 <> 0 THEN CAST(0.001 AS DOUBLE) ELSE 0 END)), 6) AS remaining FROM events")
def l14_budget(t):
    spent = F.sum(F.when(F.col("event_id") % 7 != 0, 0.001).otherwise(0.0))
    return t.events.agg(F.count("*").alias("n"), F.round(metrics.remaining(25.0, spent), 6).alias("remaining"))


@query()
def m9_own_prose(t):
    """Own prose by expressions and by a mask of the same length; tests compare the two."""
    masked = mapped(t.documents.select("doc_id", "text"), lambda c: [(d, code.prose_mask(x or "")) for d, x in zip(*c, strict=True)], "doc_id long, masked string")
    return t.documents.select("doc_id", text.unquoted_prose(F.col("text")).alias("prose")).join(masked, "doc_id")


@query("SELECT p_partkey, 'f' || p_partkey AS name, 1 AS line, 0 AS col FROM part UNION ALL SELECT p_partkey, 'b', 2, 4 FROM part")
def m10_names(t):
    source = F.concat(F.lit("def f"), "p_partkey", F.lit("(a):\n    b = 1\n    return b\n"))
    return mapped(t.part.select("p_partkey", source.alias("s")), lambda c: [(k, *n) for k, s in zip(*c, strict=True) for n in code.names_in(s)], "p_partkey long, name string, line int, col int")


@query("SELECT count(*) // 2 AS answered, CAST(count(*) // 2 AS DOUBLE) AS spent FROM documents")
def l14_shared_budget(t):
    """Twenty tasks draw on one budget that is enough for half of all documents."""
    path, half = scratch(t.spark, "asked"), t.documents.count() // 2
    with ledger.Ledger(t.spark, float(half)) as own:
        guard = own.guard()
        semantic.asked(t.documents.repartition(20), "doc_id", "text", lambda: semantic.Guarded(semantic.Stub(), guard, 1.0), 1).write.parquet(path)
        spent = own.account.spent
    return t.spark.read.parquet(path).agg(F.countDistinct("doc_id").alias("answered"), F.lit(spent).alias("spent"))


@query("""SELECT 'c' || o_custkey AS task_id, CAST(o_orderkey AS VARCHAR) AS round_id, o_orderpriority AS query, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS passed, count(*) FILTER (l_returnflag <> 'R') AS failed
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def m24_tasks(t):
    """Tasks of all orders written with their rounds and checks nested, named by the manifest, and read back."""
    key = F.concat(F.lit("c"), "o_custkey")
    rounds = t.orders.select(key.alias("task_id"), F.col("o_orderkey").cast("string").alias("round_id"), F.col("o_orderpriority").alias("query"))
    checks = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), key.alias("task_id")), "l_orderkey")
    checks = checks.select("task_id", F.col("l_orderkey").cast("string").alias("round_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("id"), F.col("l_linestatus").alias("requirement"), (F.col("l_returnflag") == "R").alias("passed"))
    path = scratch(t.spark, "tasks")
    tasks.materialise(tasks.nested(rounds.select("task_id").distinct(), rounds.limit(0), checks.limit(0)), path, "all")
    tasks.materialise(tasks.nested(rounds.select("task_id").distinct(), rounds, checks), path, "all")
    each = tasks.materialised(t.spark, path, "all").select("task_id", F.explode("rounds").alias("r"))
    size = lambda f: F.size(F.filter("r.checklist", f)).cast("long")
    return each.select("task_id", "r.round_id", "r.query", F.size("r.checklist").cast("long").alias("n"), size(lambda c: c["passed"]).alias("passed"), size(lambda c: ~c["passed"]).alias("failed"))


@query("""WITH n AS (SELECT p_partkey AS rule, unnest(['when', 'who']) AS axis FROM part), c AS (SELECT l_partkey AS rule, CASE WHEN l_returnflag = 'R' THEN 'who' ELSE 'when' END AS axis, 's' || l_suppkey AS pick, count(*) AS score FROM lineitem GROUP BY ALL),
b AS (SELECT rule, axis, pick, score FROM c QUALIFY row_number() OVER (PARTITION BY rule, axis ORDER BY score DESC, pick) = 1)
SELECT n.rule, n.axis, CASE WHEN n.rule % 4 = 0 THEN 'kept' ELSE b.pick END AS pick, CASE WHEN n.rule % 4 = 0 THEN 0 ELSE b.score END AS score, n.rule % 4 <> 0 AS fresh FROM n LEFT JOIN b ON b.rule = n.rule AND b.axis = n.axis""")
def l19_picks(t):
    """Picks of all rules and axes: those made before stay, the rest take their best candidate."""
    needed = t.part.select(F.col("p_partkey").alias("rule"), F.explode(F.array(F.lit("when"), F.lit("who"))).alias("axis"))
    before = needed.where("rule % 4 = 0").withColumns({"pick": F.lit("kept"), "score": F.lit(0).cast("long")})
    axis = F.when(F.col("l_returnflag") == "R", "who").otherwise("when")
    candidates = t.lineitem.groupBy(F.col("l_partkey").alias("rule"), axis.alias("axis"), F.concat(F.lit("s"), "l_suppkey").alias("pick")).agg(F.count("*").alias("score"))
    return tasks.with_picks(needed, before, candidates)


@query("""WITH p AS (SELECT [p_type, p_brand, CAST(p_size AS VARCHAR)] AS w FROM part), a AS (SELECT w[1] AS x, w[2] AS y, w[3] AS z, count(*) AS n FROM p GROUP BY ALL),
l1 AS (SELECT x, sum(n) AS n, (SELECT sum(n) FROM a) AS total FROM a GROUP BY x), i1 AS (SELECT x, n, (sum(n) OVER (ORDER BY x) - n) / total AS a0, sum(n) OVER (ORDER BY x) / total AS a1 FROM l1),
l2 AS (SELECT x, y, sum(n) AS n FROM a GROUP BY x, y), i2 AS (SELECT l2.x, y, l2.n, i1.a0 + (i1.a1 - i1.a0) * (sum(l2.n) OVER w - l2.n) / i1.n AS a0, i1.a0 + (i1.a1 - i1.a0) * (sum(l2.n) OVER w) / i1.n AS a1 FROM l2 JOIN i1 ON i1.x = l2.x WINDOW w AS (PARTITION BY l2.x ORDER BY y)),
i3 AS (SELECT a.x, a.y, z, a.n, i2.a0 + (i2.a1 - i2.a0) * (sum(a.n) OVER w - a.n) / i2.n AS a0, i2.a0 + (i2.a1 - i2.a0) * (sum(a.n) OVER w) / i2.n AS a1 FROM a JOIN i2 ON i2.x = a.x AND i2.y = a.y WINDOW w AS (PARTITION BY a.x, a.y ORDER BY z))
SELECT x AS node, 1 AS depth, CAST(n AS BIGINT) AS n, round(a0, 8) AS a0, round(a1, 8) AS a1 FROM i1 UNION ALL SELECT x || '/' || y, 2, CAST(n AS BIGINT), round(a0, 8), round(a1, 8) FROM i2 UNION ALL SELECT x || '/' || y || '/' || z, 3, n, round(a0, 8), round(a1, 8) FROM i3""")
def k11_ring(t):
    """The ring of all parts by type, brand and size: every node's share of the circle."""
    found = rings.ring(t.part.select(F.array("p_type", "p_brand", F.col("p_size").cast("string")).alias("path")))
    return found.select(F.array_join("prefix", "/").alias("node"), "depth", "n", F.round("a0", 8).alias("a0"), F.round("a1", 8).alias("a1"))
