"""Queries over rules, votes, groupings and taxonomies, derived from the sales tables by fixed expressions."""

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import filters, merge, trees, votes
from quern.plans.registry import query

#: Three replicates of each order: the enforcer axis agrees but for spelling, the trigger axis differs at times, the target axis is often empty.
ATTEMPTS = """attempts AS (SELECT o_orderkey AS rule, axis, rep, CASE axis
  WHEN 'enforcer' THEN CASE WHEN (o_orderkey + rep) % 5 = 0 THEN [] WHEN rep = 1 THEN [lower(o_orderpriority), 'x'] WHEN rep = 2 THEN ['X', o_orderpriority] ELSE [o_orderpriority, 'x'] END
  WHEN 'trigger' THEN CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus] WHEN (o_custkey + rep) % 4 = 0 THEN [o_orderstatus || rep] ELSE [o_orderstatus] END
  ELSE CASE WHEN o_custkey % 3 = rep - 1 THEN ['t' || o_custkey % 7] ELSE [] END END AS vals
  FROM orders, (VALUES ('enforcer'), ('trigger'), ('target')) a(axis), (VALUES (1), (2), (3)) r(rep))"""
NORM = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '\s*\([^()]*\)\s*$', ''), '[\s\-_/]+', ' ', 'g'), '^[ .;:]+|[ .;:]+$', '', 'g')"
PLAN = (
    ATTEMPTS
    + f""", named AS (SELECT rule, axis, rep, vals, list_sort(list_distinct(list_transform(vals, lambda v: {NORM.format('v')}))) AS folded FROM attempts WHERE len(vals) > 0),
head AS (SELECT rule, axis, count(*) AS named, min(folded) AS low, max(folded) AS high, min_by(vals, rep) AS first FROM named GROUP BY ALL),
plan AS (SELECT k.rule, k.axis, coalesce(named, 0) AS named, CASE WHEN coalesce(named, 0) <= 1 THEN 'null' WHEN low = high THEN 'pattern' ELSE 'ask' END AS how, first FROM (SELECT DISTINCT rule, axis FROM attempts) k LEFT JOIN head h ON h.rule = k.rule AND h.axis = k.axis),
each AS (SELECT rule, axis, rep, unnest(vals) AS raw, generate_subscripts(vals, 1) AS pos FROM named),
spelt AS (SELECT rule, axis, {NORM.format('raw')} AS norm, raw, count(DISTINCT rep) AS n, min(rep * 100 + pos) AS seen FROM each GROUP BY ALL),
best AS (SELECT rule, axis, norm, raw, seen FROM spelt QUALIFY row_number() OVER (PARTITION BY rule, axis, norm ORDER BY n DESC, seen) = 1),
firsts AS (SELECT rule, axis, norm, min(pos) AS at FROM (SELECT rule, axis, {NORM.format('raw')} AS norm, pos, rep FROM each QUALIFY rep = min(rep) OVER (PARTITION BY rule, axis)) GROUP BY ALL),
lists AS (SELECT p.rule, p.axis, list(b.raw ORDER BY f.at) AS vals FROM plan p JOIN firsts f ON f.rule = p.rule AND f.axis = p.axis JOIN best b ON b.rule = f.rule AND b.axis = f.axis AND b.norm = f.norm WHERE how = 'pattern' GROUP BY ALL)"""
)


def attempts(t):
    reps = F.explode(F.array(*map(F.lit, (1, 2, 3))))
    out = t.orders.select(F.col("o_orderkey").alias("rule"), "o_orderpriority", "o_orderstatus", "o_custkey", F.explode(F.array(*map(F.lit, ("enforcer", "trigger", "target")))).alias("axis")).withColumn("rep", reps)
    values = F.expr("""CASE axis
      WHEN 'enforcer' THEN CASE WHEN (rule + rep) % 5 = 0 THEN cast(array() as array<string>) WHEN rep = 1 THEN array(lower(o_orderpriority), 'x') WHEN rep = 2 THEN array('X', o_orderpriority) ELSE array(o_orderpriority, 'x') END
      WHEN 'trigger' THEN CASE WHEN rule % 3 = 0 THEN array(o_orderstatus) WHEN (o_custkey + rep) % 4 = 0 THEN array(o_orderstatus || rep) ELSE array(o_orderstatus) END
      ELSE CASE WHEN o_custkey % 3 = rep - 1 THEN array('t' || o_custkey % 7) ELSE cast(array() as array<string>) END END""")
    return out.select("rule", "axis", "rep", values.alias("values"))


@query(f"WITH {PLAN} SELECT p.rule, p.axis, p.named, p.how, coalesce(array_to_string(l.vals, '|'), '') AS vals FROM plan p LEFT JOIN lists l ON l.rule = p.rule AND l.axis = p.axis")
def l5_vote_plan(t):
    return votes.vote_plan(attempts(t)).select("rule", "axis", "named", "how", F.array_join("values", "|").alias("vals"))


@query(f"WITH {PLAN} SELECT axis, how, count(*) AS n, CAST(sum(named) AS BIGINT) AS named FROM plan GROUP BY ALL")
def a6_settled_counts(t):
    return votes.vote_plan(attempts(t)).groupBy("axis", "how").agg(F.count("*").alias("n"), F.sum("named").alias("named"))


@query(f"WITH {PLAN} SELECT rule, CASE WHEN bool_or(how = 'ask') THEN '2/3' ELSE '3/3' END AS stability FROM plan GROUP BY rule")
def a7_stability(t):
    return votes.stability(votes.vote_plan(attempts(t)))


SPECS = """specs AS (SELECT o_orderkey AS rule, rep, CASE WHEN (o_orderkey + rep) % 4 = 0 THEN [] ELSE [o_orderpriority || CASE WHEN (o_custkey + rep) % 3 = 0 THEN '!' ELSE '' END] END AS enforcer, CASE WHEN (o_custkey * rep) % 5 = 0 THEN '' ELSE 's' || rep END AS spec FROM orders, (VALUES (1), (2), (3)) r(rep)),
voted AS (SELECT o_orderkey AS rule, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE [o_orderpriority] END AS voted FROM orders)"""


@query(f"""WITH {SPECS}, b AS (SELECT s.*, voted, spec <> '' AND len(enforcer) > 0 AS has, len(enforcer) > 0 AND len(voted) > 0 AND {NORM.format('enforcer[1]')} = {NORM.format('voted[1]')} AS agree FROM specs s JOIN voted v ON v.rule = s.rule)
SELECT rule, CASE WHEN max(len(voted)) = 0 THEN '' ELSE coalesce(min_by(spec, rep) FILTER (has AND agree), min_by(spec, rep) FILTER (has), '') END AS spec FROM b GROUP BY rule""")
def w9_pick_spec(t):
    base = t.orders.select(F.col("o_orderkey").alias("rule"), "o_orderpriority", "o_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rep"))
    enforcer = F.expr("CASE WHEN (rule + rep) % 4 = 0 THEN cast(array() as array<string>) ELSE array(o_orderpriority || CASE WHEN (o_custkey + rep) % 3 = 0 THEN '!' ELSE '' END) END")
    specs = base.select("rule", "rep", enforcer.alias("enforcer"), F.expr("CASE WHEN (o_custkey * rep) % 5 = 0 THEN '' ELSE 's' || rep END").alias("spec"))
    voted = t.orders.select(F.col("o_orderkey").alias("rule"), F.expr("CASE WHEN o_orderkey % 6 = 0 THEN cast(array() as array<string>) ELSE array(o_orderpriority) END").alias("values"))
    return votes.picked_spec(specs, voted)


@query("WITH r AS (SELECT o_orderkey AS rule, rep, CASE WHEN (o_orderkey * 7 + rep) % 11 = 0 THEN 'x' END AS error FROM orders, (VALUES (1), (2), (3)) r(rep)) SELECT rule FROM r WHERE error IS NULL GROUP BY rule HAVING count(DISTINCT rep) = 3")
def j5_complete(t):
    reps = t.orders.select(F.col("o_orderkey").alias("rule"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rep"))
    return merge.complete(reps.withColumn("error", F.when((F.col("rule") * 7 + F.col("rep")) % 11 == 0, "x")), "rule", "rep", 3)


@query(f"""WITH {ATTEMPTS}, ans AS (SELECT rule, axis, 0 AS pos, 'x' AS value, [1, 2, 2, 9] AS cited FROM attempts WHERE axis = 'enforcer' AND rep = 1 UNION ALL SELECT rule, axis, 1, '&lt;no&gt;', [1, 3] FROM attempts WHERE axis = 'enforcer' AND rep = 1),
c AS (SELECT DISTINCT rule, axis, pos, value, unnest(cited) AS rep FROM ans),
m AS (SELECT c.*, vals FROM c JOIN attempts a ON a.rule = c.rule AND a.axis = c.axis AND a.rep = c.rep WHERE len(vals) > 0)
SELECT rule, axis, pos, value FROM m GROUP BY ALL HAVING count(*) >= 2 AND bool_or(list_contains(vals, value))""")
def l6_rails(t):
    a = attempts(t)
    one = a.where("axis = 'enforcer' AND rep = 1").select("rule", "axis")
    first = one.select("*", F.lit(0).alias("pos"), F.lit("x").alias("value"), F.array(*map(F.lit, (1, 2, 2, 9))).alias("cited"))
    second = one.select("*", F.lit(1).alias("pos"), F.lit("&lt;no&gt;").alias("value"), F.array(*map(F.lit, (1, 3))).alias("cited"))
    return votes.railed(first.unionByName(second), a)


ALIASES = [("promo|economy", "cheap"), ("brushed|polished", "finished"), ("steel$", "steel"), ("^standard", "standard"), ("econ", "never first")]
ALIASED = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(raw)), '{p}') THEN '{n}'" for p, n in ALIASES) + " ELSE trim(raw) END"


@query(f"SELECT p_partkey, {ALIASED} AS name FROM (SELECT p_partkey, '  ' || p_type || ' ' AS raw FROM part)")
def j9_first_alias(t):
    return t.part.select("p_partkey", votes.aliased(F.concat(F.lit("  "), "p_type", F.lit(" ")), ALIASES).alias("name"))


@query(f"""WITH e AS (SELECT p_partkey, trim(raw) AS raw, {ALIASED} AS name FROM (SELECT p_partkey, unnest([p_type, ' ' || p_brand]) AS raw FROM part)),
r AS (SELECT name, raw, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, raw) AS r FROM e GROUP BY name, raw),
v AS (SELECT name, string_agg(raw, '|' ORDER BY r) AS variants FROM r WHERE r <= 4 GROUP BY name),
s AS (SELECT name, count(DISTINCT p_partkey) AS rules, count(*) AS occurrences FROM e GROUP BY name)
SELECT row_number() OVER (ORDER BY rules DESC, lower(s.name), s.name) AS id, s.name, rules, occurrences, variants FROM s JOIN v ON v.name = s.name""")
def a4_subcategories(t):
    rules = t.part.select("p_partkey", F.array("p_type", F.concat(F.lit(" "), "p_brand")).alias("values"))
    return votes.subcategories(rules, "p_partkey", "values", ALIASES).select(F.col("id").cast("long").alias("id"), "name", "rules", "occurrences", F.array_join("variants", "|").alias("variants"))


@query("""WITH m AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey % 7 = 1 UNION ALL SELECT 900 + n_regionkey FROM nation WHERE n_nationkey < 3),
n AS (SELECT id, count(*) AS n FROM m GROUP BY id)
SELECT coalesce(n_nationkey, id) AS id, CASE WHEN n_nationkey IS NULL THEN 'invented' WHEN n IS NULL THEN 'missed' ELSE 'repeated' END AS fault FROM nation FULL JOIN n ON id = n_nationkey WHERE n_nationkey IS NULL OR n IS NULL OR n > 1""")
def l7_partition_check(t):
    known = t.nation.select(F.col("n_nationkey").alias("id"))
    members = known.where("id % 6 <> 0").unionAll(known.where("id % 7 = 1")).unionAll(t.nation.where("n_nationkey < 3").select((F.col("n_regionkey") + 900).alias("id")))
    return votes.partition_faults(members, known)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_tax > 0.04")
def p6_full_triple(t):
    axes = {a: F.when(F.expr(c), F.array(F.lit(a))).otherwise(F.array().cast("array<string>")) for a, c in (("enforcer", "l_quantity > 30"), ("trigger", "l_returnflag = 'R'"), ("target", "l_tax > 0.04"))}
    return t.lineitem.withColumns(axes).where(filters.full_triple(*axes)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS kept, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_quantity > 25) AS lines FROM lineitem GROUP BY l_orderkey")
def p7_nested_filter(t):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array(F.struct(items.alias("items"))).alias("rounds"))
    kept = nested.withColumn("rounds", filters.kept_items(F.col("rounds"), lambda i: i["l_quantity"] > 25)).withColumn("items", F.col("rounds")[0]["items"])
    return kept.select("l_orderkey", F.size("items").cast("long").alias("kept"), F.nullif(F.array_join(F.transform("items", lambda i: i["l_linenumber"].cast("string")), ","), F.lit("")).alias("lines"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS scored FROM lineitem GROUP BY l_orderkey ORDER BY scored DESC, l_orderkey LIMIT 20")
def a20_top_tasks(t):
    """The 20 tasks with most scored items (a top-k report)."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("scored")).orderBy(F.desc("scored"), "l_orderkey").limit(20)


@query("SELECT o_orderkey, list_distinct([o_orderstatus, o_orderpriority, o_orderstatus]) IS NOT NULL AS ok, len(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus])) AS n, list_contains([o_orderstatus, 'F'], 'F') AS has, array_to_string([o_orderstatus, o_orderpriority][1:1], '>') AS head FROM orders")
def f30_f31_arrays(t):
    a = F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")
    return t.orders.select("o_orderkey", F.array_distinct(a).isNotNull().alias("ok"), F.size(F.array_distinct(a)).cast("long").alias("n"), F.array_contains(F.array(F.col("o_orderstatus"), F.lit("F")), "F").alias("has"), F.array_join(F.slice(F.array("o_orderstatus", "o_orderpriority"), 1, 1), ">").alias("head"))


PATHS = "paths AS (SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
PREFIXES = PATHS + ", p AS (SELECT r_name AS prefix, 1 AS depth FROM paths UNION ALL SELECT r_name || ' > ' || n_name, 2 FROM paths UNION ALL SELECT r_name || ' > ' || n_name || ' > ' || c_mktsegment, 3 FROM paths WHERE c_custkey % 3 = 0)"


def _paths(t):
    named = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    deep = F.array("r_name", "n_name", "c_mktsegment")
    return named.select(F.when(F.col("c_custkey") % 3 == 0, deep).otherwise(F.slice(deep, 1, 2)).alias("path"))


@query(f"WITH {PREFIXES} SELECT prefix, count(*) AS n FROM p GROUP BY prefix")
def a12_prefix_rollup(t):
    return trees.prefix_rollup(_paths(t)).select(F.array_join("prefix", " > ").alias("prefix"), "n")


@query(f"WITH {PREFIXES}, u AS (SELECT prefix, count(*) AS n FROM p GROUP BY prefix) SELECT prefix, n FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE starts_with(x.prefix, u.prefix || ' > '))")
def a13_leaves(t):
    return trees.leaves(trees.prefix_rollup(_paths(t))).select(F.array_join("prefix", " > ").alias("prefix"), "n")


#: A tree root > region > nation > segment, and for each order priority the share of customers as probability.
def _tree(t):
    root = t.spark.createDataFrame([("root", None, "root", 0)], "node string, parent string, name string, ord int")
    regions = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    nations = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return root.unionByName(regions).unionByName(nations)


def _probabilities(t):
    each = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_mktsegment").alias("item"), F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("r"))
    by_n = each.groupBy("item", F.col("n").alias("node"), "r").agg(F.count("*").alias("k"))
    by_r = each.groupBy("item", F.col("r").alias("node")).agg(F.count("*").alias("k"))
    whole = each.groupBy("item").agg(F.count("*").alias("w"))
    regions = by_r.join(whole, "item").select("item", "node", (F.col("k") / F.col("w")).alias("p"))
    nations = by_n.join(by_r.select("item", F.col("node").alias("r"), F.col("k").alias("w")), ["item", "r"]).select("item", "node", (F.col("k") / F.col("w")).alias("p"))
    return regions.unionByName(nations)


BEAM = """c AS (SELECT c_mktsegment AS item, n_nationkey, n_name, r_regionkey, r_name, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
r AS (SELECT *, sum(k) OVER (PARTITION BY item) AS w FROM (SELECT item, r_regionkey, r_name, sum(k) AS k FROM c GROUP BY ALL)),
top AS (SELECT *, k / w AS p, row_number() OVER (PARTITION BY item ORDER BY k / w DESC, r_regionkey) AS seq FROM r QUALIFY seq <= 2),
leaf AS (SELECT top.item, top.r_name, n_name, seq, n_nationkey, exp((ln(greatest(top.p, 1e-9)) + ln(greatest(c.k / top.k, 1e-9))) / 2) AS score FROM top JOIN c ON c.item = top.item AND c.r_regionkey = top.r_regionkey)"""


@query(f"WITH {BEAM} SELECT item, row_number() OVER (PARTITION BY item ORDER BY score DESC, seq, n_nationkey) AS rank, r_name || ' > ' || n_name AS path, round(score, 6) AS score FROM leaf QUALIFY rank <= 2")
def l9_beam(t):
    found = trees.beam(_tree(t), _probabilities(t), width=2)
    return found.select("item", F.col("rank").cast("long").alias("rank"), F.array_join("path", " > ").alias("path"), F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT c_mktsegment AS item, c_nationkey % 4 AS a, c_nationkey % 3 AS b, round(sum(c_acctbal), 2) AS p FROM customer GROUP BY ALL), q AS (SELECT item, a || '-' || b AS plan, p FROM s WHERE a <> b)
SELECT item, rank, plan, p, round(CASE WHEN nxt > 0 THEN p / nxt END, 6) AS separation FROM (SELECT *, row_number() OVER w AS rank, lead(p) OVER w AS nxt FROM q WINDOW w AS (PARTITION BY item ORDER BY p DESC, plan)) WHERE rank <= 4""")
def l11_choose_plan(t):
    sums = t.customer.groupBy(F.col("c_mktsegment").alias("item"), (F.col("c_nationkey") % 4).alias("a"), (F.col("c_nationkey") % 3).alias("b")).agg(F.round(F.sum("c_acctbal"), 2).alias("p"))
    out = trees.chosen_plan(sums.where("a <> b").select("item", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("plan"), "p"))
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("separation", F.round("separation", 6))


@query("""WITH a AS (SELECT r_regionkey AS item, x FROM region, (VALUES (1), (2), (3)) v(x)), b AS (SELECT r_regionkey AS item, y FROM region, (VALUES (1), (2)) v(y)), c AS (SELECT n_regionkey AS item, n_name AS z FROM nation) SELECT item, x, y, z FROM a JOIN b USING (item) JOIN c USING (item) WHERE (x + y + item) % 2 = 0""")
def j10_plans(t):
    r = t.region.select(F.col("r_regionkey").alias("item"))
    a, b = r.withColumn("x", F.explode(F.array(*map(F.lit, (1, 2, 3))))), r.withColumn("y", F.explode(F.array(*map(F.lit, (1, 2)))))
    return trees.plans(a, b, t.nation.select(F.col("n_regionkey").alias("item"), F.col("n_name").alias("z")), (F.col("x") + F.col("y") + F.col("item")) % 2 == 0)


@query("SELECT l_orderkey, round(exp(avg(ln(greatest(l_discount, 1e-9)))), 6) AS score FROM lineitem GROUP BY l_orderkey")
def a21_path_score(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("ps")).select("l_orderkey", F.round(trees.path_score(F.col("ps")), 6).alias("score"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey // 2 AS dst FROM nation), r(node) AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 10 = 3 UNION SELECT e.dst FROM e JOIN r ON e.src = r.node) SELECT CAST(node AS INT) AS node FROM r")
def j21_closure(t):
    edges = t.nation.select(F.col("n_nationkey").alias("src"), F.expr("cast(n_nationkey div 2 as int)").alias("dst"))
    return trees.closure(edges, t.nation.where("n_nationkey % 10 = 3").select(F.col("n_nationkey").alias("node")))


@query("""WITH links AS (SELECT DISTINCT n_name || CASE WHEN n_nationkey % 9 = 0 THEN '?' ELSE '' END AS name FROM nation), nodes AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 5 <> 0), leaves AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 4 <> 0)
SELECT name, 'link to no node' AS fault FROM links WHERE name NOT IN (SELECT name FROM nodes) UNION ALL SELECT name, 'leaf without node' FROM leaves WHERE name NOT IN (SELECT name FROM nodes) UNION ALL SELECT name, 'node without leaf' FROM nodes WHERE name NOT IN (SELECT name FROM leaves)""")
def j24_references(t):
    n = t.nation
    links = n.select(F.concat("n_name", F.when(F.col("n_nationkey") % 9 == 0, "?").otherwise("")).alias("to"))
    return trees.dangling(links, n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name")), n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name")))


@query("""WITH r AS (SELECT o_orderkey AS k, 1 AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT -o_orderkey, 3 FROM orders WHERE o_orderkey < 50), o AS (SELECT k FROM r GROUP BY k HAVING count(*) = 1)
SELECT k, n, 'taken' AS what FROM r WHERE k IN (SELECT k FROM o) AND k >= 0 UNION ALL SELECT o_orderkey, NULL, 'again' FROM orders WHERE o_orderkey NOT IN (SELECT k FROM o)""")
def j22_reconcile(t):
    key = F.col("o_orderkey").alias("k")
    replies = t.orders.where("o_orderkey % 3 <> 0").select(key, F.lit(1).alias("n")).unionAll(t.orders.where("o_orderkey % 10 = 1").select(key, F.lit(2))).unionAll(t.orders.where("o_orderkey < 50").select((-F.col("o_orderkey")).alias("k"), F.lit(3)))
    good, again = merge.reconciled(replies, t.orders.select(key), "k")
    return good.select("k", "n", F.lit("taken").alias("what")).unionAll(again.select("k", F.lit(None).cast("int"), F.lit("again")))


@query("WITH a AS (SELECT o_orderkey AS rule, max(o_orderdate) OVER (PARTITION BY o_custkey) = o_orderdate AS newest, o_custkey FROM orders) SELECT o_custkey, rule FROM (SELECT o_custkey, o_orderkey AS rule, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def w12_current_version(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("rule"))


@query("SELECT c_custkey, n_name, r_name, c_mktsegment || ' (' || n_name || ')' AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2")
def j8_dimension(t):
    """Small dimensions are broadcast by Spark's own size check."""
    both = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.region.where("r_regionkey <> 2"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return both.select("c_custkey", "n_name", "r_name", F.concat("c_mktsegment", F.lit(" ("), "n_name", F.lit(")")).alias("label"))


@query("WITH g AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(array_to_string(l, ','), '') AS categories, coalesce(len(l), 0) AS n FROM customer LEFT JOIN g ON o_custkey = c_custkey")
def j7_grouped_list(t):
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("l"))
    both = t.customer.select("c_custkey").join(lists, "c_custkey", "left")
    l = F.coalesce("l", F.array().cast("array<string>"))  # noqa: E741
    return both.select("c_custkey", F.array_join(l, ",").alias("categories"), F.size(l).cast("long").alias("n"))


@query("""WITH c AS (SELECT p_brand AS a, p_size % 5 AS b, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2.0) AS x, sum(n) AS t FROM c), l AS (SELECT sum(n * (n - 1) / 2.0) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY a)), r AS (SELECT sum(n * (n - 1) / 2.0) AS q FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((x - p * q / (t * (t - 1) / 2.0)) / ((p + q) / 2 - p * q / (t * (t - 1) / 2.0)), 8) AS ari FROM s, l, r""")
def a31_rand_index(t):
    from quern.operators import metrics

    return metrics.rand_index(t.part.select(F.col("p_brand").alias("a"), (F.col("p_size") % 5).alias("b")), "a", "b").select(F.round("ari", 8).alias("ari"))


@query("SELECT count(*) AS items, CAST(ceil(count(*) / 5.0) * 3 AS BIGINT) AS calls, round(ceil(count(*) / 5.0) * 3 * 0.0023, 6) AS cost FROM part")
def l15_dry_run(t):
    from quern.operators import metrics

    n = t.part.agg(F.count("*").alias("items"))
    calls, cost = metrics.predicted_calls(F.col("items"), 5, 3, 0.0023)
    return n.select("items", calls.cast("long").alias("calls"), F.round(cost, 6).alias("cost"))


@query("SELECT p_partkey, format('{}. {} ({} rules) — {}', p_partkey, p_brand, p_size, p_type) AS line, 'RULE = ' || p_name AS prompt FROM part")
def f18_f43_render(t):
    return t.part.select("p_partkey", F.format_string("%d. %s (%d rules) — %s", "p_partkey", "p_brand", "p_size", "p_type").alias("line"), F.concat(F.lit("RULE = "), "p_name").alias("prompt"))


@query("SELECT p_partkey, CAST(len(list_filter([trim(p_brand), '', trim(' ' || p_type)], lambda x: x <> '')) AS BIGINT) AS n FROM part")
def f46_values(t):
    return t.part.select("p_partkey", F.size(text.values_of(F.array(F.col("p_brand"), F.lit(" "), F.concat(F.lit(" "), "p_type")))).cast("long").alias("n"))
