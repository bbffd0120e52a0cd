"""Queries over runs and their evaluation, and the small operators around them, derived from the sales and event tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import evaluation, filters, merge, trees, votes
from quern.plans.registry import query
from quern.sources import readers


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def s1_head_scan(t):
    """The first rows of a file in key order (the limit is the feature)."""
    return readers.read_files(t.spark, f"{t.sf_dir}/documents.parquet", 25, ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id AS repo, source AS path, 0 AS stars, CAST(NULL AS VARCHAR) AS link FROM documents WHERE lang = 'de'")
def s4_column_mapping(t):
    out = readers.mapped_columns(t.documents, {"repo": "doc_id", "path": "source", "stars": None, "link": None}, "lang = 'de'", {"stars": 0})
    return out.withColumn("link", F.col("link").cast("string"))


@query("SELECT l.doc_id, l.quality, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang <> 'en'")
def s16_provenance(t):
    return t.labels.join(t.documents.where("lang <> 'en'").select("doc_id", "source"), "doc_id", "left").select("doc_id", "quality", "source")


@query("SELECT doc_id AS id, lang, CAST(NULL AS BIGINT) AS turn FROM documents UNION ALL SELECT conv_id, CAST(NULL AS VARCHAR), turn FROM conversations")
def u1_concat_by_name(t):
    return t.documents.select(F.col("doc_id").alias("id"), "lang").unionByName(t.conversations.select(F.col("conv_id").alias("id"), "turn"), allowMissingColumns=True)


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def u2_set_difference(t):
    return t.orders.select("o_orderkey").subtract(t.lineitem.where("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT o_orderkey, list_has_any(string_split(o_orderpriority, '-'), ['1', 'URGENT']) AS meets FROM orders")
def u3_intersections(t):
    return t.orders.select("o_orderkey", F.arrays_overlap(F.split("o_orderpriority", "-"), F.array(F.lit("1"), F.lit("URGENT"))).alias("meets"))


@query("SELECT DISTINCT user_id, 'R' || (event_id % 5) AS rule FROM events WHERE event_type = 'error' UNION SELECT DISTINCT user_id, 'R' || (event_id % 4) FROM events WHERE event_type = 'view'")
def u4_fired_rules(t):
    blocks = t.events.where("event_type = 'error'").select("user_id", (F.col("event_id") % 5).cast("string").alias("hook"))
    owners = t.spark.createDataFrame([(str(i), f"R{i}") for i in range(5)], "hook string, rule string")
    messages = t.events.where("event_type = 'view'").select("user_id", F.concat(F.lit("see R"), F.col("event_id") % 4, F.lit(".")).alias("text"))
    return evaluation.fired(blocks, F.broadcast(owners), messages, ["user_id"])


@query("SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'no units' WHEN n_chars % 5 = 1 THEN 'all structural' WHEN n_chars % 5 = 2 AND n_chars % 2 = 0 THEN 'empty after markup removal' END AS reason FROM documents")
def p9_drop_reason(t):
    types = F.expr("CASE WHEN n_chars % 5 = 0 THEN cast(array() as array<string>) WHEN n_chars % 5 = 1 THEN array('heading', 'code') ELSE array('heading', 'clause') END")
    stripped = F.when((F.col("n_chars") % 5 == 2) & (F.col("n_chars") % 2 == 0), " ").otherwise(F.col("text"))
    return t.documents.select("doc_id", filters.drop_reason(types, stripped).alias("reason"))


@query("SELECT event_type, coalesce(CASE WHEN s > 0 THEN b / s END < 1.2, false) AS close FROM (SELECT event_type, max(n) AS b, CASE WHEN count(*) > 1 THEN list(n ORDER BY n DESC)[2] END AS s FROM (SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)")
def p12_a22_close_calls(t):
    n = t.events.groupBy("event_type", (F.col("user_id") % 3).alias("g")).agg(F.count("*").alias("n")).groupBy("event_type").agg(F.sort_array(F.collect_list("n"), asc=False).alias("l"))
    return n.select("event_type", filters.close_call(trees.separation(F.col("l")[0], F.get("l", F.lit(1)))).alias("close"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.02 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def p13_scripted_scope(t):
    return t.lineitem.where("l_tax > 0.02").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def p14_synthetic(t):
    message = F.to_json(F.struct(F.when(F.col("role") == "system", "<synthetic>").otherwise("m").alias("model")))
    return t.conversations.where(F.get_json_object(message, "$.model") != "<synthetic>").select("conv_id", "turn")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '$ ls ' || event_id WHEN 'click' THEN 'write f' || event_id WHEN 'purchase' THEN 'grep p' ELSE 'Other' END AS what FROM events")
def p17_tool_events(t):
    name = F.expr("CASE event_type WHEN 'view' THEN 'Bash' WHEN 'click' THEN 'Write' WHEN 'purchase' THEN 'Grep' ELSE 'Other' END")
    data = F.to_json(F.struct(F.concat(F.lit("ls "), "event_id", F.lit("\ncd x")).alias("command"), F.concat(F.lit("f"), "event_id").alias("file_path"), F.lit("p").alias("pattern")))
    return t.events.select("event_id", evaluation.tool_event(name, data).alias("what"))


@query("SELECT o_orderkey, (o_orderkey // 2000) AS batch FROM orders")
def p18_batches(t):
    return t.orders.select("o_orderkey", F.expr("o_orderkey div 2000").alias("batch"))


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y%m%d-%H%M%S') >= '20240120-120000'")
def p20_runs_after(t):
    return t.events.where(F.date_format("ts", "yyyyMMdd-HHmmss") >= "20240120-120000").select("event_id")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'judged' END, o_orderstatus) AS resolved FROM orders")
def j6_judged_or_resolved(t):
    judged = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("judged").alias("j"))
    return t.orders.select("o_orderkey", "o_orderstatus").join(judged, "o_orderkey", "left").select("o_orderkey", F.coalesce("j", "o_orderstatus").alias("resolved"))


@query("SELECT p_partkey, 'R' || k AS rule FROM part JOIN (SELECT p_type AS ty, min(p_partkey) AS k FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0) ON ty = trim(' ' || p_type || ' ')")
def j11_j12_trimmed_lookup(t):
    rules = t.part.groupBy(F.col("p_type").alias("ty")).agg(F.min("p_partkey").alias("k")).where("k % 2 = 0")
    items = t.part.select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("requirement"))
    return items.join(rules, F.trim("requirement") == F.col("ty")).select("p_partkey", F.concat(F.lit("R"), "k").alias("rule"))


@query("""WITH e AS (SELECT event_id, user_id % 7 AS hook, event_type FROM events), s AS (SELECT hook, min(event_type) AS r FROM e WHERE event_id % 50 = 0 GROUP BY hook HAVING min(event_type) = max(event_type)), n AS (SELECT hook, min(event_type) AS r FROM e GROUP BY hook)
SELECT n.hook, coalesce(s.r, n.r) AS rule FROM n LEFT JOIN s ON s.hook = n.hook""")
def j15_j16_priority(t):
    e = t.events.select("event_id", (F.col("user_id") % 7).alias("hook"), F.col("event_type").alias("rule"))
    return evaluation.first_match([evaluation.only_one(e.where("event_id % 50 = 0"), "hook", "rule"), e.groupBy("hook").agg(F.min("rule").alias("rule"))], "hook", "rule")


@query("WITH k AS (SELECT DISTINCT event_type AS k FROM events), r AS (SELECT DISTINCT unnest([k, k || '/translation', k[1:3], k || '?']) AS label FROM k) SELECT event_id, label FROM events, r WHERE label = event_type OR label = event_type || '/translation' OR contains(event_type, label)")
def j23_ledger_runs(t):
    """Runs labelled after every kind of event, its translation, a part of it, and what is none of these."""
    kind = F.col("event_type")
    runs = t.events.select("event_type").distinct().select(F.explode(F.array(kind, F.concat(kind, F.lit("/translation")), F.substring(kind, 1, 3), F.concat(kind, F.lit("?")))).alias("label"))
    return evaluation.ledger_runs(t.events.select("event_id", "event_type"), "event_type", runs, "label").select("event_id", "label")


@query("WITH n AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) SELECT o_custkey, l_linenumber, p_brand, p_type FROM n JOIN lineitem ON l_orderkey = k JOIN part ON p_partkey = l_partkey")
def j26_current_view(t):
    """The newest assignment of each rule, one row for each of its enforcers, with subcategory and class."""
    newest = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    return newest.join(t.lineitem, "l_orderkey").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("o_custkey", "l_linenumber", "p_brand", "p_type")


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS rel FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def j27_exclude_setup(t):
    return merge.not_yet(t.pages, t.pages.where("page_id % 3 = 0"), ["url"]).select("page_id", F.regexp_replace("url", "^https?://", "").alias("rel"))


@query("WITH u AS (SELECT conv_id, max(turn) AS k FROM conversations WHERE role = 'user' GROUP BY 1) SELECT c.conv_id, k, count(*) FILTER (role = 'assistant' AND turn > k) AS after FROM conversations c JOIN u ON u.conv_id = c.conv_id GROUP BY ALL")
def j28_after_last(t):
    last = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("k"))
    return t.conversations.join(last, "conv_id").groupBy("conv_id", "k").agg(F.count_if((F.col("role") == "assistant") & (F.col("turn") > F.col("k"))).alias("after"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1")
def a5_majority(t):
    return evaluation.majority(t.events, "user_id", "event_type", "event_id")


@query("SELECT event_type, count(*) FILTER (bad) AS cases, count(*) FILTER (bad AND flagged) AS caught, count(*) FILTER (bad AND flagged AND named) AS named, count(*) FILTER (bad AND flagged AND early) AS early, count(*) FILTER (NOT bad AND flagged) AS false_flags, count(*) FILTER (flagged IS NULL) AS errors FROM (SELECT event_type, event_id % 2 = 0 AS bad, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 <> 0 END AS flagged, event_id % 5 = 0 AS named, event_id % 7 = 0 AS early FROM events) GROUP BY 1")
def a11_caught(t):
    cases = t.events.selectExpr("event_type", "event_id % 2 = 0 AS bad", "CASE WHEN event_id % 11 <> 0 THEN event_id % 3 <> 0 END AS flagged", "event_id % 5 = 0 AS named", "event_id % 7 = 0 AS early")
    return evaluation.caught(cases, ["event_type"])


@query("SELECT event_type, count(*) FILTER (value >= 50) AS states, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id END) AS BIGINT) AS spent, 20000 - count(*) AS unfinished FROM events GROUP BY 1")
def a14_a15_a34_counts(t):
    cost = F.coalesce(F.when(F.col("event_id") % 7 != 0, F.col("event_id")), F.lit(0))
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("states"), F.count("*").alias("n"), F.sum(cost).alias("spent"), (20000 - F.count("*")).alias("unfinished"))


@query("SELECT l_returnflag, count(*) AS n, CASE WHEN count(*) > 4 THEN array_to_string(list(m ORDER BY m)[1:4], ', ') || ', …' ELSE array_to_string(list(m ORDER BY m), ', ') END AS names FROM (SELECT DISTINCT l_returnflag, 'n' || l_linenumber AS m FROM lineitem) GROUP BY 1")
def a26_first_names(t):
    return evaluation.first_names(t.lineitem.withColumn("m", F.concat(F.lit("n"), "l_linenumber")), "l_returnflag", "m")


@query("SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS yes, count(*) FILTER (event_id % 3 = 1) AS no, count(*) FILTER (event_id % 3 = 2) AS unresolved, round(sum(event_id % 100) / sum(event_id % 100 + 50), 8) AS cache_ratio, round(1000.0 * sum(event_id % 100) / count(*), 6) AS per_1k FROM events GROUP BY 1")
def a28_judged(t):
    r, c = F.col("event_id") % 3, F.col("event_id") % 100
    return t.events.groupBy("event_type").agg(F.count_if(r == 0).alias("yes"), F.count_if(r == 1).alias("no"), F.count_if(r == 2).alias("unresolved"), F.round(F.sum(c) / F.sum(c + 50), 8).alias("cache_ratio"), F.round(1000.0 * F.sum(c) / F.count("*"), 6).alias("per_1k"))


@query("WITH m AS (SELECT l_orderkey, l_linestatus || l_returnflag AS plan, round(avg(l_quantity), 8) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, plan, p FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, plan) = 1")
def a30_mean_plan(t):
    m = t.lineitem.groupBy("l_orderkey", F.concat("l_linestatus", "l_returnflag").alias("plan")).agg(F.round(F.avg("l_quantity"), 8).alias("p"))
    return m.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("p")).alias("m"), "plan")).alias("b")).select("l_orderkey", "b.plan", (-F.col("b.m")).alias("p"))


@query("SELECT l_shipmode, n FROM (SELECT l_linestatus AS l_shipmode, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS n FROM lineitem GROUP BY 1)")
def a36_state_sets(t):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("n"))


@query("SELECT o_custkey, o_orderkey, coalesce(o_orderkey <> lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1, false) AS gap FROM orders")
def w5_gaps(t):
    return evaluation.gaps(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT user_id, min_by(props, event_id) FILTER (event_type = 'error') AS first_crash, min_by(event_id, event_id) FILTER (event_type = 'purchase') AS first_stop FROM events GROUP BY 1")
def w13_firsts(t):
    e, p = F.col("event_type") == "error", F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(F.min_by(F.when(e, F.col("props")), F.when(e, F.col("event_id"))).alias("first_crash"), F.min(F.when(p, F.col("event_id"))).alias("first_stop"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS number FROM nation")
def w14_hook_numbers(t):
    """Hooks of all scopes numbered in scope order: a settings file's rows, few by nature."""
    return t.nation.select("n_name", F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")).cast("long").alias("number"))


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' EXCEPT SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'")
def w17_new_sessions(t):
    return merge.not_yet(t.events.where("ts >= TIMESTAMP '2024-01-20'").select("user_id").distinct(), t.events.where("ts < TIMESTAMP '2024-01-02'"), ["user_id"])


@query("SELECT p_partkey FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 40")
def t6_hashed_head(t):
    """The first rows of a fixed shuffle (a sampling operator: the limit is the feature)."""
    return t.part.select("p_partkey").orderBy(F.md5(F.col("p_partkey").cast("string")), "p_partkey").limit(40)


@query("SELECT row_number() OVER (ORDER BY [r_name, n_name], -n_nationkey) AS pos, n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def t7_path_order(t):
    paths = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")).select(F.array("r_name", "n_name").alias("path"), "n_name", "n_nationkey")
    return paths.select(F.row_number().over(Window.orderBy("path", F.desc("n_nationkey"))).cast("long").alias("pos"), "n_name")


@query(r"SELECT p_partkey, regexp_replace(regexp_replace('|  ' || p_brand || '|' || p_type || '   |', '^\|\s*|\s*\|$', '', 'g'), '\s*\|\s*', ' | ', 'g') AS cells FROM part")
def f6_table_cells(t):
    return t.part.select("p_partkey", text.table_cells(F.concat(F.lit("|  "), "p_brand", F.lit("|"), "p_type", F.lit("   |"))).alias("cells"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS meta FROM part")
def f10_field_meta(t):
    leaf = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("model: "), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("description: Use it when "), "p_name", F.lit(" fails badly"))).otherwise("- Do it.")
    return t.part.select("p_partkey", text.is_field_meta(leaf).alias("meta"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT 'no shouting' AS rule, doc_id AS "where", CAST(line AS BIGINT) AS line, regexp_extract(own, '([A-Z]+!!)', 1) AS found FROM l WHERE regexp_matches(own, '[A-Z]+!!') UNION ALL SELECT 'has the', doc_id, 0, '' FROM documents WHERE NOT regexp_matches(text, '(?i)\bthe\b')""")
def f13_validate(t):
    return evaluation.faults(t.documents, "doc_id", "text", [("no shouting", "[A-Z]+!!", False), ("has the", r"(?i)\bthe\b", True)]).withColumn("line", F.col("line").cast("long"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), f AS (SELECT doc_id, line, format('{}:{}: {} {}', doc_id, line, 'no shouting', regexp_extract(own, '([A-Z]+!!)', 1)) AS m FROM l WHERE regexp_matches(own, '[A-Z]+!!'))
SELECT doc_id AS "where", count(*) AS n, string_agg(m, chr(10) ORDER BY line) AS message FROM f GROUP BY 1""")
def m28_gate_message(t):
    return evaluation.report(evaluation.faults(t.documents.select(F.col("doc_id").cast("string").alias("doc"), "text", "doc_id"), "doc", "text", [("no shouting", "[A-Z]+!!", False)])).withColumn("where", F.col("where").cast("long"))


@query("SELECT doc_id, regexp_replace(text, '!!', '.', 'g') AS fixed FROM documents")
def f14_make_compliant(t):
    return t.documents.select("doc_id", F.regexp_replace("text", "!!", ".").alias("fixed"))


@query("SELECT p_partkey, array_to_string([p_brand, p_type], '|') AS parts FROM part")
def f16_quoted_parts(t):
    s = F.concat(F.lit('say "'), "p_brand", F.lit('" and " '), "p_type", F.lit(' " then "'), "p_brand", F.lit('"'))
    return t.part.select("p_partkey", F.array_join(text.quoted_parts(s), "|").alias("parts"))


@query("SELECT event_id, CAST(event_id % 97 AS VARCHAR) AS task, event_type AS arm, strftime(ts, '%Y%m%d') AS day FROM events")
def f27_labels(t):
    label = F.concat(F.lit("task-"), F.col("event_id") % 97, F.lit("/"), "event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd-HHmmss"))
    return t.events.select("event_id", F.regexp_extract(label, r"task-(\d+)/", 1).alias("task"), F.regexp_extract(label, r"/([a-z]+)-", 1).alias("arm"), F.regexp_extract(label, r"-(\d{8})-\d{6}\z", 1).alias("day"))


@query("SELECT p_partkey, string_agg(a || b, ',' ORDER BY a, b) AS pairs FROM part, (VALUES ('x'), ('y')) u(a), (VALUES ('1'), ('2'), ('3')) v(b) GROUP BY 1")
def f32_product(t):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))
    return t.part.select("p_partkey", F.array_join(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, y)))), ",").alias("pairs"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","none":null,"size":' || p_size || '}' AS j FROM part""")
def f34_json(t):
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("none"), F.col("p_size").alias("size")), {"ignoreNullFields": "false"}).alias("j"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent, least(10 * 2 ** (event_id % 7), 300) AS wait FROM events")
def f37_f40_rates(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3600 * 1000000, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("recent"), F.least(10 * F.pow(F.lit(2.0), F.col("event_id") % 7), F.lit(300.0)).alias("wait"))


@query("SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, ends_with(text, chr(10)) AS final FROM documents")
def f45_lines(t):
    final = F.endswith("text", F.lit("\n"))
    return t.documents.select("doc_id", (F.size(F.split("text", "\n")) - final.cast("int")).cast("long").alias("lines"), final.alias("final"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line, CAST(coalesce(sum(length(own) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l")
def f48_line_starts(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "own"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.coalesce(F.sum(F.length("own") + 1).over(w), F.lit(0)).cast("long").alias("start"))


@query("SELECT NOT EXISTS (SELECT 1 FROM nation FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> 7) ON k = n_nationkey WHERE k IS NULL OR n_nationkey IS NULL) AS usable")
def l8_reuse_partition(t):
    known = t.nation.select(F.col("n_nationkey").alias("id"))
    return votes.partition_faults(known.where("id <> 7"), known).agg((F.count("*") == 0).alias("usable"))


@query("SELECT n_name AS path, timing FROM nation, (VALUES ('before'), ('at'), ('after')) v(timing) WHERE NOT (timing = 'before' AND n_nationkey % 3 = 0) AND n_nationkey % 4 <> 1")
def l10_timings(t):
    timings = F.array(F.lit("before"), F.lit("at"), F.lit("after"))
    all_ = t.nation.withColumn("timing", F.explode(timings))
    runnable = all_.where("NOT (timing = 'before' AND n_nationkey % 3 = 0) AND n_nationkey % 4 <> 1").select(F.col("n_name").alias("path"), "timing")
    return evaluation.with_timings(t.nation.select(F.col("n_name").alias("path")), timings, runnable)


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, '') AS enforcer, CASE WHEN p_partkey % 3 = 0 THEN 'a b' ELSE '' END AS spec FROM part")
def l17_records(t):
    answer = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand"))
    spec = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    return t.part.select("p_partkey", F.array_join(text.values_of(answer), "|").alias("enforcer"), F.array_join(F.coalesce(spec, F.array().cast("array<string>")), " ").alias("spec"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN p IS NOT NULL THEN p = 1 END AS passed FROM orders LEFT JOIN (SELECT l_orderkey, min(CASE WHEN l_tax < 0.07 THEN 1 ELSE 0 END) AS p FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1) ON l_orderkey = o_orderkey")
def m15_scored_run(t):
    verdicts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", (F.col("l_tax") < 0.07).alias("passed"))
    excluded = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return evaluation.scored(t.orders.select("o_orderkey", "o_orderstatus"), verdicts, excluded, ["o_orderkey"], "l_suppkey")


@query("SELECT user_id % 9 AS hook, count(*) FILTER (event_type = 'purchase') AS flags, count(*) FILTER (event_type = 'error') AS errors, count(*) AS runs, min_by(props, event_id) FILTER (event_type = 'error') AS crash, min_by(props, event_id) FILTER (event_type = 'purchase') AS says, count(DISTINCT user_id) AS ran_in, 40 - count(DISTINCT user_id) AS missed, count(*) FILTER (event_type = 'error') = 0 AS works FROM events GROUP BY 1")
def m19_hook_status(t):
    rows = t.events.select((F.col("user_id") % 9).alias("hook"), "user_id", "props", "event_id", F.expr("CASE event_type WHEN 'purchase' THEN 'flag' WHEN 'error' THEN 'error' ELSE 'pass' END").alias("verdict"))
    return evaluation.health(rows, "hook", "user_id", "verdict", "props", "event_id", 40)


@query("WITH f AS (SELECT n_regionkey, n_nationkey, 'd' || (n_nationkey % 11) AS line FROM nation WHERE n_nationkey % 5 <> 2) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY line ORDER BY n_regionkey, n_nationkey) = 1")
def m25_route_cards(t):
    lines = t.nation.select("n_regionkey", "n_nationkey", F.concat(F.lit("d"), F.col("n_nationkey") % 11).alias("line"))
    return evaluation.route_cards(lines, "n_regionkey", "n_nationkey", "line", F.col("n_nationkey") % 5 != 2).select("n_regionkey", "n_nationkey", "line")
