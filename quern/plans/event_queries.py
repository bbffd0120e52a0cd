"""Queries over events and conversations: turns, intervals, stalls, permissions, compliance and cost tables, checkpoints."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import evaluation, merge, metrics, sessions
from quern.plans.registry import query
from quern.session import scratch
from quern.sources import logs, readers, writers


def is_user():
    return F.col("role") == "user"


@query("SELECT conv_id, turn, role, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS turn_no FROM conversations")
def w7_turns(t):
    return sessions.turns(t.conversations, "conv_id", "turn", is_user()).select("conv_id", "turn", "role", "turn_no")


TURNS = "t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM conversations)"


@query(f"WITH {TURNS} SELECT conv_id, CAST(k AS BIGINT) AS turn_no, max_by(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS reply FROM t WHERE k > 0 GROUP BY conv_id, k")
def w8_last_reply(t):
    return sessions.last_text(t.conversations, "conv_id", "turn", is_user(), F.col("role") == "assistant")


@query(f"WITH {TURNS}, r AS (SELECT conv_id, k, max_by(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS reply, min_by(text, turn) AS saved FROM t WHERE k > 0 GROUP BY conv_id, k) SELECT conv_id, CAST(k AS BIGINT) AS turn_no, coalesce(reply, saved) AS reply FROM r")
def m16_reply_choice(t):
    replies = sessions.last_text(t.conversations, "conv_id", "turn", is_user(), F.col("role") == "assistant")
    saved = sessions.turns(t.conversations, "conv_id", "turn", is_user()).where("turn_no > 0").groupBy("conv_id", "turn_no").agg(F.min_by("text", "turn").alias("saved"))
    return replies.join(saved, ["conv_id", "turn_no"]).select("conv_id", "turn_no", F.coalesce("reply", "saved").alias("reply"))


@query("WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), e AS (SELECT * FROM events WHERE event_type <> 'signup') SELECT e.event_id, (SELECT max_by(m.event_id, (m.ts, m.event_id)) FROM m WHERE m.user_id = e.user_id AND m.ts <= e.ts) AS mark FROM e")
def j13_interval(t):
    marks = t.events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return sessions.in_intervals(t.events.where("event_type <> 'signup'"), marks, "user_id", "ts", "event_id").select("event_id", "mark")


@query("SELECT event_id, round(gap, 3) AS gap_s FROM (SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events) WHERE gap > 86400")
def w11_stalls(t):
    return sessions.stalls(t.events, "user_id", "ts", "event_id", 86400).select("event_id", F.round("gap_s", 3).alias("gap_s"))


@query("WITH r AS (SELECT *, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events) SELECT user_id, mark, min_by(event_id, (ts, event_id)) AS event_id, CAST(min_by(running, (ts, event_id)) AS BIGINT) AS running FROM r, (VALUES (250), (500), (1000), (2000)) m(mark) WHERE mark <= running GROUP BY user_id, mark")
def w10_thresholds(t):
    events = t.events.withColumn("whole", F.floor("value").cast("long"))
    return sessions.crossings(events, "user_id", ["ts", "event_id"], "whole", [250, 500, 1000, 2000]).select("user_id", "mark", "event_id", "running")


@query("""WITH w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN (ts, event_id) END) OVER o AS g, max(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER o AS r FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, coalesce(g IS NOT NULL AND ts <= g[1] + INTERVAL 4320 MINUTES AND (r IS NULL OR r < g), false) AS allowed FROM w WHERE event_type = 'purchase'""")
def m20_permission(t):
    kind = F.col("event_type")
    return sessions.permitted(t.events, "user_id", "ts", "event_id", kind == "purchase", kind == "view", kind == "error", 4320).select("event_id", "allowed")


@query("WITH v AS (SELECT event_type AS source, CAST(ts AS DATE)::VARCHAR AS day, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value * 100 AS BIGINT) END AS c FROM events) SELECT source, day, count(*) AS n, CAST(sum(coalesce(c, 0)) AS BIGINT) AS total FROM v GROUP BY GROUPING SETS ((source), (day), ())")
def a8_spend(t):
    cost = t.events.withColumn("c", F.when(F.col("event_id") % 7 != 0, F.expr("cast(round(value * 100) as bigint)")))
    return metrics.spend(cost, F.col("event_type"), F.substring(F.col("ts").cast("string"), 1, 10), "c").select("source", "day", "n", F.col("total").cast("long").alias("total"))


VERDICTS = """v AS (SELECT conv_id, turn, rule, role AS arm, CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL WHEN rule = 'R1' THEN starts_with(text, 'T') WHEN rule = 'R2' THEN length(text) > 200 ELSE contains(text, ',') END AS passed, CASE WHEN rule = 'R1' THEN turn % 2 = 0 WHEN rule = 'R2' THEN turn % 3 = 0 ELSE NULL END AS fired FROM conversations, (VALUES ('R1'), ('R2'), ('R3')) r(rule))"""


def verdicts(t):
    rule = F.explode(F.array(F.lit("R1"), F.lit("R2"), F.lit("R3"))).alias("rule")
    base = t.conversations.select("conv_id", "turn", F.col("role").alias("arm"), "text", rule)
    passed = F.expr("CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL WHEN rule = 'R1' THEN startswith(text, 'T') WHEN rule = 'R2' THEN length(text) > 200 ELSE contains(text, ',') END")
    return base.select("conv_id", "turn", "rule", "arm", passed.alias("passed"), F.expr("CASE WHEN rule = 'R1' THEN turn % 2 = 0 WHEN rule = 'R2' THEN turn % 3 = 0 END").alias("fired"))


@query(f"WITH {VERDICTS} SELECT rule, arm, count(*) FILTER (passed) AS passed, count(passed) AS scored, round(100.0 * count(*) FILTER (passed) / greatest(count(passed), 1), 1) AS pct FROM v GROUP BY GROUPING SETS ((rule, arm), (arm))")
def a9_pass_table(t):
    return metrics.pass_table(verdicts(t))


@query(f"WITH {VERDICTS} SELECT rule, count(*) FILTER (passed AND coalesce(fired, false)) AS fixed, count(*) FILTER (passed AND NOT coalesce(fired, false)) AS alone, count(*) FILTER (NOT passed AND coalesce(fired, false)) AS not_fixed, count(*) FILTER (NOT passed AND NOT coalesce(fired, false)) AS missed FROM v WHERE passed IS NOT NULL GROUP BY rule")
def a10_attribution(t):
    return metrics.attribution(verdicts(t))


@query(f"WITH {VERDICTS}, e AS (SELECT conv_id, turn, avg(CAST(passed AS INT)) AS share, min(CAST(passed AS INT)) AS every FROM v GROUP BY ALL) SELECT turn, round(avg(share), 8) AS csr, round(avg(every), 8) AS c_isr, count(*) AS n FROM e WHERE share IS NOT NULL GROUP BY turn")
def a29_csr(t):
    out = metrics.csr(verdicts(t), "conv_id", "turn")
    return out.select("turn", F.round("csr", 8).alias("csr"), F.round("c_isr", 8).alias("c_isr"), "n")


@query("WITH b AS (SELECT l.quality = 1 AS t, coalesce(p.v, false) AS v FROM labels l LEFT JOIN (SELECT doc_id, n_chars > 300 AS v FROM documents WHERE doc_id % 10 <> 0) p ON p.doc_id = l.doc_id), n AS (SELECT count(*) FILTER (t AND v) AS tp, count(*) FILTER (NOT t AND v) AS fp, count(*) FILTER (t AND NOT v) AS fn, count(*) FILTER (NOT t AND NOT v) AS tn FROM b) SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM n")
def a16_eval(t):
    truth = t.labels.select("doc_id", (F.col("quality") == 1).alias("t"))
    predicted = t.documents.where("doc_id % 10 <> 0").select("doc_id", (F.col("n_chars") > 300).alias("v"))
    return metrics.evaluated(truth, predicted, "doc_id", "t", "v")


@query("SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def s7_checkpoint(t):
    rows = t.events.select("user_id", "event_id", F.from_json("props", "k long")["k"].alias("k"), F.when(F.col("event_id") % 9 == 0, "failed").alias("error"))
    return merge.last_of_each(rows, "user_id", "event_id", "error").select("user_id", "event_id", "k")


@query("SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1")
def s7_appended_log(t):
    """All events in three appends, a snapshot before the last; then the last good record of each user."""
    path = scratch(t.spark, "log")
    rows = t.events.select("user_id", "event_id", F.from_json("props", "k long")["k"].alias("k"), F.when(F.col("event_id") % 9 == 0, "failed").alias("error"))
    for part in range(3):
        if part == 2:
            logs.snapshot(t.spark, path, "user_id")
        writers.append_checkpoint(rows.where(F.col("event_id") % 3 == part).orderBy("event_id"), path)
    return readers.checkpoint(t.spark, path, "user_id long, event_id long, k long, error string", "user_id").select("user_id", "event_id", "k")


@query("SELECT event_id, len(list_filter([event_id, event_id + 1], lambda x: x % 2 = 0)) AS n FROM events WHERE event_id % 5 <> 0")
def f25_json_in_text(t):
    answer = F.concat(F.lit('Sure: [{"ID": '), "event_id", F.lit(', "is_rule": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit('}, {"ID": '), F.col("event_id") + 1, F.lit(', "is_rule": '), (F.col("event_id") % 2 == 1).cast("string"), F.lit("}] done"))
    parsed = text.json_array_in(F.when(F.col("event_id") % 5 != 0, answer).otherwise("none"), "array<struct<ID long, is_rule boolean>>")
    return t.events.select("event_id", parsed.alias("p")).where("p IS NOT NULL").select("event_id", F.size(F.filter("p", lambda x: x["is_rule"])).cast("long").alias("n"))


@query("SELECT event_id, 'x' || event_id AS last FROM events")
def f26_last_json_line(t):
    out = F.concat(F.lit('log\n{"a": "y"}\n{"a": "x'), "event_id", F.lit('"}\nbye'))
    return t.events.select("event_id", F.get_json_object(text.last_json_line(out), "$.a").alias("last"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'flag' WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'flag' WHEN event_id % 4 = 0 AND event_id % 7 = 0 THEN 'fix' WHEN event_id % 4 <> 0 THEN 'error' ELSE 'pass' END AS verdict FROM (SELECT *, event_id % 4 AS c FROM events WHERE event_id % 4 <> 2)")
def m12_hook_verdict(t):
    e = t.events.where("event_id % 4 <> 2")
    decision = F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), "block")
    return e.select("event_id", metrics.hook_verdict((F.col("event_id") % 4).cast("int"), decision, F.when(F.col("event_id") % 3 == 0, False), F.when(F.col("event_id") % 7 == 0, "new")).alias("verdict"))


@query("WITH h(hook, ev, matcher) AS (VALUES (1, 'Pre', 'view|purchase'), (2, 'Pre', ''), (3, 'Post', '*'), (4, 'Pre', 'vie')) SELECT event_id, hook FROM events, h WHERE ev = CASE WHEN event_id % 2 = 0 THEN 'Pre' ELSE 'Post' END AND (matcher IN ('', '*') OR regexp_full_match(event_type, matcher))")
def m13_hook_matching(t):
    """A theta join with the hooks of a settings file, which is small."""
    hooks = t.spark.createDataFrame([(1, "Pre", "view|purchase"), (2, "Pre", ""), (3, "Post", "*"), (4, "Pre", "vie")], "hook int, ev string, matcher string")
    e = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, "Pre").otherwise("Post").alias("on"))
    return e.join(F.broadcast(hooks), metrics.hook_matches(F.col("ev"), F.col("on"), F.col("matcher"), F.col("event_type"))).select("event_id", "hook")


@query("SELECT conv_id, turn, channel FROM conversations, (VALUES ('tool'), ('shell'), ('reply')) c(channel) WHERE NOT (channel = 'shell' AND role = 'user')")
def m14_cases(t):
    each = t.conversations.select("conv_id", "turn", "role", F.explode(F.array(*map(F.lit, ("tool", "shell", "reply")))).alias("channel"))
    return each.where("NOT (channel = 'shell' AND role = 'user')").select("conv_id", "turn", "channel")


@query("WITH c AS (SELECT event_id AS id, user_id, event_type FROM events WHERE event_id % 3 = 0), r AS (SELECT event_id - 1 AS id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 3 = 1 AND event_id % 2 = 0) SELECT c.id, user_id, event_type, v FROM c LEFT JOIN r ON r.id = c.id")
def j14_paired(t):
    calls = t.events.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), "user_id", "event_type")
    results = t.events.where("event_id % 3 = 1 AND event_id % 2 = 0").select((F.col("event_id") - 1).alias("id"), F.floor("value").alias("v"))
    return sessions.paired(calls, results, "id")


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w6_latest_run(t):
    return sessions.latest(t.events.select("user_id", "event_type", "event_id", "ts", F.struct("ts", "event_id").alias("stamp")), ["user_id", "event_type"], "stamp").select("user_id", "event_type", "event_id", "ts")


@query("SELECT user_id, event_type, count(*) AS n, min_by(event_id, (ts, event_id)) AS first, string_agg(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR), ',' ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) AS days FROM events GROUP BY ALL")
def a27_run_health(t):
    days = F.array_join(F.array_sort(F.collect_set(F.substring(F.col("ts").cast("string"), 1, 10))), ",")
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first"), days.alias("days"))


HEALTH = """h AS (SELECT DISTINCT user_id % 30 AS hook, CASE WHEN user_id % 30 % 6 < 5 THEN user_id % 30 % 6 END AS rule, CASE WHEN user_id % 30 % 7 = 0 THEN 'Display' ELSE 'Stop' END AS event FROM events WHERE user_id % 30 <> 3 OR user_id > 30),
r AS (SELECT user_id % 30 AS hook, CAST(day(ts) AS INT) AS turn, CASE WHEN event_type = 'purchase' THEN 'block' WHEN event_type = 'error' AND user_id % 30 % 5 = 1 THEN 'crash' WHEN event_type = 'error' AND user_id % 30 % 5 = 2 THEN 'error' ELSE 'pass' END AS v, props, event_id FROM events),
s AS (SELECT DISTINCT doc_id % 5 AS rule, CAST(1 + doc_id % 30 AS INT) AS turn FROM documents WHERE n_chars < 150),
p AS (SELECT hook, turn, count(*) FILTER (v = 'pass') AS passes, count(*) FILTER (v IN ('block', 'crash')) AS stopped FROM r GROUP BY ALL),
m AS (SELECT p.hook, list(p.turn ORDER BY p.turn) AS missed FROM p JOIN h ON h.hook = p.hook JOIN s ON s.rule = h.rule AND s.turn = p.turn WHERE passes > 0 AND stopped = 0 GROUP BY p.hook),
a AS (SELECT hook, count(*) AS runs, count(*) FILTER (v = 'block') AS stops, count(*) FILTER (v = 'crash') AS crashes, count(*) FILTER (v = 'error') AS errors, min_by(props, event_id) FILTER (v = 'block') AS said, min_by(props, event_id) FILTER (v = 'crash') AS sample FROM r GROUP BY hook),
x AS (SELECT h.hook, h.rule, h.event, coalesce(runs, 0) AS runs, coalesce(stops, 0) AS stops, coalesce(crashes, 0) AS crashes, coalesce(errors, 0) AS errors, said, sample, coalesce(array_to_string(missed, ','), '') AS missed FROM h LEFT JOIN a ON a.hook = h.hook LEFT JOIN m ON m.hook = h.hook),
z AS (SELECT *, event = 'Stop' AND runs > 0 AND crashes = 0 AND errors = 0 AND missed = '' AS working, CASE WHEN event <> 'Stop' THEN 'cannot check the work' ELSE coalesce(nullif(concat_ws(', ', CASE WHEN stops > 0 THEN 'stopped the agent ' || stops || ' times' END, CASE WHEN runs = 0 THEN 'never ran' END, CASE WHEN crashes > 0 THEN 'crashes' END,
  CASE WHEN errors > 0 THEN 'errors that nobody is told' END, CASE WHEN missed <> '' THEN 'missed a violation' END), ''), 'never had to stop the agent') END AS status FROM x)"""


def _health(t):
    hook = F.col("user_id") % 30
    hooks = t.events.where((hook != 3) | (F.col("user_id") > 30)).select(hook.alias("hook")).distinct()
    hooks = hooks.select("hook", F.when(F.col("hook") % 6 < 5, F.col("hook") % 6).alias("rule"), F.when(F.col("hook") % 7 == 0, "Display").otherwise("Stop").alias("event"))
    verdict = F.expr("CASE WHEN event_type = 'purchase' THEN 'block' WHEN event_type = 'error' AND user_id % 30 % 5 = 1 THEN 'crash' WHEN event_type = 'error' AND user_id % 30 % 5 = 2 THEN 'error' ELSE 'pass' END")
    runs = t.events.select(hook.alias("hook"), F.dayofmonth("ts").alias("turn"), verdict.alias("verdict"), F.col("props").alias("message"), F.col("event_id").alias("seq"))
    scores = t.documents.select((F.col("doc_id") % 5).alias("rule"), (1 + F.col("doc_id") % 30).cast("int").alias("turn"), (F.col("n_chars") >= 150).alias("passed"))
    return evaluation.hook_health(hooks, runs, scores, ["Stop"])


@query(f"WITH {HEALTH} SELECT * FROM z")
def a27_hook_health(t):
    """Whether each hook works in a run: what it did, its first words, the turns that it missed."""
    return _health(t).withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ","))


@query(f"""WITH {HEALTH} SELECT n AS rule, coalesce(bool_or(working), false) AS working, CAST(coalesce(sum(stops), 0) AS BIGINT) AS stops,
CASE WHEN count(hook) = 0 THEN 'no hook was built for this rule' ELSE coalesce(string_agg('hook ' || hook || ' (' || event || '): ' || status, '; ' ORDER BY hook) FILTER (NOT working), '') END AS why FROM range(7) g(n) LEFT JOIN z ON z.rule = n GROUP BY n""")
def a27_rule_health(t):
    """Whether each rule has a hook that works, and if not, why."""
    return evaluation.rule_health(_health(t), t.spark.range(7).select(F.col("id").alias("rule")))


@query("SELECT event_id, round(value * 0.25 + event_id % 10 * 1.25, 6) AS cost, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d') AS day, CAST(ceil(event_id / 7.0) AS BIGINT) AS batch, least(greatest(event_id, 10), 5000) AS clamped FROM events")
def f36_f38_f39_numbers(t):
    return t.events.select("event_id", F.round(F.col("value") * 0.25 + F.col("event_id") % 10 * 1.25, 6).alias("cost"), F.date_format("ts", "HH:mm:ss").alias("clock"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.ceil(F.col("event_id") / 7.0).alias("batch"), F.least(F.greatest("event_id", F.lit(10)), F.lit(5000)).cast("long").alias("clamped"))


@query("WITH b AS (SELECT *, event_id // 5 AS batch FROM events) SELECT event_id, batch, round(value / count(*) OVER (PARTITION BY batch), 8) AS share FROM b")
def a25_usage_share(t):
    b = t.events.withColumn("batch", F.expr("event_id div 5"))
    return b.select("event_id", "batch", F.round(F.col("value") / F.count("*").over(Window.partitionBy("batch")), 8).alias("share"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' OR regexp_matches(props, '\"k\": 7[0-9]')")
def p19_milestones(t):
    return t.events.where((F.col("event_type") == "error") | F.col("props").rlike('"k": 7[0-9]')).select("event_id", "event_type")


@query("SELECT user_id, event_id, greatest(count(*) OVER (PARTITION BY user_id) - 150, 0) AS n_more FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 150")
def p21_own_files(t):
    """At most 150 files listed for each owner (the limit is the feature), beside the number of those left out."""
    return evaluation.listed(t.events.where("event_type <> 'view'"), "user_id", "event_id")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id")
def f41_message_text(t):
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "assistant", "text").otherwise("other").alias("type"), "text"))), lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text")))
    return t.conversations.groupBy("conv_id").agg(blocks.alias("blocks")).select("conv_id", F.nullif(text.message_text(F.col("blocks")), F.lit("")).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' END AS agent FROM events")
def f42_header(t):
    m = F.create_map(F.when(F.col("event_id") % 3 == 0, "X-Agent").when(F.col("event_id") % 3 == 1, "x-AGENT").otherwise("other"), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b"))
    return t.events.select("event_id", text.header(m, "x-agent").alias("agent"))


@query("WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def x4_status_windows(t):
    return t.events.groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def x2_first_alerts(t):
    return merge.keep_first(t.events, [F.col("user_id"), F.col("event_type")], ["event_id"]).select("user_id", "event_type", "event_id")
