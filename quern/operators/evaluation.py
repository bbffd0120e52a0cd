"""Evaluation of agent runs: whose hook fired, what it says, which rule it serves, what a turn scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import merge

MENTIONS = 4


def first_match(candidates: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """key, value from the first frame that has it: candidates in order of priority, each with one value a key at most."""
    out = None
    for i, c in enumerate(candidates):
        one = c.select(key, F.struct(F.lit(i).alias("p"), F.col(value).alias("v")).alias("c"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min("c").alias("c")).select(key, F.col("c.v").alias(value))


def only_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value where a key has exactly one distinct value."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_m")).where(F.col(value) == F.col("_m")).drop("_m")


def fired(blocks: DataFrame, owners: DataFrame, messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and rule that fired in a turn: rules of hooks that blocked (keys, hook; owners: hook, rule) and rules named in messages (keys, text), once each."""
    by_hook = blocks.join(owners, "hook").select(*keys, "rule")
    named = messages.select(*keys, F.explode(text.rule_ids(F.col("text"))).alias("rule"))
    return by_hook.unionByName(named).distinct()


def caught(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of held-out cases (bad, flagged, named, early): caught, named, early among bad ones; false flags among good ones; errors (flagged null)."""
    bad, flag = F.col("bad"), F.col("flagged")
    return cases.groupBy(*by).agg(
        F.count_if(bad).alias("cases"), F.count_if(bad & flag).alias("caught"), F.count_if(bad & flag & F.col("named")).alias("named"), F.count_if(bad & flag & F.col("early")).alias("early"), F.count_if(~bad & flag).alias("false_flags"), F.count_if(flag.isNull()).alias("errors")
    )


def health(rows: DataFrame, hook: str, turn: str, verdict: str, message: str, order: str, turns: int) -> DataFrame:
    """Per hook: counts by verdict, its first crash and first message, turns in which it ran, how many it missed, whether it works."""
    v = F.col(verdict)
    return rows.groupBy(hook).agg(
        F.count_if(v == "flag").alias("flags"), F.count_if(v == "error").alias("errors"), F.count("*").alias("runs"), F.min_by(F.when(v == "error", F.col(message)), F.when(v == "error", F.col(order))).alias("crash"), F.min_by(F.when(v == "flag", F.col(message)), F.when(v == "flag", F.col(order))).alias("says"), F.countDistinct(turn).alias("ran_in")
    ).withColumn("missed", turns - F.col("ran_in")).withColumn("works", (F.col("errors") == 0) & (F.col("runs") > 0))


def scored(items: DataFrame, verdicts: DataFrame, excluded: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Every item of every turn with its verdict: null where no check was made; files of the set-up phase don't count."""
    counted = verdicts.join(excluded, path, "left_anti")
    worst = counted.groupBy(*keys).agg(F.min(F.col("passed").cast("int")).alias("p"))
    return items.join(worst, list(keys), "left").select(*items.columns, (F.col("p") == 1).alias("passed"))


def with_timings(paths: DataFrame, timings: Column, runnable: DataFrame) -> DataFrame:
    """A trigger tree's leaves grown by timing: each path with each of its timings that can run (runnable: path, timing)."""
    return paths.withColumn("timing", F.explode(timings)).join(runnable, ["path", "timing"], "left_semi")


def route_cards(lines: DataFrame, node: str, order: str, line: str, timing: Column) -> DataFrame:
    """Lines of a node's card, those of a timing that applies, and each detail at its first place only."""
    kept = lines.where(timing)
    first = kept.groupBy(line).agg(F.min(F.struct(node, order)).alias("_f"))
    return kept.join(first, line).where((F.col("_f")[node] == F.col(node)) & (F.col("_f")[order] == F.col(order))).drop("_f")


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most common value of each key; ties go to the one seen first."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return n.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("m"), "seen")).alias("b")).select(key, "b.*")


def first_names(rows: DataFrame, key: str, name: str, most: int = MENTIONS) -> DataFrame:
    """key, n, names: "a, b, c, d, …" of its distinct names in order."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("s"))
    text_ = F.concat(F.array_join(F.slice("s", 1, most), ", "), F.when(F.size("s") > most, ", …").otherwise(""))
    return sets.select(key, F.size("s").cast("long").alias("n"), text_.alias("names"))


def listed(rows: DataFrame, key: str, order: str, most: int = 150) -> DataFrame:
    """key, order, n_more: a key's first `most` rows and how many more it has. The limit holds before the shuffle and the count is
    summed in parts, so a key with very many rows sends little."""
    first = merge.keep_first(rows.select(key, order), [F.col(key)], [order], most)
    n = rows.groupBy(F.col(key).alias("_k")).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))
    return first.join(n, F.col(key).eqNullSafe(F.col("_k"))).select(key, order, "n_more")


def gaps(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Kept lines with whether something was left out before them."""
    w = Window.partitionBy(key).orderBy(line)
    return lines.withColumn("gap", F.coalesce(F.col(line) != F.lag(line).over(w) + 1, F.lit(False)))


def tool_event(name: Column, data: Column) -> Column:
    """What a tool call does, in one line: its command, file or pattern; data is its JSON input."""
    get = lambda k: F.get_json_object(data, f"$.{k}")
    return F.when(name == "Bash", F.concat(F.lit("$ "), text.first_line(get("command")))).when(name.isin("Write", "Edit", "Read"), F.concat(F.lower(name), F.lit(" "), get("file_path"))).when(name.isin("Grep", "Glob"), F.concat(F.lower(name), F.lit(" "), get("pattern"))).otherwise(name)


def faults(texts: DataFrame, where: str, content: str, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """rule, where, line, found of a text checked line by line; a rule is (name, expression, must match): one that must match reports once, at line 0, where it doesn't."""
    each = texts.select(F.col(where).alias("where"), F.posexplode(F.split(content, "\n")).alias("pos", "own"))
    out = None
    for name, pattern, must in rules:
        if must:
            one = texts.where(~F.col(content).rlike(f"(?m){pattern}")).select(F.lit(name).alias("rule"), F.col(where).alias("where"), F.lit(0).alias("line"), F.lit("").alias("found"))
        else:
            one = each.where(F.col("own").rlike(pattern)).select(F.lit(name).alias("rule"), "where", (F.col("pos") + 1).alias("line"), F.regexp_extract("own", f"({pattern})", 1).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out


def report(found: DataFrame) -> DataFrame:
    """where, n, message: all faults of a place in one message, as an end-of-turn gate shows them."""
    line = F.format_string("%s:%d: %s %s", "where", "line", "rule", "found")
    listed = found.groupBy("where").agg(F.array_sort(F.collect_list(F.struct("line", "rule", line.alias("text")))).alias("l"))
    return listed.select("where", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("message"))


def ledger_runs(ledger: DataFrame, source: str, runs: DataFrame, label: str) -> DataFrame:
    """Ledger rows with the runs that they belong to: the label is the row's source, its translation, or part of it. Compared once for each source that
    occurs, by equality where that will do, and only those pairs are joined with the rows."""
    kinds, labels = ledger.select(F.col(source).alias("_s")).distinct(), runs.select(F.col(label).alias("_l")).distinct()
    same = kinds.join(labels, F.col("_s") == F.col("_l")).unionByName(kinds.join(labels, F.concat("_s", F.lit("/translation")) == F.col("_l")))
    part = kinds.join(labels, F.contains(F.col("_s"), F.col("_l")))
    pairs = same.unionByName(part).distinct()
    return ledger.join(pairs, F.col(source) == F.col("_s")).withColumnRenamed("_l", label).drop("_s")


#: What a hook can say of a turn when it stops the agent.
STOPS = ("block", "deny", "gave up")


def hook_health(hooks: DataFrame, runs: DataFrame, scores: DataFrame, checking: Sequence[str]) -> DataFrame:
    """Each installed hook: runs, stops, crashes, errors, said (its first message that stopped), sample (of its first crash), missed (turns that the check of its rule
    failed and that it passed, without stopping or crashing in them), working, status.

    hooks: hook, rule, event; runs: hook, turn, verdict ("pass", one of STOPS, "crash", "error"), message, seq; scores: rule, turn, passed. A hook works if it runs at an
    event that can check (`checking`), ran, never crashed, never ended with an error that nobody is told, and missed no turn. Only sums travel: by hook and turn first, then by hook."""
    v, stop = F.col("verdict"), F.col("verdict").isin(*STOPS)
    turns = runs.groupBy("hook", "turn").agg(
        F.count("*").alias("runs"), F.count_if(v == "pass").alias("passes"), F.count_if(stop).alias("stops"), F.count_if(v == "crash").alias("crashes"), F.count_if(v == "error").alias("errors"),
        F.min_by(F.when(stop, F.col("message")), F.when(stop, F.col("seq"))).alias("said"), F.min(F.when(stop, F.col("seq"))).alias("said_at"),
        F.min_by(F.when(v == "crash", F.col("message")), F.when(v == "crash", F.col("seq"))).alias("sample"), F.min(F.when(v == "crash", F.col("seq"))).alias("sample_at"),
    )
    failed = scores.where(~F.col("passed")).select("rule", "turn").distinct()
    missed = turns.where("passes > 0 AND stops = 0 AND crashes = 0").join(hooks.select("hook", "rule"), "hook").join(failed, ["rule", "turn"]).groupBy("hook").agg(F.sort_array(F.collect_set("turn")).alias("missed"))
    sums = turns.groupBy("hook").agg(*(F.sum(c).alias(c) for c in ("runs", "stops", "crashes", "errors")), F.min_by("said", "said_at").alias("said"), F.min_by("sample", "sample_at").alias("sample"))
    out = hooks.join(sums, "hook", "left").join(missed, "hook", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("runs", "stops", "crashes", "errors")}
    out = out.withColumns(zero | {"missed": F.coalesce("missed", F.array().cast(missed.schema["missed"].dataType)), "checks": F.col("event").isin(*checking)})
    faults = [(F.col("runs") == 0, "never ran"), (F.col("crashes") > 0, "crashes"), (F.col("errors") > 0, "errors that nobody is told"), (F.size("missed") > 0, "missed a violation")]
    said = [F.when(F.col("stops") > 0, F.concat(F.lit("stopped the agent "), "stops", F.lit(" times"))), *(F.when(c, text) for c, text in faults)]
    why = F.concat_ws(", ", *said)
    status = F.when(~F.col("checks"), "cannot check the work").when(why == "", "never had to stop the agent").otherwise(why)
    sound = ~faults[0][0]
    for c, _ in faults[1:]:
        sound = sound & ~c
    return out.select("hook", "rule", "event", "runs", "stops", "crashes", "errors", "said", "sample", "missed", (F.col("checks") & sound).alias("working"), status.alias("status"))


def rule_health(health: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, working (one of its hooks is), stops, why (what its hooks lack, by hook; or that it has none)."""
    own = health.where("rule IS NOT NULL").groupBy("rule").agg(F.max("working").alias("working"), F.sum("stops").alias("stops"), F.sort_array(F.collect_list(F.when(~F.col("working"), F.struct("hook", F.concat_ws(": ", F.concat_ws(" ", F.lit("hook"), "hook", F.concat(F.lit("("), "event", F.lit(")"))), "status").alias("why"))))).alias("whys"))
    both = rules.select("rule").distinct().join(own, "rule", "left")
    why = F.when(F.col("working").isNull(), "no hook was built for this rule").otherwise(F.array_join(F.transform("whys", lambda x: x["why"]), "; "))
    return both.select("rule", F.coalesce("working", F.lit(False)).alias("working"), F.coalesce("stops", F.lit(0)).alias("stops"), why.alias("why"))
