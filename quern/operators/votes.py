"""Reconciling replicate answers: vote plan, citation rails, stability, alias grouping, exact partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.numbering import numbered


def vote_plan(attempts: DataFrame, key: str = "rule", axis: str = "axis", rep: str = "rep", values: str = "values") -> DataFrame:
    """One row per key and axis: named (attempts with values), how (null, pattern, ask), values.

    At most one attempt names the axis: null. All that do agree as order-free sets of normal values: pattern, in the order of the
    first of them, each value in its most common spelling (an attempt counts once; ties go to the earliest). Else: ask.
    """
    # a key's attempts are its few replicates: gathered once, the rest is expressions inside the row
    each = F.struct(F.col(rep).alias("rep"), F.col(values).alias("raws"), F.transform(values, text.norm).alias("norms"))
    rows = attempts.groupBy(key, axis).agg(F.array_sort(F.collect_list(F.when(F.size(values) > 0, each))).alias("a"))
    sets = F.transform("a", lambda x: F.array_sort(F.array_distinct(x["norms"])))
    rows = rows.withColumn("how", F.when(F.size("a") <= 1, "null").when(F.forall(sets, lambda s: s == sets[0]), "pattern").otherwise("ask"))
    spelt = F.flatten(F.transform("a", lambda x: F.transform(F.arrays_zip(x["raws"], x["norms"]), lambda v, i: F.struct(v["norms"].alias("norm"), v["raws"].alias("raw"), x["rep"].alias("rep"), i.alias("pos")))))
    rows = rows.withColumn("spelt", F.when(F.col("how") == "pattern", spelt))

    def best(norm: Column) -> Column:
        own = F.filter("spelt", lambda s: s["norm"] == norm)

        def rank(raw: Column) -> Column:
            seen = F.filter(own, lambda s: s["raw"] == raw)
            votes_ = F.size(F.array_distinct(F.transform(seen, lambda s: s["rep"])))
            return F.struct((-votes_).alias("m"), F.array_min(F.transform(seen, lambda s: F.struct(s["rep"], s["pos"]))).alias("at"), raw.alias("raw"))

        return F.array_min(F.transform(F.array_distinct(F.transform(own, lambda s: s["raw"])), rank))["raw"]

    chosen = F.when(F.col("how") == "pattern", F.transform(F.array_distinct(F.col("a")[0]["norms"]), best)).otherwise(F.array().cast("array<string>"))
    return rows.select(key, axis, F.size("a").cast("long").alias("named"), "how", chosen.alias("values"))


def stability(plan: DataFrame, key: str = "rule", n: int = 3) -> DataFrame:
    """n/n where no axis was split over the n replicates, n-1/n as soon as one was."""
    return plan.groupBy(key).agg(F.when(F.max((F.col("how") == "ask").cast("int")) == 1, f"{n - 1}/{n}").otherwise(f"{n}/{n}").alias("stability"))


def picked_spec(attempts: DataFrame, voted: DataFrame, key: str = "rule") -> DataFrame:
    """The spec of the first attempt whose enforcers include a voted one, else of the first with a spec and an enforcer; empty without voted enforcers.

    attempts: key, rep, enforcer (array), spec; voted: key, values.
    """
    has = (F.coalesce("spec", F.lit("")) != "") & (F.size("enforcer") > 0)
    both = attempts.join(voted.select(key, F.col("values").alias("voted")), key)
    agree = has & F.arrays_overlap(F.transform("enforcer", text.norm), F.transform("voted", text.norm))
    pick = both.groupBy(key).agg(F.min(F.when(agree, F.struct("rep", "spec"))).alias("a"), F.min(F.when(has, F.struct("rep", "spec"))).alias("b"), F.max(F.size("voted")).alias("n"))
    return pick.select(key, F.when(F.col("n") > 0, F.coalesce("a.spec", "b.spec", F.lit(""))).otherwise("").alias("spec"))


def railed(answers: DataFrame, attempts: DataFrame, key: str = "rule", least: int = 2) -> DataFrame:
    """Values of a judge's answer that hold: cited in at least two different attempts that named the axis, and literal in one of them.

    answers: key, axis, pos, value, cited (array of reps); attempts: key, axis, rep, values. An HTML-escaped value may stand for the plain one.
    """
    plain = F.col("value")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    cites = answers.withColumn("plain", plain).withColumn("rep", F.explode(F.array_distinct("cited")))
    met = cites.join(attempts.where(F.size("values") > 0).select(key, "axis", "rep", "values"), [key, "axis", "rep"])
    held = F.max(F.array_contains("values", F.col("value")).cast("int")), F.max(F.array_contains("values", F.col("plain")).cast("int"))
    sums = met.groupBy(key, "axis", "pos", "value", "plain").agg(F.count("*").alias("n"), held[0].alias("raw"), held[1].alias("unescaped"))
    good = sums.where((F.col("n") >= least) & ((F.col("raw") == 1) | (F.col("unescaped") == 1)))
    return good.select(key, "axis", "pos", F.when(F.col("raw") == 1, F.col("value")).otherwise(F.col("plain")).alias("value"))


def aliased(value: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """First-match regular-expression join: the name of the first alias that is found in the value, in any case; else the value.

    One chain of conditions made from the list, so nothing is joined; a list is configuration, not data.
    """
    stripped = F.trim(value)
    out = None
    for pattern, name in aliases:
        hit = stripped.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return stripped if out is None else out.otherwise(stripped)


def subcategories(rules: DataFrame, key: str, values: str, aliases: Sequence[tuple[str, str]], variants: int = 4) -> DataFrame:
    """id, name, rules, occurrences, variants (the most common raw values), by rules descending and name."""
    each = rules.select(key, F.explode(values).alias("raw")).withColumn("raw", F.trim("raw")).withColumn("name", aliased(F.col("raw"), aliases))
    raws = each.groupBy("name", "raw").agg(F.count("*").alias("n"))
    top = raws.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "raw"))).where(F.col("r") <= variants)
    lists = top.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "raw"))), lambda x: x["raw"]).alias("variants"))
    sums = each.groupBy("name").agg(F.countDistinct(key).alias("rules"), F.count("*").alias("occurrences"))
    named = sums.join(lists, "name")
    return numbered(named, [-F.col("rules"), F.lower("name"), F.col("name")]).select("id", "name", "rules", "occurrences", "variants")


def partition_faults(members: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """key and fault: missed (in no class), repeated (in several places), invented (not known)."""
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    both = known.select(key, F.lit(1).alias("is_known")).distinct().join(n, key, "full_outer")
    fault = F.when(F.col("is_known").isNull(), "invented").when(F.col("n").isNull(), "missed").when(F.col("n") > 1, "repeated")
    return both.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def class_stage(subcategories: dict[int, str], saved: Sequence[dict] | None, group, place, names: dict[str, str] | None = None) -> list[dict]:
    """The classes of a run: class, class_long, subcategories. Saved ones are taken again if they cover exactly the same subcategories;
    otherwise group(ids) is asked once and repaired by place, and a class shown under a shorter name keeps its long one."""
    if saved is not None and sorted(s for c in saved for s in c["subcategories"]) == sorted(subcategories.values()):
        return list(saved)
    found = repaired(group(sorted(subcategories)), set(subcategories), place)
    return [{"class": (names or {}).get(c, c), "class_long": c, "subcategories": [subcategories[i] for i in ids]} for c, ids in found.items()]


def repaired(classes: dict[str, list[int]], known: set[int], place, rounds: int = 4) -> dict[str, list[int]]:
    """An exact partition from a model's answer: invented ids and empty classes go; missed and repeated ids are placed again, at most `rounds` times.

    place(ids, class names) -> {id: class}. A class list is a model's answer of bounded size, so this runs on the driver.
    """
    held = {name: [i for i in ids if i in known] for name, ids in classes.items()}
    for _ in range(rounds):
        seen = [i for ids in held.values() for i in ids]
        todo = (known - set(seen)) | {i for i in seen if seen.count(i) > 1}
        if not todo:
            break
        for i, name in place(sorted(todo), [n for n, ids in held.items() if ids]).items():
            if i in todo:
                for ids in held.values():
                    ids[:] = [x for x in ids if x != i]
                held.setdefault(name, []).append(i)
    held = {name: ids for name, ids in held.items() if ids}
    seen = [i for ids in held.values() for i in ids]
    if sorted(seen) != sorted(known):
        raise ValueError(f"no exact partition after {rounds} rounds")
    return held
