"""URL filters by a sort-merge range join of pages with rules.

A host is reversed label by label ("www.example.com" -> "com.example.www."), so that a rule's host becomes the interval of keys
it is a prefix of. Pages and rules are dealt out by ranges of keys, sorted together, and swept once: the sweep keeps a
stack of the rules whose interval is open, innermost on top; rules of one host share an entry that finds paths by length.

A host may hold a third of all pages: range bounds are over (key, hash of the page), so such a host spreads over many
ranges. A rule goes to every range that its interval meets. Bounds come from a bounded sample and only balance the work.

Null urls and urls without "://" have an empty host and path and fit no rule; they get the default verdict. Ties: the longest
host + path wins, then the longest host; a rule given twice with both actions blocks. Repeated pages each get a row.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared

#: Keys sampled for each range.
SAMPLE = 100
DEFAULT = "allow"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parsed(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): the parts of the contract, empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: F.Column) -> F.Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit(".")))


class Sweep:
    """The stack of open rules: (key, {path: (action, host)}, lengths of the paths, longest first)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict, list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, action: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or action == "block":
            paths[path] = (action, host)
        if len(path) not in lengths:
            bisect.insort(lengths, len(path), key=lambda n: -n)

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        best, rule, verdict = (-1, -1), None, None
        if key:
            for _, paths, lengths in reversed(self.stack):
                for n in lengths:
                    if n <= len(path) and (hit := paths.get(path[:n])):
                        action, host = hit
                        if (len(host) + n, len(host)) > best:
                            best, rule, verdict = (len(host) + n, len(host)), host + path[:n], action
                        break
        return rule, verdict


def judge_pages(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. rules: host, path, action."""
    spark = pages.sparkSession
    shared.small_batches(spark)
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(pages.dtypes)["page_id"]
    host, path = parsed(F.col("url"))
    keyed = pages.select("page_id", F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", reversed_host(F.col("host"))).withColumn("order", F.concat("key", F.lit("\x01"), F.lpad(F.hex(F.xxhash64("page_id", "path")), 16, "0")))
    n = pages.count()
    some = sorted(r[0] for r in keyed.select("order").sample(min(1.0, ranges * SAMPLE / max(n, 1)), 7).limit(4 * ranges * SAMPLE).collect())
    bounds = sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []
    keys = reversed_host(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    given = rules.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("action").cast("string")).where("host <> '' AND path IS NOT NULL AND action IN ('allow', 'block')").withColumn("key", keys).withColumn("order", F.concat("key", F.lit("\x00"))).select(F.lit(None).cast(kind).alias("page_id"), "host", "path", "key", "order", "action")
    union = keyed.withColumn("action", F.lit(None).cast("string")).unionByName(given)

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            actions, orders, keys = (batch.column(i).to_pylist() for i in (5, 4, 3))
            rows, spots = [], []
            for i, (action, order, key) in enumerate(zip(actions, orders, keys, strict=True)):
                first = bisect.bisect_right(bounds, order)
                last = bisect.bisect_right(bounds, key + "\U0010ffff") if action else first
                rows += [i] * (last - first + 1)
                spots += range(first, last + 1)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(spots, pa.int32())], names=[*batch.schema.names, "spot"])

    def sweep(batches):
        import pyarrow as pa

        spot, state = None, Sweep()
        for batch in batches:
            ids, hosts, paths, keys, actions, spots = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "host", "path", "key", "action", "spot"))
            out = []
            for page, host, path, key, action, s in zip(ids, hosts, paths, keys, actions, spots, strict=True):
                if s != spot:
                    spot, state = s, Sweep()
                if action:
                    state.open(key, host.lower(), path, action)
                else:
                    rule, verdict = state.judge(key, path)
                    out.append((page, host, path, rule, verdict or default))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("page_id").type), *(pa.array(c, pa.string()) for c in columns[1:])], names=["page_id", "host", "path", "rule", "verdict"])

    schema = f'page_id {kind}, host string, path string, key string, `order` string, action string'
    spread = union.select("page_id", "host", "path", "key", "order", "action").mapInArrow(dealt, schema + ", spot int")
    ordered = spread.repartition(ranges, "spot").sortWithinPartitions("spot", "order")
    return ordered.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(shared.table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


def brute_force(url: str | None, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> tuple[str, str, str | None, str]:
    """The contract rule by rule, for tests."""
    import re

    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, a) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, h || r.p AS rule, a FROM p JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, r.p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || r.p) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": ORACLE}
