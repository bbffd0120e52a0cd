"""Merkle manifest of a dataset: a digest of each row, a tree over the rows of each group, a tree over the groups, a proof for each row.

Rows are numbered within their group by a range partition and counted offsets. A superblock reduction builds the trees: rows
are bucketed by number // fanout^LEVELS, each bucket collapses LEVELS levels in one group of at most fanout^LEVELS
rows, and the bucket roots are reduced in the same way until one node remains. A row's proof is what its bucket
says of the lower levels, followed by what the bucket root's proof says of the upper ones. The subroots of the groups, in the
groups' order, are the leaves of the last tree, which is built by the same steps.

A proof is two arrays, an element for each level from the leaf to the root: the digests before the node in its run, and those after it,
concatenated ('' where the node has none, as at the end of a level). `folded` computes the root from a leaf and its proof with
DataFrame functions, so that anyone who has a row, its proof and the root can check the row.

Nulls in any field have a digest like other values, a null group is a group of its own, before the others. Rows with a null order
come first in their group. Rows that agree in the order are placed by their digest, equal rows by arrival, so that roots don't depend on
it. Very long texts are digested whole. An empty table has an empty manifest and no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import shared

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels that one bucket collapses: 2^10 leaves of about 100 bytes.
LEVELS = 10
LOCAL = 2**33 - 1


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: '-' for null, else the count of UTF-8 bytes, ':' and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx (from 0) in the order of their group and n, the group's size; a group may lie in many partitions."""
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_at")
    placed = dealt.sortWithinPartitions(group, *order, "_at").drop("_at").withColumn("_row", F.monotonically_increasing_id())
    placed, _ = shared.stored(placed.withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(LOCAL)}), "placed")
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    every = Window.partitionBy(group)
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), "_first", (F.sum("_n").over(every.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("n"))
    found = placed.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    return found.withColumn("idx", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_own", "_group", "_first", "_before")


def collapse(nodes: list[str], fanout: int, levels: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """At most `levels` levels over the nodes, as many as it takes if that is fewer; the last node, and for each leaf what lies before and after its node in each run."""
    before, after = [[] for _ in nodes], [[] for _ in nodes]
    width, own = 1, nodes
    for _ in range(levels):
        runs = [own[i : i + fanout] for i in range(0, len(own), fanout)]
        for leaf in range(len(nodes)):
            at = leaf // width
            run, i = runs[at // fanout], at % fanout
            before[leaf].append("".join(run[:i]))
            after[leaf].append("".join(run[i + 1 :]))
        own = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        width *= fanout
    return own[0], before, after


def height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def reduced(nodes: DataFrame, group: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes: the group's column, idx, n, node (hex), others. Adds root, before and after; buckets first, then the same for their roots."""
    width = fanout**levels

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        root, before, after = collapse(pdf["node"].tolist(), fanout, min(levels, height(int(pdf["n"].iloc[0]), fanout)))
        return pdf.assign(root=root, before=before, after=after)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", bucket long, root string, before array<string>, after array<string>"
    low = nodes.withColumn("bucket", F.floor(F.col("idx") / width).cast("long")).groupBy(group, "bucket").applyInPandas(bucket, schema)
    low, _ = shared.stored(low, "buckets")
    if low.where(F.col("n") > width).isEmpty():
        return low.drop("bucket")
    tops = low.where(F.col("idx") % width == 0).select(F.col(group).alias("_group"), F.col("bucket").alias("idx"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("root").alias("node"))
    up = reduced(tops, "_group", fanout, levels).select(F.col("_group").alias("_of"), F.col("idx").alias("_bucket"), F.col("root").alias("_root"), F.col("before").alias("_before"), F.col("after").alias("_after"))
    whole = low.join(up, F.col(group).eqNullSafe(F.col("_of")) & (F.col("bucket") == F.col("_bucket")))
    return whole.withColumns({"root": F.col("_root"), "before": F.concat("before", "_before"), "after": F.concat("after", "_after")}).drop("bucket", "_of", "_bucket", "_root", "_before", "_after")


def manifest(leaves: DataFrame, group: str, order: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves: leaf (hex), the columns named, others. Adds idx, subroot, root, before and after: the proof up to the root over all groups."""
    own = reduced(numbered(leaves.withColumn("node", F.col("leaf")), group, [order, "leaf"]), group, fanout, levels).drop("node", "n")
    own, _ = shared.stored(own.withColumnRenamed("root", "subroot"), "manifest")
    subroots = own.where("idx = 0").select(F.col(group).alias("_name"), F.col("subroot").alias("node"), F.lit(0).alias("_all"))
    top = reduced(numbered(subroots, "_all", ["_name"]), "_all", fanout, levels).select("_name", "root", F.col("before").alias("_before"), F.col("after").alias("_after"))
    return own.join(top, F.col(group).eqNullSafe(F.col("_name"))).withColumns({"before": F.concat("before", "_before"), "after": F.concat("after", "_after")}).drop("_name", "_before", "_after")


def folded(leaf: Column, before: str = "before", after: str = "after") -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), leaf, lambda node, run: F.sha2(F.concat(run["b"], node, run["a"]), 256))


def siblings(before: str = "before", after: str = "after") -> Column:
    """All digests of the proof in one string, level by level, left to right."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    docs = shared.table(spark, sf_dir, "documents").select(*FIELDS)
    own = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), digest(*own).alias("leaf"), F.when(tampered, digest(*changed)).alias("changed"))
    leaves, _ = shared.stored(leaves, "leaves")  # ranges are sampled from digests, not from texts read and digested once more
    out = manifest(leaves, "lang", "doc_id")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def brute_force(rows: list[tuple[str | None, int | None, str]], fanout: int = FANOUT) -> tuple[str, dict[int, tuple[str, str]]]:
    """rows: group, order, leaf. The root; and for each row's place its subroot and the siblings of its proof, for tests."""
    def build(nodes: list[str]) -> tuple[str, list[str]]:
        paths, at = [""] * len(nodes), list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for leaf, node in enumerate(at):
                paths[leaf] += "".join(x for i, x in enumerate(runs[node // fanout]) if i != node % fanout)
            at = [node // fanout for node in at]
            nodes = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        return nodes[0], paths

    groups: dict = {}
    for place, (g, o, leaf) in enumerate(rows):
        groups.setdefault(g, []).append(((o is not None, o if o is not None else 0), leaf, place))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: build([leaf for _, leaf, _ in sorted(groups[g])]) for g in names}
    if not names:
        return "", {}
    root, tops = build([built[g][0] for g in names])
    return root, {place: (built[g][0], path + top) for g, top in zip(names, tops, strict=True) for path, (_, _, place) in zip(built[g][1], sorted(groups[g]), strict=True)}


#: The CRC-32 of a string's bytes: each byte is put in, then eight steps (-1) of its polynomial.
CRC = "list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [CAST(ascii({0}[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT))"


def crc_sql(text: str) -> str:
    """DuckDB's form of crc32."""
    return f"xor({CRC.format(text)}, 4294967295)"


def field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit FROM documents),
l AS MATERIALIZED (SELECT doc_id, lang, sha256({" || ".join(map(field_sql, FIELDS))}) AS leaf,
  sha256({" || ".join(field_sql("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)}) AS changed, hit, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx FROM d),
t(g, lvl, idx, node) AS (SELECT coalesce('=' || lang, '-'), 0, idx, leaf FROM l UNION ALL
  SELECT g, lvl + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE n > 1 GROUP BY g, lvl, idx // 2),
s AS MATERIALIZED (SELECT g, max(lvl) AS h, max_by(node, lvl) AS subroot FROM t GROUP BY g),
o AS MATERIALIZED (SELECT g, subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx FROM s),
u(lvl, idx, node) AS (SELECT 0, idx, subroot FROM o UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, idx // 2),
p AS (SELECT l.doc_id, k.lvl, a.node AS before, b.node AS after FROM l JOIN s ON s.g = coalesce('=' || l.lang, '-'), unnest(range(s.h)) k(lvl)
  LEFT JOIN t a ON a.g = s.g AND a.lvl = k.lvl AND (l.idx >> k.lvl) % 2 = 1 AND a.idx = (l.idx >> k.lvl) - 1
  LEFT JOIN t b ON b.g = s.g AND b.lvl = k.lvl AND (l.idx >> k.lvl) % 2 = 0 AND b.idx = (l.idx >> k.lvl) + 1
  UNION ALL SELECT l.doc_id, 1000 + k.lvl, a.node, b.node FROM l JOIN o ON o.g = coalesce('=' || l.lang, '-'), unnest(range((SELECT max(lvl) FROM u))) k(lvl)
  LEFT JOIN u a ON a.lvl = k.lvl AND (o.idx >> k.lvl) % 2 = 1 AND a.idx = (o.idx >> k.lvl) - 1
  LEFT JOIN u b ON b.lvl = k.lvl AND (o.idx >> k.lvl) % 2 = 0 AND b.idx = (o.idx >> k.lvl) + 1),
f AS (SELECT doc_id, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY lvl) AS path FROM p GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(replace(array_to_string(path, ''), '|', ''), '')) AS proof_sha256,
  list_reduce(coalesce(path, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), CASE WHEN hit THEN changed ELSE leaf END) AS folded_root,
  folded_root = r.root AS verified
FROM l JOIN s ON s.g = coalesce('=' || l.lang, '-') CROSS JOIN (SELECT max_by(node, lvl) AS root FROM u) r LEFT JOIN f USING (doc_id)
"""
QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": ORACLE}
