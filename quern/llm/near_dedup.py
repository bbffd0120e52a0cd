"""MinHash near-duplicates by a signature-coordinate inverted join.

Each document's set of distinct word shingles gives a signature of K coordinates. Documents with equal sets are one class.
Classes are posted under each (coordinate, value); values that only one class has can't collide and are left out. A pair
must collide in at least LEAST coordinates, so it shares one of the rarest K - LEAST + 1 postings of each side (prefix);
classes with fewer than LEAST shared values are skipped. The collisions of a pair so met are counted on a longer signature of FINE
coordinates, a byte each; pairs with LEAST_FINE of them are confirmed on the full sets.

A long posting list is never expanded into its pairs. First each member meets one pivot of each of its lists: the most
central member, whose values are the most common, then another in each of the ROUNDS; members that are then linked are one
component. Only lists that still hold several components are compared whole, in blocks of at most BLOCK members, between
different components; links inside a component change nothing. Members of a list of over SECOND blocks are posted again under each further
value of their prefix, which two linked documents must share too (LEAST collisions have two among the rarest K - LEAST + 2), so
that they meet in shorter lists rather than in the square of its blocks. A block counts collisions and confirms pairs itself, each under
the first posting that both sides share, and puts out only links that join components. So every link between different
components is found: a pair with J >= 0.8 is missed only if fewer than LEAST of its K coordinates, or LEAST_FINE of its FINE,
collide; each has a probability below 1e-6.

Null, empty and blank texts have the empty set and are linked with nothing. Texts of fewer words than a shingle have one
shingle, the whole sequence. Repeated rows fall in one class; ties go to the smallest doc_id. Very long texts are hashed
whole, in pieces. Shingles are 64-bit hashes (two sets of 10,000 have a false common one with a probability of 5e-12). doc_ids
are unique, but for repeated rows. Rows with a null doc_id take part under no id and are returned unlinked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared
from quern.llm.components import components

SIZE = 4
K, LEAST = 64, 34
FINE, LEAST_FINE = 512, 364
PERCENT = 80
ROUNDS = 2
BLOCK = 1000
#: Bytes of full sets that the members of a block have together, about.
BLOCK_BYTES = 16 << 20
#: Blocks of a list from which a second posting makes fewer copies of a member (at most K - LEAST + 1) than pairs of blocks do.
SECOND = K - LEAST + 1
#: Up to so many ids of classes that remain are broadcast to the scan of texts (8 bytes each); beyond, Spark joins by sorting.
BROADCAST_IDS = 1_000_000
RANDOM = np.random.default_rng(20240229)
ODD, ADD = RANDOM.integers(0, 2**63, FINE, np.uint64) * np.uint64(2) + np.uint64(1), RANDOM.integers(0, 2**63, FINE, np.uint64)


def shingles(words: list[bytes], hashes: shared.WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = hashes.of(words)
    n = max(1, len(words) - size + 1)
    if not len(words):
        return h
    got = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        got = shared.mix(got * np.uint64(31) + h[i : i + n] + np.uint64(i + 1))
    return np.unique(got)


def signature(found: np.ndarray, size: int = K) -> np.ndarray:
    best = np.full(size, 2**32 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        part = ((found[None, at : at + 2048] + ADD[:size, None]) * ODD[:size, None]) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=1))
    return best.astype(np.uint32).view(np.int32)


def fine_signature(found: np.ndarray) -> bytes:
    return signature(found, FINE).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, mark (hash of the text), n (size of the set), key (128-bit hash of the set), sig (array of K ints; null for the empty set)."""
    shared.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashes = shared.WordHashes()
        for batch in batches:
            ns, keys, sigs = [], [], []
            for raw in shared.as_bytes(batch.column(1)):
                found = shingles(raw.lower().split(), hashes, size)
                ns.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "mark", "n", "key", "sig"])
        hashes.clear()
        shared.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), shared.mark().alias("mark")).mapInArrow(run, "doc_id long, mark long, n long, key binary, sig array<int>")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, shingles (array of long), fine (bytes of the longer signature) of the documents in ids (column id)."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(ids, "id", "left_semi")

    def run(batches):
        import pyarrow as pa

        hashes = shared.WordHashes()
        for batch in batches:
            found = [shingles(raw.lower().split(), hashes, size) for raw in shared.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([fine_signature(x) for x in found], pa.binary())], names=["id", "shingles", "fine"])
        hashes.clear()
        shared.release()

    return chosen.mapInArrow(run, "id long, shingles array<long>, fine binary")


def colliding(batches):
    """Pairs (a, b, na, nb, fa, fb) whose longer signatures collide often enough, without the signatures."""
    import pyarrow as pa

    for batch in batches:
        fa, fb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, FINE) for i in (4, 5))
        yield batch.select([0, 1, 2, 3]).filter(pa.array(np.count_nonzero(fa == fb, axis=1) >= LEAST_FINE))


def cell_pairs(pdf: pd.DataFrame, percent: int):
    """Pairs of rows of one cell of a posting list (positions, batch by batch) that lie in different components, collide often enough, and share no earlier posting, nor an earlier second one."""
    i, j, token, second = (int(pdf[c].iloc[0]) for c in ("i", "j", "token", "second"))
    own = pdf["own"].to_numpy()
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    if not len(left) or not len(right):
        return
    fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(len(pdf), FINE)
    # of the postings of a row the last is a second one only
    earlier = [{t for t in p[:-1] if t < token} for p in pdf["tokens"]]
    seconds = [{t for t in p if t < second and t != token} for p in pdf["tokens"]]
    comp, n = pdf["comp"].to_numpy(), pdf["n"].to_numpy()
    for k, a in enumerate(left):
        others = right[k + 1 :] if i == j else right
        at = others[(comp[others] != comp[a]) & (100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a]))]
        at = at[np.count_nonzero(fine[at] == fine[a], axis=1) >= LEAST_FINE]
        yield a, [b for b in at if earlier[a].isdisjoint(earlier[b]) and seconds[a].isdisjoint(seconds[b])]


def cell_members(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a cell that have a pair in it."""
    hit = np.zeros(len(pdf), bool)
    for a, found in cell_pairs(pdf, percent):
        if found:
            hit[a] = True
            hit[found] = True
    return pdf[hit]


def cell_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one cell, confirmed on the full sets; only those that join components, so never more than it has rows."""
    root = {c: c for c in pdf["comp"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    ids, comp, sets, out = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), list(pdf["shingles"]), []
    for a, found in cell_pairs(pdf, percent):
        for b in found:
            x, y = find(comp[a]), find(comp[b])
            if x != y:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[x] = y
                    out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


CELL = "token long, second long, i int, j int, own int, id long, comp long, n long, fine binary, tokens array<long>"


def links_between(docs: DataFrame, classes: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame:
    """(node, root) of the classes that are linked with another class; classes: id, n, sig."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        df, path = shared.stored(df, label)
        paths.append(path)
        return df

    posted = classes.select("id", F.posexplode("sig").alias("at", "value")).select("id", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + 2**31).alias("token"))
    shared_values = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = posted.join(shared_values, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found")).where(F.size("found") >= LEAST)
    central = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    chosen = keep(ranked.select("id", central.alias("weight"), F.transform(F.slice("found", F.lit(1), F.size("found") - LEAST + 2), lambda p: p["token"]).alias("tokens")), "postings")
    prefix = chosen.select("id", "weight", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - 1)).alias("token"))
    ids = chosen.select("id")
    sets = keep(sets_of(docs, ids, size), "sets")
    known = keep(classes.select("id", "n").join(sets.select("id", "fine"), "id"), "members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(known.toDF("a", "na", "fa"), "a").join(known.toDF("b", "nb", "fb"), "b")
        met = met.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "fa", "fb")
        met = met.mapInArrow(colliding, "a long, b long, na long, nb long")
        both = met.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("tb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("ta")), "a").withColumn("common", F.size(F.array_intersect("ta", "tb")))
        return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    links, lists, roots = None, prefix.withColumn("comp", F.col("id")), None
    for r in range(ROUNDS + 1):
        several = lists.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), (F.min_by("id", F.xxhash64("id", F.lit(r), "token")) if r else F.max_by("id", F.struct("weight", "id"))).alias("pivot")).where("low < high")
        if r < ROUNDS:
            pivots = several.join(lists.select("id", "comp"), F.col("pivot") == F.col("id")).select("token", "pivot", F.col("comp").alias("pivot_comp")).distinct()
            pairs = lists.join(pivots, "token").where("comp <> pivot_comp").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        else:
            hot = F.col("m") > SECOND * BLOCK
            placed = lists.join(several.where("m > 2").select("token", "m"), "token").join(chosen.select("id", "tokens"), "id")
            placed = placed.withColumn("second", F.explode(F.when(hot, F.array_except("tokens", F.array("token"))).otherwise(F.array(F.lit(-1).cast("long")))))
            placed = keep(placed.select("id", "comp", "token", "second"), "placed")
            sizes = placed.join(classes.select("id", "n"), "id").groupBy("token", "second").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
            sizes = sizes.select("token", "second", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
            members = placed.join(sizes, ["token", "second"]).join(known, "id").join(chosen.select("id", "tokens"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", F.col("n").cast("long").alias("n"), "fine", "tokens")
            met = cells.groupBy("token", "second", "i", "j").applyInPandas(lambda pdf: cell_members(pdf, percent), CELL)
            whole = met.join(sets.select("id", "shingles"), "id").select(*met.columns, "shingles")
            pairs = whole.groupBy("token", "second", "i", "j").applyInPandas(lambda pdf: cell_links(pdf, percent), "a long, b long").distinct()
        new = keep(confirmed(pairs) if r < ROUNDS else pairs, "links")
        if r and new.isEmpty():
            continue  # the components stay as they are; only the last round compares lists whole
        links = new if links is None else links.unionByName(new)
        roots, more = components(links)
        paths += more
        if r < ROUNDS:
            comps = roots.select(F.col("node").alias("id"), "root")
            lists = keep(prefix.join(comps, "id", "left").select("id", "weight", "token", F.coalesce("root", "id").alias("comp")), "lists")
    return roots


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, mark (hash of its text), n_shingles, component_id, kept. What was written on the way but the last tables is removed."""
    spark, paths = docs.sparkSession, []
    found, _ = shared.stored(signatures(docs, size), "signatures")
    classes, _ = shared.stored(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.first("sig").alias("sig")), "classes")
    roots = links_between(docs, classes.select("id", "n", "sig"), size, percent, paths)
    ends, _ = shared.stored(classes.select("key", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", F.coalesce("root", "id").alias("end")), "ends")
    for path in paths:
        shared.remove(spark, path)
    out = found.select("doc_id", "mark", "n", "key").join(ends, "key", "left")
    end = F.coalesce("end", "doc_id")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), end.alias("component_id"), F.coalesce(end == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents")).drop("mark")


def brute_force(rows: list[tuple[int, str | None]], size: int = SIZE, percent: int = PERCENT) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> n_shingles, component_id, kept by comparing all pairs, for tests."""
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(1, len(ws) - 3) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {"op2_near_dedup": ORACLE}
