"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's tokens are its distinct word shingles, ordered alike in all documents: by how often their cell of a table of counts (CELLS
cells over the shingles of all documents) was met, rarest first, then by hash. Two sets of n shingles that reach the similarity share at least
o = ceil(n * percent / 100) of them, so that for any l <= o both have l shared ones among their first n - o + l. Each document posts
its tokens up to LONGEST more than the plain prefix; from the true lengths of its posting lists it then chooses the l
with the least estimated cost: postings read, and n for each candidate, of which there are at most postings / l. Of two documents the smaller l
counts: they are a candidate only if they share l tokens of both l-prefixes.

Documents with equal sets are one class. Lists of up to SHORT classes give their pairs, which are counted. A longer list is
never expanded into pairs: its members meet its smallest one (pivot), what is confirmed makes components, and lists that still hold several
components are compared in cells of two blocks (bounded in members and in bytes of their sets), each pair in its first common long list, with
the same counting. Pairs inside one component change nothing and are not confirmed. A candidate is screened by an exact bound, the sum of the smaller counts in BINS classes of shingles, and
confirmed on the full sets. So no link between different components is missed.

Null, empty and blank texts have the empty set and are linked with nothing. Texts of fewer words than a shingle have one shingle, the whole
sequence. Repeated rows fall in one class; ties go to the smallest doc_id. Rows that share a doc_id each follow
their own text; classes with one smallest doc_id are one node. Rows with a null doc_id are returned unlinked. Texts are hashed whole. Shingles are 64-bit hashes (two sets of 10,000 have a false common one with a probability of
5e-12). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import near_dedup, shared
from quern.llm.components import components

SIZE, PERCENT = 3, 90
#: Largest l: tokens by which a prefix may be longer, less one.
LONGEST = 4
#: Lists of up to so many classes are expanded into pairs: 7.5 for a posting.
SHORT = 16
#: Cells of the table of counts (4 bytes each, so 16 MB whatever the corpus), in blocks of PIECE; tables of tasks are added up FAN at a time.
CELLS, PIECE, FAN = 1 << 22, 1 << 16, 64
BINS = 256
#: Members and bytes of sets of a block.
BLOCK, BLOCK_BYTES = 1000, 16 << 20
BROADCAST_IDS = near_dedup.BROADCAST_IDS


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    import xxhash

    words, counts = shared.split_words(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)

    def mixed(h: np.ndarray, size: int) -> np.ndarray:
        got = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for i in range(size):
            got = shared.mix(got * np.uint64(31) + h[i : i + len(got)] + np.uint64(i + 1))
        return got

    every, out, at = mixed(h, size), [], 0
    for n in counts.tolist():
        out.append(np.unique(every[at : at + n - size + 1] if n >= size else mixed(h[at : at + n], n) if n else h[:0]))
        at += n
    return out


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


SCANNED = "doc_id long, n long, key binary, part int, piece int, cells binary, counts binary, held int"


def piece_rows(counts: np.ndarray, part: int) -> dict:
    """A task's counts, as rows of the cells that are not zero."""
    rows: dict = {"piece": [], "cells": [], "counts": [], "held": []}
    for piece, own in enumerate(counts.reshape(-1, PIECE)):
        at = np.flatnonzero(own)
        if len(at):
            for name, value in (("piece", piece), ("cells", packed(at.astype(np.uint16))), ("counts", packed(own[at].astype(np.int64))), ("held", len(at))):
                rows[name].append(value)
    return rows | {"part": [part] * len(rows["piece"])}


def scanned(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: doc_id, n (size of its set), key (128-bit hash of it, null for the empty one); and each task's table of counts in rows with a piece."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("part", pa.int32()), ("piece", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("held", pa.int32())])

        def made(rows: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        counts, held, few = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            found = shingle_sets(batch.column(1), size)
            held += found
            few += sum(map(len, found))
            if few >= CELLS:
                counts += np.bincount(cell(np.concatenate(held)), minlength=CELLS)
                held, few = [], 0
            yield made({"doc_id": batch.column(0), "n": [len(x) for x in found], "key": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]}, len(found))
        if few:
            counts += np.bincount(cell(np.concatenate(held)), minlength=CELLS)
        rows = piece_rows(counts, TaskContext.get().partitionId())
        for k in range(0, len(rows["piece"]), 8):
            part = {c: v[k : k + 8] for c, v in rows.items()}
            yield made(part, len(part["piece"]))
        shared.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


def table_of(pieces: DataFrame, tasks: int) -> np.ndarray:
    """The counts of all tasks added up, at most FAN tables in one group; CELLS counts, so of one size whatever the corpus."""
    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, np.int64)
        for cells, counts, held in zip(pdf["cells"], pdf["counts"], pdf["held"], strict=True):
            total[unpacked(cells, held, np.uint16)] += unpacked(counts, held, np.int64)
        at = np.flatnonzero(total)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "piece": [int(pdf["piece"].iloc[0])], "cells": [packed(at.astype(np.uint16))], "counts": [packed(total[at])], "held": [len(at)]})

    pieces = pieces.select("part", "piece", "cells", "counts", "held")
    while True:
        pieces = pieces.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("piece", "part").applyInPandas(added, "part int, piece int, cells binary, counts binary, held int")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    table = np.zeros(CELLS, np.int64)
    for r in pieces.toLocalIterator():
        table[r["piece"] * PIECE + unpacked(bytes(r["cells"]), r["held"], np.uint16).astype(np.int64)] = unpacked(bytes(r["counts"]), r["held"], np.int64)
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def least_common(n, percent: int):
    """How many shingles a set of n shares at least with one that reaches the similarity."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, table: np.ndarray, size: int, percent: int) -> tuple[DataFrame, object]:
    """id, key, n, tokens: the longest prefix that a document may choose, rarest first. And the broadcast table, to be freed."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batch: pa.RecordBatch) -> dict:
        import xxhash

        out: dict = {"id": batch.column(0), "key": [], "n": [], "tokens": []}
        for found in shingle_sets(batch.column(1), size):
            common = least_common(len(found), percent)
            most = len(found) - common + min(LONGEST, common)
            out["key"].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            out["n"].append(len(found))
            out["tokens"].append(found[np.argsort(sent.value[cell(found)], kind="stable")[:most]].view(np.int64))
        return out

    return shared.arrow_map(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")), rows, "id long, key binary, n long, tokens array<long>"), sent


def common_sql(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100)).cast("long")


def chosen(posted: DataFrame, percent: int) -> DataFrame:
    """id, n, l and posts (pos, df, token) of the l-prefix that is estimated to cost least; tokens that only one class posts are left out."""
    lists = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = common_sql(F.col("n"), percent)
    ls = range(1, LONGEST + 1)
    read = [F.sum(F.when(F.col("pos") < F.col("n") - common + l, F.col("df") - 1).otherwise(0)).alias(f"read{l}") for l in ls]
    met = posted.join(lists, "token").groupBy("id", "key", "n").agg(F.collect_list(F.struct("pos", "df", "token")).alias("posts"), *read)
    cost = [F.when(common >= l, F.struct((F.col(f"read{l}") * (1 + F.col("n") / l)).alias("cost"), F.lit(l).alias("l"))) for l in ls]
    best = met.withColumn("l", F.array_min(F.array_compact(F.array(*cost)))["l"])
    return best.select("id", "n", "l", F.filter("posts", lambda p: p["pos"] < F.col("n") - common + F.col("l")).alias("posts")).where(F.size("posts") > 0)


def counted_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share at least l tokens of both l-prefixes; posts: token, id, n, l, pos, of lists of up to SHORT."""
    lists = posts.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "n", "l", "pos"))).alias("m")).where(F.size("m") > 1)
    first = lists.select("token", F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    x, y = F.col("x"), F.col("y")
    l = F.least(x["l"], y["l"])
    sized = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    inside = [v["pos"] < v["n"] - common_sql(v["n"], percent) + l for v in (x, y)]
    met = first.where((x["id"] != y["id"]) & sized & inside[0] & inside[1]).select(x["id"].alias("a"), y["id"].alias("b"), l.alias("l"))
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("l").alias("l")).where("c >= l").select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, n, shingles and bins (how many shingles each of BINS classes has) of the documents in ids."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(ids, "id", "left_semi")

    def rows(batch: pa.RecordBatch) -> dict:
        found = shingle_sets(batch.column(1), size)
        bins = [np.minimum(np.bincount((x % np.uint64(BINS)).astype(np.int64), minlength=BINS), 65535).astype(np.uint16).tobytes() for x in found]
        return {"id": batch.column(0), "n": [len(x) for x in found], "shingles": [x.view(np.int64) for x in found], "bins": bins}

    return shared.arrow_map(own, rows, "id long, n long, shingles array<long>, bins binary").where("n > 0")


def bounded(na: np.ndarray, nb: np.ndarray, fa: np.ndarray, fb: np.ndarray, percent: int) -> np.ndarray:
    """Where two sets may still reach the similarity: they share at most the sum of the smaller counts of each class. A full count bounds nothing."""
    most = np.minimum(fa, fb).sum(axis=-1, dtype=np.int64)
    full = ((fa == 65535) & (fb == 65535)).any(axis=-1)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (full | ((100 + percent) * most >= percent * (na + nb)))


def screened(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            fa, fb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (4, 5))
            yield batch.select([0, 1]).filter(pa.array(bounded(na, nb, fa, fb, percent)))

    return run


def similar(sa: np.ndarray, sb: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(sa, sb, assume_unique=True))
    return 100 * common >= percent * (len(sa) + len(sb) - common)


def cell_pairs(pdf: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a cell in different components that share at least l tokens of both l-prefixes and may reach the similarity; each pair in its first common long list."""
    i, j, token = (int(pdf[c].iloc[0]) for c in ("i", "j", "token"))
    own, comp, n, l = (pdf[c].to_numpy() for c in ("own", "comp", "n", "l"))
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint16).reshape(len(pdf), BINS)
    common = least_common(n, percent)
    tokens, places, longs = list(pdf["tokens"]), list(pdf["places"]), [set(x) for x in pdf["longs"]]
    cut = [{m: set(t[p < size - o + m]) for m in range(1, most + 1)} for t, p, size, o, most in zip(tokens, places, n.tolist(), common.tolist(), l.tolist(), strict=True)]
    for k, a in enumerate(left):
        others = right[k + 1 :] if i == j else right
        others = others[comp[others] != comp[a]]
        for b in others[bounded(n[others], n[a], bins[others], bins[a], percent)]:
            m = int(min(l[a], l[b]))
            both = cut[a][m] & cut[b][m]
            if len(both) >= m and token == min(both & longs[a] & longs[b], default=None):
                yield a, b


def cell_members(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    hit = np.zeros(len(pdf), bool)
    for pair in cell_pairs(pdf, percent):
        hit[list(pair)] = True
    return pdf[hit]


def cell_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links confirmed on the full sets; only those that join components, so never more than the cell has rows."""
    root = {c: c for c in pdf["comp"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    ids, comp, sets, out = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), list(pdf["shingles"]), []
    for a, b in cell_pairs(pdf, percent):
        x, y = find(comp[a]), find(comp[b])
        if x != y and similar(sets[a], sets[b], percent):
            root[x] = y
            out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


CELL = "token long, i int, j int, own int, id long, comp long, n long, l int, bins binary, tokens array<long>, places array<long>, longs array<long>"


def links_between(docs: DataFrame, posted: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame | None:
    """(node, root) of the ids that are linked with another; None without a link. posted: id, key, n, pos, token."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        df, path = shared.stored(df, label)
        paths.append(path)
        return df

    def together(links: DataFrame) -> DataFrame:
        roots, more = components(links)
        paths.extend(more)
        return keep(roots, "roots")

    own = keep(chosen(posted, percent), "chosen")
    lists = own.select("id", "n", "l", F.explode("posts").alias("p")).select("id", "n", "l", "p.pos", "p.df", "p.token")
    long = keep(lists.where(F.col("df") > SHORT).select("token", "id").distinct(), "long")
    pivots = long.groupBy("token").agg(F.min("id").alias("a"))
    pairs = long.join(pivots, "token").where("id <> a").select("a", F.col("id").alias("b"))
    pairs = keep(pairs.unionByName(counted_pairs(lists.where(F.col("df") <= SHORT), percent)).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(long.select("id")).distinct()
    sets = keep(sets_of(docs, keep(ids, "met"), size), "sets")
    known = keep(sets.select("id", "n", "bins"), "known")

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(known.toDF("a", "na", "fa"), "a").join(known.toDF("b", "nb", "fb"), "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(screened(percent), "a long, b long").distinct()
        both = met.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("tb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("ta")), "a")
        both = both.withColumn("common", F.size(F.array_intersect("ta", "tb")))
        return both.where(100 * F.col("common") >= percent * (F.size("ta") + F.size("tb") - F.col("common"))).select("a", "b").distinct()

    def apart(frame: DataFrame, column: str, roots: DataFrame | None, name: str) -> DataFrame:
        if roots is None:
            return frame.withColumn(name, F.col(column))
        return frame.join(roots.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")

    # one partner each first: most pairs of a group of copies then lie in one component
    links = keep(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a"))), "links")
    roots = None if links.isEmpty() else together(links)
    rest = apart(apart(pairs, "a", roots, "ca"), "b", roots, "cb").where("ca <> cb").select("a", "b")
    more = keep(confirmed(rest), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = together(links)
    placed = keep(apart(long, "id", roots, "comp"), "placed")
    sizes = placed.join(own.groupBy("id").agg(F.max("n").alias("n")), "id").groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    sizes = keep(sizes.select("token", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")), "sizes")
    if sizes.isEmpty():
        return roots
    members = placed.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.join(own.select("id", F.col("n").alias("pn"), "l", F.transform("posts", lambda p: p["token"]).alias("tokens"), F.transform("posts", lambda p: p["pos"].cast("long")).alias("places"), F.transform(F.filter("posts", lambda p: p["df"] > SHORT), lambda p: p["token"]).alias("longs")), "id").join(known, "id").where("pn = n")
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "n", "l", "bins", "tokens", "places", "longs")
    met = cells.groupBy("token", "i", "j").applyInPandas(lambda pdf: cell_members(pdf, percent), CELL)
    whole = met.join(sets.select("id", "n", "shingles"), ["id", "n"]).select(*met.columns, "shingles")
    found = keep(whole.groupBy("token", "i", "j").applyInPandas(lambda pdf: cell_links(pdf, percent), "a long, b long").distinct(), "links")
    return roots if found.isEmpty() else together(links.unionByName(found))


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. What was written on the way but the last tables is removed."""
    spark, paths = docs.sparkSession, []
    found, path = shared.stored(scanned(docs, size), "scanned")
    pieces = found.where("piece IS NOT NULL")
    tasks = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    rows = found.where("piece IS NULL").select("doc_id", "n", "key")
    classes, _ = shared.stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id")), "classes")
    posts, sent = prefixes(docs, table_of(pieces, tasks), size, percent)
    posted, posted_path = shared.stored(posts.where("n > 0 AND id IS NOT NULL").join(classes, ["id", "key"], "left_semi"), "prefixes")
    sent.destroy()
    paths.append(posted_path)
    roots = links_between(docs, posted.dropDuplicates(["id", "key"]).select("id", "key", "n", F.posexplode("tokens").alias("pos", "token")), size, percent, paths)
    ends = classes.withColumn("end", F.col("id")) if roots is None else classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("end", F.coalesce("root", "id"))
    ends, _ = shared.stored(ends.select("key", "end"), "ends")
    for path in paths:
        shared.remove(spark, path)
    return rows.join(ends, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("end", "doc_id")).alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(shared.table(spark, sf_dir, "documents"))


ORACLE = near_dedup.ORACLE.replace("i + 3]", "i + 2]").replace("len(ws) - 3)", "len(ws) - 2)").replace(">= 80 *", ">= 90 *").replace(", component_id = doc_id AS kept", "")
QUERIES = {"op13_ngram_join": op13_ngram_join}
ORACLES = {"op13_ngram_join": ORACLE}
