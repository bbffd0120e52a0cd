"""Approximate nearest neighbours by largest inner product: inverted lists scanned with adaptive dimension sampling.

Vectors are brought to nearest-distance form by one more component (sqrt(M^2 - |x|^2), 0 for queries), turned by a random
rotation, and put in the list of their nearest centroid. A query visits its `probes` nearest lists. In a list, distances are
summed over blocks of columns; after each block a hypothesis test compares the partial distance, scaled by the share of
dimensions seen, with the query's best so far, and candidates that fail it at significance EPSILON are abandoned. Those that
stay are scored by the inner product of the original vectors in double precision.

Equal vectors are one class, of which the smallest k + 1 ids are kept: no other member can be among k nearest. So a vector of
which there are very many weighs one entry. Lists are cut into blocks of about BLOCK vectors, queries of a list into
batches of at most QUERIES_A_BATCH; each block of a list is joined with its queries by (list, block), so no task holds a list. Queries
first visit their nearest list; the score of the best k + 1 found there bounds what is looked at in the others. Centroids and the rotation are fitted on at most SAMPLE vectors;
every vector is indexed. Probes are the fewest that reach TARGET recall on queries of the sample against the sample.

Vectors that are null, empty, zero, hold null or non-finite components, or have another dimension than most, take no part. Doubles are scored as doubles; index and tests use single precision.
Ties go to the smaller vec_id. Fewer candidates than k: all are returned. Repeated vec_ids are separate candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import shared

K = 20
SAMPLE = 20_000
MAX_LISTS = 4096
TARGET = 0.97
EPSILON = 2.5
COLUMNS = 16
BLOCK, QUERIES_A_BATCH = 2048, 256


class Index:
    """What is fitted on the sample: the largest norm, the rotation, the centroids in rotated space, the number of probes."""

    def __init__(self, sample: np.ndarray, norm: float, total: int, k: int) -> None:
        rng = np.random.default_rng(11)
        d = sample.shape[1] + 1
        self.norm = norm
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        x = self.turned(sample)
        lists = int(max(1, min(MAX_LISTS, total**0.5, len(x) // 8 or 1)))
        c = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(10):
            own = self.nearest(x, c, 1)[:, 0]
            sums, n = np.zeros_like(c), np.bincount(own, minlength=lists)
            np.add.at(sums, own, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        self.centroids = c
        self.probes = self.fitted(sample, x, k)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros((len(x), 1), np.float32) if query else np.sqrt(np.maximum(0, self.norm**2 - (x.astype(np.float64) ** 2).sum(1)))[:, None]
        return np.hstack([x, last]).astype(np.float32) @ self.rotation

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(x), min(n, len(c))), np.int64)
        for i in range(0, len(x), 1024):
            dist = (c**2).sum(1)[None] - 2 * x[i : i + 1024] @ c.T
            out[i : i + 1024] = np.argsort(dist, axis=1, kind="stable")[:, :n]
        return out

    def fitted(self, sample: np.ndarray, x: np.ndarray, k: int) -> int:
        some = np.linspace(0, len(x) - 1, min(300, len(x))).astype(int)
        scores = sample[some].astype(np.float64) @ sample.astype(np.float64).T
        scores[np.arange(len(some)), some] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        if not best.shape[1]:
            return len(self.centroids)
        own = self.nearest(x, self.centroids, 1)[:, 0]
        order = self.nearest(self.turned(sample[some], True), self.centroids, len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def scan(q: np.ndarray, x: np.ndarray, k: int, bound: float = np.inf) -> np.ndarray:
    """Positions in x (rotated vectors) that may be among the k nearest of q: all that the tests don't reject. bound: a squared distance that k others are known to keep."""
    n, d = x.shape
    seed = min(n, max(4 * k, 96)) if bound == np.inf else 0
    near = ((x[:seed] - q) ** 2).sum(1)
    if n <= seed:
        return np.arange(n)
    if seed:
        bound = np.partition(near, k - 1)[k - 1]
    left, part = np.arange(seed, n), np.zeros(n - seed, np.float32)
    for at in range(0, d, COLUMNS):
        stop = min(d, at + COLUMNS)
        part = part + ((x[left, at:stop] - q[at:stop]) ** 2).sum(1)
        limit = bound if stop == d else bound * stop / d * (1 + EPSILON / stop**0.5) ** 2
        stay = part <= limit * 1.0001 + 1e-6
        left, part = left[stay], part[stay]
    return np.concatenate([np.flatnonzero(near <= bound * 1.0001 + 1e-6), left])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floats as they are, other numbers as doubles."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def matrix(column, kind=np.float32) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. queries: vec_id; rows of vectors whose ids they are."""
    spark = vectors.sparkSession
    shared.small_batches(spark)
    v = valid(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return empty
    d = sizes["d"]
    v = v.where(F.size("v") == d)
    number = dict(v.dtypes)["v"].removeprefix("array<").removesuffix(">")
    raw_kind = {"float": np.float32, "double": np.float64}[number]
    mine = Window.partitionBy("v").orderBy("vec_id")
    members = v.withColumn("r", F.row_number().over(mine)).where(F.col("r") <= k + 1)
    classes, _ = shared.stored(members.groupBy("v").agg(F.min("vec_id").alias("class"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = v.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")
    asked, _ = shared.stored(asked.join(classes.select("v", "class"), "v").select(F.col("vec_id").alias("query_id"), "class"), "asked")
    top = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    sample = np.array([r[0] for r in classes.select("v", "class").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("v").collect()], np.float32)
    index = spark.sparkContext.broadcast(Index(sample, float(top[1]) ** 0.5, top[0], k))

    def listed(batches):
        import pyarrow as pa

        ix = index.value
        for b in batches:
            x = ix.turned(matrix(b.column(1)))
            own = ix.nearest(x, ix.centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), b.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["class", "list", "v", "x"])

    entries, _ = shared.stored(classes.select("class", "v").mapInArrow(listed, f"class long, list int, v array<{number}>, x array<float>"), "lists")
    parts = entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # at most MAX_LISTS rows

    def packed(t):
        import pyarrow as pa

        t = t.combine_chunks().sort_by("class")
        return pa.table({"list": t["list"][:1], "part": t["part"][:1], "classes": [t["class"].to_numpy().tobytes()], "v": [matrix(t["v"].combine_chunks(), raw_kind).tobytes()], "x": [matrix(t["x"].combine_chunks()).tobytes()]})

    parts, _ = shared.stored(parts, "parts")
    blocks = entries.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).select("list", "part", "class", "v", "x").groupBy("list", "part").applyInArrow(packed, "list int, part int, classes binary, v binary, x binary")
    blocks, _ = shared.stored(blocks, "blocks")

    def visits(first: bool):
        def run(batches):
            """class, v, bound (least score of its k + 1 best so far) to rows of a list and queries that visit it: their nearest list, or the further ones."""
            import pyarrow as pa

            ix = index.value
            for b in batches:
                raw = matrix(b.column(1), raw_kind)
                found = ix.nearest(ix.turned(raw, True), ix.centroids, ix.probes)[:, slice(0, 1) if first else slice(1, None)]
                ids, bounds = b.column(0).to_numpy(), b.column(2).to_numpy()
                own, lists = np.repeat(np.arange(len(ids)), found.shape[1]), found.ravel()
                order = np.argsort(lists, kind="stable")
                ends, out = np.searchsorted(lists[order], np.arange(len(ix.centroids) + 1)), []
                for a, z in zip(ends[:-1], ends[1:], strict=True):
                    for i in range(a, z, QUERIES_A_BATCH):
                        at = own[order[i : min(z, i + QUERIES_A_BATCH)]]
                        out.append({"list": int(lists[order[i]]), "asked": ids[at].tobytes(), "q": raw[at].tobytes(), "bounds": bounds[at].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("list", pa.int32()), *((n, pa.binary()) for n in ("asked", "q", "bounds"))]))

        return run

    def searched(batches):
        import pyarrow as pa

        ix = index.value
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for r in b.to_pylist():
                ids, asked_ids, bounds = np.frombuffer(r["classes"], np.int64), np.frombuffer(r["asked"], np.int64), np.frombuffer(r["bounds"], np.float64)
                raw, x = np.frombuffer(r["v"], raw_kind).reshape(len(ids), -1).astype(np.float64), np.frombuffer(r["x"], np.float32).reshape(len(ids), -1)
                q = np.frombuffer(r["q"], raw_kind).reshape(len(asked_ids), -1).astype(np.float64)
                # a score as a squared distance in rotated space
                limits = (q**2).sum(1) + ix.norm**2 - 2 * bounds
                for own, one, turned, limit in zip(asked_ids, q, ix.turned(q, True), limits, strict=True):
                    at = scan(turned, x, k + 1, limit)
                    score = (raw[at] * one).sum(1)
                    best = np.lexsort((ids[at], -score))[: k + 1]
                    out.append((np.full(len(best), own), ids[at[best]], score[best]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asked", "class", "score"])

    def scanned(wanted: DataFrame, first: bool) -> DataFrame:
        """asked, class, score: candidates of the queries' nearest list, or of the others; each block of a list meets its queries in its own task."""
        told = wanted.mapInArrow(visits(first), "list int, asked binary, q binary, bounds binary").join(F.broadcast(parts), "list")
        told = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return told.join(blocks, ["list", "part"]).select("asked", "q", "bounds", "classes", "v", "x").mapInArrow(searched, "asked long, class long, score double")

    wanted = classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v")
    nearest, _ = shared.stored(scanned(wanted.withColumn("bound", F.lit(float("-inf"))), True), "nearest")
    near = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
    best = nearest.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    bounds = best.where(F.col("r") == k + 1).select(F.col("asked").alias("class"), F.col("score").alias("bound"))
    further = wanted.join(bounds, "class", "left").select("class", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    met = nearest.unionByName(scanned(further, False))
    best = met.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r")
    listed_ids = best.join(classes.select("class", "ids"), "class").select("asked", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    best = listed_ids.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r")
    best = best.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    answers = asked.join(best, asked["class"] == best["asked"]).select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.select("vec_id").where("vec_id % 20 = 0"))


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLES: dict[str, str] = {}
