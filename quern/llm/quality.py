"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, with thresholds by language.

The model is over the characters of whole texts, in which any blanks count as one, so that contexts reach across words. It is
trained on all documents labelled as good and not as toxic but those kept for the thresholds. Counts, continuation counts, context sums and probabilities are aggregations and joins sharded by n-gram:

    P_n(c|h) = (C(hc) - D(C(hc))) / sum C(h.) + gamma(h) P_{n-1}(c|h')

with D for counts 1, 2 and 3 or more from the counts of counts, and lower orders counting the distinct characters before.
A document's perplexity is that of its whole text; it is rejected above its language's threshold and below its lower threshold
(text that repeats itself is too easy). A short text's perplexity says less, so both are wider by a factor of
10**(SLACK / sqrt(characters)); within that, they are the QUANTILE and the 1 - QUANTILE of documents labelled as good and not as
toxic in that language (of all languages where there are fewer than ENOUGH). These are documents that the model wasn't trained on:
every KEPT-th good one, by a hash of its id, is kept from training; each good one counts in the model or in the thresholds.
Only where fewer than ENOUGH are left do the trained ones count too.

The fitted model has at most ORDER entries a character of the trained texts; up to MAX_ENTRIES (24 bytes each) it goes to the
scorers, which read the documents where they lie and remember what frequent n-grams cost. A larger one stays in Spark: the
documents' distinct n-grams are joined with it, shard by shard; results are the same.

Null, empty and blank texts have no words and are rejected: nothing speaks for them. Very long texts are read whole. A null
language is a language of its own. Without any trusted document nothing but empty texts is rejected. Repeated rows each get their
row; rows that share an id are told apart by mark, a hash of the text, and share the id's label. Ties at a threshold are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared

U = np.uint64
ORDER = 5
MAX_ENTRIES = 4_000_000
QUANTILE, SLACK, ENOUGH = 0.995, 1.2, 30
#: One of so many trusted documents is kept from training, for the thresholds.
KEPT = 3
#: Up to so many ids to train on are broadcast (8 bytes each); more are joined by sorting.
BROADCAST_ROWS = 1_000_000
#: Distinct n-grams that a training task counts before it gives them away.
HELD = 100_000
OPEN, CLOSE = "\x02", "\x03"
#: Characters that part words.
BLANKS = re.compile(r"[\x20\t-\r]+")


def unit_of(text: str | None) -> str:
    """A text as the model reads it, with its start and end; empty without words."""
    text = BLANKS.sub(" ", text or "").strip(" ")
    return f"{OPEN * (ORDER - 1)}{text}{CLOSE}" if text else ""


def grams(docs: DataFrame) -> DataFrame:
    """key, g, n: the full-order n-grams of each row's text (columns key, text), counted in the row."""
    shared.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if unit := unit_of(text):
                    found = Counter(unit[i : i + ORDER] for i in range(len(unit) - ORDER + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "g", "n"])

    return docs.select(F.col("key").cast("long"), F.col("text").cast("string")).mapInArrow(run, "key long, g string, n long")


def counted(texts: DataFrame) -> DataFrame:
    """g, n: the full-order n-grams of all texts, counted over HELD distinct ones at a time before they are brought together."""
    shared.small_batches(texts.sparkSession)

    def run(batches):
        import pyarrow as pa

        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["g", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if unit := unit_of(text):
                    found.update(unit[i : i + ORDER] for i in range(len(unit) - ORDER + 1))
                    if len(found) >= HELD:
                        yield given()
                        found.clear()
        if found:
            yield given()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts."""
    found = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def train(texts: DataFrame) -> DataFrame:
    """The model: order, g, logp (log10 P of the last character after the others), back (log10 gamma of g as a context; null if it is none)."""
    counts = {ORDER: shared.stored(counted(texts), "counts")[0]}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = shared.stored(counts[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("n")), "counts")[0]
    lower = None
    model, backs = None, None
    alphabet = counts[1].count() + 1
    for n in range(1, ORDER + 1):
        d = discounts(counts[n])
        c = counts[n].withColumn("h", F.substring("g", 1, n - 1))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        sums = c.groupBy("h").agg(F.sum("n").alias("total"), F.sum(cut).alias("mass"))
        joined = c.join(sums, "h")
        gamma = F.col("mass") / F.col("total")
        if lower is None:
            p = joined.withColumn("p", (F.col("n") - cut) / F.col("total") + gamma / alphabet)
        else:
            joined = joined.withColumn("suffix", F.substring("g", 2, n - 1))
            p = joined.join(lower.select(F.col("g").alias("suffix"), F.col("p").alias("q")), "suffix").withColumn("p", (F.col("n") - cut) / F.col("total") + gamma * F.col("q"))
        lower, _ = shared.stored(p.select("g", "p"), "order")
        level = lower.select(F.lit(n).alias("order"), "g", F.log10("p").alias("logp"))
        back = sums.select(F.lit(n - 1).alias("order"), F.col("h").alias("g"), F.log10(gamma).alias("back"))
        model = level if model is None else model.unionByName(level)
        backs = back if backs is None else backs.unionByName(back)
    both = model.join(backs, ["order", "g"], "full_outer")
    unseen = both.sparkSession.createDataFrame([(-1, "", -math.log10(alphabet), None)], "order int, g string, logp double, back double")
    return shared.stored(both.unionByName(unseen), "model")[0]


def codes_of(units: str) -> np.ndarray:
    return np.frombuffer(units.encode("utf-32-le"), np.uint32).astype(U)


def gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each position from n - 1 on."""
    m = max(0, len(codes) - n + 1)
    out = np.full(m, n, U)
    for i in range(n):
        out = shared.mix(out * U(0x9E3779B97F4A7C15) + codes[i : i + m])
    return out


def row_hash(codes: np.ndarray) -> np.ndarray:
    """The same of each row of a matrix of n-grams."""
    out = np.full(len(codes), codes.shape[1], U)
    for column in codes.T:
        out = shared.mix(out * U(0x9E3779B97F4A7C15) + column)
    return out


class Scorer:
    """The model as sorted hashes; scores texts, and remembers the n-gram met last of those that fall in one of SLOTS slots."""

    SLOTS = 1 << 20
    #: Characters that are scored at once.
    PIECE = 1 << 18

    def __init__(self, tables: dict, unseen: float) -> None:
        self.tables, self.unseen = tables, unseen
        self.keys, self.values = np.zeros(self.SLOTS, U), np.full(self.SLOTS, np.nan)

    @staticmethod
    def pack(model: DataFrame) -> tuple[dict, float]:
        """The model as sorted hashes, order by order, so that the driver holds the strings of one order at once."""
        unseen, tables = 0.0, {}
        for n in range(-1, ORDER + 1):
            own = model.where(F.col("order") == n).select("g", "logp", "back").toArrow()
            if not own.num_rows:
                continue
            logp, back = (own[c].to_numpy() for c in ("logp", "back"))
            if n < 0:
                unseen = float(logp[0])
                continue
            keys = row_hash(codes_of("".join(own["g"].to_pylist())).reshape(-1, n)) if n else np.zeros(1, U)
            order = np.argsort(keys)
            tables[n] = (keys[order], logp[order].astype(np.float64), back[order].astype(np.float64))
        return tables, unseen

    def look(self, n: int, keys: np.ndarray, what: int) -> np.ndarray:
        """logp (1) or back (2) of n-grams; nan if there is none."""
        if n not in self.tables:
            return np.full(len(keys), np.nan)
        table = self.tables[n]
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[what][at], np.nan)

    def computed(self, rows: np.ndarray) -> np.ndarray:
        """log10 P of the last character of each full-order n-gram after the others."""
        logp, open_ = np.zeros(len(rows)), np.arange(len(rows))
        for n in range(ORDER, 0, -1):
            found = self.look(n, row_hash(rows[open_, ORDER - n :]), 1)
            ok = ~np.isnan(found)
            logp[open_[ok]] += found[ok]
            open_ = open_[~ok]
            if not len(open_):
                break
            context = row_hash(rows[open_, ORDER - n : ORDER - 1]) if n > 1 else np.zeros(len(open_), U)
            logp[open_] += np.nan_to_num(self.look(n - 1, context, 2), nan=0.0)
        logp[open_] += self.unseen
        return logp

    def looked(self, codes: np.ndarray) -> np.ndarray:
        """The same of the n-grams that end at each position from ORDER - 1 on."""
        keys = gram_hash(codes, ORDER)
        slots = (keys & U(self.SLOTS - 1)).astype(np.int64)
        out = self.values[slots]
        new = np.flatnonzero((self.keys[slots] != keys) | np.isnan(out))
        if len(new):
            out[new] = self.computed(np.lib.stride_tricks.sliding_window_view(codes, ORDER)[new])
            # keys and values of one slot must come from one n-gram, so the last of each slot is taken once
            at, last = np.unique(slots[new][::-1], return_index=True)
            last = new[len(new) - 1 - last]
            self.keys[at], self.values[at] = keys[last], out[last]
        return out

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 P, predicted characters) of each text."""
        logp, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held, size = [], 0

        def flush() -> None:
            codes = codes_of("".join(u for _, u in held))
            found = np.concatenate((np.zeros(ORDER - 1), self.looked(codes))) if len(codes) >= ORDER else np.zeros(len(codes))
            at = 0
            for i, u in held:
                logp[i] = found[at + ORDER - 1 : at + len(u)].sum()
                at += len(u)

        for i, text in enumerate(texts):
            if unit := unit_of(text):
                n[i] = len(unit) - ORDER + 1
                held.append((i, unit))
                size += len(unit)
                if size >= self.PIECE:
                    flush()
                    held, size = [], 0
        flush()
        return logp, n


def score(docs: DataFrame, model: DataFrame, max_entries: int = MAX_ENTRIES, sent: list | None = None) -> DataFrame:
    """doc_id, mark, lang, n_symbols, logp: log10 of the text's probability. sent gets the broadcast, to be destroyed once the result is stored."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), shared.mark().alias("mark"), F.col("lang").cast("string"), F.col("text").cast("string"))
    if model.count() > max_entries:
        return score_sharded(docs, model)
    told, made = spark.sparkContext.broadcast(Scorer.pack(model)), []
    if sent is not None:
        sent.append(told)

    def rows(batch):
        if not made:
            made.append(Scorer(*told.value))
        logp, n = made[0].documents(batch.column(3).to_pylist())
        return {"doc_id": batch.column(0), "mark": batch.column(1), "lang": batch.column(2), "n_symbols": n, "logp": logp}

    return shared.arrow_map(docs, rows, "doc_id long, mark long, lang string, n_symbols long, logp double")


def score_sharded(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same by joins: documents' distinct n-grams with the model, by shard of n-gram."""
    numbered, _ = shared.stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spots, _ = shared.stored(grams(numbered.select(F.col("row").alias("key"), "text")), "spots")
    kinds = spots.select("g").distinct()
    value, done = F.lit(0.0), F.lit(False)
    known = kinds
    for n in range(ORDER, 0, -1):
        p = model.where(F.col("order") == n).select(F.col("g").alias(f"g{n}"), F.col("logp").alias(f"p{n}"))
        known = known.withColumn(f"g{n}", F.substring("g", ORDER - n + 1, n)).join(p, f"g{n}", "left")
        b = model.where(F.col("order") == n - 1).select(F.col("g").alias(f"h{n}"), F.col("back").alias(f"b{n}"))
        known = known.withColumn(f"h{n}", F.substring("g", ORDER - n + 1, n - 1)).join(b, f"h{n}", "left")
        value = value + F.when(done, 0.0).otherwise(F.coalesce(f"p{n}", f"b{n}", F.lit(0.0)))
        done = done | F.col(f"p{n}").isNotNull()
    unseen = model.where(F.col("order") == -1).first()["logp"]
    known = known.select("g", (value + F.when(done, 0.0).otherwise(unseen)).alias("p"))
    sums = spots.join(known, "g").groupBy(F.col("key").alias("row")).agg(F.sum(F.col("p") * F.col("n")).alias("logp"), F.sum("n").alias("n_symbols"))
    zero = F.lit(0).cast("long")
    return numbered.select("row", "doc_id", "mark", "lang").join(sums, "row", "left").select("doc_id", "mark", "lang", F.coalesce("n_symbols", zero).alias("n_symbols"), F.coalesce("logp", F.lit(0.0)).alias("logp"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, mark, lang, n_symbols, perplexity (null without words), lower_threshold, threshold, rejected."""
    good = labels.where("quality = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = good.where("toxic = 0")
    for_training = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(KEPT)) != 0
    chosen, _ = shared.stored(good.where(for_training).select("doc_id"), "chosen")
    if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)  # the texts stay where they lie
    model = train(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id", "left_semi"))
    sent: list = []
    scored, _ = shared.stored(score(docs, model, sent=sent).withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.pow(F.lit(10.0), -F.col("logp") / F.col("n_symbols")))).drop("logp"), "scores")
    for told in sent:
        told.destroy()
    judged = scored.where("perplexity IS NOT NULL").join(good, "doc_id", "left_semi")
    unseen = judged.where(~for_training)
    trusted = unseen if unseen.limit(ENOUGH).count() == ENOUGH else judged
    wider = F.pow(F.lit(10.0), slack / F.sqrt(F.greatest("n_symbols", F.lit(1))))
    # calibrated at the width of each text's own length, so that short texts' spread doesn't widen the thresholds of long ones;
    # where documents are too few for the quantile to be more than their extreme, on the perplexity itself, which leaves room
    resolved = F.count("*") >= round(1 / (1 - quantile)) if quantile < 1 else F.lit(False)

    def end(own: Column, q: float) -> Column:
        return F.when(resolved, F.percentile_approx(own, q, 10_000)).otherwise(F.percentile_approx("perplexity", q, 10_000))

    ends = [end(F.col("perplexity") * wider, 1 - quantile).alias("own_low"), end(F.col("perplexity") / wider, quantile).alias("own_high")]
    limits = trusted.groupBy("lang").agg(*ends, F.count("*").alias("k"))
    limits = limits.select(F.col("lang").alias("of"), *(F.when(F.col("k") >= ENOUGH, F.col(c)).alias(c) for c in ("own_low", "own_high")))
    overall = trusted.agg(*ends).first()
    low, high = (F.coalesce(c, F.lit(overall[c]).cast("double")) for c in ("own_low", "own_high"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("lower_threshold", low / wider).withColumn("threshold", high * wider)
    outside = (F.col("perplexity") > F.col("threshold")) | (F.col("perplexity") < F.col("lower_threshold"))
    return out.select("doc_id", "mark", "lang", "n_symbols", "perplexity", "lower_threshold", "threshold", (F.col("perplexity").isNull() | F.coalesce(outside, F.lit(False))).alias("rejected"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")).drop("mark")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
