"""Semantic operators: a model client behind a protocol, batches, reconciliation, resuming, budgets.

A client's answers are paid for, so each stage writes them to a table before anything reads them, and reads back what is done.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import code
from quern.operators import merge
from quern.operators.ledger import Guard, Refused
from quern.session import prepare


class Client(Protocol):
    """Answers a batch: key -> answer. It may leave keys out, repeat or invent some."""

    def answer(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]: ...


@dataclass
class Stub:
    """A client without a model: an answer is a function of the item, so runs are alike."""

    decide: Callable[[str], str] = lambda text: "yes" if int(hashlib.sha256(text.encode()).hexdigest(), 16) % 3 else "no"
    skips: int = 0  # every so many items of a batch is left out
    calls: int = field(default=0)

    def answer(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]:
        self.calls += 1
        return [(k, self.decide(t)) for i, (k, t) in enumerate(items) if len(items) == 1 or not self.skips or (i + 1) % self.skips]


class BudgetSpent(Exception):
    pass


class Fatal(Exception):
    """Asking again will not help: no quota left, an unknown route, no key."""


class RateLimited(Exception):
    """The provider asks for patience: for `wait` seconds, if it says so."""

    def __init__(self, message: str = "", wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


@dataclass
class Retrying:
    """A client that asks again after a failure, waiting longer each time, and stops for good at a fatal one.

    Rate limits have their own count (`limits`) and wait as long as the provider says. With a budget, no call starts once it is spent.
    """

    client: Client
    attempts: int = 5
    wait: float = 10.0
    most: float = 300.0
    fatal: tuple[type[Exception], ...] = (PermissionError, Fatal, BudgetSpent)
    limits: int = 6
    budget: Budget | None = None

    def answer(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]:
        failed = limited = 0
        while True:
            if self.budget:
                self.budget.check()
            try:
                return self.client.answer(items)
            except self.fatal:
                raise
            except RateLimited as e:
                limited += 1
                if limited == self.limits:
                    raise
                pause = self.wait * 2 ** (limited - 1) if e.wait is None else e.wait
            except Exception:
                failed += 1
                if failed == self.attempts:
                    raise
                pause = self.wait * 2 ** (failed - 1)
            time.sleep(min(pause, self.most))


@dataclass
class Strict:
    """A client whose answers must be JSON of a closed schema: others fail, so that a retrying client asks again."""

    client: Client
    schema: dict

    def answer(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]:
        closed, told = code.strict_schema(self.schema), self.client.answer(items)
        for key, answer in told:
            if wrong := code.schema_errors(json.loads(answer), closed):
                raise ValueError(f"{key}: {wrong[0]}")
        return told


@dataclass
class Budget:
    """Refuses a call once the spent amount reaches the limit, and every call after one without a price."""

    limit: float
    spent: float = 0.0
    unpriced: bool = False

    def check(self) -> None:
        if self.unpriced or self.spent >= self.limit:
            raise BudgetSpent(f"spent {self.spent} of {self.limit}")

    def record(self, cost: float | None) -> None:
        self.unpriced |= cost is None
        self.spent += cost or 0.0


#: Clients by name, so that a provider is one entry.
ROUTES: dict[str, Callable[[], Client]] = {"stub": Stub}


def route(name: str, environment: dict[str, str] | None = None, keys: Sequence[str] = ()) -> Callable[[], Client]:
    """The route of a name; fatal where there is none, or where none of its keys is set."""
    if name not in ROUTES:
        raise Fatal(f"unknown provider {name!r}; known: {sorted(ROUTES)}")
    if keys and not any((environment or {}).get(k) for k in keys):
        raise Fatal(f"{' or '.join(keys)} is not set")
    return ROUTES[name]


@dataclass
class Guarded:
    """A client whose calls the stage's ledger allows one by one: a batch is reserved at `price` an item and settled at what it cost (`cost`: items and answers -> amount, None if
    unknown). Once the ledger refuses, the batch's items stay unasked, so that the stage ends with what was paid for."""

    client: Client
    guard: Guard
    price: float
    cost: Callable[[list, list], float | None] | None = None

    def answer(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]:
        def work() -> tuple[list, float | None]:
            told = self.client.answer(items)
            return told, self.cost(items, told) if self.cost else self.price * len(items)

        try:
            return self.guard.call(self.price * len(items), work)
        except Refused:
            return []


def asked(items: DataFrame, key: str, text: str, client: Callable[[], Client], batch: int) -> DataFrame:
    """key, answer: as the client gave them, batch by batch within a partition; one client a task, whatever batches Arrow brings."""
    prepare(items.sparkSession)

    def run(arrow):
        import pyarrow as pa

        one, held = client(), []

        def told(part: list) -> pa.RecordBatch:
            got = one.answer(part)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([a for _, a in got], pa.string())], names=[key, "answer"])

        for rows in arrow:
            held += [(k, t or "") for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
            while len(held) >= batch:
                yield told(held[:batch])
                held = held[batch:]
        if held:
            yield told(held)

    return items.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, f"{key} string, answer string")


def sem_map(items: DataFrame, key: str, text: str, client: Callable[[], Client], path: str, batch: int = 5) -> DataFrame:
    """key, answer for every item: done ones are read from the checkpoint at path, the rest are asked in batches, and what a batch
    dropped, repeated or invented is asked again one by one. Each step is written before the next, so no answer is paid twice."""
    spark = items.sparkSession
    named = items.select(F.col(key).cast("string").alias(key), text)
    schema = f"{key} string, answer string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    done = lambda: spark.read.schema(schema).parquet(path)
    for size in (batch, 1):
        left = merge.not_yet(named, done(), [key])
        if left.isEmpty():
            break
        attempt = f"{path}-asked-{size}"
        asked(left, key, text, client, size).write.mode("overwrite").parquet(attempt)
        good, _ = merge.reconciled(spark.read.schema(schema).parquet(attempt), left, key)
        good.write.mode("append").parquet(path)
    return done()


def sem_filter(items: DataFrame, key: str, text: str, client: Callable[[], Client], batch: int = 5) -> DataFrame:
    """items with is_rule: yes true, no false, null where the reply lacks the row or has it twice. Replies are read once, so each item is asked once."""
    told = asked(items, key, text, client, batch).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.first("answer").alias("answer"))
    verdict = told.where("_n = 1").select("_k", F.when(F.col("answer") == "yes", True).when(F.col("answer") == "no", False).alias("is_rule"))
    return items.join(verdict, F.col(key).cast("string") == F.col("_k"), "left").drop("_k")


def sem_attribute(items: DataFrame, key: str, text: str, client: Callable[[], Client], path: str, batch: int = 5) -> DataFrame:
    """key, state_p: the probability that a state must hold, asked once an item; null where the answer is no probability."""
    p = F.expr("try_cast(answer AS double)")
    return sem_map(items, key, text, client, path, batch).select(key, F.when((p >= 0) & (p <= 1), F.round(p, 4)).alias("state_p"))


def replicated(items: DataFrame, n: int) -> DataFrame:
    return items.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
