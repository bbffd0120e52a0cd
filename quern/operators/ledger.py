"""One budget and one rate for all tasks of a stage: a ledger on the driver that every task asks before it calls a model.

A task reserves what a call may cost; the ledger refuses once what is spent and reserved reaches the limit, and says how long to wait where calls come
faster than the rate. When the call is done the task settles its true cost. So all tasks together never pass the limit by more than the
calls in flight cost beyond their estimate. A call without a known price closes the ledger. A reservation that is not settled within its lease (a
lost executor) is counted as spent at its estimate: money that may have gone. Starting from what the ledger table says is spent (`spent`), a stage that
runs again goes on where it stopped.

The ledger is a few numbers and the open reservations; requests are small and answered one by one.
"""

from __future__ import annotations

import secrets
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Connection, Listener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(Exception):
    """The budget is spent, or a call without a price has closed it."""


@dataclass
class Account:
    """What the ledger knows; times in seconds."""

    limit: float
    spent: float = 0.0
    per_second: float | None = None
    lease: float = 600.0
    unpriced: bool = False
    calls: int = 0
    refused: int = 0
    held: dict[int, tuple[float, float]] = field(default_factory=dict)
    recent: deque = field(default_factory=deque)

    def reserve(self, estimate: float, now: float) -> tuple[str, float]:
        """("ok", number), ("wait", seconds) or ("no", what is spent)."""
        for n, (cost, until) in list(self.held.items()):
            if until < now:
                self.spent += cost
                del self.held[n]
        if self.unpriced or self.spent >= self.limit:
            self.refused += 1
            return "no", self.spent
        if self.spent + sum(c for c, _ in self.held.values()) + estimate > self.limit:
            if self.held:  # what is in flight may turn out cheaper
                return "wait", 0.05
            self.refused += 1
            return "no", self.spent
        if self.per_second is not None:
            while self.recent and self.recent[0] <= now - 1:
                self.recent.popleft()
            if len(self.recent) >= self.per_second:
                return "wait", self.recent[0] + 1 - now
            self.recent.append(now)
        self.calls += 1
        self.held[self.calls] = estimate, now + self.lease
        return "ok", self.calls

    def settle(self, number: int, cost: float | None) -> None:
        if self.held.pop(int(number), None) is None:
            return  # its lease ran out and it was counted, or the message came twice
        self.unpriced |= cost is None
        self.spent += cost or 0.0


class Ledger:
    """The account behind a socket on the driver. `with Ledger(spark, limit) as ledger: … ledger.guard() …`"""

    def __init__(self, spark: SparkSession, limit: float, spent: float = 0.0, per_second: float | None = None, lease: float = 600.0) -> None:
        self.account, self.lock, self.key = Account(limit, spent, per_second, lease), threading.Lock(), secrets.token_bytes(32)
        self.listener = Listener((spark.conf.get("spark.driver.host", "127.0.0.1"), 0), authkey=self.key, backlog=256)
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self) -> None:
        while True:
            try:
                link = self.listener.accept()
            except OSError:
                return
            except Exception:
                continue  # someone without the key
            threading.Thread(target=self._answer, args=(link,), daemon=True).start()

    def _answer(self, link: Connection) -> None:
        try:
            while True:
                what, *given = link.recv()
                with self.lock:
                    link.send(self.account.reserve(given[0], time.monotonic()) if what == "reserve" else self.account.settle(*given))
        except (EOFError, OSError):
            link.close()

    def guard(self) -> Guard:
        return Guard(self.listener.address, self.key)

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *error: object) -> None:
        self.listener.close()


class Guard:
    """A task's way to the ledger; it travels with the task and connects when first used."""

    def __init__(self, address: tuple, key: bytes) -> None:
        self.address, self.key, self.link = address, key, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"link": None}

    def _ask(self, *message: object) -> object:
        if self.link is None:
            self.link = Client(self.address, authkey=self.key)
        self.link.send(message)
        return self.link.recv()

    def call(self, estimate: float, work: Callable[[], tuple[object, float | None]]) -> object:
        """work() -> (answer, cost), once the ledger allows it. A call that fails has cost its estimate."""
        while True:
            said, value = self._ask("reserve", estimate)
            if said == "no":
                raise Refused(f"spent {value}")
            if said == "ok":
                break
            time.sleep(max(0.001, value))
        cost: float | None = estimate
        try:
            answer, cost = work()
            return answer
        finally:
            self._ask("settle", value, cost)


def spent_so_far(ledger: DataFrame) -> float:
    """What a ledger table (cost) says is spent, for a stage that goes on."""
    return float(ledger.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0])
