"""Keyed state of streams: processors for ``transformWithState`` with values, lists and timers in RocksDB.

A batch costs what its own rows and keys cost: state that it does not touch is not read or written, and the store's own
checkpoints keep it. Rows are cut in front of the shuffle to what the state can still use, so a key with most of the rows sends few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which lists and timers need. A store that was chosen before stays."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)


def with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, mode: str = "Append", time: str = "None") -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, mode, time)


def cut_ahead(rows: DataFrame, keep: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Each Arrow batch of ``rows`` cut by ``keep`` before any row is shuffled."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield keep(b)

    return rows.mapInPandas(work, rows.schema)


def newest(rows: list[tuple], n: int) -> list[tuple]:
    return sorted(rows, key=lambda r: r[:2])[-n:]


class LastRows(StatefulProcessor):
    """The last ``n`` rows of a key, by time and order, as a list."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "at BIGINT, place BIGINT, row STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        have = before
        for b in rows:
            have = newest(have + list(zip(b["at"].tolist(), b["place"].tolist(), b["row"].tolist(), strict=True)), self.n)
        if have != before:
            self.rows.put(have)
            yield pd.DataFrame({"session": [key[0]], "held": [len(have)]})

    def close(self) -> None:
        pass


class Timed(StatefulProcessor):
    """A value per key and at most one timer, which moves with the key's last event."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.STATE}, timer BIGINT")

    def read(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def write(self, value: tuple, due: int, timerValues) -> None:
        """``value`` until the watermark passes ``due``."""
        due = max(due, timerValues.getCurrentWatermarkInMs() + 1)
        before = self.read()
        if before is not None and before[-1] != due:
            self.handle.deleteTimer(before[-1])
        if before is None or before[-1] != due:
            self.handle.registerTimer(due)
        self.value.update((*value, due))

    def close(self) -> None:
        pass


def in_order(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["event_ms", order], kind="stable")


class Stalls(Timed):
    """The time of a session's last event; a row when nothing follows for ``limit_ms``."""

    STATE = "last BIGINT"

    def __init__(self, order: str, limit_ms: int):
        self.order, self.limit_ms = order, limit_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.read()
        last = state[0] if state else None
        gaps = []
        for t in in_order(rows, self.order)["event_ms"].tolist():
            if last is not None and t - last > self.limit_ms:
                gaps.append(last)
            last = max(t, last or 0)
        self.write((last,), last + self.limit_ms + 1, timerValues)
        if gaps:
            yield pd.DataFrame({"session": [key[0]] * len(gaps), "silent_since": gaps})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.read()
        self.value.clear()
        if state:
            yield pd.DataFrame({"session": [key[0]], "silent_since": [state[0]]})


class Loops(Timed):
    """The last call of a session and how often it came in a row; forgotten after ``forget_ms`` of silence."""

    STATE = "call STRING, count BIGINT, seen BIGINT"

    def __init__(self, order: str, limit: int, forget_ms: int):
        self.order, self.limit, self.forget_ms = order, limit, forget_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, count, seen = (self.read() or ("", 0, 0, 0))[:3]
        out = []
        batch = in_order(rows, self.order)
        for verb, args, at, t in zip(*(batch[c].tolist() for c in ("verb", "args", self.order, "event_ms")), strict=True):
            call = f"{verb}|{args}"
            if seen and t - seen > self.forget_ms:
                last, count = "", 0
            last, count = call, count + 1 if call == last else 1
            seen = max(seen, t)
            if count >= self.limit:
                out.append((key[0], at, call, count))
        self.write((last, count, seen), seen + self.forget_ms, timerValues)
        if out:
            yield pd.DataFrame(out, columns=["session", "at", "call", "repeat"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield from ()


class FirstDecision(StatefulProcessor):
    """The first decision about a key; later ones change nothing and give nothing out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decision = handle.getValueState("decision", "decision STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.decision.exists():
            for _ in rows:
                pass
            return
        first = earliest(pd.concat(list(rows)))["decision"].iloc[0]
        self.decision.update((first,))
        yield pd.DataFrame({"source": [key[0]], "norm_value": [key[1]], "decision": [first]})

    def close(self) -> None:
        pass


def earliest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["ts", "decision"], kind="stable").drop_duplicates(["source", "norm_value"])
