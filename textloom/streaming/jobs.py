"""Streaming forms of the event jobs.

Event time is in the column ``ts``. How late an event may come is the caller's choice. Streams end with a watermark, so
rows behind the last one are given out only when later events arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.events import BUFFER_ROWS, QUIET_MS, SETTLE_CAP_MS, STALL_MS
from textloom.operators.shapes import mask_by_policy, split_quarantine
from textloom.plans.masking import mask_documents
from textloom.session import cut_lineage
from textloom.streaming.state import FirstDecision, LastRows, Loops, Stalls, cut_ahead, earliest, use_rocksdb, with_state

#: Silence after which a session's calls are forgotten.
FORGET_MS = 86_400_000


def watch_regex(events: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Events whose text matches. Stateless."""
    return events.where(F.col(text).rlike(pattern))


def event_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per type and window; with ``slide`` the windows overlap. Counts are combined before the shuffle."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = events.withWatermark("ts", late).groupBy(window, "type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n")


def quiet_windows(events: DataFrame, quiet: str = f"{QUIET_MS} milliseconds", late: str = "10 seconds") -> DataFrame:
    """Stretches of activity that end in a quiet time, where open requests do not matter."""
    grouped = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", quiet).alias("w"))
    counts = grouped.agg(F.count("*").alias("events"))
    return counts.select("session", F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "events")


def request_lifecycle_stream(events: DataFrame, wait: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Every request beside its end, or with NULL when none came within ``wait``.

    The two sides are joined on the request and a bounded time, so state is dropped as the watermark moves on.
    """
    marked = events.withWatermark("ts", late)
    sent = marked.where("event = 'sent'").select("session", "request_id", "url", "method", F.col("ts").alias("sent_at"))
    ended = marked.where("event IN ('finished', 'failed')").select(
        F.col("session").alias("_s"), F.col("request_id").alias("_r"), F.col("event").alias("outcome"), "error", F.col("ts").alias("ended_at")
    )
    match = f"session = _s AND request_id = _r AND ended_at >= sent_at AND ended_at <= sent_at + INTERVAL {wait}"
    return sent.join(ended, F.expr(match), "left_outer").drop("_s", "_r")


def _by_session(
    events: DataFrame, late: str, output: str, state: str, step: Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]
) -> DataFrame:
    marked = events.withColumn("_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return marked.groupBy("session").applyInPandasWithState(step, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def _ordered(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame | None:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values(["_ms", order], kind="stable") if parts else None


def settle_stream(
    events: DataFrame, order: str = "event_id", quiet_ms: int = QUIET_MS, cap_ms: int = SETTLE_CAP_MS, late: str = "10 seconds"
) -> DataFrame:
    """Settled stretches per session, with open requests taken into account: the state is five numbers per session.

    ``kind`` is ``dom``, ``request``, ``response`` or ``failed``. Events of a session must come in order across batches. A stretch whose
    requests stay open ends anyway ``cap_ms`` after it began, once the session is quiet: ``ended_by`` is then ``cap`` and not ``quiet``.
    Either way the session's state goes.
    """

    def row(key: tuple, s: list, ended_by: str = "quiet") -> dict:
        end = s[1] + quiet_ms
        return {"session": key[0], "started": s[0], "last": s[1], "events": s[2], "mutations": s[3], "settled": end, "timed_out": end - s[0] > cap_ms, "ended_by": ended_by}

    def due(s: list) -> int:
        return int(s[1]) + quiet_ms if s[4] <= 0 else max(int(s[1]) + quiet_ms, int(s[0]) + cap_ms)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([row(key, s, "quiet" if s[4] <= 0 else "cap")])
            return
        batch = _ordered(batches, order)
        for t, kind in zip(batch["_ms"], batch["kind"]) if batch is not None else ():
            if s and t - s[1] >= quiet_ms and s[4] <= 0:
                out.append(row(key, s))
                s = [t, t, 0, 0, s[4]]
            s = s or [t, t, 0, 0, 0]
            s = [s[0], t, s[2] + 1, s[3] + (kind == "dom"), s[4] + (kind == "request") - (kind in ("response", "failed"))]
        if s:
            state.update(tuple(int(v) for v in s))
            state.setTimeoutTimestamp(max(due(s), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)

    output = "session STRING, started BIGINT, last BIGINT, events BIGINT, mutations BIGINT, settled BIGINT, timed_out BOOLEAN, ended_by STRING"
    return _by_session(events, late, output, "s BIGINT, l BIGINT, n BIGINT, m BIGINT, o BIGINT", step)


def stall_alerts(events: DataFrame, order: str = "event_id", limit_ms: int = STALL_MS, late: str = "10 seconds") -> DataFrame:
    """A row as soon as a session has been silent for ``limit_ms``; the state is the time of its last event, and goes with the alert."""
    marked = events.withColumn("event_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return with_state(marked, ["session"], Stalls(order, limit_ms), "session STRING, silent_since BIGINT", time="EventTime")


def loop_alerts(events: DataFrame, order: str = "event_id", limit: int = 3, late: str = "10 seconds", forget_ms: int = FORGET_MS) -> DataFrame:
    """The ``limit``-th and later of equal calls in a row; the state is the last call and its count.

    A session without an event for ``forget_ms`` is forgotten: its next call counts as the first.
    """
    marked = events.withColumn("event_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return with_state(marked, ["session"], Loops(order, limit, forget_ms), "session STRING, at BIGINT, call STRING, repeat BIGINT", time="EventTime")


def ring_buffer_stream(events: DataFrame, checkpoint: str, n: int = BUFFER_ROWS, order: str = "event_id") -> StreamingQuery:
    """Keep the last ``n`` events of every session as state of the stream; read them with ``ring_buffer_table``.

    The list of a session is the only thing that is kept of it, so the state is as large after a thousand batches as its sessions' buffers.
    Every Arrow batch is cut to ``n`` rows per session before the shuffle. ``order`` is a BIGINT column. A batch that is repeated
    leaves the same state.
    """

    def last(rows):
        return rows.sort_values(["at", "place"], kind="stable").groupby("session", dropna=False).tail(n)

    whole = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    packed = events.select("session", F.unix_micros("ts").alias("at"), F.col(order).cast("bigint").alias("place"), whole.alias("row"))
    held = with_state(cut_ahead(packed, last), ["session"], LastRows(n), "session STRING, held BIGINT", "Update")
    return held.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring_buffer_table(spark, checkpoint: str, schema) -> DataFrame:
    """The buffers of ``ring_buffer_stream`` after its last whole batch, read from its state. ``schema`` is that of its events."""
    use_rocksdb(spark)
    state = spark.read.format("statestore").option("stateVarName", "rows").option("flattenCollectionTypes", "true").load(checkpoint)
    return state.select(F.from_json("list_element.row", schema).alias("e")).select("e.*")


def mask_stream(
    docs: DataFrame, released: str, withheld: str, checkpoint: str, secret: str,
    decisions: Callable[[], DataFrame], values: Callable[[], DataFrame] | None = None, key: str = "doc_id",
) -> StreamingQuery:
    """Mask every batch and write cleared rows and withheld ones apart.

    Store and decisions are read again for each batch. A batch that is repeated after a failure replaces its own output.
    """

    def one(batch: DataFrame, number: int) -> None:
        masked = mask_by_policy(batch, decisions(), secret, key) if values is None else mask_documents(batch, values(), decisions(), secret, key)
        done = cut_lineage(masked)
        good, bad = split_quarantine(done)
        good.write.mode("overwrite").parquet(f"{released}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{withheld}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_memory(decisions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Remember the first decision about every (source, norm_value); later ones change nothing.

    What is known is state of the stream and is looked up by key: a batch reads nothing of what earlier ones wrote. New decisions are
    appended to ``out`` (source, norm_value, decision), each once. Repeats within an Arrow batch go before the shuffle.
    """
    told = cut_ahead(decisions.select("source", "norm_value", "decision", "ts"), earliest)
    first = with_state(told, ["source", "norm_value"], FirstDecision(), "source STRING, norm_value STRING, decision STRING")
    writer = first.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
