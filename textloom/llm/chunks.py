"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes has its top CUT_BITS bits at zero, not before LEAST bytes and not after
MOST, so an insertion moves only the chunks around it. Chunks with equal 128-bit digests are duplicates: the first
place in order of doc_id and offset stays, the others go where duplicates in a row make at least RUN bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, id_and_text, release, small_batches, stash
from textloom.llm.repeated import SPANS, RepeatFilter, cut_out
from textloom.llm.shingles import BYTE_VALUES, mix

LEAST, CUT_BITS, MOST = 16, 5, 192
#: Shortest run of duplicate chunks that is removed: shorter ones are common phrases.
RUN = 96
GEAR = (BYTE_VALUES >> np.uint64(32)).astype(np.uint32)
STEP = 1 << 22


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 32 bytes, each shifted left by its age."""
    h = GEAR[raw]
    for age in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[age:] = h[:-age]
        h = h + (older << np.uint32(age))
    return h


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Where chunks end; the last end is that of the text."""
    n = len(raw)
    marks: list[int] = []
    for at in range(0, n, STEP):
        lo = max(0, at - 31)
        h = gear_hashes(raw[lo : at + STEP])[at - lo :]
        marks += (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + at + 1).tolist()
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            last = m
            ends.append(m)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunk_keys(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each chunk: mixed words of its bytes and their places."""
    if not len(ends):
        return np.empty(0, np.uint64)
    starts = np.concatenate(([0], ends[:-1]))
    place = (np.arange(len(raw)) - np.repeat(starts, ends - starts)).astype(np.uint64)
    sums = np.add.reduceat(mix(BYTE_VALUES[raw] + place * np.uint64(0x9E3779B97F4A7C15)), starts)
    return mix(sums + (ends - starts).astype(np.uint64))


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of removed runs, in bytes).

    Of equal chunks the one at the smallest doc_id, then offset, stays (null ids first; rows with equal ids in any fixed order). A null
    text is empty and has no chunks. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    known = RepeatFilter(texts, lambda raw: [chunk_keys(raw, chunk_ends(raw))])
    release(docs.sparkSession)
    kind = "array<struct<start:bigint,end:bigint,digest:binary>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for text in b.column(1).to_pylist():
                raw = text.encode()
                view = np.frombuffer(raw, np.uint8)
                ends = chunk_ends(view)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                hit = known.test(chunk_keys(view, ends)) if len(ends) else np.empty(0, bool)
                found = [{"start": s, "end": e, "digest": hashlib.blake2b(raw[s:e], digest_size=16).digest()} for s, e in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]
                for to, x in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), raw if found else None, found or None), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "digest", "raw", "chunks"])

    rows = texts.mapInArrow(work, f"doc_id long, n_bytes long, digest string, raw binary, chunks {kind}")
    rows = stash(rows.withColumn("uid", F.monotonically_increasing_id()), "chunked")
    hot = rows.filter("raw IS NOT NULL")
    places = stash(hot.select("doc_id", "uid", F.explode("chunks").alias("c")).select("doc_id", "uid", "c.*"), "places")
    groups = places.groupBy("digest").agg(F.min(F.struct("doc_id", "uid", "start")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    met = attach(places, groups, "digest", "n", places.count()).filter("n IS NOT NULL")
    runs = stash(met.filter("uid <> top.uid OR start <> top.start").groupBy("uid").agg(F.collect_list(F.struct(F.col("start").alias("lo"), F.col("end").alias("hi"))).alias("runs")), "runs")
    release(docs.sparkSession)
    cut = cut_out(hot, runs, run)
    clean = rows.filter("raw IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.array().cast(SPANS).alias("spans"))
    return clean.unionByName(cut).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
