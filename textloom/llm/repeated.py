"""What the operators on repeated substrings share: a filter of keys that occur twice, and cutting runs out of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import partitions
from textloom.llm.shingles import mix

#: Bits of the filter and its hashes; bytes of text for each bucket of keys, and the most buckets.
FILTER_BITS, HASHES, BUCKET_BYTES, BUCKETS = 1 << 27, 4, 64 << 20, 1 << 16
SPANS = "array<struct<start:bigint,end:bigint>>"
U = np.uint64


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """HASHES bit positions in a slice of ``size`` bits."""
    return np.stack([(mix(keys + U(k + 1)) % U(size)).astype(np.int64) for k in range(HASHES)])


def at_most_two(keys: np.ndarray) -> np.ndarray:
    """Sorted ``keys`` with no more than two of each: two are enough to know a repeat."""
    keys = np.sort(keys)
    more = np.zeros(len(keys), bool)
    more[2:] = keys[2:] == keys[:-2]
    return keys[~more]


class RepeatFilter:
    """A Bloom filter of the 64-bit keys that occur twice or more in column ``text``; ``keys_of`` gives those of a text's bytes.

    Keys travel sorted and packed, at most two of each per batch, to the bucket that owns them; each bucket fills its own slice. The filter
    has FILTER_BITS bits at any size of the input and is broadcast; where many more keys repeat, more texts than needed pass.
    """

    def __init__(self, texts: DataFrame, keys_of: Callable[[np.ndarray], list[np.ndarray]]):
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = buckets = min(BUCKETS, max(partitions(texts), -(-total // BUCKET_BYTES)))
        self.size = size = FILTER_BITS // buckets // 8 * 8

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [x for t in b.column(0).to_pylist() for x in keys_of(np.frombuffer(t.encode(), np.uint8))]
                keys = at_most_two(np.concatenate(found)) if found else np.empty(0, U)
                if not len(keys):
                    continue
                bucket = (keys % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, keys = bucket[order], keys[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*cuts[1:].tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([keys[s:e].tobytes() for s, e in zip(cuts.tolist(), ends, strict=True)], pa.binary())], ["bucket", "keys"])

        def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [np.frombuffer(x, U) for b in batches for x in b.column(1).to_pylist()]
            if not got:
                return
            keys = np.sort(np.concatenate(got))
            del got
            keys = np.unique(keys[1:][keys[1:] == keys[:-1]])
            owner = (keys % U(buckets)).astype(np.int64)
            for k in np.unique(owner).tolist():
                bits = np.zeros(size, bool)
                bits[slots(keys[owner == k], size).ravel()] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

        rows = texts.select("text").mapInArrow(spread, "bucket int, keys binary").repartition(buckets, "bucket").mapInArrow(repeated, "bucket int, bits binary")
        table = np.zeros((buckets, size // 8), np.uint8)
        for r in rows.collect():  # FILTER_BITS in all, whatever the input
            table[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.shared = texts.sparkSession.sparkContext.broadcast(table)

    def test(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be repeated: all that are, and a few others."""
        at = slots(keys, self.size)
        row = (keys % U(self.buckets)).astype(np.int64)
        return ((self.shared.value[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(0)


def cut_out(rows: DataFrame, runs: DataFrame, least: int = 0) -> DataFrame:
    """``rows`` (uid, doc_id, n_bytes, raw) without the stretches of ``runs`` (uid, runs: array of lo, hi) that together make ``least`` bytes or more: doc_id, n_bytes, n_removed, kept_sha256, spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for raw, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found or []):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                merged = [[lo, hi] for lo, hi in merged if hi - lo >= least]
                left, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    left.update(raw[at:lo])
                    at = hi
                left.update(raw[at:])
                for to, x in zip(out, (sum(hi - lo for lo, hi in merged), left.hexdigest(), [{"start": lo, "end": hi} for lo, hi in merged]), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "kept_sha256", "spans"])

    met = rows.join(runs, "uid", "left").select("doc_id", "n_bytes", "raw", "runs")
    return met.mapInArrow(work, f"doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans {SPANS}")
