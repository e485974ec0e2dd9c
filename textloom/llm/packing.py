"""Best-fit packing of tokenised documents into sequences of bounded length, by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first. Full and nearly full bins are emitted at once. Underfull
bins become items: groups of ``FAN_IN`` partitions merge their underfull bins by best-fit again, level by level, until one
group is left. After a round at most one bin of a group is half full or less, so a level can use at most as many other bins as
hosts as there were partitions; the emptiest of these go on, the rest is emitted. What a task holds is thus
bounded by the number of partitions, not by the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import tokenizer
from textloom.llm.common import id_and_text, small_batches, stash

CAPACITY, END_ID = 4096, 1
#: A bin with no more room than this counts as nearly full.
NEARLY_FULL = 4
FAN_IN = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and the fill of each bin; items go longest first to the fullest bin that takes them."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r exists
    place, fills = [0] * len(lengths), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        place[k] = b
        fills[b] += n
        left = room - n
        if left:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return place, fills


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document with its closing id 1: doc_id, piece, start, length, ids_crc32.

    Every document has at least one piece (a null or empty text: the closing id alone). Ids are those of ``bpe.encode``.
    """
    small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), t.encode_batch(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, PIECES)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``items`` (PIECES; 0 < length <= capacity) a sequence_id and a gapless offset there.

    Rows are told apart by where they stand, so null or repeated ids do no harm. An empty table gives an empty result.
    """
    spark = items.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = context.partitionId() << 33
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        place, fills = best_fit(lengths.tolist(), capacity)
        place = np.array(place)
        order = np.argsort(place, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        offsets = np.empty(len(place), np.int64)
        offsets[order] = before - np.repeat(before[first], np.diff(np.append(first, len(place))))
        out = table.append_column("bin", pa.array(base + place)).append_column("at", pa.array(offsets)).append_column("fill", pa.array(np.array(fills)[place]))
        yield from out.to_batches(max_chunksize=100_000)

    packed = stash(items.mapInArrow(local, f"{PIECES}, bin long, at long, fill long"), "packed")
    leaves = packed.filter(f"fill < {capacity - NEARLY_FULL}").groupBy("bin").agg(F.max("fill").alias("fill"))
    groups = max(1, items.rdd.getNumPartitions())
    hosts = groups
    # Each underfull bin: the leaf bin, the bin it lies in now, its place there, that bin's fill, and its group.
    moved = None
    level = leaves.select("bin", F.col("bin").alias("top"), F.lit(0).cast("long").alias("base"), "fill", F.shiftright("bin", 33).alias("grp"))
    while True:
        groups = -(-groups // FAN_IN)
        level = level.withColumn("grp", F.floor(F.col("grp") / FAN_IN)).repartition(groups, "grp")
        level = stash(level.groupBy("grp").applyInPandas(lambda pdf: merge(pdf, capacity, hosts), "bin long, top long, base long, fill long, grp long, open boolean"), "merged")
        done = level.filter("NOT open").select("bin", "top", "base")
        moved = done if moved is None else moved.unionByName(done)
        if groups == 1:
            moved = moved.unionByName(level.filter("open").select("bin", "top", "base"))
            break
        level = level.filter("open").drop("open")
    out = packed.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("top", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))


def merge(pdf, capacity: int, hosts: int):
    """One more best-fit round over the bins of a group, each a single item; ``open`` bins go on to the next level."""
    tops = pdf.drop_duplicates("top")[["top", "fill"]].sort_values("top")
    place, fills = best_fit(tops["fill"].tolist(), capacity)
    names, starts, used = {}, [], [0] * len(fills)
    for top, b, n in zip(tops["top"].tolist(), place, tops["fill"].tolist(), strict=True):
        names.setdefault(b, top)
        starts.append(used[b])
        used[b] += n
    small = {b for b, f in enumerate(fills) if 2 * f <= capacity}
    rest = sorted((b for b, f in enumerate(fills) if b not in small and f < capacity - NEARLY_FULL), key=lambda b: fills[b])
    going = small | set(rest[:hosts])
    to = {t: (names[b], s, fills[b], b in going) for t, b, s in zip(tops["top"].tolist(), place, starts, strict=True)}
    got = [to[t] for t in pdf["top"].tolist()]
    pdf = pdf.assign(base=[x + g[1] for x, g in zip(pdf["base"].tolist(), got, strict=True)], top=[g[0] for g in got], fill=[g[2] for g in got], open=[g[3] for g in got])
    return pdf[["bin", "top", "base", "fill", "grp", "open"]]


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; equal and null ids are packed row by row; other columns are ignored.
    """
    return pack(stash(pieces(docs, path, capacity, id_col, text_col).repartition(_leaves(docs)), "pieces"), capacity)


def _leaves(docs: DataFrame) -> int:
    """Partitions of the first round: few enough that each holds thousands of pieces."""
    return max(1, min(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
