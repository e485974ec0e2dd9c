"""Repeated substrings by a distributed difference-cover algorithm.

Every start of a repeated string of LENGTH bytes is wanted, so suffixes need to be told apart by their first LENGTH bytes
only. Suffixes at the positions of a difference cover (17 of 273) are the sample: for any two starts there is a shift below
273 that takes both into the sample, and what follows there still agrees for LENGTH - 272 bytes.

1. The sampled tuples of that many bytes are named by a 64-bit digest and sorted; neighbours with one name may be repeats.
   The names that occur twice go into a filter of fixed size; texts without such a name are done.
2. One recursion: names that stay are named again together with the bytes around them that any window can use. Equal
   contexts settle all starts that lead to them.
3. The remaining starts are merged in through the sample suffix that follows them: within a name, the windows of its distinct
   contexts are sorted, and neighbours that are equal are repeats.

Equality of digests stands for equality of strings; only strings with one name are ever compared by their last digest.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, id_and_text, partitions, release, small_batches, stash
from textloom.llm.repeated import SPANS, RepeatFilter, cut_out
from textloom.llm.shingles import BYTE_VALUES, mix

LENGTH = 400
#: Contexts of one name that a task takes at once; larger groups are shuffled by window.
GROUP_LIMIT = 30_000
#: Rows after which a task settles the whole groups it has, and contexts of one Arrow batch: a worker holds a few megabytes of them.
SETTLE_ROWS, CONTEXT_ROWS = 8192, 4096
#: Rows whose first windows are summed at a time: each byte takes 16 there.
BLOCK_ROWS = 512
STEP = 1 << 20
RADIX = 0xD1342543DE82EF95
U = np.uint64


def difference_cover(modulus: int) -> list[int]:
    """Residues whose differences give every residue. 273: the union of three orbits of doubling, in which each difference occurs once."""
    if modulus == 273:
        return sorted({x * 2**k % 273 for x in (1, 91, 117) for k in range(12)})
    root = max(1, int(modulus**0.5))
    return sorted({*range(min(root, modulus)), *(k % modulus for k in range(root - 1, modulus + root, root))})


@functools.lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(RADIX, -1, 1 << 64)
    up, down = np.ones(size + 1, U), np.ones(size + 1, U)
    up[1:], down[1:] = RADIX, inverse
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


class Cover:
    """The sample positions of a text, their names and contexts."""

    def __init__(self, length: int):
        self.length = length
        self.modulus = 273 if length >= LENGTH else max(1, length // 2)
        self.width = length - self.modulus + 1  # bytes of a tuple
        self.reach = self.modulus - 1  # bytes on either side that a window may use
        self.cover = np.array(difference_cover(self.modulus))

    def samples(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions, names and contexts, stretch by stretch, so that long texts need no long tables."""
        n, m, w, reach = len(raw), self.modulus, self.width, self.reach
        step = STEP // m * m
        up, down = powers(step + w + 3 * reach + 2)
        for at in range(0, max(n - w + 1, 0), step):
            lo = max(0, at - reach)
            part = raw[lo : at + step + w + reach]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
            base = np.arange(at, min(at + step, n - w + 1), m)
            p = (base[:, None] + self.cover).ravel()
            p = p[p + w <= min(n, at + step + w - 1)]
            q = p - lo
            names = mix((sums[q + w] - sums[q]) * down[q])
            left, right = np.minimum(p, reach), np.minimum(n - w - p, reach)
            context = mix((sums[q + w + right] - sums[q - left]) * down[q - left] + (left * 1000003 + right).astype(U))
            fits = left + right >= reach  # else no window lies in the text
            yield p[fits], names[fits], context[fits]


def suspects(texts: DataFrame, cover: Cover) -> DataFrame:
    """Every row, with the sample positions, names and contexts that may be repeated; only rows that have any keep their text."""
    known = RepeatFilter(texts, lambda raw: [x[1] for x in cover.samples(raw)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                raw = text.encode()
                found: list[list[np.ndarray]] = [[], [], []]
                for p, names, context in cover.samples(np.frombuffer(raw, np.uint8)):
                    hit = known.test(names)
                    for to, x in zip(found, (p, names.view(np.int64), context.view(np.int64)), strict=True):
                        to.append(x[hit])
                some = any(len(x) for x in found[0])
                values = [len(raw), hashlib.sha256(raw).hexdigest(), raw if some else None, *(np.concatenate(x) if some else None for x in found)]
                for to, x in zip(out, values, strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "digest", "raw", "pos", "name", "ctx"])

    release(texts.sparkSession)
    rows = texts.mapInArrow(work, "doc_id long, n_bytes long, digest string, raw binary, pos array<long>, name array<long>, ctx array<long>")
    return stash(rows.withColumn("uid", F.monotonically_increasing_id()), "suspects")


def edge_windows(groups: pa.Table, cover: Cover) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window place in turn: the place, the rows that have it, and their window digests, tied to the name."""
    reach, w, length = cover.reach, cover.width, cover.length
    left, right = groups.column("l").to_numpy(), groups.column("r").to_numpy()
    wide = np.zeros((len(left), 2 * reach + w), np.uint8)
    raws = itertools.chain.from_iterable(c.to_pylist() for c in groups.column("raw").iterchunks())
    for k, (raw, l) in enumerate(zip(raws, left.tolist(), strict=True)):
        wide[k, reach - l : reach - l + len(raw)] = np.frombuffer(raw, np.uint8)
    up, _ = powers(2 * reach + w + 1)
    own = mix(groups.column("name").to_numpy().view(U))
    h = np.zeros(len(left), U)
    for k in range(0, len(left), BLOCK_ROWS):
        h[k : k + BLOCK_ROWS] = (BYTE_VALUES[wide[k : k + BLOCK_ROWS, :length]] * up[:length]).sum(1, dtype=U)
    for s in range(reach + 1):
        valid = np.flatnonzero((left >= reach - s) & (right >= s))
        yield s, valid, mix(h[valid]) ^ own[valid]
        if s < reach:
            h = h - BYTE_VALUES[wide[:, s]] * up[s] + BYTE_VALUES[wide[:, s + length]] * up[s + length]


def settle(groups: pa.Table, cover: Cover) -> pa.RecordBatch:
    """(uid, lo, hi): the repeated windows of the edge contexts of whole groups."""
    flags = np.zeros((groups.num_rows, cover.reach + 1), bool)
    for s, rows, digests in edge_windows(groups, cover):
        order = np.argsort(digests)
        same = digests[order][1:] == digests[order][:-1]
        flags[rows[order[1:][same]], s] = True
        flags[rows[order[:-1][same]], s] = True
    flags &= (groups.column("n").to_numpy() == 1)[:, None]
    turn = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8))
    row, start = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    begin = groups.column("pos").to_numpy() - cover.reach  # where place 0 would be
    return pa.RecordBatch.from_arrays([pa.array(groups.column("uid").to_numpy()[row]), pa.array(begin[row] + start), pa.array(begin[row] + end - 1 + cover.length)], ["uid", "lo", "hi"])


def settle_groups(batches: Iterator[pa.RecordBatch], cover: Cover, least: int = SETTLE_ROWS) -> Iterator[pa.RecordBatch]:
    """``settle`` for rows in order of names: the whole groups among the rows so far, whenever there are ``least`` rows or more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held)
            cuts = np.flatnonzero(np.diff(t.column("name").to_numpy())) + 1
            if len(cuts):
                yield settle(t.slice(0, int(cuts[-1])), cover)
                held = t.slice(int(cuts[-1])).to_batches()
                rows = t.num_rows - int(cuts[-1])
    if rows:
        yield settle(pa.Table.from_batches(held), cover)


def joined_stretches(batches: Iterator[pa.RecordBatch], cover: Cover) -> Iterator[pa.RecordBatch]:
    """(uid, lo, hi) of the stretches around the positions of each row (uid, pos, n_bytes)."""
    for b in batches:
        uids, los, his = [], [], []
        for uid, pos, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            p = np.sort(np.array(pos, np.int64))
            lo, hi = np.maximum(p - cover.reach, 0), np.minimum(p + cover.width + cover.reach, n)
            first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
            uids += [uid] * len(first)
            los.append(lo[first])
            his.append(hi[np.append(first[1:], len(p)) - 1])
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), *(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (los, his))], ["uid", "lo", "hi"])


def surroundings(batches: Iterator[pa.RecordBatch], cover: Cover) -> Iterator[pa.RecordBatch]:
    """The places of each row (uid, raw, found) with the bytes around them, in batches that do not grow with the texts."""
    for b in batches:
        raws, found = b.column(1), b.column(2)
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        name, pos, n = (found.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("name", "pos", "n"))
        uid, size = b.column(0).to_numpy()[row], pc.binary_length(raws).to_numpy().astype(np.int64)[row]
        left, right = np.minimum(pos, cover.reach), np.minimum(size - cover.width - pos, cover.reach)
        start, end = pos - left, pos + cover.width + right
        for k in range(0, len(row), CONTEXT_ROWS):
            part = slice(k, k + CONTEXT_ROWS)
            texts = {i: raws[i].as_py() for i in np.unique(row[part]).tolist()}
            around = [texts[i][lo:hi] for i, lo, hi in zip(row[part].tolist(), start[part].tolist(), end[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[part], pa.int64()) for x in (name, uid, pos, n, left, right)), pa.array(around, pa.binary())], ["name", "uid", "pos", "n", "l", "r", "raw"])


def contexts(docs: DataFrame, places: DataFrame, cover: Cover) -> DataFrame:
    """``places`` (uid, pos, name, n, ...) with the bytes around each: l, r, raw."""
    by_doc = places.groupBy("uid").agg(F.collect_list(F.struct("name", "pos", "n")).alias("found"))
    return docs.select("uid", "raw").join(by_doc, "uid").select("uid", "raw", "found").mapInArrow(lambda batches: surroundings(batches, cover), "name long, uid long, pos long, n long, l long, r long, raw binary")


def repeats(docs: DataFrame, cover: Cover, limit: int) -> DataFrame:
    """(uid, lo, hi): stretches of the suspect rows ``docs`` that repeated windows cover."""
    samples = docs.select("uid", F.explode(F.arrays_zip("pos", "name", "ctx")).alias("x")).select("uid", "x.pos", "x.name", "x.ctx")
    distinct = stash(samples.groupBy("name", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("at")), "contexts")
    # A context met twice settles all its places.
    total = distinct.agg(F.sum("n")).first()[0] or 0
    ctx_key = F.xxhash64("name", "ctx")
    full = distinct.filter("n > 1").select(ctx_key.alias("k"), "n")
    n_bytes = docs.select("uid", "n_bytes")
    settled = attach(samples.withColumn("k", ctx_key).select("k", "uid", "pos"), full, "k", "n", total).filter("n IS NOT NULL")
    # Each text's settled stretches, joined where they touch: a long copy is one stretch, however many places it has.
    settled = settled.groupBy("uid").agg(F.collect_list("pos").alias("pos")).join(n_bytes, "uid")
    settled = stash(settled.mapInArrow(lambda batches: joined_stretches(batches, cover), "uid long, lo long, hi long"), "settled")
    release(docs.sparkSession)
    # Names with several contexts, some of which occur once: their windows are compared.
    names = distinct.groupBy("name").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1").select("name", "m")
    open_ = stash(attach(distinct.select("name", "n", "at.*"), names, "name", "m", distinct.count()).filter("m IS NOT NULL").withColumn("n", F.least("n", F.lit(2)).cast("long")), "open")
    small, large = open_.filter(F.col("m") <= limit), open_.filter(F.col("m") > limit)

    kind = "uid long, lo long, hi long"
    edges = contexts(docs, small, cover).repartition(partitions(docs), "name").sortWithinPartitions("name").mapInArrow(lambda batches: settle_groups(batches, cover), kind)
    edges = stash(edges, "edges")
    release(docs.sparkSession)
    if large.isEmpty():
        return settled.unionByName(edges)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                for s, rows, digests in edge_windows(t, cover):
                    at = pa.array(t.column("pos").to_numpy()[rows] - cover.reach + s)
                    yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(t.column("uid").to_numpy()[rows]), at, pa.array(t.column("n").to_numpy()[rows])], ["w", "uid", "lo", "n"])

    rows = stash(contexts(docs, large, cover).mapInArrow(windows, "w long, uid long, lo long, n long"), "windows")
    # The same start can be reached through two samples: it counts once.
    twice = rows.groupBy("w").agg(F.min(F.struct("uid", "lo")).alias("a"), F.max(F.struct("uid", "lo")).alias("b"), F.max("n").alias("most"), F.count("*").alias("c")).filter("a <> b OR most > 1").select("w", "c")
    wide = attach(rows.filter("n = 1"), twice, "w", "c", rows.count()).filter("c IS NOT NULL").select("uid", "lo", (F.col("lo") + cover.length).alias("hi"))
    return settled.unionByName(edges).unionByName(wide)


def remove_repeats(docs: DataFrame, length: int = LENGTH, limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of removed runs, in bytes).

    Removed is each byte in a string of ``length`` bytes that also starts anywhere else in any row, the same one included;
    every row counts as a text of its own, also with a null or repeated id. A null text is empty. Other columns are ignored; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    cover = Cover(length)
    rows = suspects(id_and_text(docs, id_col, text_col), cover)
    hot = rows.filter("raw IS NOT NULL")
    spans = repeats(hot, cover, limit).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    cut = cut_out(hot, spans)
    clean = rows.filter("raw IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.array().cast(SPANS).alias("spans"))
    out = clean.unionByName(cut)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
