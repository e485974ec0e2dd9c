"""Near-duplicate detection: MinHash signatures joined by a multi-index Hamming join, links confirmed on full shingle sets.

A signature has SLOTS values of b = 16 bits; the distance of two signatures is the number of slots that differ. At a similarity of 0.8
a slot differs with a probability of at most 0.2, so a distance above DISTANCE has a probability below 1e-6. Signatures are cut
into CHUNKS chunks of four slots. By pigeonhole two signatures within DISTANCE have a chunk with at most
DISTANCE // CHUNKS = 1 error; the allowed errors are enumerated as the four ways to leave one slot out. So equal keys
(chunk, slot left out, three values) bring together every pair within DISTANCE.

Documents with equal sets are one class and never expanded. Each key's bucket first gives a star: its smallest
class against each other one. Confirmed links make components. Buckets that still hold several components are then compared: those of
more than UNIT rows are dealt into units, each a block of the bucket against a block of its rows outside the commonest component, so
a task holds a bounded number of rows. Of the pairs across components those within the distance are named, each in its first common bucket only, if
their wide signatures (WIDE_SLOTS values of 4 bits, of the classes in such buckets alone) are within WIDE_DISTANCE too, which a
link again exceeds with a probability below 1e-6. That is done twice: first each row names its nearest such row alone, which merges
most components that belong together, then all pairs that are left are named. All named pairs are confirmed. Links inside a
component add nothing to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, id_and_text, key_filter, partitions, release, small_batches, stash, test_filter
from textloom.llm.shingles import mix, shingle_set

SLOTS, CHUNKS, DISTANCE = 60, 15, 29
WIDTH = SLOTS // CHUNKS
WIDE_SLOTS, WIDE_DISTANCE, WIDE_NEAR = 1024, 253, 215
FILTER_BITS = 1 << 26
#: Hashes of a set that are minimised at a time.
BLOCK = 2048
#: Rows of a bucket, about, that one unit of work holds on either side.
UNIT = 4096
_rng = np.random.default_rng(7)
FACTORS = _rng.integers(1, 2**63, (SLOTS + WIDE_SLOTS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**64, (SLOTS + WIDE_SLOTS, 1), np.uint64)
LEFT_OUT = [(c, [c * WIDTH + j for j in range(WIDTH) if j != k], k) for c in range(CHUNKS) for k in range(WIDTH)]
SIGNED = "doc_id long, n_shingles long, digest binary, sig binary"


def least_hashes(hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` hash functions over a set, mixed."""
    least = np.full(count, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), BLOCK):
        x = hashes[at : at + BLOCK] * FACTORS[first : first + count]
        x += SHIFTS[first : first + count]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(1), out=least)
    return mix(least)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS values of 16 bits."""
    return (least_hashes(hashes, 0, SLOTS) & np.uint64(0xFFFF)).astype("<u2")


def wide_signature(hashes: np.ndarray) -> bytes:
    """WIDE_SLOTS values of 4 bits, two in a byte."""
    x = (least_hashes(hashes, SLOTS, WIDE_SLOTS) & np.uint64(15)).astype(np.uint8)
    return (x[::2] << 4 | x[1::2]).tobytes()


def set_digest(hashes: np.ndarray) -> bytes:
    """Names a set: two independent sums of mixed hashes, and its size."""
    a, b = mix(hashes + np.uint64(1)).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") + len(hashes).to_bytes(4, "little")


def sign(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature of each row; a text without words has neither."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, signs = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, SIGNED)


def keys_of(classes: DataFrame) -> DataFrame:
    """(way, key, cls): one row per class and way to leave a slot of a chunk out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, SLOTS).astype(np.uint64)
            keys = np.empty((len(sig), len(LEFT_OUT)), np.uint64)
            for n, (chunk, slots, k) in enumerate(LEFT_OUT):
                packed = sig[:, slots[0]] | sig[:, slots[1]] << np.uint64(16) | sig[:, slots[2]] << np.uint64(32)
                keys[:, n] = mix(packed | np.uint64(chunk * WIDTH + k + 1) << np.uint64(48))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(LEFT_OUT)), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))], ["cls", "keys"])

    return classes.select("cls", "sig").mapInArrow(work, "cls long, keys array<long>").select(F.posexplode("keys").alias("way", "key"), "cls")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class that each class of ``edges`` (a, b) reaches; alternating large and small stars.

    A large star takes every larger neighbour of a node to the smallest one; a small star does so with the smaller ones. It is done
    when every class has one smaller neighbour and no large star moved anything. Skewed joins are split while they run.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        large = stash(large, "stars")
        small = stash(large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.max("moved").alias("moved")), "stars")
        if small.filter("m <> most OR moved").isEmpty():
            return small.select(F.col("u").alias("cls"), F.col("m").alias("comp")).unionByName(small.select(F.col("m").alias("cls"), F.col("m").alias("comp")).distinct())
        parents = small.select("u", "m")
        edges = large.join(parents, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(parents.withColumnRenamed("m", "v"))


class Linker:
    """The steps of one run: classes of equal sets, their candidates and the links between them."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.docs, self.words, self.percent = id_and_text(docs, id_col, text_col), words, percent
        self.spark = docs.sparkSession
        self.signed = stash(sign(docs, words, id_col, text_col), "signed")
        same = self.signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
        self.classes = stash(same.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def ratio(self, a: str, b: str):
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def stars(self) -> DataFrame:
        """(a, b): the smallest class of each bucket with each other one, if their distance and sizes allow a link. Also sets ``members``."""
        members = keys_of(self.classes)
        live = stash(members.groupBy("key").agg(F.min("cls").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "buckets")
        words = stash(key_filter(live.select(F.col("key").alias("h")), FILTER_BITS), "live")
        hit = test_filter(members.withColumn("h", F.col("key")), words, FILTER_BITS).filter("hit").select("way", "key", "cls")
        self.members = stash(hit.join(live, "key").select("way", "key", "cls", "lead"), "members")
        release(self.spark)
        return self.allowed(self.members.filter("lead <> cls").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct())

    def with_class(self, pairs: DataFrame, side: str, columns: list[str]) -> DataFrame:
        return pairs.join(self.classes.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)

    def allowed(self, pairs: DataFrame) -> DataFrame:
        met = self.with_class(self.with_class(pairs, "a", ["size", "sig"]), "b", ["size", "sig"]).filter(self.ratio("size_a", "size_b"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, SLOTS) for k in (2, 3))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((x != y).sum(1) <= DISTANCE))

        return met.select("a", "b", "sig_a", "sig_b").mapInArrow(near, "a long, b long")

    def from_texts(self, wanted: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
        """(cls, made): ``make`` of the shingle sets of ``wanted`` (cls); only texts that a filter lets through are cut into shingles again."""
        needed = stash(self.classes.join(wanted.distinct(), "cls", "left_semi").select("cls", "digest", "first_id"), "needed")
        key = lambda c: F.xxhash64(F.coalesce(c, F.lit(-1)))
        words = key_filter(needed.select(key("first_id").alias("h")), FILTER_BITS)
        size = self.words

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingle_set(t, size) for t in b.column(0).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([make(s) for s in sets], pa.binary())], ["digest", "made"])

        texts = test_filter(self.docs.withColumn("h", key("doc_id")), words, FILTER_BITS).filter("hit").select("text")
        found = texts.mapInArrow(work, "digest binary, made binary").join(needed, "digest").select("cls", "made")
        return stash(found.dropDuplicates(["cls"]), "made")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links on their full sets."""
        pairs = stash(pairs, "pairs")
        sets, percent = self.from_texts(pairs.select(F.explode(F.array("a", "b")).alias("cls")), lambda s: s.tobytes()), self.percent

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    common = int((x[at] == y).sum())
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        met = pairs.join(sets.select(F.col("cls").alias("a"), F.col("made").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("made").alias("y")), "b")
        links = stash(met.select("a", "b", "x", "y").mapInArrow(work, "a long, b long"), "links")
        release(self.spark)
        return links

    def mixed(self, comps: DataFrame) -> DataFrame:
        """(way, key, cls, comp) of the buckets that hold several components."""
        placed = self.members.join(comps, "cls", "left").select("way", "key", "cls", F.coalesce("comp", "cls").alias("comp"))
        placed = stash(placed, "placed")
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        return stash(placed.join(mixed, "key"), "mixed")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, cls, comp and more) by units (key, block, part): ``role``, and ``most``, the commonest component of the bucket.

        A bucket of up to UNIT rows is one unit of rows with role 0, and ``most`` is left open (-1). In a larger one each row is a target (2) in its
        block, once for each part of the rows outside the commonest component, and each of those rows is also a probe (1) in its part,
        once for each block. So every such row meets all rows of the bucket.
        """
        sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
        sizes = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("n_most"), F.max_by("comp", F.struct("n", "comp")).alias("most")).filter(F.col("n") > UNIT)
        count = lambda n: F.ceil(n / F.lit(UNIT)).cast("int")
        large = stash(sizes.select("key", "most", count(F.col("n")).alias("blocks"), count(F.col("n") - F.col("n_most")).alias("parts")), "large")
        place = lambda n: F.pmod(F.xxhash64("cls"), n.cast("long")).cast("int")
        unit = lambda block, part, role: F.struct(block.alias("block"), part.alias("part"), F.lit(role).alias("role"))
        targets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: unit(place(F.col("blocks")), q, 2))
        probes = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: unit(b, place(F.col("parts")), 1))
        units = F.when(F.col("most").isNull(), F.array(unit(F.lit(0), F.lit(0), 0))).when(F.col("comp") == F.col("most"), targets).otherwise(F.concat(targets, probes))
        met = rows.join(large, "key", "left").select(*rows.columns, F.coalesce("most", F.lit(-1)).alias("most"), F.explode(units).alias("unit"))
        return met.select(*rows.columns, "most", "unit.*")

    def across(self, rows: DataFrame, wide: DataFrame, nearest: bool) -> DataFrame:
        """Pairs within both distances that share a bucket but not a component; ``nearest``: at most one for each row and bucket."""
        about = self.classes.select("cls", "size", "sig").join(wide, "cls")
        rows = self.dealt(rows.join(about, "cls").select("way", "key", "cls", "comp", "size", "sig", "made"))
        percent = self.percent

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None
            for b in batches:
                t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
                if not t.num_rows:
                    continue
                cuts = unit_cuts(t)
                last = int(cuts[-1]) if len(cuts) else 0
                rest = t.slice(last)
                if last:
                    yield from crossing(t.slice(0, last), percent, nearest)
            if rest is not None and rest.num_rows:
                yield from crossing(rest, percent, nearest)

        unit = ["key", "block", "part"]
        found = rows.repartition(partitions(rows), *unit).sortWithinPartitions(*unit, "role", "size").mapInArrow(work, "key long, own long, a long, b long, far long")
        if nearest:
            found = found.groupBy("key", "own").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("pair")).select("pair.*")
        return found.select("a", "b").distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b) that span every component, and (cls, comp) of the classes that have any."""
        links = self.confirm(self.stars())
        comps, wide = stash(components(links), "components"), None
        for nearest in (True, False):
            rows = self.mixed(comps)
            wide = self.from_texts(rows.select("cls"), wide_signature) if wide is None else wide
            more = self.confirm(self.across(rows, wide, nearest))
            if not more.isEmpty():
                links = links.unionByName(more)
                # From the stars that are there already.
                comps = stash(components(comps.select(F.col("cls").alias("a"), F.col("comp").alias("b")).unionByName(more)), "components")
        return links, comps


def first_way(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The first way in which the signature ``own`` and each of ``others`` have a key in common; past all ways if none."""
    same = (others == own).reshape(-1, CHUNKS, WIDTH)
    equal = same.sum(2)
    chunk = (equal >= WIDTH - 1).argmax(1)
    rows = np.arange(len(others))
    left_out = np.where(equal[rows, chunk] == WIDTH, 0, same[rows, chunk].argmin(1))
    return np.where(equal[rows, chunk] >= WIDTH - 1, chunk * WIDTH + left_out, len(LEFT_OUT))


def unit_cuts(t: pa.Table) -> np.ndarray:
    """Where a new unit begins, but for the first one."""
    return np.flatnonzero(np.any([np.diff(t.column(c).to_numpy()) != 0 for c in ("key", "block", "part")], 0)) + 1


def crossing(t: pa.Table, percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of each unit of ``t`` (by unit, role, then size) in different components, of fitting sizes, within both distances, that no earlier bucket has."""
    way, keys, cls, comp, size, commonest, role = (t.column(c).to_numpy() for c in ("way", "key", "cls", "comp", "size", "most", "role"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, SLOTS)
    wide = np.frombuffer(b"".join(t.column("made").to_pylist()), np.uint64).reshape(len(keys), -1)
    ones = np.uint64(0x1111111111111111)
    cuts = [0, *unit_cuts(t).tolist(), len(keys)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        # Rows of the commonest component are only compared with others, so a bucket of one large component costs little.
        most, first = commonest[s], s + int(np.searchsorted(role[s:e], 2))
        probes = np.arange(s, first)
        if most < 0:
            names, counts = np.unique(comp[s:e], return_counts=True)
            most, first = names[counts.argmax()], s
            probes = np.flatnonzero(comp[s:e] != most) + s
        for i in probes.tolist():
            lo = first + int(np.searchsorted(100 * size[first:e], percent * size[i]))
            hi = first + int(np.searchsorted(percent * size[first:e], 100 * size[i], side="right"))
            # A pair of two such rows is met twice: the smaller class names it.
            at = np.flatnonzero((comp[lo:hi] != comp[i]) & ((comp[lo:hi] == most) | (cls[lo:hi] > cls[i]))) + lo
            x = wide[at] ^ wide[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            far = np.bitwise_count(x & ones).sum(1)
            ok = far <= (WIDE_NEAR if nearest else WIDE_DISTANCE)
            at, far = at[ok], far[ok]
            ok = (sig[at] != sig[i]).sum(1) <= DISTANCE
            at, far = at[ok], far[ok]
            ok = first_way(sig[i], sig[at]) == way[i] if len(at) else ok[ok]
            at, far = at[ok], far[ok]
            if nearest and len(at):
                best = int(np.lexsort((cls[at], far))[0])
                at, far = at[best : best + 1], far[best : best + 1]
            if len(at):
                own = np.full(len(at), cls[i])
                columns = [np.full(len(at), keys[i]), own, np.minimum(own, cls[at]), np.maximum(own, cls[at]), far.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "own", "a", "b", "far"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * common >= percent * all of their shingles. A component's id is its smallest doc_id that is not null, and that
    document is kept. Null and empty texts have no shingles and no links: their component is their own doc_id. Rows with
    equal ids get equal results; a row without id is kept only where its whole component has none. An empty table gives an empty result.
    """
    run = Linker(docs, words, percent, id_col, text_col)
    _, comps = run.links()
    named = run.classes.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_classes"))
    placed = attach(stash(named.select("comp", "digest", "n_rows"), "named"), least, "comp", "n_classes", run.classes.count()).select("digest", "n_rows", "component_id")
    rows = run.signed.select("doc_id", "n_shingles", "digest")
    met = attach(rows.filter("digest IS NOT NULL"), placed, "digest", "n_rows", rows.count())
    out = met.select("doc_id", "n_shingles", "component_id").unionByName(rows.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id.

    A row without id counts as one with a larger id than all others, made from its text. Rows that share an id stay if one of
    them does. Only rows whose id may be among those that go are shuffled; the others pass straight through.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.coalesce(docs[id_col].cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("doc_id"), text.alias("text"))
    found = near_duplicates(rows, words, percent)
    gone = stash(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id"), "gone")
    hashed = key_filter(gone.select(F.xxhash64("doc_id").alias("h")), FILTER_BITS)
    tested = test_filter(rows.select("row", "doc_id").withColumn("h", F.xxhash64("doc_id")), hashed, FILTER_BITS)
    stay = tested.filter("hit").join(gone, "doc_id", "left_anti")
    return tested.filter("NOT hit").select("row.*").unionByName(stay.select("row.*"))
