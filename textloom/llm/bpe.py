"""Byte-pair encoding with word ends, by a pair occurrence index, and decoding.

The method: all words not met before in a batch of texts are laid out in one row of symbols. An index maps each
mergeable pair, by its rank, to all its positions there. Active ranks are applied in ascending order to all their
positions from left to right; a merge looks only at its two neighbours and adds the pairs it makes to their lists.
A merge that makes a pair of equal or lower rank puts the rest of its own list back and lets that rank go first, so the result is
that of merging each word alone.

Texts are normalised and cut as the tokenizer file says (NFC, white space, lower case, letters / single digits /
other signs). White space always parts words, so what stands between white space is looked up in a bounded cache first.
Chunks beyond ASCII are cut by the tokenizers library, whose Unicode tables say what a letter is; merging is done here.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from textloom.llm.common import id_and_text, small_batches

#: Entries of the worker's cache of chunks, their longest length, and the characters of a text handled at a time.
CACHE_ENTRIES, CACHE_LENGTH, STRETCH = 550_000, 48, 1 << 20
#: Lists of more positions than this are applied by numpy.
LONG_LIST = 40
#: Characters of text whose chunks are looked up together.
GROUP = 6 << 20
#: The word pattern and the white space of the tokenizer file. Below LATIN_END no letter or number was ever added.
LATIN_END = "\u0250"
_LETTERS, _NUMBERS = ("".join(re.escape(chr(i)) for i in range(ord(LATIN_END)) if unicodedata.category(chr(i))[0] == k) for k in "LN")
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+"
SPACE = "[\t-\r \x85\xa0  -     　]+"
#: Python's split() parts at these, the tokenizer does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbol[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of this kind, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a BPE file with word ends and lower case")
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
        symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        library = Tokenizer.from_file(path)
        self.cutter, self.normalizer = library.pre_tokenizer, library.normalizer
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + "</w>"] for s in symbols], np.int32)
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        lowest: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(self.merges):
            lowest.setdefault(a, rank)
            lowest.setdefault(b, rank)
        self.rewinds = [lowest.get(c, rank + 1) <= rank for rank, (_, _, c) in enumerate(self.merges)]
        self.words = re.compile(WORDS)
        self.split_space = re.compile(SPACE)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    def cut(self, chunk: str) -> list[str]:
        """The words of a chunk without white space. Letters and numbers of the Latin blocks are known here, others to the library."""
        if chunk.isascii() or max(chunk) < LATIN_END:
            return [chunk] if chunk.isalpha() else self.words.findall(chunk)
        return [bytes([self.byte_of[c] for c in w]).decode() for w, _ in self.cutter.pre_tokenize_str(chunk)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, merged together through one pair occurrence index."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        size = len(raw)
        # Arrays for single steps and, over the same memory, numpy views for long lists of positions.
        sym, nxt, prv = (array("i", bytes(4 * size)) for _ in range(3))
        symbols, after, before = (np.frombuffer(x, np.int32) for x in (sym, nxt, prv))
        symbols[:] = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        after[:] = np.arange(1, size + 1)
        before[:] = np.arange(-1, size - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        before[0] = -1
        where: dict[int, list[int]] = {}
        active: list[int] = []

        def add(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Put the pairs that can merge on the lists of their ranks."""
            keys = left.astype(np.int64) << 20 | right
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            if not hit.any():
                return
            ranks, places = self.key_ranks[at[hit]], places[hit]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order].tolist()
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, s, e in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(places)], strict=True):
                if r in where:
                    where[r] += places[s:e]
                else:
                    where[r] = places[s:e]
                    heapq.heappush(active, r)

        first = np.flatnonzero(after >= 0)
        add(first, symbols[first], symbols[after[first]])
        get, merges, rewinds = self.ranks.get, self.merges, self.rewinds
        while active:
            rank = heapq.heappop(active)
            a, b, c = merges[rank]
            places = where.pop(rank)
            if len(places) > LONG_LIST and a != b and not rewinds[rank]:
                i = np.array(places, np.int64)
                i.sort()
                i = i[np.flatnonzero(np.diff(i, prepend=-1))]
                j = after[i]
                ok = (symbols[i] == a) & (j >= 0) & (symbols[j] == b)
                i, j = i[ok], j[ok]
                n, p = after[j], before[i]
                symbols[i], symbols[j], after[i] = c, -1, n
                on = n >= 0
                before[n[on]] = i[on]
                add(i[on], symbols[i[on]], symbols[n[on]])
                back = p[(p >= 0)]
                add(back, symbols[back], symbols[after[back]])
                continue
            places.sort()
            for k, i in enumerate(places):
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = c, -1
                n, p = nxt[j], prv[i]
                nxt[i] = n
                low = rank + 1
                if n >= 0:
                    prv[n] = i
                    if (r := get(c << 20 | sym[n])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                        low = min(low, r)
                if p >= 0 and (r := get(sym[p] << 20 | c)) is not None:
                    if r in where:
                        where[r].append(p)
                    else:
                        where[r] = [p]
                        heapq.heappush(active, r)
                    low = min(low, r)
                if low <= rank and k + 1 < len(places):
                    if rank in where:
                        where[rank] += places[k + 1 :]
                    else:
                        where[rank] = places[k + 1 :]
                        heapq.heappush(active, rank)
                    break
        kept = symbols >= 0
        stop = (4 * np.cumsum(kept)[ends - 1]).tolist()
        out = symbols[kept].astype("<u4").tobytes()
        return [out[s:e] for s, e in zip([0, *stop[:-1]], stop, strict=True)]

    def stretches(self, text: str) -> Iterator[str | int]:
        """Ids of added tokens, and normalised stretches of text between them, cut at white space."""
        for part in self.split_added.split(text) if self.split_added and "<|" in text else [text]:
            if part in self.added:
                yield self.added[part]
                continue
            if not part.isascii():
                if any(unicodedata.category(c) == "Cn" for c in set(part)):  # newer letters than Python knows
                    part = self.normalizer.normalize_str(part)
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            at = 0
            while at < len(part):
                end = at + STRETCH
                if end < len(part):
                    m = self.split_space.search(part, end)
                    end = m.end() if m else len(part)
                yield part[at:end]
                at = end

    def chunks(self, stretch: str) -> list[str]:
        return [c for c in self.split_space.split(stretch) if c] if any(c in stretch for c in NOT_SPACE) else stretch.split()

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, in bytes. New chunks are cut into words, and of these only new ones are merged."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = self.cache
        found = list(map(known.get, chunks))
        new = {k: self.cut(chunks[k]) for k, ids in enumerate(found) if ids is None}
        words = list(dict.fromkeys(w for ws in new.values() for w in ws if w not in known))
        learned = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True)) if words else {}
        for k, ws in new.items():
            found[k] = b"".join([learned[w] if w in learned else known[w] for w in ws])
        known.update({w: ids for w, ids in learned.items() if len(w) <= CACHE_LENGTH})
        known.update({chunks[k]: found[k] for k, ws in new.items() if len(ws) > 1 and len(chunks[k]) <= CACHE_LENGTH})
        return found

    def gather(self, stretches: list[list[str]]) -> list[np.ndarray]:
        """The ids of stretches of text cut into chunks: each distinct chunk is looked up once, the rest is copying by number."""
        counts = np.fromiter(map(len, stretches), np.int64, len(stretches))
        coded = pa.array(list(chain.from_iterable(stretches)), pa.string()).dictionary_encode()
        ids = self.look_up(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        long = sizes[codes]
        stops = np.cumsum(long)
        at = np.repeat((firsts[codes] - stops + long).astype(np.int32), long)
        at += np.arange(len(at), dtype=np.int32)
        out = np.frombuffer(b"".join(ids), "<u4")[at]
        cuts = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [out[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list] = [[] for _ in texts]
        group: list[tuple[list, int, list[str]]] = []
        size = 0

        def close() -> None:
            if group:
                for (own, k, _), ids in zip(group, self.gather([c for _, _, c in group]), strict=True):
                    own[k] = ids.tobytes()
                group.clear()

        for own, text in zip(parts, texts, strict=True):
            for s in self.stretches(text):
                if isinstance(s, int):
                    own.append(s.to_bytes(4, "little"))
                    continue
                group.append((own, len(own), self.chunks(s)))
                own.append(b"")
                size += len(s)
                if size >= GROUP:
                    close()
                    size = 0
        close()
        return [own[0] if len(own) == 1 else b"".join(own) for own in parts]


def joined(ids: bytes, names: dict[int, str]) -> str:
    """Token strings parted by blanks, as the file has no decoder; ids that stand for no token are left out."""
    return " ".join([names[i] for i in memoryview(ids).cast("I").tolist() if i in names])


@functools.lru_cache(maxsize=2)
def token_names(path: str) -> dict[int, str]:
    """The token of each id: all that decoding needs of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary: little-endian unsigned 32-bit).

    ``path`` is a tokenizer file that every worker can open. A null text is empty and has no ids. Rows with null or equal ids
    are encoded each for itself; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.encode_batch(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids as ``encode`` gives them): doc_id, ids, decoded. Null ids count as none."""
    small_batches(encoded.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([joined(x or b"", names) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, decoded string")
