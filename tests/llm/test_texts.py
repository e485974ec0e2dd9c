"""Operators on texts against brute force, and their edge cases."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import bpe, chunks, exact, neardup, packing, quality, secrets, suffix
from textloom.llm.shingles import shingle_set

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in rows(df)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Exact deduplication


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_exact_marks_and_drops(docs, texts, bits):
    got = by_id(exact.mark_duplicates(docs, bits=bits))
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t or ""].append(i)
    for i, t in texts.items():
        same = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(same), len(same), i == max(same), sha(t or ""))
    left = exact.drop_duplicates(docs, bits=bits)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows(left)) == sorted(max(g) for g in groups.values())


def test_exact_edges(odd_docs, no_docs):
    got = rows(exact.mark_duplicates(odd_docs))
    assert len(got) == 7
    same = [r for r in got if r["group_size"] == 4]
    assert len(same) == 4 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {5}
    assert [r["keep_id"] for r in got if r["text_sha256"] == sha("")] == [7, 7]
    assert exact.drop_duplicates(odd_docs).count() == 3
    assert exact.mark_duplicates(no_docs).count() == 0 and exact.drop_duplicates(no_docs).count() == 0


# Secrets


def spans_of(t):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="tTokenſKpasswdAPI_Ky=: \"'abcdef0189AKIAZ.漢", max_size=120))
def test_base_spans(text):
    assert sorted(s for s in secrets.find_spans(text) if s[0] in secrets.BASE) == sorted(spans_of(text))


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_structures_are_confirmed():
    import base64

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 30) for k in range(8)))
    text64 = base64.b64encode(key).decode()
    wrapped = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, key))
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{part(b'{"alg":"HS256","typ":"JWT"}')}.{part(b'{"sub":"1234567890"}')}.{part(b'x' * 32)}"
    kinds = lambda t: [k for k, *_ in secrets.find_spans(t) if k not in secrets.BASE]
    assert kinds(f"see {text64} there") == ["key"]
    assert kinds(f"see {key.hex().upper()} there") == ["key"]
    assert kinds(base64.b64encode(wrapped).decode()) == ["key"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{text64[:64]}\n{text64[64:]}\n-----END RSA PRIVATE KEY-----")[0] == "pem"
    assert kinds(f"bearer {token}") == ["token"]
    broken = bytearray(key)
    broken[3] ^= 1
    assert kinds(base64.b64encode(bytes(broken)).decode()) == [] and kinds(base64.b64encode(key[:-1]).decode()) == []
    assert kinds("a" * 50 + "." + "b" * 50 + "." + "c" * 20) == [] and kinds("-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----") == []
    assert secrets.masked(f"bearer {token} end token=abcdefgh", "[S]") == "bearer [S] end [S]"


def test_keys_that_are_escaped_encrypted_or_wrapped():
    import base64

    der = lambda tag, body: bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body
    plain = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k]) * 40) for k in range(1, 9)))
    algorithm = der(0x30, der(6, b"\x2a\x86\x48") + der(0x30, der(4, b"saltsalt") + der(2, b"\x08")))
    digest = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, b"d" * 64))
    encrypted = der(0x30, algorithm + der(4, b"e" * 96))
    lines = lambda raw: [base64.b64encode(raw).decode()[k : k + 64] for k in range(0, 4 * len(raw), 64) if base64.b64encode(raw)[k : k + 64]]
    for raw, label in ((plain, "RSA PRIVATE KEY"), (encrypted, "ENCRYPTED PRIVATE KEY")):
        for end in ("\n", "\\n", "\\r\\n", "\\\\n"):
            pem = end.join([f"-----BEGIN {label}-----", *lines(raw), f"-----END {label}-----"])
            text = f'{{"k": "{pem}"}}'
            assert ("pem", 7, 7 + len(pem)) in secrets.find_spans(text) and [k for k, _, _ in secrets.find_spans(text)] == ["pem"], (label, end)
            body = end.join(lines(raw))
            assert ("key", 6, 6 + len(body)) in secrets.find_spans(f"here:\n{body}\nThe end") or end != "\n"
            assert ("key", 0, len(body)) in secrets.find_spans(body), (label, end)
    assert not secrets.find_spans(base64.b64encode(digest).decode()) and not secrets.find_spans("\n".join(lines(digest)))


def test_secrets_on_tables(docs, texts, odd_docs, no_docs):
    got = by_id(secrets.scan(docs))
    for i, t in texts.items():
        assert sorted((s["kind"], s["start"], s["end"]) for s in got[i]["spans"] if s["kind"] in secrets.BASE) == sorted(spans_of(t or ""))
    assert secrets.scan(odd_docs).count() == 7 and secrets.scan(no_docs).count() == 0
    clean = by_id(secrets.redact(docs))
    assert clean[113]["text"] == "[SECRET] [SECRET]" and clean[105]["text"] is None and clean[0]["text"] == texts[0]
    assert secrets.redact(docs).columns == docs.columns


# Byte pairs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abtheinΣé'<|> 1\n.~ñłж漢́\x1c"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=4))
def test_ids_are_those_of_the_library(found):
    mine = bpe.tokenizer(PATH)
    for raw, want in zip(mine.encode_batch(found), LIBRARY.encode_batch(found, add_special_tokens=False), strict=True):
        assert list(memoryview(raw).cast("I")) == want.ids
        assert bpe.joined(raw, bpe.token_names(PATH)) == LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_added_tokens_and_long_words():
    mine = bpe.tokenizer(PATH)
    for t in ("<|endoftext|>a<|startoftext|><|endoftext", "ab" * 40_000, "the " * 300_000 + "end", "thethe" * 30 + "'s"):
        assert list(memoryview(mine.encode_batch([t])[0]).cast("I")) == LIBRARY.encode(t, add_special_tokens=False).ids


def test_lower_ranks_made_on_the_way_go_first(tmp_path):
    """A vocabulary in which a late merge makes a pair of an early rank."""
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    symbols = bpe.byte_symbols()
    vocab = {t: i for i, t in enumerate([*symbols, *(s + "</w>" for s in symbols)])}
    merges = [["a", "b"], ["ab", "cd"], ["c", "d"], ["ab", "ab"], ["abcd", "ab"], ["x", "ab"], ["a", "a"], ["aa", "aa"], ["aa", "a"], ["cd", "cd"]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    mine, library = bpe.WordBpe(str(path)), Tokenizer.from_file(str(path))
    rng = np.random.default_rng(0)
    many = ["".join(rng.choice(list("abcdx"), 40)) for _ in range(400)] + ["abcdcdab" * 60, "a" * 501]
    for raw, want in zip(mine.encode_batch(many), library.encode_batch(many, add_special_tokens=False), strict=True):
        assert list(memoryview(raw).cast("I")) == want.ids


def test_bpe_on_tables(docs, texts, odd_docs, no_docs):
    got = by_id(bpe.decode(bpe.encode(docs, PATH), PATH))
    for i, t in texts.items():
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[i]["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and got[i]["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd_docs, PATH).count() == 7 and bpe.encode(no_docs, PATH).count() == 0


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_best_fit(lengths):
    place, fills = packing.best_fit(lengths, 60)
    totals = collections.Counter()
    for n, b in zip(lengths, place, strict=True):
        totals[b] += n
    assert [totals[b] for b in range(len(fills))] == fills and all(f <= 60 for f in fills)
    assert sum(2 * f <= 60 for f in fills) <= 1


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, texts, odd_docs, no_docs, capacity):
    got = rows(packing.pack_documents(docs, PATH, capacity))
    want = {}
    for i, t in texts.items():
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[i, k] = (s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    full(got, capacity)
    edge = rows(packing.pack_documents(odd_docs, PATH, capacity))
    assert len(edge) == 7
    full(edge, capacity)
    assert packing.pack_documents(no_docs, PATH).count() == 0


def full(got, capacity):
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.25 * total / capacity + 2


def test_levels_of_merging(spark):
    """More partitions than one merge takes: every item has one place and few bins stay open."""
    items = spark.range(0, 3000, 1, 40).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + id * 7919 % 97 AS length", "0L AS ids_crc32")
    got = rows(packing.pack(items, 100))
    assert len(got) == 3000 and len({r["doc_id"] for r in got}) == 3000
    full(got, 100)


# Repeated substrings


@pytest.mark.parametrize(("length", "limit"), [(24, 30_000), (24, 3), (400, 30_000), (400, 2), (3, 50)])
def test_repeats(spark, docs, texts, length, limit):
    seen = collections.Counter()
    raws = {i: (t or "").encode() for i, t in texts.items()}
    for b in raws.values():
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    got = by_id(suffix.remove_repeats(docs, length, limit))
    for i, b in raws.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), runs, sha(kept)), i


def test_repeats_edges(odd_docs, no_docs):
    got = rows(suffix.remove_repeats(odd_docs, 10))
    assert len(got) == 7 and [r["n_removed"] for r in got if r["n_bytes"] == 26] == [26] * 4
    assert suffix.remove_repeats(no_docs).count() == 0


def test_covers():
    for m in (1, 2, 7, 12, 200, 273):
        cover = suffix.difference_cover(m)
        assert {(a - b) % m for a in cover for b in cover} == set(range(m))
    assert len(suffix.difference_cover(273)) == 17


def edge_contexts(groups, each):
    """Rows of ``settle``: groups of contexts of one name, which agree from a place on that differs."""
    rng = np.random.default_rng(3)
    n = groups * each
    raw = np.repeat(rng.integers(97, 123, (groups, 672), dtype=np.uint8), each, 0)
    for row, k in zip(raw, rng.integers(0, 272, n).tolist(), strict=True):
        row[:k] = rng.integers(97, 123, k, dtype=np.uint8)
    columns = {"name": np.arange(n) // each, "uid": np.arange(n), "pos": np.full(n, 1000), "n": np.where(np.arange(n) % 5 == 0, 2, 1), "l": np.full(n, 272), "r": np.full(n, 272)}
    return pa.table({k: pa.array(x, pa.int64()) for k, x in columns.items()} | {"raw": pa.array([x.tobytes() for x in raw], pa.binary())})


@pytest.mark.parametrize(("groups", "each", "most"), [(7500, 4, 40), (1, 30_000, 100), (3, 10_000, 100)])
def test_memory_of_settling(groups, each, most):
    """A worker settles 30,000 contexts, in many groups or in one of the largest it takes, in few megabytes."""
    import tracemalloc

    cover, t = suffix.Cover(400), edge_contexts(groups, each)
    tracemalloc.start()
    whole = suffix.settle(t, cover)
    at_once = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.reset_peak()
    parts = list(suffix.settle_groups(iter(t.to_batches(max_chunksize=1024)), cover))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert whole.num_rows and at_once < 100 and peak < most
    key = lambda x: sorted(zip(*x.to_pydict().values(), strict=True))
    assert key(pa.Table.from_batches(parts)) == key(whole)


def test_contexts_of_long_texts():
    """A text with very many places gives its contexts in batches of bounded size."""
    cover, rng = suffix.Cover(400), np.random.default_rng(4)
    raws = [rng.bytes(k) for k in (500, 300_000, 400)]
    places = [np.arange(0, len(x) - cover.width + 1, 11).tolist() for x in raws]
    found = pa.array([[{"name": p * 7, "pos": p, "n": 1 + p % 2} for p in x] for x in places], pa.list_(pa.struct([(k, pa.int64()) for k in ("name", "pos", "n")])))
    out = list(suffix.surroundings(iter([pa.RecordBatch.from_arrays([pa.array([5, 6, 9]), pa.array(raws, pa.binary()), found], ["uid", "raw", "found"])]), cover))
    assert max(x.num_rows for x in out) <= 4096
    want = []
    for uid, raw, x in zip((5, 6, 9), raws, places, strict=True):
        for p in x:
            lo, hi = max(0, p - 272), min(len(raw), p + 128 + 272)
            want.append((p * 7, uid, p, 1 + p % 2, p - lo, hi - p - 128, raw[lo:hi]))
    assert list(zip(*pa.Table.from_batches(out).to_pydict().values(), strict=True)) == want


# Content-defined chunks


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_chunk_ends(raw):
    ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == len(raw)
    assert all(s <= chunks.MOST for s in sizes) and all(s >= chunks.LEAST for s in sizes[:-1])
    h, cut, last = 0, [], 0
    for k, b in enumerate(raw):  # the rolling hash, a byte at a time
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        if k + 1 - last == chunks.MOST or (h >> 32 - chunks.CUT_BITS == 0 and k + 1 - last >= chunks.LEAST):
            last = k + 1
            cut.append(last)
    assert [e for e in ends if e in cut or e == len(raw)] == ends and set(cut) <= set(ends)


def spans_cut(x):
    ends = chunks.chunk_ends(x).tolist()
    return list(zip([0, *ends], ends, strict=False))


def test_chunks_resist_insertions():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 20_000).astype(np.uint8)
    other = np.concatenate((raw[:5000], np.array([33], np.uint8), raw[5000:]))
    cut = lambda x: {x[s:e].tobytes() for s, e in spans_cut(x)}
    assert len(cut(raw) ^ cut(other)) <= 6


def test_chunk_dedup(docs, texts, odd_docs, no_docs):
    raws = {i: (t or "").encode() for i, t in texts.items()}
    cut = {i: spans_cut(np.frombuffer(b, np.uint8)) for i, b in raws.items()}
    seen = set()
    got = by_id(chunks.dedup_chunks(docs))
    assert set(got) == set(texts)
    for i in sorted(raws):
        runs = []
        for s, e in cut[i]:
            if raws[i][s:e] in seen:
                if runs and runs[-1][1] == s:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
            seen.add(raws[i][s:e])
        runs = [(s, e) for s, e in runs if e - s >= chunks.RUN]
        assert [(x["start"], x["end"]) for x in got[i]["spans"]] == runs, i
        kept = b"".join(raws[i][a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raws[i])], strict=True))
        assert got[i]["kept_sha256"] == sha(kept)
    assert all(got[i]["n_removed"] for i in range(93, 104))  # the shared passage
    assert chunks.dedup_chunks(odd_docs).count() == 7 and chunks.dedup_chunks(no_docs).count() == 0


# Near duplicates


def linked(texts, n, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return sets, top


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, texts, n):
    sets, top = linked(texts, n)
    got = by_id(neardup.near_duplicates(docs, n))
    for i in texts:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), top(i), top(i) == i), i
    left = neardup.keep_one(docs, n)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in rows(left)) == sorted(i for i in texts if top(i) == i)


def test_chains_reach_one_component(spark):
    """Each text is near the next one only."""
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for i in range(30):
        texts[100 - i] = " ".join(base)
        base = base[2:] + [f"n{i}a", f"n{i}b"]
    sets, top = linked(texts, 4)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4))
    assert {i: r["component_id"] for i, r in got.items()} == {i: top(i) for i in texts}


def test_near_duplicate_edges(odd_docs, no_docs):
    got = rows(neardup.near_duplicates(odd_docs))
    assert len(got) == 7 and sum(r["n_shingles"] == 0 for r in got) == 2
    same = [r for r in got if r["n_shingles"] == 2]
    assert [r["component_id"] for r in same if r["component_id"] == 5] and all(r["kept"] == (r["doc_id"] == 5) for r in same)
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0b\x0c\r\x1c é", max_size=60))
def test_shingle_counts(text):
    w = text.encode().lower().split()
    want = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    assert len(shingle_set(text, 3)) == len(want)


def test_every_pair_within_the_distance_shares_a_key(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, neardup.SLOTS).astype("<u2")
    signs = [base]
    for _ in range(300):
        x = base.copy()
        x[rng.choice(neardup.SLOTS, neardup.DISTANCE, replace=False)] ^= 1
        signs.append(x)
    got = neardup.keys_of(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(signs)], "cls long, sig binary")).collect()
    keys = collections.defaultdict(set)
    for r in got:
        keys[r["cls"]].add(r["key"])
    assert all(keys[0] & keys[i] for i in range(1, 301))


def test_large_buckets_are_dealt_into_bounded_units(spark, monkeypatch):
    """One key with a large component, a stray row and some small components: bounded units, the same pairs."""
    monkeypatch.setattr(neardup, "UNIT", 16)
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 30))) for i in range(150)]
    run = neardup.Linker(spark.createDataFrame(texts, "doc_id long, text string"), 2, 80, "doc_id", "text")
    sig, made = bytearray(2 * neardup.SLOTS), bytearray(neardup.WIDE_SLOTS // 2)
    run.classes = spark.createDataFrame([(i, 100, sig) for i in range(150)], "cls long, size long, sig binary")
    wide = spark.createDataFrame([(i, made) for i in range(150)], "cls long, made binary")
    comp = {i: 0 if i < 100 else 100 if i < 101 else i - i % 2 for i in range(150)}
    rows = spark.createDataFrame([(0, 9, i, c) for i, c in comp.items()], "way int, key long, cls long, comp long")
    got = run.across(rows, wide, False).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for i in range(150) for j in range(i + 1, 150) if comp[i] != comp[j]}
    near = run.across(rows, wide, True).collect()
    assert {(r["a"], r["b"]) for r in near} == {(0, i) for i in range(100, 150)}
    units = run.dealt(rows).groupBy("key", "block", "part", "role").count().collect()
    assert max(r["count"] for r in units) <= 2 * 16 and {r["role"] for r in units} == {1, 2}
    stray = run.dealt(rows.filter("cls <= 100")).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in stray} == {1: 7, 2: 101}


# Quality


def test_rules_learn_and_compile(spark):
    rng = np.random.default_rng(0)
    good = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(80)) + "." for _ in range(300)]
    data = [(i, t if i % 3 else " ".join(f"{w}%%%" for w in t.split()), int(i % 3 > 0)) for i, t in enumerate(good)] + [(300, None, None), (301, "", 1), (None, "x", 1)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in data], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    train = quality.training_labels(labels)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows(train))
    model = quality.fit(docs, train)
    assert 0 < len(model.rules) < 60
    got = rows(quality.score(docs, model))
    assert len(got) == 303 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], r["doc_id"]) for r in got if r["held_out"] and r["doc_id"] < 300]
    assert np.mean([p == int(i % 3 > 0) for p, i in held]) > 0.97
    x = np.array([quality.statistics(t or "") for _, t, _ in data])
    total = model.bias + sum(w * r.holds(x) for r, w in model.rules)
    want = {i: float(s) for (i, _, _), s in zip(data, 1 / (1 + np.exp(-total)), strict=True)}
    assert all(abs(want[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in got if r["predicted"]}


def test_no_labels(docs, no_docs):
    none = no_docs.select("doc_id", F.lit(1).alias("quality"))
    model = quality.fit(docs, quality.training_labels(none))
    assert {r["score"] for r in rows(quality.score(docs, model))} == {0.5} and quality.score(no_docs, model).count() == 0


def test_one_row_of_an_id_is_fitted_in_any_order(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda x, y: seen.append((x.tolist(), y.tolist())))
    labels = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, label double")
    docs = [(1, "word " * k) for k in range(1, 40)] + [(2, "one text"), (2, None)]
    for rows in (docs, docs[::-1]):
        quality.fit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labels)
    assert seen[0] == seen[1] and len(seen[0][0]) == 2
