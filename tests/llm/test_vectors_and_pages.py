"""Nearest neighbours and archives, against brute force, and their edge cases."""

import gzip
import hashlib
import io
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from textloom.llm import ann, warc

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.IntegerType()), T.StructField("ids", T.StringType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("n", T.IntegerType())])


def exact_nearest(vectors, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            found = sorted((-float(x @ y), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("shard", [8192, 150])
def test_recall(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 900)] + 0.5 * rng.normal(size=(900, 24))) * rng.uniform(0.5, 2, (900, 1))
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*v, 1, "x") for v in vectors], VECTORS), 20, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact_nearest(vectors, 20, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - float(np.array(vectors[q][1], np.float32).astype(float) @ np.array(vectors[i][1], np.float32).astype(float))) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.95


def test_vector_edges(spark):
    same = [1.0, 0.0, 0.5]
    vectors = [(i, same) for i in range(0, 40)] + [(40, [0.0, -0.0, 0.0]), (60, None), (80, [1.0, None, 0.0]), (100, [float("nan"), 1.0, 0.0]), (120, [float("inf"), 1.0, 0.0]), (140, []), (None, [9.0, 9.0, 9.0]), (160, [1.0, 2.0]), (161, [3.0, 4.0]), (41, [-1.0, 0.0, 0.0]), (41, [-1.0, 0.0, 0.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*v, None, None) for v in vectors], VECTORS)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 20, 160}
    assert sorted(got[0]) == [(k, k) for k in range(1, 21)]  # ties go to the smaller id, never to itself
    assert sorted(got[20]) == [(k + 1, k) for k in range(20)]
    assert got[160] == [(1, 161)]  # fewer candidates than asked for
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_ties_between_unlike_vectors(spark, monkeypatch):
    """400 vectors with one and the same score for the query, in several shards: of those the beams find, the smallest ids come first."""
    monkeypatch.setattr(ann, "SHARD", 100)
    rng = np.random.default_rng(3)
    ids = rng.permutation(np.arange(1, 1000))[:400]
    vectors = [(0, [4.0, 0.0, 0.0])] + [(int(i), [0.5, float(rng.integers(-64, 64)) / 64, float(n)]) for n, i in enumerate(ids)]
    vectors = [(i, [v[0], v[1], v[2] / 512]) for i, v in vectors]
    got = ann.nearest(spark.createDataFrame([(*v, None, None) for v in vectors], VECTORS), every=1000).orderBy("rank").collect()
    assert [r["score"] for r in got] == [2.0] * 20
    found = [r["vec_id"] for r in got]
    assert found == sorted(found)
    # Every shard holds fewer points than its beam finds, so nothing smaller was left out.
    assert found == sorted(int(i) for i in ids)[:20]


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], float)
    kept = ann.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 0, -1]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


@pytest.fixture(scope="module")
def pages():
    long = "<html>" + "same " * 40 + "</html>"
    rows = [(i, f"http://h{i % 3}.test/{i}", f"<p>{'é' * i} page {i}</p>" * 20) for i in range(20)]
    rows += [(30, "http://a.test/x", long), (25, "http://b.test/y z\r\nX: 1", long), (40, None, long), (41, "u", None), (42, "u", ""), (43, "u", "x" * 99), (44, "u", "x" * 99), (45, "u", "y" * 100), (46, "u", "y" * 100), (None, "u", long), (30, "again", long), (50, "\0ÿ", "WARC/1.1\r\n\r\nnot a record\r\n\r\n" * 9), (51, "big", "z" * 3_000_000)]
    return rows


def test_archives(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], PAGES).repartition(3)
    folder = f"file://{tmp_path}"
    records = warc.roles(df)
    archives = warc.write_archives(records, folder)
    assert archives.count() >= 3
    members = warc.normalise(archives)
    got = warc.read_records(members).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, html in pages:
        b = (html or "").encode()
        first[b] = min(first.get(b, 1 << 60), 1 << 60 if i is None else i)
    want = []
    for i, _, html in pages:
        b = (html or "").encode()
        again = len(b) >= 100 and i != first[b]
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first[b] if again else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    texts = {i: (html or "").encode() for i, _, html in pages}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == texts[r["page_id"]]
    # A whole-file stream is one member; afterwards each record is one, at the listed places.
    path = archives.first()["archive"].removeprefix("file://")
    raw = open(path, "rb").read()
    one = zlib.decompressobj(31)
    one.decompress(raw)
    assert one.eof and not one.unused_data
    for m in members.collect():
        data = open(m["archive"].removeprefix("file://"), "rb").read()
        listed = [json.loads(x) for x in open(m["index"].removeprefix("file://"))]
        assert len(listed) == m["records"] and listed[-1]["offset"] + listed[-1]["length"] == len(data)
        for e in listed:
            own = zlib.decompressobj(31)
            part = own.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert own.eof and not own.unused_data and part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n")
        gzip.decompress(data)


def test_normaliser_takes_any_mixture_of_members():
    parts = [warc.record(i, "u", b"p" * (i * 700_000), "d", "response", None) for i in range(4)]
    for whole in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts)), gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2] + parts[3])):
        stream, count = warc.Inflated(io.BytesIO(whole)), 0
        while (head := stream.until(b"\r\n\r\n")) is not None:
            stream.take(int(warc.headers(head)["content-length"]) + 4)
            count += 1
        assert count == 4
    broken = warc.Inflated(io.BytesIO(gzip.compress(b"".join(parts))[:-2000]))
    with pytest.raises(ValueError):
        while (head := broken.until(b"\r\n\r\n")) is not None:
            broken.take(int(warc.headers(head)["content-length"]) + 4)


def test_no_pages(spark, tmp_path):
    assert warc.archive_pages(spark.createDataFrame([], PAGES), f"file://{tmp_path}").count() == 0


def gzip_cut(tmp_path, keep):
    """An archive of two records with the stream flushed between them, cut to ``keep`` of its bytes after the first record."""
    import zlib

    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    records = [warc.record(i, f"http://a.test/{i}", b"payload %d" % i * 50, "0" * 64, "response", None) for i in (1, 2)]
    first = packer.compress(records[0]) + packer.flush(zlib.Z_FULL_FLUSH)
    rest = packer.compress(records[1]) + packer.flush()
    path = tmp_path / "one.warc.gz"
    path.write_bytes(first + rest[: int(len(rest) * keep)] if keep < 1 else first + rest)
    return f"file://{path}"


@pytest.mark.parametrize(("keep", "records", "said"), [(0.0, 2, "ends early"), (0.0, 1, "ends early"), (0.97, 2, "ends"), (1, 3, "3 were written"), (1, 1, "1 were written")])
def test_unfinished_archives_are_errors(spark, tmp_path, keep, records, said):
    archives = spark.createDataFrame([(gzip_cut(tmp_path, keep), records)], "archive string, records long")
    with pytest.raises(Exception, match=said):
        warc.normalise(archives)


def test_whole_and_missing_archives(spark, tmp_path):
    path = gzip_cut(tmp_path, 1)
    members = warc.normalise(spark.createDataFrame([(path, 2)], "archive string, records long"))
    assert members.first()["records"] == 2
    with pytest.raises(Exception, match="were written"):
        warc.read_records(members.withColumn("records", members["records"] + 1), False).collect()
    with pytest.raises(Exception, match="(?i)not found|no such file|cannot open|failed to open"):
        warc.normalise(spark.createDataFrame([(path + "-gone", 2)], "archive string, records long"))
