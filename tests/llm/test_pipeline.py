"""The pipeline, stage by stage, against what brute force keeps."""

import collections

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, written and read again as the check does."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(folder / name))
        out.append((name, docs, docs := spark.read.parquet(str(folder / name))))
    return out


def ids(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(kept, spark):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [n for n, *_ in kept] == ["quality", "exact_dedup", "near_dedup", "secrets", "pack"]
    assert all(after.columns == columns for _, _, after in kept[:-1])


def test_quality_rejects_bad_ones(kept):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    _, before, after = kept[0]
    left = ids(after)
    right = [(i in left) == bool(labels[i]) for i in ids(before) if i in labels]
    assert sum(right) / len(right) > 0.95


def test_exact_copies_go(kept):
    _, before, after = kept[1]
    last = {}
    for i, t in ids(before).items():
        last[t] = max(i, last.get(t, i))
    assert set(ids(after)) == set(last.values())


def test_near_copies_go(kept):
    _, before, after = kept[2]
    texts = ids(before)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, t in texts.items() if (w := t.encode().lower().split())}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    for a, b in {(a, b) for same in at.values() for a in same for b in same if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert set(ids(after)) == {i for i in texts if top(i) == i}


def test_secrets_go(kept):
    _, before, after = kept[3]
    clean = ids(after)
    for i, t in ids(before).items():
        assert clean[i] == secrets.masked(t, "[SECRET]") and not [s for s in secrets.find_spans(clean[i]) if s[0] in ("access", "hex")]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_everything_is_packed(kept):
    _, before, after = kept[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in ids(before).items()}
    got = collections.Counter()
    fill = collections.Counter()
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert dict(got) == want and max(fill.values()) <= 4096


def test_run_gives_the_same_rows(kept, spark):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, FOLDER).select(columns).collect()) == sorted(kept[4][2].select(columns).collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
