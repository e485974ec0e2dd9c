"""The Merkle manifest against a plain tree built with hashlib."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import merkle

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("hash", T.IntegerType()), T.StructField("n", T.StringType()), T.StructField("rank", T.LongType())])
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(tree, i, fan):
    for level in tree[:-1]:
        a = i // fan * fan
        yield "".join(level[a:i]), "".join(level[i + 1 : a + fan])
        i //= fan


def plain(rows, fan):
    """(doc_id, leaf, subroot, root, siblings) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])], fan) for s in order}
    top = levels([trees[s][-1][0] for s in order], fan)
    out = []
    for k, s in enumerate(order):
        for i, x in enumerate(sorted(groups[s])):
            way = [*siblings(trees[s], i, fan), *siblings(top, k, fan)]
            out.append((x[3], x[2], trees[s][-1][0], top[-1][0], tuple(way)))
    return out


def made(spark, rows, fan, height):
    df = spark.createDataFrame([(*r, "k", 1, "n", 5) for r in rows], ROW).repartition(3)
    got = merkle.manifest(df, COLUMNS, fan=fan, height=height).collect()
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["levels"] if x)) for r in got]


def by_all(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("fan", "height", "sizes"), [(16, 2, (1, 16, 17, 40)), (2, 2, (1, 2, 3, 4, 5, 21)), (3, 1, (1, 9, 10, 28))])
def test_trees_of_many_sizes(spark, fan, height, sizes):
    rng = random.Random(3)
    rows = []
    for s, n in enumerate(sizes):
        rows += [(rng.randrange(10**6), f"s{s}é" if s % 2 else f"S{s}", "de", i, "Grüße " * (i % 3)) for i in range(n)]
    assert by_all(made(spark, rows, fan, height)) == by_all(plain(rows, fan))


def test_nulls_equal_ids_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, "", "x", 3, "a:b"), (1, "", "x", 3, "a:b"), (1, "", "y", None, "-"), (2, "=", None, 1, "x" * 100_000)]
    rows += [(7, "hot", "en", 1, "same")] * 40
    got = made(spark, rows, 2, 2)
    want = plain(rows, 2)
    assert by_all(got) == by_all(want)
    assert len(got) == len(rows)


def test_single_row_and_empty_table(spark):
    row = (5, "only", "en", 2, "hi")
    assert made(spark, [row], 16, 2) == [(5, leaf(row), leaf(row), leaf(row), ())]
    assert made(spark, [], 16, 2) == []


def test_claims_fold_to_the_root_only_if_untouched(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Text" if i % 2 else "text") for i in range(50)]
    df = spark.createDataFrame([(*r, "k", 1, "n", 5) for r in rows], ROW)
    proofs = merkle.manifest(df, COLUMNS, claimed={"text": F.lower("text")}, fan=4)
    got = proofs.select("doc_id", "root", merkle.fold(F.col("claimed_leaf"), F.col("levels")).alias("folded"), merkle.proof_digest(F.col("levels")).alias("proof")).collect()
    assert {r["doc_id"] for r in got if r["folded"] == r["root"]} == {i for i in range(0, 50, 2)}
    proof = {d: sha("".join(a + b for a, b in way)) for d, _, _, _, way in plain(rows, 4)}
    assert {r["doc_id"]: r["proof"] for r in got} == proof
