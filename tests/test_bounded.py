"""Memory of Python functions that follows a part of a batch, not the batch."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.operators import corpus


def test_normalized_texts_leave_in_parts():
    texts = ["Ab  c\t" * 5000, None, "", "É x" * 9000] * 60
    out = list(folding.normalize_text.func(iter([pa.array(texts)])))
    assert len(out) > 3 and max(o.field("starts").flatten().nbytes for o in out) < 16 * folding.PART_CHARS
    rows = [r for o in out for r in o.to_pylist()]
    assert [r["norm"] for r in rows] == [folding.fold(t or "")[0] for t in texts]
    assert rows[0]["starts"][:5] == [0, 1, 2, 4, 5] and rows[0]["ends"][:5] == [1, 2, 4, 5, 6]


def test_ascii_texts_fold_as_others_do():
    rnd = random.Random(7)
    for n in range(400):
        text = "".join(rnd.choice("aB'-1 \t\n\r\x0b\x0c\x1c\x00\x7f") for _ in range(n % 40))
        # The character in front takes the text past the short path.
        norm, starts, ends = folding.fold("é" + text)
        got = folding.fold(text)
        assert (got[0], list(got[1]), list(got[2])) == (norm[1:], [s - 1 for s in starts[1:]], [e - 1 for e in ends[1:]])


def test_line_differences_leave_in_parts():
    old = ["\n".join(f"line {i}" for i in range(20_000))] * 12 + [None]
    new = [t and t.replace("line 7", "row 7") for t in old]
    out = list(corpus.line_changes.func(iter([(pa.array(old), pa.array(new))])))
    assert len(out) > 3 and sum(len(o) for o in out) == 13
    rows = [r for o in out for r in o.to_pylist()]
    assert [[(c["op"], c["line"]) for c in r] for r in rows[-2:]] == [corpus.line_ops(old[0], new[0]), corpus.line_ops(None, None)]


def test_a_frequent_value_is_dealt_to_several_tasks(spark):
    """Matches of one value, decided for all: several tasks join them."""
    from pyspark.sql import functions as F

    from textloom.operators import shapes

    matches = spark.range(4000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit("54321").alias("norm_value"))
    decided = spark.createDataFrame([("*", "54321", "allow"), ("s", "54321", "mask")], "source STRING, norm_value STRING, decision STRING")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    kept = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "-1")):
            spark.conf.set(n, v)
        rows = shapes.apply_decisions(matches, decided).select("decision", F.spark_partition_id().alias("p")).groupBy("decision", "p").count().collect()
    finally:
        for n, v in zip(names, kept):
            spark.conf.set(n, v)
    assert {r["decision"] for r in rows} == {"allow"} and len(rows) > 2 and sum(r["count"] for r in rows) == 4000


def test_many_decisions_stay_off_the_driver(spark, monkeypatch):
    """Decisions are broadcast by their number, not by what Spark takes their size to be."""
    from textloom.operators import shapes

    matches = spark.range(4000).selectExpr("if(id % 2 = 0, 's', 't') AS source", "id AS doc_id", "cast(id % 500 AS STRING) AS norm_value")
    made = spark.range(300).selectExpr("if(id < 200, '*', 's') AS source", "cast(id AS STRING) AS norm_value", "if(id % 3 = 0, 'allow', 'mask') AS decision")
    decided = made.union(spark.createDataFrame([("s", "0", "mask"), ("*", None, "mask"), ("t", "450", "what")], "source STRING, norm_value STRING, decision STRING"))
    word = lambda r: ("allow" if int(r[1]) % 3 == 0 else "mask") if int(r[1]) < (300 if r[0] == "s" else 200) else "pending"
    for few in (0, 150, 1000):
        monkeypatch.setattr(shapes, "FEW_DECISIONS", few, raising=False)
        out = shapes.apply_decisions(matches, decided)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")) == {0: (0, 2), 150: (1, 1), 1000: (2, 0)}[few]
        rows = out.collect()
        assert len(rows) == 4000 and all(r["decision"] == word((r["source"], r["norm_value"])) for r in rows)


def test_counts_of_decided_matches_stay_off_the_driver(spark, tmp_path):
    """The query broadcasts a few decisions about single sources, not the many that grow with the orders."""
    from textloom.plans import identifiers_queries

    spark.range(12_000).selectExpr("id o_orderkey", "id DIV 3 o_custkey", "if(id % 4 = 0, '1-URGENT', '5-LOW') o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(4000).selectExpr("id c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    out = identifiers_queries.mask_counts(spark, str(tmp_path))
    counts = {r["source"]: (r["masked"], r["allowed"], r["pending"]) for r in out.collect()}
    assert "SortMergeJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("BroadcastHashJoin") <= 2  # the plan and what it was at first
    assert {s: sum(n) for s, n in counts.items()} == {"1-URGENT": 15_000, "5-LOW": 45_000}
    assert counts["5-LOW"][0] > 18_000 and counts["5-LOW"][1] >= 18_000 and counts["5-LOW"][2] > counts["1-URGENT"][2] * 3


def test_lookups_of_tokens_stay_off_the_driver(spark):
    from textloom.operators import shapes

    texts = spark.createDataFrame([(1, "a ⟦wall:0123456789abcdef⟧ b"), (2, None), (None, "plain")], "doc_id BIGINT, text STRING")
    vault = spark.createDataFrame([("x", "⟦wall:0123456789abcdef⟧")], "value STRING, token STRING")
    out = shapes.vault_resolve(texts, vault, "doc_id")
    assert sorted(r["text"] or "" for r in out.collect()) == ["", "a x b", "plain"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_meet_their_values_in_one_shuffle(spark, monkeypatch):
    """Buckets ask for each of their tokens once; no key made of the text travels with every token."""
    from textloom.operators import shapes

    monkeypatch.setattr(shapes, "ROWS_PER_TASK", 50, raising=False)
    monkeypatch.setattr(shapes, "ASKED", 30, raising=False)
    token = lambda n: f"⟦wall:{n:016x}⟧"
    text = lambda n: f"{token(n)} é {token(n % 7)}, {token(5000 + n)} {token(n)}. ⟦wall:x⟧" if n % 10 else ("plain", None)[n % 20 // 10]
    rows = [(n % 5 or None, text(n), {"n": str(n)}) for n in [*range(300), *[3] * 200]]
    vault = [(f"v\\1${n}", token(n)) for n in range(300)] + [("z", token(3)), (None, token(5001))]
    texts = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, more MAP<STRING, STRING>")
    out = shapes.vault_resolve(texts, spark.createDataFrame(vault, "value STRING, token STRING"), "doc_id")
    assert "sha2(" not in out._jdf.queryExecution().optimizedPlan().toString() and out.columns == texts.columns
    back = lambda t, n: t and t.replace(token(n), f"v\\1${n}").replace(token(n % 7), f"v\\1${n % 7}")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out.collect())) == sorted(key((k, back(t, int(m["n"])), m)) for k, t, m in rows)


def test_a_store_stays_off_the_driver(spark):
    from textloom.operators import values

    rows = [("f1", "a", "name", "Alice"), ("f1", "b", "name", "Alice"), ("f2", "c", "name", "Bobby"), ("f3", "d", "name", "Bobby")]
    out = values.dictionary(spark.createDataFrame(rows, "family STRING, member STRING, path STRING, value STRING"), "k")
    assert {(r["match_key"], r["tier"]) for r in out.collect()} == {("alice", 2), ("bobby", 3)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_windows_of_large_store_searched_once(spark):
    """Masking reads the spans it found from what it wrote; it does not search the texts again for each field of the spans."""
    from textloom.plans import masking

    store = spark.createDataFrame([("f1", "a", "name", "Anna Smith"), ("f1", "a", "city", "Springfield"), ("f2", "b", "city", "Springfield")], "family string, member string, path string, value string")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Anna Smith of Springfield "), "id").alias("text"))
    out = masking.mask_known(docs, store, "k", small_store=0)
    assert "windows(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r["text"] for r in out.collect()]
    assert len(got) == 40 and all(t.startswith("@@@(f1.a.name) of ###{city across 2 families incl. f1 #") for t in got)


def test_spans_of_large_store_are_dealt_once(spark, monkeypatch):
    """What is found in a text travels with a short key, and once."""
    import re

    from textloom.plans import masking

    kept, write = {}, masking.written
    monkeypatch.setattr(masking, "written", lambda df, label: kept.setdefault(label, write(kept.setdefault(label + " made", df), label)))
    store = [("f1", "a", "name", "Anna Smith"), ("f1", "b", "nick", "Anna Smith"), ("f1", "a", "phone", "555-0101"), ("f1", "a", "city", "Springfield"), ("f2", "b", "city", "SPRINGFIELD")]
    texts = ["Anna Smith of Springfield, tel 5550101", "springfield", None, "", "nothing", "###{city across 2 families #0123456789abcdef} Springfield", "Anna Smith of Springfield, tel 5550101"]
    docs = spark.createDataFrame([(n % 3 or None, t) for n, t in enumerate(texts)], "doc_id LONG, text STRING")
    values = spark.createDataFrame(store, "family STRING, member STRING, path STRING, value STRING")
    both = [sorted(map(str, masking.mask_known(docs, values, "k", small_store=n).collect())) for n in (0, 1000)]
    assert both[0] == both[1] and sum("###{a.name, b.nick in f1} of ###{city across 2 families incl. f1 #" in r for r in both[0]) == 2
    chosen = kept["chosen"]
    assert dict(chosen.dtypes)["_row"] == "binary" and {len(r["_row"]) for r in chosen.collect()} == {16}
    assert not re.search(r"hashpartitioning\(_row#\d+, start", kept["chosen made"]._jdf.queryExecution().executedPlan().toString())
    assert {(s["tier"], s["key"]) for r in chosen.collect() for s in r["_found"]} == {(1, None), (2, None), (3, "t:springfield")}


def test_store_is_read_by_all_cores(spark, tmp_path):
    from textloom.plans import identifiers_queries

    spark.range(60_000).selectExpr("id c_custkey", "'c' || id c_name", "cast(id % 25 as int) c_nationkey", "'s' c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(25).selectExpr("id n_nationkey").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    rows = identifiers_queries.store(spark, str(tmp_path))
    assert rows.count() == 7 * 60_000 + 25 and rows.rdd.getNumPartitions() >= 9


def test_outline_tasks_do_not_grow_with_the_pages(spark, monkeypatch):
    """Each task takes apart a bounded amount of markup; adaptive execution does not join tasks for their few bytes in the shuffle."""
    monkeypatch.setattr(corpus, "MARKUP_BYTES", 512)
    pages = spark.range(64).select("id", F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 248), F.lit("</p>")).alias("html"))
    out = corpus.page_outline(pages, ["id"])
    assert out.rdd.getNumPartitions() >= 31 and out.count() == 64
    assert corpus.page_outline(pages.where("false"), ["id"]).count() == 0


def test_common_words_are_folded_after_they_are_counted(spark):
    """Only the words that are common go through Python, not every word of every text."""
    from textloom.operators import values

    texts = spark.range(3000).selectExpr("concat('The w', id) AS text")
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").count().where("count > 100").select("word")
    out = values.reject_common(spark.createDataFrame([("the",), ("w1",), (None,)], "value string"), words)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for n, line in enumerate(plan) if "nfc_lower" in line and any("Generate explode" in below for below in plan[n:n + 3])]
    assert {r["value"]: r["problem"] for r in out.collect()} == {"the": "common word", "w1": None, None: None}
    assert plan and sum("nfc_lower" in line for line in plan) == 2


def test_tasks_of_the_validator_do_not_grow_with_the_store(spark, monkeypatch):
    """Index, tiers and tokens are dealt by their number of rows, whatever the session's number of shuffle partitions."""
    from textloom import session
    from textloom.operators import values
    from textloom.plans import masking

    monkeypatch.setattr(session, "ROWS_PER_SHARE", 100)
    store = spark.range(1500).selectExpr("'f' || id % 5 AS family", "'m' || id AS member", "'name' AS path", "'Person ' || id AS value")
    tokens = store.selectExpr("concat('@@@(', family, '.', member, '.name)') AS token")
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    kept = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "2")):
            spark.conf.set(n, v)
        index = values.fixed_index(store)
        tiers = values.tiered_index(index)
        genuine = masking.token_validator(tokens.unionByName(tokens.selectExpr("concat(token, 'x') AS token")), store, index, tiers)
        for df in (index, tiers, genuine):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 1500 and len(sizes) >= 10 and max(sizes) < 300
    finally:
        for n, v in zip(names, kept):
            spark.conf.set(n, v)


def test_tiers_of_values_in_many_families(spark):
    """Families of one value are counted in several tasks; fields, counts and slots are those of all of them."""
    from textloom.operators import values

    rows = [(f"f{k}", "a", "nick" if k % 7 else "name", "Common") for k in range(200)] + [("f3", "b", "name", "Common"), ("f3", "b", "city", "Common")]
    rows += [("f1", "a", "name", "Twice"), ("f1", "b", "nick", "TWICE"), ("f1", "b", "nick", "twice"), ("f2", "c", "name", "Once"), ("f2", None, "zone", "Famous")]
    got = values.tiered_index(spark.createDataFrame(rows, "family STRING, member STRING, path STRING, value STRING")).collect()
    assert {r["norm_key"]: (r["n_paths"], r["n_families"], r["tier"], r["fields"], sorted(r["slots"])) for r in got} == {
        "t:common": (202, 200, 3, ["city", "name", "nick"], ["a.name"]),
        "t:twice": (2, 1, 2, ["name", "nick"], ["a.name", "b.nick"]),
        "t:once": (1, 1, 1, ["name"], ["c.name"]),
        "t:famous": (1, 1, 1, ["zone"], ["zone"]),
    }
