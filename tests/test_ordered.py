"""Sliced scans give what one window over the whole group gives, also when one group holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import events
from textloom.operators.ordered import last_rows, ordered_scan, slices


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    data = []
    for i in range(3000):
        session = "hot" if random.random() < 0.7 else random.choice(["a", "b", None])
        t = random.choice([random.randint(0, 10_000), random.randint(4000, 4040)])
        data.append((session, t, i, random.choice([None, 1, 2, 3]), random.choice("xy")))
    return spark.createDataFrame(data, "session STRING, t BIGINT, event_id BIGINT, v BIGINT, verb STRING").cache()


def scan(df, cut):
    out = ordered_scan(
        df, ["session"], ["t", "event_id"], cut, sums={"total": F.col("v"), "n": F.lit(1)}, lasts={"seen": F.col("v")}, previous={"before": F.col("v")}
    )
    return sorted(map(tuple, out.select("event_id", "total", "n", "seen", "before").collect()))


def test_sliced_scan_equals_window(rows):
    cut = slices(rows, ["session"], ["t", "event_id"], 50)
    assert cut is not None
    sizes = rows.groupBy("session", cut.alias("s")).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 120 and sizes[1] > 40
    assert scan(rows, cut) == scan(rows, None)


def test_slices_follow_the_order(rows):
    place = ["session", "t", "event_id"]
    placed = rows.select(*place, slices(rows, place[:1], place[1:], 50).alias("s")).orderBy(*place).collect()
    assert all(a["s"] <= b["s"] for a, b in zip(placed, placed[1:]))


def test_equal_and_null_positions_spread(spark):
    """One session with all its rows at one time, or at none: the slices are as even as any."""
    for t in (5, None):
        df = spark.createDataFrame([("hot", t, i, i % 3) for i in range(3000)] + [(None, t, i, 1) for i in range(300)], "session STRING, t BIGINT, event_id BIGINT, v BIGINT")
        cut = slices(df, ["session"], ["t", "event_id"], 100)
        sizes = [r["count"] for r in df.groupBy("session", cut.alias("s")).count().collect()]
        assert max(sizes) <= 250 and len(sizes) >= 30
        run = lambda c: sorted(map(str, ordered_scan(df, ["session"], ["t", "event_id"], c, sums={"n": F.col("v")}, previous={"p": F.col("event_id")}).collect()))
        assert run(cut) == run(None)


def test_snapshots_carry_facts_not_pages(spark):
    df = spark.createDataFrame([("a", i, f'<p id="x{i % 3}">{"<b>" * (i % 4)}') for i in range(300)], "session STRING, page_id BIGINT, html STRING")
    out = lambda n: events.snapshot_diffs(df, ["page_id"], n).select("page_id", "summary")
    assert sorted(map(tuple, out(20).collect())) == sorted(map(tuple, out(10**6).collect()))
    plan = out(10**6)._jdf.queryExecution().executedPlan().toString()
    window = plan[: plan.index("Exchange")]
    assert "html" not in window.replace("_facts", "")


def test_small_tables_need_no_slices(rows):
    assert slices(rows, ["session"], ["t"]) is None


def test_last_rows(rows):
    got = last_rows(rows, ["session"], ["t", "event_id"], 7).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["t"], r["event_id"])):
        want.setdefault(r["session"], []).append(r["event_id"])
    assert sorted(r["event_id"] for r in got) == sorted(i for ids in want.values() for i in ids[-7:])


def test_loops_and_settling_do_not_depend_on_slices(rows):
    calls = rows.withColumn("args", F.lit("{}"))
    loops = lambda n: sorted(map(tuple, events.detect_loops(calls, rows_per_slice=n).select("event_id", "repeat", "looped").collect()))
    assert loops(40) == loops(10**6)
    kinds = rows.withColumn("kind", F.when(F.col("v") == 1, "request").when(F.col("v") == 2, "response").otherwise("dom"))
    settle = lambda n: sorted(map(str, events.settle_windows(kinds, 20, 500, rows_per_slice=n).collect()))
    assert settle(40) == settle(10**6)


def test_loop_flags(spark):
    data = [("s", i, i, v, "{}") for i, v in enumerate("aaaabaaac")]
    df = spark.createDataFrame(data, "session STRING, t BIGINT, event_id BIGINT, verb STRING, args STRING")
    got = [r["repeat"] for r in events.detect_loops(df).orderBy("t").collect()]
    assert got == [1, 2, 3, 4, 1, 1, 2, 3, 1]


def test_lifecycle_edges(spark):
    e = lambda i, rid, kind, status=None, err=None: ("s", i, i, rid, kind, f"u{i}", "GET", status, "text/html", 5, err)
    data = [
        e(1, "redirected", "sent"), e(2, "redirected", "sent"), e(3, "redirected", "response", 200), e(4, "redirected", "finished"),
        e(5, "broken", "sent"), e(6, "broken", "failed", err="net"),
        e(7, "missing", "sent"), e(8, "missing", "response", 404),
        e(9, "early", "response", 200), e(10, "early", "sent"),
        e(11, "unknown", "finished"),
    ]
    df = spark.createDataFrame(data, "session STRING, t BIGINT, event_id BIGINT, request_id STRING, event STRING, url STRING, method STRING, status INT, mime STRING, size BIGINT, error STRING")
    got = {r["request_id"]: r for r in events.request_lifecycle(df).collect()}
    assert set(got) == {"redirected", "broken", "missing", "early"}
    assert (got["redirected"]["redirects"], got["redirected"]["url"], got["redirected"]["ms"]) == (1, "u2", 3)
    assert (got["broken"]["failed"], got["broken"]["status"], got["broken"]["done"]) == ("net", None, 6)
    assert (got["missing"]["status"], got["missing"]["done"]) == (404, None)
    assert got["early"]["status"] is None
    failed = events.filter_network(events.request_lifecycle(df), failed_only=True).collect()
    assert {r["request_id"] for r in failed} == {"broken", "missing"}


def test_attribution_with_equal_times(spark):
    changes = spark.createDataFrame([("s", 5, 1), ("s", 4, 2), ("r", 9, 3)], "session STRING, t BIGINT, event_id BIGINT")
    actions = spark.createDataFrame([("s", 5, 1, "click")], "session STRING, t BIGINT, event_id BIGINT, action STRING")
    got = {r["event_id"]: r["cause"] for r in events.attribute_changes(changes, actions).collect()}
    assert got == {1: "click", 2: None, 3: None}


def test_read_since_gives_every_row_once(spark):
    df = spark.range(1, 51).withColumnRenamed("id", "seq")
    first, cursor = events.read_since(df.where("seq <= 20"), 0)
    second, _ = events.read_since(df, cursor.first()[0])
    assert sorted(r[0] for r in first.union(second).collect()) == list(range(1, 51))


def test_links_are_compared_with_the_page_before_over_gaps(spark, tmp_path, monkeypatch):
    from textloom.plans import text_queries

    pages = [(1, 'href="a"'), (5, 'href="a" href="b"'), (6, 'href="c"'), (90, "none")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = [(1, "a", ""), (5, "b", ""), (6, "c", "a,b"), (90, "", "c")]
    for n in (10_000, 2):
        monkeypatch.setattr(text_queries, "PAGES_PER_SLICE", n)
        assert sorted(tuple(r) for r in text_queries.id_set_changes_of_links(spark, str(tmp_path)).collect()) == want
