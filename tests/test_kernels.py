"""Small helpers and columns against plain models."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import folding, text as tx, web
from textloom.functions.registry import register_all
from textloom.operators import corpus, logs, tasks


def model_diff(old, new):
    a, b = old.split("\n"), new.split("\n")
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if x == y else max(dp[i - 1][j], dp[i][j - 1])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("same", a[i]))
        elif i and (not j or dp[i - 1][j] >= dp[i][j - 1]):
            i -= 1
            out.append(("del", a[i]))
        else:
            j -= 1
            out.append(("add", b[j]))
    return out[::-1]


lines = st.lists(st.sampled_from("abc"), max_size=12).map("\n".join)


@settings(max_examples=300, deadline=None)
@given(lines, lines)
def test_line_ops(old, new):
    assert corpus.line_ops(old, new) == model_diff(old, new)


def test_unified():
    old = "\n".join("abcdefghijkl")
    new = old.replace("b", "B").replace("k\n", "")
    assert corpus.unified(old, new) == (
        "--- file\n+++ file\n@@ -1,4 +1,4 @@\n a\n+B\n-b\n c\n d\n@@ -9,4 +9,3 @@\n i\n j\n-k\n l"
    )
    assert corpus.unified("a\nb\nc\nd\ne", "A\nb\nc\nd\ne").endswith("+A\n-a\n b\n c\n d\n e")
    assert corpus.unified("x", "x") == "--- file\n+++ file"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n-" + chr(0x301) + chr(0xAD) + "ßé" + chr(0xFB01) + chr(0x2019) + "１_", max_size=12))
def test_fold_spans(text):
    norm, starts, ends = folding.fold(text)
    assert len(norm) == len(starts) == len(ends)
    assert list(starts) == sorted(starts) and all(s < e <= len(text) for s, e in zip(starts, ends))
    assert folding.fold(norm)[0] in (norm, norm.strip()) or chr(0x301) in text


def test_number_segments():
    seg = lambda t: ["".join(d for _, d in g) for g in folding.number_segments(t)]
    assert seg("call 482 on gate 11") == ["482", "11"]
    assert seg("482 - 11 | 90") == ["4821190"]
    assert seg("1" + " " * 7 + "2") == ["1", "2"]
    assert seg("４８２-11") == ["48211"]


def test_tool_calls():
    text = (
        'Hi <remote-workspace><read path=" a.js " offset="05" limit="x"/><list-tasks parent="T-1"/>'
        '<write path="b">body </write><edit path="c"><find >x</find><replace>y\n</replace></edit><INFO path="d"></remote-workspace><list/>'
    )
    got = [(c["verb"], c["kind"], c["args"]) for c in tasks.parse_calls(text)]
    assert got == [
        ("read", "tool", {"path": "a.js", "offset": "5", "limit": "x"}),
        ("list-tasks", "task-op", {"parent": "T-1"}),
        ("write", "tool", {"path": "b", "content": "body "}),
        ("edit", "tool", {"path": "c", "find": "x", "replace": "y\n"}),
        ("info", "tool", {"path": "d"}),
    ]
    assert tasks.parse_calls("<workspace-result><list/>") == [] == tasks.parse_calls(None)


def outline(spark, html, **kw):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [r["line"] for r in corpus.page_outline(pages, ["page_id"], **kw).orderBy("n").collect()]


def test_outline(spark):
    html = (
        '<head><title>t</title></head><body><h1>Head  line</h1><div hidden><a href="x">no</a><p>no</p></div>'
        '<ul><li><a href="y">Go <b>on</b></a></li></ul><input type="checkbox" name="n" checked disabled><p>text</p><script>var a="</p>";</script></body>'
    )
    assert outline(spark, html) == ['H1 "Head line"', '[e1] link "Go on"', '[e2] checkbox "n" (disabled,checked)', '"text"']
    assert outline(spark, "<b>" * 5000 + "<p>deep</p>") == ['"deep"']
    assert outline(spark, "") == outline(spark, None) == outline(spark, "no markup, 1 < 2") == []


def test_outline_nesting_and_names(spark):
    html = (
        "<!-- <a>no</a> --><div role=button title='a > b'>A &amp; <span>B</span><a href=x>in&#110;er&#x21; &copy;&nosuch; &#xD800; & 1&lt;</a><p>leaf<p>next</div>"
        '<div><div role="tab" aria-expanded="true" style="color:red"></div></div><label>L<input type=text placeholder="P"><br/></label></div>'
        '<p style="display: none">no</p><select name=s><option>one<option>two</select><span>a<b>c</b></span><h2>  </h2><A HREF=z>Up</A><button>open'
    )
    assert outline(spark, html) == [
        '[e1] button "A & Binner! ©&nosuch; &#xD800; & 1<leafnext"', '  "B"', '  [e2] link "inner! ©&nosuch; &#xD800; & 1<"', '  "leaf"', '  "next"', '[e3] tab "" (expanded=true)', '[e4] label "L"',
        '  [e5] text "P"', '[e6] combobox "s"', '  [e7] option "one"', '  [e8] option "two"', '[e9] link "Up"', '[e10] button "open"',
    ]


def test_outlines_are_whole_unless_a_limit_is_given(spark, tmp_path):
    from textloom.plans import corpus_queries

    html = '<p>x</p>' * 900 + '<a href="y">late</a>' + '<a href="z">last</a>'
    pages = spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None), (None, "<p>y</p>"), (None, "<p>z</p>")], "page_id long, html string")
    size = lambda limit: {r["page_id"]: r["count"] for r in corpus.page_outline(pages, ["page_id"], limit=limit).groupBy("page_id").count().collect()}
    assert size(None) == {1: 902, 2: 1, None: 2} and size(900) == {1: 901, 2: 1, None: 2}
    assert outline(spark, html, limit=10) == ['"x"'] * 10 + [corpus.MORE_LINES]
    assert outline(spark, "<p>x</p>" * 10, limit=10) == ['"x"'] * 10
    assert [r["n"] for r in corpus.find_in_outline(pages, ["page_id"], "link").orderBy("n").collect()] == [900, 901]
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in corpus_queries.outline_links(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_long_differences_in_little_memory():
    """20,000 lines a side, all changed but some; memory stays far below a bit for every pair of lines."""
    import random
    import tracemalloc

    rng = random.Random(5)
    old = [f"line {i}" for i in range(20_000)]
    new = [s if rng.random() < 0.5 else s + "!" for s in old if rng.random() < 0.9]
    tracemalloc.start()
    ops = corpus.line_ops("\n".join(old), "\n".join(new))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [s for op, s in ops if op != "add"] == old and [s for op, s in ops if op != "del"] == new
    assert sum(op == "same" for op, _ in ops) == len(set(old) & set(new))
    assert peak < 25_000_000


def test_globs(spark):
    cases = {
        "src/**/*.mjs": (["src/a.mjs", "src/x/y/b.mjs"], ["lib/a.mjs", "src/a.js"]),
        "*.{md,t.t}": (["a.md", "b.t.t"], ["x/a.md", "b.tat"]),
        "a?c+(x)": (["abc+(x)"], ["a/c+(x)"]),
        "{open": (["{open"], ["open"]),
    }
    for glob, (yes, no) in cases.items():
        df = spark.createDataFrame([(p,) for p in yes + no], "path STRING")
        assert sorted(r[0] for r in corpus.find_paths(df, glob).collect()) == sorted(yes), glob


def test_grep_flags_and_caps(spark):
    df = spark.createDataFrame([("b.txt", "One\ntwo\none"), ("a.txt", "none")], "path STRING, text STRING")
    got = [r["shown"] for r in corpus.grep_corpus(df, "^one", flags="i").collect()]
    assert got == ["b.txt:1:One", "b.txt:3:one"]
    rows = corpus.capped(corpus.grep_corpus(df, "one", limit=None), 1, ["path", "line"]).collect()
    assert [(r["path"], r["truncated"]) for r in rows] == [("a.txt", True)]


def test_context_window(spark):
    line = "x" * 400 + "12345" + "y" * 400
    df = spark.createDataFrame([("a\n" + "b" * 400 + "\n" + line + "\nc",)], "text STRING")
    start = len("a\n" + "b" * 400 + "\n") + 400
    c = df.select(tx.match_context(F.col("text"), F.lit(start), F.lit(start + 5)).alias("c")).first()["c"]
    assert c["line"] == 3 and c["hit"] == "… " + "x" * 160 + "12345" + "y" * 160 + " …"
    assert c["before"] == ["a", "b" * 320 + " …"] and c["after"] == ["c"]


def test_web_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(web.source_key(F.lit("x"), F.lit("HTTPS://H.Test:443/p?ssn=1#a"))) == "browser:x@https://h.test/p"
    assert one(web.source_key(F.lit(None).cast("string"), F.lit("not a url"))) == "browser:?@not a url"
    assert one(web.classify_request(F.lit("https://h/api/v1/chats/new"))) == "new"
    assert one(web.classify_request(F.lit("https://h/pages/api/v1/chats/new"))) == "excluded"
    ids = lambda *names: F.lit("".join(f'<i id="{n}">' for n in names))
    assert one(web.html_change_summary(ids("a"), ids("a"))) == "no tag-count change; +ids: (none); -ids: (none)"
    assert one(web.html_change_summary(ids(), ids(*"abcdef"))) == "~+6 tags; +ids: a, b, c, d, e; -ids: (none)"


def test_attributes_and_markers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    got = one(tx.extract_attributes(F.lit('a="1" b = " x " a="02" n="07" ok="true"'), {"n": "integer", "ok": "boolean"}))
    assert got == {"a": "02", "b": "x", "n": "7", "ok": "true"}
    assert one(tx.reload_marker(F.lit("=== reload e: App.java → compile OK, context rebuilt in 1.3s ===")))["seconds"] == 1.3
    assert one(tx.reload_marker(F.lit("hello"))) is None
    assert one(tx.java_trim(F.lit("\x1f\x1e a \x00"))) == "a"
    rows = spark.createDataFrame([("weird",), ("DataSource: Hikari down",)], "raw STRING")
    assert {r["cause"] for r in logs.classify_failure(rows).collect()} == {"unclassified", "datasource-unreachable"}


def test_demotion_borders(spark):
    """A total of exactly 1.10 times the budget stays; one token more goes, oldest first; the current task never goes."""

    def run(extra, low_mark=False):
        size = 13200 // 4
        t = [("p", f"T-{i}", "t", "", None, i, 100 - i if i < 4 else None, 1, None, i, i == 3) for i in range(6)]
        tdf = spark.createDataFrame(t, "project STRING, id STRING, title STRING, goal STRING, parent_id STRING, started BIGINT, ended BIGINT, tier INT, summary STRING, position BIGINT, is_current BOOLEAN")
        m = [("p", f"T-{i}", 0, "tool-result", "user", "x" * 4 * (size + (extra if i == 0 else 0)), "grep") for i in (0, 1, 2, 4)] + [("p", "T-3", 0, "assistant", "assistant", "y" * 9999, None)]
        mdf = spark.createDataFrame(m, "project STRING, task_id STRING, pos INT, kind STRING, role STRING, content STRING, tool_name STRING")
        out, kept = tasks.demote_tiers(tdf, mdf, low_mark)
        return {r["id"]: r["tier"] for r in out.collect()}, {r["task_id"]: r["content"] for r in kept.collect()}

    tiers, _ = run(0)
    assert set(tiers.values()) == {1}
    tiers, kept = run(1)
    assert tiers == {"T-0": 1, "T-1": 1, "T-2": 2, "T-3": 1, "T-4": 1, "T-5": 1}
    assert kept["T-2"] == "[T-2 grep -> 1 lines, masked]"


def test_verdicts(spark):
    runs = spark.createDataFrame([("none", []), ("seq", [1, 1]), ("rare", [1, 1, 1, 1, 2]), ("batch", [1, 1, 2, 1])], "run STRING, batches ARRAY<INT>")
    got = {r["run"]: r["verdict"] for r in tasks.parallelism_verdict(tasks.parallelism_stats(runs, ["run"])).collect()}
    assert got == {"none": "none", "seq": "sequential", "rare": "rare", "batch": "batching"}


def test_registered_functions(spark):
    assert {"regex_spans", "text_spans", "shape_rows", "norm_key"} <= set(register_all(spark))
    rows = spark.sql("""SELECT t.* FROM VALUES ('a <list path="x"/>') v(s), LATERAL extract_tool_calls(s) t""").collect()
    assert [(r["verb"], r["args"]) for r in rows] == [("list", {"path": "x"})]
    assert spark.sql("SELECT fold_key('Straße')").first()[0] == "strasse"
    assert [tuple(r) for r in spark.sql("SELECT * FROM regex_spans('a1b22', '[0-9]+')").collect()] == [(1, 2, "1"), (3, 5, "22")]


def test_sql_functions_give_what_the_builders_give(spark):
    """Texts with marks, nulls, signs of other widths; JVM patterns; calls beside rows of a table."""
    from textloom.functions import identifiers, text

    register_all(spark)
    rows = [(1, "a1 b22\n" * 4 + "zip 12345, a@b.org, 5 Main"), (2, None), (3, ""), (4, "x" * 500 + " 77 " + "y" * 500), (5, f"{chr(0xFFFF)}9{chr(0xFFFE)} 123-45-6789"), (6, '<a class="c" href="https://h:8443/x">⟦wall:0123456789abcdef⟧ 12 Ä')]
    df = spark.createDataFrame(rows, "id INT, t STRING")
    df.createOrReplaceTempView("sql_texts")
    out = lambda d: sorted(map(str, d.collect()))
    sql = lambda q: out(spark.sql(f"SELECT id, {q} AS x FROM sql_texts"))
    built = lambda c: out(df.select("id", c.alias("x")))
    t = F.col("t")
    assert sql("clip(t, 9)") == built(text.clip(t, 9)) and sql("clip(t)") == built(text.clip(t))
    assert sql("estimate_tokens(t)") == built(text.estimate_tokens(t))
    assert sql("slice_lines(t, 2, 2)") == built(corpus.slice_lines(t, 2, 2))
    assert sql("decision_value(t)") == built(identifiers.decision_value(t))
    assert sql("scan_surface(t)") == built(identifiers.scan_surface(t))
    assert sql("text_spans(t, '[0-9]+(?=[^0-9]|$)')") == built(F.coalesce(text.regex_spans(F.coalesce(t, F.lit("")), "[0-9]+(?=[^0-9]|$)")))
    assert sql("shape_matches(t)") == built(identifiers.shape_matches(F.coalesce(t, F.lit(""))))
    spans = df.select("id", "t", F.explode(text.regex_spans(t, "[0-9]+")).alias("s"))
    want = spans.select("id", "s.start", "s.end", "s.value", text.match_context(t, F.col("s.start"), F.col("s.end"), 1).alias("x"))
    got = spark.sql("SELECT d.id, s.*, match_context(d.t, s.start, s.end, 1) AS x FROM sql_texts d, LATERAL regex_spans(d.t, '[0-9]+') s")
    assert out(got) == out(want) and len(out(want)) > 10
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
