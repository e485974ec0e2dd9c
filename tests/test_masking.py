"""Known values: folding, keys, both strategies, tokens, and the way back."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import folding, identifiers
from textloom.operators import shapes, values
from textloom.plans import masking

SECRET = "k" * 70

STORE = [
    ("smiths", "sponsor", "first_name", "Große"),
    ("smiths", "sponsor", "ssn", "482-11-9037"),
    ("smiths", "spouse", "ssn", "482119037"),
    ("smiths", "sponsor", "phone", "(555) 012-3456"),
    ("smiths", None, "deers_family_id", "20240001"),
    ("smiths", "sponsor", "address.street", "12345 Kilimanjaro Way"),
    ("smiths", "sponsor", "address.zip", "12345"),
    ("smiths", "sponsor", "last_name", "O'Brien"),
    ("smiths", "sponsor", "floor", "12"),
    ("smiths", "sponsor", "city", "Fairview"),
    ("jones", "kid", "first_name", "Grosse"),
    ("jones", "kid", "city", " Fairview "),
    ("jones", "kid", "tag", "#hash!"),
    ("jones", "kid", "nick", "Ix-fin"),
]

TEXTS = {
    1: "SSN 482 11 9037, again 482.11.9037 but not 1482-11-9037 nor 482-11-90371",
    2: "GROSSE or Große or große met O’BRIEN; OBrien stayed",
    3: "at 12345 kilimanjaro  way, zip 12345",
    4: "Fairview fairview Fairviewer",
    5: "Fairview and " + "(555)" + chr(0xA0) + "012-3456",
    6: "\U0001f600 Fair" + chr(0xAD) + "view",
    7: "@@@(smiths.sponsor.ssn) and @@@(smiths.20240001) and ###{482.11.9037 across 2 families #0123456789abcdef}",
    8: "###{city across 2 families incl. jones #0123456789abcdef} 20240001",
    9: "nothing here",
    10: None,
    11: "tags #hash! and x#hash! and #hash!y; Ix" + chr(0x2010) + chr(0xFB01) + "n",
    12: "id" + "".join(chr(0xFF10 + int(d)) for d in "20240001") + "_x",
}


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(STORE, "family STRING, member STRING, path STRING, value STRING")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sorted(TEXTS.items()), "doc_id BIGINT, text STRING")


def masked(docs, store, **kw):
    return {r["doc_id"]: r["text"] for r in masking.mask_known(docs, store, SECRET, **kw).collect()}


def fid(key):
    return hmac.new(SECRET.encode(), key.encode(), hashlib.sha256).hexdigest()[:16]


def test_masking(docs, store):
    got = masked(docs, store)
    ssn = "###{sponsor.ssn, spouse.ssn in smiths}"
    city = "###{city across 2 families%s #" + fid("t:fairview") + "}"
    assert got[1] == f"SSN {ssn}, again {ssn} but not 1482-11-9037 nor 482-11-90371"
    assert got[2] == "@@@(jones.kid.first_name) or @@@(smiths.sponsor.first_name) or @@@(smiths.sponsor.first_name) met @@@(smiths.sponsor.last_name); OBrien stayed"
    assert got[3] == "at @@@(smiths.sponsor.address.street), zip @@@(smiths.sponsor.address.zip)"
    assert got[4] == f"{city % ''} {city % ''} Fairviewer"
    assert got[5] == f"{city % ' incl. smiths'} and (@@@(smiths.sponsor.phone)"
    assert got[6] == "\U0001f600 " + city % ""
    assert got[7] == "@@@(smiths.sponsor.ssn) and @@@(smiths.@@@(smiths.deers_family_id)) and ###{" + ssn + " across 2 families #0123456789abcdef}"
    assert got[8] == TEXTS[8].replace("20240001", "@@@(smiths.deers_family_id)")
    assert got[9] == TEXTS[9] and got[10] is None
    assert got[11] == "tags @@@(jones.kid.tag) and x@@@(jones.kid.tag) and @@@(jones.kid.tag)y; @@@(jones.kid.nick)"
    assert got[12] == "id@@@(smiths.deers_family_id)_x"


def test_both_strategies_agree(docs, store):
    assert masked(docs, store, small_store=0) == masked(docs, store)


def test_masking_is_idempotent(docs, store):
    once = masking.mask_known(docs, store, SECRET)
    assert masked(once, store) == masked(docs, store)


def test_values_do_not_survive(spark, store):
    random.seed(5)
    words = [v[3].strip() for v in STORE if v[3] != "12"] + ["x", "12", "-", " ", "\n", "é", "Way", "482"]
    data = [(i, " ".join(random.choice(words) for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    fast = masked(df, store)
    assert fast == masked(df, store, small_store=0)
    assert not any(w in t for t in fast.values() for w in ("O'Brien", "482-11-9037", "20240001", "Große"))


def test_unmask(spark, store):
    data = {
        1: "to @@@(smiths.sponsor.phone), @@@(SMITHS.deers_family_id), @@@(other.x.y)",
        2: "bad @@@(smiths.sponsor.shoe)",
        3: "see ###{a, b in smiths}",
        4: "css ####{color: red}",
        5: "dup @@@(smiths.sponsor.zip)",
        6: "none",
    }
    more = spark.createDataFrame([("smiths", "sponsor", "zip", "1"), ("smiths", None, "sponsor.zip", "2")], store.schema)
    df = spark.createDataFrame(sorted(data.items()), "doc_id BIGINT, text STRING")
    good, bad = masking.unmask_known(df, store.union(more))
    assert {r["doc_id"]: r["text"] for r in good.collect()} == {
        1: "to (555) 012-3456, 20240001, @@@(other.x.y)", 4: data[4], 6: data[6],
    }
    assert {r["doc_id"]: r["problem"] for r in bad.collect()} == {2: "unresolved", 3: "read-only descriptor", 5: "ambiguous"}


def test_round_trip(spark, store):
    df = spark.createDataFrame([(1, "Call (555) 012-3456 for O'Brien, family 20240001.")], "doc_id BIGINT, text STRING")
    back, errors = masking.unmask_known(masking.mask_known(df, store, SECRET), store)
    assert errors.count() == 0
    assert back.first()["text"] == "Call ((555) 012-3456 for O'Brien, family 20240001."


def test_candidates_match_brute_force(spark, store):
    """Against a plain search for every value at every place of the folded text."""
    random.seed(9)
    alphabet = ["Fair", "view", "#hash!", " ", "Ix-fin", "1", "12345", "-", "_", "é", chr(0xAD), "\n", "Große", "20240001"]
    data = [(i, "".join(random.choice(alphabet) for _ in range(9))) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["start"], r["end"]) for r in masking.dictionary_candidates(df, store, SECRET).collect()}
    want = set()
    texts = {folding.fold(v[3].strip())[0] for v in STORE if not v[3].replace("-", "").strip().isdigit() and "555" not in v[3]}
    numbers = {"482119037", "5550123456", "20240001", "12345"}
    for i, t in data:
        norm, starts, ends = folding.fold(t)
        for k in texts:
            for p in range(len(norm)):
                if norm.startswith(k, p):
                    s, e = starts[p], ends[p + len(k) - 1]
                    left = folding.is_word(k[0]) and s > 0 and folding.is_word(t[s - 1])
                    right = folding.is_word(k[-1]) and e < len(t) and folding.is_word(t[e])
                    if not left and not right:
                        want.add((i, s, e))
        for groups in folding.number_segments(t):
            digits = [(pos + j, d) for pos, part in groups for j, d in enumerate(part)]
            for k in numbers:
                for p in range(len(digits)):
                    if "".join(d for _, d in digits[p:p + len(k)]) == k:
                        s, e = digits[p][0], digits[p + len(k) - 1][0] + 1
                        if not (s > 0 and t[s - 1].isdigit()) and not (e < len(t) and t[e].isdigit()):
                            want.add((i, s, e))
    assert got == want


def test_tiers_and_ids(store):
    tiers = {r["norm_key"]: (r["tier"], r["n_paths"], r["n_families"]) for r in values.value_tier(store).collect()}
    assert tiers["n:482119037"] == (2, 2, 1)
    assert tiers["t:fairview"] == (3, 2, 2)
    assert tiers["t:große"] == (1, 1, 1) and tiers["t:grosse"] == (1, 1, 1)
    assert not any(k.endswith(":12") for k in tiers)
    ids = values.build_value_index(store).select("norm_key", identifiers.pii_id(F.col("norm_key"), SECRET).alias("id"))
    assert all(r["id"] == fid(r["norm_key"]) for r in ids.collect())


def test_expand(spark, store):
    ids = spark.createDataFrame([("#" + fid("t:fairview"),), ("0" * 16,), ("zz",)], "id STRING")
    got = {(r["id"], r["status"], r["path"]) for r in values.expand_descriptor(ids, store, SECRET).collect()}
    f = fid("t:fairview")
    assert got == {(f, "ok", "jones.kid.city"), (f, "ok", "smiths.sponsor.city"), ("0" * 16, "unknown", None), ("", "invalid", None)}


def test_value_problems(spark):
    df = spark.createDataFrame([("1/2",), ("J.",), ("Green",), ("",), ("Okonkwo",), ("12345",)], "value STRING")
    words = spark.createDataFrame([("green",)], "word STRING")
    got = {r["value"]: r["problem"] for r in values.reject_common(df, words).collect()}
    assert got == {"1/2": "too few digits", "J.": "too few letters", "Green": "common word", "": None, "Okonkwo": None, "12345": None}


SHAPED = {
    "123-45-6789 and 123 45 6789": ["ssn", "ssn"],
    "999123456789999": [],
    "id 1234567890": ["edi"],
    "192.168.1.100 2026-07-25 19": [],
    "404 Error": ["address"],
    "3 items": [],
    "123 Main": ["address"],
    "mail a.b@x.org": ["email"],
    "12345@x.org": ["email"],
    "http://h:54321/?ssn=123456789": ["ssn"],
    '<p class="12345" id="54321" value="11111">': ["zip", "zip"],
    "\U0001f600 12345": ["zip"],
    "⟦wall:0123456789012345⟧": [],
    "": [],
}


def test_shapes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SHAPED)], "doc_id BIGINT, text STRING")
    for r in shapes.detect_pii_shapes(df).collect():
        assert [m["shape"] for m in r["matches"]] == SHAPED[r["text"]], r["text"]
        assert all(r["text"][m["start"]:m["end"]] == m["value"] for m in r["matches"])
    low = shapes.detect_pii_shapes(df.where("text = '3 items'"), any_case=True).first()["matches"]
    assert [m["value"] for m in low] == ["3 items"]


def test_policy(spark):
    docs = spark.createDataFrame([(1, "p", "a 12345 b 99999"), (2, "q", "a 12345 z@x.org"), (3, "q", "plain"), (4, "q", None)], "doc_id BIGINT, source STRING, text STRING")
    rules = spark.createDataFrame([("*", "12345", "mask"), ("p", "12345", "allow"), ("q", "z@xorg", "allow")], "source STRING, norm_value STRING, decision STRING")
    rows = {r["doc_id"]: r for r in shapes.mask_by_policy(docs, rules, SECRET).collect()}
    token = "⟦wall:" + fid("12345") + "⟧"
    assert (rows[1]["released"], rows[1]["pending"], rows[1]["masked"]) == (False, 1, 1)
    assert (rows[2]["released"], rows[2]["text"]) == (True, f"a {token} z@x.org")
    assert (rows[3]["released"], rows[3]["text"]) == (True, "plain")
    assert rows[4]["released"]
    everything = {r["doc_id"]: r["text"] for r in shapes.mask_all(docs, rules, SECRET).collect()}
    assert everything[1] == f"a {token} b ⟦wall:{fid('99999')}⟧"
    vault = shapes.token_vault(shapes.match_rows(docs, ["doc_id"]), SECRET)
    back = shapes.vault_resolve(spark.createDataFrame(list(everything.items()), "doc_id BIGINT, text STRING"), vault, "doc_id")
    assert {r["doc_id"]: r["text"] for r in back.collect()}[1] == "a 12345 b 99999"


def test_raw_text_decides(spark):
    docs = spark.createDataFrame([(1, "p", "t 12345 t 55555", "t 12345 t")], "doc_id BIGINT, source STRING, text STRING, raw STRING")
    rules = spark.createDataFrame([("*", "12345", "allow")], "source STRING, norm_value STRING, decision STRING")
    row = shapes.mask_by_policy(docs, rules, SECRET, raw="raw").first()
    assert (row["allowed"], row["pending"], row["released"]) == (1, 0, True)


def test_secret_is_not_in_the_plan(spark, store):
    plan = spark.range(1).select(identifiers.pii_id(F.lit("a"), SECRET))._jdf.queryExecution().toString()
    assert bytes(b ^ 0x36 for b in hashlib.sha256(SECRET.encode()).digest()).hex().upper() not in plan.upper()


def test_candidates_are_filtered_before_they_leave_the_scan(spark, store):
    """The filter and the texts hash alike: every key passes, hardly anything else does."""
    import xxhash

    keys = [f"tkey {i} é漢" for i in range(300)] + ["n12345", "t"]
    bits = masking.key_filter(spark.createDataFrame([(k,) for k in keys], "match_key STRING"))
    at = lambda k: xxhash.xxh64_intdigest(k.encode(), 42) & (masking.FILTER_BITS - 1)
    hit = lambda k: bits[at(k) >> 3] >> (at(k) & 7) & 1
    assert all(map(hit, keys)) and sum(hit(f"tother {i}") for i in range(20000)) < 5


ODD = [(None, "a", "zip 12345 here"), (None, "a", "zip 54321 there"), (7, "a", "aa 54321"), (7, "a", "bb 12345 cc 12345"), (8, "a", "tel 99999"), (9, "a", None), (9, "b", "plain"), (None, None, "id 11111")]


@pytest.mark.parametrize("small", [100, 0])
def test_policy_with_shared_and_missing_keys(spark, small):
    """A text is withheld or masked by what it holds, whatever its key; a word that is no decision releases nothing."""
    df = spark.createDataFrame(ODD, "doc_id BIGINT, source STRING, text STRING")
    told = [("*", "12345", "mask"), ("*", "54321", "allow"), ("a", "99999", "Mask"), ("*", "11111", None), (None, "11111", "allow")]
    decisions = spark.createDataFrame(told, "source STRING, norm_value STRING, decision STRING")
    got = {}
    for r in shapes.mask_by_policy(df, decisions, "key", small_decisions=small).collect():
        got[r["doc_id"], r["text"] and r["text"][:2], r["source"], r["released"]] = (r["text"], r["masked"], r["allowed"], r["pending"])
    assert len(got) == 8 - 1  # two rows with NULL ids begin alike
    assert got[7, "aa", "a", True] == ("aa 54321", 0, 1, 0)
    assert got[7, "bb", "a", True][1:] == (2, 0, 0) and "12345" not in got[7, "bb", "a", True][0]
    assert got[8, "te", "a", False] == ("tel 99999", 0, 0, 1)
    assert got[9, None, "a", True] == (None, 0, 0, 0) and got[None, "id", None, False][3] == 1
    rows = shapes.mask_all(df, decisions, "key").collect()
    assert all(r["released"] for r in rows) and not any(v in (r["text"] or "") for r in rows for v in ("12345", "99999", "11111"))


@pytest.mark.parametrize("small", [100, 0])
def test_known_values_with_shared_and_missing_keys(spark, small):
    store = spark.createDataFrame([("f", "m", "name", "Adebayo"), ("f", "m", "city", "Lagos")], "family STRING, member STRING, path STRING, value STRING")
    texts = ["see Adebayo now", "Adebayo", "in Lagos", None, "nothing", "see Adebayo now"]
    df = spark.createDataFrame([(None if i % 2 else 1, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    got = [r["text"] for r in masking.mask_known(df, store, "key", small_store=small).collect()]
    name, city = "@@@(f.m.name)", "@@@(f.m.city)"
    assert sorted(map(str, got)) == sorted([f"see {name} now", name, f"in {city}", "None", "nothing", f"see {name} now"])
    notes = spark.createDataFrame([(None, f"to {name}"), (None, "bad @@@(f.m.shoe)"), (None, "plain"), (1, f"to {name}"), (1, "###{city across 3 families #0123456789abcdef}")], "doc_id BIGINT, text STRING")
    good, bad = masking.unmask_known(notes, store)
    assert sorted((str(r["doc_id"]), r["text"]) for r in good.collect()) == [("1", "to Adebayo"), ("None", "plain"), ("None", "to Adebayo")]
    assert sorted((str(r["doc_id"]), r["problem"]) for r in bad.collect()) == [("1", "read-only descriptor"), ("None", "unresolved")]


def test_digits_of_a_token_are_no_shape(spark):
    """Five digits inside the id of a shared value must neither hold the text back nor be masked."""
    people = [(f"f{i}", "m", "city", f"Town{n}x") for n in range(60) for i in range(2)]
    store = spark.createDataFrame(people, "family STRING, member STRING, path STRING, value STRING")
    df = spark.createDataFrame([(n, "s", f"from Town{n}x") for n in range(60)], "doc_id BIGINT, source STRING, text STRING")
    none = spark.createDataFrame([], "source STRING, norm_value STRING, decision STRING")
    rows = masking.mask_documents(df, store, none, "key").collect()
    assert len(rows) == 60 and all(r["released"] and r["text"].startswith("from ###{city across 2 families") for r in rows)


def test_queries_over_whole_texts(spark, tmp_path):
    """Every match, tag and word, and the whole prose, beside the queries that look at the first ones only."""
    from textloom.plans import identifiers_queries, tasks_queries, text_queries

    long = "say " * 50 + "<b> end"
    spark.createDataFrame([(1, "ab 1 x\n22 y 333"), (2, "none"), (3, "Gr\u00fc\u00dfe")], "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, '<html lang="de"><a href="x"><p><a href="y">')], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = lambda q: sorted(tuple(r) for r in q(spark, str(tmp_path)).collect())
    assert rows(text_queries.match_context_all) == [(1, 1, 1, "ab 1 x"), (1, 2, 2, "22 y 333"), (1, 3, 2, "22 y 333")]
    assert rows(text_queries.extract_attributes_all) == [(1, 1, "", "de"), (1, 2, "x", ""), (1, 3, "", ""), (1, 4, "y", "")]
    assert {v for v, _ in identifiers_queries.value_problems_all(spark, str(tmp_path)).collect()} >= {"ab", "1", "y", "333", "none"}
    assert rows(tasks_queries.split_prose_and_commands_whole)[0][2] == "Look: " + long.replace("<", " ")
    assert [r[3] for r in rows(tasks_queries.extract_tool_calls_whole)] == ["read", "write", "next-task"]
    assert {r["doc_id"] for r in text_queries.normalize_all_text(spark, str(tmp_path)).collect()} == {1, 2, 3}
