"""Queries that find, mask and restore personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import registry
from textloom.functions import identifiers as ids
from textloom.functions.text import js_trim
from textloom.functions.web import source_key
from textloom.operators import shapes, values
from textloom.plans import masking
from textloom.plans.catalog import query
from textloom.plans.inputs import load
from textloom.session import cut_lineage, once, shares, spread

# The key of the queries. A real one comes from a file or from the session, never from code.
SECRET = "a key for checks"

_PAD = SECRET.encode().ljust(64, b"\0")
_IPAD = "".join(f"\\x{b ^ 0x36:02X}" for b in _PAD)
_OPAD = "".join(f"\\x{b ^ 0x5C:02X}" for b in _PAD)


def hmac_sql(message: str) -> str:
    return f"substr(sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode({message})))), 1, 16)"


def documents(spark, folder):
    return spread(load(spark, folder, "SELECT doc_id, source, text FROM $documents"))


# Without look-around: one alternation takes whole runs from the left, and run lengths decide afterwards.
_SURFACE = "regexp_replace(regexp_replace(text, '(?i)\\s(class|style|placeholder)\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', ' ', 'g'), '(?i)(https?://[^\\s/:?#]+):[0-9]{1,5}', '\\1: ', 'g')"
_FOUND = f"""
    SELECT doc_id, source, v, CASE WHEN contains(v, '@') THEN 'email' WHEN regexp_matches(v, '^[0-9]{{1,5}}[ \\t]+\\p{{Lu}}') THEN 'address'
               WHEN regexp_matches(v, '^[0-9]{{3}}[-‐-― ][0-9]{{2}}[-‐-― ][0-9]{{4}}$') OR length(v) = 9 THEN 'ssn'
               WHEN length(v) = 10 THEN 'edi' WHEN length(v) = 5 THEN 'zip' END AS shape
    FROM (SELECT doc_id, source, unnest(regexp_extract_all({_SURFACE},
          '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}|[0-9]{{1,5}}[ \\t]+\\p{{Lu}}[\\p{{L}}''’.-]*|[0-9]{{3}}[-‐-― ][0-9]{{2}}[-‐-― ][0-9]{{4,}}|[0-9]+')) AS v FROM {{0}}) x
"""
_NORM = "regexp_replace(lower(v), '[\\s.‐-―-]', '', 'g')"


def found_sql(table: str) -> str:
    return f"SELECT doc_id, source, v, shape, {_NORM} AS norm FROM ({_FOUND.replace("{0}", table)}) f WHERE shape IS NOT NULL"


@query(f"SELECT source, shape, count(*) AS matches, count(DISTINCT norm) AS distinct_values FROM ({found_sql('$documents')}) m GROUP BY ALL")
def pii_shape_report(spark, folder):
    return shapes.pii_shape_report(documents(spark, folder))


@query(f"SELECT doc_id, shape, v AS value, norm AS norm_value FROM ({found_sql('$documents')}) m")
def detect_pii_shapes(spark, folder):
    return shapes.match_rows(documents(spark, folder), ["doc_id"]).select("doc_id", "shape", "value", "norm_value")


# Forms: every order as a short page text with numbers of all shapes.
_PAGE = """'Id ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '1') || '-' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0')
    || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || '; zip: ' || lpad(CAST(o_custkey % 700 + 10000 AS STRING), 5, '0') || '; mail u' || CAST(o_custkey % 300 AS STRING)
    || '@mail.test; <b class="12345" id="54321">at</b> ' || CAST(o_custkey % 97 AS STRING) || ' Oak.St; http://h.test:' || CAST(o_custkey % 700 + 10000 AS STRING) || '/x'"""
_FORMS = f"SELECT o_orderkey AS doc_id, o_orderpriority AS source, {_PAGE} AS text FROM $orders"


def forms(spark, folder):
    """What the texts are made of is dealt out, not the texts."""
    orders = spread(load(spark, folder, "SELECT o_orderkey AS doc_id, o_orderpriority AS source, o_orderkey, o_custkey FROM $orders"))
    return once(orders, "text", F.expr(_PAGE)).select("doc_id", "source", "text")


@query(f"SELECT source, shape, count(*) AS matches, count(DISTINCT norm) AS distinct_values FROM ({found_sql('(' + _FORMS + ')')}) m GROUP BY ALL")
def pii_shape_report_of_forms(spark, folder):
    return shapes.pii_shape_report(forms(spark, folder))


_DECISIONS = """SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '1-URGENT' END AS source, CAST(c_custkey % 700 + 10000 AS STRING) AS norm_value,
    CASE WHEN c_custkey % 3 = 0 THEN 'allow' ELSE 'mask' END AS decision FROM $customer WHERE c_custkey % 7 > 0
    UNION ALL SELECT '*', '54321', 'allow' UNION ALL SELECT DISTINCT '*', 'u' || CAST(c_custkey % 300 AS STRING) || '@mailtest', 'mask' FROM $customer
    UNION ALL SELECT DISTINCT '*', CAST(c_custkey % 97 AS STRING) || 'oakst', 'allow' FROM $customer
    UNION ALL SELECT DISTINCT '*', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '1') || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), 'mask' FROM $orders"""
_DECIDED = f"""SELECT m.*, coalesce(g.decision, l.decision, 'pending') AS decision FROM ({found_sql('(' + _FORMS + ')')}) m
    LEFT JOIN (SELECT norm_value, max(decision) AS decision FROM ({_DECISIONS}) d WHERE source = '*' GROUP BY ALL) g ON g.norm_value = m.norm
    LEFT JOIN (SELECT source, norm_value, max(decision) AS decision FROM ({_DECISIONS}) d WHERE source <> '*' GROUP BY ALL) l ON l.norm_value = m.norm AND l.source = m.source"""


def decisions(spark, folder):
    return load(spark, folder, _DECISIONS)


def decided(spark, folder):
    return shapes.apply_decisions(shapes.match_rows(forms(spark, folder), ["doc_id", "source"]), decisions(spark, folder))


@query(f"SELECT doc_id, shape, v AS value, decision FROM ({_DECIDED}) d")
def apply_decisions(spark, folder):
    return decided(spark, folder).select("doc_id", "shape", "value", "decision")


@query(f"""SELECT source, count(*) FILTER (decision = 'mask') AS masked, count(*) FILTER (decision = 'allow') AS allowed,
           count(*) FILTER (decision = 'pending') AS pending FROM ({_DECIDED}) d GROUP BY source""")
def mask_counts(spark, folder):
    return shapes.mask_counts(decided(spark, folder), ["source"])


@query(f"SELECT doc_id, norm AS norm_value, min(shape) AS shape FROM ({found_sql('(' + _FORMS + ')')}) d GROUP BY doc_id, norm")
def distinct_matches(spark, folder):
    rows = shapes.distinct_matches(shapes.match_rows(forms(spark, folder), ["doc_id", "source"]), ["doc_id", "source"])
    return rows.select("doc_id", "norm_value", "shape")


_TOKEN = f"'⟦wall:' || {hmac_sql('v')} || '⟧'"


def _policy_sql(default: str) -> str:
    word = f"CASE WHEN decision = 'pending' THEN '{default}' ELSE decision END"
    return f"""
    WITH d AS (SELECT doc_id, v, shape, {word} AS decision FROM ({_DECIDED}) q),
    r AS (SELECT doc_id, shape || CASE WHEN v = '54321' THEN 'id' ELSE '' END AS shape, CASE WHEN decision = 'mask' THEN {_TOKEN} ELSE v END AS n, decision FROM d),
    p AS (SELECT doc_id, max(n) FILTER (shape = 'ssn') AS ssn, max(n) FILTER (shape = 'zip') AS zip, max(n) FILTER (shape = 'email') AS mail, max(n) FILTER (shape = 'address') AS addr,
          count(*) FILTER (decision = 'mask') AS masked, count(*) FILTER (decision = 'allow') AS allowed, count(*) FILTER (decision = 'pending') AS pending FROM r GROUP BY doc_id)
    SELECT p.doc_id, 'Id ' || ssn || '; zip: ' || zip || '; mail ' || mail || '; <b class="12345" id="54321">at</b> ' || addr
           || '; http://h.test:' || (o_custkey % 700 + 10000) || '/x' AS text, masked, allowed, pending, CAST(pending = 0 AS INT) AS released
    FROM p JOIN $orders o ON o.o_orderkey = p.doc_id"""


@query(_policy_sql("pending"))
def mask_by_policy(spark, folder):
    rows = shapes.mask_by_policy(forms(spark, folder), decisions(spark, folder), SECRET)
    return rows.select("doc_id", "text", "masked", "allowed", "pending", F.col("released").cast("int").alias("released"))


@query(_policy_sql("pending"))
def mask_by_policy_joined(spark, folder):
    """The same with the strategy for many decisions."""
    rows = shapes.mask_by_policy(forms(spark, folder), decisions(spark, folder), SECRET, small_decisions=0)
    return rows.select("doc_id", "text", "masked", "allowed", "pending", F.col("released").cast("int").alias("released"))


def shared_keys(df):
    """Rows whose key is NULL or shared by many; the true id goes along as ``own``."""
    return df.withColumn("own", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7))


@query(_policy_sql("pending"))
def mask_by_policy_shared_keys(spark, folder):
    rows = shapes.mask_by_policy(shared_keys(forms(spark, folder)), decisions(spark, folder), SECRET, small_decisions=0)
    return rows.select(F.col("own").alias("doc_id"), "text", "masked", "allowed", "pending", F.col("released").cast("int").alias("released"))


@query(f"SELECT doc_id, text, pending FROM ({_policy_sql('pending')}) x WHERE released = 0")
def quarantine(spark, folder):
    rows = shapes.mask_by_policy(forms(spark, folder), decisions(spark, folder), SECRET)
    return shapes.split_quarantine(rows)[1].select("doc_id", "text", "pending")


@query(f"SELECT doc_id, text, pending FROM ({_policy_sql('pending')}) x WHERE released = 1")
def released(spark, folder):
    rows = shapes.mask_by_policy(forms(spark, folder), decisions(spark, folder), SECRET)
    return shapes.split_quarantine(rows)[0].select("doc_id", "text", "pending")


@query(f"SELECT doc_id, text, pending FROM ({_policy_sql('mask')}) x")
def mask_all(spark, folder):
    return shapes.mask_all(forms(spark, folder), decisions(spark, folder), SECRET).select("doc_id", "text", "pending")


@query(f"SELECT doc_id, count(*) AS masked FROM ({found_sql('$documents')}) m GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM $documents WHERE doc_id NOT IN (SELECT doc_id FROM ({found_sql('$documents')}) n)")
def mask_documents_counts(spark, folder):
    return shapes.mask_all(documents(spark, folder), decisions(spark, folder).where("false"), SECRET).select("doc_id", "masked")


@query()
def mask_documents(spark, folder):
    """Every shape in the documents masked; the rows keep their ids."""
    none = decisions(spark, folder).where("false")
    return shapes.mask_all(documents(spark, folder), none, SECRET).select("doc_id", "text", "masked")


@query(f"SELECT v AS value, {_TOKEN} AS token, count(*) AS uses FROM ({found_sql('(' + _FORMS + ')')}) m GROUP BY v")
def token_vault(spark, folder):
    return shapes.token_vault(shapes.match_rows(forms(spark, folder), ["doc_id"]), SECRET)


@query(f"SELECT doc_id, text FROM ({_FORMS}) f")
def vault_resolve(spark, folder):
    rows = forms(spark, folder)
    vault = shapes.token_vault(shapes.match_rows(rows, ["doc_id"]), SECRET)
    masked = shapes.mask_all(rows, decisions(spark, folder).where("false"), SECRET).select("doc_id", "text")
    return shapes.vault_resolve(masked, vault, "doc_id", rows=load(spark, folder, "SELECT o_orderkey FROM $orders").count())


@query("""SELECT page_id, len(regexp_extract_all(html, 'class="[^"]*"')) AS blanked, length(html) AS size FROM $pages""")
def scan_surface(spark, folder):
    rows = load(spark, folder, "SELECT page_id, html FROM $pages").withColumn("s", ids.scan_surface(F.col("html")))
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit('class="[^"]*"'), F.lit(0)))
    return rows.select("page_id", (count("html") - count("s")).alias("blanked"), F.length("s").alias("size"))


@query("SELECT doc_id, regexp_replace(lower(text), '[\\s.‐-―-]', '', 'g') AS norm FROM $documents")
def decision_values(spark, folder):
    return documents(spark, folder).select("doc_id", ids.decision_value(F.col("text")).alias("norm"))


# ── known values ──────────────────────────────────────────────────────────────

_KEYED = """SELECT family, member, path, trim(value) AS v, CASE WHEN regexp_matches(trim(value), '^[0-9 .()-]+$') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 5
    THEN 'n:' || regexp_replace(value, '[^0-9]', '', 'g') ELSE 't:' || lower(trim(value)) END AS norm_key FROM $store"""
_INDEX = f"SELECT DISTINCT norm_key, concat_ws('.', family, member, path) AS path, family, concat_ws('.', member, path) AS slot FROM ({_KEYED}) k WHERE NOT regexp_matches(v, '^[0-9]{{1,4}}$') AND length(norm_key) >= 4"
_TIERS = f"""SELECT norm_key, count(*) AS n_paths, count(DISTINCT family) AS n_families,
    CASE WHEN count(*) = 1 THEN 1 WHEN count(DISTINCT family) = 1 THEN 2 ELSE 3 END AS tier FROM ({_INDEX}) i GROUP BY norm_key"""


def letters(spark, folder):
    return spread(load(spark, folder, "letters"))


def store(spark, folder):
    return spread(load(spark, folder, "store"))


@query(f"SELECT family, member, path, norm_key FROM ({_KEYED}) k")
def norm_key(spark, folder):
    return store(spark, folder).select("family", "member", "path", ids.norm_key(js_trim(F.col("value"))).alias("norm_key"))


@query(f"SELECT norm_key, path FROM ({_INDEX}) i")
def build_value_index(spark, folder):
    return values.build_value_index(store(spark, folder)).select("norm_key", "path")


@query(_TIERS)
def value_tier(spark, folder):
    return values.value_tier(store(spark, folder))


@query("SELECT DISTINCT family, CASE WHEN member IS NULL THEN 'field' ELSE 'member' END AS kind, coalesce(member, path) AS name FROM $store")
def store_catalog(spark, folder):
    return values.store_catalog(store(spark, folder))


_FIELDS = ("name", "phone", "dob", "address.city", "nick", "alias")


@query(f"""SELECT r.family, r.member, f.path, CASE WHEN s.path IS NOT NULL THEN 'filled' ELSE 'blank' END AS status
           FROM (SELECT DISTINCT family, member FROM $store WHERE member IS NOT NULL) r CROSS JOIN (SELECT unnest({list(_FIELDS)}) AS path) f
           LEFT JOIN $store s ON s.family = r.family AND s.member = r.member AND s.path = f.path
           UNION ALL SELECT family, member, path, 'extra' FROM $store WHERE member IS NOT NULL AND path NOT IN {_FIELDS}""")
def field_status(spark, folder):
    rows = store(spark, folder).where("member is not null")
    return values.field_status(rows.select("family", "member"), rows, _FIELDS)


_COMMON = """SELECT word FROM (SELECT unnest(list_distinct(string_split(lower(text), ' '))) AS word, doc_id FROM $documents) w GROUP BY word HAVING count(*) > (SELECT count(*) / 4 FROM $documents)"""


@query(f"""SELECT value, CASE WHEN trim(value) = '' THEN NULL WHEN regexp_matches(trim(value), '^[0-9]+$') THEN CASE WHEN length(trim(value)) < 5 THEN 'too few digits' END
           WHEN length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 2 THEN 'too few letters' WHEN lower(trim(value)) IN ({_COMMON}) THEN 'common word' END AS problem
           FROM (SELECT DISTINCT string_split(text, ' ')[1] AS value FROM $documents
                 WHERE NOT regexp_matches(string_split(text, ' ')[1], '[^A-Za-z0-9]')) v""")
def value_problems(spark, folder):
    docs = documents(spark, folder)
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    quarter = docs.agg(F.count("*") / 4).scalar()
    common = words.where(F.col("n") > quarter).select("word")
    tried = docs.select(F.split("text", " ", -1)[0].alias("value")).where("NOT value rlike '[^A-Za-z0-9]'").distinct()
    return values.reject_common(tried, common)


@query(f"""SELECT value, CASE WHEN trim(value) = '' THEN NULL WHEN regexp_matches(trim(value), '^[0-9]+$') THEN CASE WHEN length(trim(value)) < 5 THEN 'too few digits' END
           WHEN length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 2 THEN 'too few letters' WHEN lower(trim(value)) IN ({_COMMON}) THEN 'common word' END AS problem
           FROM (SELECT DISTINCT value FROM (SELECT unnest(string_split(text, ' ')) AS value FROM $documents) w WHERE NOT regexp_matches(value, '[^A-Za-z0-9]')) v""")
def value_problems_all(spark, folder):
    """Every word of every document."""
    docs = documents(spark, folder)
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    quarter = docs.agg(F.count("*") / 4).scalar()
    common = words.where(F.col("n") > quarter).select("word")
    tried = docs.select(F.explode(F.array_distinct(F.split("text", " ", -1))).alias("value")).where("NOT value rlike '[^A-Za-z0-9]'").distinct()
    return values.reject_common(tried, common)


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9]+([ .-]{1,6}[0-9]+)*'), lambda x: length(x) > 0)) AS runs FROM (SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z .-]', 'x', 'g') AS text FROM $documents) d""")
def number_segments(spark, folder):
    docs = documents(spark, folder).withColumn("text", F.regexp_replace("text", "[^0-9A-Za-z .-]", "x"))
    return docs.select("doc_id", F.size(ids.number_segments(F.col("text"))).alias("runs"))


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+([ .-]{1,6}[0-9]+)*'), lambda x: length(x) || ':' || regexp_replace(x, '[^0-9]', '', 'g')), ',') AS runs
          FROM (SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z .-]', 'x', 'g') AS text FROM $documents) d""")
def number_segment_digits(spark, folder):
    """The digits of every run, and how long it is with its separators."""
    docs = documents(spark, folder).withColumn("text", F.regexp_replace("text", "[^0-9A-Za-z .-]", "x"))
    one = lambda s: F.concat_ws(":", s["end"] - s["start"], s["digits"])
    return docs.select("doc_id", F.array_join(F.transform(ids.number_segments(F.col("text")), one), ",").alias("runs"))


@query(f"SELECT norm_key, {hmac_sql('norm_key')} AS id FROM (SELECT DISTINCT norm_key FROM ({_INDEX}) i) k")
def pii_id(spark, folder):
    keys = values.build_value_index(store(spark, folder)).select("norm_key").distinct()
    return keys.select("norm_key", ids.pii_id(F.col("norm_key"), SECRET).alias("id"))


@query(f"""SELECT i.id, CASE WHEN k.norm_key IS NULL THEN 'unknown' ELSE 'ok' END AS status, p.path FROM
           (SELECT DISTINCT CASE WHEN norm_key LIKE 't:%' THEN {hmac_sql('norm_key')} ELSE substr(md5(norm_key), 1, 16) END AS id FROM ({_INDEX}) x) i
           LEFT JOIN (SELECT DISTINCT norm_key, {hmac_sql('norm_key')} AS id FROM ({_INDEX}) y) k USING (id)
           LEFT JOIN ({_INDEX}) p ON p.norm_key = k.norm_key""")
def expand_descriptor(spark, folder):
    keys = values.build_value_index(store(spark, folder)).select("norm_key").distinct()
    known = F.col("norm_key").startswith("t:")
    wanted = keys.select(F.when(known, F.concat(F.lit("#"), ids.pii_id(F.col("norm_key"), SECRET))).otherwise(F.substring(F.md5("norm_key"), 1, 16)).alias("id"))
    return values.expand_descriptor(wanted, store(spark, folder), SECRET)


_HOME = "SELECT c_custkey AS k, 'n' || c_nationkey AS f, 'n' || c_nationkey || '.c' || c_custkey AS m FROM $customer"
_CITY = """SELECT c_custkey % 50 AS t, count(DISTINCT c_nationkey) AS n, count(*) AS p, min('n' || c_nationkey) AS f, string_agg('c' || c_custkey || '.address.city', ', ' ORDER BY 'c' || c_custkey || '.address.city') AS slots FROM $customer GROUP BY ALL"""
_MASKED = f"""
    SELECT o_orderkey AS doc_id, 'Order for @@@(' || h.m || '.name), tel (@@@(' || h.m || '.phone), ' || CASE WHEN c.p = 1 THEN '@@@(' || h.m || '.address.city)'
           WHEN c.n = 1 THEN '###{{' || c.slots || ' in ' || c.f || '}}'
           ELSE '###{{address.city across ' || c.n || ' families incl. ' || h.f || ' #' || {hmac_sql("'t:town ' || c.t || 'x'")} || '}}' END
           || '; called ###{{c' || h.k || '.alias, c' || h.k || '.nick in ' || h.f || '}} - not nick' || h.k || 'yz.' AS text
    FROM $orders o JOIN ({_HOME}) h ON h.k = o.o_custkey JOIN ({_CITY}) c ON c.t = o.o_custkey % 50"""


@query(_MASKED)
def mask_known(spark, folder):
    return masking.mask_known(letters(spark, folder), store(spark, folder), SECRET).select("doc_id", "text")


@query(_MASKED)
def mask_known_joined(spark, folder):
    """The same with the strategy for large stores."""
    return masking.mask_known(letters(spark, folder), store(spark, folder), SECRET, small_store=0).select("doc_id", "text")


@query(_MASKED)
def mask_known_shared_keys(spark, folder):
    rows = masking.mask_known(shared_keys(letters(spark, folder)), store(spark, folder), SECRET, small_store=0)
    return rows.select(F.col("own").alias("doc_id"), "text")


@query(f"""SELECT doc_id, text || ' zip ' || CASE WHEN doc_id % 3 = 0 THEN '⟦wall:' || {hmac_sql("CAST(doc_id % 90000 + 10000 AS STRING)")} || '⟧' ELSE CAST(doc_id % 90000 + 10000 AS STRING) END AS text,
           CAST(doc_id % 3 = 0 AS BIGINT) AS masked, CAST(doc_id % 3 = 1 AS BIGINT) AS allowed, CAST(doc_id % 3 = 2 AS BIGINT) AS pending FROM ({_MASKED}) m""")
def mask_letters_whole(spark, folder):
    """Known values first, then shapes by decision, as one job."""
    rows = letters(spark, folder).withColumn("zip", (F.col("doc_id") % 90000 + 10000).cast("string"))
    rows = rows.withColumn("text", F.concat("text", F.lit(" zip "), "zip")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    made = rows.select("source", F.col("zip").alias("norm_value"), F.when(F.col("source") == "s0", "mask").when(F.col("source") == "s1", "allow").otherwise("Mask").alias("decision")).distinct()
    out = masking.mask_documents(rows.drop("zip"), store(spark, folder), made, SECRET)
    return out.select("doc_id", "text", "masked", "allowed", "pending")


@query(_MASKED)
def mask_known_twice(spark, folder):
    """Masking what is masked already changes nothing."""
    once = masking.mask_known(letters(spark, folder), store(spark, folder), SECRET)
    return masking.mask_known(once, store(spark, folder), SECRET).select("doc_id", "text")


@query("""SELECT doc_id, norm_key, tier FROM (
            SELECT o_orderkey AS doc_id, 't:customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS norm_key FROM $orders
            UNION ALL SELECT o_orderkey, 'n:555' || lpad(CAST(o_custkey AS STRING), 7, '0') FROM $orders
            UNION ALL SELECT o_orderkey, 't:town ' || (o_custkey % 50) || 'x' FROM $orders
            UNION ALL SELECT o_orderkey, 't:nick' || o_custkey || 'y' FROM $orders) x JOIN (""" + _TIERS + """) t USING (norm_key)""")
def dictionary_candidates(spark, folder):
    return masking.dictionary_candidates(letters(spark, folder), store(spark, folder), SECRET).select("doc_id", "norm_key", "tier")


_NOTES = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 1 THEN 'bad @@@(n' || c_nationkey || '.c' || c_custkey || '.shoe)' WHEN o_orderkey % 10 = 2
    THEN 'see ###{city across 3 families #0123456789abcdef}' WHEN o_orderkey % 10 = 3 THEN 'plain text' ELSE 'To @@@(n' || CAST(c_nationkey AS STRING) || '.c' || CAST(c_custkey AS STRING) || '.name), @@@(zz.c1.name) tel @@@(N'
    || CAST(c_nationkey AS STRING) || '.c' || CAST(c_custkey AS STRING) || '.phone)' END AS text, c_custkey, c_name FROM $orders JOIN $customer ON c_custkey = o_custkey"""


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text ELSE 'To ' || c_name || ', @@@(zz.c1.name) tel 555-' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS text
           FROM ({_NOTES}) n WHERE doc_id % 10 NOT IN (1, 2)""")
def unmask_known(spark, folder):
    notes = load(spark, folder, _NOTES).select("doc_id", "text")
    return masking.unmask_known(notes, store(spark, folder))[0]


@query(f"""SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN substr(text, 5) ELSE substr(text, 5) END AS token, CASE doc_id % 10 WHEN 1 THEN 'unresolved' ELSE 'read-only descriptor' END AS problem
           FROM ({_NOTES}) n WHERE doc_id % 10 IN (1, 2)""")
def unmask_errors(spark, folder):
    notes = load(spark, folder, _NOTES).select("doc_id", "text")
    return masking.unmask_known(notes, store(spark, folder))[1]


@query(f"""SELECT DISTINCT token FROM (SELECT '@@@(' || path || ')' AS token FROM (SELECT concat_ws('.', family, member, path) AS path FROM $store) p
           UNION ALL SELECT '###{{' || fields || ' across ' || n || ' families incl. ' || f || ' #0123456789abcdef}}' FROM (
              SELECT 'address.city' AS fields, c.n, min('n' || c_nationkey) AS f FROM $customer JOIN ({_CITY}) c ON c.t = c_custkey % 50 WHERE c.n > 1 GROUP BY c.t, c.n) s) t""")
def token_validator(spark, folder):
    """Genuine tokens out of genuine and forged ones."""
    rows = store(spark, folder)
    index = values.fixed_index(rows)
    tiers = cut_lineage(values.tiered_index(index))
    path = F.concat_ws(".", "family", "member", "path")
    real = rows.select(F.concat(F.lit("@@@("), path, F.lit(")")).alias("token"))
    forged = rows.select(F.concat(F.lit("@@@("), path, F.lit(".more)")).alias("token"))
    shared = masking.shared_families(index, tiers).where("fields = 'address.city'").groupBy("norm_key", "fields", "n_families").agg(F.min("family").alias("f"))
    form = lambda n, f: F.format_string("###{%s across %d families incl. %s #0123456789abcdef}", "fields", n, f).alias("token")
    tier3 = shared.select(form(F.col("n_families"), F.col("f"))).union(shared.select(form(F.col("n_families") + 100, F.col("f")))).union(shared.select(form(F.col("n_families"), F.lit("nobody"))))
    return masking.token_validator(real.union(forged).union(tier3), rows, index, tiers).repartition(shares(rows), "token").distinct()


@query(f"""SELECT 'browser:orders@' || lower(source) AS key, count(*) AS n FROM ({_FORMS}) f GROUP BY 1""")
def form_source_keys(spark, folder):
    return forms(spark, folder).select(source_key(F.lit("orders"), F.lower("source")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, shape, v AS value FROM ({found_sql('$documents')}) m")
def sql_shape_rows(spark, folder):
    """Shapes through a native table function beside each row."""
    registry.register_all(spark)
    return spark.sql(f"SELECT d.doc_id, s.shape, s.value FROM parquet.`{folder}/documents.parquet` d, LATERAL shape_rows(d.text) s")


@query("""SELECT page_id, len(regexp_extract_all(html, 'class="[^"]*"')) AS blanked, length(html) AS size FROM $pages""")
def sql_scan_surface(spark, folder):
    registry.register_all(spark)
    pages = f"(SELECT page_id, html, scan_surface(html) AS s FROM parquet.`{folder}/pages.parquet`)"
    found = lambda c: f"size(regexp_extract_all({c}, 'class=\"[^\"]*\"', 0))"
    return spark.sql(f"SELECT page_id, {found('html')} - {found('s')} AS blanked, length(s) AS size FROM {pages}")


@query(f"SELECT family, member, path, norm_key FROM ({_KEYED}) k")
def sql_norm_key(spark, folder):
    registry.register_all(spark)
    store(spark, folder).createOrReplaceTempView("textloom_store")
    return spark.sql("SELECT family, member, path, norm_key(trim(value)) AS norm_key FROM textloom_store")
