"""Queries over document collections and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import corpus
from textloom.plans.catalog import query
from textloom.plans.inputs import load
from textloom.session import spread

_LINES = "SELECT path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM $corpus"


@query(f"SELECT path, line, text FROM ({_LINES}) l WHERE regexp_matches(text, '(?i)[a-z]+tion [a-z]+ly')")
def grep_corpus(spark, folder):
    return corpus.grep_corpus(spread(load(spark, folder, "corpus")), "[a-z]+tion [a-z]+ly", flags="i", limit=None).select("path", "line", "text")


_THE = f"SELECT path, line, path || ':' || line || ':' || text AS shown FROM ({_LINES}) l WHERE regexp_matches(path, '^src1[^/]*/.*[.](md|txt)$') AND contains(text, 'the')"


@query(f"SELECT *, CAST((SELECT count(*) FROM ({_THE}) a) > 2000 AS INT) AS truncated FROM ({_THE}) b ORDER BY path, line LIMIT 2000")
def grep_corpus_first(spark, folder):
    hits = corpus.grep_corpus(spread(load(spark, folder, "corpus")), "the", "src1*/**.{md,txt}", limit=2000)
    return hits.select("path", "line", "shown", F.col("truncated").cast("int").alias("truncated"))


@query(f"{_THE} AND path LIKE 'src1/%'")
def grep_folder(spark, folder):
    return corpus.grep_corpus(spread(load(spark, folder, "corpus")), "the", "**.{md,txt}", folder="src1").select("path", "line", "shown")


@query("SELECT path FROM $corpus WHERE regexp_matches(path, '^src[^/]*/en/[^/]*[.]md$')")
def find_paths(spark, folder):
    return corpus.find_paths(load(spark, folder, "corpus"), "src*/en/*.md")


@query("SELECT path, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text FROM $corpus")
def slice_lines(spark, folder):
    return load(spark, folder, "corpus").select("path", corpus.slice_lines(F.col("text"), 2, 3).alias("text"))


@query("SELECT path, octet_length(encode(text)) AS bytes, len(string_split(text, chr(10))) AS lines FROM $corpus")
def file_info(spark, folder):
    rows = load(spark, folder, "corpus").select("path", "text", F.octet_length("text").alias("bytes"), F.contains(F.substring("text", 1, 8192), F.lit("\0")).alias("is_binary"))
    return corpus.file_info(rows)


@query("SELECT path, CAST((SELECT count(*) FROM $corpus) > 300 AS INT) AS truncated FROM $corpus ORDER BY path LIMIT 300")
def capped_paths(spark, folder):
    return corpus.capped(load(spark, folder, "SELECT path FROM $corpus"), 300, ["path"]).select("path", F.col("truncated").cast("int").alias("truncated"))


def pairs(spark, folder):
    """Every document beside a copy with edited lines."""
    docs = spread(load(spark, folder, "corpus"))
    lines = F.split("text", "\n", -1)
    edited = F.transform(F.filter(lines, lambda l, i: (i + F.col("doc_id")) % 5 != 4), lambda l, i: F.when(i % 7 == 3, F.concat(l, F.lit(" (edited)"))).otherwise(l))
    return docs.select("doc_id", "path", F.col("text").alias("old"), F.array_join(edited, "\n").alias("new"))


@query()
def line_diff(spark, folder):
    return corpus.line_diff(pairs(spark, folder), ["doc_id"])


@query("""SELECT path, array_to_string(list_transform(string_split(text, chr(10)), lambda l: ' ' || l), chr(10)) AS both FROM $corpus""")
def line_diff_rebuilds(spark, folder):
    """The old side of every difference, put together again."""
    rows = corpus.line_diff(pairs(spark, folder), ["path"]).where("op <> 'add'")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(" "), x["line"])), "\n").alias("both"))


@query("""SELECT path, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l, i: (i - 1 + doc_id) % 5 <> 4), lambda l, i: chr(10) || '|' || l || CASE WHEN (i - 1) % 7 = 3 THEN ' (edited)' ELSE '' END), '') AS both FROM $corpus""")
def line_diff_rebuilds_new(spark, folder):
    """The new side of every difference, put together again. A text without lines is one empty line to a difference and none to SQL."""
    rows = corpus.line_diff(pairs(spark, folder), ["path"]).where("op <> 'del'")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    whole = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("\n|"), x["line"])), "")
    return rows.groupBy("path").agg(F.when(whole == "\n|", "").otherwise(whole).alias("both"))


@query("""SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS old_lines, count(DISTINCT doc_id) AS pairs FROM $documents""")
def line_diff_totals(spark, folder):
    rows = corpus.line_diff(pairs(spark, folder), ["doc_id"])
    per_pair = rows.groupBy("doc_id").agg(F.count_if(F.col("op") != "add").alias("n"))
    return per_pair.agg(F.sum("n").alias("old_lines"), F.count("*").alias("pairs"))


@query()
def diff_summary(spark, folder):
    return corpus.diff_summary(corpus.line_diff(pairs(spark, folder), ["doc_id"]), ["doc_id"])


@query()
def unified_diff(spark, folder):
    return corpus.unified_diff(pairs(spark, folder), ["doc_id"])


_OUTLINE = """
    WITH pieces AS (SELECT page_id, unnest(string_split(c, '<')[2:]) AS x, unnest(range(1, len(string_split(c, '<')))) AS pos FROM (
             SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\\b[^>]*>.*?</head\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<![^>]*>', '', 'g') AS c FROM $pages) h),
         tags AS (SELECT page_id, pos, regexp_extract(x, '^/?[A-Za-z0-9]+') AS tag, substr(trim(regexp_replace(replace(replace(replace(replace(substr(x, strpos(x, '>') + 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 100) AS text, substr(x, strpos(x, '>') + 1) = '' AS bare FROM pieces),
         near AS (SELECT *, lead(tag) OVER (PARTITION BY page_id ORDER BY pos) AS nxt, CASE WHEN tag = 'a' THEN 1 ELSE 0 END AS link FROM tags),
         shown AS (SELECT *, sum(link) OVER (PARTITION BY page_id ORDER BY pos) AS ref FROM near
                   WHERE tag = 'a' OR tag IN ('h1', 'h2', 'h3', 'p', 'li', 'span', 'div') AND text <> '' AND (nxt IS NULL OR nxt LIKE '/%' OR tag = 'li' AND nxt = 'li'
                         OR tag = 'p' AND nxt IN ('p', 'div', 'ul', 'ol', 'h1', 'h2', 'h3', 'h4', 'table', 'article', 'section', 'form')))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS n, CASE WHEN link = 1 THEN '[e' || CAST(ref AS BIGINT) || '] link "' || substr(text, 1, 80) || '"'
           WHEN tag LIKE 'h%' THEN upper(tag) || ' "' || text || '"' ELSE '"' || text || '"' END AS line FROM shown"""


@query(_OUTLINE)
def page_outline(spark, folder):
    return corpus.page_outline(load(spark, folder, "SELECT page_id, html FROM $pages"), ["page_id"])


@query("""SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links FROM $pages WHERE regexp_matches(html, '<a ')""")
def outline_links(spark, folder):
    """Every link of the markup, also those that an outline does not show."""
    links = F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("bigint")
    return load(spark, folder, "SELECT page_id, html FROM $pages").select("page_id", links.alias("links")).where("links > 0")


@query(f"SELECT * FROM ({_OUTLINE}) o WHERE contains(line, '***')")
def find_in_outline(spark, folder):
    return corpus.find_in_outline(load(spark, folder, "SELECT page_id, html FROM $pages"), ["page_id"], "***")


@query(f"SELECT * FROM ({_OUTLINE}) o WHERE regexp_matches(line, '(?i)link \".*the')")
def find_links_in_outline(spark, folder):
    return corpus.find_in_outline(load(spark, folder, "SELECT page_id, html FROM $pages"), ["page_id"], 'link ".*the')
