"""The native builders as SQL functions: bodies in SQL, no Python worker. ``registry.register_all`` creates them in a session.

Patterns are of the JVM's dialect, as in the builders. A table function takes its arguments from the row beside it:
``SELECT d.doc_id, s.* FROM documents d, LATERAL regex_spans(d.text, '[0-9]+') s``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from textloom.functions import identifiers as ids
from textloom.functions.text import BOM, CHARS_PER_TOKEN, CLIP_CHARS, CONTEXT_WIDTH, SPACES

_MARK, _OTHER = chr(0xFFFF), chr(0xFFFE)
SPAN = "ARRAY<STRUCT<start: INT, end: INT, value: STRING>>"
MATCH = "ARRAY<STRUCT<start: INT, end: INT, value: STRING, shape: STRING, rank: INT>>"
CONTEXT = "STRUCT<line: INT, before: ARRAY<STRING>, hit: STRING, after: ARRAY<STRING>>"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def pieces(text: str, pattern: str) -> str:
    """Gaps and matches in turn, starting with a gap."""
    clean = f"CASE WHEN contains({text}, '{_MARK}') THEN translate({text}, '{_MARK}', '{_OTHER}') ELSE {text} END"
    return f"split(regexp_replace({clean}, {pattern}, '{_MARK}$0{_MARK}'), '{_MARK}', -1)"


def spans(text: str, pattern: str) -> str:
    start = f"struct(0 AS pos, false AS hit, CAST(array() AS {SPAN}) AS out)"
    found = "CASE WHEN a.hit THEN concat(a.out, array(struct(a.pos AS start, a.pos + length(x) AS end, x AS value))) ELSE a.out END"
    return bind(pieces(f"coalesce({text}, '')", pattern), "p", f"aggregate(p, {start}, (a, x) -> struct(a.pos + length(x) AS pos, NOT a.hit AS hit, {found} AS out), a -> a.out)")


def blanked(text: str, part: str, pattern: str) -> str:
    blank = "array_join(transform(p, (x, i) -> CASE WHEN i % 2 = 1 THEN repeat(' ', length(x)) ELSE x END), '')"
    return bind(text, "t", f"CASE WHEN contains(t, {literal(part)}) THEN {bind(pieces('t', literal(pattern)), 'p', blank)} ELSE t END")


def surface(text: str) -> str:
    out = f"coalesce({text}, '')"
    for part, pattern in (("=", ids.SKIPPED_ATTRIBUTES), ("://", ids.URL_PORT), (ids.OWN_TOKEN[:6], ids.OWN_TOKEN)):
        out = blanked(out, part, pattern)
    return out


def shapes(text: str) -> str:
    each = [f"transform({spans('t', literal(p))}, s -> struct(s.start AS start, s.end AS end, s.value AS value, '{n}' AS shape, {rank} AS rank))" for rank, (n, p) in enumerate(ids.SHAPES)]
    found = f"concat({', '.join(each)})"
    keyed = "array_sort(transform(m, s -> struct(s.start AS start, s.start - s.end AS size, s.rank AS rank, s AS span)))"
    step = "(a, x) -> CASE WHEN x.start >= a.pos THEN struct(concat(a.out, array(x.span)) AS out, x.span.end AS pos) ELSE a END"
    chosen = f"aggregate({keyed}, struct(CAST(array() AS {MATCH}) AS out, 0 AS pos), {step}, a -> a.out)"
    return bind(f"coalesce({text}, '')", "t", bind(f"CASE WHEN t RLIKE '[0-9@]' THEN {found} ELSE CAST(array() AS {MATCH}) END", "m", chosen))


def context() -> str:
    near = CONTEXT_WIDTH
    short = lambda rows: f"transform({rows}, x -> concat(substring(x, 1, {2 * near}), CASE WHEN length(x) > {2 * near} THEN ' …' ELSE '' END))"
    none = "CAST(array() AS ARRAY<STRING>)"
    above = "split(substring(h, 1, b - 1), '\\n', -1)"
    parts = f"""struct(length(h) - length(replace(h, '\\n', '')) + 1 AS line,
        {short(f"CASE WHEN b > 0 THEN slice({above}, greatest(1, size({above}) - lines + 1), lines) ELSE {none} END")} AS before,
        concat(CASE WHEN first > b + {near} THEN '… ' ELSE '' END, substring(text, greatest(b, first - {near}) + 1, least(e, last + {near}) - greatest(b, first - {near})), CASE WHEN last + {near} < e THEN ' …' ELSE '' END) AS hit,
        {short(f"CASE WHEN e < length(text) THEN slice(split(substring(text, e + 2), '\\n', lines + 1), 1, lines) ELSE {none} END")} AS after)"""
    ends = bind("length(h) + length(substring_index(substring(text, first + 1), '\\n', 1))", "e", parts)
    return bind("substring(text, 1, first)", "h", bind("length(h) - length(substring_index(h, '\\n', -1))", "b", ends))


_NUMERIC = f"value RLIKE {literal('^(?:' + ids.SEPARATOR_CLASS + '|[0-9])+$')}"
_DIGITS = "regexp_replace(value, '[^0-9]', '')"

#: name: parameters, type, body. ``norm_key`` folds letters through the registered function ``nfc_lower``.
SCALARS = {
    "clip": (f"text STRING, n INT DEFAULT {CLIP_CHARS}", "STRING", "CASE WHEN length(text) > n THEN concat(substring(text, 1, n), '\\n…[+', length(text) - n, ' chars]') ELSE coalesce(text, '') END"),
    "estimate_tokens": ("text STRING", "BIGINT", f"CAST(ceil(length(coalesce(text, '')) / {CHARS_PER_TOKEN}) AS BIGINT)"),
    "slice_lines": ("text STRING, first INT, n INT", "STRING", "array_join(slice(split(text, '\\n', -1), greatest(1, first), n), '\\n')"),
    "decision_value": ("value STRING", "STRING", f"regexp_replace(lower(coalesce(value, '')), {literal(f'[{SPACES}{BOM}.' + chr(92) + 'x{2010}-' + chr(92) + 'x{2015}-]')}, '')"),
    "norm_key": ("value STRING", "STRING", f"CASE WHEN {_NUMERIC} AND length({_DIGITS}) >= {ids.NUMBER_FLOOR} THEN concat('n:', {_DIGITS}) ELSE concat('t:', nfc_lower(value)) END"),
    "text_spans": ("text STRING, pattern STRING", SPAN, spans("text", "pattern")),
    "scan_surface": ("html STRING", "STRING", surface("html")),
    "shape_matches": ("text STRING", MATCH, shapes("text")),
    "match_context": ("text STRING, first INT, last INT, lines INT DEFAULT 2", CONTEXT, context()),
}
TABLES = {
    "regex_spans": ("text STRING, pattern STRING", "start INT, end INT, value STRING", f"SELECT s.start, s.end, s.value FROM (SELECT explode({spans('text', 'pattern')}) AS s)"),
    "shape_rows": ("text STRING", "start INT, end INT, value STRING, shape STRING", f"SELECT s.start, s.end, s.value, s.shape FROM (SELECT explode({shapes('text')}) AS s)"),
}


def create_all(spark: SparkSession) -> list[str]:
    """Create all functions in the session, in place of earlier ones of the same names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [*SCALARS, *TABLES]
