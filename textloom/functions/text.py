"""Native column builders for text, JSON and log lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"

# Fixed values.
CLIP_CHARS = 20000
CHARS_PER_TOKEN = 4
CONTEXT_WIDTH = 160

# White space as browsers define it, without the byte order mark (which counts as invisible here).
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BOM = r"\x{FEFF}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


# Two characters that no text should hold; the first marks the borders of matches, the second stands in for it.
_MARK, _OTHER = chr(0xFFFF), chr(0xFFFE)


def _pieces(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn, starting with a gap.

    One replacement puts a mark on both sides of every match and a split on that single character takes the text apart:
    one pass of the expression, compiled once for all rows.
    """
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    return F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def regex_spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` with its character offsets. The pattern must not match empty text."""

    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        span = F.struct(acc["pos"].alias("start"), end.alias("end"), piece.alias("value"))
        out = F.when(acc["hit"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), (~acc["hit"]).alias("hit"), out.alias("out"))

    empty = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), empty.alias("out"))

    def found(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 1, F.aggregate(pieces, zero, step, lambda acc: acc["out"])).otherwise(empty)

    return let(text, lambda t: let(_pieces(t, pattern), found))


def blank_spans(text: Column, pattern: str) -> Column:
    """Overwrite every match with as many spaces, so later offsets still point into the original text."""

    def blank(piece: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(piece))).otherwise(piece)

    return let(text, lambda t: let(_pieces(t, pattern), lambda p: F.when(F.size(p) > 1, F.array_join(F.transform(p, blank), "")).otherwise(t)))


def rebuild(text: Column, spans: Column) -> Column:
    """Replace sorted, non-overlapping spans by their ``token`` field."""

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

    def filled(t: Column, found: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            kept = F.substr(t, acc["pos"] + 1, s["start"] - acc["pos"])
            return F.struct(F.concat(acc["out"], kept, s["token"]).alias("out"), s["end"].alias("pos"))

        return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["pos"] + 1, F.length(t))))

    # One binding for both, so that neither ends up inside the other's lambda, where a Python function could not run.
    both = F.struct(text.alias("text"), spans.alias("spans"))
    return let(both, lambda x: F.when(F.size(x["spans"]) > 0, filled(x["text"], x["spans"])).otherwise(x["text"]))


def leftmost_longest(spans: Column, spans_type: str, rank: str | None = None) -> Column:
    """Keep non-overlapping spans: the earliest first, then the longest, then the lowest ``rank``."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            (-(s["end"] - s["start"])).alias("size"),
            (s[rank] if rank else F.lit(0)).alias("rank"),
            s.alias("span"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        s = x["span"]
        kept = F.struct(F.concat(acc["out"], F.array(s)).alias("out"), s["end"].alias("pos"))
        return F.when(s["start"] >= acc["pos"], kept).otherwise(acc)

    zero = F.struct(F.array().cast(spans_type).alias("out"), F.lit(0).alias("pos"))
    return F.aggregate(F.array_sort(keyed), zero, step, lambda acc: acc["out"])


def match_context(text: Column, start: Column, end: Column, lines: int = 2) -> Column:
    """Line number, the hit line cut to a window around the match, and ``lines`` clamped lines on both sides.

    Worked out from the places where the match's line begins and ends; only the lines nearby are taken apart.
    """
    near = CONTEXT_WIDTH
    if_cut = lambda cut, mark: F.when(cut, F.lit(mark)).otherwise(F.lit(""))
    short = lambda rows: F.transform(rows, lambda x: F.concat(F.substring(x, 1, 2 * near), if_cut(F.length(x) > 2 * near, " …")))
    none = F.array().cast("array<string>")

    def around(ahead: Column, rest: Column) -> Column:
        begins = F.length(ahead) - F.length(F.substring_index(ahead, "\n", -1))
        ends = F.length(ahead) + F.length(F.substring_index(rest, "\n", 1))
        above = F.split(F.substr(ahead, F.lit(1), begins - 1), "\n", -1)
        last = F.slice(above, F.greatest(F.lit(1), F.size(above) - lines + 1), F.lit(lines))
        below = F.split(F.substr(text, ends + 2, F.length(text)), "\n", lines + 1)
        lo, hi = F.greatest(begins, start - near), F.least(ends, end + near)
        return F.struct(
            (F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit(""))) + 1).alias("line"),
            short(F.when(begins > 0, last).otherwise(none)).alias("before"),
            F.concat(if_cut(lo > begins, "… "), F.substr(text, lo + 1, hi - lo), if_cut(hi < ends, " …")).alias("hit"),
            short(F.when(ends < F.length(text), F.slice(below, 1, lines)).otherwise(none)).alias("after"),
        )

    head, tail = F.substr(text, F.lit(1), start), F.substr(text, start + 1, F.length(text))
    return let(head, lambda ahead: let(tail, lambda rest: around(ahead, rest)))


def clip(text: Column, n: int = CLIP_CHARS) -> Column:
    """Cut long text and say how much is missing."""
    t = F.coalesce(text, F.lit(""))
    more = F.concat(F.substring(t, 1, n), F.lit("\n…[+"), (F.length(t) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(t) > n, more).otherwise(t)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN).cast("bigint")


def glob_regex(glob: str) -> str:
    """The anchored regular expression for ``**``, ``*``, ``?`` and ``{a,b}``."""
    tokens = {"**/": ".*", "**": ".*", "*": r"[^/\\]*", "?": r"[^/\\]"}
    out, rest = [], glob
    while rest:
        hit = next((t for t in tokens if rest.startswith(t)), None)
        choice = rest.startswith("{") and "}" in rest
        if hit:
            out.append(tokens[hit])
            rest = rest[len(hit):]
        elif choice:
            body, rest = rest[1:].split("}", 1)
            out.append("(?:" + "|".join(p.replace(".", r"\.") for p in body.split(",")) + ")")
        else:
            c, rest = rest[0], rest[1:]
            out.append("\\" + c if c in ".{}+()|^$\\" else c)
    return "^" + "".join(out) + "$"


def glob_predicate(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def extract_attributes(text: Column, types: Mapping[str, str] | None = None) -> Column:
    """``name="value"`` pairs as a map of strings; the last of two equal names wins.

    ``types`` names the attributes declared ``integer``, ``number`` or ``boolean``; their values are put in normal form.
    Every value is trimmed, one that does not parse stays as it is.
    """
    gap = f"[{SPACES}{BOM}]*"
    pattern = f'([a-zA-Z_][a-zA-Z0-9_-]*){gap}={gap}"([^"]*)"'
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    clean = F.transform(values, js_trim)

    def coerce(k: Column, v: Column) -> Column:
        out = v
        for name, kind in (types or {}).items():
            if kind == "boolean":
                out = F.when(k == name, (v == "true").cast("string")).otherwise(out)
            elif kind in ("integer", "number"):
                number = F.when(v == "", F.lit("0")).otherwise(number_text(v.try_cast("double"), v))
                out = F.when(k == name, number).otherwise(out)
        return out

    # Pairs are folded in order, so a repeated name takes its last value under any session setting.
    pairs = F.arrays_zip(names.alias("k"), F.zip_with(names, clean, coerce).alias("v"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(
        pairs,
        empty,
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])),
    )


def number_text(number: Column, otherwise: Column) -> Column:
    """A number as text, without a trailing ``.0`` for whole values."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    text = F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string"))
    return F.when(number.isNull() | F.isnan(number), otherwise).otherwise(text)


def js_trim(text: Column) -> Column:
    """Trim white space of any kind from both ends."""
    ends = f"^[{SPACES}{BOM}]+|[{SPACES}{BOM}]+$"
    return F.regexp_replace(text, ends, "")


def java_trim(text: Column) -> Column:
    """Trim every character up to U+0020 from both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def fill_template(text: Column, values: Column) -> Column:
    """Replace every ``${name}`` by its entry in the map ``values``."""
    return F.aggregate(
        F.map_entries(values),
        text,
        lambda acc, e: F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))),
    )


def unresolved_placeholders(text: Column) -> Column:
    """Names still standing as ``${name}``, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}]+)\}"), F.lit(1))))


def redact_key(key: Column) -> Column:
    k = F.coalesce(key, F.lit(""))
    return F.when(k == "", F.lit("(empty)")).otherwise(F.concat(F.substring(k, 1, 8), F.lit("…")))


def reload_marker(line: Column) -> Column:
    """App, file, outcome, seconds and error text of a reload line; NULL for any other line."""
    head = r"^=== reload ([^:]+): "
    good = head + r"(\S+) → compile OK, .*? in ([0-9.]+)s ===$"
    bad = head + r"COMPILE FAILED — (.*) ===$"
    ok, failed = line.rlike(good), line.rlike(bad)
    error = F.regexp_extract(line, bad, 2)
    text = F.lit(None).cast("string")
    return F.when(
        ok | failed,
        F.struct(
            F.regexp_extract(line, head, 1).alias("app"),
            F.when(ok, F.regexp_extract(line, good, 2)).otherwise(F.regexp_extract(error, r"^([^:\s]+)", 1)).alias("file"),
            ok.alias("ok"),
            F.when(ok, F.regexp_extract(line, good, 3).try_cast("double")).alias("seconds"),
            F.when(ok, text).otherwise(error).alias("error"),
        ),
    )


def vendor_extras(json: Column, known: Sequence[str]) -> Column:
    """Field names of a JSON object that are not in ``known``; NULL when there are none."""
    names = F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in known]))
    return F.when(F.size(names) > 0, names)


# The fields a chat message, a tool call and a function object are known to have.
MESSAGE_FIELDS = ("role", "content", "tool_calls", "tool_call_id", "refusal", "name", "function_call")
TOOL_CALL_FIELDS = ("id", "type", "function", "index")
FUNCTION_FIELDS = ("name", "arguments")


def retry_after_seconds(header: Column, body: Column) -> Column:
    """The larger of the two waits that are positive numbers, else one second."""

    def usable(c: Column) -> Column:
        n = c.try_cast("double")
        return F.when((n > 0) & (n < float("inf")), n)

    return F.coalesce(F.greatest(usable(header), usable(body)), F.lit(1.0))


def retry_wait_ms(header: Column, body: Column, attempt: Column) -> Column:
    return F.greatest(retry_after_seconds(header, body) * 1000, F.pow(F.lit(2.0), attempt) * 500)


def summarize_event(kind: Column, payload: Column) -> Column:
    """One line per telemetry event; ``payload`` is JSON text."""

    def get(path: str, default: str | None = "?") -> Column:
        found = F.get_json_object(payload, path)
        return F.coalesce(found, F.lit(default)) if default is not None else found

    ms = F.concat(F.lit("  ("), get("$.durationMs"), F.lit("ms)"))
    models = F.json_array_length(F.get_json_object(payload, "$.response.data")).cast("string")
    chat = F.concat(
        F.lit("chat_completions  →  finish="),
        get("$.response.choices[0].finish_reason"),
        F.lit("  tokens="),
        get("$.response.usage.total_tokens"),
        ms,
    )
    return (
        F.when(kind == "list_models", F.concat(F.lit("list_models  →  "), F.coalesce(models, F.lit("?")), F.lit(" models"), ms))
        .when(kind == "chat_completions", chat)
        .when(kind == "unlock", F.concat(F.lit("unlock  →  "), get("$.url")))
        .when(kind == "rate-limit", F.concat(F.lit("rate-limit  →  sleep "), get("$.ms"), F.lit("ms")))
        .when(kind == "usage", F.concat(F.lit("usage  →  "), payload))
        .when(kind == "error", F.concat(F.lit("error: "), get("$.message")))
        .otherwise(clip(payload, 200))
    )


def summarize_tool_result(name: Column, status: Column, text: Column) -> Column:
    """What a tool returned, in a few words. ``name`` is the verb or the tool name."""
    lines = F.split(text, "\n", -1)
    filled = F.size(F.filter(lines, lambda l: js_trim(l) != "")).cast("string")
    nothing = text.startswith("(no matches")
    spaces = f"[{SPACES}{BOM}]+"

    def after(word: str) -> Column:
        return F.regexp_replace(text, f"^{word}{spaces}", "")

    return (
        F.when(status == "error", F.substring(F.element_at(lines, 1), 1, 140))
        .when(name.isin("list", "list_dir"), F.concat(filled, F.lit(" entries")))
        .when(name.isin("read", "read_file"), F.concat(F.lit("Read "), F.size(lines).cast("string"), F.lit(" lines")))
        .when(name.isin("search", "grep"), F.when(nothing, F.lit("No matches")).otherwise(F.concat(filled, F.lit(" matching lines"))))
        .when(name.isin("find", "glob"), F.when(nothing, F.lit("No files")).otherwise(F.concat(filled, F.lit(" files"))))
        .when(name.isin("write", "write_file"), after("wrote"))
        .when(name.isin("edit", "edit_file"), after("edited"))
        .when(name == "next-task", after("opened new task"))
        .when(name == "list-tasks", F.concat(filled, F.lit(" tasks")))
        .when(name == "task-detail", F.lit("task detail"))
        .when(name == "search-tasks", F.concat(filled, F.lit(" matches")))
        .otherwise(F.concat(F.length(text).cast("string"), F.lit(" bytes")))
    )


def flatten_content(content: Column) -> Column:
    """Message content as plain text: a JSON string, or the text parts of a JSON array joined together.

    ``content`` is a VARIANT.
    """
    parts = F.try_variant_get(content, "$", "array<variant>")

    def part(p: Column) -> Column:
        typed = F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))
        plain = F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))
        return F.coalesce(plain, typed, F.lit(""))

    joined = F.array_join(F.transform(parts, part), "")
    return F.coalesce(joined, F.try_variant_get(content, "$", "string"), F.lit(""))


def assistant_reply_text(chunks: Column) -> Column:
    """Reply text of a streamed answer. ``chunks`` is ARRAY<VARIANT>; thoughts are left out, ``\\n`` becomes a line end."""

    def replies(chunk: Column) -> Column:
        found = F.try_variant_get(chunk, "$.streamAssistResponse.answer.replies", "array<variant>")
        return F.coalesce(found, F.array().cast("array<variant>"))

    def text(reply: Column) -> Column:
        thought = F.coalesce(F.try_variant_get(reply, "$.groundedContent.content.thought", "boolean"), F.lit(False))
        said = F.try_variant_get(reply, "$.groundedContent.content.text", "string")
        return F.when(~thought, F.coalesce(said, F.lit(""))).otherwise(F.lit(""))

    joined = F.array_join(F.transform(F.flatten(F.transform(chunks, replies)), text), "")
    return js_trim(F.replace(joined, F.lit("\\n"), F.lit("\n")))
