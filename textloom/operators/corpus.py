"""Search and comparison over a collection of texts (path, text)."""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator, Sequence
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.folding import text_parts
from textloom.functions.text import glob_predicate

# Limits.
SIZE_LIMIT = 2 * 1024 * 1024
OUTLINE_LINES = 800
MORE_LINES = "… [more lines]"
#: Bytes of markup that a task takes apart.
MARKUP_BYTES = 4 << 20


def capped(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order``, with ``truncated`` telling whether there were more."""
    some = df.orderBy(*order).limit(n + 1)
    # One window over at most n + 1 rows.
    everything = Window.partitionBy(F.lit(1))
    flagged = some.withColumn("truncated", F.count("*").over(everything) > n)
    return flagged.orderBy(*order).limit(n)


def grep_corpus(
    df: DataFrame, pattern: str, glob: str | None = None, flags: str = "", limit: int | None = None, folder: str | None = None
) -> DataFrame:
    """Lines matching ``pattern`` as (path, line, text, shown), below ``folder`` if one is given.

    All of them; with ``limit`` the first ones by path and line, and ``truncated`` tells whether there were more.

    Texts without any match are dropped before they are split into lines.
    """
    own = f"(?{flags})" if flags else ""
    out = below(df, folder)
    out = out if glob is None else out.where(glob_predicate(F.col("path"), glob))
    # Line by line first would split every text; a pattern without anchors can be tested on the whole text.
    if not re.search(r"[\^$]|\\[AzZbBG]|\(\?[=!<]", pattern):
        out = out.where(F.col("text").rlike(own + pattern))
    lines = out.select("path", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("_i", "text"))
    hits = lines.where(F.col("text").rlike(own + pattern)).select("path", (F.col("_i") + 1).alias("line"), "text")
    hits = hits.withColumn("shown", F.concat_ws(":", "path", F.col("line").cast("string"), "text"))
    return hits if limit is None else capped(hits, limit, ["path", "line"])


def below(df: DataFrame, folder: str | None) -> DataFrame:
    return df if folder is None else df.where(F.col("path").startswith(folder.rstrip("/") + "/"))


def find_paths(df: DataFrame, glob: str, limit: int | None = None, folder: str | None = None) -> DataFrame:
    """All paths that match; with ``limit`` the first ones and ``truncated``."""
    hits = below(df, folder).where(glob_predicate(F.col("path"), glob)).select("path")
    return hits if limit is None else capped(hits, limit, ["path"])


def slice_lines(text: Column, offset: int | None = None, limit: int | None = None) -> Column:
    """Lines from the 1-based ``offset`` on, at most ``limit`` of them."""
    lines = F.split(text, "\n", -1)
    start = max(1, offset or 1)
    count = F.size(lines) if limit is None else F.lit(limit)
    return F.array_join(F.slice(lines, F.lit(start), count), "\n")


def file_info(df: DataFrame) -> DataFrame:
    """Size and number of lines; no line count for binary or very large files."""
    lines = F.size(F.split("text", "\n", -1))
    return df.select("path", "bytes", F.when(~F.col("is_binary") & (F.col("bytes") <= SIZE_LIMIT), lines).alias("lines"))


# ── line differences ──────────────────────────────────────────────────────────

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("line", T.StringType())]))


#: Match masks that are kept at a time, in bytes.
MASKS = 32 << 20


class _Grid:
    """Lengths of longest common subsequences of the first i symbols of x and the first j of y, one bit for each j and row.

    A row is a whole number whose bit j is 0 where the length grows from j to j + 1; the next row takes four operations on such numbers. Only
    every so many rows are kept, and a stretch between two of them is worked out again when it is asked for: of n rows of m bits,
    2 * sqrt(n) are held.
    """

    def __init__(self, x: Sequence[int], y: Sequence[int]):
        self.x, self.width = x, len(y)
        self.full = (1 << len(y)) - 1
        self.places: dict[int, list[int]] = {}
        for j, symbol in enumerate(y):
            self.places.setdefault(symbol, []).append(j)
        self.masks: dict[int, int] = {}
        self.stride = max(1, math.isqrt(len(x)))
        self.kept = [self.full]
        row = self.full
        for i, symbol in enumerate(x, 1):
            row = self.after(row, symbol)
            if i % self.stride == 0:
                self.kept.append(row)
        self.last = row
        self.stretch: tuple[int, list[int]] = (-1, [])

    def mask(self, symbol: int) -> int:
        known = self.masks.get(symbol)
        if known is None:
            known = 0
            places = self.places[symbol]
            if len(places) < 8:
                for j in places:
                    known |= 1 << j
                return known
            bits = np.zeros(self.width, np.uint8)
            bits[places] = 1
            known = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if (len(self.masks) + 1) * (self.width >> 3) > MASKS:
                self.masks.clear()
            self.masks[symbol] = known
        return known

    def after(self, row: int, symbol: int) -> int:
        if symbol not in self.places:
            return row
        hit = row & self.mask(symbol)
        return (row + hit | row - hit) & self.full

    def row(self, i: int) -> int:
        block = i // self.stride
        if self.stretch[0] != block:
            rows = [self.kept[block]]
            for symbol in self.x[block * self.stride : (block + 1) * self.stride - 1]:
                rows.append(self.after(rows[-1], symbol))
            self.stretch = block, rows
        return self.stretch[1][i - block * self.stride]

    def length(self, i: int, j: int) -> int:
        return j - (self.row(i) & ((1 << j) - 1)).bit_count()


def line_ops(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """Longest-common-subsequence difference of two texts, as (op, line). Of equal choices the later deletion wins.

    Shared last lines are set aside. Every old line is then settled from the last to the first, given how many new lines are left: it is
    kept if it equals the last of these; else it goes if the rest does without it; else its nearest equal is the partner, and the new
    lines after that one are additions. Two texts of 200,000 changed lines each need some 50 MB.
    """
    a, b = (old or "").split("\n"), (new or "").split("\n")
    shared = 0
    while shared < min(len(a), len(b)) and a[-1 - shared] == b[-1 - shared]:
        shared += 1
    end = a[len(a) - shared :]
    a, b = a[: len(a) - shared], b[: len(b) - shared]
    codes: dict[str, int] = {}
    x = [codes.setdefault(line, len(codes)) for line in a]
    y = [codes.setdefault(line, len(codes)) for line in b]
    grid = _Grid(x, y)
    left = len(y)
    length = left - grid.last.bit_count()
    partner: list[int] = [-1] * len(x)  # of a line that is kept
    until = [0] * len(x)  # new lines that come before the line's place
    for i in range(len(x) - 1, -1, -1):
        places = grid.places.get(x[i], [])
        at = bisect.bisect_left(places, left) - 1
        if at >= 0 and (places[at] == left - 1 or grid.length(i, left) < length):
            partner[i] = left = places[at]
            length -= 1
        until[i] = left
    out, done = [], 0
    for i, line in enumerate(a):
        out += [("add", s) for s in b[done : until[i]]]
        kept = partner[i] >= 0
        out.append(("same" if kept else "del", line))
        done = until[i] + kept
    return out + [("add", s) for s in b[done:]] + [("same", s) for s in end]


@F.arrow_udf(OPS)
def line_changes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``line_ops`` of each pair. Results leave in parts of bounded size, so memory does not follow the size of a batch."""
    for batch in batches:
        for olds, news in text_parts(batch):
            ops, lines, ends = [], [], [0]
            for old, new in zip(olds, news):
                for op, line in line_ops(old, new):
                    ops.append(op)
                    lines.append(line)
                ends.append(len(ops))
            fields = pa.StructArray.from_arrays([pa.array(ops, pa.string()), pa.array(lines, pa.string())], ["op", "line"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


def unified(old: str | None, new: str | None, context: int = 2, label: str = "file") -> str:
    """The hunks of a line difference, with ``context`` unchanged lines around them."""
    ops = line_ops(old, new)
    changed = [i for i, (op, _) in enumerate(ops) if op != "same"]
    hunks: list[list[int]] = []
    for i in changed:
        if hunks and i - hunks[-1][1] <= 2 * context + 1:
            hunks[-1][1] = i
        else:
            hunks.append([i, i])
    sign = {"same": " ", "add": "+", "del": "-"}
    lines = [f"--- {label}", f"+++ {label}"]
    for first, last in hunks:
        lo, hi = max(0, first - context), min(len(ops), last + 1 + context)
        if all(op == "same" for op, _ in ops[last + 1:]) and len(ops) - last - 1 <= 2 * context:
            hi = len(ops)
        before, part = ops[:lo], ops[lo:hi]
        count = lambda rows, other: sum(op != other for op, _ in rows)
        lines.append(f"@@ -{count(before, 'add') + 1},{count(part, 'add')} +{count(before, 'del') + 1},{count(part, 'del')} @@")
        lines += [sign[op] + line for op, line in part]
    return "\n".join(lines)


@F.arrow_udf(T.StringType())
def unified_text(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in text_parts(batch):
            yield pa.array([unified(a, b, label=c or "file") for a, b, c in zip(*part)], pa.string())


def line_diff(pairs: DataFrame, keys: Sequence[str], old: str = "old", new: str = "new") -> DataFrame:
    """One row per line of the difference of every pair. Equal pairs do not reach Python. Every pair is on its own."""
    same = F.transform(F.split(F.col(new), "\n", -1), lambda l: F.struct(F.lit("same").alias("op"), l.alias("line")))
    equal = F.col(old).eqNullSafe(F.col(new))
    rows = pairs.where(~equal).select(*keys, F.posexplode(line_changes(F.col(old), F.col(new))).alias("pos", "c"))
    rest = pairs.where(equal).select(*keys, F.posexplode(same).alias("pos", "c"))
    return rows.union(rest).select(*keys, "pos", "c.op", "c.line")


def diff_summary(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``+a / -d`` per pair."""
    added, deleted = F.count_if(F.col("op") == "add"), F.count_if(F.col("op") == "del")
    return changes.groupBy(*keys).agg(F.format_string("+%d / -%d", added, deleted).alias("summary"))


def unified_diff(pairs: DataFrame, keys: Sequence[str], old: str = "old", new: str = "new", label: str = "path") -> DataFrame:
    return pairs.select(*keys, unified_text(F.col(old), F.col(new), F.col(label)).alias("diff"))


def id_set_changes(before: Column, after: Column) -> Column:
    """Ids that came and ids that went."""
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"))


# ── page outlines ─────────────────────────────────────────────────────────────

# Elements that can be used, roles, elements whose own text is shown, elements that have no content or need no end.
USABLE = {"a", "button", "input", "select", "textarea", "option", "label", "summary"}
ROLES = {
    "a": "link",
    "button": "button",
    "select": "combobox",
    "textarea": "textbox",
    "img": "img",
    "nav": "navigation",
    "main": "main",
    "header": "banner",
    "h1": "heading",
    "h2": "heading",
    "h3": "heading",
    "h4": "heading",
}
TEXTUAL = {"h1", "h2", "h3", "p", "li", "span", "div"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "table", "article", "section", "form"}, "li": {"li"}, "option": {"option"}}


#: What holds no page content, pieces of markup, and attributes of a tag.
_DROPPED = r"(?is)<!--.*?-->|<(script|style|noscript|template|head)\b[^>]*+>.*?</\1\s*+>|</?(?:meta|link)\b[^>]*+>|<[!?][^>]*+>"
_PIECE = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[A-Za-z][^>]*+>|[^<]++|<"""
_ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?"""
_OF_INTEREST = "(?i)role|onclick|tabindex|hidden|style|aria-|placeholder|name|value|type|disabled|checked"
_NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})


def unescape(text: Column) -> Column:
    """Character references, by number or by name, as the characters they stand for; what is none stays as it is."""
    names = F.from_json(F.lit(_NAMED), "map<string,string>")

    def part(rest: Column, i: Column) -> Column:
        mark = F.regexp_extract(rest, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.when(mark.rlike("^#[xX]"), F.conv(F.substring(mark, 3, 6), 16, 10)).when(mark.startswith("#"), F.substring(mark, 2, 7)).try_cast("bigint")
        sound = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(mark != "", F.try_element_at(names, mark))
        return F.when(i == 0, rest).when(char.isNotNull(), F.concat(char, F.substr(rest, F.length(mark) + 2, F.length(rest)))).otherwise(F.concat(F.lit("&"), rest))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&", -1), part), "")).otherwise(text)


def _attributes(piece: Column) -> Column:
    """Attributes of an opening tag by lower-case name; one without a value is empty. The last of two equal names counts."""
    body = F.regexp_replace(piece, r"^<[^\s/>]+", "")
    found = [F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(n)) for n in range(1, 5)]
    both = lambda a, b: F.concat(a, b)
    values = F.zip_with(F.zip_with(found[1], found[2], both), found[3], both)
    return F.map_from_entries(F.transform(F.arrays_zip(found[0].alias("k"), values.alias("v")), lambda x: F.struct(F.lower(x["k"]).alias("k"), unescape(x["v"]).alias("v"))))


def _squeezed(text: Column, n: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " ")), 1, n)


def markup_elements(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """Pieces of markup in their order, opening tags with their attributes, if one of them is used here, and the place of their closing tag.

    A closing tag belongs to the last open one of its name: both have the same level in the running count of that name. An option holds
    text alone and ends with it. All windows share one exchange by page.
    """
    pieces = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col("_html"), F.lit("")), _DROPPED, ""), F.lit(_PIECE), F.lit(0))
    # A number of partitions that is given is kept: adaptive execution would join small ones, whose rows hold many times their size when sorted.
    size = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // MARKUP_BYTES))
    rows = pages.select(*keys, F.col(html).alias("_html"), F.monotonically_increasing_id().alias("_page")).repartition(tasks, "_page")
    rows = rows.select(*keys, "_page", F.posexplode(pieces).alias("pos", "piece"))
    tag = F.lower(F.regexp_extract("piece", "^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    rows = rows.withColumn("tag", tag).withColumn("closes", (F.col("tag") != "") & F.startswith("piece", F.lit("</")))
    rows = rows.withColumn("opens", (F.col("tag") != "") & ~F.col("closes"))
    rows = rows.withColumn("holds", F.col("opens") & ~F.col("tag").isin(*VOID, "option") & ~F.endswith("piece", F.lit("/>")))
    # A plain search spares most tags the taking apart.
    attrs = F.when(F.col("opens") & F.col("piece").rlike(_OF_INTEREST), _attributes(F.col("piece"))).when(F.col("opens"), F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("attrs", attrs).withColumn("text", F.when(F.col("tag") == "", unescape(F.col("piece"))).otherwise(""))
    by_tag = Window.partitionBy("_page", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("holds"), 1).when(F.col("closes"), -1).otherwise(0)
    rows = rows.withColumn("level", F.sum(step).over(by_tag) + F.col("closes").cast("int"))
    so_far = Window.partitionBy("_page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("chars", F.sum(F.length("text")).over(so_far))
    # Tags without content stand beside the levels, not on them.
    partner = Window.partitionBy("_page", "tag", "level", F.col("holds") | F.col("closes")).orderBy("pos")
    return rows.withColumn("end_chars", F.when(F.col("holds"), F.lead("chars").over(partner)))


def page_outline(pages: DataFrame, keys: Sequence[str], html: str = "html", limit: int | None = None) -> DataFrame:
    """(keys, n, line): elements that can be used, with role, name and state, and the text of elements that hold nothing else.

    Lines are indented by the usable elements around them and numbered from 0 in each page. What the markup hides is left out with all it
    holds. With ``limit`` the first lines of each page, and MORE_LINES after them if there were more. Pages are rows: equal or null keys do
    not mix, and a null page has no lines.
    """
    rows = markup_elements(pages, keys, html)
    has = lambda *names: F.coalesce(F.arrays_overlap(F.map_keys("attrs"), F.array(*[F.lit(n) for n in names])), F.lit(False))
    attr = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    pair = Window.partitionBy("_page", "tag", "level", F.col("holds") | F.col("closes")).orderBy("pos")
    so_far = Window.partitionBy("_page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("_page").orderBy("pos")

    def inside(flag: str) -> Column:
        """How many elements with ``flag`` are open after a piece."""
        begun = F.when(F.col("holds") & F.col(flag), 1).otherwise(0)
        ended = F.when(F.col("closes") & F.coalesce(F.lag(flag).over(pair), F.lit(False)), 1).otherwise(0)
        return begun - ended

    rows = rows.withColumn("hides", F.col("opens") & (has("hidden") | attr("style").rlike(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")))
    rows = rows.withColumn("_step", inside("hides")).withColumn("seen", ~F.col("hides") & (F.sum("_step").over(so_far) <= 0))
    rows = rows.withColumn("usable", F.col("opens") & F.col("seen") & (F.col("tag").isin(*USABLE) | has("role", "onclick", "tabindex")))
    rows = rows.withColumn("_step", inside("usable")).withColumn("depth", F.greatest(F.lit(0), F.sum("_step").over(so_far) - F.greatest(F.lit(0), F.col("_step"))))
    rows = rows.withColumn("ref", F.sum(F.col("usable").cast("int")).over(so_far))
    after = [F.lead(F.struct("tag", "closes", "text"), n).over(ahead).alias(f"_next{n}") for n in (1, 2)]
    rows = rows.select("*", *after)
    third = F.col("_next2")
    shut = third.isNull() | third["closes"]
    for name, closers in CLOSED_BY.items():
        shut = shut | (F.col("tag") == name) & third["tag"].isin(*closers)
    leaf = F.col("holds") & F.col("seen") & ~F.col("usable") & F.col("tag").isin(*TEXTUAL) & (F.col("_next1.tag") == "") & shut
    plain = F.when(leaf, _squeezed(F.col("_next1.text"), 100))
    role = F.when(attr("role") != "", attr("role")).when(F.col("tag") == "input", F.when(attr("type") != "", attr("type")).otherwise("textbox"))
    role = F.coalesce(role, F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("tag")), F.col("tag"))
    given = [attr(n) for n in ("aria-label", "placeholder", "name")] + [F.when(F.col("tag") == "input", attr("value")).otherwise("")]
    beside = F.when(F.col("_next1.tag") == "", _squeezed(F.col("_next1.text"), 80))
    name = F.coalesce(*[F.when(g != "", F.trim(g)) for g in given], F.when(F.col("tag") == "option", beside), F.when(~F.col("holds"), ""))
    states = [F.when(has(s), F.lit(s)) for s in ("disabled", "checked")]
    states.append(F.when(attr("aria-expanded") != "", F.concat(F.lit("expanded="), attr("aria-expanded"))))
    listed = F.concat_ws(",", *states)
    item = F.struct(
        "pos",
        F.repeat(F.lit("  "), F.least(F.col("depth"), F.lit(8)).cast("int")).alias("pad"),
        F.when(F.col("usable"), F.concat(F.lit("[e"), F.col("ref"), F.lit("] "), role, F.lit(' "'))).otherwise(F.concat(F.when(F.startswith("tag", F.lit("h")), F.concat(F.upper("tag"), F.lit(" "))).otherwise(""), F.lit('"'))).alias("head"),
        F.when(F.col("usable"), name).otherwise(plain).alias("name"),
        F.col("chars").alias("from"),
        F.col("end_chars").alias("to"),
        F.concat(F.lit('"'), F.when(F.col("usable") & (listed != ""), F.concat(F.lit(" ("), listed, F.lit(")"))).otherwise("")).alias("tail"),
    )
    shown = F.col("usable") | (F.length(plain) > 0)
    texts = F.when(F.col("text") != "", F.struct("pos", "text"))
    whole = rows.groupBy("_page", *keys).agg(F.array_sort(F.collect_list(F.when(shown, item))).alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(texts)), lambda t: t["text"]), "").alias("_text"))

    def line(x: Column) -> Column:
        held = F.substr(F.col("_text"), (x["from"] + 1).cast("int"), F.coalesce(x["to"] - x["from"], F.length("_text")).cast("int"))
        return F.concat(x["pad"], x["head"], F.coalesce(x["name"], _squeezed(held, 80)), x["tail"])

    lines = F.transform("items", line)
    if limit is not None:
        lines = F.when(F.size("items") > limit, F.concat(F.slice(lines, 1, limit), F.array(F.lit(MORE_LINES)))).otherwise(lines)
    return whole.select(*keys, F.posexplode(lines).alias("n", "line"))


def find_in_outline(pages: DataFrame, keys: Sequence[str], query: str, html: str = "html") -> DataFrame:
    """Outline lines matching ``query`` in any case, of all lines of a page. A query that is no regular expression is taken literally."""
    try:
        pages.sparkSession.range(1).select(F.lit("").rlike("(?i)" + query)).collect()
        pattern = query
    except Exception:
        pattern = re.escape(query)
    return page_outline(pages, keys, html).where(F.col("line").rlike("(?i)" + pattern))
