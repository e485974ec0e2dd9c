"""Column builders for URLs, captured requests and page markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The requests worth capturing, in order, and words that exclude a URL.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
WATCHED = (
    ("new", r"^.*/api/v1/chats/new$"),
    ("completion", r"^.*/api/chat/completions$"),
    ("completed", r"^.*/api/chat/completed$"),
    ("chat", r"^.*/api/v1/chats/" + UUID + "$"),
)
EXCLUDED_WORDS = ("count", "pinned", "/tags", "page")
LIST_CAP = 12
ID_CAP = 5


def classify_request(url: Column, excluded: tuple[str, ...] = EXCLUDED_WORDS) -> Column:
    """``new``, ``completion``, ``completed`` or ``chat``; ``excluded`` or ``unwatched`` otherwise."""
    low = F.lower(url)
    out = F.lit("unwatched")
    for name, pattern in reversed(WATCHED):
        out = F.when(url.rlike(pattern), F.lit(name)).otherwise(out)
    for word in excluded:
        out = F.when(low.contains(word.lower()), F.lit("excluded")).otherwise(out)
    return out


def page_address(url: Column) -> Column:
    """Scheme, host and path, without query and fragment; an unreadable URL is kept."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.try_parse_url(url, F.lit("PATH"))
    shown = F.concat(
        scheme,
        F.lit("://"),
        host,
        F.when((port == "") | usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", F.lit("/")).otherwise(path),
    )
    return F.coalesce(shown, url)


def source_key(label: Column, url: Column) -> Column:
    """The name under which masking decisions about one page are kept. The query may hold personal data, so it is dropped."""
    name = F.when(F.coalesce(label, F.lit("")) == "", F.lit("?")).otherwise(label)
    return F.concat(F.lit("browser:"), name, F.lit("@"), page_address(F.coalesce(url, F.lit(""))))


def html_ids(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit('id="([^"]*)"'), F.lit(1)))


def page_facts(html: Column) -> Column:
    """What a change summary needs of a page: the number of tag openings and the ids."""
    tags = F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))
    return F.when(html.isNotNull(), F.struct(tags.alias("tags"), html_ids(html).alias("ids")))


def html_change_summary(before: Column, after: Column, most: int | None = ID_CAP) -> Column:
    """Change in the number of tag openings, and the first ``most`` ids that came and went; None for all."""
    return facts_change_summary(page_facts(before), page_facts(after), most)


def facts_change_summary(before: Column, after: Column, most: int | None = ID_CAP) -> Column:
    """As ``html_change_summary``, from the facts of both pages."""

    def names(ids: Column) -> Column:
        some = ids if most is None else F.slice(ids, 1, most)
        return F.when(F.size(ids) == 0, F.lit("(none)")).otherwise(F.array_join(some, ", "))

    delta = after["tags"] - before["tags"]
    moved = (
        F.when(delta > 0, F.concat(F.lit("~+"), delta.cast("string"), F.lit(" tags")))
        .when(delta < 0, F.concat(F.lit("~"), delta.cast("string"), F.lit(" tags")))
        .otherwise(F.lit("no tag-count change"))
    )
    added = F.array_except(after["ids"], before["ids"])
    removed = F.array_except(before["ids"], after["ids"])
    text = F.concat(moved, F.lit("; +ids: "), names(added), F.lit("; -ids: "), names(removed))
    return F.when(before.isNull(), F.lit("initial snapshot")).otherwise(text)


def dom_change_summary(added: Column, removed: Column, attr: Column, cause: Column, most: int | None = LIST_CAP) -> Column:
    """``+a, +b  -c  ~d``, each list cut to ``most`` names (None: whole), after the action that caused it."""

    def part(sign: str, names: Column) -> Column:
        signed = F.transform(names if most is None else F.slice(names, 1, most), lambda x: F.concat(F.lit(sign), x))
        return F.when(F.size(names) > 0, F.array_join(signed, ", "))

    body = F.concat_ws("  ", part("+", added), part("-", removed), part("~", attr))
    body = F.when(body == "", F.lit("(dom change)")).otherwise(body)
    known = cause.isNotNull() & (cause != "")
    return F.when(known, F.concat(cause, F.lit(" → "), body)).otherwise(body)
