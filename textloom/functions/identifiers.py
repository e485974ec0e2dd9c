"""Column builders for personal-data values: shapes, keys and keyed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.functions.text import SPACES, blank_spans, js_trim, leftmost_longest, let, regex_spans

# Shapes in tie order, attributes that hold no data, token forms.
_SEP = r"[-\x{2010}-\x{2015} ]"
_WORD = r"\p{Lu}[\p{L}'\x{2019}.-]*"
_ANY_WORD = r"\p{L}[\p{L}'\x{2019}.-]*"
SHAPES = (
    ("ssn", r"(?<!\d)\d{9}(?!\d)"),
    ("ssn", r"(?<!\d)\d{3}" + _SEP + r"\d{2}" + _SEP + r"\d{4}(?!\d)"),
    ("edi", r"(?<!\d)\d{10}(?!\d)"),
    ("zip", r"(?<!\d)\d{5}(?!\d)"),
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("address", r"(?<!\d)\d{1,5}[ \t]+" + _WORD),
)
_ALONE = r"(?<!\d)"
_S = f"[{SPACES}\\x{{FEFF}}]"
_NOT_S = f"[^{SPACES}\\x{{FEFF}}>]"
SKIPPED_ATTRIBUTES = f"(?i){_S}(?:class|style|placeholder){_S}*={_S}*(?:\"[^\"]*\"|'[^']*'|{_NOT_S}+)"
_HOST = f"[^{SPACES}\\x{{FEFF}}/:?#]{{1,255}}"
URL_PORT = f"(?i)(?<=:)[0-9]{{1,5}}(?<=https?://{_HOST}:[0-9]{{1,5}})"
OWN_TOKEN = "⟦wall:[0-9a-f]{16}⟧"
RESERVED = r"@@@\([^() \t\n\x0B\f\r]{0,200}\)|###\{[^{}]{0,400}\}"
OWN_TOKEN_FORMAT = "⟦wall:%s⟧"
NUMBER_FLOOR = 5
SEPARATOR_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in folding.SEPARATORS) + "]"
MATCH = "array<struct<start:int,end:int,value:string,shape:string,rank:int>>"


def scan_surface(text: Column) -> Column:
    """The text with everything blanked that holds no page data: styling attributes, URL ports, tokens already given out."""
    # A plain search for a part every match must hold spares most texts the regular expressions.
    out = F.coalesce(text, F.lit(""))
    for part, pattern in (("=", SKIPPED_ATTRIBUTES), ("://", URL_PORT), (OWN_TOKEN[:6], OWN_TOKEN)):
        out = let(out, lambda t: F.when(F.contains(t, F.lit(part)), blank_spans(t, pattern)).otherwise(t))
    return out


def _shapes(any_case: bool) -> tuple[tuple[str, str], ...]:
    return tuple((n, p.replace(_WORD, _ANY_WORD) if any_case else p) for n, p in SHAPES)


def shape_matches(surface: Column, any_case: bool = False) -> Column:
    """All values that look like personal data, without overlaps, in text order.

    ``any_case`` also takes a number before a lower-case word for an address.
    """

    # At any one place at most one number shape holds, or an address and the ZIP code it begins with; so one pass finds them all.
    parts = [p.removeprefix(_ALONE) for n, p in _shapes(any_case) if n != "email"]
    number = _ALONE + "(?:" + "|".join(reversed(parts)) + ")"
    mail, mail_rank = next((p, rank) for rank, (n, p) in enumerate(SHAPES) if n == "email")
    none = F.array().cast(MATCH)

    def numbers(s: Column) -> Column:
        size, last = s["end"] - s["start"], F.substring(s["value"], -1, 1)
        rank = F.when(~last.between("0", "9"), 5).when(size == 5, 3).when(size == 10, 2).when(size == 9, 0).otherwise(1)
        shape = lambda r: F.when(r == 5, "address").when(r == 3, "zip").when(r == 2, "edi").otherwise("ssn")
        return let(rank, lambda r: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), shape(r).alias("shape"), r.alias("rank")))

    def mails(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit("email").alias("shape"), F.lit(mail_rank).alias("rank"))

    def found(t: Column) -> Column:
        alone = F.when(t.rlike("[0-9]"), F.transform(regex_spans(t, number), numbers)).otherwise(none)
        posted = F.when(F.contains(t, F.lit("@")), F.transform(regex_spans(t, mail), mails)).otherwise(none)
        both = lambda n, m: F.when(F.size(m) == 0, n).otherwise(leftmost_longest(F.concat(n, m), MATCH, "rank"))
        return let(posted, lambda m: let(alone, lambda n: both(n, m)))

    return let(surface, found)


def decision_value(value: Column) -> Column:
    """The form under which a decision about a value is kept: lower case, without spaces, dots and dashes."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), f"[{SPACES}\\x{{FEFF}}.\\x{{2010}}-\\x{{2015}}-]", "")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_numeric_text(value: Column) -> Column:
    return value.rlike(f"^(?:{SEPARATOR_CLASS}|[0-9])+$")


def norm_key(value: Column) -> Column:
    """``n:`` and the digits for an identifier of at least five digits, ``t:`` and the folded text for anything else."""
    digits = digits_of(value)
    numeric = is_numeric_text(value) & (F.length(digits) >= NUMBER_FLOOR)
    return F.when(numeric, F.concat(F.lit("n:"), digits)).otherwise(F.concat(F.lit("t:"), folding.nfc_lower(value)))


def value_problem(value: Column, common: Column) -> Column:
    """Why a value must not enter the store; NULL if it may. ``common`` tells whether it is an everyday word."""
    v = js_trim(F.coalesce(value, F.lit("")))
    body = F.regexp_replace(v, r"[^\p{L}\p{N}]", "")
    return (
        F.when(v == "", None)
        .when(is_numeric_text(v), F.when(F.length(digits_of(v)) < NUMBER_FLOOR, F.lit("too few digits")))
        .when(F.length(body) < 2, F.lit("too few letters"))
        .when(common, F.lit("common word"))
    )


def number_segments(text: Column) -> Column:
    """Runs of digits joined by at most six separator characters, with the digits alone as ``digits``."""
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    plain = F.translate(text, wide, "0123456789")
    spans = regex_spans(plain, f"[0-9]+(?:{SEPARATOR_CLASS}{{1,{folding.GAP}}}[0-9]+)*")
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), digits_of(s["value"]).alias("digits")),
    )


def keyed_hash(message: Column, secret: str) -> Column:
    """HMAC-SHA256 in hexadecimal, from two nested built-in hashes. The pads are redacted from printed plans by ``prepare``."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def pii_id(key: Column, secret: str) -> Column:
    return F.substring(keyed_hash(key, secret), 1, 16)


def own_token(value: Column, secret: str) -> Column:
    return F.format_string(OWN_TOKEN_FORMAT, pii_id(value, secret))
