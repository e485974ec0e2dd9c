"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Beyond them, long base64 and hex candidates are decoded and reported only
if what they hold parses: the nested lengths of a key encoding, or the header and payload of a signed token.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import id_and_text, small_batches

#: Kinds in their order: the base patterns, then what the structure confirms.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "pem", "key")
ORDER = {k: i for i, k in enumerate(KINDS)}

# The base patterns and the shortest secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6

#: Shortest candidates that are decoded.
LONG = 40
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]|\\+[nr])*)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
#: Line ends, also escaped ones; lines of base64 that follow one another.
LINE_END = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}(?:{LINE_END}[A-Za-z0-9+/_-]+)+={{0,2}}")
BREAK = re.compile(r"\s|\\+[nr]")
MAGIC = b"openssh-key-v1\0"


def decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill ``raw`` exactly, or None."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(raw):
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


def is_key(raw: bytes) -> bool:
    """Whether ``raw`` is a private key: a sequence that begins with a version number (plain, wrapped or elliptic), an encrypted one, or the length-prefixed form."""
    if raw.startswith(MAGIC):
        at, fields = len(MAGIC), 0
        while at + 4 <= len(raw) and fields < 3:
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
            fields += 1
        return fields == 3 and at <= len(raw)
    if raw[:1] != b"\x30":
        return False
    top = elements(raw)
    if not top or len(top) != 1:
        return False
    inner = elements(top[0][1])
    if inner and [t for t, _ in inner] == [0x30, 4] and inner[1][1]:
        # The algorithm with its parameters, which a bare digest does not have, then what it made of the key.
        return [t for t, _ in elements(inner[0][1]) or []] == [6, 0x30]
    if not inner or len(inner) < 3 or inner[0][0] != 2 or len(inner[0][1]) != 1:
        return False
    tags = [t for t, _ in inner]
    plain = len(inner) >= 9 and all(t == 2 for t in tags[:9])
    wrapped = tags[1] == 0x30 and tags[2] == 4 and (elements(inner[1][1]) or [(0, b"")])[0][0] == 6
    elliptic = tags[1] == 4 and len(inner[1][1]) >= 20 and tags[2] in (0xA0, 0xA1)
    return plain or wrapped or elliptic


def is_token(header: str, payload: str) -> bool:
    """Whether both parts decode to JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(decode64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def sequence_chars(head: str) -> int:
    """Characters of base64, without padding, of the DER sequence that begins with ``head``; 0 if it is none."""
    raw = decode64(head[:12]) or b""
    if len(raw) < 9 or raw[0] != 0x30 or raw[1] & 0x7F > 4 and raw[1] & 0x80:
        return 0
    n = raw[1] & 0x7F if raw[1] & 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + n], "big") if n else raw[1]
    return -(-4 * (2 + n + size) // 3)


def wrapped_keys(text: str) -> Iterator[tuple[int, int]]:
    """Keys in base64 over several lines, found from any of the lines; the length inside, or a shorter line, tells where a key ends."""
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + s, m.start() + e) for s, e in runs(m[0])]
        done = -1
        for n, (start, stop) in enumerate(lines):
            if start < done:
                continue
            ends = []
            if text.startswith("b3BlbnNzaC1rZXktdjE", start):
                short = next((e for s, e in lines[n:] if e - s < stop - start), m.end())
                ends = [short] if short == m.end() else [short, m.end()]
            elif text[start] == "M" and (left := sequence_chars(text[start:stop])):
                for s, e in lines[n:]:
                    left -= len(text[s:e].rstrip("="))
                    if left <= 0:
                        ends = [e] if left == 0 and s > start else []
                        break
            for end in ends:
                raw = decode64(BREAK.sub("", text[start:end]))
                if raw and is_key(raw):
                    yield start, end
                    done = end
                    break


def runs(text: str) -> list[tuple[int, int]]:
    """Where the lines of ``text`` begin and end."""
    out, at = [], 0
    for m in re.finditer(LINE_END, text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            raw = decode64(BREAK.sub("", m[1]))
            if raw and is_key(raw):
                spans.append(("pem", *m.span()))
    if max(map(len, text.split()), default=0) >= LONG:
        spans += [("token", *m.span()) for m in TOKEN.finditer(text) if is_token(m[1], m[2])]
        for m in BASE64.finditer(text):
            raw = decode64(m[0])
            if raw and is_key(raw):
                spans.append(("key", *m.span()))
        pems = [s for s in spans if s[0] == "pem"]
        spans += [("key", s, e) for s, e in wrapped_keys(text) if not any(a <= s and e <= b for _, a, b in pems)]
        for m in HEX_KEY.finditer(text):
            if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
                spans.append(("key", *m.span()))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, end; empty if there is none).

    A null text is empty. Rows with null or equal ids are scanned each for itself; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans() -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*BASE))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans become one. A null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else masked(t, mark))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def masked(text: str, mark: str) -> str:
    out, at = [], 0
    for _, start, end in find_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
