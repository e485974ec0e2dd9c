"""Arrow functions for Unicode folding, which Spark has no built-in for.

Offsets are code points. Text that is plain ASCII takes a short path.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _chars(*codes: int | range) -> str:
    return "".join(chr(c) for part in codes for c in ([part] if isinstance(part, int) else part))


# Fixed values.
INVISIBLE = _chars(0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
WHITE = _chars(range(0x09, 0x0E), 0x20, 0xA0, 0x1680, range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
APOSTROPHES = _chars(0x27, 0x2018, 0x2019, 0x02BC, 0x2032)
DASHES = _chars(0x2D, range(0x2010, 0x2016), 0x2212)
SEPARATORS = WHITE + INVISIBLE + DASHES + ".,;:/\\_|()[]{}<>*~=+#&'" + '"' + _chars(0xB7, range(0xFF0D, 0xFF10), 0xFF1A)
GAP = 6
#: Characters of text whose results are held at a time, whatever the size of the batches that come in.
PART_CHARS = 1 << 20

FOLDED = T.StructType(
    [
        T.StructField("norm", T.StringType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)

_CANON = {ord(c): group[0] for group in (APOSTROPHES, DASHES) for c in group}
_UNIT = re.compile(f"[{INVISIBLE}]|[{WHITE}][{WHITE}{INVISIBLE}]*|[!-~]+|.", re.S)
_UNEVEN = re.compile(f"[{WHITE[:5]}]|  ")
_NUMBER = re.compile(r"[0-9]+(?:[" + re.escape(SEPARATORS) + "]{1,%d}[0-9]+)*" % GAP)


def is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def digit(ch: str) -> str | None:
    """The ASCII digit a character stands for, if it is one in another width or position."""
    folded = unicodedata.normalize("NFKC", ch) if ch <= "\uffff" else ""
    return folded if len(folded) == 1 and folded in "0123456789" else None


def fold(text: str) -> tuple[str, Sequence[int], Sequence[int]]:
    """The folded text, and for each of its characters the start and end of the original characters it came from."""
    if text.isascii() and not _UNEVEN.search(text):
        return text.lower(), range(len(text)), range(1, len(text) + 1)
    if text.isascii():
        return _fold_ascii(text)
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    pos, size = 0, len(text)
    while pos < size:
        unit = _UNIT.match(text, pos).group()
        end = pos + len(unit)
        if unit[0] in INVISIBLE:
            pos = end
            continue
        if "!" <= unit[0] <= "~":
            # A run of plain characters; the last one may carry a mark and then belongs to the next unit.
            if len(unit) > 1 and end < size and unicodedata.category(text[end])[0] == "M":
                unit, end = unit[:-1], end - 1
            if len(unit) > 1 or end == size or unicodedata.category(text[end])[0] != "M":
                out.append(unit.lower())
                starts += range(pos, end)
                ends += range(pos + 1, end + 1)
                pos = end
                continue
        if unit[0] in WHITE:
            folded = " "
        else:
            while end < size and unicodedata.category(text[end])[0] == "M":
                end += 1
            folded = unicodedata.normalize("NFKC", text[pos:end].translate(_CANON)).upper().lower()
        out.append(folded)
        starts += [pos] * len(folded)
        ends += [end] * len(folded)
        pos = end
    return "".join(out), starts, ends


def _fold_ascii(text: str) -> tuple[str, list[int], list[int]]:
    """Plain ASCII has no marks and nothing invisible: white space is squeezed, and a character ends where the next one kept starts."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8)
    white = (codes == 32) | (codes >= 9) & (codes <= 13)
    kept = ~white
    kept[0] = True
    kept[1:] |= ~white[:-1]
    starts = np.flatnonzero(kept)
    norm = np.where(white, np.uint8(32), codes)[kept].tobytes().decode("ascii").lower()
    return norm, starts.tolist(), [*starts[1:].tolist(), len(text)]


def text_key(value: str) -> str:
    return unicodedata.normalize("NFC", value).lower()


def text_parts(columns: Sequence[pa.Array], limit: int = PART_CHARS) -> Iterator[list[list[str | None]]]:
    """The rows of a batch of text columns in parts of about ``limit`` bytes; a longer row is a part of its own."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    done, rows, ends = 0, len(size), np.cumsum(size)
    while done < rows:
        before = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield [c.slice(done, stop - done).to_pylist() for c in columns]
        done = stop


@F.arrow_udf(FOLDED)
def normalize_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Folded text with the original span of each folded character."""
    kind = pa.list_(pa.int32())
    for batch in batches:
        for (texts,) in text_parts([batch]):
            norms, places = [], ([], [])
            for t in texts:
                norm, *spans = fold(t or "")
                norms.append(norm)
                for held, span in zip(places, spans):
                    held.append(np.fromiter(span, np.int32, len(span)))
            yield pa.StructArray.from_arrays([pa.array(norms, pa.string()), *[pa.array(p, kind) for p in places]], ["norm", "starts", "ends"])


@F.pandas_udf(T.StringType())
def fold_key(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else fold(v)[0])


@F.pandas_udf(T.StringType())
def nfc_lower(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.lower() if v.isascii() else text_key(v))


def text_windows(text: str, lengths: Mapping[str, Sequence[int]]) -> list[tuple[int, int, str]]:
    """Folded stretches that start and end where a stored value may start and end.

    ``lengths`` gives, by the first character of a value, the lengths that occur.
    """
    norm, starts, ends = fold(text)
    size, total, out = len(norm), len(text), []
    for i, first in enumerate(norm):
        if first not in lengths:
            continue
        start = starts[i]
        if start and is_word(first) and is_word(text[start - 1]):
            continue
        for n in lengths[first]:
            j = i + n
            if j <= size and (ends[j - 1] == total or not (is_word(norm[j - 1]) and is_word(text[ends[j - 1]]))):
                out.append((start, ends[j - 1], norm[i:j]))
    return out


def number_segments(text: str) -> list[list[tuple[int, str]]]:
    """Digit groups joined by at most six separators: one list of (position, digits) for each joined run."""
    plain = text if text.isascii() else text.translate({ord(c): d for c in set(text) if (d := digit(c))})
    return [
        [(m.start() + g.start(), g.group()) for g in re.finditer("[0-9]+", m.group())] for m in _NUMBER.finditer(plain)
    ]


def number_windows(text: str, lengths: frozenset[int]) -> list[tuple[int, int, str]]:
    """Runs of whole digit groups whose digits together have a wanted length."""
    longest = max(lengths, default=0)
    out = []
    for groups in number_segments(text):
        for i, (start, _) in enumerate(groups):
            digits = ""
            for pos, part in groups[i:]:
                digits += part
                if len(digits) > longest:
                    break
                if len(digits) in lengths:
                    out.append((start, pos + len(part), digits))
    return out
