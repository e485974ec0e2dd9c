"""Personal data by weak supervision, in DataFrame operations only.

Four base patterns are reported as they match. Patterns for further kinds propose candidates, and labelers vote on every candidate,
base ones and those that fail their test among them: its form, gazetteers, words before and after it, counter-words, other personal
data nearby, and tables of numbers around it. Expectation-maximisation over the counts of all vote patterns estimates how
reliable each labeler is and how likely each candidate is personal data; a logistic classifier over votes and shape is trained
on these estimates, compiled into one column expression and decides about the candidates beyond the base patterns.

Texts are read once and no text is shuffled. What comes to the driver is a table of counts with at most ``PATTERNS`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stash

# The base patterns. Each run of characters is read from its beginning only, and never given back, so that long runs cost
# no more than their length; \G lets a match begin where the last one ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

BASE = ("email", "ip", "card", "phone")
#: Kinds beyond the base: national telephone, social security and bank account numbers, dates of birth, persons, streets, disguised mail.
ADDED = ("tel", "ssn", "iban", "born", "name", "street", "mail")
KINDS = BASE + ADDED

# Gazetteers, cues and counter-cues in the languages of the texts.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sra|Mme|Mlle|Monsieur|Madame"
GIVEN = "James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Thomas|Peter|Hans|Klaus|Wolfgang|Ursula|Monika|Sabine|Jean|Pierre|Marie|Sophie|Carlos|José|María|Carmen|Ana|Luis|Juan|Anna|Paul|Laura"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court"
ACCOUNTS = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
CODES = "1|33|34|39|41|43|44|49|31|32|45|46|47|48|351|353|61|81|86|91"
PROVIDERS = "gmail|googlemail|yahoo|hotmail|outlook|icloud|gmx|web|orange|free|telefonica|aol|proton"
CUES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write|reach",
    "ip": r"\bip\b|address|adresse|host|client|server|login|logged",
    "card": "card|karte|carte|tarjeta|visa|master|credit|kredit|crédito",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|handy|appel|llam|teléfono|whatsapp",
    "tel": "phone|tel|call|mobile|cell|fax|telefon|handy|appel|llam|teléfono|whatsapp",
    "ssn": r"\bssn\b|social security|sozialversicherung|seguridad social|sécurité sociale",
    "iban": "iban|account|konto|compte|cuenta|bank|transfer|überweis",
    "born": r"\bborn\b|birth|\bdob\b|geboren|geburtsdatum|\bnée?\b|naissance|nacid|nacimiento",
    "name": "name|dear|signed|regards|sincerely|patient|customer|client|liebe|geehrte|cher|chère|estimad|nombre|nom ",
    "street": "address|adresse|live|wohn|dirección|domicilio|habite|ship to|deliver",
    "mail": "e-?mail|mail|contact|kontakt|correo|courriel|write|reach",
}
COUNTER = r"(?i)(?:\b(?:version|ver|v|isbn|issn|order|invoice|page|pages|fig|figure|chapter|section|ticket|build|release|sku|part|item|rfc|article|kapitel|seite|página|chapitre)\.?:?|[#§$€£])\s*$"
OWN_WORDS = r"(?i)@|\+[0-9]{2}|\b(?:my|mine|mein|meine|mon|ma|mi|our|unser|notre|nuestro)\b"

#: Proposals beyond the base, each with a cheap test that its texts must pass.
PROPOSALS = {
    "tel": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", "[0-9]{3}[ .-][0-9]{4}"),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-[0-9]{2}-[0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "born": (r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9.-])", "[0-9][./-](?:[0-9]{2}|[12][0-9]{3})"),
    "name": (rf"(?=[A-Z])(?<![\p{{L}}0-9])(?:(?:{TITLES})\.? |(?:{GIVEN}) )\p{{Lu}}[\p{{L}}'-]{{1,30}}+(?: \p{{Lu}}[\p{{L}}'-]{{1,30}}+)?", r"[A-Z]\p{L}++\.? \p{Lu}"),
    "street": (
        rf"(?=[0-9\p{{Lu}}c])(?<![\p{{L}}0-9])(?:[0-9]{{1,5}} \p{{Lu}}\p{{L}}{{1,30}}+ (?:{STREETS})(?!\p{{L}})|\p{{Lu}}\p{{L}}{{1,30}}(?:straße|strasse|weg|gasse|platz) [0-9]{{1,4}}(?![0-9])|[0-9]{{1,5}},? rue (?:de |du |des )?\p{{L}}{{2,30}}+|[Cc]alle \p{{Lu}}\p{{L}}{{1,30}}+,? [0-9]{{1,4}}(?![0-9]))",
        r"[0-9] \p{Lu}|[egz] [0-9]|[0-9],? rue |alle \p{Lu}",
    ),
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[] ?dot ?[)\]] ?|\.)[A-Za-z]{2,24}", r"(?i)[(\[] ?at ?[)\]]"),
}

LABELERS = ("form", "gazetteer", "before", "after", "counter", "company", "numbers")
SHAPE = ("size", "left", "right")
#: Rows the table of counts can have: kinds, votes of the form and of the gazetteer, five labelers that vote one way or abstain, shapes.
PATTERNS = len(KINDS) * 2 * 3 * 3 * 2**5 * 3**3
#: Characters of context, pieces whose places are summed up together, steps of the estimation, and the weight of its prior.
NEAR_BEFORE, NEAR_AFTER, STRETCH, ROUNDS, PRIOR = 40, 24, 512, 200, 5.0
#: All counts together weigh this much beside the penalty of the classifier, at every size of the corpus.
WEIGHT, PENALTY = 10_000, 1.0
_MARK, _OTHER = chr(0xFFFF), chr(0xFFFE)


# ── matches ───────────────────────────────────────────────────────────────────
# Expressions are written as SQL: there are some hundred parts, and each would be a call of its own as a column.


def quoted(pattern: str) -> str:
    return f'r"{pattern}"'


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def matches(text: str, pattern: str) -> str:
    """start, end, value of every match, with the text before and after it up to the next match; null if there is none.

    Marks are put around the matches and the text is split at them: gaps and matches in turn. Places are sums of lengths, first within
    stretches and then over them, so that the work follows the length of the text.
    """
    running = "aggregate({values}, struct({start} AS at, CAST(array() AS array<int>) AS out), (acc, n) -> struct(acc.at + n AS at, concat(acc.out, array(acc.at)) AS out), acc -> acc.out)"
    part = f"slice(lengths, b * {STRETCH} + 1, {STRETCH})"
    numbers = f"sequence(0, CAST((size(lengths) - 1) div {STRETCH} AS INT))"
    sums = f"transform({numbers}, b -> aggregate({part}, 0, (acc, n) -> acc + n))"
    places = bind(running.format(values=sums, start="0"), "firsts", f"flatten(transform({numbers}, b -> {running.format(values=part, start='get(firsts, b)')}))")
    row = f"""transform(sequence(1, size(p) - 2, 2), i -> struct(
        get(at, i) AS start, get(at, i) + length(get(p, i)) AS end, get(p, i) AS value,
        substring(get(p, i - 1), -{NEAR_BEFORE}, {NEAR_BEFORE}) AS before, substring(get(p, i + 1), 1, {NEAR_AFTER}) AS after))"""
    found = bind(bind("transform(p, x -> length(x))", "lengths", places), "at", row)
    return bind(f"split(regexp_replace({text}, {quoted(pattern)}, '{_MARK}$0{_MARK}'), '{_MARK}', -1)", "p", f"CASE WHEN size(p) > 1 THEN {found} END")


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def passes(kind: str, value: str) -> str:
    """Whether a match of a base pattern is reported."""
    if kind == "ip":
        return f"{value} RLIKE " + quoted(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return f"luhn_check({digits(value)})"
    if kind == "phone":
        return f"length({digits(value)}) BETWEEN 10 AND 15"
    return "true"


# ── labelers ──────────────────────────────────────────────────────────────────


def well_formed(kind: str, v: str) -> str:
    """Whether the form of a candidate is that of its kind; null where the form says nothing."""
    if kind == "email":
        return f"{v} RLIKE {quoted(r'^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,24}$')} AND NOT contains({v}, '..')"
    if kind == "card":
        return f"{passes(kind, v)} AND {v} RLIKE '^[2-6]'"
    if kind in BASE:
        return passes(kind, v)
    if kind == "tel":
        return f"{v} RLIKE {quoted(r'^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]')}"
    if kind == "ssn":
        return f"{v} RLIKE {quoted('^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$')}"
    if kind == "iban":
        # The account number with its head moved to the end, letters as numbers, leaves 1 by 97.
        number = "(ascii(c) - CASE WHEN c RLIKE '[0-9]' THEN 48 ELSE 55 END)"
        rest = f"aggregate(split(concat(substring(a, 5), substring(a, 1, 4)), ''), 0, (acc, c) -> CASE WHEN c = '' THEN acc ELSE (acc * CASE WHEN {number} > 9 THEN 100 ELSE 10 END + {number}) % 97 END)"
        return bind(f"replace({v}, ' ', '')", "a", f"length(a) BETWEEN 15 AND 34 AND {rest} = 1")
    if kind == "born":
        days = ", ".join(f"try_to_date({v}, '{f}')" for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy"))
        return f"CASE WHEN coalesce({days}) IS NULL THEN false END"
    return "true" if kind == "mail" else "CAST(NULL AS BOOLEAN)"


def in_gazetteer(kind: str, v: str) -> str:
    """Whether a list of names knows a candidate; null where no list does."""
    if kind in ("email", "mail"):
        return f"CASE WHEN {v} RLIKE {quoted(rf'(?i)(?:@|[)\]] ?)(?:{PROVIDERS})\b')} THEN true END"
    if kind == "phone":
        return f"CASE WHEN {v} RLIKE {quoted(rf'^\+(?:{CODES})\b')} THEN true END"
    if kind == "iban":
        return f"{v} RLIKE '^(?:{ACCOUNTS})'"
    if kind == "ip":
        return f"CASE WHEN {v} RLIKE {quoted(r'^(?:0|127|255)\.')} THEN false END"
    if kind == "name":
        return f"CASE WHEN {v} RLIKE {quoted(rf'(?:^|[ .])(?:{GIVEN})\b')} THEN true END"
    return "true" if kind == "street" else "CAST(NULL AS BOOLEAN)"


def votes(kind: str) -> dict[str, str]:
    """1 for personal data, -1 against it, 0 without an opinion, by labeler, for a match ``m``."""
    cue = quoted(f"(?i)(?:{CUES[kind]})")
    figures = quoted(r"^[0-9\s.,;:|/+()-]{12,}$")
    own = quoted(OWN_WORDS)
    either = lambda c: bind(c, "x", "CASE WHEN x THEN 1 WHEN NOT x THEN -1 ELSE 0 END")
    return {
        "form": either(well_formed(kind, "m.value")),
        "gazetteer": either(in_gazetteer(kind, "m.value")),
        "before": f"int(m.before RLIKE {cue})",
        "after": f"int(m.after RLIKE {cue})",
        "counter": f"-int(m.before RLIKE {quoted(COUNTER)})",
        "company": f"int(m.before RLIKE {own} OR m.after RLIKE {own})",
        "numbers": f"-int(substring(m.before, -16, 16) RLIKE {figures} OR substring(m.after, 1, 16) RLIKE {figures})",
    }


def shape() -> dict[str, str]:
    """Length in three classes, and what stands on either side: nothing or white space, a letter or figure, a sign."""
    side = lambda c: bind(c, "x", f"CASE WHEN x = '' OR x RLIKE {quoted(chr(92) + 's')} THEN 0 WHEN x RLIKE {quoted('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} THEN 1 ELSE 2 END")
    return {
        "size": "CASE WHEN length(m.value) < 12 THEN 0 WHEN length(m.value) < 24 THEN 1 ELSE 2 END",
        "left": side("substring(m.before, -1, 1)"),
        "right": side("substring(m.after, 1, 1)"),
    }


def candidates(text: str = "text") -> Column:
    """Everything that is proposed: kind, start, end, base (whether it is a base span), votes, shape."""
    fields = "kind:string,start:int,end:int,base:boolean," + ",".join(f"{n}:int" for n in (*LABELERS, *SHAPE))
    tests = {"email": f"contains({text}, '@')", "ip": f"{text} RLIKE {quoted('[0-9][.][0-9]')}", "card": f"{text} RLIKE '[0-9][ -]?[0-9]'", "phone": f"contains({text}, '+')"}
    tests |= {k: f"{text} RLIKE {quoted(t)}" for k, (_, t) in PROPOSALS.items()}
    patterns = dict(zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True)) | {k: p for k, (p, _) in PROPOSALS.items()}
    parts = []
    for kind in KINDS:
        base = passes(kind, "m.value") if kind in BASE else "false"
        rest = ", ".join(f"{c} AS {n}" for n, c in (votes(kind) | shape()).items())
        rows = f"transform({matches(text, patterns[kind])}, m -> struct('{kind}' AS kind, m.start AS start, m.end AS end, {base} AS base, {rest}))"
        parts.append(f"coalesce(CASE WHEN {tests[kind]} THEN {rows} END, CAST(array() AS array<struct<{fields}>>))")
    return F.expr(f"concat({', '.join(parts)})")


# ── estimation ────────────────────────────────────────────────────────────────


@dataclass
class SpanModel:
    """Reliabilities (labeler, class, vote) of the estimation, and the weights of the classifier by feature."""

    reliability: dict[str, list[list[float]]]
    weights: dict[str, float]

    def score(self, c: str) -> str:
        """The probability that candidate ``c`` is personal data; 0 if no labeler is for it."""
        if self.weights["bias"] == -math.inf:
            return "0D"
        parts = [f"{self.weights['bias']!r}D"]
        for name in ("kind", *LABELERS, *SHAPE):
            known = [f"WHEN '{k.split('=')[1]}' THEN {w!r}D" for k, w in sorted(self.weights.items()) if k.startswith(f"{name}=")]
            parts.append(f"CASE CAST({c}.{name} AS STRING) {' '.join(known)} ELSE 0D END")
        spoken_for = f"greatest({', '.join(f'{c}.{n}' for n in LABELERS)}) > 0"
        return f"CASE WHEN {spoken_for} THEN 1 / (1 + exp(-({' + '.join(parts)}))) ELSE 0D END"


def estimate(counts: Sequence[tuple[str, tuple[int, ...], int]]) -> tuple[list[float], dict[str, list[list[float]]]]:
    """Expectation-maximisation over (kind, votes, number): the probability of each row, and the labelers' reliabilities.

    Labelers are taken as independent given the truth, each with its own chances of a vote for, against or none. A weak prior
    holds them to be right rather than wrong, and kinds to be true as often as not; it starts from the votes' sum.
    """
    v = np.array([r[1] for r in counts]).reshape(len(counts), len(LABELERS))
    n = np.array([r[2] for r in counts], float)
    kinds = [KINDS.index(r[0]) for r in counts]
    q = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
    prior = PRIOR * np.array([[1.0, 1.0, 0.5], [0.5, 1.0, 1.0]])  # class 0 and 1; votes -1, 0, 1
    theta = np.zeros((len(LABELERS), 2, 3))
    for _ in range(ROUNDS):
        weight = np.stack([n * (1 - q), n * q])
        for k in range(len(LABELERS)):
            for vote in (-1, 0, 1):
                theta[k, :, vote + 1] = weight[:, v[:, k] == vote].sum(axis=1)
            theta[k] += prior
            theta[k] /= theta[k].sum(axis=1, keepdims=True)
        per_kind = np.stack([np.bincount(kinds, w, len(KINDS)) + PRIOR for w in weight])
        log = np.log(per_kind[:, kinds])
        for k in range(len(LABELERS)):
            log = log + np.log(theta[k][:, v[:, k] + 1])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-9:
            break
    return q.tolist(), {name: theta[k].tolist() for k, name in enumerate(LABELERS)}


def train(rows: Sequence[Mapping]) -> SpanModel:
    """The model of a table of counts: kind, votes, shape and ``n``. Rows that no labeler is for are left out."""
    rows = sorted((r for r in rows if max(r[x] for x in LABELERS) > 0), key=lambda r: [str(r[x]) for x in ("kind", *LABELERS, *SHAPE)])
    if not rows:
        return SpanModel({}, {"bias": -math.inf})
    grouped: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in rows:
        key = (r["kind"], tuple(r[x] for x in LABELERS))
        grouped[key] = grouped.get(key, 0) + r["n"]
    q, reliability = estimate([(k, v, n) for (k, v), n in grouped.items()])
    truth = dict(zip(grouped, q, strict=True))
    names: dict[str, int] = {"bias": 0}
    for r in rows:
        for x in ("kind", *LABELERS, *SHAPE):
            names.setdefault(f"{x}={r[x]}", len(names))
    x = np.zeros((len(rows), len(names)))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        for c in ("kind", *LABELERS, *SHAPE):
            x[i, names[f"{c}={r[c]}"]] = 1
    n = np.array([r["n"] for r in rows], float)
    n *= WEIGHT / n.sum()
    y = np.array([truth[r["kind"], tuple(r[c] for c in LABELERS)] for r in rows])
    w = np.zeros(len(names))
    held = np.full(len(names), PENALTY)
    held[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + held * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(held)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(reliability, dict(zip(names, w.tolist(), strict=True)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end, score; by start, then kind, then end; empty if there is none).

    Spans of the base patterns have score 1. Others need a probability of ``threshold`` and must not overlap a base span. Reliabilities and
    weights are learnt from all rows. A null text is empty; null and equal ids and repeated rows stay rows of their own; other
    columns are ignored; an empty table, or one without candidates, gives no added spans.
    """
    # The mark of ``matches`` is no character of a text.
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    text = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    found = stash(docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).select("doc_id", candidates().alias("found")), "spans")
    columns = ("kind", *LABELERS, *SHAPE)
    each = found.where(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.*")
    # At most PATTERNS rows, whatever the size of the corpus.
    model = train([r.asDict() for r in each.groupBy(*columns).agg(F.count("*").alias("n")).collect()])
    kinds = ", ".join(f"'{k}'" for k in ADDED)
    score = model.score("c")
    free = "NOT exists(held, b -> b.start < c.end AND b.end > c.start)"
    added = bind("filter(found, c -> c.base)", "held", f"filter(found, c -> c.kind IN ({kinds}) AND {score} >= {threshold!r}D AND {free})")
    places = ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS))
    keyed = f"transform(concat(filter(found, c -> c.base), {added}), c -> struct(c.start AS start, map({places})[c.kind] AS place, c.end AS end, c.kind AS kind, CASE WHEN c.base THEN 1D ELSE {score} END AS score))"
    spans = f"transform(array_sort({keyed}), s -> struct(s.kind AS kind, s.start AS start, s.end AS end, s.score AS score))"
    return found.select("doc_id", F.expr(f"CASE WHEN size(found) > 0 THEN {spans} ELSE CAST(array() AS array<struct<kind:string,start:int,end:int,score:double>>) END").alias("spans"))
