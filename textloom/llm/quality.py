"""Quality classifier: a sparse ensemble of rules over statistics of the whole text.

Boosted trees of small depth are grown on a bounded sample of labelled rows; every path from a root is a conjunctive rule. A
logistic regression with a lasso penalty gives the rules weights, most of them zero. What is left is compiled into one
Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches
from textloom.llm.shingles import PLACE_FACTORS, mix, word_hashes

#: Labelled rows that are fitted at most (those with the smallest hashes of their ids), trees, their depth, bins of a statistic.
SAMPLE, TREES, DEPTH, BINS = 20_000, 24, 3, 32
RATE, LEAST_ROWS, STEPS = 0.3, 10, 400
#: Penalties tried, from sparse to dense; the sparsest within a hundredth of the best likelihood on a fifth of the sample is taken.
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "points", "signs", "bars",
    "exclaims", "beyond_ascii", "distinct_words", "top_word", "distinct_triples", "log_lines", "line_length", "distinct_lines", "signed_words", "upper_words",
)
_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_POINT = np.isin(_BYTES, list(b".,;:?'\"()-"))
_SIGN = np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{}~"))


def statistics(text: str) -> tuple[float, ...]:
    """STATISTICS of a text; all zero for an empty one."""
    if not text:
        return (0.0,) * len(STATISTICS)
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    words = word_hashes(text)
    k = len(words)
    _, times = np.unique(words, return_counts=True) if k else (None, np.zeros(1, int))
    triples = mix(words[:-2]) + mix(words[1:-1] * PLACE_FACTORS[1]) + mix(words[2:] * PLACE_FACTORS[2]) if k > 2 else words
    gap = _SPACE[raw]
    ends = np.flatnonzero(gap[1:] & ~gap[:-1])
    ends = np.append(ends, n - 1) if not gap[-1] else ends
    last = raw[ends]
    starts = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)) == -1)
    lines = text.split("\n")
    letters = int(counts[_LETTER].sum())
    return (
        math.log1p(n), math.log1p(k), (n - counts[_SPACE].sum()) / max(k, 1), math.log1p(float((ends - starts).max()) if k else 0.0), letters / n, counts[_UPPER].sum() / max(letters, 1),
        counts[_DIGIT].sum() / n, counts[_SPACE].sum() / n, counts[_POINT].sum() / n, counts[_SIGN].sum() / n, counts[124] / n, counts[33] / n, counts[128:].sum() / n,
        len(times) / max(k, 1), times.max() / max(k, 1), len(np.unique(triples)) / max(len(triples), 1), math.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
        (~(_LETTER | _DIGIT | _POINT)[last]).mean() if k else 0.0, _UPPER[last].mean() if k else 0.0,
    )


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` and a struct column of the statistics of the whole text (null: empty)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t or "") for t in texts], columns=STATISTICS, dtype=float)

    return docs.withColumn(name, measure(F.col(text_col).cast("string")))


@dataclass(frozen=True)
class Rule:
    """Bounds that all must hold: (statistic, whether it must be above, bound)."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, f] > b) == above for f, above, b in self.bounds])

    def column(self, stats: Column) -> Column:
        tests = [(stats[STATISTICS[f]] > b) if above else (stats[STATISTICS[f]] <= b) for f, above, b in self.bounds]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: Column) -> Column:
        """The score, 0 to 1."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, bounds: tuple, rules: set[Rule], out: np.ndarray, rng) -> None:
    """Split ``rows`` where it gains most, over a random half of the statistics; every node below the root is a rule."""
    if bounds:
        rules.add(Rule(tuple(sorted(bounds))))
    best = (1e-6, None, None)
    if len(bounds) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        g, h = gradient[rows], hessian[rows]
        parent = g.sum() ** 2 / (h.sum() + 1)
        for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
            if not len(edges[f]):
                continue
            size = len(edges[f]) + 1
            gs, hs, ns = (np.bincount(binned[rows, f], v, size).cumsum()[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - parent
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k)
    if best[1] is None:
        out[rows] = -RATE * gradient[rows].sum() / (hessian[rows].sum() + 1)
        return
    _, f, k = best
    above = binned[rows, f] > k
    for side in (False, True):
        grow(x, binned, edges, gradient, hessian, rows[above == side], (*bounds, (f, side, float(edges[f][k]))), rules, out, rng)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    rng = np.random.default_rng(11)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    rules: set[Rule] = set()
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(x, binned, edges, p - y, p * (1 - p), np.sort(rng.choice(len(y), max(1, len(y) * 3 // 4), replace=False)), (), rules, step, rng)
        margin += step
    return sorted(rules, key=lambda r: r.bounds)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal steps; the bias is not penalised."""
    n, k = z.shape
    w = np.zeros(k + 1) if weights is None else weights.copy()
    v, t = w.copy(), 1.0
    design = np.concatenate([z, np.ones((n, 1))], 1)
    u = np.ones(k + 1)
    for _ in range(30):
        u = design.T @ (design @ u)
        u /= np.linalg.norm(u) or 1
    size = 4 * n / max(float(np.linalg.norm(design @ u) ** 2), 1e-12)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(design @ v, -40, 40)))
        new = v - size * (design.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_rows(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Fit on rows of statistics and labels 0 and 1. With one label only, or none, the score is that of the smoothed share."""
    if len(y) < 4 * LEAST_ROWS or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    rules = tree_rules(x, y)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    held = np.random.default_rng(5).permutation(len(y)) < len(y) // 5
    losses = []
    for penalty in PENALTIES:
        w, b = lasso(z[~held], y[~held], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[held] @ w + b))), 1e-9, 1 - 1e-9)
        losses.append(float(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()))
    penalty = next(q for q, loss in zip(PENALTIES, losses, strict=True) if loss <= min(losses) + 0.01)
    w, b = lasso(z, y, penalty)
    return RuleEnsemble(b, tuple((r, float(x)) for r, x in zip(rules, w, strict=True) if abs(x) > 1e-4))


def training_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Rows to learn from: doc_id, label, those whose crc32(doc_id as text) mod 3 is not 1; null or other labels are left out, several of one id are averaged."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label"))
    rows = rows.filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> RuleEnsemble:
    """Fit on at most ``sample`` labelled documents; only these and their statistics come to the driver. ``labels``: doc_id, label."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # Of several texts with one id the same one is taken in any order of rows, before anything comes to the driver.
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    met = with_statistics(one, "text", "stats").select("doc_id", "label", "stats.*").toPandas().sort_values("doc_id")
    return fit_rows(met[list(STATISTICS)].to_numpy(), met["label"].to_numpy())


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts are scored from statistics of zero; a null doc_id is not held out."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = with_statistics(texts, "text", "stats").select("doc_id", model.column(F.col("stats")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, with their columns."""
    name = "stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, text_col, name).filter(model.column(F.col(name)) >= least).drop(name)
