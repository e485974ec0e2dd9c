"""Values that look like personal data: detection, decisions, masking, withholding.

Input frames have an id column, a ``source`` and a text column. Decisions are rows (source, norm_value, decision) with
``*`` for every source and ``allow`` or ``mask`` as decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.identifiers import (
    MATCH,
    OWN_TOKEN,
    RESERVED,
    decision_value,
    own_token,
    scan_surface,
    shape_matches,
)
from textloom.functions.text import SPAN, let, rebuild, regex_spans
from textloom.session import ROWS_PER_TASK, cut_lineage, once

# The words of a decision.
DECISIONS = ("allow", "mask")
#: Decisions that are broadcast at most, and their characters.
SMALL_DECISIONS, DECISION_CHARS = 200_000, 32_000_000
#: Tasks that matches of one value are dealt to at most.
DEALT = 16
#: Decisions that a join with matches broadcasts at most, and their characters. Spark would go by the size of their files, or by bytes after compression.
FEW_DECISIONS, FEW_CHARS = 10_000, 1_000_000
#: Parts in which the rows of a task look up their tokens, and pairs of a part and a token that a task holds at most.
BUCKETS_PER_TASK, ASKED = 5, 200_000
DECIDED = MATCH.replace("rank:int", "rank:int,decision:string")


def detect_pii_shapes(df: DataFrame, text: str = "text", out: str = "matches", any_case: bool = False) -> DataFrame:
    """Add the matches found in one text column. Narrow: no row leaves its partition."""
    return df.withColumn(out, shape_matches(scan_surface(F.col(text)), any_case))


def match_rows(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per match. The text itself does not travel on."""
    found = df.select(*keep, F.explode(shape_matches(scan_surface(F.col(text)))).alias("m"))
    return found.select(*keep, "m.start", "m.end", "m.shape", "m.value", decision_value(F.col("m.value")).alias("norm_value"))


def pii_shape_report(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Matches and distinct values by source and shape."""
    rows = match_rows(df, [source], text)
    # Two steps, so that no task holds all values of a large source.
    values = rows.groupBy(source, "shape", "norm_value").agg(F.count("*").alias("n"))
    return values.groupBy(source, "shape").agg(F.sum("n").alias("matches"), F.count("*").alias("distinct_values"))


def fixed_decisions(decisions: DataFrame) -> DataFrame:
    """One row per source and value. Any word but ``allow`` and ``mask`` decides nothing, and of several decisions the safest holds."""
    word = F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.lit("pending"))
    # In alphabetical order the safer word is the later one.
    return decisions.where("source IS NOT NULL AND norm_value IS NOT NULL").groupBy("source", "norm_value").agg(F.max(word).alias("decision"))


def apply_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add ``decision``: one made for all sources, else one made for this source, else ``pending``.

    A value that most texts hold is dealt to ``DEALT`` tasks. No more than ``FEW_DECISIONS`` are gathered on the driver.
    """
    return _apply_fixed(matches, cut_lineage(fixed_decisions(decisions)))


def _apply_fixed(matches: DataFrame, unique: DataFrame) -> DataFrame:
    general = unique.where("source = '*'").select("norm_value", F.col("decision").alias("_general"))
    local = unique.where("source <> '*'").withColumnRenamed("decision", "_local")
    mixed = matches.withColumn("_deal", F.pmod(F.hash(*matches.columns), F.lit(DEALT)).cast("int"))
    return (
        _look_up(_look_up(mixed, general, ["norm_value"]), local, ["source", "norm_value"])
        .withColumn("decision", F.coalesce("_general", "_local", F.lit("pending")))
        .select(*matches.columns, "decision")
    )


def _look_up(mixed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    rows, chars = known.agg(F.count("*"), F.sum(F.length(F.concat(*keys)))).first()
    if rows <= FEW_DECISIONS and (chars or 0) <= FEW_CHARS:
        return mixed.join(F.broadcast(known), keys, "left")
    dealt = known.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return mixed.join(dealt.hint("merge"), [*keys, "_deal"], "left")


def mask_counts(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Masked, allowed and pending matches per key."""
    return decided.groupBy(*keys).agg(
        F.count_if(F.col("decision") == "mask").alias("masked"),
        F.count_if(F.col("decision") == "allow").alias("allowed"),
        F.count_if(F.col("decision") == "pending").alias("pending"),
    )


def distinct_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first match of every normalised value within ``keys``."""
    first = F.min_by(F.struct("start", "end", "shape", "value"), F.struct("start", "end"))
    return matches.groupBy(*keys, "norm_value").agg(first.alias("m")).select(*keys, "norm_value", "m.*")


def row_key(*columns: Column) -> Column:
    """A key made of what a row holds. Ids may be NULL or repeated, contents may not be mistaken for each other."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def counted_matches(text: Column, raw: Column | None) -> Column:
    """The matches of a text. With ``raw``, those it lacks are left out, and those inside a token it lacks: masking put these there."""
    found = shape_matches(scan_surface(text))
    if raw is None:
        return found
    in_raw = lambda v: F.coalesce(F.contains(raw, v), F.lit(True))
    held = F.contains(text, F.lit("@@@(")) | F.contains(text, F.lit("###{"))
    put = F.when(held, F.filter(regex_spans(text, RESERVED), lambda t: ~in_raw(t["value"]))).otherwise(F.array().cast(SPAN))
    inside = lambda m, tokens: F.exists(tokens, lambda t: (m["start"] < t["end"]) & (m["end"] > t["start"]))
    return let(put, lambda tokens: F.filter(found, lambda m: in_raw(m["value"]) & ~inside(m, tokens)))


def mask_by_policy(
    df: DataFrame,
    decisions: DataFrame,
    secret: str,
    key: str = "doc_id",
    text: str = "text",
    raw: str | None = None,
    default: str = "pending",
    small_decisions: int = SMALL_DECISIONS,
) -> DataFrame:
    """Masked text with counts; ``released`` is false where a match is undecided and the text must be held back.

    With ``raw`` a match counts only if the column of that name holds it too (the text may already carry tokens); where raw is
    NULL every match counts. ``default`` ``mask`` masks whatever nobody has decided.

    Decisions are brought to the rows, never rows to each other by their ids, so ``key`` may be NULL or repeated. At most
    ``small_decisions`` of them, of bounded size, are broadcast: shapes are found once and no row leaves its partition. More are
    joined with the matches, and a text meets its own matches again by what it holds.
    """
    found = counted_matches(F.col(text), None if raw is None else F.col(raw))
    unique = cut_lineage(fixed_decisions(decisions))
    size = unique.limit(small_decisions + 1).agg(F.count("*"), F.sum(F.length("source") + F.length("norm_value"))).first()
    if size[0] <= small_decisions and (size[1] or 0) <= DECISION_CHARS:
        staged = _decide_in_place(df, unique, found)
    else:
        staged = _decide_joined(df, unique, found, [F.col(c) for c in ("source", text, *([raw] if raw else []))], F.col(text))
    settled = F.transform("_found", lambda m: F.when(m["decision"] == "pending", m.withField("decision", F.lit(default))).otherwise(m))
    token = lambda m: F.when(m["decision"] == "mask", own_token(m["value"], secret)).otherwise(m["value"])
    spans = F.transform("_found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), token(m).alias("token")))
    count = lambda d: F.size(F.filter("_found", lambda m: m["decision"] == d)).cast("bigint")
    counts = {n: count(d) for n, d in (("masked", "mask"), ("allowed", "allow"), ("pending", "pending"))}
    counted = once(staged, "_settled", settled).drop("_found").withColumnRenamed("_settled", "_found").withColumns(counts)
    rewritten = F.when(F.size("_found") > 0, rebuild(F.col(text), spans)).otherwise(F.col(text))
    written = once(counted, "_text", rewritten).withColumn(text, F.col("_text")).drop("_found", "_text")
    return written.withColumn("released", F.col("pending") == 0)


def _decide_in_place(df: DataFrame, unique: DataFrame, found: Column) -> DataFrame:
    store = df.sparkSession.sparkContext.broadcast({(r["source"], r["norm_value"]): r["decision"] for r in unique.collect()})

    @F.pandas_udf("array<string>")
    def decide(source: pd.Series, values: pd.Series) -> pd.Series:
        get = store.value.get
        return pd.Series([[get(("*", v)) or get((s, v)) or "pending" for v in vs] for s, vs in zip(source, values)], dtype=object)

    matched = once(df, "_found", found).withColumn("_values", F.transform("_found", lambda m: decision_value(m["value"])))
    # Marked as non-deterministic only to be computed once, in a step of its own.
    named = matched.withColumn("_named", decide.asNondeterministic()(F.col("source"), F.col("_values")))
    paired = F.zip_with("_found", "_named", lambda m, d: m.withField("decision", F.coalesce(d, F.lit("pending"))))
    return named.withColumn("_found", paired).drop("_values", "_named")


def _decide_joined(df: DataFrame, unique: DataFrame, found: Column, content: list[Column], text: Column) -> DataFrame:
    # Every shape holds a digit or an @. Shapes are looked for once, on the way to the join.
    likely = F.coalesce(F.contains(text, F.lit("@")) | text.rlike("[0-9]"), F.lit(False))
    plain = df.where(~likely).withColumn("_found", F.array().cast(DECIDED))
    risky = df.where(likely).withColumn("_row", row_key(*content))
    rows = risky.select("_row", "source", F.explode(found).alias("m")).select("_row", "source", "m", decision_value(F.col("m.value")).alias("norm_value"))
    decided = _apply_fixed(rows, unique)
    # Rows with the same content have the same matches, once each.
    per_row = decided.groupBy("_row").agg(F.array_sort(F.collect_set(F.col("m").withField("decision", F.col("decision")))).alias("_decided"))
    # A text that meets no decided matches has none; should it have any, they are undecided.
    undecided = F.transform(found, lambda m: m.withField("decision", F.lit("pending")))
    met = risky.join(per_row, "_row", "left")
    return plain.unionByName(once(met, "_found", F.coalesce("_decided", undecided)).drop("_row", "_decided"))


def mask_all(df: DataFrame, decisions: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``mask_by_policy``, with everything undecided masked; nothing is held back."""
    return mask_by_policy(df, decisions, secret, key, text, default="mask")


def split_quarantine(masked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be released, and rows that may not."""
    return masked.where(F.col("released")), masked.where(~F.col("released"))


def token_vault(matches: DataFrame, secret: str) -> DataFrame:
    """One row per distinct value with its token. The token is a keyed hash, so every executor and every rerun agrees."""
    values = matches.groupBy("value").agg(F.count("*").alias("uses"))
    return values.select("value", own_token(F.col("value"), secret).alias("token"), "uses")


def vault_resolve(df: DataFrame, vault: DataFrame, key: str, text: str = "text", rows: int | None = None) -> DataFrame:
    """Put values back for the tokens in the vault; unknown tokens stay. Only rows that hold a token are shuffled, and those once.

    ``rows`` is how many ``df`` has, where that is known; they are counted otherwise.
    """
    holds = F.coalesce(F.col(text).rlike(OWN_TOKEN), F.lit(False))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // ROWS_PER_TASK))
    return _resolve(df.where(holds), vault, text, parts).unionByName(df.where(~holds))


def _resolve(df: DataFrame, vault: DataFrame, text: str, parts: int) -> DataFrame:
    """Rows are dealt to buckets by what they hold. A bucket asks for each of its tokens once, and its rows meet the answers where they are."""
    hashed = [c for c, kind in df.dtypes if c == text or not re.search("map<|variant|interval|geo", kind)]
    bucket = F.pmod(F.xxhash64(*hashed), F.lit(parts * BUCKETS_PER_TASK)).alias("_bucket")
    dealt = df.select("*", bucket).repartition(parts, "_bucket")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, str]] = set()
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], t) for n, t in enumerate((pa.int64(), pa.string()))], ["_bucket", "token"])
        for batch in batches:
            for at, t in zip(batch.column("_bucket").to_pylist(), batch.column(text).to_pylist()):
                pairs.update((at, token) for token in re.findall(OWN_TOKEN, t))
                if len(pairs) >= ASKED:
                    yield flushed()
                    pairs.clear()
        if pairs:
            yield flushed()

    def answered(rows: pa.Table, known: pa.Table) -> pa.Table:
        values = dict(zip(known.column("token").to_pylist(), known.column("_value").to_pylist()))
        at = rows.schema.get_field_index(text)
        put = [re.sub(OWN_TOKEN, lambda m: values.get(m[0], m[0]), t) for t in rows.column(at).to_pylist()]
        return rows.set_column(at, rows.schema.field(at), pa.chunked_array([pa.array(put, rows.schema.field(at).type)])).drop_columns(["_bucket"])

    # All columns are asked for, though two are used: the rows are dealt once for both steps then.
    pairs = dealt.mapInArrow(asked, "_bucket long, token string")
    # The lookup is as large as the texts are many: it must not be gathered on the driver, however small it looks when it is shuffled.
    lookup = vault.where("value IS NOT NULL").groupBy("token").agg(F.min("value").alias("_value")).hint("merge")
    known = pairs.join(lookup, "token").select("_bucket", "token", "_value")
    return dealt.groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(answered, df.schema)


def replace_tokens(df: DataFrame, known: DataFrame, key: str, text: str, pattern: str, name: Column | None = None) -> DataFrame:
    """Replace every token of ``known`` (token, value) found by ``pattern``; ``name`` maps a found token to its key.

    A text meets its own tokens again by what it holds, so ``key`` may be NULL or repeated.
    """
    keyed = df.withColumn("_row", row_key(F.col(text)))
    spans = keyed.select("_row", F.explode(regex_spans(F.col(text), pattern)).alias("s"))
    hits = spans.select("_row", "s.start", "s.end", F.col("s.value").alias("_found")).distinct()
    hits = hits.withColumn("token", F.col("_found") if name is None else name)
    # The lookup is as large as the texts are many: it must not be gathered on the driver, however small it looks when it is shuffled.
    lookup = known.select("token", F.col("value").alias("_value")).hint("merge")
    per_row = (
        hits.join(lookup, "token")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("_value").alias("token")))).alias("_spans"))
    )
    text_out = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(rebuild(F.col(text), F.col("_spans")))
    return keyed.join(per_row.hint("merge"), "_row", "left").withColumn(text, text_out).select(*df.columns)
