"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one counts filter positions of text digests and keeps, as a filter of fixed size, the positions met twice or
more. Pass two tests every row against the broadcast filter: rows that miss it have no equal and pass straight through; only
the others are shuffled, by their digest. Groups that hold a large share of the rows are counted before the shuffle and are
brought back to their rows by a bounded broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, id_and_text, key_filter, stash, test_filter

#: Size of the filter. It bounds the broadcast to 2**20 words; with many more rows than bits all rows are shuffled, with equal results.
FILTER_BITS = 1 << 26


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text is empty. Of equal texts the row with the largest doc_id stays, null ids last;
    of rows that are equal in both, exactly one is ``kept``. An empty table gives an empty result; other columns are ignored.
    """
    digests = stash(
        id_and_text(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("uid")),
        "digests",
    ).withColumn("h", F.xxhash64("text_sha256"))
    tested = test_filter(digests, key_filter(digests, bits, 2), bits)
    alone = tested.filter("NOT hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = stash(tested.filter("hit").select("doc_id", "text_sha256", "uid"), "candidates")
    groups = rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size"))
    met = attach(rows, groups, "text_sha256", "group_size", rows.count())
    return alone.unionByName(met.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("top.uid")).alias("kept"), "text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one of each group of equal texts (rules as above)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256).alias("digest"))
    rows = rows.withColumn("h", F.xxhash64("digest"))
    tested = test_filter(rows, key_filter(rows, bits, 2), bits)
    met = tested.filter("hit").groupBy("digest").agg(F.max_by("row", F.struct("id")).alias("row"))
    return tested.filter("NOT hit").select("row.*").unionByName(met.select("row.*"))
