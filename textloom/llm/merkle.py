"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof for every row.

The method is a rollup of nested structs. Rows are ranked within their group, and the digits of a rank say where a row stands in the
tree. Blocks hold the rows that agree in all but the last ``HEIGHT`` digits; within a block one digit after the other is
grouped away, and each grouping nests the structs of its run in the struct of their parent. The blocks' digests are the nodes of
the next round, so a group of any size becomes many small blocks and no task holds more than one block at a time. On the
way down a block meets the path of its own node by one grouping, and two steps of transform and explode give each child its siblings: proofs
are emitted without joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.llm.common import partitions, stash

#: Nodes of a run, and digits that are grouped away within a block: a block holds at most FAN ** HEIGHT nodes.
FAN, HEIGHT = 16, 2
PATH = "struct<levels:array<struct<left:string,right:string>>,subroot:string,root:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row: every value as ``-`` if null, else as its length in UTF-8 bytes, a colon and the value."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(F.concat(*[part(c) for c in columns]))


def ranked(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0, among those with the same ``key`` (never null) and ``n``, how many they are.

    Rows are laid out by ranges of (key, order), so a key with most of the rows spreads over many partitions; counts
    per key and partition, at most one more than there are partitions and keys, turn places in a partition into ranks.
    """
    laid = rows.repartitionByRange(partitions(rows), key, *order).sortWithinPartitions(key, *order)
    laid = stash(laid.withColumn("_at", F.monotonically_increasing_id()), "laid").withColumn("_part", F.shiftright("_at", 33))
    heads = laid.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_part", key, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return laid.join(heads, ["_part", key]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def blocks(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """One row per block of ``nodes`` (key, rank, n, hash, item): key, n, block, node; a node nests those below it as ``kids``.

    A run becomes the digest of its nodes' digests as long as there are several nodes on its level, else its only node goes up as it is.
    """
    digit = [f"d{k}" for k in range(height)]
    out = nodes.select(
        "key",
        "n",
        F.expr(f"rank div {fan**height}").alias("block"),
        *[F.expr(f"int(rank div {fan**k} % {fan})").alias(digit[k]) for k in range(height)],
        F.struct(F.expr(f"int(rank % {fan})").alias("place"), "hash", "item").alias("node"),
    ).repartition(partitions(nodes), "key", "block")
    for k in range(height):
        above = digit[k + 1 :]
        runs = out.groupBy("key", "n", "block", *above).agg(F.sort_array(F.collect_list("node")).alias("run"))
        together = digest(F.array_join(F.transform("run", lambda x: x["hash"]), ""))
        mark = F.when(F.col("n") > fan**k, together).otherwise(F.col("run")[0]["hash"])
        place = F.col(above[0]) if above else F.lit(0)
        out = runs.select("key", "n", "block", *above, F.struct(place.alias("place"), mark.alias("hash"), F.col("run").alias("kids")).alias("node"))
    return out


def rise(nodes: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, from the lowest, and the top (key, hash) of each key."""
    rounds = []
    while True:
        made = stash(blocks(nodes, fan, height), "blocks")
        rounds.append(made)
        nodes = made.select("key", F.col("block").alias("rank"), F.expr(f"(n + {fan**height - 1}) div {fan**height}").alias("n"), F.col("node.hash").alias("hash"), F.col("block").alias("item"))
        if (made.agg(F.max("n")).first()[0] or 0) <= fan**height:
            return rounds, nodes.select("key", "hash")


def sink(rounds: Sequence[DataFrame], paths: DataFrame, fan: int, height: int) -> DataFrame:
    """(key, item, hash, path) of the lowest nodes; ``paths`` (key, path) has the way from each top upwards."""
    paths = paths.select("key", F.lit(0).cast("long").alias("block"), "path")
    for n, made in reversed(list(enumerate(rounds))):
        # A block and the path of its node meet as rows of one group.
        both = made.unionByName(paths, allowMissingColumns=True).groupBy("key", "block").agg(*[F.first(c, True).alias(c) for c in ("n", "node", "path")])
        out = both.select("key", "n", F.col("node.kids").alias("run"), "path")
        for k in reversed(range(height)):
            out = out.select("key", "n", "path", F.explode(let(F.col("run"), lambda run: beside(run, fan))).alias("x"))
            levels = F.when(F.col("n") > fan**k, F.concat(F.array("x.side"), "path.levels")).otherwise(F.col("path.levels"))
            path = F.struct(levels.alias("levels"), "path.subroot", "path.root").alias("path")
            out = out.select("key", "n", path, F.col("x.node.kids").alias("run")) if k else out.select("key", F.col("x.node.item").alias("item"), F.col("x.node.hash").alias("hash"), path)
        paths = out.select("key", F.col("item").alias("block"), "path") if n else out
    return paths


def beside(run: Column, fan: int) -> Column:
    """Each node of a run with the digests to its left and to its right, run together."""

    def sides(hashes: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            left = F.array_join(F.slice(hashes, F.lit(1), i), "")
            right = F.array_join(F.slice(hashes, i + 2, F.lit(fan)), "")
            return F.struct(x.alias("node"), F.struct(left.alias("left"), right.alias("right")).alias("side"))

        return F.transform(run, one)

    return let(F.transform(run, lambda x: x["hash"]), sides)


def fold(start: Column, levels: Column) -> Column:
    """The root that ``start`` leads to along ``levels`` of siblings."""
    return F.aggregate(levels, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(levels: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(levels, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(
    rows: DataFrame,
    columns: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    claimed: Mapping[str, Column] | None = None,
    fan: int = FAN,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of ``rows``: id, leaf, claimed_leaf, subroot, root, levels (array of left and right, lowest first).

    ``leaf`` covers ``columns``, in this order; ``claimed_leaf`` is the leaf with the columns of ``claimed`` put in the place of those in
    ``rows``, as someone might hand the row over. Rows of a group ascend by id, a null id first; rows with equal ids
    follow their leaves, and rows that are equal altogether hold consecutive places, each with a proof of its own. A null group is a group and comes
    first; groups ascend by their UTF-8 bytes. Null values and empty texts differ. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    own = leaf([rows[c] for c in columns])
    other = leaf([(claimed or {}).get(c, rows[c]) for c in columns]) if claimed else own
    group = rows[group_col].cast("string")
    leaves = rows.select(
        rows[id_col].alias("id"),
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("key"),
        own.alias("hash"),
        *([other.alias("claimed")] if claimed else []),
        F.monotonically_increasing_id().alias("uid"),
    )
    leaves = stash(leaves if claimed else leaves.withColumn("claimed", F.col("hash")), "leaves")
    nodes = ranked(leaves, "key", ["id", "hash", "uid"]).select("key", "rank", "n", "hash", F.struct("id", "claimed").alias("item"))
    rounds, subroots = rise(nodes, fan, height)
    groups = ranked(subroots.select(F.lit("").alias("key"), "hash", F.col("key").alias("item")), "key", ["item"])
    upper, roots = rise(groups, fan, height)
    top = roots.select("key", F.struct(F.array().cast("array<struct<left:string,right:string>>").alias("levels"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("path"))
    ways = sink(upper, top, fan, height)
    ways = ways.select(F.col("item").alias("key"), F.struct("path.levels", F.col("hash").alias("subroot"), "path.root").alias("path"))
    out = sink(rounds, ways, fan, height)
    return out.select(F.col("item.id").alias(id_col), F.col("hash").alias("leaf"), F.col("item.claimed").alias("claimed_leaf"), "path.subroot", "path.root", "path.levels")
