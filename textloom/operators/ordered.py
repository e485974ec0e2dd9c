"""Running values over long ordered groups.

A window partitioned by session puts a whole session into one task. When one session may hold a third of the table, that
task never ends. ``ordered_scan`` therefore works on slices: stretches of a group's order that hold a limited number of
rows each. Every slice is processed on its own, a small table with one row per slice carries the totals from slice to slice,
and the two are joined on the slice key, so the large side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_SLICE = 2_000_000
#: Sampled rows for each border, and how many reach the driver at most.
PER_BORDER, MOST_SAMPLED = 40, 400_000


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> Column | None:
    """A slice number that never decreases with (keys, order), or None if one slice is enough.

    A sample of at most ``MOST_SAMPLED`` positions sets the borders, in the whole order of keys and rows: a slice holds about
    ``rows_per_slice`` rows, whichever groups and positions they belong to. Rows with equal or NULL positions are told apart by the later
    columns of ``order``. The borders are one constant of the plan and a row finds its slice by halving.
    """
    total = df.count()
    if total <= rows_per_slice:
        return None
    parts = min(-(-total // rows_per_slice), MOST_SAMPLED // PER_BORDER)
    names = [*keys, *order]
    places = df.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("at"))
    share = min(1.0, parts * PER_BORDER / total)
    some = places if share == 1.0 else places.sample(share, 7)
    listed = F.array_sort(F.collect_list("at"))
    # Every so manieth of the sorted sample, as text that Spark reads back in the same types.
    ranks = F.sequence(F.lit(1), F.lit(parts - 1).cast("bigint"))
    picked = F.transform(ranks, lambda i: F.get(F.col("all"), F.floor(i * F.size("all") / F.lit(parts)).cast("int")))
    sampled = some.limit(2 * MOST_SAMPLED).agg(listed.alias("all"))
    borders = sampled.select(F.to_json(picked, {"ignoreNullFields": "false"}).alias("j")).first()["j"]
    if borders is None or parts < 2:
        return None
    kind = places.schema["at"].dataType
    known = F.from_json(F.lit(borders), T.ArrayType(kind))
    at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    halves = [1 << k for k in reversed(range((parts - 1).bit_length()))]

    def halve(low: Column, step: Column) -> Column:
        return F.when((low + step <= parts - 1) & (F.get(known, low + step - 1) <= at), low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), halve).cast("bigint")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``; ``order`` must be total within ``keys``.

    ``sums``      sum of the expression over this row and all earlier ones
    ``lasts``     latest non-null value of the expression at or before this row
    ``previous``  value of the expression on the row just before
    """
    sums, lasts, previous = dict(sums or {}), dict(lasts or {}), dict(previous or {})
    rank = [F.col(c) for c in order]
    if slice_by is None:
        whole = Window.partitionBy(*keys).orderBy(*rank)
        run = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = {n: F.sum(e).over(run) for n, e in sums.items()}
        out |= {n: F.last(e, ignorenulls=True).over(run) for n, e in lasts.items()}
        out |= {n: F.lag(e).over(whole) for n, e in previous.items()}
        return df.withColumns(out)

    base = df.withColumn("_slice", slice_by)
    at = F.struct(*rank)
    heads = base.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_rows"),
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_l_{n}") for n, e in lasts.items()],
        *[F.max_by(F.struct(e.alias("v")), at).alias(f"_p_{n}") for n, e in previous.items()],
    )
    before = Window.partitionBy(*keys).orderBy("_slice")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_kslice"),
        *[F.sum(f"_s_{n}").over(past).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(past).alias(f"_l_{n}") for n in lasts],
        *[F.lag(f"_p_{n}").over(before).alias(f"_p_{n}") for n in previous],
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*rank)
    run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = base.withColumns(
        {f"_ls_{n}": F.sum(e).over(run) for n, e in sums.items()}
        | {f"_ll_{n}": F.last(e, ignorenulls=True).over(run) for n, e in lasts.items()}
        | {f"_lp_{n}": F.lag(F.struct(e.alias("v"))).over(local) for n, e in previous.items()}
    )
    match = part["_slice"].eqNullSafe(carry["_kslice"])
    for i, k in enumerate(keys):
        match = match & part[k].eqNullSafe(carry[f"_k{i}"])
    return part.join(carry, match, "left").select(
        *df.columns,
        *[
            F.when(F.col(f"_ls_{n}").isNull() & F.col(f"_s_{n}").isNull(), None)
            .otherwise(F.coalesce(f"_ls_{n}", F.lit(0)) + F.coalesce(f"_s_{n}", F.lit(0)))
            .alias(n)
            for n in sums
        ],
        *[F.coalesce(f"_ll_{n}", f"_l_{n}").alias(n) for n in lasts],
        *[F.coalesce(f"_lp_{n}", f"_p_{n}").getField("v").alias(n) for n in previous],
    )


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, spread: int = 64) -> DataFrame:
    """The last ``n`` rows of every group by ``order``.

    Each group is first cut to ``n`` rows in ``spread`` independent shares, so the final ranking sees at most
    ``n * spread`` rows of any group however large it is.
    """
    newest = [F.col(c).desc() for c in order]
    share = F.pmod(F.xxhash64(*order), F.lit(spread))
    first = Window.partitionBy(*keys, "_share").orderBy(*newest)
    final = Window.partitionBy(*keys).orderBy(*newest)
    return (
        df.withColumn("_share", share)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .where(F.col("_rank") <= n)
        .drop("_share", "_rank")
    )
