"""The store of known values: cleaning, index, tiers, reports.

A store frame has the columns family, member (NULL for a value of the whole family), path, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.folding import fold_key, nfc_lower
from textloom.functions.identifiers import digits_of, is_numeric_text, NUMBER_FLOOR, norm_key, pii_id, value_problem
from textloom.functions.text import js_trim
from textloom.session import cut_lineage, once, shares

# The fields a member and a family are expected to have.
MEMBER_FIELDS = (
    "first_name",
    "last_name",
    "middle_name",
    "dob",
    "ssn",
    "phone",
    "email",
    "edi",
    "deers_beneficiary_id",
    "address.street",
    "address.city",
    "address.zip",
)
FAMILY_FIELDS = ("deers_family_id",)
SMALL_STORE = 200_000
#: Tasks in which the families of one value are counted first.
SPLIT = 64


def slot() -> Column:
    """The path of a value inside its family."""
    return F.concat_ws(".", F.col("member"), F.col("path"))


def after_first_dot(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"^[^.]*\.", "")).otherwise(c)


def indexed_values(values: DataFrame) -> DataFrame:
    """Rows (norm_key, family, slot, field, spelling) for every value that can be matched safely.

    Every function below that reads the index takes these rows as well as a plain store.
    """
    if "norm_key" in values.columns:
        return values
    v = js_trim(F.col("value"))
    rows = once(values.select("family", slot().alias("slot"), "value"), "spelling", v)
    short = is_numeric_text(F.col("spelling")) & (F.length(digits_of(F.col("spelling"))) < NUMBER_FLOOR)
    return (
        rows.where((F.col("spelling") != "") & ~short)
        .withColumn("norm_key", norm_key(F.col("spelling")))
        .where(F.length("norm_key") - 2 >= 2)
        .select("norm_key", "family", "slot", after_first_dot(F.col("slot")).alias("field"), "spelling")
    )


def fixed_index(values: DataFrame) -> DataFrame:
    """The index rows, written out once, for jobs that read them several times."""
    return cut_lineage(indexed_values(values).repartition(shares(values), "norm_key", "family", "slot").distinct())


def build_value_index(values: DataFrame) -> DataFrame:
    """Distinct (norm_key, path) rows. Rows rather than arrays: a value may be shared by any number of families."""
    path = F.concat_ws(".", "family", "slot").alias("path")
    return indexed_values(values).select("norm_key", path, "family", "slot").distinct()


def value_spellings(values: DataFrame) -> DataFrame:
    return indexed_values(values).select("norm_key", "spelling").distinct()


def tiered_index(values: DataFrame) -> DataFrame:
    """One row per key: counts, tier, and what its token is made of.

    A value shared by a third of all families is counted in several tasks first, and at most ``SPLIT`` small rows of it meet in one. Slots are
    kept only for keys of a single family, whose token lists them; other keys keep their distinct field names.
    """
    rows = indexed_values(values).select("norm_key", "family", "slot", "field")
    # Dealt by number: tasks would grow with the store otherwise. Nothing is joined, so no table can be gathered on the driver.
    parts = shares(rows)
    split = rows.withColumn("_split", F.pmod(F.xxhash64("family"), F.lit(SPLIT))).repartition(parts, "norm_key", "_split")
    paths = split.groupBy("norm_key", "_split", "family").agg(F.array_sort(F.collect_set(F.struct("slot", "field"))).alias("paths"))
    per_family = paths.select(
        "norm_key", "_split", "family", F.size("paths").alias("n"), F.col("paths")["slot"].alias("slots"), F.array_sort(F.array_distinct(F.col("paths")["field"])).alias("fields")
    )
    several = F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))).alias("fields")
    per_split = per_family.groupBy("norm_key", "_split").agg(
        F.sum("n").alias("n"), F.count("*").alias("families"), F.min("family").alias("family"), F.min(F.col("slots")[0]).alias("slot"), F.min("slots").alias("slots"), several
    )
    own = per_split.withColumn("slots", F.when(F.col("families") == 1, F.col("slots")))
    per_key = own.repartition(parts, "norm_key").groupBy("norm_key").agg(
        F.sum("n").alias("n_paths"), F.sum("families").alias("n_families"), F.min("family").alias("family"), F.min("slot").alias("slot"), F.min("slots").alias("slots"), several
    )
    tier = F.when(F.col("n_paths") <= 1, 1).when(F.col("n_families") == 1, 2).otherwise(3)
    slots = F.when(F.col("tier") == 2, F.col("slots")).otherwise(F.array("slot"))
    return per_key.withColumn("tier", tier).select("norm_key", "n_paths", "n_families", "family", "tier", "fields", slots.alias("slots"))


def value_tier(values: DataFrame) -> DataFrame:
    """1 for a value on one path, 2 for one on several paths of a family, 3 for one shared by families."""
    rows = build_value_index(values)
    per_family = rows.groupBy("norm_key", "family").agg(F.count("*").alias("n"))
    per_key = per_family.groupBy("norm_key").agg(F.sum("n").alias("n_paths"), F.count("*").alias("n_families"))
    tier = F.when(F.col("n_paths") <= 1, 1).when(F.col("n_families") == 1, 2).otherwise(3)
    return per_key.withColumn("tier", tier)


def dictionary(values: DataFrame, secret: str, tiers: DataFrame | None = None) -> DataFrame:
    """What matching needs: match_key, norm_key, tier, and the token (up to the anchors for a tier 3 value)."""
    head = F.format_string("###{%s across %d families", F.array_join("fields", "/"), F.col("n_families"))
    token = (
        F.when(F.col("tier") == 1, F.concat(F.lit("@@@("), F.col("family"), F.lit("."), F.col("slots")[0], F.lit(")")))
        .when(
            F.col("tier") == 2,
            F.concat(F.lit("###{"), F.array_join(F.array_sort("slots"), ", "), F.lit(" in "), F.col("family"), F.lit("}")),
        )
        .otherwise(head)
    )
    tail = F.when(F.col("tier") == 3, F.concat(F.lit(" #"), pii_id(F.col("norm_key"), secret), F.lit("}")))
    tokens = (tiered_index(values) if tiers is None else tiers).select(
        "norm_key", "tier", "n_families", F.when(F.col("tier") < 3, F.col("family")).alias("family"),
        token.alias("token"), tail.alias("tail"), F.array_join("fields", "/").alias("fields"),
    )
    spelled = value_spellings(values)
    texts = spelled.where(F.col("norm_key").startswith("t:")).select("norm_key", fold_key("spelling").alias("match_key"))
    numbers = spelled.where(F.col("norm_key").startswith("n:")).select(
        "norm_key", F.substring("norm_key", 3, 1_000_000).alias("match_key")
    )
    keys = texts.where(F.col("match_key") != "").union(numbers).distinct()
    return keys.join(tokens.hint("merge"), "norm_key")


def store_catalog(values: DataFrame) -> DataFrame:
    """Distinct fields and members of every family, as rows (family, kind, name)."""
    kind = F.when(F.col("member").isNull(), "field").otherwise("member")
    return values.select("family", kind.alias("kind"), F.coalesce("member", "path").alias("name")).distinct()


def field_status(records: DataFrame, values: DataFrame, fields: tuple[str, ...] = MEMBER_FIELDS) -> DataFrame:
    """``filled``, ``blank`` or ``extra`` for every (family, member) and field."""
    wanted = records.select("family", "member").distinct().select(
        "family", "member", F.explode(F.array(*[F.lit(f) for f in fields])).alias("path")
    )
    have = values.groupBy("family", "member", "path").agg(F.max(F.coalesce(js_trim(F.col("value")), F.lit("")) != "").alias("full"))
    known = F.col("path").isin(*fields)
    status = F.when(~known, "extra").when(F.coalesce("full", F.lit(False)), "filled").otherwise("blank")
    joined = wanted.join(have, ["family", "member", "path"], "full")
    return joined.where(known | F.col("full")).select("family", "member", "path", status.alias("status"))


def reject_common(values: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``problem``: why a value must not be stored. ``words`` (word) lists everyday words, in lower case."""
    # Marked as non-deterministic, or the test of the join for NULL would take the function below the counting of words, to all texts.
    lowered = nfc_lower.asNondeterministic()
    common = words.select(lowered(F.col("word")).alias("_word")).distinct().withColumn("_common", F.lit(True))
    keyed = values.withColumn("_key", lowered(js_trim(F.col("value"))))
    joined = keyed.join(common, keyed["_key"] == common["_word"], "left")
    problem = value_problem(F.col("value"), F.coalesce("_common", F.lit(False)))
    return joined.withColumn("problem", problem).select(*values.columns, "problem")


def expand_descriptor(ids: DataFrame, values: DataFrame, secret: str) -> DataFrame:
    """Every path behind an id. ``status`` is ``ok``, ``unknown`` or ``ambiguous``; paths are given only for ``ok``."""
    clean = F.regexp_replace(F.lower(F.col("id")), "[^0-9a-f]", "")
    wanted = ids.select(clean.alias("id")).distinct()
    keys = build_value_index(values).select("norm_key").distinct().select("norm_key", pii_id(F.col("norm_key"), secret).alias("id"))
    hits = wanted.join(keys, "id", "left").groupBy("id").agg(F.count("norm_key").alias("n"), F.min("norm_key").alias("norm_key"))
    status = F.when(F.length("id") != 16, "invalid").when(F.col("n") == 0, "unknown").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    paths = build_value_index(values).select("norm_key", "path")
    judged = hits.withColumn("status", status).withColumn("norm_key", F.when(F.col("status") == "ok", F.col("norm_key")))
    return judged.join(paths, "norm_key", "left").select("id", "status", "path")
