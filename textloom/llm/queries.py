"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, chunks, exact, merkle, neardup, packing, pii, quality, secrets, suffix, warc, whiten
from textloom.llm.common import new_folder
from textloom.session import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(check: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(prepare(spark), folder)
        if check is not None:
            CHECKS[f.__name__] = check.strip()
        return f

    return register


@query()
def op1_graph(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"))


@query()
def op2_chunks(spark, folder):
    return chunks.dedup_chunks(table(spark, folder, "documents")).withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op3_exact(spark, folder):
    return exact.mark_duplicates(table(spark, folder, "documents"))


@query("""
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) < 100 OR page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) < 100 OR page_id = min(page_id) OVER same THEN NULL ELSE min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
""")
def op4_warc(spark, folder):
    records = warc.archive_pages(table(spark, folder, "pages"), new_folder(spark, "warc"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_secrets(spark, folder):
    return secrets.scan(table(spark, folder, "documents")).select(
        "doc_id",
        *[secrets.count_kind(k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.listed(secrets.base_spans()), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query()
def op6_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, quality.training_labels(table(spark, folder, "labels"))))


@query()
def op7_bpe(spark, folder):
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), TOKENIZER), TOKENIZER)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query()
def op8_pack(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)


@query()
def op9_suffix(spark, folder):
    return suffix.remove_repeats(table(spark, folder, "documents")).drop("spans")


@query()
def op10_minhash(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"), words=4)


def merkle_sql(fan: int = 16, levels: int = 5) -> str:
    """The manifest in SQL, level by level, for groups of at most fan ** levels rows and as many groups."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # The checksum of the decimal id, bit by bit: each byte enters before the first of its eight steps.
    steps = "flatten(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, nodes: str) -> list[str]:
        """name0 .. name<levels>: nodes (g, i, n, h) of each level; name_r<k>: their runs as lists."""
        out = [f"{name}0 AS ({nodes})"]
        for k in range(levels):
            out.append(f"{name}_r{k} AS (SELECT g, i // {fan} AS i, n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT g, i, (n + {fan - 1}) // {fan} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_r{k})")
        return out

    def joins(name: str, g: str, i: str) -> str:
        return " ".join(f"JOIN {name}_r{k} {name}{k}x ON {name}{k}x.g = {g} AND {name}{k}x.i = {i} // {fan ** (k + 1)}" for k in range(levels))

    def sides(name: str, i: str, k: int) -> tuple[str, str, str]:
        at = f"({i} // {fan**k}) % {fan}"
        return f"{name}{k}x.n > 1", f"array_to_string({name}{k}x.hs[1:{at}], '')", f"array_to_string({name}{k}x.hs[{at} + 2:], '')"

    way = [sides("s", "l.i", k) for k in range(levels)] + [sides("t", "t.i", k) for k in range(levels)]
    # The fold one level at a time, so that no digest is written out twice.
    folds, last = [], "way"
    for k in range(len(way)):
        folds.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN c{k} THEN sha256(a{k} || x || b{k}) ELSE x END AS x) FROM {last})")
        last = f"f{k}"
    sides_of = ", ".join(f"{c} AS c{k}, {a} AS a{k}, {b} AS b{k}" for k, (c, a, b) in enumerate(way))
    proof = " || ".join(f"CASE WHEN c{k} THEN a{k} || b{k} ELSE '' END" for k in range(len(way)))
    return ", ".join([
        f"""WITH leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {leaf('text')} AS h,
            CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS x FROM documents)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        *tree("s", "SELECT g, i, n, h FROM placed"),
        *tree("t", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM s{levels}"),
        f"tops AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM s{levels})",
        f"way AS (SELECT l.doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, l.x, {sides_of} FROM placed l JOIN tops t USING (g) CROSS JOIN t{levels} r {joins('s', 'l.g', 'l.i')} {joins('t', chr(39) * 2, 't.i')})",
        *folds,
    ]) + f" SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, x AS folded_root, x = root AS verified FROM {last}"


@query(merkle_sql())
def op11_merkle(spark, folder):
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(tampered, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    proofs = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], claimed={"text": text})
    folded = merkle.fold(F.col("claimed_leaf"), F.col("levels")).alias("folded_root")
    proofs = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("levels")).alias("proof_sha256"), folded)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_whiten(spark, folder):
    return whiten.whiten(table(spark, folder, "embeddings"))


@query()
def op13_pii(spark, folder):
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return pii.find(table(spark, folder, "documents")).select(
        "doc_id",
        *[secrets.count_kind(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )
