"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched by beams.

Equal vectors are one point that keeps its smallest ids, so hot vectors do not grow a shard. Points are dealt to shards of bounded
size by a hash. In a shard, points are inserted in growing batches: a greedy search proposes neighbours, relaxed distance
pruning keeps the diverse ones, and edges back are pruned where a point gets too many. Every shard is searched for every
query by a beam, the points found are scored exactly, and the best of all shards are kept.

Inner products are turned into distances by one more coordinate, the square root of what a point's squared length lacks to the longest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import partitions, stash

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH, QUERY_BLOCK = 8192, 32, 56, 120, 1.2, 512, 8192


def lifted(x: np.ndarray) -> np.ndarray:
    norms = (x**2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``beam`` nearest points met for each query (-1 where fewer), nearest first."""
    m, n = len(queries), len(points)
    norms = (points**2).sum(1)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    met = np.zeros((m, n), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = norms[start] - 2 * queries @ points[start]
    met[:, start] = True
    rows = np.arange(m)
    while True:
        waiting = np.where(done, np.inf, dist)
        at = waiting.argmin(1)
        live = rows[waiting[rows, at] < np.inf]
        if not len(live):
            break
        at = at[live]
        done[live, at] = True
        near = edges[ids[live, at]]
        fresh = (near >= 0) & ~met[live[:, None], near]
        met[np.repeat(live, near.shape[1])[fresh.ravel()], near[fresh]] = True
        far = norms[near] - 2 * np.einsum("mrd,md->mr", points[near], queries[live])
        far[~fresh] = np.inf
        all_ids = np.concatenate([ids[live], near], 1)
        all_dist = np.concatenate([dist[live], far], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        take = lambda a: np.take_along_axis(a, order, 1)
        ids[live], dist[live], done[live] = take(all_ids), take(all_dist), take(all_done)
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of ``own``, at most ``degree`` of its ``proposed`` neighbours (-1: none): the nearest, then the nearest not ``alpha`` times nearer to one already kept."""
    near = points[proposed]
    d = ((near - points[own][:, None]) ** 2).sum(2)
    d[(proposed < 0) | (proposed == own[:, None])] = np.inf
    kept = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        best = d.argmin(1)
        some = np.isfinite(d[rows, best])
        if not some.any():
            break
        kept[some, k] = proposed[rows, best][some]
        between = ((near - near[rows, best][:, None]) ** 2).sum(2)
        d[(alpha * alpha * between <= d) & some[:, None]] = np.inf
        d[rows[some], best[some]] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Out-edges of each point (-1: none) and the point where searches begin."""
    n = len(points)
    rng = np.random.default_rng(3)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.concatenate(([start], rng.permutation(np.delete(np.arange(n), start))))
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, max(1, at))]
        at += len(batch)
        ids, _ = beam_search(points, edges, start, points[batch], beam)
        proposed = np.concatenate([ids, edges[batch], np.broadcast_to(rng.choice(batch, min(len(batch), 8)), (len(batch), min(len(batch), 8)))], 1)
        edges[batch] = robust_prune(points, batch, proposed, degree, alpha)
        # Edges back: points with no room left are pruned anew.
        src = np.repeat(batch, degree)[edges[batch].ravel() >= 0]
        dst = edges[batch].ravel()
        dst = dst[dst >= 0]
        sort = np.argsort(dst, kind="stable")
        src, dst = src[sort], dst[sort]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        back = np.full((len(targets), most), -1, np.int64)
        back[np.repeat(np.arange(len(targets)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        full = (edges[targets] >= 0).sum(1) + count > degree
        for t in range(0, int(full.sum()), BATCH):
            some = np.flatnonzero(full)[t : t + BATCH]
            edges[targets[some]] = robust_prune(points, targets[some], np.concatenate([edges[targets[some]], back[some]], 1), degree, alpha)
        for t in np.flatnonzero(~full).tolist():
            row = edges[targets[t]]
            have = set(row[row >= 0].tolist())
            new = [x for x in back[t, : count[t]].tolist() if x not in have]
            free = int((row >= 0).sum())
            row[free : free + len(new)] = new
    return edges, start


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part; equal rows once."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = "NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(finite)
    return rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()


def index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(points: point, v, ids - its ``k`` + 1 smallest), (graphs: dim, shard, points, firsts - the smallest id of each, vectors, edges, start)."""
    smallest = Window.partitionBy("v").orderBy("vec_id")
    same = valid(vectors, id_col, vector_col).withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
    points = stash(same.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.monotonically_increasing_id()), "points")
    shards = max(1, -(-points.count() // SHARD))
    dealt = points.select("point", F.col("ids")[0].alias("first"), "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))

    def work(pdf):
        pdf = pdf.sort_values("point")
        x = np.stack(pdf["v"].to_numpy())
        edges, start = build_graph(lifted(x))
        return type(pdf)({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "points": [pdf["point"].to_numpy().astype("<i8").tobytes()], "firsts": [pdf["first"].to_numpy().astype("<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()], "edges": [edges.astype("<i4").tobytes()], "start": [start]})

    graphs = dealt.repartition(max(shards, partitions(points)), "dim", "shard").groupBy("dim", "shard").applyInPandas(work, "dim int, shard int, points binary, firsts binary, vectors binary, edges binary, start int")
    return points, stash(graphs, "graphs")


def search(points: DataFrame, graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query (vec_id, v): query_id, rank, vec_id, score. Points of another length than the query are no candidates.

    Every block of queries meets every graph of its dimension under a key of its own, (dim, shard, block): a task holds one graph and one block.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    key = ["dim", "shard", "block"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), "v", F.monotonically_increasing_id().alias("q"))
    asked = asked.select("*", every(shards).alias("shard"))
    held = graphs.select("*", every(blocks).alias("block"))

    def work(questions, graph):
        frames = []
        for row in graph.to_dict("records"):
            ids, firsts = np.frombuffer(row["points"], "<i8"), np.frombuffer(row["firsts"], "<i8")
            x = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
            edges = np.frombuffer(row["edges"], "<i4").reshape(len(ids), -1).astype(np.int64)
            lift = lifted(x)
            for at in range(0, len(questions), BATCH):
                some = questions.iloc[at : at + BATCH]
                q = np.stack(some["v"].to_numpy())
                found, _ = beam_search(lift, edges, row["start"], np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32), max(BEAM, k + 1))
                exact = np.einsum("mbd,md->mb", x[found], q)
                exact[found < 0] = -np.inf
                # Equal scores go by the smallest id of each point.
                best = np.lexsort((firsts[found], -exact))[:, : k + 1]
                top, score = np.take_along_axis(found, best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()
                ok = np.isfinite(score)
                n = np.repeat(np.arange(len(q)), best.shape[1])[ok]
                frames.append(type(questions)({"query_id": some["query_id"].to_numpy()[n], "q": some["q"].to_numpy()[n], "point": ids[top[ok]], "first": firsts[top[ok]], "score": score[ok]}))
        return pd.concat(frames) if frames else pd.DataFrame({c: pd.Series([], dtype="float64" if c == "score" else "int64") for c in ("query_id", "q", "point", "first", "score")})

    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(work, "query_id long, q long, point long, first long, score double")
    own = Window.partitionBy("query_id", "q")
    # Each point stands for all its ids; of the k + 1 first ones by score and smallest id one at most is the query alone.
    top = found.withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "first", "point"))).filter(F.col("r") <= k + 1)
    named = top.join(points.select("point", "ids"), "point").select("query_id", "q", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = named.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score (inner product in double precision).

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite parts take no part. Rows equal in id and vector are one; a row is
    never found for its own id; an id with several vectors asks once for each. Ties go to the smaller id. Other columns are
    ignored; an empty table gives an empty result.
    """
    points, graphs = index(vectors, k, id_col, vector_col)
    return search(points, graphs, valid(vectors, id_col, vector_col).filter(F.col("vec_id") % every == 0), k)
