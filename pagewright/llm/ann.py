"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted to a sample by k-means with a penalty on full clusters, and a neighbour graph over them is kept in
memory. There are as many as the square root of the rows asks for: beyond what one sample on the driver can hold, the
clusters of that sample are split further, each in its own task, so lists do not grow longer with the table. Each vector goes to the list of its nearest centroid and, at a boundary, to further lists whose distance
is within a ratio of the nearest. A query walks the graph, keeps the lists within a ratio of its nearest, and is compared
with every vector of those lists. Inner products become distances by one more coordinate that gives all vectors the
same norm. Scores are inner products of the original vectors in double precision.

A list that holds very many vectors, or meets very many queries, is dealt out in chunks, each searched on its own, so no
task holds more than one chunk and nothing is dropped. A query reads every list within the ratio that its walk meets: the
walk goes on with a wider beam as long as all of the beam is within it. A query whose lists hold fewer rows than it asks
for is compared with all lists. Only the sample, the centroids (as many as the root of the rows) and one count for each
list reach the driver.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
without an id. Ties go to the smaller id; a repeated id counts once, with its best score. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_map

VECTORS_A_CHUNK, QUERIES_A_CHUNK = 4096, 1024


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, penalty: float = 0.05, seed: int = 1) -> np.ndarray:
    """k-means on the rows of sample; a cluster above the mean size looks farther away, which evens the lists out."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.ones(k, dtype=np.float32)
    norm = (x * x).sum(1)
    scale = float(norm.mean()) or 1.0
    for _ in range(rounds):
        label = np.empty(len(x), dtype=np.int64)
        for s in range(0, len(x), 4096):
            d = norm[s : s + 4096, None] - 2 * x[s : s + 4096] @ centroids.T + (centroids * centroids).sum(1)
            label[s : s + 4096] = (d + penalty * scale * (load - 1)).argmin(1)
        count = np.bincount(label, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, label, x)
        full = count > 0
        centroids[full] = total[full] / count[full, None]
        centroids[~full] = x[rng.choice(len(x), int((~full).sum()))]
        load = np.minimum(count / (len(x) / k), 4).astype(np.float32)
    return centroids


class CentroidGraph:
    """Nearest-neighbour graph over the centroids with links back and a few random ones; searched best first, many queries at once.

    A centroid that lies apart is nobody's neighbour, so each is linked from two of its own nearest that have room for it.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 16, links: int = 4, room: int = 6, seed: int = 1):
        self.c = centroids.astype(np.float32)
        k = len(self.c)
        near = np.empty((k, min(degree, max(k - 1, 1))), dtype=np.int64)
        for s in range(0, k, 1024):
            d = self.distances(self.c[s : s + 1024])
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf if k > 1 else 0
            least = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            near[s : s + 1024] = np.take_along_axis(least, np.argsort(np.take_along_axis(d, least, 1), axis=1), 1)
        back, used = np.tile(np.arange(k)[:, None], (1, room)), np.zeros(k, dtype=np.int64)  # an empty place links to itself
        for c in range(k):
            free = near[c][used[near[c]] < room][:2]
            back[free, used[free]] = c
            used[free] += 1
        self.near = np.concatenate([near, back, np.random.default_rng(seed).integers(0, k, (k, links))], axis=1)

    def distances(self, q: np.ndarray) -> np.ndarray:
        return np.maximum((q * q).sum(1)[:, None] - 2 * q @ self.c.T + (self.c * self.c).sum(1), 0)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the best `beam` centroids that a walk finds, nearest first; -1 and inf where fewer."""
        n, k = len(q), len(self.c)
        beam = min(beam, k)
        ids = np.full((n, beam), -1, dtype=np.int64)
        dist = np.full((n, beam), np.inf, dtype=np.float32)
        seen = np.zeros((n, k), dtype=bool)
        open_ = np.zeros((n, beam), dtype=bool)
        fresh = np.tile(np.linspace(0, k - 1, min(k, 8)).astype(np.int64), (n, 1))
        rows = np.arange(n)
        live = rows
        while len(live):
            new = ~np.take_along_axis(seen[live], fresh, 1)
            ordered = np.sort(np.where(new, fresh, k), axis=1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = k
            real = ordered < k
            cand = np.where(real, ordered, 0)
            np.put_along_axis(seen, fresh, True, 1) if len(live) == n else seen.__setitem__((live[:, None], fresh), True)
            points = self.c[cand]
            d = np.where(real, ((points - q[live][:, None, :]) ** 2).sum(2), np.inf)
            all_ids = np.concatenate([ids[live], np.where(real, cand, -1)], axis=1)
            all_d = np.concatenate([dist[live], d], axis=1)
            all_open = np.concatenate([open_[live], real], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_d, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
            live = rows[open_.any(1)]
            if len(live):
                step = open_[live].argmax(1)
                open_[live, step] = False
                fresh = self.near[ids[live, step]]
        return ids, dist


def _stack(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.stack(values).astype(np.float64) if len(values) else np.zeros((0, 1))


def within(graph: CentroidGraph, q: np.ndarray, beam: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the lists whose distance is within the ratio of the nearest; -1 and inf where fewer."""
    ids, d = graph.search(q, beam)
    near = (ids >= 0) & (np.sqrt(d) <= ratio * np.sqrt(d[:, :1]))
    ids, d = np.where(near, ids, -1), np.where(near, d, np.inf)
    full = np.flatnonzero(near[:, -1]) if ids.shape[1] < len(graph.c) else []
    if len(full):
        more_ids, more_d = within(graph, q[full], 2 * beam, ratio)
        wider = ((0, 0), (0, more_ids.shape[1] - ids.shape[1]))
        ids, d = np.pad(ids, wider, constant_values=-1), np.pad(d, wider, constant_values=np.inf)
        ids[full], d[full] = more_ids, more_d
    return ids, d


def _lists(rows: DataFrame, graph: CentroidGraph, norm2: float, beam: int, ratio: float, most: int | None, as_query: bool) -> DataFrame:
    """A row for each list that a vector goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                v = _stack(part.column(1))
                last = np.zeros(len(v)) if as_query else np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))
                x = np.concatenate([v, last[:, None]], axis=1).astype(np.float32)
                if as_query:
                    keep = (ids := within(graph, x, beam, ratio)[0]) >= 0
                else:
                    ids, d = graph.search(x, beam)
                    keep = (ids >= 0) & (np.sqrt(d) <= ratio * np.sqrt(d[:, :1]))
                    keep[:, most:] = False
                at, place = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(ids[at, place].astype(np.int32))], ["vec_id", "embedding", "list"])

    return arrow_map(rows, run, "vec_id long, embedding array<double>, list int")


def _search(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best k of each chunk of a list for each query sent to it: query_id, vec_id, score."""
    n_vectors = postings.groupBy("list").agg(F.count("*").alias("n_vectors"))
    n_queries = asked.groupBy("list").agg(F.count("*").alias("n_queries"))
    sizes = n_vectors.join(n_queries, "list").select("list", F.ceil(F.col("n_vectors") / VECTORS_A_CHUNK).cast("int").alias("v"), F.ceil(F.col("n_queries") / QUERIES_A_CHUNK).cast("int").alias("q"))
    sizes = F.broadcast(sizes)  # a row for each centroid
    own = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        return df.join(sizes, "list").select("vec_id", "embedding", "list", (own % F.col(mine)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("vec_id", kind="stable")
        ids, asking = left.vec_id.to_numpy(), right.vec_id.to_numpy()
        ids, begin = np.unique(ids, return_index=True)  # the rows of one id lie side by side
        out = []
        v = _stack(left.embedding)
        for s in range(0, len(right), 256) if len(left) else ():
            score = _stack(right.embedding.iloc[s : s + 256]) @ v.T
            if len(begin) < len(v):
                score = np.maximum.reduceat(score, begin, axis=1)  # a repeated id is one neighbour, with its best score
            score[asking[s : s + 256, None] == ids] = -np.inf
            if len(ids) > k:
                keep = score >= np.partition(score, -k, axis=1)[:, -k][:, None]
                keep &= score > -np.inf
            else:
                keep = score > -np.inf
            q, at = np.nonzero(keep)
            value = score[q, at]
            order = np.lexsort((ids[at], -value, q))
            q, at, value = q[order], at[order], value[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            out.append(pd.DataFrame({"query_id": asking[s + q], "vec_id": ids[at], "score": value})[place < k])
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    left, right = dealt(postings, "v", "q"), dealt(asked, "q", "v")
    return left.groupBy("list", "v", "q").cogroup(right.groupBy("list", "v", "q")).applyInPandas(compare, "query_id long, vec_id long, score double")


def _split(usable: DataFrame, coarse: np.ndarray, norm2: float, lists: int, rows: int) -> np.ndarray:
    """About `lists` centroids: the clusters of the coarse ones, each split in a task of its own by a sample of its vectors.

    20 vectors are drawn for each list to be, over all; a cluster with more than four times the mean of them is cut to that.
    """
    share = int((1 << 30) * min(1.0, 20 * lists / rows))
    drawn = usable.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < share)
    homes = _lists(drawn, CentroidGraph(coarse), norm2, 16, 1.0, 1, False)
    in_order = Window.partitionBy("list").orderBy(F.xxhash64("vec_id"), "vec_id")
    held = homes.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= 80 * lists // len(coarse))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        v = _stack(part.sort_values(["place", "vec_id"]).embedding)
        x = np.concatenate([v, np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))[:, None]], axis=1)
        return pd.DataFrame({"list": part.list.iloc[0], "centroid": list(fit_centroids(x, max(1, len(x) // 20)).astype(np.float64))})

    found = held.groupBy("list").applyInPandas(fit, "list int, centroid array<double>").toPandas()  # one row for each list
    return np.stack(found.sort_values("list", kind="stable").centroid).astype(np.float32)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, root: float = 0.5, sample: int = 20_000, boundary: float = 1.03, replicas: int = 4, probe: float = 1.15, beam: int = 128, scratch: Scratch | None = None) -> DataFrame:
    """The k nearest rows of each row that meets the SQL condition ``is_query``: query_id, rank, vec_id, score.

    root: lists for each square root of the rows. sample: vectors, about, that centroids are fitted to at once on the driver;
    more than sample / 20 lists come from splitting. boundary, replicas: a vector goes to lists within this ratio of the
    nearest, so many at most. probe: a query reads the lists within this ratio. beam: how wide its walk begins.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    vectors = vectors.where("vec_id is not null")
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    if most is None or most["d"] < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    asks = F.coalesce(F.expr(is_query), F.lit(False)).alias("asks")
    usable = vectors.where((F.size("embedding") == most["d"]) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), asks)
    facts = usable.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries, usable = usable.where("asks").drop("asks"), usable.drop("asks")
    share = int((1 << 30) * min(1.0, sample / facts["n"]))
    drawn = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).limit(2 * sample).toPandas()
    drawn = drawn if len(drawn) else usable.limit(sample).toPandas()
    x = _stack(drawn.sort_values("vec_id", kind="stable").embedding)
    x = np.concatenate([x, np.sqrt(np.maximum(facts["norm2"] - (x * x).sum(1), 0))[:, None]], axis=1)
    lists = max(1, int(root * facts["n"] ** 0.5))
    held = max(1, min(lists, sample // 20, len(x) // 4))
    centroids = fit_centroids(x, held)
    if lists > held and facts["n"] >= 40 * lists:
        centroids = _split(usable, centroids, facts["norm2"], lists, facts["n"])
    graph = CentroidGraph(centroids)

    postings = scratch.save(_lists(usable, graph, facts["norm2"], 4 * replicas, boundary, replicas, False), "postings")
    asked = scratch.save(_lists(queries, graph, facts["norm2"], beam, probe, None, True), "asked")
    found = scratch.save(_search(postings, asked, k), "found")
    need = min(k, facts["ids"] - 1)
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= need)
    short = scratch.save(queries.join(enough, queries.vec_id == enough.query_id, "left_anti"), "short")
    if need and not short.isEmpty():
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(centroids) - 1))))
        found = found.unionByName(scratch.save(_search(postings, everywhere, k), "found_everywhere"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
