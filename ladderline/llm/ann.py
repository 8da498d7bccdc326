"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are trained on a hash sample of at most ``train_most`` vectors; every
vector is indexed. A vector goes to its nearest centroid's list with the codes of its residual. A query
probes the lists whose centroids have the largest inner products with it, ranks their vectors by
asymmetric distance tables (query against codebook entries, summed by code), and the best ``rerank``
of each group of lists are scored exactly on the original vectors.

A query mostly points where the centroids of its lists do, so an error of the codes in that direction
counts most; vectors of one length, or far from zero, differ there by less than that error. So each
vector's true component along its list's centroid is kept beside the codes, and only what is across it
is approximated. That sum is in doubles, for the differences may be far smaller than the scores.

Lists are put together to groups of about ``group_rows`` vectors, and a longer list is cut into blocks
of that many, so a list that holds a third of all vectors is many tasks' work. Queries are dealt in parts
of about ``query_rows``. A task holds one group and one part; a query is sent to a group once, however
many of its lists it probes, and comes back with its best few, whose union is ranked.

How many lists a query probes is learned: as many as hold the share ``recall`` of the neighbours that
256 vectors of the sample have in the sample, and on to further lists until they hold more than ``k``
vectors. Neighbours in a sample are farther away, so that is on the safe side. Vectors without clusters
(as in the test tables: 64 nearly equal principal components) spread their neighbours over two thirds of
all lists; clustered vectors do with few. For a query set that grows with the table the work grows with
its square, at any share.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates, nor do rows with a null id; equal
scores go to the smaller id; repeated rows are candidates of their own, but never of a query with
their id; fewer candidates than asked for are all returned; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import stored, table

TRAIN_MOST = 20_000
SEED = 11


@dataclass(frozen=True)
class Index:
    """Coarse centroids (lists x d) and codebooks (parts x 256 x d / parts)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    def lists(self, v: np.ndarray) -> np.ndarray:
        return (2 * v @ self.centroids.T - (self.centroids**2).sum(1)).argmax(1)

    def directions(self) -> np.ndarray:
        """The centroids at length one."""
        length = np.linalg.norm(self.centroids, axis=1, keepdims=True)
        return self.centroids / np.where(length > 0, length, 1)

    def along(self, v: np.ndarray, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes lack of each vector's component along its centroid."""
        decoded = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.codebooks)], axis=1)
        return np.einsum("ij,ij->i", v - decoded, self.directions()[of])

    def encode(self, residual: np.ndarray) -> np.ndarray:
        parts = np.array_split(residual, len(self.codebooks), axis=1)
        return np.stack([(2 * r @ c.T - (c**2).sum(1)).argmax(1) for r, c in zip(parts, self.codebooks)], 1).astype(np.uint8)


def kmeans(v: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), k, replace=len(v) < k)].astype(float)
    for _ in range(rounds):
        of = (2 * v @ c.T - (c**2).sum(1)).argmax(1)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, v)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = v[rng.choice(len(v), int((n == 0).sum()))]
    return c


def train(v: np.ndarray, lists: int, parts: int, seed: int = SEED) -> Index:
    centroids = kmeans(v, lists, 12, seed)
    of = Index(centroids, np.zeros((0, 0, 0))).lists(v)
    residual = v - centroids[of]
    books = [kmeans(r, 256, 8, seed + i) for i, r in enumerate(np.array_split(residual, parts, axis=1))]
    return Index(centroids, np.stack(books))


def probes_for(index: Index, v: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold the share ``recall`` of the k nearest of some vectors among all of ``v``."""
    if len(v) < 2:
        return len(index.centroids)
    at = np.unique(np.linspace(0, len(v) - 1, 256).astype(int))
    near = v[at] @ v.T
    near[np.arange(len(at)), at] = -np.inf
    k = min(k, len(v) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(v[at] @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    reached = np.take_along_axis(place, index.lists(v)[best], axis=1).ravel()
    return int(np.quantile(reached, recall, method="higher")) + 1


def usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """Rows that take part: (id, v)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(id_).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return rows.where(good).select(F.col(id_).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first group and how many groups it is cut into: a long list has its own ones."""
    blocks = np.maximum(-(-counts // most), 1)
    first = np.zeros(len(counts), np.int64)
    at, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if blocks[i] > 1 or held + n > most:
            at, held = at + (held > 0), 0
        first[i] = at
        held += n
        if blocks[i] > 1:
            at, held = at + int(blocks[i]), 0
    return first, blocks


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest finite values of each row, ties to the smaller column."""
    if near.shape[1] > k:
        least = np.partition(near, -k, axis=1)[:, -k, None]
        more, ties = near > least, near == least
        near = np.where(more | (ties & (np.cumsum(ties, axis=1) <= k - more.sum(1, keepdims=True))), near, -np.inf)
    return np.nonzero(near > -np.inf)


def scan(index: Index, q: np.ndarray, qid: np.ndarray, probed: list, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, v: np.ndarray, k: int, rerank: int, along: np.ndarray | None = None):
    """query id, vec id, score of the best k of some vectors (sorted by id) for each of some queries."""
    tables = [np.ascontiguousarray(p @ book.T, np.float32) for p, book in zip(np.array_split(q, len(index.codebooks), axis=1), index.codebooks)]
    near, directions = np.full((len(q), len(ids)), -np.inf), index.directions()
    along = np.linalg.norm(index.centroids, axis=1)[lists] if along is None else along  # without it, the centroid's own
    of = np.repeat(np.arange(len(q)), [len(x) for x in probed])
    wanted = np.concatenate([np.asarray(x) for x in probed])
    for one in np.unique(lists):
        who, where = of[wanted == one], np.flatnonzero(lists == one)
        if len(who):
            part = np.zeros((len(who), len(where)), np.float32)
            for p, t in enumerate(tables):
                part += t[who][:, codes[where, p]]
            near[np.ix_(who, where)] = part + np.outer(q[who] @ directions[one], along[where])
    near[qid[:, None] == ids[None, :]] = -np.inf
    a, b = _best(near, rerank)
    score = np.einsum("ij,ij->i", q[a], v[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    starts = np.searchsorted(a, np.arange(len(q)))
    top = np.arange(len(a)) - starts[a] < k
    return qid[a[top]], ids[b[top]], score[top]


def search(
    rows: DataFrame,
    is_query: Column,
    id_: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    recall: float = 0.96,
    rerank: int = 128,
    group_rows: int = 4096,
    query_rows: int = 8192,
    train_most: int = TRAIN_MOST,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``is_query`` (a condition on ``id``)."""
    spark = rows.sparkSession
    good = usable(rows, id_, vector)
    by_length = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("q"))
    most = by_length.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None or not most["q"]:
        return spark.createDataFrame([], schema)
    d, n = most["d"], most["n"]
    good = good.where(F.size("v") == d)
    share = int(min(1.0, train_most / n) * 1_000_000)
    sample = good.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < share).orderBy("id", "v").select("v").toPandas()
    if not len(sample):
        sample = good.orderBy("id", "v").limit(1).select("v").toPandas()
    lists = max(1, min(round(n**0.5), train_most // 4))
    parts = max(1, d // 4)
    vectors = np.array(sample["v"].tolist(), dtype=float)
    index = train(vectors, lists, parts)
    probes = probes_for(index, vectors, k, recall)
    shared = spark.sparkContext.broadcast(index)  # at most train_most / 4 lists x d numbers, and 256 x d

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            of = shared.value.lists(v)
            codes = shared.value.encode(v - shared.value.centroids[of])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(of.astype(np.int32)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(shared.value.along(v, of, codes)), pa.array([x.tobytes() for x in v], pa.binary())],
                names=["id", "list", "codes", "along", "v"],
            )

    indexed = stored(good.mapInArrow(place, "id long, list int, codes binary, along double, v binary"), "ivf")
    counts = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row per list
        counts[r["list"]] = r["n"]
    first, blocks = _groups(counts, group_rows)
    table_ = F.broadcast(spark.createDataFrame(list(enumerate(zip(first.tolist(), blocks.tolist()))), "list int, at struct<first: long, blocks: long>"))
    query_parts = max(1, -(-int(most["q"]) // query_rows))
    group = (F.col("at.first") + F.pmod(F.xxhash64("id"), F.col("at.blocks"))).alias("group")
    part = F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("part")
    members = indexed.join(table_, "list").select(group, part, "list", "id", "codes", "along", "v")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column(1))
            near = np.argsort(-(q @ shared.value.centroids.T), axis=1, kind="stable")
            held = np.cumsum(counts[near], axis=1)
            upto = np.maximum(probes, 1 + np.minimum((held <= k).sum(axis=1), lists - 1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, (one, last) in enumerate(zip(near, upto.tolist())):
                some = np.sort(one[:last])
                some = some[counts[some] > 0]
                whole = some[blocks[some] == 1]
                at, starts = np.unique(first[whole], return_index=True)  # first is in order of lists
                reach = list(zip(at.tolist(), np.split(whole, starts[1:]))) if len(whole) else []
                reach += [(int(first[x]) + y, np.array([x])) for x in some[blocks[some] > 1] for y in range(int(blocks[x]))]
                for g, which in reach:
                    for column, value in zip(out, (g, int(ids[i]), which.astype(np.int32), q[i].tobytes())):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["group", "query_id", "probed", "q"])

    asked = good.where(is_query).mapInArrow(probe, "group long, query_id long, probed array<int>, q binary")
    asked = asked.select("group", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("part"), "query_id", "probed", "q")

    def task(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors = vectors.sort_values("id", kind="stable")
        ids, of = vectors["id"].to_numpy(), vectors["list"].to_numpy()
        v = np.frombuffer(b"".join(vectors["v"]), float).reshape(len(ids), d)
        codes = np.frombuffer(b"".join(vectors["codes"]), np.uint8).reshape(len(ids), parts)
        along = vectors["along"].to_numpy()
        out = []
        for s in range(0, len(queries), 512):
            some = queries.iloc[s : s + 512]
            q = np.frombuffer(b"".join(some["q"]), float).reshape(len(some), d)
            out.append(scan(shared.value, q, some["query_id"].to_numpy(), some["probed"].tolist(), ids, of, codes, v, k, rerank, along))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    found = asked.groupBy("group", "part").cogroup(members.groupBy("group", "part")).applyInPandas(task, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
