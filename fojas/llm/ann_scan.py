"""Nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are dealt to the lists of a k-means fitted on a bounded sample. A query probes its nearest lists;
how many is measured on the sample. Within a list rotated vectors are read in blocks of columns: after
each block a hypothesis test compares the distance so far, scaled to all dimensions, with the query's
bound, and candidates that are beyond it with high confidence are abandoned. The bound starts as the
distance to the (k + 1)-th nearest sample row and tightens with every list piece. Distances of survivors
are computed anew in double precision on the original vectors.

Equal vectors are one candidate with its k + 1 smallest ids, and equal queries are one query, so a
vector that a third of all rows share costs what any other does. Lists are cut into pieces of about
``PIECE_ROWS``; a task holds one piece while the queries that probe it stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fojas.llm.common import written

PIECE_ROWS = 4096
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 4_000_000
COLUMNS_AT_ONCE = 16
CONFIDENCE = 2.1  # the test's epsilon: a wrong rejection about once in some ten thousand


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


class Index:
    """What every task knows: centroids, the sample, how many lists a query probes, the k of the search."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, lists: int, k: int, recall: float):
        self.sample, self.ids, self.k = sample, ids, k
        self.centroids = _k_means(sample, max(1, min(lists, len(sample))))
        self.probes = self._probes(recall)

    def _probes(self, recall: float) -> int:
        """The fewest lists with which sampled queries find ``recall`` of their neighbours in the sample."""
        if len(self.sample) < 2:
            return len(self.centroids)
        own = nearest_lists(self.sample, self.centroids, 1)[:, 0]
        needed = []
        for i in range(0, len(self.sample), max(1, len(self.sample) // 300)):
            near = np.argsort(distances(self.sample, self.sample[i]), kind="stable")[1 : self.k + 1]
            place = np.argsort(nearest_lists(self.sample[i : i + 1], self.centroids, len(self.centroids))[0])
            needed.append(place[own[near]])
        needed = np.sort(np.concatenate(needed))
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out = np.empty((len(x), min(n, len(centroids))), np.int64)
    for i in range(0, len(x), 1000):
        d = (centroids**2).sum(axis=1) - 2 * x[i : i + 1000] @ centroids.T
        out[i : i + 1000] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]] if n > 1 else np.argmin(d, axis=1)[:, None]
    return out


def _k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.random.default_rng(3).permutation(len(x))[:k]] if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        own = nearest_lists(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _to_list(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = nearest_lists(_matrix(batch.column("vec")), index.value.centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column("id"), batch.column("vec")], names=["list", "id", "vec"])

    return run


def _to_probes(index):
    """A query's rows: its probes, with its bound; and the sample rows that set the bound, as finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Index = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                q = _matrix(part.column("vec"))
                lists = nearest_lists(q, m.centroids, m.probes)
                near, bound = [], []
                for row in q:
                    d = distances(m.sample, row)
                    order = np.lexsort((m.ids, d))[: m.k + 1]
                    near.append([{"id": int(m.ids[j]), "score": float(d[j])} for j in order])
                    bound.append(float(d[order[-1]]) if len(order) > m.k else float("inf"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("qid"), part.column("vec"), pa.array(bound), pa.array(lists.tolist(), pa.list_(pa.int64())), pa.array(near, pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))],
                    names=["qid", "vec", "bound", "lists", "near"],
                )

    return run


def scan(x: np.ndarray, turned: np.ndarray, q: np.ndarray, q_turned: np.ndarray, bound: float, step: int = COLUMNS_AT_ONCE) -> np.ndarray:
    """Rows of x not abandoned on the way through the columns."""
    d = x.shape[1]
    alive, so_far = np.arange(len(x)), np.zeros(len(x))
    for a in range(0, d - step, step):
        seen = a + step
        so_far = so_far + ((turned[alive, a:seen] - q_turned[a:seen]) ** 2).sum(axis=1)
        keep = so_far * (d / seen) <= (bound * (1 + CONFIDENCE / np.sqrt(seen))) ** 2
        alive, so_far = alive[keep], so_far[keep]
    return alive


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, at, parts, piece, r = index.value.k, None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, pieces = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "piece"))
            query = batch.column("bound").is_valid().to_numpy(zero_copy_only=False)
            turn = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (pieces[1:] != pieces[:-1]) | (query[1:] != query[:-1]))))
            vec = _matrix(batch.column("vec"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            bounds = batch.column("bound").to_numpy(zero_copy_only=False)
            r = rotation(vec.shape[1]) if r is None else r
            out: list[list] = [[], [], []]
            for a, b in zip(turn, [*turn[1:], len(lists)]):
                if (lists[a], pieces[a]) != at:
                    at, parts, piece = (lists[a], pieces[a]), [], None
                if not query[a]:
                    parts.append((ids[a:b], vec[a:b]))
                    continue
                if not parts:
                    continue
                if piece is None:
                    own, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    piece = own, x, x @ r
                own, x, turned = piece
                q_turned = vec[a:b] @ r
                for j in range(a, b):
                    # the small slack keeps ties with the bound that rounding in the rotation would lose
                    left = scan(x, turned, vec[j], q_turned[j - a], bounds[j] * (1 + 1e-9) + 1e-12)
                    d = distances(x[left], vec[j])
                    order = np.lexsort((own[left], d))[: k + 1]
                    order = order[d[order] <= bounds[j]]
                    out[0] += [ids[j]] * len(order)
                    out[1] += own[left[order]].tolist()
                    out[2] += d[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["qid", "id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.95) -> DataFrame:
    """(id, vec) to (query_id, rank, id, score): the k nearest found for each row that ``is_query`` holds for,
    its own id left out; all candidates where there are fewer. Ties go to the smaller id.

    Null, empty and zero vectors, vectors with null or non-finite components, rows with null id and
    vectors of other than the most frequent length (ties: the shortest) take no part. Rows with one id and
    one vector count once; an id with several vectors is a candidate with each. An empty table gives no
    rows. The driver and every task hold the sample: at most SAMPLE_ROWS rows and SAMPLE_NUMBERS numbers.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("id").isNotNull() & usable(F.col("vec"))).select(F.col("id").cast("long").alias("id"), "vec")
    lengths = sorted(rows.groupBy(F.size("vec").alias("d")).count().collect(), key=lambda r: (-r["count"], r.d))
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not lengths:
        return empty
    d = lengths[0].d
    rows = rows.filter(F.size("vec") == d)
    ranked = rows.withColumn("k", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("k") <= k + 1)
    items = written(ranked.dropDuplicates(["vec", "id"]), "items")
    n = items.filter("k = 1").count()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // d))
    h = F.xxhash64("vec", F.lit(5))
    near = items.filter("k = 1").withColumn("h", h).filter(F.shiftrightunsigned("h", 1) / F.lit(float(2**63)) <= 1.2 * most / n)
    sample = sorted(near.collect(), key=lambda r: (r.h, r.id))[:most]
    model = Index(np.array([r.vec for r in sample], np.float64), np.array([r.id for r in sample], np.int64), int(np.sqrt(n) / 2), k, recall)
    index = spark.sparkContext.broadcast(model)

    vec = items.schema["vec"].dataType.simpleString()
    listed = written(items.select("id", "vec").mapInArrow(_to_list(index), f"list long, id long, vec {vec}"), "listed")
    pieces = listed.groupBy("list").count().select("list", F.ceil(F.col("count") / PIECE_ROWS).cast("int").alias("pieces"))  # a row per list
    asked = rows.filter(is_query)
    queries = asked.groupBy("vec").agg(F.min("id").alias("qid"))
    probes = written(queries.mapInArrow(_to_probes(index), f"qid long, vec {vec}, bound double, lists array<bigint>, near array<struct<id:bigint,score:double>>"), "probes")
    each = probes.select("qid", "vec", "bound", F.explode("lists").alias("list")).join(F.broadcast(pieces), "list")
    each = each.select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("qid").alias("id"), "vec", "bound")
    dealt = listed.join(F.broadcast(pieces), "list").select("list", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "vec", F.lit(None).cast("double").alias("bound"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.unionByName(each).repartition(parts, "list", "piece").sortWithinPartitions("list", "piece", F.col("bound").isNotNull())
    found = both.mapInArrow(_scan(index), "qid long, id long, score double")
    found = found.unionByName(probes.select("qid", F.explode("near").alias("x")).select("qid", "x.id", "x.score")).distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))).filter(F.col("r") <= k + 1)
    # the queries that share a vector share its finds
    own = asked.select(F.col("id").alias("query_id"), "vec").distinct().join(queries, "vec").select("query_id", "qid")
    out = own.join(best.drop("r"), "qid").filter("query_id <> id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", "score")
