"""Nearest neighbours by inner product over balanced posting lists.

* Every vector is lifted to one more number, so that all have the greatest norm M; a query, scaled to M, keeps 0 there.
  The nearest lifted vectors are then those of the largest inner product, whatever their norms.
* Fit: a hashed sample of at most `sample_rows` vectors (and `sample_values` numbers) is halved, each part between two
  means at its median, until a part stands for `list_rows` vectors: its mean is a list's centroid. There are at most
  `max_lists` lists. All else covers every vector.
* Lists: a vector goes to its nearest centroid, and to others that are at most 1 + `spread` times as far, nearest first,
  unless one that it already has is nearer to the other centroid than the vector is; up to `replicas` in all.
* Centroids form a graph (nearest neighbours that no nearer one covers, and links that keep it in one piece), which is
  broadcast. A query walks it best first and takes all lists that are at most 1 + ratio times as far as the nearest one.
  The ratio is fitted: the least with which sampled queries find `recall` of their sampled neighbours.
* Lists are packed in the tree's order into bins of at most `bin_values` numbers; a longer list is several bins. A task
  holds one bin and at most `query_rows` queries that chose a list in it, multiplies list by list, and gives the best of
  each query. Nothing is capped: longer lists and more queries are more bins and blocks.

Equal vectors are one entry with their k + 1 smallest ids: as ties go to smaller ids, no other id can be in a result.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a null id, and vectors
of another length than the most frequent one (of several, the shortest) take no part; all rows of a query's id are its own
and never its candidates; rows that repeat an id and vector count once, an id with several vectors is a query with each
of them and a candidate with the nearest; without candidates a query has no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class PostingParams:
    k: int = 20
    list_rows: int = 256
    max_lists: int = 1024
    sample_rows: int = 16384
    sample_values: int = 1 << 22
    replicas: int = 4
    spread: float = 0.05
    recall: float = 0.96
    probes: int = 256
    degree: int = 16
    bin_values: int = 1 << 20
    query_rows: int = 4096
    seed: int = 41


@dataclass(frozen=True)
class Lists:
    """centroids: lifted, in the tree's order; near: their graph, each row filled up with the node itself."""

    centroids: np.ndarray
    near: np.ndarray
    start: int
    norm: float
    ratio: float


# --- fit on the sample -----------------------------------------------------------------------


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))])


def asking(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries as they are compared with lifted vectors."""
    return np.column_stack([x * (norm / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros(len(x))])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


def balanced_centroids(x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Means of `parts` parts of nearly the same size; neighbours in the tree stand side by side."""
    rng = np.random.default_rng(seed)

    def halved(own: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1 or len(own) < 2:
            return [x[own].mean(0)]
        left = parts // 2
        cut = max(1, min(len(own) - 1, len(own) * left // parts))
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(6):
            order = own[np.argsort(x[own] @ (b - a), kind="stable")]
            a, b = x[order[:cut]].mean(0), x[order[cut:]].mean(0)
        return halved(order[:cut], left) + halved(order[cut:], parts - left)

    c = np.array(halved(np.arange(len(x)), parts))
    size = np.linalg.norm(c, axis=1, keepdims=True)
    return c * np.where(size > 0, np.linalg.norm(x[0]) / np.where(size > 0, size, 1), 1)  # back on the sphere of the lifted vectors


def graph(c: np.ndarray, degree: int) -> tuple[np.ndarray, int]:
    """(near, start): each centroid's neighbours that no nearer neighbour covers, up to degree, and links to an earlier one, so that all are reached."""
    d = distances(c, c)
    links: list[set[int]] = [set() for _ in c]
    for i in range(len(c)):
        own: list[int] = []
        for j in np.argsort(d[i], kind="stable").tolist():
            if len(own) == degree:
                break
            if j != i and all(d[i, j] < d[m, j] for m in own):
                own.append(j)
        if i:
            own.append(int(d[i, :i].argmin()))
        for j in own:
            links[i].add(j)
            links[j].add(i)
    width = max(map(len, links), default=0) or 1
    return np.array([sorted(x) + [i] * (width - len(x)) for i, x in enumerate(links)]), int(d.sum(1).argmin())


def walk(q: np.ndarray, lists: Lists, ratio: float) -> np.ndarray:
    """Distances of queries to the centroids that are at most 1 + ratio times as far as the nearest; others inf.

    Best first on the graph, all queries side by side: a node is expanded while it is within the ratio or among the 8
    best so far.
    """
    c, n = lists.centroids, len(q)
    far, done = np.full((n, len(c)), np.inf), np.zeros((n, len(c)), bool)
    rows, nodes = np.arange(n), np.full(n, lists.start)
    while len(rows):
        far[rows, nodes] = np.linalg.norm(q[rows] - c[nodes], axis=1)
        best = far.min(1)
        open_ = np.where(done, np.inf, far)
        few = min(8, len(c)) - 1
        eighth = np.partition(far, few, axis=1)[:, few]
        rows, nodes = np.nonzero((open_ < np.inf) & ((far <= best[:, None] * (1 + ratio)) | (far <= eighth[:, None])))
        done[rows, nodes] = True
        to = np.unique(np.repeat(rows, lists.near.shape[1]) * len(c) + lists.near[nodes].ravel())
        rows, nodes = to // len(c), to % len(c)
        new = far[rows, nodes] == np.inf
        rows, nodes = rows[new], nodes[new]
    return np.where(far <= far.min(1, keepdims=True) * (1 + ratio), far, np.inf)


def assigned(x: np.ndarray, c: np.ndarray, p: PostingParams) -> np.ndarray:
    """A lifted vector's lists as a mask: the nearest, and others at the boundary."""
    d = distances(x, c)
    between = distances(c, c)
    order = np.argsort(d, axis=1, kind="stable")[:, : 4 * p.replicas]
    out = np.zeros(d.shape, bool)
    rows = np.arange(len(x))
    first = d[rows, order[:, 0]]
    count = np.zeros(len(x), int)
    for j in order.T:
        own = d[rows, j]
        near = np.where(out, between[:, j].T, np.inf).min(1)  # from the chosen centroid nearest to this one
        take = (own <= first * (1 + p.spread)) & (near > own) & (count < p.replicas)
        out[rows[take], j[take]] = True
        count += take
    return out


def fit(sample: np.ndarray, parts: int, norm: float, p: PostingParams) -> Lists:
    x = lifted(sample, norm)
    c = balanced_centroids(x, max(1, min(parts, len(x))), p.seed)
    near, start = graph(c, p.degree)
    lists = Lists(c, near, start, norm, 0.0)
    rng = np.random.default_rng(p.seed)
    asked = rng.choice(len(x), min(p.probes, len(x)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    k = min(p.k, len(x) - 1)
    if not k:
        return lists
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    held = assigned(x, c, p)
    d = distances(asking(sample[asked], norm), c)
    least = d.min(1, keepdims=True)
    ratio = np.where(least > 0, d / np.where(least > 0, least, 1), np.where(d > 0, np.inf, 1.0)) - 1
    needed = np.array([np.where(held[t], ratio[i], np.inf).min(1) for i, t in enumerate(top)]).ravel()
    needed = np.sort(needed)[min(len(needed) - 1, int(np.ceil(p.recall * len(needed))))]
    return Lists(c, near, start, norm, float(needed) if np.isfinite(needed) else float(ratio[np.isfinite(ratio)].max(initial=0)))


# --- the index -------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    own = own.where(finite & F.exists("vec", lambda x: x != 0))
    most = own.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.where(F.size("vec") == (most["d"] if most else 0))


def entries(own: DataFrame, k: int) -> DataFrame:
    """(entry, ids, vec): distinct vectors with their k + 1 smallest ids, of which entry is the first."""
    own = own.withColumn("h", F.xxhash64("vec")).distinct()
    place = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))  # limited before the shuffle
    own = own.withColumn("place", place).where(F.col("place") <= k + 1)
    return own.groupBy("h", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "vec")


def _numbers(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _mapped(df: DataFrame, ddl: str, work: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]) -> DataFrame:
    """mapInArrow of batches whose column `vec` has numbers."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays(work(batch, _numbers(batch.column("vec"), batch.num_rows)), names)

    return df.mapInArrow(run, ddl)


def _of_rows(mask: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    """Lists of the columns that are set in each row."""
    rows, cols = np.nonzero(mask)
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(mask)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cols, kind))


def packed(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """(first bin, number of bins) of each list: neighbours share a bin while it has at most `most` rows; a longer list has bins of its own."""
    out, bin_, held = [], 0, 0
    for n in sizes:
        if held and held + n > most:
            bin_, held = bin_ + 1, 0
        parts = max(1, -(-n // most))
        out.append((bin_, parts))
        bin_, held = (bin_ + parts, 0) if parts > 1 else (bin_, held + n)
    return out


def best_in_bin(v: np.ndarray, ids: list[np.ndarray], lists: dict[int, np.ndarray], q: np.ndarray, qid: np.ndarray, chosen: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k best of each query among the vectors of the lists that it chose. lists: list to rows of v."""
    n_ids, flat = np.array([len(x) for x in ids]), np.concatenate(ids)
    starts, longest = np.cumsum(n_ids) - n_ids, np.linalg.norm(v, axis=1).max()
    out = []
    for at in range(0, len(q), 256):
        own, picks = q[at : at + 256], chosen[at : at + 256]
        score = np.full((len(own), len(v)), -np.inf)
        asked: dict[int, list[int]] = {}
        for i, x in enumerate(picks):
            for one in x:
                asked.setdefault(int(one), []).append(i)
        for one, rows in asked.items():
            if (cols := lists.get(one)) is not None:
                score[np.ix_(rows, cols)] = own[rows] @ v[cols].T
        last = np.partition(score, max(0, len(v) - k - 1), axis=1)[:, max(0, len(v) - k - 1)]
        slack = 1e-12 * longest * np.linalg.norm(own, axis=1)  # matrix products round by place; the sums below don't
        a, b = np.nonzero((score >= (last - slack)[:, None]) & (score > -np.inf))
        exact = np.concatenate([(own[a[i : i + 65536]] * v[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)] or [np.empty(0)])
        n = n_ids[b]
        to = np.repeat(starts[b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, near, exact = np.repeat(a, n), flat[to], np.repeat(exact, n)
        other = near != qid[at + rows]
        rows, near, exact = rows[other], near[other], exact[other]
        order = np.lexsort((near, -exact, rows))
        rows, near, exact = rows[order], near[order], exact[order]
        first = np.searchsorted(rows, rows)
        few = np.arange(len(rows)) - first < k
        out.append((at + rows[few], near[few], exact[few]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def neighbours(vectors: DataFrame, asked: str, p: PostingParams = PostingParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row for which `asked` (SQL on id_col) holds, nearest first."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    own = usable(vectors, id_col, vec_col)
    every = common.saved(entries(own, p.k), "entries")
    n, dim, norm = every.agg(F.count("*"), F.max(F.size("vec")), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    if not n:
        return spark.createDataFrame([], out)
    rows = max(2, min(p.sample_rows, p.sample_values // dim))
    sample = common.hash_sample(every, "entry", rows, p.seed).select("vec").toArrow()
    lists = fit(_numbers(sample.column("vec"), sample.num_rows), min(p.max_lists, -(-n // p.list_rows)), norm, p)

    def to_lists(batch: pa.RecordBatch, x: np.ndarray) -> list[pa.Array]:
        return [*batch.columns, _of_rows(assigned(lifted(x, norm), lists.centroids, p))]

    kind = every.schema["vec"].dataType.simpleString()
    held = common.saved(_mapped(every, f"entry long, ids array<long>, vec {kind}, lists array<int>", to_lists), "postings")
    common.forget(every)
    sizes = dict(held.select(F.explode("lists").alias("list")).groupBy("list").count().collect())  # max_lists rows
    bins = packed([sizes.get(i, 0) for i in range(len(lists.centroids))], max(1, p.bin_values // dim))
    where = spark.createDataFrame([(i, *x) for i, x in enumerate(bins)], "list int, first int, parts int")
    postings = held.select("entry", "ids", "vec", F.explode("lists").alias("list")).join(F.broadcast(where), "list")
    postings = postings.withColumn("bin", (F.col("first") + F.pmod(F.xxhash64("entry"), "parts")).cast("int")).drop("first", "parts")

    def to_bins(batch: pa.RecordBatch, x: np.ndarray) -> list[pa.Array]:
        chosen = walk(asking(x, norm), lists, lists.ratio) < np.inf
        return [*batch.columns, _of_rows(chosen)]

    queries = own.where(F.expr(asked.replace(id_col, "id"))).distinct().select("id", F.xxhash64("vec").alias("key"), "vec")
    queries = _mapped(queries, f"id long, key long, vec {kind}, lists array<int>", to_bins)
    queries = queries.withColumn("list", F.explode("lists")).join(F.broadcast(where), "list")
    queries = queries.withColumn("bin", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
    queries = common.saved(queries.groupBy("id", "key", "vec", "bin").agg(F.collect_set("list").alias("chosen")), "asked")  # lists of one bin
    blocks = queries.groupBy("bin").agg(F.ceil(F.count("*") / p.query_rows).cast("int").alias("blocks"))
    queries = queries.join(blocks, "bin").withColumn("block", F.pmod(F.xxhash64("id", "key"), "blocks").cast("int")).drop("blocks")
    postings = postings.join(blocks, "bin").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"id": [], "key": [], "vec_id": [], "score": []})
        _, first, inverse = np.unique(v["entry"].to_numpy(), return_index=True, return_inverse=True)
        of = {int(k): inverse[x] for k, x in v.groupby("list").indices.items()}
        vecs, ids = v["vec"].to_numpy()[first], v["ids"].to_numpy()[first]
        at, near, score = best_in_bin(np.stack(vecs).astype(np.float64), list(ids), of, np.stack(q["vec"].to_numpy()).astype(np.float64), q["id"].to_numpy(), q["chosen"].tolist(), p.k)
        return pd.DataFrame({"id": q["id"].to_numpy()[at], "key": q["key"].to_numpy()[at], "vec_id": near, "score": score})

    found = postings.groupBy("bin", "block").cogroup(queries.groupBy("bin", "block")).applyInPandas(search, "id long, key long, vec_id long, score double")
    found = found.groupBy("id", "key", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
