"""Near duplicates by MinHash: universal hash minima, banding, signature verification, alternating large-star and small-star.

A document's set holds the distinct hashes of its k-word shingles (words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with
fewer words the whole sequence is the one shingle). Documents with equal sets are one class, which takes part once.

1. Each class gets `bands * rows` minima of multiply-shift hashes; each band of `rows` minima names a bucket. A pair at
   similarity 0.8 shares no bucket with probability (1 - 0.8**5)**40 = 1.3e-7.
2. The hub of a bucket is the member with the most company over all of its buckets. Each class is paired with the best
   of its buckets' hubs: at most one pair for each class, however large a bucket is.
3. Pairs pass if their signatures agree on nearly the threshold's share of the minima (5 standard errors below it), and
   are then confirmed on their full sets. Links make components.
4. In each bucket that still holds several components, the members outside of the hub's component meet all members of
   other components, in blocks of bounded size, by signature; a pair is taken in the first of its common buckets alone.
   What leaves a block is its members that have a likely partner, never pairs. These members bring their full sets to
   the same block, where likely pairs are confirmed, best first, unless links of the block have joined them before; the
   links that leave it are a forest. So each pair that shares a bucket is compared or already joined, nothing is capped,
   and rows grow with members and blocks.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; rows with a null id are
returned with a null component and kept; rows that share an id are one document for linking. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    #: Link at share / 100 of the union or more.
    share: int = 80
    bands: int = 40
    rows: int = 5
    #: How far below the threshold a signature's agreement may lie.
    margin: float = 0.15
    #: Members, and shingles of full sets, in a block of a bucket, about.
    block: int = 1024
    block_shingles: int = 1 << 20
    #: Bucket members that one call looks at, about.
    bin_rows: int = 2000
    seed: int = 97


def hashers(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and increments of the universal family x -> high bits of a * x + b modulo 2**64."""
    rng = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def minima(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 512):
        np.minimum(out, (a[:, None] * members[None, i : i + 512] + b[:, None]).min(1), out=out)
    return out >> np.uint64(32)


def band_keys(low: np.ndarray, p: MinHashParams) -> np.ndarray:
    grid = low.reshape(p.bands, p.rows)
    key = np.arange(p.bands, dtype=np.uint64) + np.uint64(1)
    for j in range(p.rows):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return key.view(np.int64)


def set_key(members: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        one = np.add.reduce(common.mix64(members ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
        two = np.add.reduce(common.mix64(members + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def sketches(docs: DataFrame, p: MinHashParams, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, bands, sig): size and name of each document's set, its buckets, and the low byte of each minimum."""

    def make():
        a, b = hashers(p)

        def row(words: np.ndarray) -> tuple:
            members = common.shingles(words, p.shingle)
            if not len(members):
                return 0, 0, 0, [], b""
            low = minima(members, a, b)
            return len(members), *set_key(members), band_keys(low, p), low.astype(np.uint8).tobytes()

        return lambda texts: [row(w) for w in common.word_hashes(texts, "space")]

    return common.map_texts(docs, make, "n long, k1 long, k2 long, bands array<long>, sig binary", id_col, text_col).withColumnRenamed(id_col, "id")


def full_sets(docs: DataFrame, wanted: DataFrame, p: MinHashParams, id_col: str, text_col: str) -> DataFrame:
    """(id, members): the full sets of the classes in wanted (id, k1, k2)."""
    ids = wanted.select("id").distinct().withColumn("_key", F.xxhash64(F.col("id").cast("string")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("_key"))
    texts = common.sieved(texts, ids, "_key").join(ids, ["id", "_key"], "left_semi")

    def make():
        def row(words: np.ndarray) -> tuple:
            members = common.shingles(words, p.shingle)
            return (*(set_key(members) if len(members) else (0, 0)), members.view(np.int64))

        return lambda texts: [row(w) for w in common.word_hashes(texts, "space")]

    sets = common.map_texts(texts, make, "k1 long, k2 long, members array<long>", "id", "text")
    return sets.join(wanted.select("id", "k1", "k2"), ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select("id", "members")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from agreeing low bytes, less what agrees by chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def likely(pairs: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose set sizes and signatures allow the threshold."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = classes.select("id", "n", "sig")
    both = pairs.join(side.toDF("b", "nb", "sb"), "b").join(side.toDF("a", "na", "sa"), "a")
    both = both.where(f"100 * least(na, nb) >= {p.share} * greatest(na, nb)").select("a", "b", "sa", "sb")
    least = p.share / 100 - p.margin

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("sa", "sb"))
                yield pdf.loc[_agreement(x, y) >= least, ["a", "b"]]

    return both.mapInPandas(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.toDF("b", "mb"), "b").join(sets.toDF("a", "ma"), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("ma", "mb")).cast("long").alias("i"), (F.size("ma") + F.size("mb")).cast("long").alias("s"))
    return shared.where(f"100 * i >= {p.share} * (s - i)").select("a", "b").distinct()


def star_components(links: DataFrame) -> DataFrame:
    """(id, root) of the linked nodes: the smallest node reachable, by alternating large-star and small-star.

    links: columns a and b. Each round is written to the shared folder; the driver sees a count and a checksum of it.
    """
    edges = common.saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())  # edges are distinct

    was = mark(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.saved(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(new)
        common.forget(edges)
        common.forget(large)
        edges = new
        if now == was:  # only stars are left
            break
        was = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    if links.isEmpty():
        return roots
    return common.saved(star_components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")


#: Pairs that one numpy step compares.
PAIRS = 1 << 16


def likely_pairs(t: pa.Table, p: MinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, agreement): rows of side 0 and of side 1 in the same bucket and block whose components differ, whose sizes
    and signatures allow the threshold, and whose signatures agree on no band before the bucket's (else an earlier
    bucket has the pair)."""
    side, n, band = (t[c].to_numpy() for c in ("side", "n", "band"))
    c = np.unique(t["c"].to_numpy(), return_inverse=True)[1]
    block = np.unique(np.stack([t[k].to_numpy() for k in ("key", "i", "j")]), axis=1, return_inverse=True)[1].ravel()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), -1)
    right = np.flatnonzero(side == 1)
    right = right[np.lexsort((n[right], block[right]))]
    left = np.flatnonzero(side == 0)
    # The partners that sizes allow stand together; sizes are put behind the block's number.
    step = int(n.max(initial=0)) + 2
    place = block[right] * step + n[right]
    first = np.searchsorted(place, block[left] * step - (-p.share * n[left] // 100))
    last = np.searchsorted(place, block[left] * step + np.minimum(100 * n[left] // p.share, step - 1), side="right")
    least, out, size = p.share / 100 - p.margin, [], last - first
    for a, b in common.steps([range(s) for s in size.tolist()], PAIRS):
        m = size[a:b]
        x = np.repeat(left[a:b], m)
        y = right[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[a:b], m)]
        on = c[x] != c[y]
        x, y = x[on], y[on]
        same = sig[x] == sig[y]
        share = (same.mean(1) - 1 / 256) / (1 - 1 / 256)  # less what agrees by chance
        on = share >= least
        x, y, same, share = x[on], y[on], same[on], share[on]
        on = same.reshape(len(x), p.bands, p.rows).all(2).argmax(1) >= band[x]
        out.append((x[on], y[on], share[on]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def rest_links(members: DataFrame, hubs: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (a, b) between bucket members in different components: a forest of those that each block finds."""
    own = members.join(roots.toDF("id", "root"), "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("c"))
    own = own.join(classes.select("id", "n"), "id")
    open_ = own.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m"), F.sum("n").alias("s")).where("x <> y")
    hub = hubs.select("key", "hub").join(roots.toDF("hub", "hub_root"), "hub", "left").select("key", F.coalesce("hub_root", "hub").alias("main"))
    open_ = open_.join(hub, "key").select("key", "main", F.greatest(F.ceil(F.col("m") / p.block), F.ceil(F.col("s") / p.block_shingles)).cast("int").alias("blocks"))
    minor = own.join(open_, "key").where("c <> main").groupBy("key").agg(F.count("*").alias("q"), F.sum("n").alias("s"))
    minor = minor.select("key", F.greatest(F.ceil(F.col("q") / p.block), F.ceil(F.col("s") / p.block_shingles)).cast("int").alias("rows"))
    own = own.join(open_.join(minor, "key"), "key").withColumn("at", F.xxhash64("id", "key"))
    # (i, j): block i of those outside of the hub's component meets block j of all.
    own = own.withColumn("whole", F.expr("blocks = 1 and rows = 1"))
    left = own.where("c <> main").select("key", "whole", F.lit(0).alias("side"), F.expr("cast(pmod(at, rows) as int)").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "id", "c", "n", "band")
    right = own.select("key", "whole", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.expr("cast(pmod(at, blocks) as int)").alias("j"), "id", "c", "n", "band")
    # Blocks of small buckets are put together, so that a call has some work.
    bins = max(1, members.count() // p.bin_rows)
    alone = F.xxhash64("key", "i", "j")
    rows = left.unionByName(right).withColumn("bin", F.when(F.col("whole"), F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(alone)).drop("whole")
    rows = rows.join(classes.select("id", "sig"), "id")
    fields = {f.name: f for f in rows.schema}
    columns = ["bin", "key", "side", "i", "j", "id", "c", "n", "sig", "band"]

    def partners(t: pa.Table) -> pa.Table:
        x, y, _ = likely_pairs(t, p)
        return t.select(columns).take(np.unique(np.concatenate([x, y])))

    found = common.saved(rows.select(columns).groupBy("bin").applyInArrow(partners, StructType([fields[c] for c in columns])), "partners")

    def forest(t: pa.Table) -> pa.Table:
        x, y, share = likely_pairs(t, p)
        up: dict = {}

        def top(v):
            while (w := up.get(v, v)) != v:
                up[v] = v = up.get(w, w)
            return v

        ids, c, n, sets_ = t["id"].to_pylist(), t["c"].to_pylist(), t["n"].to_pylist(), t["members"].combine_chunks()
        out = []
        for k in np.argsort(-share, kind="stable"):
            i, j = x[k], y[k]
            if (a := top(c[i])) == (b := top(c[j])):
                continue
            both = len(np.intersect1d(sets_[i].values.to_numpy(), sets_[j].values.to_numpy(), assume_unique=True))
            if 100 * both >= p.share * (n[i] + n[j] - both):
                up[a] = b
                out.append(sorted((ids[i], ids[j])))
        return pa.table({k: pa.array([o[m] for o in out], t.schema.field("id").type) for m, k in enumerate("ab")})

    kind = classes.schema["id"].dataType
    links = found.join(sets, "id").select(*columns, "members").groupBy("bin").applyInArrow(forest, StructType([StructField("a", kind), StructField("b", kind)]))
    return links.distinct()


def components(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs."""
    docs = docs.select(id_col, text_col)
    every = common.saved(sketches(docs, p, id_col, text_col), "sketches")
    named = every.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = common.saved(named, "classes")

    spots = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = spots.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = common.saved(spots.join(shared, "key").select("key", "band", "m", "id"), "members")
    company = members.groupBy("id").agg(F.sum("m").alias("w"))
    hubs = members.join(company, "id").groupBy("key").agg(F.max(F.struct("w", "id")).alias("x")).select("key", F.col("x.id").alias("hub"), F.col("x.w").alias("w"))
    hubs = common.saved(hubs, "hubs")
    sets = common.saved(full_sets(docs, classes.join(company.select("id"), "id", "left_semi"), p, id_col, text_col), "sets")

    best = members.join(hubs, "key").where("id <> hub").groupBy("id").agg(F.max(F.struct("w", "hub"))["hub"].alias("hub"))
    tested = best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    roots = common.saved(star_components(common.saved(confirmed(likely(tested, classes, p), sets, p), "links")), "roots")
    roots = _joined(roots, common.saved(rest_links(members, hubs, roots, classes, sets, p), "links"))
    common.forget(sets, members, hubs)

    reps = classes.select("k1", "k2", F.col("id").alias("rep")).join(roots.toDF("rep", "root"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    out = every.select("id", "n", "k1", "k2").join(reps, ["k1", "k2"], "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), root).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the smallest of its component."""
    return docs.join(components(docs, p, id_col, text_col).where("not kept").select(id_col).distinct(), id_col, "left_anti")
