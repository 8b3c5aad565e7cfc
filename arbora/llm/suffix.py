"""Benchmark decontamination by suffix arrays over shards of the training texts.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` with A-Z lower-cased. Each shard (some consecutive documents of a
partition) gets a suffix array over its words: the places whose words can begin a match, in lexicographic order of what
follows up to the document's end. Every suffix of every benchmark item that is as long as a window is binary-searched in
each shard's array, which gives its longest verbatim matches as intervals of the array. Intervals are merged before they
become places: each place gets the longest match that begins there, each document the items that occur in it.

A place is indexed if its first words begin some test suffix (a filter on rolling hashes of 1 to `lead` words); no
match of a window can begin elsewhere, so nothing is lost. The test items are held by each task in blocks of at most
`block_words` words; with more than one block the corpus is read once for each and the findings are merged. The driver
holds one block at a time, and its broadcast ends with its pass.

Defined cases: null and empty texts have no words and no hits; items without words can't occur; an item of fewer words
than a window is one window; repeated items each count; a null item id reads as an empty string. Ids of documents may
repeat or be null: each row gets its own answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class SuffixParams:
    window: int = 13
    #: A document is contaminated if hit words make at least 1 / part of its words.
    part: int = 20
    lead: int = 5
    filter_bits: int = 20
    #: Words of a shard and of a block of benchmark items, about.
    shard_words: int = 1 << 18
    block_words: int = 1 << 20


def lead_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, for the places that have them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - n + 1 + j]
        return common.mix64(h)


@dataclass
class TestItems:
    """Benchmark items as words. filters[n]: which hashes of n words begin a window, for each n in use. Suffix j of an
    item begins at start[j] of `flat`, ends at stop[j], is of item[j] and must match need[j] words."""

    params: SuffixParams
    names: list[str]
    words: list[np.ndarray]
    filters: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        p, rows, first = self.params, [np.zeros((4, 0), np.int64)], 0
        for i, w in enumerate(self.words):
            need = min(p.window, len(w))
            last = len(w) - need + 1 if need else 0  # a window begins before here
            at = np.arange(last)
            rows.append(np.stack([first + at, np.full(last, first + len(w)), np.full(last, i), np.full(last, need)]))
            first += len(w)
            if last:
                n = min(p.lead, need)
                bits = self.filters.setdefault(n, np.zeros(1 << p.filter_bits, bool))
                bits[(lead_hashes(w, n)[:last] >> np.uint64(64 - p.filter_bits)).astype(np.int64)] = True
        self.start, self.stop, self.item, self.need = np.concatenate(rows, axis=1)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.item_first = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)


class Shard:
    """A suffix array over the words of some documents; only places that pass the items' filter are in it."""

    #: Places that agree in so many words are sorted by doubling.
    WORDWISE = 32

    def __init__(self, docs: list[np.ndarray], items: TestItems) -> None:
        p = items.params
        self.first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        words = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        n = len(words)
        stop = np.repeat(self.first[1:], np.diff(self.first))
        may = np.zeros(n, bool)
        for k, bits in items.filters.items():
            h = lead_hashes(words, k)
            ok = bits[(h >> np.uint64(64 - p.filter_bits)).astype(np.int64)]
            may[: len(h)] |= ok & (np.arange(len(h)) + k <= stop[: len(h)])
        place = np.flatnonzero(may)
        self.words, self.stop = words, stop
        self.array = self._sorted(place, max([len(w) for w in items.words], default=0))

    def _sorted(self, place: np.ndarray, depth: int) -> np.ndarray:
        """Places in lexicographic order of the up to depth words that follow them in their document (word hashes compare), then by place."""
        order = place
        group = np.zeros(len(place), np.int64)
        k = 0
        while k < depth and len(order):
            if k == self.WORDWISE:
                return self._doubled(place, depth)
            at = order + k
            inside = at < self.stop[order]
            word = np.where(inside, self.words[np.minimum(at, len(self.words) - 1)], np.uint64(0))
            sort = np.lexsort((word, inside, group))
            order, group, word, inside = order[sort], group[sort], word[sort], inside[sort]
            turn = np.concatenate(([False], (group[1:] != group[:-1]) | (word[1:] != word[:-1]) | (inside[1:] != inside[:-1])))
            group = np.cumsum(turn)
            if group[-1] == len(group) - 1:
                break
            k += 1
        return order

    def _doubled(self, place: np.ndarray, depth: int) -> np.ndarray:
        """As _sorted, by ranks of all places over 1, 2, 4... words: for texts that repeat themselves."""
        rank, n, k = np.unique(self.words, return_inverse=True)[1].astype(np.int64), len(self.words), 1
        while k < depth:
            after = np.arange(n) + k
            follow = np.where(after < self.stop, rank[np.minimum(after, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 2) + follow, return_inverse=True)[1].astype(np.int64)
            k *= 2
        return place[np.argsort(rank[place], kind="stable")]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, k: int, word: np.ndarray, after: bool) -> np.ndarray:
        """Binary searches, all at once: the first row of each array[lo:hi] (equal in k words) whose word k isn't below, or is above, the given one."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            m = (lo + hi) // 2
            row = self.array[np.minimum(m, len(self.array) - 1)]
            inside = row + k < self.stop[row]
            own = self.words[np.minimum(row + k, len(self.words) - 1)]
            below = ~inside | (own < word) | (after & (own == word))  # a document's end sorts first
            lo = np.where(open_ & below, m + 1, lo)
            hi = np.where(open_ & ~below, m, hi)
        return lo

    def findings(self, items: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first row, last + 1, suffix of the items, words): the intervals of the array whose places match a suffix in so many words and no more, from a window on."""
        live = np.arange(len(items.start)) if len(self.array) else np.zeros(0, np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.array))
        found, k = [np.zeros((4, 0), np.int64)], 0
        while len(live):
            at = items.start[live] + k
            more = at < items.stop[live]
            word = items.flat[np.minimum(at, len(items.flat) - 1)]
            a = self._bound(lo, np.where(more, hi, lo), k, word, False)
            b = np.where(more, self._bound(a, np.where(more, hi, a), k, word, True), a)
            done = k >= items.need[live]  # rows that match no further end here
            for x, y in ((lo, np.where(a < b, a, hi)), (np.where(a < b, b, hi), hi)):
                on = done & (x < y)
                found.append(np.stack([x[on], y[on], live[on], np.full(on.sum(), k)]))
            on = a < b
            live, lo, hi, k = live[on], a[on], b[on], k + 1
        return tuple(np.concatenate(found, axis=1))

    def longest(self, items: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
        """(place, words, suffix) of the longest match that begins at each place (the first suffix that reaches it), and for each document the items that occur in it."""
        first, last, suffix, words = self.findings(items)
        n, names = len(self.array), [set() for _ in range(len(self.first) - 1)]
        if not len(first):
            return first, words, suffix, names
        value = words * (len(items.start) + 1) + len(items.start) - suffix
        # The largest value over each row: an interval is two overlapping runs of 2**level rows, and levels go down.
        level = np.frexp(last - first)[1] - 1
        best = np.zeros(n, np.int64)  # at a row: of the run of 2**v rows that begins there
        for v in range(int(level.max()), -1, -1):
            own, half = level == v, 1 << v
            np.maximum.at(best, first[own], value[own])
            np.maximum.at(best, last[own] - half, value[own])
            if v:
                best[half // 2 :] = np.maximum(best[half // 2 :], best[: n - half // 2])
        held = np.flatnonzero(best)
        got, s = best[held] // (len(items.start) + 1), len(items.start) - best[held] % (len(items.start) + 1)
        # Documents of each item: the item's intervals, merged, then cut into steps of bounded size.
        doc, item = self.document(self.array), items.item[suffix]
        order = np.lexsort((first, item))
        x, y, i = first[order], last[order], item[order]
        reach = np.maximum.accumulate(y + i * (n + 1)) - i * (n + 1)
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (x[1:] > reach[:-1])))
        x, y, i = x[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)], i[new]
        for a, b in common.steps([range(k) for k in (y - x).tolist()], 1 << 18):
            m = y[a:b] - x[a:b]
            rows = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(x[a:b], m)
            for d, k in np.unique(np.stack([doc[rows], np.repeat(i[a:b], m)]), axis=1).T.tolist():
                names[d].add(k)
        return self.array[held], got, s, names

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def blocks(benchmark: DataFrame, p: SuffixParams, id_col: str, text_col: str) -> Iterator[TestItems]:
    """The benchmark's items in blocks of about block_words words, streamed to the driver."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy("i", "t")
    names, words, held = [], [], 0
    for r in rows.toLocalIterator():
        w = common.word_hashes([r["t"]], "alnum")[0]
        if not len(w):
            continue
        if held and held + len(w) > p.block_words:
            yield TestItems(p, names, words)
            names, words, held = [], [], 0
        names.append(r["i"])
        words.append(w)
        held += len(w)
    yield TestItems(p, names, words)


def matches(docs: DataFrame, benchmark: DataFrame, p: SuffixParams = SuffixParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, place, length, item, item_place): the longest verbatim match with the benchmark that begins at each place
    of a document, from a window's length on, and one item that has it; in words. With several blocks of items, one row for each block."""
    return _over_blocks(docs, benchmark, p, id_col, text_col, item_col, item_text_col, False)


def contamination(docs: DataFrame, benchmark: DataFrame, p: SuffixParams = SuffixParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, contaminated) for each row; items: sorted ids of the items with a window in it."""
    return _over_blocks(docs, benchmark, p, id_col, text_col, item_col, item_text_col, True)


def hit_spans(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie inside any [first, last)."""
    edge = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _over_blocks(docs: DataFrame, benchmark: DataFrame, p: SuffixParams, id_col: str, text_col: str, item_col: str, item_text_col: str, summed: bool) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = blocks(benchmark, p, item_col, item_text_col)
    part, following = next(parts), next(parts, None)
    many = following is not None
    if many:  # rows need a name that the passes share
        texts = common.saved(texts.withColumn("row", F.expr("uuid()")), "decontaminate")
    row_type = "n_words long, spans array<long>, items array<string>" if summed else "m array<struct<place: long, length: long, item: string, item_place: long>>"
    out = []
    while part is not None:
        held = spark.sparkContext.broadcast(part)  # block_words words at most, or one item

        def make(held=held):
            items = held.value

            def rows(texts: list[str | None]) -> list[tuple]:
                words, got = common.word_hashes(texts, "alnum"), []
                for a, b in common.steps(words, p.shard_words):
                    shard = Shard(words[a:b], items)
                    place, length, suffix, names = shard.longest(items)
                    if summed:
                        hit = hit_spans(place, place + length, len(shard.words))
                        got += [(len(words[a + d]), np.stack(common.runs(hit[shard.first[d] : shard.first[d + 1]]), 1).ravel() if names[d] else np.zeros(0, np.int64), sorted(items.names[i] for i in names[d])) for d in range(b - a)]
                        continue
                    doc, own = shard.document(place), items.item[suffix]
                    frame = [[] for _ in range(b - a)]
                    for d, *r in zip(doc.tolist(), (place - shard.first[doc]).tolist(), length.tolist(), own.tolist(), (items.start[suffix] - items.item_first[own]).tolist(), strict=True):
                        frame[d].append({"place": r[0], "length": r[1], "item": items.names[r[2]], "item_place": r[3]})
                    got += [(x,) for x in frame]
                return got

            return rows

        found = common.map_texts(texts, make, row_type, "id", "text", ("row",) if many else ())
        if many:
            found = common.saved(found, "findings")
            held.destroy()
        out.append(found)
        part, following = following, next(parts, None)
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    if not summed:
        return got.select(F.col("id").alias(id_col), F.explode("m").alias("m")).select(id_col, "m.*")
    if many:
        got = got.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [np.array([v for y in s for v in y], np.int64).reshape(-1, 2) for s in batch.column(2).to_pylist()]
                spans = [np.stack(common.runs(hit_spans(x[:, 0], x[:, 1], n)), 1).ravel() for x, n in zip(both, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), batch.column(3)], ["id", "n_words", "spans", "items"])

        kind = docs.schema[id_col].dataType.simpleString()
        got = got.select("id", "n_words", "s", "items").mapInArrow(merge, f"id {kind}, n_words long, spans array<long>, items array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # the end of the last span less its first, and so on
    got = got.select("id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    return got.withColumn("contaminated", F.expr(f"n_hit > 0 and {p.part} * n_hit >= n_words")).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, p: SuffixParams = SuffixParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated; those with a null id are taken by their text."""
    docs = docs.withColumn("_document", common.document_key(id_col, text_col))
    found = contamination(docs.select("_document", text_col), benchmark, p, "_document", text_col)
    return docs.join(found.where("contaminated").select("_document").distinct(), "_document", "left_anti").drop("_document")


def items_sha256(names) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
