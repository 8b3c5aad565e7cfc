"""How five filters interact, in every order, from signed parity sums.

A document fails A with under 50 words (maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive), B if 100 * distinct words < 65 *
words, C if 100 * `[A-Z]` > 5 * code points, D if it holds any of `#$%&*|`, and E if a smaller doc_id has the same text.

* The filters a document fails are a mask m of five bits. For each part (source) and label (all, good, toxic) 32 sums of
  the signs (-1)^bits(u & m) are taken, one for each u: a Walsh-Hadamard transform of how many documents have each mask,
  made by adding alone. The transform is its own inverse up to 32, so its 32 cells come back exactly.
* All counts of an order's step are sums of cells. A document that fails s filters is removed by each of them in 120 / s
  of the 120 orders, so a filter's removals over all orders (its Shapley value times 120) are sums of cells too.
* Copies: equal texts fail the same filters but for E, which all of them fail but the smallest doc_id. Documents are
  counted by digest, part and labels before they meet their digest's smallest id, so a large group of copies is a few rows.

Defined cases: null texts are empty; empty texts are equal to each other and have no words; a null source is part ''; a
null doc_id fails no E, makes no other fail it and has no labels; repeated rows count each, and none of them is smaller
than the other; of several labels of a document any 1 counts; an empty table has no rows. Other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")


def own_mask(text: Column) -> Column:
    """Which of A to D a text fails, as bits 1, 2, 4 and 8."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, capitals = F.size(words), F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text), text.rlike("[#$%&*|]")]
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, good, toxic, mask, n): numbers of documents; a row for each distinct text, part, labels and whether E fails."""
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_mask(text).alias("mask"))
    own = own.join(marked, "id", "left").na.fill(False, ["good", "toxic"])
    key = ["digest", "mask", "part", "good", "toxic"]
    own = own.groupBy("id", *key).agg(F.count("*").alias("n"))  # rows of one id lie together after the join
    own = own.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = F.min("least.id").over(Window.partitionBy("digest"))  # a row for each part and labels of a text
    own = own.withColumn("kept", F.col("nameless") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    cells = F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    return own.select("part", "good", "toxic", F.explode(cells).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, label, sums): for each u below 32 the sum of (-1)^bits(u & mask) over the documents with the label."""
    held = F.filter(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")), lambda x: x.isNotNull())
    signed = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(u))) % 2 == 0, F.col("n")).otherwise(-F.col("n"))).alias(f"s{u}") for u in range(MASKS)]
    sums = rows.select("part", "mask", "n", F.explode(held).alias("label")).groupBy("part", "label").agg(*signed)
    return sums.select("part", "label", F.array(*[f"s{u}" for u in range(MASKS)]).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """(part, label, cells): the number of documents of each mask."""
    cells = []
    for m in range(MASKS):
        total = F.lit(0).cast("long")
        for u in range(MASKS):
            total = total + F.col("sums")[u] if (u & m).bit_count() % 2 == 0 else total - F.col("sums")[u]
        cells.append(F.shiftright(total, 5))
    return sums.select("part", "label", F.array(*cells).alias("cells"))


def orders(cells: DataFrame) -> DataFrame:
    """The rows of every part, order and step, from the cells of each part and label."""
    none = F.array(*[F.lit(0).cast("long")] * MASKS)
    parts = cells.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS])
    every = ",".join(map("".join, permutations(FILTERS)))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(every), ",")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.ascii(F.substring("filter_order", place, F.lit(1))) - ord("A") + 1)

    earlier = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda a, i: F.when(i > 0, a + bit(i)).otherwise(a))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("earlier", earlier)

    def total(label: str, of) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.col(label)[m] * of(m))

    def fails(m: Column, bits: str) -> Column:
        return m.bitwiseAND(F.col(bits)) != 0

    def once(condition: Column) -> Column:
        return condition.cast("long")

    def here(m: Column) -> Column:
        return once(fails(m, "own") & ~fails(m, "earlier"))

    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: once(~fails(m, "own") & ~fails(m, "earlier"))).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: once(fails(m, "own") & fails(m, "earlier"))).alias("redundant"),
        F.col("all")[F.col("own")].alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("all", lambda m: F.when(fails(m, "own"), F.expr("120L") / F.bit_count(m)).otherwise(0).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return orders(inverted(parity_sums(masks(docs, labels, id_col, text_col, source_col))))


def sql() -> str:
    """DuckDB SQL of audit on `documents` and `labels`: every order applied to every kind of document."""
    return r"""
WITH lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
k AS (SELECT part, fails, good, bad, count(*) AS n FROM x GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
r AS (SELECT part, filter_order, step, own, n, good, bad, contains(fails, own) AS f, len(translate(fails, earlier, '')) < len(fails) AS e, fails = own AS u FROM k, s),
t AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT f AND NOT e), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (f AND NOT e), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (f AND e), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (u), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (f AND NOT e AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (f AND NOT e AND bad), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t"""
