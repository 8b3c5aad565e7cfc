"""URL filter by a path-template tree, in DataFrame functions alone.

Rules (host, path) allow or block a URL outright: a rule fits its host and all subdomains if the URL's path starts with
the rule's path, and the longest rule wins. The URLs that rules fit are also the labels from which the tree learns to
judge the others. For each host, paths are cut into segments and go down a tree, level by level until all have ended:

* A segment of digits, or of hex digits of a hash's length, is a wildcard from the start, by its shape; digits within a
  segment are one. Children that are seen fewer than `min_child` times become one wildcard branch `*`.
* Children whose share of blocked labels doesn't differ from their parent's by a chi-square test (1 degree of freedom,
  5 %) are merged into one branch `~`; children without labels always are.
* A node's purity is its share of blocked labels, smoothed with `smoothing` labels at its parent's purity; a host's
  parent is the whole table. URLs whose template has purity `reject` or more are blocked.

What travels is one row for each distinct generalised path of a host, whatever the number of its URLs. Paths below a node
whose labels are all alike, and those below lone children, take all their levels at once.

Defined cases: null URLs and those without `://` have an empty host and path, fit no rule and are judged as the empty
host; without any labels the purity is 0, so all is allowed; rows may repeat and ids may be null: each row is judged.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

SHAPES = (
    (r"^[0-9]+(\.[a-z]+)?$", "{n}"),
    (r"^[0-9a-f-]{16,}$", "{h}"),
)

#: 95 % point of chi-square with 1 degree of freedom.
CHI2 = 3.841458820694124


@dataclass(frozen=True)
class UrlParams:
    min_child: int = 5
    smoothing: float = 4.0
    reject: float = 0.5
    rules: tuple[tuple[str, str, str], ...] = RULES


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, variable ones by shape."""

    def general(s: Column) -> Column:
        out = F.regexp_replace(s, "[0-9]+", "#")
        for pattern, name in reversed(SHAPES):
            out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def _stats(rows: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    rows = common.saved(rows, "paths")  # each step reads its rows twice; unwritten, plans would double with each
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in zip(("n", "labelled", "blocked"), names, strict=True)])
    return rows.join(sums, keys)


def _step(purity: Column, blocked: Column, labelled: Column, p: UrlParams) -> Column:
    return (blocked + p.smoothing * purity) / (labelled + p.smoothing)


def _unary(template: Column, levels: Column) -> Column:
    """The template after levels at which all children are one merged branch."""
    return F.concat(template, F.repeat(F.lit("/~"), levels))


def _pure(rows: DataFrame, p: UrlParams) -> DataFrame:
    """(host, segs, template, purity) of the paths at nodes whose labels are all alike, or that have none. There no child
    differs from its parent, so each level down is one merged branch, with the labels of the paths that reach it."""
    rows = rows.withColumn("len", F.size("segs"))
    each = rows.groupBy("template", "len").agg(F.sum("labelled").alias("own"), *[F.first(c).alias(c) for c in ("k", "L", "B", "purity")])  # alike in a node
    up, down = Window.partitionBy("template").orderBy("len"), Window.partitionBy("template").orderBy(F.desc("len"))  # a row for each length of a path
    each = each.withColumn("reach", F.sum("own").over(down)).withColumn("steps", F.col("len") - F.coalesce(F.lag("len").over(up), F.col("k")))
    each = each.withColumn("hit", F.when((F.col("B") > 0), F.col("reach")).otherwise(0))
    nodes = each.groupBy("template").agg(F.first("purity").alias("purity"), F.array_sort(F.collect_list(F.struct("len", "steps", "reach", "hit"))).alias("lens"))

    def further(a: Column, x: Column) -> Column:
        end = F.when(x["steps"] > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(x["steps"], F.lit(1))), a["purity"], lambda q, _: _step(q, x["hit"], x["reach"], p))).otherwise(a["purity"])
        return F.struct(end.alias("purity"), F.concat(a["ends"], F.array(F.struct(x["len"].alias("len"), end.alias("purity")))).alias("ends"))

    start = F.struct(F.col("purity"), F.expr("cast(array() as array<struct<len: int, purity: double>>)").alias("ends"))
    ends = nodes.select("template", F.explode(F.aggregate("lens", start, further)["ends"]).alias("e")).select("template", "e.len", F.col("e.purity").alias("purity"))
    rows = rows.drop("purity").join(ends, ["template", "len"])
    return rows.select("host", "segs", _unary(F.col("template"), F.col("len") - F.col("k")).alias("template"), "purity")


def _jumped(rows: DataFrame, p: UrlParams) -> DataFrame:
    """rows, further down as long as all paths of a node go on alike: a lone child doesn't differ from its parent either."""
    ends = rows.groupBy("template").agg(F.min("segs").alias("low"), F.max("segs").alias("high"), *[F.first(c).alias(c) for c in ("k", "L", "B", "purity")])
    differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    to = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
    ends = ends.withColumn("to", to).where(F.col("to") > F.col("k"))
    down = F.aggregate(F.sequence(F.lit(1), F.col("to") - F.col("k")), F.col("purity"), lambda q, _: _step(q, F.col("B"), F.col("L"), p))
    rows = rows.join(ends.select("template", "to", down.alias("down")), "template", "left")
    below = _unary(F.col("template"), F.coalesce(F.col("to") - F.col("k"), F.lit(0)))
    return rows.select("host", "segs", "n", "labelled", "blocked", "L", "B", F.coalesce("down", "purity").alias("purity"), below.alias("template"), F.coalesce("to", "k").alias("k"))


def templates(paths: DataFrame, p: UrlParams) -> DataFrame:
    """paths: (host, segs, n, labelled, blocked), one row for each host and segs. Adds template and purity.

    A round goes a level down from the nodes with labels of both kinds where paths part; there are as many rounds as such
    nodes lie under one another, however long the paths are."""
    labelled, blocked = paths.agg(F.sum("labelled"), F.sum("blocked")).first()
    top = blocked / labelled if labelled else 0.0
    rows = _stats(paths, ["host"], ("_n", "L", "B")).drop("_n")
    rows = rows.withColumn("purity", _step(F.lit(top), F.col("B"), F.col("L"), p)).withColumn("template", F.col("host")).withColumn("k", F.lit(0))
    rows, ended = common.saved(rows, "paths"), []
    while True:
        pure = (F.col("B") == 0) | (F.col("B") == F.col("L"))
        ended.append(_pure(rows.where(pure), p))
        rows = common.saved(_jumped(rows.where(~pure), p), "paths")
        ended.append(rows.where(F.size("segs") <= F.col("k")).select("host", "segs", "template", "purity"))
        if len(ended) >= 6:  # many rounds: keep the plan short
            ended = [common.saved(functools.reduce(DataFrame.unionByName, ended), "paths")]
        rows = rows.where(F.size("segs") > F.col("k"))
        if rows.isEmpty():
            return functools.reduce(DataFrame.unionByName, ended)
        rows = rows.withColumn("seg", F.get("segs", F.col("k")))
        rows = _stats(rows, ["template", "seg"], ("cn", "_l", "_b")).drop("_l", "_b")
        rows = rows.withColumn("seg", F.when(F.col("cn") < p.min_child, "*").otherwise(F.col("seg"))).drop("cn")
        rows = _stats(rows, ["template", "seg"], ("_n", "cl", "cb")).drop("_n")
        # (observed - expected)**2 < CHI2 * variance, multiplied out by L**2
        d = F.col("cb") * F.col("L") - F.col("cl") * F.col("B")
        alike = d * d <= CHI2 * (F.col("cl") * F.col("B") * (F.col("L") - F.col("B")))
        rows = rows.withColumn("seg", F.when(alike, "~").otherwise(F.col("seg"))).drop("cl", "cb")
        rows = _stats(rows.drop("L", "B"), ["template", "seg"], ("_n", "L", "B")).drop("_n")
        rows = rows.withColumn("purity", _step(F.col("purity"), F.col("B"), F.col("L"), p)).withColumn("k", F.col("k") + 1)
        rows = common.saved(rows.withColumn("template", F.concat("template", F.lit("/"), "seg")).drop("seg"), "paths")


def judged(pages: DataFrame, p: UrlParams = UrlParams(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) for each row; other columns aren't read."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), p.rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.array_join(segments(F.col("path")), "/").alias("segs"))
    rows = common.saved(rows, "urls")
    paths = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.coalesce(F.sum((F.col("ruled") == "block").cast("long")), F.lit(0)).alias("blocked"))
    tree = templates(paths.withColumn("segs", F.filter(F.split("segs", "/"), lambda s: s != "")), p).withColumn("segs", F.array_join("segs", "/"))
    out = rows.join(tree, ["host", "segs"])
    own = F.when(F.col("purity") >= p.reject, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def sql(p: UrlParams = UrlParams()) -> str:
    """DuckDB SQL for judged() on pages(page_id, url)."""
    rules = sorted(p.rules, key=lambda r: -len(r[0] + r[1]))
    cases = {i: " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[0] + r[1] if i == 0 else r[2]}'" for r in rules) for i in (0, 1)}
    shape = " ".join(f"WHEN regexp_matches(s, '{a}') THEN '{b}'" for a, b in SHAPES)
    parts = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT page_id, host, path, CASE {cases[0]} END AS rule, CASE {cases[1]} END AS ruled, [CASE {shape} ELSE regexp_replace(s, '[0-9]+', '#', 'g') END FOR s IN string_split(path, '/') IF s <> ''] AS segs FROM hp)",
        "g AS (SELECT host, segs, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b FROM r GROUP BY host, segs)",
        f"t AS (SELECT 0 AS k, *, sum(l) OVER h AS pl, sum(b) OVER h AS pb, host AS template, (sum(b) OVER h + {p.smoothing} * CASE WHEN sum(l) OVER () > 0 THEN sum(b) OVER () / sum(l) OVER () ELSE 0 END) / (sum(l) OVER h + {p.smoothing}) AS purity FROM g WINDOW h AS (PARTITION BY host) UNION ALL ("
        f"SELECT k + 1, host, segs, n, l, b, sum(l) OVER w, sum(b) OVER w, template || '/' || seg, (sum(b) OVER w + {p.smoothing} * purity) / (sum(l) OVER w + {p.smoothing}) FROM ("
        f"SELECT * REPLACE (CASE WHEN CAST((cb * pl - cl * pb) * (cb * pl - cl * pb) AS DOUBLE) <= {CHI2!r} * CAST(cl * pb * (pl - pb) AS DOUBLE) THEN '~' ELSE seg END AS seg) FROM ("
        f"SELECT *, sum(l) OVER w AS cl, sum(b) OVER w AS cb FROM ("
        f"SELECT *, CASE WHEN sum(n) OVER (PARTITION BY template, segs[k + 1]) < {p.min_child} THEN '*' ELSE segs[k + 1] END AS seg FROM t WHERE len(segs) > k"
        ") WINDOW w AS (PARTITION BY template, seg))) WINDOW w AS (PARTITION BY template, seg)))",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT page_id, r.host AS host, path, rule, coalesce(ruled, CASE WHEN purity >= {p.reject} THEN 'block' ELSE 'allow' END) AS verdict, "
        f"template, round(purity, 9) AS purity FROM r JOIN t ON r.host = t.host AND r.segs = t.segs AND t.k = len(t.segs)"
    )
