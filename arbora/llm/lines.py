"""Line dedup by a log-template tree, in DataFrame functions alone.

Tokens with a digit are variable fields from the start. A line's leaf in the tree is its number of tokens and its
`lead` leading tokens. In a leaf that holds different lines, a place whose most frequent token makes at least half of the
mentions is constant and the others are wildcards: lines that agree with at least `min_constant` of the places after the
leading ones (as many of which must be constant) share the leaf's template; other lines are templates of their own.

A template, or an exact line by itself, recurs if it stands in at least `min_docs` families of documents (`min_docs_long`
from `long_tokens` tokens on): copies of a document repeat all of its lines, which isn't boilerplate. What a document is
apart from a line is marked by `FAMILIES` minima of the hashed token pairs of its other lines, which copies and near
copies share. Documents that share a minimum are one family, and so are those that others link; a family counts once,
whatever its size. All recurring lines, and all lines of recurring templates, are dropped, wherever they stand.

A passage may be broken into short lines. At each place of a document's distinct lines, the shortest run of neighbours
that has `long_tokens` tokens, forward and backward, is counted like one long line: where it stands in `min_docs_long`
families of documents, its lines are dropped from the documents that hold the run.

Defined cases: null texts stay null; empty lines are kept and never counted; a line repeated within a document counts
once; texts without a recurring line stay as they are, byte for byte; rows may repeat, and rows with a null id are taken
by their text. All columns of the input stay, whatever their names, but for `n_lines` and `n_dropped`, which are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .minhash import star_components

#: Even: each hash gives the least and the greatest value.
FAMILIES = 4
#: Added to a pair's hash by exclusive or, one for each two minima.
TURNS = (0, 0x5555555555555555)


@dataclass(frozen=True)
class LineParams:
    lead: int = 3
    min_docs: int = 5
    min_docs_long: int = 2
    long_tokens: int = 50
    min_constant: float = 0.6


def _masked(line: Column) -> Column:
    """The line with one space between tokens and <*> for tokens with a digit. Only lines with something to do are rewritten."""
    odd = line.contains("  ") | line.rlike(r"[\t\x0B\f\r]")  # few lines have digits, fewer these
    spaced = F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")).otherwise(line))
    return F.when(line.contains("  ") | line.rlike(r"[0-9\t\x0B\f\r]"), F.regexp_replace(spaced, r"(?<! )[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(F.trim(line))


def _size(line: Column) -> Column:
    """The number of a masked line's tokens."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column, size: Column, p: LineParams) -> Column:
    return F.xxhash64(size, F.substring_index(line, " ", p.lead))


def _pairs(hashes: Column) -> Column:
    """Hashes of pairs of neighbours; a lone one is itself."""
    n = F.size(hashes) - 1
    return F.when(n > 0, F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1)))).otherwise(hashes)


def _marks(df: DataFrame, text_col: str, p: LineParams) -> DataFrame:
    """Adds sigs, the hash of each masked line in order, and lines: (leaf, sig, tokens, m0...) of the distinct ones. Each step is a column of its own: lambdas evaluate what they repeat anew."""
    df = df.withColumn("_every", F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _masked))
    df = df.withColumn("sigs", F.transform("_every", lambda x: F.xxhash64(x))).withColumn("_own", F.array_remove(F.array_distinct("_every"), ""))
    df = df.withColumn("_hashes", F.transform("_own", lambda x: F.transform(F.split(x, " "), lambda y: F.xxhash64(y))))
    df = df.withColumn("_sizes", F.transform("_hashes", F.size)).withColumn("_pairs", F.transform("_hashes", _pairs))

    turned = [f"_pairs{k}" if turn else "_pairs" for k, turn in enumerate(TURNS[: FAMILIES // 2])]
    for c, turn in zip(turned, TURNS):
        if turn:  # once for both ends; in the lambda below it would be evaluated for each
            df = df.withColumn(c, F.transform("_pairs", lambda y: F.transform(y, lambda x, t=turn: x.bitwiseXOR(F.lit(t)))))

    def minima(z: Column) -> list[Column]:
        out = [c for h in turned for c in (F.array_min(z[h]), F.bitwise_not(F.array_max(z[h])))]
        return [c.alias(f"m{k}") for k, c in enumerate(out)]

    each = F.arrays_zip("_own", "_sizes", *dict.fromkeys(["_pairs", *turned]))
    return df.withColumn("lines", F.transform(each, lambda z: F.struct(leaf(z["_own"], z["_sizes"], p).alias("leaf"), F.xxhash64(z["_own"]).alias("sig"), z["_sizes"].alias("tokens"), *minima(z))))


def _two_least() -> list[Column]:
    """For each hash function the two least of the minima of a document's lines."""
    own = [F.array_distinct(F.col("lines")[f"m{k}"]) for k in range(FAMILIES)]
    least = [(F.array_min(a), F.array_min(F.array_remove(a, F.array_min(a)))) for a in own]
    return [F.array(*x).alias(f"t{k}") for k, x in enumerate(least)]


def _families() -> list[Column]:
    """For a line x, the minima over the document's other lines (its own if there is none): what its text is apart from the line."""
    both = [(F.get(f"t{k}", F.lit(0)), F.get(f"t{k}", F.lit(1)), F.col(f"x.m{k}")) for k in range(FAMILIES)]
    return [F.when(own != a, a).otherwise(F.coalesce(b, a)) for a, b, own in both]


def _enough(p: LineParams, n: str = "n") -> Column:
    return (F.col(n) >= p.min_docs) | ((F.col(n) >= p.min_docs_long) & (F.col("tokens") >= p.long_tokens))


def _counted(rows: DataFrame) -> DataFrame:
    """(unit, n): how many families the documents of a unit make. rows: (unit, f0...), one or more for each document."""
    rows = common.saved(rows.select("unit", *[F.xxhash64("unit", F.lit(k), f"f{k}").alias(f"v{k}") for k in range(FAMILIES)]).distinct(), "line-families")
    roots = star_components(rows.select(F.col("v0").alias("a"), F.explode(F.array(*[f"v{k}" for k in range(1, FAMILIES)])).alias("b")))
    units = rows.select("unit", F.col("v0").alias("id")).distinct().join(roots, "id").select("unit", "root").distinct().groupBy("unit").agg(F.count("*").alias("n"))
    units = common.saved(units, "line-counts")
    common.forget(rows, roots)
    return units


def _passages(marks: DataFrame, lines: DataFrame, p: LineParams) -> DataFrame:
    """(body, leaf, sig): lines of recurring runs, by the document's body. Copies that have the same lines are one body."""
    own = marks.select("body", F.posexplode("lines").alias("at", "x")).select("body", "at", "x.leaf", "x.sig", "x.tokens")
    often = lines.where((F.col("n") >= p.min_docs_long) & F.col("mixed")).select("leaf", "sig")
    lone = common.saved(common.sieved(own, often, "sig").distinct().join(often, ["leaf", "sig"]), "line-held")  # copies are one body
    held = lone
    held = held.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("body").orderBy("at")))
    held = held.withColumn("all", F.sum("tokens").over(Window.partitionBy("body", "run"))).where(F.col("all") >= p.long_tokens)
    near, far = Window.partitionBy("body", "run").orderBy("at"), p.long_tokens - 1  # each line has a token at least
    line = F.struct("tokens", "leaf", "sig")
    held = held.withColumn("fore", F.collect_list(line).over(near.rowsBetween(0, far))).withColumn("back", F.reverse(F.collect_list(line).over(near.rowsBetween(-far, 0))))
    size, none = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("lines")), F.lit(None)

    def enough(run: str) -> Column:
        """How many lines of the run make up long_tokens; null if all don't."""
        got = F.aggregate(run, size, lambda a, x: F.when(a["tokens"] >= p.long_tokens, a).otherwise(F.struct((a["tokens"] + x["tokens"]).alias("tokens"), (a["lines"] + 1).alias("lines"))))
        return F.when(got["tokens"] >= p.long_tokens, got["lines"]).otherwise(none)

    held = held.withColumn("nf", enough("fore")).withColumn("nb", enough("back"))
    fore = held.where("nf > 1").select("body", F.col("at").alias("a"), (F.col("at") + F.col("nf") - 1).alias("b"), F.slice("fore", F.lit(1), F.col("nf")).alias("run"))
    back = held.where("nb > 1").select("body", (F.col("at") - F.col("nb") + 1).alias("a"), F.col("at").alias("b"), F.reverse(F.slice("back", F.lit(1), F.col("nb"))).alias("run"))
    runs = fore.unionByName(back).select("body", "a", "b", F.xxhash64(F.lit("run"), "run").alias("unit"), F.lit(p.long_tokens).alias("tokens")).distinct()
    runs = common.saved(runs, "line-runs")
    asked = runs.groupBy("unit").agg(F.count("*").alias("n"), F.min("body").alias("x"), F.max("body").alias("y")).where("n > 1 and x <> y").select("unit")

    wanted = common.saved(runs.join(asked, "unit"), "line-runs")
    bodies = marks.join(wanted.select("body").distinct(), "body", "left_semi").select("body", "lines").dropDuplicates(["body"])
    rows = wanted.join(bodies, "body").withColumn("rest", F.filter("lines", lambda x, i: (i < F.col("a")) | (i > F.col("b"))))
    rows = rows.withColumn("rest", F.when(F.size("rest") > 0, F.col("rest")).otherwise(F.col("lines")))
    rows = rows.select("unit", *[F.array_min(F.col("rest")[f"m{k}"]).alias(f"f{k}") for k in range(FAMILIES)])
    counted = _counted(rows)
    found = wanted.join(counted.where(F.col("n") >= p.min_docs_long), "unit").select("body", F.explode(F.sequence("a", "b")).alias("at")).distinct()
    out = common.saved(found.join(lone, ["body", "at"]).select("body", "leaf", "sig").distinct(), "line-passages")
    common.forget(lone, runs, wanted, counted)
    return out


def recurring(docs: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, found, passages): (key, version, body, sigs, lines) of each document with the hashes of all its lines and the distinct (leaf, sig, tokens, m0...); (leaf, sig) of the lines to drop; (body, leaf, sig) of those to drop from some documents."""
    texts = docs.select(common.document_key(id_col, text_col).alias("key"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    marks = _marks(texts, "text", p).select("key", "version", F.xxhash64(F.col("lines")["sig"]).alias("body"), "sigs", "lines", *_two_least())
    marks = common.saved(marks, "line-marks")

    each = marks.select("body", F.explode("lines").alias("x"), *[f"t{k}" for k in range(FAMILIES)])
    lines = each.groupBy("x.leaf", "x.sig").agg(F.count("*").alias("n"), F.max("x.tokens").alias("tokens"), F.min("body").alias("x"), F.max("body").alias("y"))
    lines = common.saved(lines.select("leaf", "sig", "n", "tokens", (F.col("x") != F.col("y")).alias("mixed")), "lines")

    leaves = lines.groupBy("leaf").agg(F.sum("n").alias("docs"), F.min("sig").alias("a"), F.max("sig").alias("b"), F.max("tokens").alias("tokens"))
    opened = leaves.where((F.col("a") != F.col("b")) & _enough(p, "docs") & (F.col("tokens") > p.lead)).select("leaf", "docs")
    opened = _varied(each, common.saved(opened, "line-leaves"))
    shared = _templates(texts, marks, lines, opened, p)
    whole = shared.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens")).where(_enough(p)).select("leaf")
    asked = lines.where(_enough(p) & F.col("mixed")).select("leaf", "sig", "tokens", F.xxhash64(F.lit("line"), "leaf", "sig").alias("unit"))
    asked = asked.unionByName(shared.join(whole, "leaf").select("leaf", "sig", "tokens", F.xxhash64(F.lit("leaf"), "leaf").alias("unit")))
    asked = common.saved(asked, "line-units")
    common.forget(shared)
    held = common.sieved(each.withColumn("sig", F.col("x.sig")), asked, "sig").select("x.leaf", "sig", *[f.alias(f"f{k}") for k, f in enumerate(_families())])
    counted = _counted(held.join(asked, ["leaf", "sig"]))
    found = common.saved(asked.join(counted, "unit").where(_enough(p)).select("leaf", "sig").distinct(), "line-templates")
    common.forget(asked, counted)
    passages = _passages(marks, lines, p)
    common.forget(lines)
    return marks, found, passages


def _varied(each: DataFrame, opened: DataFrame) -> DataFrame:
    """The rows of opened whose lines aren't all of one family by a minimum that all documents share."""
    held = common.sieved(each.withColumn("leaf", F.col("x.leaf")), opened, "leaf").select("leaf", *[f.alias(f"f{k}") for k, f in enumerate(_families())])
    ends = [e(f"f{k}").alias(f"{n}{k}") for k in range(FAMILIES) for n, e in (("a", F.min), ("b", F.max))]
    differ = " and ".join(f"a{k} <> b{k}" for k in range(FAMILIES))
    out = common.saved(opened.join(held.groupBy("leaf").agg(*ends).where(differ).select("leaf"), "leaf"), "line-leaves")
    common.forget(opened)
    return out


def _flagged(marks: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, version, flags): for each line of a text whether it is among those chosen of its document, so that nothing is masked anew. chosen: (key, sig)."""
    chosen = chosen.groupBy("key").agg(F.collect_set("sig").alias("chosen"))  # the lines of one document
    rows = common.sieved(marks.select("key", "version", "sigs"), chosen, "key").join(chosen, "key")
    flags = F.transform("sigs", lambda x: F.array_contains("chosen", x))
    return common.saved(rows.select("key", "version", flags.alias("flags")).dropDuplicates(["key", "version"]), "line-flags")


def _templates(texts: DataFrame, marks: DataFrame, lines: DataFrame, opened: DataFrame, p: LineParams) -> DataFrame:
    """The rows of lines that share their leaf's template. texts: (key, version, text). opened: (leaf, docs) of the leaves that hold different lines."""
    # First by leaf and sig, so that a line of many documents travels once for each task, and a leaf of many lines is spread.
    held = common.sieved(marks.select("key", F.explode("lines").alias("x")).select("key", "x.leaf", "x.sig"), opened, "leaf")
    held = held.groupBy("leaf", "sig").agg(F.min("key").alias("key")).join(lines.select("leaf", "sig", "n", "tokens"), ["leaf", "sig"])
    held = common.saved(held.join(opened, "leaf"), "line-leaves")
    # The text of a line is read from one document that has it.
    flags = _flagged(marks, held.select("key", "sig"))
    text = common.sieved(texts, flags, "key").join(flags, ["key", "version"]).select(F.arrays_zip(F.split("text", "\n").alias("line"), "flags").alias("both"))
    text = text.select(F.explode(F.filter("both", lambda z: z["flags"])).alias("z")).select(_masked(F.col("z.line")).alias("line"))
    text = text.select("line", F.xxhash64("line").alias("sig"), leaf(F.col("line"), _size(F.col("line")), p).alias("leaf")).dropDuplicates(["leaf", "sig"])
    text = common.saved(text.join(held.drop("key"), ["leaf", "sig"]), "line-texts")
    common.forget(held, flags)
    spots = text.select("leaf", "sig", "n", "docs", F.posexplode(F.split("line", " ")).alias("place", "token")).where(F.col("place") >= p.lead)
    often = spots.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"), F.first("docs").alias("docs"))
    top = often.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("t"), F.first("docs").alias("docs"))
    top = top.select("leaf", "place", F.when(2 * F.col("t.n") >= F.col("docs"), F.col("t.token")).alias("token"))
    constant = top.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "token")))["token"].alias("constant"))  # the places of a line
    rest = F.slice(F.split("line", " "), p.lead + 1, F.col("tokens") - p.lead)
    agree = F.size(F.filter(F.zip_with(rest, "constant", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    kept = text.join(constant, "leaf").where(agree >= p.min_constant * (F.col("tokens") - p.lead))
    out = common.saved(kept.select("leaf", "sig", "tokens", "n"), "line-shared")
    common.forget(text, opened)
    return out


def deduplicated(docs: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of recurring templates dropped from text_col, and n_lines and n_dropped."""
    marks, found, passages = recurring(docs, p, id_col, text_col)
    each = marks.select("key", F.explode("lines").alias("x")).select("key", "x.leaf", "x.sig")
    hits = common.sieved(each, found, "sig").join(found, ["leaf", "sig"]).select("key", "leaf", "sig")
    hits = hits.unionByName(marks.select("key", "body").distinct().join(passages, "body").select("key", "leaf", "sig"))
    flags = _flagged(marks, hits.select("key", "sig"))
    common.forget(marks, found, passages)

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(common.document_key(id_col, text_col).alias("key"), F.xxhash64(text_col).alias("version"), F.struct(*kept).alias("row"))
    rows, others = common.parted(rows, flags, "key")  # documents without such a line aren't shuffled
    rows = rows.join(flags, ["key", "version"], "left").unionByName(others.withColumn("flags", F.lit(None).cast(flags.schema["flags"].dataType)))
    own = F.col("row")[text_col]
    # Lines and flags go into one array first: a column that only a lambda reads would be evaluated for each element.
    rows = rows.withColumn("both", F.arrays_zip(F.split(F.when(F.col("flags").isNotNull(), own), "\n").alias("line"), "flags"))
    rows = rows.withColumn("left", F.transform(F.filter("both", lambda z: ~z["flags"]), lambda z: z["line"]))
    whole = F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1
    new = F.when(F.col("flags").isNotNull(), F.array_join("left", "\n")).otherwise(own)
    n_lines = F.when(own.isNull() | (own == ""), 0).otherwise(whole).cast("long").alias("n_lines")
    n_dropped = F.coalesce(whole - F.size("left"), F.lit(0)).cast("long").alias("n_dropped")
    return rows.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept], n_lines, n_dropped)
