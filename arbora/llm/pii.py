"""PII: bootstrapped contextual extraction.

1. Seeds: fixed patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers in whole texts, and
   secrets: hex strings of a digest's length with letters and digits. Other identifier-like tokens (four digits or more,
   also in groups with spaces between, an at sign, or one spelt out) are candidates.
2. Each mention of a seed or candidate has lexical patterns: the word before it, the two words before it, the word that
   it is assigned to (with = or : between), the word after it. Words are whole, however long. Pairs of (pattern,
   instance) form a bipartite graph, which Spark builds and scores; a pair counts once, however often it is mentioned.
3. In rounds, a pattern's confidence for a kind is the share of that kind among its instances (weighted by their
   scores, smoothed); an instance's score is 1 - product(1 - confidence) over its confident patterns. Rounds go on until
   no score changes.
4. Candidates whose score reaches the bound, and that look like their kind, are unseen identifiers; all of their mentions
   are reported as `found`, beside the secrets among the seeds.

Defined cases: null texts are empty; matches that fail a check (ranges, Luhn, digit counts) are dropped without another
try; candidates never overlap seeds; places are in code points, ends exclusive. Each row is read by itself, so ids may
repeat or be null; other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: What instances of a kind look like, as lower-cased text.
LOOKS = {
    "email": r"@|\(at\)|\[at\]",
    "ip": r"^[0-9]+([.][0-9]+){3}$",
    "card": r"^([ -]?[0-9]){12,19}$",
    "phone": r"^[0-9 ()+./-]{7,24}$",
    SECRET: r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]{12,}$",
}


@dataclass(frozen=True)
class PiiParams:
    #: Added to a pattern's count of instances: a pattern seen a few times isn't confident yet.
    smoothing: float = 2.0
    min_support: int = 3
    min_confidence: float = 0.7
    min_score: float = 0.7


# --- seeds -----------------------------------------------------------------------------------

#: Fixed patterns. Possessive runs that can't begin inside a run of digits match the same text as the plain pattern.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])")
_GROUPS = re.compile(r"(?: [0-9()./-]*[0-9][0-9()./-]*(?![^\s.,;:!?\"']))+")
_NUMBER = re.compile(r"[0-9()+./-]+")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]|\(at\)|\[at\]")
_TOKEN_END = re.compile(r"\S*")
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&"


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def seeds(text: str) -> list[tuple[str, int, int]]:
    """(kind, first, end), by kind as listed, then place."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def secrets(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Hex strings of a digest's length that hold letters and digits, outside of the spans taken."""
    found = [m.span() for m in _SECRET.finditer(text) if not m[0].isdigit() and not m[0].isalpha()]
    return [(SECRET, a, b) for a, b in found if not any(x < b and y > a for _, x, y in taken)] if found else []


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside of the spans taken; what stands before the last = or : of a token is its context."""
    out, free = [], 0
    spans = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in _HINT.finditer(text):
        if m.start() < free:
            continue
        a = m.start()
        while a > free and not text[a - 1].isspace():
            a -= 1
        b = free = _TOKEN_END.match(text, m.start()).end()
        cut = max(text.rfind("=", a, b - 1), text.rfind(":", a, b - 1))
        a = max(a, cut + 1)
        while a < b and text[a] in _STRIP and text[a] != "(":
            a += 1
        if _NUMBER.fullmatch(text, a, b) and (more := _GROUPS.match(text, b)):
            b = free = more.end()
        while b > a and text[b - 1] in _STRIP:
            b -= 1
        own = text[a:b]
        if "@" not in own and "(at)" not in own and "[at]" not in own and len(_DIGIT.findall(own)) < 4:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if a < b and not (k < len(spans) and spans[k][0] < b):  # the first span that ends behind a decides
            out.append((a, b))
    return out


def _words_before(text: str, at: int) -> list[re.Match]:
    """The two words before a place, whole: what is looked at grows until they stand in it."""
    reach = 64
    while True:
        first = max(0, at - reach)
        found = [m for m in _WORD.finditer(text, first, at) if m.start() > first or not first]
        if len(found) >= 2 or not first:
            return found[-2:]
        reach *= 4


def _word_after(text: str, at: int) -> str | None:
    m = _WORD.search(text, at)
    return m[0].lower() if m else None


def context(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns of text[a:b]."""
    before = _words_before(text, a)
    words = [m[0].lower() for m in before]
    out = ["L " + words[-1]] if words else []
    if len(words) == 2:
        out.append("LL " + " ".join(words))
    if words and re.fullmatch(r"\s*[=:][\s\"'(\[]*", text[before[-1].end() : a][:64]):
        out.append("A " + words[-1])
    after = _word_after(text, b)
    return out + (["R " + after] if after else [])


# --- Spark -----------------------------------------------------------------------------------

_SCAN = "base array<struct<kind: string, first: long, end: long>>, mentions array<struct<kind: string, first: long, end: long, value: string, patterns: array<string>>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, mentions) for each row; mentions: base seeds, secrets, and candidates with a null kind, with their values and patterns."""

    def row(text: str | None) -> tuple[list, list]:
        text = text or ""
        base = seeds(text)
        known = base + secrets(text, base)
        every = known + [(None, a, b) for a, b in candidates(text, known)]
        return [dict(zip(("kind", "first", "end"), s, strict=True)) for s in base], [{"kind": k, "first": a, "end": b, "value": text[a:b].lower(), "patterns": context(text, a, b)} for k, a, b in every]

    return common.map_texts(docs, lambda: lambda texts: [row(t) for t in texts], _SCAN, id_col, text_col).withColumnRenamed(id_col, "id")


def bootstrap(mentions: DataFrame, p: PiiParams) -> tuple[DataFrame, DataFrame]:
    """mentions: (kind, value, patterns). Returns the discovered instances (value, kind, score) and the patterns (pattern, kind, confidence)."""
    graph = common.saved(mentions.select(F.explode("patterns").alias("pattern"), "value").distinct(), "pii-graph")
    known = common.saved(mentions.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    totals = graph.groupBy("pattern").agg(F.count("*").alias("total"))
    looks = F.lit(False)
    for kind, look in LOOKS.items():
        looks = looks | ((F.col("kind") == kind) & F.col("value").rlike(look))
    found, was = known.limit(0), None
    while True:
        held = graph.join(known.unionByName(found), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("support")).where(F.col("support") >= p.min_support)
        confident = held.join(totals, "pattern").select("pattern", "kind", F.round(F.col("s") / (F.col("total") + p.smoothing), 6).alias("confidence")).where(F.col("confidence") >= p.min_confidence)
        confident = common.saved(confident, "pii-patterns")
        miss = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))
        scored = graph.join(confident, "pattern").where(looks).groupBy("value", "kind").agg(F.round(1 - F.exp(miss), 6).alias("score")).where(F.col("score") >= p.min_score)
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        found = common.saved(best.join(known.select("value").distinct(), "value", "left_anti"), "pii-found")
        now = tuple(found.agg(F.count("*"), F.round(F.sum("score"), 4)).first())
        if now == was or not now[0]:
            return found, confident
        was = now


def extract(docs: DataFrame, p: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, found) for each row: arrays of (kind, first, end). base: by kind and place. found: the added spans
    by kind and place, secrets and discovered identifiers; seed tells the former."""
    scanned = common.saved(scan(docs, id_col, text_col).withColumn("row", F.expr("uuid()")), "pii")  # written: the uuids stay
    each = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    found, _ = bootstrap(each.select("kind", "value", "patterns"), p)
    fresh = each.where("kind is null").drop("kind", "patterns").join(found.select("value", "kind"), "value").withColumn("seed", F.lit(False))
    fresh = fresh.select("row", "kind", "first", "end", "seed").unionByName(each.where(F.col("kind") == SECRET).select("row", "kind", "first", "end", F.lit(True).alias("seed")))
    order = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, SECRET)]), F.col("kind"))
    fresh = fresh.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "first", "end", "kind", "seed"))).alias("f"))  # the mentions of one text
    out = scanned.select("row", "id", "base").join(fresh, "row", "left")
    spans = F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["end"].alias("end"), x["seed"].alias("seed")))
    none = F.array().cast("array<struct<kind: string, first: bigint, end: bigint, seed: boolean>>")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce(spans, none).alias("found"))
