"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Emails, addresses, card and phone numbers are found by fixed rules.  They are seeds, and so are tokens whose shape alone
tells a secret (long hexadecimal or mixed keys, keys with a known prefix), which are spans of kind `id` themselves.  The words
around seeds induce lexical patterns: the word before, the second word before, the word after, and the name that a value is given to
(`name=value`, `name:value`).  All tokens shaped like identifiers, seeds or not, form a graph with the patterns they stand in.  Spark scores it
iteratively.  A pattern's support is how often seeds and accepted instances stand in it; the evidence against it is how often
ordinary words do, over the whole table; tokens of which nothing is known yet count for neither side.  Its score for an unseen instance is
support / (support + evidence against), without that instance's own part, and it is trusted if at least SEEDS other seeds or accepted
instances stand in it.  An instance's score is the best of its trusted patterns; from ACCEPT on it is accepted, is a span of kind `id` wherever it
stands, and supports its other patterns like a seed in the next round.  So discovery goes on from context to context, none raises its
own score, accepted ones stay so, and rounds go on until none is new.  Tokens of fewer than SHORTEST characters or without a digit are no identifiers.

Positions are code points, ends exclusive.  Null or empty text has no spans.  Texts of any length are read whole, in time
linear in their length; words of contexts are whole.  Spans of equal start are ordered by kind.  Repeated rows (id and
text) are found alike.  Added spans never overlap base spans.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.shared import discard, written

ACCEPT = 0.5
SEEDS = 3  # distinct seeds or accepted instances that a trusted pattern needs
KINDS = ("email", "ip", "card", "phone", "id")

#: Base rules (fixed values); each runs in linear time, as a match can only start where its run does.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Shapes of secrets: long hexadecimal, keys with a known prefix, long keys of mixed letters and digits.
_SECRET = re.compile(
    r"[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"
)
#: Shorter hexadecimal tells a secret if letters and digits are mixed.
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})")
SHORTEST = 6
#: Words: runs without blanks (of any script), quotes and brackets; one class for Python and Spark.
WORD = "[^\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\"'<>()\\[\\]{},;|]+"
#: A name with a value after it.
NAMED = "^([^=:]+[=:]).+"
_TOKEN, _NAMED = re.compile(WORD), re.compile(NAMED)
FEW_PATTERNS = 1_000_000  # 64-bit hashes that may be broadcast


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain with a point."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def looks_like_identifier(token: str) -> bool:
    return len(token) >= SHORTEST and _DIGIT.search(token) is not None


def looks_like_secret(token: str) -> bool:
    """A known shape, with letters and digits; or 24 characters and more with capitals, small letters and five digits."""
    letters, digits = any(c.isalpha() for c in token), sum(c in "0123456789" for c in token)
    if _SECRET.fullmatch(token):
        return letters and digits > 0
    if _HEX.fullmatch(token):
        return digits >= 3 and len(token) - digits >= 3
    mixed = token.isascii() and re.fullmatch(r"[A-Za-z0-9+/=_-]{24,}", token) is not None
    return mixed and digits >= 5 and token.lower() != token and token.upper() != token


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of all words between blanks, quotes and brackets."""
    return [m.span() for m in _TOKEN.finditer(text)]


def candidates(text: str, words: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like words, or the values in them, without marks at their ends, outside the base spans; both lists are in order and read once."""
    out, k, reach = [], 0, 0
    for start, stop in words:
        end = start + len(text[start:stop].rstrip(".:!?#$%&*="))
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach > start:
            continue
        named = _NAMED.match(text[start:end])
        if named and looks_like_identifier(text[start + named.end(1) : end]):
            start += named.end(1)
        if looks_like_identifier(text[start:end]):
            out.append((start, end))
    return out


def contexts(text: str, words: list[tuple[int, int]], starts: list[int], start: int, end: int) -> list[str]:
    """Lexical patterns around a span: kind (one character) and word."""
    at = bisect_left(starts, start)
    out = []
    if at and words[at - 1][1] > start:  # within a word: what stands before it there names it
        at -= 1
        out.append(f"={text[words[at][0] : start]}")
    out += [f"{kind}{text[slice(*words[at - back])]}" for kind, back in (("<", 1), ("2", 2)) if at >= back]
    after = bisect_left(starts, end)
    if after < len(words):
        out.append(f">{text[slice(*words[after])]}")
    return out


_FOUND = "doc_id string, th long, spans array<struct<start:int,kind:int,stop:int>>, seen array<struct<start:int,stop:int,seed:boolean,base:boolean,value:string,patterns:array<string>>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shapes: bool = True) -> DataFrame:
    """Per row: base spans, and all seeds and candidates with their patterns; shapes: whether secrets' shapes make seeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans, seen = [], []
            for t in pdf["text"]:
                t = "" if t is None else t
                base = base_spans(t)
                own = []
                if base or _DIGIT.search(t):
                    words = tokens(t)
                    starts = [w[0] for w in words]
                    around = lambda s, e: contexts(t, words, starts, s, e)  # noqa: B023, E731
                    own = [{"start": s, "stop": e, "seed": True, "base": True, "value": t[s:e], "patterns": around(s, e)} for s, _, e in base]
                    own += [
                        {"start": s, "stop": e, "seed": shapes and looks_like_secret(t[s:e]), "base": False, "value": t[s:e], "patterns": around(s, e)}
                        for s, e in candidates(t, words, base)
                    ]
                spans.append([{"start": s, "kind": k, "stop": e} for s, k, e in base])
                seen.append(own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "spans": spans, "seen": seen})

    given = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    return given.mapInPandas(run, _FOUND)


def edges_of(seen: DataFrame) -> DataFrame:
    """(pattern, word, instance, seed, n): how often each value stands in each pattern; as a seed anywhere it is a seed everywhere.

    pattern and word are hashes of lower-cased text, with and without the pattern's kind.
    """
    low = F.lower(F.col("p"))
    return seen.select(F.xxhash64("x.value").alias("instance"), F.col("x.seed").alias("seed"), F.explode("x.patterns").alias("p")).select(
        F.xxhash64(low).alias("pattern"), F.xxhash64(F.substring(low, 2, 2**30)).alias("word"), "instance", "seed"
    ).groupBy("pattern", "word", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def ordinary(docs: DataFrame, edges: DataFrame, text: str = "text", seeds: int = SEEDS) -> DataFrame:
    """(pattern, against): how often a pattern's word stands in the table without an identifier-like token in that place.

    Only patterns of more than `seeds` instances, as no others can ever be trusted.  Words are counted over all texts.
    """
    able = written(edges.groupBy("pattern", "word").agg(F.count("*").alias("k"), F.sum("n").alias("shaped")).where(F.col("k") > seeds), "able")
    wanted = able.select("word").distinct()
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).alias("w"))
    name = F.regexp_extract("w", NAMED, 1)
    each = words.select(F.explode(F.when(name != "", F.array("w", name)).otherwise(F.array("w"))).alias("w")).select(F.xxhash64(F.lower("w")).alias("word"))
    if wanted.count() <= FEW_PATTERNS:
        each = each.join(F.broadcast(wanted), "word", "left_semi")
    counts = each.groupBy("word").agg(F.count("*").alias("total"))
    found = written(able.join(counts, "word", "left").select(
        "pattern", F.greatest(F.coalesce("total", F.lit(0)) - F.col("shaped"), F.lit(0)).cast("long").alias("against")), "against")
    discard(able)
    return found


def bootstrap(edges: DataFrame, against: DataFrame, seeds: int = SEEDS, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """edges(pattern, instance, seed, n), distinct, and (pattern, against) -> (pattern, score, n_seeds) and (instance, score) of accepted unseen instances."""
    accepted: DataFrame | None = None
    found = 0
    while True:
        known = F.col("seed")
        scored = edges
        if accepted is not None:
            scored = edges.join(accepted.select(F.col("instance").alias("_i")), F.col("instance") == F.col("_i"), "left")
            known = F.col("seed") | F.col("_i").isNotNull()
        scored = scored.select("pattern", "instance", "seed", F.when(known, F.col("n")).otherwise(0).alias("own"), known.cast("long").alias("one"))
        support = scored.groupBy("pattern").agg(F.sum("own").alias("total"), F.sum("one").alias("n_seeds")).where(F.col("n_seeds") >= seeds)
        patterns = written(support.join(against, "pattern"), "patterns")
        judged = scored.where("NOT seed").join(patterns, "pattern").where(F.col("n_seeds") - F.col("one") >= seeds)
        others = F.col("total") - F.col("own")
        best = judged.groupBy("instance").agg(F.max(others / (others + F.col("against"))).alias("score")).where(F.col("score") >= accept)
        if accepted is not None:  # once accepted, always
            best = best.union(accepted).groupBy("instance").agg(F.max("score").alias("score"))
        before, accepted = accepted, written(best, "instances")
        n = accepted.count()
        discard(before)
        if n == found:
            return patterns.select("pattern", (F.col("total") / (F.col("total") + F.col("against"))).alias("score"), "n_seeds"), accepted
        discard(patterns)
        found = n


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT, shapes: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, n_spans, base_sha256, spans."""
    found = written(scan(docs, doc_id, text, shapes), "entities")
    seen = found.select("doc_id", "th", F.explode("seen").alias("x"))
    edges = written(edges_of(seen), "edges")
    against = ordinary(docs, edges, text)
    _, unseen = bootstrap(edges, against, accept=accept)
    discard(against)
    secrets = edges.where("seed").select("instance")
    good = written(unseen.select("instance").union(secrets).distinct(), "good")
    discard(edges, unseen)
    more = (
        seen.where("NOT x.base").select("doc_id", "th", F.xxhash64("x.value").alias("instance"), "x.start", "x.stop")
        .join(good, "instance", "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        .agg(F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "stop"))).alias("more"))
    )
    both = found.select("doc_id", "th", "spans").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    base, extra = F.col("spans"), F.coalesce("more", empty)
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.size(extra).cast("long").alias("n_id"),
        (F.size(base) + F.size(extra)).cast("long").alias("n_spans"),
        F.sha2(_joined(F.array_sort(base)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(base, extra))).alias("spans"),
    )
