"""Exact token counts of every prefix of a text under byte-level BPE.

For each distinct pre-token a prefix dynamic programme finds, for every prefix, the last token
of that prefix's encoding: the one vocabulary entry that ends there and is compatible with
the last token before it (merging the two alone gives the two back).  The count at a prefix is
the count before that token plus one.  Whole texts add up the counts of their pre-tokens, so a
prefix's count, or the longest prefix within a budget, is read off without encoding again.

Null text is empty: 0 bytes, 0 tokens.  Repeated rows are counted alike.  An empty table gives an empty
table.  Other columns are kept; a clash with an output name replaces the input's column.  A text of any
length is counted whole, in time linear in its length and with 4 bytes a character.  Memory: a task holds
one Arrow batch, the counts of one text, and a cache of at most 2 * CACHE pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
CACHE = 400_000
#: Longer pre-tokens are counted anew each time; so many characters never hold more than 255 tokens.
SHORT = 60
#: Pre-tokens that a shorter text would split (fixed values).
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Pre-token pattern of the byte-level tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts of every prefix for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merge = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.made_by = {made: (rank, pair) for pair, (rank, made) in self.merge.items()}
        self.spines: dict[int, list[tuple[int, int]]] = {}
        self.wholes: dict[int, bool] = {}
        self.back: dict[int, int] = {}
        self.ends = [-1]
        for token, t in self.ids.items():
            node = 0
            for b in reversed(token):
                key = node << 8 | b
                if (node := self.back.get(key, -1)) < 0:
                    node = self.back[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = t
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pretokens = regex.compile(PATTERN)
        self.fits: dict[int, bool] = {}
        self.runs = regex.compile(r"\s{2,}")
        self.locals: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging by rank, for pairs of tokens and for tests."""
        while len(ids) > 1:
            best = min((self.merge[p] for p in zip(ids, ids[1:], strict=False) if p in self.merge), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merge.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """Along the first (side 0) or last (side 1) bytes of a token's merge tree, from the byte up: (node, rank that takes it)."""
        key = t << 1 | side
        if (known := self.spines.get(key)) is None:
            known, above = [], 1 << 30
            while True:
                known.append((t, above))
                if t not in self.made_by:
                    break
                above, pair = self.made_by[t]
                t = pair[side]
            known.reverse()
            self.spines[key] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Does no merge across the border come before the merges that build a and b?

        Merges apply in order of rank, leftmost first among equals, so both borders grow in
        step, and a merge across them must outrank the next growth on either side.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            left, right, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            while True:
                (x, grow_x), (y, grow_y) = left[i], right[j]
                across = self.merge.get((x, y))
                if across is not None and across[0] < grow_x and across[0] <= grow_y:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            self.fits[key] = known
        return known

    def byte_prefixes(self, piece: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of a pre-token."""
        step, known_fit, compatible = self.back.get, self.fits.get, self.compatible
        counts, last = [0], [-1]
        for end in range(1, len(piece) + 1):
            node, start = 0, end
            while start:
                # Backwards through the vocabulary's endings: few steps until no entry ends so.
                start -= 1
                if (node := step(node << 8 | piece[start])) is None:
                    break
                t = self.ends[node]
                if t < 0:
                    continue
                if start:
                    before = last[start]
                    ok = known_fit(before << 20 | t)
                    if ok or ok is None and compatible(before, t):
                        counts.append(counts[start] + 1)
                        last.append(t)
                        break
                elif self.whole(t):
                    counts.append(1)
                    last.append(t)
                    break
        return counts

    def whole(self, t: int) -> bool:
        """Does merging the bytes of a token give it back?"""
        if (known := self.wholes.get(t)) is None:
            b = self.bytes_of[t]
            known = self.wholes[t] = self.merged([self.ids[b[i : i + 1]] for i in range(len(b))]) == [t]
        return known

    def local(self, piece: str) -> bytes | np.ndarray:
        """Counts of a pre-token's prefixes of 1, 2, ... characters, each as if the text ended there."""
        if (known := self.locals.get(piece)) is None:
            if (known := self.older.pop(piece, None)) is None:
                if piece[0] == "'" and piece in CONTRACTIONS:  # cut short, the apostrophe stands alone
                    known = [*(1 + n for n in (0, *self.char_prefixes(piece[1:-1])[1:])), self.char_prefixes(piece)[-1]]
                else:
                    known = self.char_prefixes(piece)[1:]
                known = bytes(known) if len(piece) <= SHORT else np.array(known, dtype=np.int32)
            if len(piece) <= SHORT:
                if len(self.locals) >= CACHE:  # two generations: what is in use moves on, the rest goes
                    self.older, self.locals = self.locals, {}
                self.locals[piece] = known
        return known

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in order, (stretch, is a special token)."""
        if self.at_special is None:
            yield text, False
            return
        for i, x in enumerate(self.at_special.split(text)):
            if x:
                yield x, bool(i % 2)

    def count(self, text: str) -> int:
        n, local = 0, self.local
        for stretch, special in self.parts(text):
            n += 1 if special else sum(int(local(p)[-1]) for p in self.pretokens.findall(stretch))
        return n

    def prefixes(self, text: str) -> np.ndarray:
        """counts[i]: tokens of the first i characters, each as if they were the whole text.

        A later end of the text changes the split into pre-tokens only within runs of blanks, within
        contractions (see local) and within special tokens; everything else adds up.
        """
        out = np.zeros(len(text) + 1, dtype=np.int32)
        at = tail = 0  # tail: the last place before `at` from which the split does not depend on what follows
        for stretch, special in self.parts(text):
            stop = at + len(stretch)
            if special:
                for i in range(at + 1, stop):
                    out[i] = out[tail] + self.count(text[tail:i])
                out[stop] = out[at] + 1
                tail = stop
            else:
                tail = at + self._add(stretch, out[at : stop + 1])
            at = stop
        return out

    def _add(self, stretch: str, out: np.ndarray) -> int:
        """Fills out[1:] for a stretch without special tokens, on top of out[0]; the start of its last pre-token that is not blank."""
        pieces = self.pretokens.findall(stretch)
        known = list(map(self.locals.get, pieces))
        if None in known:
            known = [self.local(p) if k is None else k for p, k in zip(pieces, known, strict=True)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        if ends[-1] > SHORT and sizes.max() > SHORT:
            inner = np.concatenate([np.frombuffer(k, np.uint8) if type(k) is bytes else k for k in known]).astype(np.int32)
        else:
            inner = np.frombuffer(b"".join(known), np.uint8)
        totals = inner[ends - 1].astype(np.int32)
        before = np.cumsum(totals, dtype=np.int32) - totals + out[0]
        np.add(inner, np.repeat(before, sizes), out=out[1:], casting="unsafe")
        for m in self.runs.finditer(stretch):  # a prefix that ends in a run of blanks holds them as one pre-token
            lo, hi = m.span()
            run = self.local(m[0])
            out[lo + 1 : hi + 1] = out[lo] + (np.frombuffer(run, np.uint8) if type(run) is bytes else run)
        last = len(pieces) - 1
        while last > 0 and pieces[last].isspace():
            last -= 1
        return int(ends[last] - sizes[last])

    def char_prefixes(self, piece: str) -> list[int]:
        by_byte = self.byte_prefixes(piece.encode("utf-8", "surrogatepass"))
        out, at = [0], 0
        for c in piece:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(by_byte[at])
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One per worker process."""
    return PrefixCounter(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens (counts may fall as a text grows, so the last such)."""
    if counts[-1] <= budget:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= budget)[-1])


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit and, from the same prefix counts, chars_in_limit (characters of the longest prefix of at
    most `limit` tokens) and tokens_of_half (tokens of the first half of the characters, rounded down).  One pass in place: no shuffle."""
    src = docs.drop(*[c for c in ("n_bytes", "n_tokens", "over_limit", "chars_in_limit", "tokens_of_half", "_t") if c != text])

    @F.pandas_udf("n_tokens long, chars_in_limit long, tokens_of_half long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for s in batches:
            rows = []
            for x in s:
                counts = c.prefixes(x or "")
                rows.append((counts[-1], longest_within(counts, limit), counts[(len(counts) - 1) // 2]))
            yield pd.DataFrame(rows, columns=["n_tokens", "chars_in_limit", "tokens_of_half"], dtype="int64")

    whole = src.select("*", tokens(F.col(text)).alias("_t"))
    return whole.select(
        *[F.col(f"`{c}`") for c in src.columns],
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        "_t.n_tokens",
        (F.col("_t.n_tokens") > limit).alias("over_limit"),
        "_t.chars_in_limit", "_t.tokens_of_half",
    )


def prefix_store(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts): counts[i] is the exact token count of the first i characters."""

    @F.pandas_udf("array<int>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for s in batches:
            yield pd.Series([c.prefixes(x or "") for x in s])

    return docs.select(F.col(doc_id).alias("doc_id"), counts(F.col(text)).alias("counts"))


def tokens_of_prefix(store: DataFrame, chars: int) -> DataFrame:
    """Adds n_tokens: tokens of the first `chars` characters (all, if there are fewer)."""
    return store.withColumn("n_tokens", F.col("counts")[F.least(F.lit(chars), F.size("counts") - 1)])


def cut_for_budget(store: DataFrame, budget: int) -> DataFrame:
    """Adds n_chars: the longest prefix with at most `budget` tokens."""
    return store.withColumn(
        "n_chars", F.size("counts") - 1 - F.coalesce(
            F.array_position(F.transform(F.reverse("counts"), lambda n: (n <= budget).cast("int")), 1) - 1, F.size("counts").cast("long"))
    )
