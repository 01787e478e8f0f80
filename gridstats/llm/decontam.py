"""Benchmark decontamination by templates.

Words become typed placeholders: numbers (digits, also with inner points, and number words) <num>;
capitalised words within a sentence <name>, neighbours joined; units after a number <unit>; all others are
literal, ASCII letters lower-cased.  Windows of WINDOW template tokens with at least LITERALS literals are hashed.
A capitalised word that opens a sentence may be a name or not, and a word after a number that is no known unit may be a unit or not: a window with such
words is hashed in each reading (all its openers as names or none; all its words after numbers as units or none); of
matches at one place the one with the fewest such readings counts.  As capitals and small letters may have been lost, each text is also
read without any names, as an edition of its own, in which names are literals and slots are compared without case; it counts if SHARE of the item's windows with names are found in it too,
so names that were exchanged are left to the first edition.
Windows of the documents are joined with those of the benchmark on the hash.  Matches of one item
at one offset form an occurrence; its slots must be consistent: equal values of the item are equal values
in the document.  A document holds an item if, in either edition, consistent occurrences cover at least SHARE of the
item's windows, or one of them covers STRETCH tokens of the item on end (all of a shorter item): `verbatim` if all
slots are the item's own, else `reparameterised`.

Null texts hold nothing; an item with fewer than WINDOW tokens is one shorter window.  An item of which no window has
enough literals is one window over all of it, found only with the item's own slots.  One with
fewer than LITERALS tokens is found where it is a line of its own, whatever stands between and around its words (first_token is NULL).  An item is not found if it is
altered so that neither SHARE nor STRETCH is left.  Repeated items are found alike; repeated documents (id and text)
give one row an item.  Texts of any length are read whole, a text at a time beyond shingles.CHUNK bytes.  Extra columns are ignored, whatever their
names; without documents or without items there are no rows.

A Bloom filter of the benchmark's hashes, sized by their count up to 2^FILTER_BITS bits (32 MB), is built in Spark and goes to
the tasks to discard other windows before the join; what it lets through wrongly the join discards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.shared import discard, written
from gridstats.llm.shingles import U, _powers, chunks, mix
from gridstats.llm.shingles import _BYTES as BYTE_CODES

WINDOW = 5
LITERALS = 3
SHARE = 0.8
STRETCH = 13
FILTER_BITS = 28

#: Number words and units (fixed values).
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
         "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
         "dollar dollars cent cents euro euros percent degree degrees celsius kelvin watt watts volt volts meter meters metre metres kmh mph").split()

NUM, NAME, UNIT = (mix(np.array([k], U))[0] for k in (1, 2, 3))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = _UPPER | _LOWER | _DIGIT
_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n\0"]] = True
_QUIET = np.zeros(256, bool)  # passed over when looking back for the end of a sentence
_QUIET[[ord(c) for c in " \t\r\"'()[]"]] = True
_CODES = BYTE_CODES.copy()
_CODES[65:91] = BYTE_CODES[97:123]


def _word_code(words: list[str]) -> np.ndarray:
    return np.sort(np.array([_tokens(b" " + w.encode() + b" ", plain=True)[2][0] for w in words], U))


def _is_in(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


_LISTS: dict[str, np.ndarray] = {}


def _tokens(data: bytes, plain: bool = False, names: bool = True) -> tuple[np.ndarray, ...]:
    """(start, stop, code, opener, soft) of the template tokens of texts joined by zero bytes.

    Openers may be names that open a sentence, soft ones units that no list has.  Without names all words but numbers and units are
    literals, and opener marks what would be a name or an opener.
    """
    a = np.frombuffer(data, np.uint8)
    word = _WORD[a]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    start, stop = edge[::2], edge[1::2]
    none = np.zeros(len(start), bool)
    if not len(start):
        return start, stop, np.zeros(0, U), none, none
    length = stop - start
    at = np.flatnonzero(word)
    first = np.cumsum(length) - length
    within = np.arange(len(at)) - np.repeat(first, length)
    code = mix(np.add.reduceat(_CODES[a[at]] * _powers(int(length.max()))[within], first) + length.astype(U))
    if plain:
        return start, stop, code, none, none
    if not _LISTS:
        _LISTS.update(num=_word_code(NUMBER_WORDS), unit=_word_code(UNITS))
    digits = _DIGIT[a[start]]
    number = digits | _is_in(code, _LISTS["num"])
    after, unit = none.copy(), none.copy()
    after[1:] = number[:-1] & ~number[1:] & (start[1:] - stop[:-1] <= 2) & (a[start[1:] - 1] > 0) & (a[stop[:-1]] > 0)  # of one text
    unit = after & _is_in(code, _LISTS["unit"])
    # The last byte before a word that is neither blank, quote nor bracket tells where sentences begin.
    loud = np.where(_QUIET[a], -1, np.arange(len(a)))
    last = np.maximum.accumulate(loud)
    before = np.where(start > 0, last[np.maximum(start - 1, 0)], -1)
    opens = (before < 0) | _STOP[a[np.maximum(before, 0)]]
    second = a[np.minimum(start + 1, len(a) - 1)]
    capital = _UPPER[a[start]] & (length > 1) & (_LOWER[second] | (second >= 128)) & ~number
    name, opener = capital & ~opens & ~unit, capital & opens & ~unit
    if not names:
        name, opener = none, capital & ~unit
    code = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, code)))
    # Digits joined by a point or comma are one number, neighbouring names one name.
    gap = np.zeros(len(start), np.int64)
    gap[1:] = start[1:] - stop[:-1]
    between = a[np.maximum(start - 1, 0)]
    joined = np.zeros(len(start), bool)
    joined[1:] = (digits[1:] & digits[:-1] & (gap[1:] == 1) & ((between[1:] == 46) | (between[1:] == 44))) | (
        name[1:] & name[:-1] & (gap[1:] == 1) & (between[1:] == 32)
    )
    keep = np.flatnonzero(~joined)
    last_of = np.append(keep[1:], len(start)) - 1
    return start[keep], stop[last_of], code[keep], opener[keep], (after & ~unit & ~capital)[keep]


def _slots(data: bytes, start: np.ndarray, stop: np.ndarray, code: np.ndarray, lo: int, hi: int, low: bool = False) -> list[str]:
    kinds = {int(NUM): "n", int(NAME): "p", int(UNIT): "u"}
    return [
        kinds[int(code[i])] + ":" + (data[start[i] : stop[i]].lower() if low else data[start[i] : stop[i]]).decode("utf-8", "replace") for i in range(lo, hi) if int(code[i]) in kinds
    ]


def _window_hashes(code: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    h = code[at] + U(width)
    for i in range(1, width):
        h = mix(h) + code[at + i]
    return mix(h)


def _bits_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a filter of 2^bits bits."""
    mask = U((1 << bits) - 1)
    return h & mask, (h >> U(bits)) & mask


def _may_hold(only: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for place in _bits_of(h, len(only).bit_length() + 2):
        out &= (only[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 == 1
    return out


def window_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the column `hash`: 2^bits bits, made of bitmaps of 4 KB that Spark aggregates."""
    mask = (1 << bits) - 1
    places = F.explode(F.array(F.col("hash").bitwiseAND(mask) + 1, F.shiftrightunsigned("hash", bits).bitwiseAND(mask) + 1))
    maps = hashes.select(places.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.collect():  # at most 2^bits bits
        lo = (r["b"] - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def filter_bits(n: int) -> int:
    """Sixteen bits a hash, from 2^15 to 2^FILTER_BITS bits."""
    return min(FILTER_BITS, max(15, (16 * n).bit_length()))


def template_windows(texts: list[bytes], widths: tuple[int, ...], only: np.ndarray | None, literals: int,
                     whole: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int, list[str], int, int, bool]]:
    """(text number, width, position, hash, slots, tokens of the text, readings, edition without names) of windows with enough literals (any, for widths in whole).

    readings: 1 if openers are names, 2 if words after numbers are units, 3 if both, 0 if neither; 4 more if a window of the edition without names would have any.
    """
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        data = b"\0" + b"\0".join(t.replace(b"\0", b" ") for t in part) + b"\0"
        starts = 1 + np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
        for bare in (False, True):
            start, stop, code, opener, soft = _tokens(data, names=not bare)
            doc = np.searchsorted(starts, start, side="right") - 1
            per = np.bincount(doc, minlength=len(part))
            first = np.cumsum(per) - per
            so_many = lambda marks: np.concatenate([[0], np.cumsum(marks)])
            openers, softs = so_many(opener), so_many(soft)
            for reading in range(4):
                named, loose = reading & 1, reading & 2
                if named and (bare or not openers[-1]) or loose and not softs[-1]:
                    continue
                codes = np.where(opener, NAME, code) if named else code
                codes = np.where(soft, UNIT, codes) if loose else codes
                so_far = so_many((codes != NUM) & (codes != NAME) & (codes != UNIT))
                for width in widths:
                    if len(codes) < width:
                        continue
                    at = np.flatnonzero(doc[: len(codes) - width + 1] == doc[width - 1 :])
                    if named:
                        at = at[openers[at + width] > openers[at]]
                    if loose:
                        at = at[softs[at + width] > softs[at]]
                    at = at[so_far[at + width] - so_far[at] >= (0 if width in whole and not reading else min(literals, width))]
                    h = _window_hashes(codes, at, width)
                    if only is not None:
                        hit = _may_hold(only, h)
                        at, h = at[hit], h[hit]
                    for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        d = int(doc[i])
                        marked = reading + (4 if bare and openers[i + width] > openers[i] else 0)
                        yield lo + d, width, i - int(first[d]), x, _slots(data, start, stop, codes, i, i + width, bare), int(per[d]), marked, bare


_OUT = "doc_id string, th long, width int, pos int, hash long, slots array<string>, n_tokens int, reading int, bare boolean"


def _windows(df: DataFrame, widths: tuple[int, ...] | None, only: np.ndarray | None, window: int, literals: int,
             whole: frozenset[int] = frozenset()) -> DataFrame:
    """Windows of df(doc_id, th, text).  widths None: `window`, or the whole of a shorter text or of one without enough literals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf["text"]]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            kept = [x for x in template_windows(raw, widths or tuple(range(literals, window + 1)), only, literals, whole)
                    if widths is not None or x[1] == min(window, x[5])]
            if widths is None:
                for bare in (False, True):
                    for i in sorted(set(range(len(raw))) - {x[0] for x in kept if x[7] == bare}):
                        size = len(_tokens(b"\0" + raw[i].replace(b"\0", b" ") + b"\0", names=not bare)[0])
                        if size >= literals:
                            kept += [(i, *x[1:]) for x in template_windows([raw[i]], (size,), None, 0) if not x[6] & 3 and x[7] == bare]
            ids, th = pdf["doc_id"].to_numpy(), pdf["th"].to_numpy()
            for lo in range(0, len(kept), 20_000):
                n, w, p, x, s, k, r, e = zip(*kept[lo : lo + 20_000], strict=True)
                yield pd.DataFrame({"doc_id": ids[list(n)], "th": th[list(n)], "width": w, "pos": p, "hash": x, "slots": s, "n_tokens": k, "reading": r, "bare": e})

    return df.mapInPandas(run, _OUT)


def bare_words(text: Column) -> Column:
    """A text's words, lower-cased (A-Z), with single blanks."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def short_lines(items: DataFrame, literals: int = LITERALS) -> DataFrame:
    """(item, line): items of fewer than `literals` words, but at least one."""
    lines = items.select(F.col("doc_id").alias("item"), bare_words(F.col("text")).alias("line"))
    return lines.where((F.col("line") != "") & (F.size(F.split("line", " ")) < literals)).distinct()


def short_items(docs: DataFrame, items: DataFrame, literals: int = LITERALS) -> DataFrame:
    """(doc_id, th, item): documents(doc_id, th, text) with a line that is an item of fewer than `literals` words."""
    lines = docs.select("doc_id", "th", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw")).select("doc_id", "th", bare_words(F.col("raw")).alias("line"))
    few = (F.col("line") != "") & (F.size(F.split("line", " ")) < literals)
    return lines.where(few).join(short_lines(items, literals), "line").select("doc_id", "th", "item").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, stretch: int = STRETCH) -> DataFrame:
    """One row a document and item held: doc_id, th, item_id, n_windows, n_found, coverage, kind, first_token."""
    keyed = lambda df, i, t: df.select(F.col(i).cast("long").cast("string").alias("doc_id"), F.xxhash64(F.col(t)).alias("th"), F.col(t).alias("text"))
    bench, given = keyed(benchmark, item_id, item_text).distinct(), keyed(docs, doc_id, text)
    items = written(_windows(bench, None, None, window, literals), "items")
    poor = F.size("slots") > F.col("width") - literals  # windows over all of an item without enough literals
    found = items.groupBy("width").agg(F.max(poor).alias("poor"), F.count("*").alias("n")).collect()  # one row a width
    whole = frozenset(r["width"] for r in found if r["poor"])
    widths = tuple(sorted(r["width"] for r in found)) or (window,)
    only = window_filter(items, filter_bits(sum(r["n"] for r in found)))
    of_item = ("item_th", "item", "bare")
    with_names = lambda c: F.col(c) >= 4
    theirs = items.select(
        F.col("doc_id").alias("item"), F.col("th").alias("item_th"), "bare", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "hash", "width", F.col("n_tokens").alias("item_tokens"), F.col("reading").alias("item_reading")
    ).join(items.groupBy(F.col("doc_id").alias("item"), F.col("th").alias("item_th"), "bare").agg(
        F.countDistinct("pos").alias("n_windows"), F.countDistinct(F.when(with_names("reading"), F.col("pos"))).alias("n_names")), list(of_item))
    ours = _windows(given, widths, only, window, literals, whole)
    met = ours.join(theirs, ["hash", "width", "bare"]).where(F.size("slots") == F.size("item_slots")).where(~poor | (F.col("slots") == F.col("item_slots")))
    ours_read, its_read = (F.col(c).bitwiseAND(3) for c in ("reading", "item_reading"))
    readings = (F.bit_count(ours_read) + F.bit_count(its_read)) * 16 + ours_read + its_read * 4
    place = ("doc_id", "th", *of_item, "n_windows", "n_names", "item_tokens", "pos", "item_pos")
    met = met.groupBy(*place).agg(F.min_by(F.struct("slots", "item_slots", "width", "item_reading"), readings).alias("m")).select(*place, "m.*")
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("a"), z["slots"].alias("b")))
    spot = met.groupBy("doc_id", "th", *of_item, "n_windows", "n_names", (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set("item_pos").alias("found"), F.collect_set(F.when(with_names("item_reading"), F.col("item_pos"))).alias("names"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.min("pos").alias("first_token"),
        F.max("width").alias("width"), F.max("item_tokens").alias("item_tokens"),
    )
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.lit(0).alias("most"))

    def longer(acc: Column, x: Column) -> Column:
        start, stop = F.when(x <= acc["stop"], acc["start"]).otherwise(x), x + F.col("width")
        return F.struct(start.alias("start"), stop.alias("stop"), F.greatest(acc["most"], stop - start).alias("most"))

    spot = spot.withColumn("long", F.aggregate(F.array_sort("found"), none, longer, lambda acc: acc["most"]) >= F.least(F.lit(stretch), "item_tokens"))
    consistent = spot.where(F.size(F.array_distinct(F.transform("pairs", lambda z: z["a"]))) == F.size("pairs"))
    both = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    held = consistent.groupBy("doc_id", "th", *of_item, "n_windows", "n_names").agg(
        both("found").alias("n_found"), both("names").alias("named"),
        F.max(F.exists("pairs", lambda z: z["a"] != z["b"])).alias("other"), F.min("first_token").alias("first_token"),
        F.max("long").alias("long"),
    ).where(((F.col("n_found") >= share * F.col("n_windows")) | F.col("long")) & (F.col("named") >= share * F.col("n_names")))
    # Of the two editions the one that holds more of the item counts; of equal ones the one with names.
    more = F.struct(F.col("n_found") / F.col("n_windows"), ~F.col("bare"), ~F.col("other"), F.col("item_th"))
    best = held.groupBy("doc_id", "th", "item").agg(F.max_by(F.struct("n_windows", "n_found", "other", "first_token"), more).alias("m")).select("doc_id", "th", "item", "m.*")
    one = F.lit(1)
    if not short_lines(bench, literals).isEmpty():  # else no document's lines need be looked at
        best = best.unionByName(short_items(given, bench, literals).select(
            "doc_id", "th", "item", one.alias("n_windows"), one.alias("n_found"), F.lit(False).alias("other"), F.lit(None).cast("int").alias("first_token")))
    out = written(best.select(
        F.col("doc_id").cast("long").alias("doc_id"), "th", F.col("item").cast("long").alias("item_id"),
        F.col("n_windows").cast("long").alias("n_windows"), F.col("n_found").cast("long").alias("n_found"),
        (F.col("n_found") / F.col("n_windows")).alias("coverage"),
        F.when(F.col("other"), "reparameterised").otherwise("verbatim").alias("kind"), F.col("first_token").cast("long").alias("first_token"),
    ), "leaks")
    discard(items)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark."""
    leaks = find_leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks["_id"]) & (F.xxhash64(docs[text]) == leaks["_th"]), "left_anti")
