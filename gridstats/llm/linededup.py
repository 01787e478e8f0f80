"""Line dedup by winnowing: runs of lines that stand earlier in the corpus are deleted, DataFrame functions only.

1. The gram of a non-blank line is the shortest run of non-blank lines from it on that holds at least `min_chars`
   characters or `min_lines` lines (a long line alone is one); the last lines of a text may have none.
2. Winnowing: the window of a line is the lines of its gram.  Each window selects the line whose gram has the smallest
   digest (of equal ones the first); only selected lines are fingerprints.  So every repeated line of `min_chars`
   characters is selected, and every repeated run that holds a window and the grams of its lines (twice `min_chars`
   characters or `min_lines` lines are enough) has a selected line in common with its copies.
3. A fingerprint's first place in the corpus is its origin; every later place is joined to it.
4. Extension: from the joined places the lines before and after are compared until they differ.  A line of `min_chars`
   characters ends the comparison, as it is a fingerprint of its own; short lines between two fingerprints are
   fewer than `min_lines`, and after the last one of a run fewer than 2 * min_lines, so no more need to be compared.
5. The later run is deleted: the fingerprint's line and the lines that matched on either side.

Lines are compared by 128-bit digests of their whole text, without blanks at either end, never by 64-bit hashes alone.
A deleted line always has an equal one earlier, so of any line one copy stays.  The order is (doc_id, text hash, line);
null ids come first.  Rows that repeat an id and its text are one place: they get the same result.  Blank lines are never
deleted.  Null text stays null, with 0 lines; empty text is one blank line.  Texts of any length are taken whole; a text
gives at most one row a line.  An empty table gives no rows.  Extra columns are kept; n_lines and n_removed of the input
are replaced.  Only digests and positions move until the last join, which moves every text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.shared import discard, written

MIN_CHARS = 40
MIN_LINES = 4
BLANK = " \t\r"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _fingerprints(text: Column, min_chars: int, min_lines: int) -> Column:
    """array<struct<key, line, left, right>> of the selected lines; left and right: neighbours (line, digest), nearest first."""
    raw = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(BLANK)).alias("t")))
    lines = F.transform(
        F.filter(raw, lambda x: x["t"] != ""),
        lambda x: F.struct(x["i"].alias("i"), F.md5(x["t"]).alias("h"), F.length(x["t"]).alias("n")),
    )

    def shortest(run: Column) -> Column:
        """How many lines from the start of a run of up to min_lines lines make a gram; 0: none."""
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0).alias("r"))
        return F.aggregate(
            run, zero,
            lambda a, x: F.struct(
                (a["k"] + 1).alias("k"), (a["n"] + x["n"]).alias("n"),
                F.when(a["r"] > 0, a["r"]).when((a["n"] + x["n"] >= min_chars) | (a["k"] + 1 >= min_lines), a["k"] + 1).otherwise(0).alias("r"),
            ),
            lambda a: a["r"],
        )

    def gram(ls: Column, x: Column, j: Column) -> Column:
        k = F.when(x["n"] >= min_chars, F.lit(1)).otherwise(shortest(F.slice(ls, j + 1, F.lit(min_lines))))
        return let(k, lambda k: F.struct(
            F.when(k == 1, x["h"]).when(k > 1, F.md5(F.array_join(F.transform(F.slice(ls, j + 1, k), lambda y: y["h"]), ""))).alias("key"),
            j.alias("j"), k.alias("k"),
        ))

    def chosen(gs: Column) -> Column:
        """Positions of the window minima."""
        return F.array_distinct(F.transform(
            F.filter(gs, lambda g: g["k"] > 0),
            lambda g: F.when(g["k"] == 1, g["j"]).otherwise(F.array_min(F.filter(F.slice(gs, g["j"] + 1, g["k"]), lambda y: y["k"] > 0))["j"]),
        ))

    def short_ones(run: Column) -> Column:
        """The lines of a run before its first long one, without their lengths."""
        return let(run, lambda r: F.transform(
            F.slice(r, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(r, lambda x: x["n"] >= min_chars), True), F.lit(0)) - 1, F.size(r).cast("long")).cast("int")),
            lambda x: F.struct(x["i"].alias("i"), F.unhex(x["h"]).alias("h")),
        ))

    def fingerprint(ls: Column, gs: Column, j: Column) -> Column:
        start = F.greatest(j + 2 - min_lines, F.lit(1))
        return F.struct(
            F.unhex(gs[j]["key"]).alias("key"), ls[j]["i"].alias("line"),
            short_ones(F.reverse(F.slice(ls, start, j + 1 - start))).alias("left"),
            short_ones(F.slice(ls, j + 2, F.lit(2 * min_lines - 1))).alias("right"),
        )

    return let(lines, lambda ls: let(
        F.transform(ls, lambda x, j: gram(ls, x, j)),
        lambda gs: F.transform(chosen(gs), lambda j: fingerprint(ls, gs, j)),
    ))


def _same(own: Column, origin: Column) -> Column:
    """Line numbers of own as far as its digests and those of origin agree."""
    agree = F.transform(F.zip_with(own, origin, lambda a, b: F.coalesce(a["h"] == b, F.lit(False))), lambda x: x)
    return let(agree, lambda a: F.transform(
        F.slice(own, F.lit(1), F.coalesce(F.nullif(F.array_position(a, False), F.lit(0)) - 1, F.size(a).cast("long")).cast("int")), lambda x: x["i"]
    ))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, th, lines): the lines to delete, numbered from 0, of each text that has any; th is the text's hash."""
    w = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
        F.explode(_fingerprints(F.col(text), min_chars, min_lines)).alias("w"),
    ).select("doc_id", "th", "w.*"), "fingerprints")
    place = lambda: F.struct(F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("line").alias("line"))
    # Written, so that both sides of each join are exchanges of their own and a very common line's rows can be split.
    first = written(w.groupBy("key").agg(F.min(place()).alias("origin"), F.max(place()).alias("last")).where("origin <> last").select("key", "origin"), "origins")
    met = written(w.join(first, "key"), "repeated")
    here = place() == F.col("origin")
    digests = lambda c: F.transform(c, lambda x: x["h"])
    origins = written(
        met.where(here).groupBy("key").agg(F.first(digests("left")).alias("before"), F.first(digests("right")).alias("after")), "neighbours"
    )
    later = met.where(~here).join(origins, "key").select(
        "doc_id", "th", F.concat(F.array("line"), _same(F.col("left"), F.col("before")), _same(F.col("right"), F.col("after"))).alias("lines")
    )
    out = written(later.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines")), "deleted")
    discard(w, first, met, origins)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_lines: int = MIN_LINES) -> DataFrame:
    """The input with `text` cut, and n_lines (all lines before), n_removed (lines deleted)."""
    src = docs.drop(*[c for c in ("n_lines", "n_removed", "_th", "_id", "_key", "_lines") if c not in (doc_id, text)])
    gone = repeated_lines(src, doc_id, text, min_chars, min_lines).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_key"), F.col("lines").alias("_lines")
    )
    both = src.withColumn("_th", F.xxhash64(F.col(text))).join(
        gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_key")), "left"
    )

    def cut(t: Column, lines: Column) -> Column:
        return let(F.split(t, "\n"), lambda a: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), lines), lambda i: a[i]), "\n"
        ))

    return both.select(
        *[
            F.when(F.col("_lines").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("_lines"))).alias(text) if c == text else F.col(f"`{c}`")
            for c in src.columns
        ],
        F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed"),
    )
