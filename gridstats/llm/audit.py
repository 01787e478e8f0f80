"""How filters interact: what each removes in every order, and what it removes beyond the others.

A document's failures are bits.  Filters A to D look at the text alone.  Filter E finds exact copies by an existential self-join:
a left-semi join on the text's digest, the exact text and a smaller doc_id marks every row of which a copy with a smaller id exists
anywhere in the table.  The joined side holds one row a text, its smallest id, gathered before the shuffle, so a text that a third of the rows share meets each of
them once.  Only texts whose digest stands under two ids are moved.  E's ids are united with the rows of the other filters, the bits of a document are or-ed, and documents
are counted by bit combination; every order, step and measure follows from those counts, at most 32 a part.

Null text is empty text, equal to other empty ones.  A null source is the part ''.  A null id is neither smaller nor larger than
another, so such a row never fails E and makes no other fail.  Rows that repeat count each; equal ids are not smaller than one another.
Labels that repeat an id count as good, or toxic, if one of them says so; null labels say nothing.  An
empty table gives no rows.  Texts of any length are read whole.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2  # words, percent of words, percent of code points
SYMBOLS = r"[#$%&*|]"


def failures(text: Column) -> Column:
    """Bits of A to D for a text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    fails = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * F.size(words).cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    out = F.lit(0)
    for f, failing in fails.items():
        out = out + F.when(failing, BIT[f]).otherwise(0)
    return out


def later_copies(rows: DataFrame) -> DataFrame:
    """rows(doc_id, part, digest, text) of which an equal text has a smaller doc_id, without the text.

    Both joins are dealt by key at any size: texts move once to learn whether their digest is shared, and Spark can split a text that many rows share.
    """
    known = rows.where(F.col("doc_id").isNotNull())
    ids = known.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = ids.where("least < most").select("digest")
    several = written(known.join(shared.hint("merge"), "digest", "left_semi"), "several")
    first = written(several.groupBy(F.col("digest").alias("_digest"), F.col("text").alias("_text")).agg(F.min("doc_id").alias("_first")), "first")
    same = (F.col("digest") == F.col("_digest")) & (F.col("text") == F.col("_text")) & (F.col("doc_id") > F.col("_first"))
    return several.join(first.hint("merge"), same, "left_semi").drop("text")


def combinations(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters that they fail."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.sha2(whole, 256).alias("digest"), whole.alias("text"))
    marks = rows.select("doc_id", "part", "digest", failures(F.col("text")).alias("mask"), F.lit(1).cast("long").alias("n"))
    copies = later_copies(rows).select("doc_id", "part", "digest", F.lit(BIT["E"]).alias("mask"), F.lit(0).cast("long").alias("n"))
    by_doc = marks.unionByName(copies).groupBy("doc_id", "digest", "part").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    says = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    return by_doc.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")])


def audit(counts: DataFrame) -> DataFrame:
    """combinations() -> one row a part, order of the filters and step."""
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # at most 32 a part
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = per.select("part", "c", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select(
        "*", F.split("filter_order", "").alias("letters"), F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
    at = steps.withColumns({
        "own": bit_of(F.element_at("letters", F.col("step"))),
        "prior": F.aggregate(F.slice("letters", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit_of(x)),
    })
    own, prior = F.col("own"), F.col("prior")

    def total(take, what: str = "n") -> Column:  # noqa: ANN001
        return F.aggregate(F.filter("c", lambda x: take(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + x[what])

    has = lambda m: m.bitwiseAND(own) != 0
    early = lambda m: m.bitwiseAND(prior) != 0
    removed = lambda m: has(m) & ~early(m)
    n_orders = len(orders.split(","))
    return at.select(
        "part", "filter_order", "step",
        total(lambda m: ~has(m) & ~early(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: has(m) & early(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        # Of k filters that a document fails, each comes first in one k-th of the orders.
        F.aggregate(F.filter("c", lambda x: has(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.floor(F.lit(n_orders) / F.bit_count(x["mask"]))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(combinations(docs, labels, doc_id, text, source))
