"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weighted share of all words, at most `most` times its own size.  Each of its
documents then has the same expected number of copies; the whole part is taken, and the
fractional parts are rounded dependently: in a pair, mass is moved at random from one document to the
other, in proportion to their sizes, until one of the two is integral.  The words taken stay the same at every
move, so each source ends within one document of its target.

Pairs are formed in parallel in chunks of a source; each chunk leaves one fractional document at
most.  Those residuals go up a tree of fan-in FAN until each source has one, which goes to the
nearer side.  Random numbers come from hashes of the documents: reruns and repartitioning agree.

Size: number of runs of `[^\\x20\\x09-\\x0D]` characters; null text has size 0 and is never taken, nor is
a source without words (target 0).  A null source is a source, the last.  Repeated rows (id and
text) are documents of their own, told apart by a number among equals.  Texts of any length count whole; ties of seeds are
broken by id, size and number; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstats.llm.shared import discard, written
from gridstats.llm.shingles import mix as mixed

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
CHUNK = 1000  # documents
FAN = 500
FEW_SOURCES = 20_000  # rows of the source table that may be broadcast


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, th)"""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text)).alias("th"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target, ratio): shares by weight, capped, the excess reshared until none is above.

    Sources are ranked by code point over ranges, so no single task sees them all.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged = written(
        per.withColumn("last", F.col("source").isNull()).repartitionByRange(F.col("last"), F.col("source"))
        .withColumn("part", F.spark_partition_id()), "sources",
    )
    before = [0]
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    for p in range(max(counts, default=-1) + 1):
        before.append(before[-1] + counts.get(p, 0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + F.element_at(F.array(*[F.lit(b) for b in before]), F.col("part") + 1)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(ranged.withColumn("weight", F.element_at(kinds, place % len(weights) + 1)).select("source", "source_size", "n_docs", "weight"), "weights")
    discard(ranged)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("weight") * level > most * F.col("source_size")
        row = ranked.agg(
            F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("int"))
        ).first()
        held, free = row[0] or 0.0, row[1] or 0.0
        new = (total - held) / free if free > 0 else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * level, most * F.col("source_size"))
    out = written(ranked.select(
        "source", "source_size", "n_docs", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(0.0).alias("ratio"),
    ), "targets")
    discard(ranked)
    return out


def pivot(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> int:
    """Rounds p in place, keeping sum(size * p) but for one residual; its position, or -1."""
    eps = 1e-12
    i = -1
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b, wa, wb = p[i], p[j], size[i], size[j]
        up = min((1 - a) * wa, b * wb)  # mass that may move from j to i
        down = min(a * wa, (1 - b) * wb)
        if draw[j] * (up + down) < down:  # moves up with probability down / (up + down): expectations stay
            a, b = a + up / wa, b - up / wb
        else:
            a, b = a - down / wa, b + down / wb
        p[i], p[j] = a, b
        open_i, open_j = eps < a < 1 - eps, eps < b < 1 - eps
        for k, is_open in ((i, open_i), (j, open_j)):
            if not is_open:
                p[k] = round(p[k])
        i = i if open_i else j if open_j else -1
    return i


_ROWS = "doc_id string, size long, source_size long, target double, taken long, copies long, p double, sid long, node long, seed long, nth int"


def draws(seed: np.ndarray, level: int) -> np.ndarray:
    """Uniform numbers, independent from level to level of the tree, of documents' seeds."""
    with np.errstate(over="ignore"):
        x = mixed(seed.view(np.uint64) ^ mixed(np.full(len(seed), level + 1, np.uint64)))
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def _round(level: int):  # noqa: ANN202
    """What a node of the tree at that level does: at most one document keeps a fraction, the others' copies are settled."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that what is left over tends to be small.
        rank = pdf.assign(_class=-np.log2(pdf["size"] + 1).astype(int))
        pdf = rank.sort_values(["_class", "seed", "doc_id", "size", "nth"], kind="stable", ignore_index=True).drop(columns="_class")
        p = pdf["p"].to_numpy(float).copy()
        left = pivot(pdf["size"].to_numpy(float), p, draws(pdf["seed"].to_numpy(np.int64), level))
        settled = np.ones(len(pdf), bool)
        if left >= 0:
            settled[left] = False
        copies = pdf["copies"].to_numpy(np.int64) + np.where(settled, p, 0).astype(np.int64)
        return pdf.assign(copies=copies, taken=np.where(settled, copies * pdf["size"], -1), p=np.where(settled, 0.0, p))

    return settle


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, source, th (its text's hash), nth (among equals)."""
    sized = written(sizes(docs, doc_id, text, source), "sizes")
    want = targets(sized, weights, most)
    named = (F.broadcast(want) if want.count() <= FEW_SOURCES else want).withColumnsRenamed({"source": "_source"})
    with_target = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Equal rows are numbered; a window only over those that have equals would not change a number.
    same = with_target.groupBy("doc_id", "source", "size", "th", "source_size", "n_docs", "target", "ratio").agg(F.count("*").alias("times"))
    rows = same.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    seed = F.xxhash64("doc_id", "th", "nth")
    chunks = F.ceil(F.col("n_docs") / CHUNK)
    whole = F.floor(F.col("ratio") + 1e-12)
    # Ids travel as text, so that a null among them changes no value.
    start = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), "size", "source_size", "target", F.lit(-1).cast("long").alias("taken"), whole.cast("long").alias("copies"),
        F.when(F.col("size") > 0, F.greatest(F.col("ratio") - whole, F.lit(0.0))).otherwise(0.0).alias("p"),
        F.xxhash64(F.coalesce("source", F.lit("\0null"))).alias("sid"), F.pmod(F.xxhash64(seed, F.lit(1)), chunks).alias("node"),
        seed.alias("seed"), "nth", "source", "th",
    )
    most_docs = want.agg(F.max("n_docs")).first()[0] or 0
    kind = _ROWS + ", source string, th long"
    level = written(start.groupBy("sid", "node").applyInPandas(_round(0), kind), "mix0")
    discard(sized, want)
    done = [level.where("taken >= 0")]
    left, nodes = level.where("taken < 0"), math.ceil(most_docs / CHUNK)
    height = 0
    while nodes > 1:
        height += 1
        up = left.withColumn("node", F.floor(F.col("node") / FAN))
        level = written(up.groupBy("sid", "node").applyInPandas(_round(height), kind), "mixup")
        done.append(level.where("taken >= 0"))
        left, nodes = level.where("taken < 0"), math.ceil(nodes / FAN)
    # One document a source is left: it goes to the nearer side.
    copies = F.col("copies") + F.round("p").cast("long")
    done.append(left.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "source", "th", "nth")
