"""Quality rules: fixed counts over a text, and a linear classifier over hashed n-grams.

Words, pairs of words, and runs of 2 to 4 characters are hashed into BUCKETS columns a family; a column's value is its share of
the family's n-grams in the text, so a text's score is the mean of its n-grams' weights and needs no table of
its own.  The weights are those of a logistic regression that Spark fits on labelled rows; a second curve, fitted on labelled rows
that it has not seen, makes the score the probability of label 1.  Texts are then scored in Arrow batches, in place, against the fixed
thresholds of THRESHOLDS, the milder one for short texts, which hold little evidence.

Base rules: a text fails with fewer than MIN_WORDS words, or if more than MAX_REPEAT percent of its words stand in
windows of WINDOW words that it holds twice or more.

Fitting uses at most SAMPLE labelled rows of each class (those with the smallest hash of the id), two thirds for the weights and one third for
the curve; their texts are read whole.  Labels other than 0 and 1, null labels, null ids and the held-out fifth of the ids teach nothing; of labels
that repeat an id the smaller counts, of texts that repeat one the smallest.  If a class has no labelled row, every score is the share of good labels (0.5 without
any).  Null text has no words and fails the base rules like an empty one; repeated rows are judged alike; an empty table gives no rows.
Very long texts are read in pieces that end between words.  Other columns are kept; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.llm.quality import held_out, logistic, probability
from gridstats.llm.shared import discard, written
from gridstats.llm.shingles import mix, word_hashes

U = np.uint64
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30  # words, percent
SAMPLE = 2000  # labelled rows of a class
BUCKETS = 1 << 14  # columns of a family
FAMILIES = 5  # words, pairs of words, 2 to 4 characters
SCALE = 30.0  # of shares, so that one penalty suits all families
PENALTY, ROUNDS = 1e-4, 60
#: (words up to, probability needed); the last holds for all longer texts.
THRESHOLDS = ((60, 0.2), (None, 0.3))
CHUNK = 1 << 20  # bytes or characters handled together
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LINE_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Model:
    """Weights by column, start and curve; prior alone if there are no weights."""

    weights: np.ndarray | None
    start: float
    curve: tuple[float, float]
    prior: float


def hashed_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in pieces that end at a blank."""
    a = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(data):
        stop = at + CHUNK
        while stop < len(data) and not (blank := _SPACE[a[stop : stop + CHUNK]]).any():
            stop += CHUNK
        if stop < len(data):
            stop += int(blank.argmax())
        out.append(word_hashes(data[at:stop])[1])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, U)


def repeated_words(data: bytes, h: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that stand twice or more.  Hashes tell texts without any; the others compare their words themselves."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, U)
        for j in range(window):
            rolled = mix(rolled + h[j : j + n])
    if len(np.unique(rolled)) == n:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in data.split()), np.int64, len(h))
    width = 1
    while width < window:  # names of runs twice as long, exact
        pair = ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, data: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    a = np.frombuffer(data, np.uint8)
    chars = symbols = 0
    for at in range(0, len(a), CHUNK):
        b = a[at : at + CHUNK]
        chars += int((~_SPACE[b] & ((b & 0xC0) != 0x80)).sum())
        symbols += int(_SYMBOL[b].sum())
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(_LINE_SPACE):
            again += line in seen
            seen.add(line)
    return len(h), chars, symbols, again, repeated_words(data, h)


def grams(text: str, h: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of a text's n-grams, family after family and piece after piece."""
    with np.errstate(over="ignore"):
        for at in range(0, len(h), CHUNK):
            w = h[at : at + CHUNK + 1]
            yield (mix(w[:CHUNK] + U(1)) % U(BUCKETS)).astype(np.int64)
            if len(w) > 1:
                yield (mix(w[:-1] * U(3) + w[1:]) % U(BUCKETS)).astype(np.int64) + BUCKETS
        for at in range(0, len(text), CHUNK):
            c = np.frombuffer(text[at : at + CHUNK + 3].encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
            run = c
            for n in (2, 3, 4):
                if len(c) < n:
                    break
                run = run[: len(c) - n + 1] * U(0x1000003) + c[n - 1 :]
                yield (mix(run[:CHUNK]) % U(BUCKETS)).astype(np.int64) + n * BUCKETS


def columns(text: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, value) of a text, columns ascending."""
    count = np.zeros(FAMILIES * BUCKETS)
    for g in grams(text, h):
        count += np.bincount(g, minlength=len(count))
    total = count.reshape(FAMILIES, BUCKETS).sum(axis=1).repeat(BUCKETS)
    at = np.flatnonzero(count)
    return at, SCALE * count[at] / total[at]


def raw_score(text: str, h: np.ndarray, model: Model) -> float:
    """Log odds before the curve: the mean weight of each family's n-grams."""
    total, n = np.zeros(FAMILIES), np.zeros(FAMILIES)
    for g in grams(text, h):
        if len(g):
            family = int(g[0]) // BUCKETS
            total[family] += model.weights[g].sum(dtype=np.float64)
            n[family] += len(g)
    return model.start + SCALE * float((total / np.maximum(n, 1)).sum())


def _parts(text: str | None) -> tuple[str, bytes, np.ndarray]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    return text, data, hashed_words(data)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Weights from Spark's logistic regression over the sampled rows' columns, and the curve."""
    y = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    ).groupBy("_id").agg(F.min("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in y.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(None, 0.0, (0.0, 0.0), prior)
    picked = None
    for c in (0, 1):
        part = y.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    # At most 2 * sample rows of two numbers go out, and as many texts come back: of rows that repeat an id the smallest text.
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_t").alias("_t"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [columns(t, h) for t, _, h in map(_parts, b["_t"])]
            yield pd.DataFrame({"_y": b["_y"], "teaches": b["teaches"], "at": [f[0] for f in found], "value": [f[1] for f in found]})

    teaches = F.pmod(F.xxhash64(F.lit("role"), "_id"), F.lit(3)) < 2
    rows = written(chosen.select("_y", "_t", teaches.alias("teaches")).mapInPandas(featured, "_y int, teaches boolean, at array<int>, value array<double>"), "columns")
    have = {(r["teaches"], r["_y"]): r["n"] for r in rows.groupBy("teaches", "_y").agg(F.count("*").alias("n")).collect()}
    taught = [have.get((True, c), 0) for c in (0, 1)]
    if not all(taught):
        discard(rows)
        return Model(None, 0.0, (0.0, 0.0), prior)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    vector = F.udf(lambda at, value: SparseVector(FAMILIES * BUCKETS, at, value), VectorUDT())
    even = F.when(F.col("_y") == 1, 0.5 / taught[1]).otherwise(0.5 / taught[0]) * sum(taught)
    train = rows.where("teaches").select(F.col("_y").cast("double").alias("label"), even.alias("weight"), vector("at", "value").alias("features"))
    found = LogisticRegression(weightCol="weight", regParam=PENALTY, maxIter=ROUNDS, standardization=False).fit(train)
    weights = found.coefficients.toArray().astype(np.float32)
    start = float(found.intercept)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [start + float(weights[a].astype(float) @ v) for a, v in zip(b["at"], b["value"], strict=True)]
            yield pd.DataFrame({"y": b["_y"], "d": d})

    seen = rows.where("NOT teaches").mapInPandas(rate, "y int, d double").toPandas()  # two numbers a row
    discard(rows)
    truth, d = seen["y"].to_numpy(float), seen["d"].to_numpy(float)
    if not 0 < truth.sum() < len(truth):
        return Model(weights, start, (float(np.log(prior / (1 - prior))), 1.0), prior)
    weight = np.where(truth == 1, prior / truth.mean(), (1 - prior) / (1 - truth.mean()))
    return Model(weights, start, logistic(d, truth, weight), prior)


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def judge(docs: DataFrame, model: Model, text: str = "text", thresholds: tuple[tuple[int | None, float], ...] = THRESHOLDS) -> DataFrame:
    """Adds the base counts, base_failed, score and kept.  One pass in place: no shuffle."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    src = docs.drop(*[c for c in (*names, "base_failed", "kept") if c != text])

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for t, data, h in map(_parts, s):
                x = model.prior if model.weights is None else float(probability(np.array([raw_score(t, h, model)]), model.curve)[0])
                out.append((*base_counts(t, data, h), x))
            yield pd.DataFrame(out, columns=names)

    n = F.col("n_words")
    needed = F.lit(thresholds[-1][1])
    for most, p in reversed(thresholds[:-1]):
        needed = F.when(n <= most, p).otherwise(needed)
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * n)
    found = "_found"
    while found in {c.lower() for c in src.columns}:
        found = f"_{found}"
    keep = [c for c in src.columns]
    return src.withColumn(found, judged(F.col(text))).select(*keep, f"{found}.*").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= needed))
