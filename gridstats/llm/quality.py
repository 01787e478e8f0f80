"""Quality classifier by compression.

Two zstandard dictionaries are trained on pieces of good and of bad labelled texts.  A text is compressed with either,
in pieces of PIECE bytes so that the dictionary and not the text itself explains each; the difference of the two
compressed sizes over the larger one is all that enters a score.  A logistic curve over it, fitted on labelled rows that no
dictionary has seen and never falling, makes it the probability of label 1.

Training uses at most SAMPLE labelled texts of each class (those with the smallest hash of the id), two thirds for the
dictionaries and one third for the curve.  A dictionary is trained on all pieces of its texts (equal ones once), in a task of their class, and only the dictionary is
collected; the other third is compressed whole where it lies, and only the differences are collected.  Scoring reads every whole text, of any
length, in bounded memory.

Null text is scored as empty text; its difference is 0, so empty texts share a defined score.  Labels other than 0 and 1, null labels and
null ids teach nothing; of labels that repeat an id one counts.  If a class has no labelled row, or too little text to train a dictionary on,
every score is the share of good labels (0.5 without any).  Repeated rows score alike.  An empty table gives no rows.  Other columns are kept, `score` and
`predicted` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 1500  # texts of a class
LEARN = 400  # characters of a piece that trains
DICTIONARY = 16_000  # bytes
SEGMENT, SEED = 64, 6  # bytes that a dictionary takes at once, and that tell whether they recur
PIECE = 400  # bytes that are compressed at once
LEVEL = 3
THRESHOLD = 0.3


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves remainder 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass(frozen=True)
class Model:
    """Dictionaries and curve: score = 1 / (1 + exp(-(start + slope * difference))); prior alone if there is no curve."""

    good: bytes
    bad: bytes
    curve: tuple[float, float] | None
    prior: float


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes | None:
    """Trained on the pieces; None if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=SEED).as_bytes()
    except zstandard.ZstdError:
        return None


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """The dictionary of a class, from all its texts; the sample's bound is the bound of what is held here."""
    pieces = {t[i : i + LEARN].encode("utf-8", "surrogatepass") for t in rows["_t"] for i in range(0, len(t), LEARN)}
    pieces = sorted(pieces, key=lambda p: (crc32(p), p))  # mixed, as the trainer holds some of them back, and the same in every run
    return pd.DataFrame({"_y": rows["_y"].iloc[:1], "trained": [dictionary(pieces)]})


class Scorer:
    """The two compressors; one pair a task."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.pair = []
        for d in (good, bad):
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=z, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str | None) -> tuple[int, int]:
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        return good, bad

    def difference(self, text: str | None) -> float:
        """From -1 to 1; positive if the good dictionary compresses better."""
        good, bad = self.sizes(text)
        return (bad - good) / max(good, bad, 1)


def probability(difference: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * difference, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(start, slope) by Newton steps, the slope at least 0."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones(len(x)), (x - mean) / scale], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[1] / scale, 0.0)
    return float(w[0] - slope * mean), float(slope)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    y = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    ).groupBy("_id").agg(F.min("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in y.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(b"", b"", None, prior)
    picked = None
    for c in (0, 1):
        part = y.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(picked), "_id")  # at most 2 * sample
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_t").alias("_t"))  # of rows that repeat an id one, the smallest text
    teaches = F.pmod(F.xxhash64(F.lit("role"), "_id"), F.lit(3)) < 2
    trained = rows.where(teaches & (F.length("_t") > 0)).groupBy("_y").applyInPandas(_train, "_y int, trained binary")
    found = {r["_y"]: bytes(r["trained"]) for r in trained.where("trained IS NOT NULL").collect()}  # two dictionaries
    if len(found) < 2:
        return Model(b"", b"", None, prior)
    good, bad = found[1], found[0]

    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(good, bad)
        for s in batches:
            yield pd.Series([scorer.difference(t) for t in s], dtype=float)

    seen = rows.where(~teaches).select("_y", difference(F.col("_t")).alias("d")).toPandas()  # two numbers a row
    truth, x = seen["_y"].to_numpy(float), seen["d"].to_numpy(float)
    if not 0 < truth.sum() < len(truth):
        return Model(good, bad, (float(np.log(prior / (1 - prior))), 10.0), prior)
    weight = np.where(truth == 1, prior / truth.mean(), (1 - prior) / (1 - truth.mean()))
    return Model(good, bad, logistic(x, truth, weight), prior)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted.  One pass in place: no shuffle."""
    src = docs.drop(*[c for c in ("score", "predicted") if c != text])

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.good, model.bad) if model.curve else None
        for s in batches:
            yield pd.Series(
                probability(np.array([scorer.difference(t) for t in s], float), model.curve) if scorer else np.full(len(s), model.prior)
            )

    return src.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
