"""Nearest neighbours (inner product) by additive quantisation.

BOOKS codebooks of full-dimensional codewords are fitted on a bounded sample by k-means on
residuals.  Every vector is encoded by beam search: the BEAM best partial sums go on to the next
codebook.  A query's table holds its inner product with every codeword; a vector's guess is the
sum of its BOOKS entries, times the stored scale of its decoded sum.  With each code goes its reach, the length of
what the code leaves out: no score differs from its guess by more than reach times the query's length.  Every
vector whose guess and bound come up to the k-th best score found so far is scored on the original vectors
in double precision, so no neighbour is lost; codebooks that fit badly only make the search slower.

Queries are stated, candidates are all vectors.  Vectors and codes stay where they were written, in rows of BLOCK vectors; at most about QUERIES queries at
a time go to all tasks, and each task keeps one running list a query over the rows that it reads.  Only lists are exchanged: no vector
moves however many queries there are, and the table is read once for every QUERIES of them.

Equal vectors are one candidate and one query, named by their smallest id and, as different vectors may share that, a 64-bit hash.  The k + 1 best of them hold all that a query can
list (it is among them itself); they become ids at the end, by score and id, of equal vectors the k + 1 smallest ids.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose length is
not the most frequent one (ties: the longest); rows without an id take no part.  Rows that repeat an id are rows like others: each is a candidate, and each a query
that leaves out only itself; its list stands once for each such row.  Other columns, whatever their names, are ignored; without vectors or without
queries there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstats.llm.shared import discard, written

BOOKS = 24
WORDS = 256
BEAM = 3
SAMPLE = 4096  # vectors that codebooks are fitted on
K = 20
BLOCK = 2048  # vectors
QUERIES = 32_768  # that go to the tasks at once: with their lists some 40 MB at 64 components
SLICE = 64  # queries that are looked up together
PAIRS = 1 << 20  # products held at once in exact scoring


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """(books, words, dim) codebooks."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    out, left = [], x.copy()
    for _ in range(books):
        c = left[rng.integers(0, len(left), words)].copy()
        for _ in range(rounds):
            near = _nearest(left, c)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            at = np.cumsum(n) - n
            some = n > 0
            c[some] = np.add.reduceat(left[order], at[some], axis=0) / n[some, None]
            c[~some] = left[rng.integers(0, len(left), int((~some).sum()))]
        left = left - c[_nearest(left, c)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes by beam search over the squared error, with products of codewords from tables."""
    m, words, dim = books.shape
    flat = books.reshape(-1, dim)
    cross = flat @ flat.T
    half = 0.5 * np.einsum("ij,ij->i", flat, flat)
    codes = np.zeros((len(x), m), np.uint8)
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512].astype(np.float32)
        gain = part @ flat.T - half  # larger is nearer
        n = len(part)
        total = gain[:, :words]
        width = min(beam, words)
        best = np.argpartition(-total, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(total, best, 1)
        paths = best[:, :, None]
        for b in range(1, m):
            own = gain[:, None, b * words : (b + 1) * words].repeat(paths.shape[1], 1)
            for j in range(b):
                own -= cross[j * words + paths[:, :, j], b * words : (b + 1) * words]
            all_ = (score[:, :, None] + own).reshape(n, -1)
            width = min(beam, all_.shape[1])
            pick = np.argpartition(-all_, width - 1, axis=1)[:, :width]
            score = np.take_along_axis(all_, pick, 1)
            old = np.take_along_axis(paths, (pick // words)[:, :, None], 1)
            paths = np.concatenate([old, (pick % words)[:, :, None]], axis=2)
        codes[lo : lo + n] = paths[np.arange(n), score.argmax(1)]
    return codes


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): finite, non-zero vectors of the usual length; v keeps single precision if it has it, else is double."""
    v = F.col("v")
    kind = "float" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "double"
    ok = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    lengths = ok.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    return ok.where(F.size("v") == dim)


def exact_scores(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """q[rows] . x[cols] in double precision, summed in order of components."""
    out = np.empty(len(rows))
    step = max(1, PAIRS // x.shape[1])
    for lo in range(0, len(rows), step):
        at = slice(lo, lo + step)
        out[at] = np.cumsum(x[cols[at]].astype(float) * q[rows[at]], axis=1)[:, -1]
    return out


def keep_best(best: np.ndarray, found: np.ndarray, hashes: np.ndarray, rows: np.ndarray, ids: np.ndarray, id_hashes: np.ndarray, scores: np.ndarray) -> None:
    """Puts scored candidates into the lists (score descending, id, hash), in place; best is -inf where a list has room."""
    n, k = best.shape
    row = np.concatenate([np.repeat(np.arange(n), k), rows])
    score, name, tie = np.concatenate([best.ravel(), scores]), np.concatenate([found.ravel(), ids]), np.concatenate([hashes.ravel(), id_hashes])
    order = np.lexsort((tie, name, -score, row))
    per = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    order = order[place < k]  # every list has at least k rows
    best[:], found[:], hashes[:] = score[order].reshape(n, k), name[order].reshape(n, k), tie[order].reshape(n, k)


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, its k best among all others."""
    spark = vectors.sparkSession
    found = usable(vectors, vec_id, embedding)
    kind = found.schema["v"].dataType.elementType
    real = np.float32 if isinstance(kind, T.FloatType) else np.float64
    rows = written(found.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind))), "vectors")  # -0 is 0
    same = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    base = written(least.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("h", F.xxhash64("v")), "distinct")
    shape = "query_id long, rank int, vec_id long, score double"
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id", "h").limit(sample).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], shape)
    fitting = np.array([r["v"] for r in drawn]).astype(np.float32)
    fitting = fitting[np.abs(fitting).max(axis=1) < 1e18]  # products of longer vectors leave single precision; they are scored without a bound
    books = train(fitting if len(fitting) else np.ones((1, len(drawn[0]["v"])), np.float32))
    dim = books.shape[2]
    lengths = np.linalg.norm(books.astype(float), axis=2)
    parts = max(1, -(-base.count() // BLOCK))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of vectors and codes: at most BLOCK vectors a row."""
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                part = pdf.iloc[lo : lo + BLOCK]
                ids = part["vec_id"].to_numpy(np.int64)
                x = np.stack(part["v"].to_numpy()).astype(real)
                codes = encode(x, books)
                whole, sums = x.astype(float), decode(codes, books.astype(float))
                scale = ((whole * sums).sum(1) / np.maximum((sums * sums).sum(1), 1e-30)).astype(np.float32)
                reach = np.linalg.norm(whole - scale[:, None].astype(float) * sums, axis=1)
                # What single precision may add to a guess.
                size = np.abs(scale.astype(float)) * sum(lengths[j][codes[:, j]] for j in range(len(books)))
                reach = reach * (1 + 1e-12) + (dim + len(books) + 8) * 2.0**-23 * (size + np.linalg.norm(whole, axis=1))
                yield pd.DataFrame({"ids": [ids.tobytes()], "hs": [part["h"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "codes": [codes.tobytes()], "scales": [scale.tobytes()], "reaches": [reach.tobytes()]})

    codes = written(base.repartition(parts, "vec_id", "h").mapInPandas(pack, "ids binary, hs binary, x binary, codes binary, scales binary, reaches binary"), "codes")
    wanted = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").cast("int").alias("times"))
    # own: the place of one of the query's rows among the ids of its vector.
    asking = written(
        wanted.join(base.withColumnRenamed("vec_id", "query"), "v").select("query_id", "times", "v", "query", F.col("h").alias("query_h"), F.array_position("ids", F.col("query_id")).alias("own")), "asking"
    )
    mine = asking.select(F.col("query").alias("vec_id"), F.col("query_h").alias("h"), "v").dropDuplicates(["vec_id", "h"])
    blocks = max(1, -(-mine.count() // QUERIES))
    asked = written(mine.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id", "h"), F.lit(blocks)).cast("int")), "queries")
    discard(rows)

    def scan_for(own: list) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """The scan of vectors for these queries."""
        q_ids, q_hs = (np.array([r[c] for r in own], np.int64) for c in ("vec_id", "h"))
        q = np.array([r["v"] for r in own]).astype(real)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            long = np.linalg.norm(q.astype(float), axis=1)
            best, found, hashes = np.full((len(q_ids), k + 1), -np.inf), *np.zeros((2, len(q_ids), k + 1), np.int64)
            for pdf in batches:
                for ids, hs, x, code, scale, reach in zip(*(pdf[c] for c in ("ids", "hs", "x", "codes", "scales", "reaches")), strict=True):
                    ids, hs, scale, reach = np.frombuffer(ids, np.int64), np.frombuffer(hs, np.int64), np.frombuffer(scale, np.float32), np.frombuffer(reach, float)
                    x = np.frombuffer(x, real).reshape(len(ids), dim)
                    code = np.frombuffer(code, np.uint8).reshape(len(ids), -1)
                    for lo in range(0, len(q_ids), SLICE):
                        at = slice(lo, lo + SLICE)
                        t = (q[at].astype(np.float32) @ books.reshape(-1, dim).T).reshape(-1, books.shape[0], books.shape[1])
                        s = t[:, 0, :][:, code[:, 0]]
                        for j in range(1, books.shape[0]):
                            s += t[:, j, :][:, code[:, j]]
                        s *= scale
                        bound = s + long[at, None] * reach
                        bound[~(np.isfinite(s) & np.isfinite(bound))] = np.inf  # beyond single precision: no bound
                        # The best guesses first, as they raise the score to be reached; then all whose bound reaches it.
                        few = min(k + 1, len(ids))
                        first = np.argpartition(-bound, few - 1, axis=1)[:, :few]
                        rows, cols = np.repeat(np.arange(len(s)), few), first.ravel()
                        for again in (True, False):
                            keep_best(best[at], found[at], hashes[at], rows, ids[cols], hs[cols], exact_scores(x, q[at], rows, cols))
                            if again:
                                bound[rows, cols] = -np.inf
                                rows, cols = np.nonzero((bound >= best[at, -1:]) & (bound > -np.inf))
            out = pd.DataFrame({"query": np.repeat(q_ids, k + 1), "query_h": np.repeat(q_hs, k + 1), "name": found.ravel(), "name_h": hashes.ravel(), "score": best.ravel()})
            yield out[out["score"] > -np.inf]

        return scan

    best = Window.partitionBy("query", "query_h").orderBy(F.desc("score"), "name", "name_h")
    listed = None
    for block in range(blocks):
        own = asked.where(F.col("block") == block).select("vec_id", "h", "v").collect()  # about QUERIES
        if not own:
            continue
        scored = codes.mapInPandas(scan_for(own), "query long, query_h long, name long, name_h long, score double")
        lists = written(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "lists")
        listed = lists if listed is None else listed.union(lists)
    discard(codes, asked)
    if listed is None:
        return spark.createDataFrame([], shape)
    ids = listed.join(base.select(F.col("vec_id").alias("name"), F.col("h").alias("name_h"), "ids"), ["name", "name_h"]).select(
        "query", "query_h", "name", "name_h", "score", F.posexplode("ids").alias("at", "vec_id")
    )
    best = Window.partitionBy("query", "query_h").orderBy(F.desc("score"), "vec_id", "name_h", "at")
    spread = ids.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    itself = (F.col("name") == F.col("query")) & (F.col("name_h") == F.col("query_h")) & (F.col("at") + 1 == F.col("own"))
    others = asking.drop("v").join(spread, ["query", "query_h"]).where(~itself)
    best = Window.partitionBy("query_id", "query", "query_h").orderBy("r")
    ranked = others.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", "rank", "vec_id", "score")
