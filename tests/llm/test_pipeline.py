"""The pipeline's decisions against plain Python, each stage on its own input, and very long texts."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridstats.llm import quality

SF = "/root/testdata/sf0.001"


def near_by_hand(rows, words=5, share=0.8):
    """Ids of the documents that stay: of each group of near copies the smallest."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, min(len(w), 1)))}
    above = {i: i for i in sets}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= share * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {i for i in sets if not sets[i] or root(i) == i}


def test_each_stage_decides_as_by_hand(spark):
    stage = dict(cp.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Near copies that only a few words part, so that the threshold decides.
    rng = random.Random(3)
    base = [r for r in docs.where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").limit(25).collect()]
    more = []
    for n, r in enumerate(base):
        w = r["text"].split(" ")
        for k in sorted(rng.sample(range(len(w)), rng.randint(1, max(2, len(w) // 25)))):
            w[k] = f"other{k}"
        more.append((100_000 + n, " ".join(w), r["lang"], r["source"], len(r["text"])))
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).cache()

    kept = stage["quality"](spark, docs, SF).cache()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = quality.Scorer(model.good, model.bad)
    want = {r["doc_id"] for r in docs.collect() if quality.probability(np.array([scorer.difference(r["text"])]), model.curve)[0] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()

    lines = stage["lines"](spark, kept, SF).cache()
    before, after = ({r["doc_id"]: r["text"] or "" for r in d.collect()} for d in (kept, lines))
    assert set(after) <= set(before)
    for i, text in after.items():  # lines go, nothing else changes
        left = iter(before[i].split("\n"))
        assert all(line in left for line in text.split("\n"))
    assert sum(map(len, after.values())) < sum(map(len, before.values()))

    near = stage["near"](spark, lines, SF).cache()
    stay = near_by_hand([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert {r["doc_id"] for r in near.collect()} == stay and len(stay) < lines.count()

    clean = stage["benchmark"](spark, near, SF).cache()
    gone = {r["doc_id"] for r in near.collect()} - {r["doc_id"] for r in clean.collect()}
    grams = lambda t, n=5: {tuple(w[k : k + n]) for w in [re.findall(r"\w+", (t or "").lower())] for k in range(len(w) - n + 1)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r["doc_id"]: r["text"] for r in near.collect()}
    whole = {i for i, t in text.items() if any(k <= grams(t) for k in items if k)}
    assert whole <= gone and all(any(grams(text[i]) & k for k in items) or re.search(r"\d", text[i]) for i in gone)

    mixed = stage["mixing"](spark, clean, SF).cache()
    size, taken, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in clean.collect():
        size[r["source"]] += count(r["text"])
    for r in mixed.collect():
        taken[r["source"]] += count(r["text"])
        copies[r["doc_id"]] += 1
        assert 1 <= r["copy"] <= r["copies"] <= 3
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.2) and all(taken[s] <= 3 * size[s] for s in size)
    assert {r["doc_id"]: r["copies"] for r in mixed.collect()} == copies


def test_very_long_texts_pass_every_stage_whole(spark):
    stage = dict(cp.STAGES)
    rng = random.Random(5)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    long = " ".join(word() for _ in range(60_000))
    near = long.rsplit(" ", 1)[0] + " changed"
    line = " ".join(word() for _ in range(30))
    rows = [(1, long), (2, near), (3, " ".join(word() for _ in range(60_000)) + " " + item), (4, f"{word()}\n" * 20_000 + line), (5, f"{word()} {word()}\n{line}\n" + "y" * 300_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert set(ids(stage["quality"](spark, docs, SF))) <= {1, 2, 3, 4, 5}
    cut = {r["doc_id"]: r["text"] for r in stage["lines"](spark, docs, SF).collect()}
    assert line in cut[4] and line not in cut[5] and len(cut[5]) > 300_000 and cut[1] == long
    assert ids(stage["near"](spark, docs, SF)) == [1, 3, 4, 5]
    assert ids(stage["benchmark"](spark, docs, SF)) == [1, 2, 4, 5]
    assert set(ids(stage["mixing"](spark, docs, SF))) <= {1, 2, 3, 4, 5}
