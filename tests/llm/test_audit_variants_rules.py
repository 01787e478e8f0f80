"""Filter audit, spelling variants and quality rules against brute force, and odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstats.llm import audit, rules, variants
from gridstats.llm.quality import held_out

LABELS = "doc_id long, quality int, toxic int"


# 11. Filter audit


def audit_by_hand(rows, labels):
    """Each order, step by step, over every row."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    known = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        known.append((source or "", i, fails))
    out, total = {}, Counter()
    for part in {k[0] for k in known}:
        own = [k for k in known if k[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[2]]
                left = [k for k in left if f not in k[2]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in k[2] for k in own) - len(gone), sum(k[2] == {f} for k in own),
                    sum(k[1] in good for k in gone), sum(k[1] in toxic for k in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_the_filters_in_every_order(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.sample(words, 250)), " ".join(rng.choices(words[:60], k=300)), "SHOUT " * 40, "a #tag", "", None, "plain words " * 150]
    rows = [(rng.choice([None, *range(40)]), rng.choice(base), rng.choice(["x", "y", None, ""])) for _ in range(120)]
    rows += [(7, "same id, other text", "x"), (7, "same id, other text", "x"), (8, "same id, other text", "y"), (3, base[0], "x"), (2, base[0], "y")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(4, None, None), (6, 0, 1), (None, 1, 1), (5, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("clash"), "digest": F.lit(1), "mask": F.lit("m"), "n": F.lit(0)})
    found = audit.audit_filters(docs, spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], LABELS).withColumn("good", F.lit(9)))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found.collect()}
    assert got == audit_by_hand(rows, labels)


def test_audit_of_an_empty_table_and_one_hot_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit_filters(docs, labels).count() == 0
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("s").alias("source"))
    got = audit.audit_filters(hot, labels).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r["kept"], r["removed"]) for r in got[:2]] == [(1, 4999), (0, 1)]


# 12. Spelling variants


def variants_by_hand(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def spelled(rng, letters, size):
    return "".join(rng.choice(letters) for _ in range(size))


def test_variants_are_all_pairs_one_edit_apart(spark):
    rng = random.Random(8)
    stems = [spelled(rng, "aeéÉstn", rng.randint(4, 9)) for _ in range(60)] + ["a" * 300, "ab" * 150, "Straße", "ÀÉîõÿ", "aaaaa", "aaaaaa", "aaaaaaa"]
    words = []
    for s in stems:
        words += [s] * rng.randint(3, 40)
        for _ in range(4):
            k, c = rng.randrange(len(s)), rng.choice("aestxé")
            words += [rng.choice((s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :]))] * rng.randint(1, 9)
    rng.shuffle(words)
    rows = [(rng.choice([None, *range(30)]), " ".join(x if rng.random() < 0.8 else x.upper() for x in words[k : k + 25])) for k in range(0, len(words), 25)]
    rows += [rows[0], (1, None), (2, ""), (3, "12 ** 34"), (4, "x-ray's\ttwo\nlines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "form": F.lit(2), "sig": F.lit(3)})
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.group_variants(docs).collect()}
    assert got == variants_by_hand(rows)
    assert any(v[2] for v in got.values()) and any(v[4] not in (w, v[2]) for w, v in got.items())


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "one two")]):
        assert variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("first", "second"), [(1, 8), (1, 4), (2, 4), (3, 1)])
def test_vectors_within_two_share_a_signature(spark, first, second):
    """Whatever the partitioning, the signatures lose no pair within the distance."""
    rng = random.Random(first * 10 + second)
    bags = sorted({"".join(sorted(spelled(rng, "abcdefgh", rng.randint(4, 7)))) for _ in range(150)})
    df = spark.createDataFrame([(b, 1) for b in bags], "letters string, words long")
    sigs = {}
    for r in variants.signatures(df, 2, first, second).select("sig", "letters").collect():
        sigs.setdefault(r["letters"], set()).add(r["sig"])
    for a in bags:
        for b in bags:
            if a < b and sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) <= 2:
                assert sigs[a] & sigs[b]


def test_very_long_words(spark):
    rows = [(k, f"{'ab' * 20_000} {'ab' * 20_000}c") for k in range(1, 6)]
    got = {len(r["word"]): (r["n"], r["n_near"]) for r in variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {40_000: (5, 1), 40_001: (5, 1)}


# 13. Quality rules


def counts_by_hand(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_base_counts_are_the_counts_by_hand(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "x" * 3000, "one two\none two\n\n\none two \n", "é ü\x0bñ z #*$%&|<>", "a b c d e f g h " * 3 + "a b", "same " * 40, "  line line"]
    for _ in range(60):
        vocab = [spelled(rng, "abé#|", rng.randint(1, 6)) for _ in range(rng.choice((2, 5, 60)))]
        texts.append("".join(rng.choice(vocab) + rng.choice((" ", " ", "\n", "\t ")) for _ in range(rng.randint(1, 200))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "score": F.lit(3), "kept": F.lit(1), "_found": F.lit(2)})
    out = rules.judge(docs, rules.Model(None, 0.0, (0.0, 0.0), 0.9)).collect()
    assert len(out) == len(texts)
    for r in out:
        n = counts_by_hand(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, r["text"]
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed) and r["_found"] == 2


def test_pieces_of_a_long_text_are_the_whole(monkeypatch):
    rng = random.Random(9)
    text = " ".join(spelled(rng, "abcdéf#", rng.randint(1, 12)) for _ in range(400)) + "\n" + "y" * 500 + " end"
    whole = rules.columns(text, rules.hashed_words(text.encode()))
    counts = rules.base_counts(text, text.encode(), rules.hashed_words(text.encode()))
    monkeypatch.setattr(rules, "CHUNK", 64)
    h = rules.hashed_words(text.encode())
    at, value = rules.columns(text, h)
    assert (at == whole[0]).all() and np.allclose(value, whole[1])
    assert rules.base_counts(text, text.encode(), h) == counts
    model = rules.Model(np.random.default_rng(1).normal(size=rules.FAMILIES * rules.BUCKETS).astype(np.float32), 0.25, (0.0, 1.0), 0.5)
    assert rules.raw_score(text, h, model) == pytest.approx(0.25 + float(model.weights[at].astype(float) @ value), rel=1e-5)


def test_no_labels_and_one_class_give_the_prior(spark):
    docs = spark.createDataFrame([(k, "word " * k) for k in range(1, 40)], "doc_id long, text string")
    for rows, prior in (([], 0.5), ([(k, 1, 0) for k in range(1, 20)], 1.0), ([(None, 1, 0), (3, None, 0), (4, 7, 0)], 0.5)):
        model = rules.fit(docs, spark.createDataFrame(rows, LABELS))
        assert model.weights is None and model.prior == prior
        assert {r["score"] for r in rules.judge(docs, model).collect()} == {prior}
    assert rules.judge(docs.limit(0), model).count() == 0


SF = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_verdicts_on_rows_that_taught_nothing(spark):
    docs, labels = spark.read.parquet(str(SF / "documents.parquet")), spark.read.parquet(str(SF / "labels.parquet"))
    model = rules.fit(docs, labels)
    seen = rules.judge(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")) & ~F.col("base_failed"))
    by = {r["quality"]: (r["n"], r["kept"]) for r in seen.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1][1] >= 0.99 * by[1][0] and by[0][1] <= 0.1 * by[0][0]
    clean = seen.where("toxic = 1 AND quality = 1")  # toxic, but well written
    assert clean.where("kept").count() >= 0.98 * clean.count()
