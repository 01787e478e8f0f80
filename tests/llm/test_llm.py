"""Operators of gridstats.llm against brute force, round trips, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gridstats.llm import ann, decontam, graph, jaccard, licenses, linededup, mixing, pii, quality, shingles, tokencount, warc
from gridstats.llm.queries import vocabulary

ODD = [(1, None), (2, ""), (2, ""), (None, " \t\n"), (3, "x" * 50_000), (None, None), (4, "a b " * 9_000)]


def docs_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1. License scan


def test_license_base_places(spark):
    rows = [*ODD, (5, "MIT License mit-license, MIT"), (6, "GNU General Public License, version 3 é apache\nLICENSE 2.0"), (7, "mit license " * 500)]
    out = licenses.scan_licenses(docs_of(spark, rows, labels="clash", n_words=1, _norm=2)).collect()
    assert len(out) == len(rows)
    for r in out:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        at, names = [], set()
        for phrase, name in licenses.BASE_PHRASES:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            names |= {name} if hits else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)))
        assert names <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules_suppress_what_they_contain(spark):
    out = licenses.scan_licenses(docs_of(spark, [(1, "Licensed under the GNU General Public License, version 3."), (2, "SPDX-License-Identifier: Apache-2.0")])).collect()
    by = {r["doc_id"]: r for r in out}
    assert [(d["label"], d["priority"]) for d in by[1]["detections"]] == [("gpl-3.0", 1)]
    assert by[1]["labels"] == "gpl,gpl-3.0" and by[2]["labels"] == "apache-2.0" and by[2]["score"] == 1.0
    assert len(licenses.rules()) > 300


def test_license_scan_has_no_python(spark):
    plan = licenses.scan_licenses(docs_of(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def examples(tree):
    """Texts that a rule matches: every alternative, options left out and taken."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind in ("NOT_LITERAL", "IN"):
            more = ["x"] if kind == "NOT_LITERAL" or str(arg[0][0]) == "NEGATE" else [chr(c if isinstance(c, int) else c[0]) for _, c in arg]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * n for n in {arg[0], min(arg[1], arg[0] + 1)} for x in examples(arg[2])]
        elif kind == "SUBPATTERN":
            more = examples(arg[3])
        elif kind == "BRANCH":
            more = [x for a in arg[1] for x in examples(a)]
        else:
            assert kind == "ASSERT_NOT"
            more = [""]
        out = list(dict.fromkeys(a + b for a in out for b in more))
    return out


def test_every_example_of_a_rule_passes_its_gates():
    lost = set()
    for _, label, kw, kw2, rx, _ in licenses.rules():
        if rx.startswith("(?<="):
            continue  # within an expression: tested by its texts
        for x in examples(re._parser.parse(rx)):
            assert re.fullmatch(rx, x), (rx, x)
            x = f" {x} "
            if kw not in x or kw2 not in x or not any(a in x for a in licenses.ANCHORS):
                lost.add((label, kw, kw2, x))
    assert not lost


def test_long_names_and_bodies_are_found(spark):
    rows = [
        (1, "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."), (2, "CC BY-NC-ND 3.0"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"),
        (4, "SPDX-License-Identifier: CC-BY-SA-4.0"), (5, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert out == {1: ("cc-by-sa-4.0", 0.95), 2: ("cc-by-nc-nd-3.0", 0.7), 3: ("mit", 0.95), 4: ("cc-by-sa-4.0", 1.0), 5: ("bsd", 0.8)}


FAMILIES = {
    "SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause": "apache-2.0,bsd-3-clause,mit",
    "// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": "linux-syscall-note",
    "Code is GPLv3 or later, see GPL-2.0 licence": "gpl-2.0,gpl-3.0",
    "as published by the Free Software Foundation, either version 3": "",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl,gpl-3.0",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "made available under the terms of the Eclipse Public License v2.0": "epl-2.0",
    "3. This notice may not be removed; altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": "zlib",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache,apache-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "ofl-1.1",
    "no licence is spoken of, nor a mitigation of bsdx": "",
}


def test_families_of_rules(spark):
    rows = list(enumerate(FAMILIES))
    out = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert {t: out[i] for i, t in rows} == FAMILIES
    assert len({r[4] for r in licenses.rules()}) > 500


NOTICES = {
    "SPDX-License-Identifier: (MIT OR Apache-2.0 OR GPL-2.0-or-later OR BSD-3-Clause OR MPL-2.0 OR LGPL-2.1-only OR ISC OR EPL-2.0)":
        "apache-2.0,bsd-3-clause,epl-2.0,gpl-2.0,isc,lgpl-2.1,mit,mpl-2.0",
    "SPDX-License-Identifier: LicenseRef-Our-Own AND (ISC OR Zlib)\nor mit": "isc,mit,zlib",
    "SPDX-License-Identifier: ISC\nThis is one of many words, and MIT is a university": "isc",
    "or MIT and ISC": "",
    "license: mit": "mit",
    "Licensed under MIT": "mit",
    "released under the terms of the MIT/X11 License": "mit",
    "Apache 2 licensed": "apache-2.0",
    "License: GPLv3+": "gpl-3.0",
    "licensed under the terms and conditions of the BSD 2-clause": "bsd-2-clause",
    "The submit licence and a summit": "",
}


def test_notices_as_people_write_them(spark):
    long = "SPDX-License-Identifier: " + " OR ".join(["MIT", "Unheard-Of-1.0"] * 300 + ["ISC"])
    rows = [*enumerate(NOTICES), (99, long)]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert {t: out[i]["labels"] for i, t in rows[:-1]} == NOTICES
    assert out[99]["labels"] == "isc,mit" and len(out[99]["detections"]) == 301
    for d in out[99]["detections"]:  # places are those of the text's words
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(long))) + " "
        assert norm[d["start"] : d["end"]].split()[-1] == d["label"]


def test_rules_are_planned_in_seconds(spark):
    df = docs_of(spark, [(1, "x")])
    licenses.scan_licenses(df)
    began = time.perf_counter()
    licenses.scan_licenses(df)._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 15


def test_suppression_against_brute_force(spark):
    """All matches of all rules, then those without a stronger or longer interval around them."""
    rng = random.Random(2)
    stock = [*FAMILIES, "Apache License 2.0", "MIT license", "mit", "gnu", "Creative Commons Attribution 4.0", "under the", "public domain", "see the", "BSD"]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 8)))) for i in range(60)] + [(99, "mit license " * 3000)]
    plain = [r for r in licenses.rules() if not r[4].startswith("(?<=")]
    out = licenses.scan_licenses(docs_of(spark, rows), rule_list=plain).collect()
    for r in out:
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))) + " "
        found = []
        for i, (prio, label, kw, kw2, rx, _) in enumerate(plain):
            if kw in norm and kw2 in norm and any(a in norm for a in licenses.ANCHORS):
                found += [(m.start(), m.end(), prio, i, label) for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm)]
        found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
        kept, far = [], [-1] * licenses.LEVELS
        for d in found:  # sorted by start: an interval around this one has come before it
            inside = any(far[p] >= d[1] for p in range(d[2] + 1))
            far[d[2]] = max(far[d[2]], d[1])
            if not inside:
                kept.append(d)
        assert [(d["start"], d["end"], d["priority"], d["rule"], d["label"]) for d in r["detections"]] == kept


# 2. Decontamination

ITEM = "A train leaves Berlin at 8 am, and travels 90 km in 3 hours, then stops in Berlin again."


def test_reparameterised_items_are_found_and_inconsistent_ones_are_not(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM)], "item_id long, text string")
    rows = [
        (1, f"Before. {ITEM} After."),
        (2, "Well: a train leaves Rome at 12 am, and travels 1,300.5 miles in 40 hours, then stops in Rome again!"),
        (3, "A train leaves Rome at 12 am, and travels 40 km in 2 hours, then stops in Oslo again."),
        (4, "Quite another text about trains and hours that leaves nothing in Berlin."), *ODD[:4], (None, ITEM),
    ]
    out = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.find_leaks(docs_of(spark, rows), bench).collect()}
    assert out == {(1, 7): "verbatim", (2, 7): "reparameterised", (None, 7): "verbatim"}
    left = decontam.drop_leaking(docs_of(spark, rows), bench)
    assert left.count() == len(rows) - 3 and left.columns == ["doc_id", "text"]


def test_long_passages_and_items_without_literals_are_found(spark):
    words = [f"{a}{b}" for a in ("ta", "ke", "li", "mo", "su", "ra") for b in "bcdfghjklm"][:59]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "12 + 7 = 19, 19 + 8 = 27"), (3, "5 6")], "item_id long, text string")
    rows = [
        (1, "before it " + " ".join(words[7:52]) + " after it"), (2, "so 12 + 7 = 19, 19 + 8 = 27 holds"), (3, "so 12 + 7 = 19, 19 + 9 = 28 holds"),
        (4, " ".join(words[20:32])), (5, "5 6"), (6, " ".join(words[20:33])),
    ]
    out = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.find_leaks(docs_of(spark, rows), bench).collect()}
    assert out == {(1, 1): "verbatim", (2, 2): "verbatim", (5, 3): "verbatim", (6, 1): "verbatim"}


def test_units_capitals_and_short_items(spark):
    item = "A train travels 60 km in 2 hours and then rests. How far does Anna ride it in Rome?"
    bench = spark.createDataFrame([(1, item), (2, "see Rome"), (3, "???"), (4, "")], "item_id long, text string")
    rows = [
        (1, "A train travels seventy kilometres in 3 hours and then rests. How far does Bella ride it in Oslo?"), (2, item.upper()), (3, item.lower()),
        (4, "so: " + item.replace("Anna", "ANNA")), (5, "we went to\n  See -- ROME!\nand back"), (6, "we went to see Rome and back"), (7, ""), (8, None),
        (9, "x " * 40_000 + item), (10, "A TRAIN TRAVELS 60 KM IN 2 HOURS AND THEN STOPS THERE FOR NOW"),
    ]
    out = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.find_leaks(docs_of(spark, rows, bare=1, reading=2), bench).collect()}
    assert out == {(1, 1): "reparameterised", (2, 1): "verbatim", (3, 1): "verbatim", (4, 1): "verbatim", (5, 2): "verbatim", (9, 1): "verbatim"}


def template_by_hand(text, names):
    """[kind, text, opener, soft] of a text's tokens."""
    data = text.replace("\0", " ")
    number = lambda w: w[0].isascii() and w[0].isdigit() or lower(w) in decontam.NUMBER_WORDS
    out, last = [], None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", data):
        w, k = m[0], m.start() - 1
        while k >= 0 and data[k] in " \t\r\"'()[]":
            k -= 1
        opens = k < 0 or data[k] in ".!?:\n"
        after = last is not None and number(last[0]) and not number(w) and m.start() - last[1] <= 2
        unit = after and lower(w) in decontam.UNITS
        capital = re.match(r"[A-Z][a-z\x80-\U0010ffff]", w) and not number(w) and not unit
        kind = "n" if number(w) else "u" if unit else "p" if names and capital and not opens else lower(w)
        between = data[last[1] : m.start()] if last else None
        if last and (w[0].isdigit() and last[0][0].isdigit() and between in (".", ",") or kind == "p" and last[2] == "p" and between == " "):
            out[-1][1] = data[out[-1][4] : m.end()]
        else:
            out.append([kind, w, bool(capital and (opens or not names)), bool(after and not unit and not capital), m.start()])
        last = (w, m.end(), kind)
    return out


def windows_by_hand(tokens, width, literals, whole=False, names=True):
    """{position: [(readings, template, slots)]}"""
    found = defaultdict(list)
    for r in range(4) if names else (0, 2):
        for i in range(len(tokens) - width + 1):
            part = tokens[i : i + width]
            if r & 1 and not any(t[2] for t in part) or r & 2 and not any(t[3] for t in part):
                continue
            kinds = ["p" if r & 1 and t[2] else "u" if r & 2 and t[3] else t[0] for t in part]
            slot = [(("n", "p", "u").index(k) if k in ("n", "p", "u") else None) for k in kinds]
            kinds = [("<n>", "<p>", "<u>")[x] if x is not None else k for x, k in zip(slot, kinds, strict=True)]
            if sum(x is None for x in slot) >= (0 if whole and not r else min(literals, width)):
                found[i].append((r, tuple(kinds), tuple((x, t[1] if names else lower(t[1])) for x, t in zip(slot, part, strict=True) if x is not None)))
    return found


def leak_by_hand(doc, item, window=5, literals=3, share=0.8, stretch=13):
    best = None
    for names in (True, False):
        d, t = template_by_hand(doc, names), template_by_hand(item, names)
        width = min(window, len(t))
        if len(t) < literals:
            continue
        theirs, poor = windows_by_hand(t, width, literals, names=names), False
        if not theirs:
            width, poor = len(t), True
            theirs = {0: [x for x in windows_by_hand(t, width, 0, True, names)[0] if x[0] == 0]}
        ours = windows_by_hand(d, width, literals, poor, names)
        named = set() if names else {j for j in theirs if any(x[2] for x in t[j : j + width])}
        spots = defaultdict(dict)
        for i, mine in ours.items():
            for j, its in theirs.items():
                cost = lambda a, b: (bin(a).count("1") + bin(b).count("1")) * 16 + a + 4 * b
                same = [(cost(a[0], b[0]), b[2], a[2]) for a in mine for b in its if a[1] == b[1] and (not poor or a[2] == b[2])]
                if same:
                    spots[i - j][j] = min(same)[1:]
        covered, other, long = set(), False, False
        for at in spots.values():
            pairs = {p for its, mine in at.values() for p in zip(its, mine, strict=True)}
            if len({a for a, _ in pairs}) == len(pairs):
                covered |= set(at)
                other |= any(a != b for a, b in pairs)
                tokens = [any(j <= k < j + width for j in at) for k in range(len(t))]
                runs = "".join("x" if x else " " for x in tokens).split()
                long |= max(map(len, runs)) >= min(stretch, len(t))
        if covered and (len(covered) >= share * len(theirs) or long) and len(covered & named) >= share * len(named):
            row = (len(covered) / len(theirs), names, not other)
            best = row if best is None else max(best, row)
    return best and (pytest.approx(best[0]), "verbatim" if best[2] else "reparameterised")


def test_leaks_are_those_found_by_hand(spark):
    rng = random.Random(21)
    common = "the a of in with and then takes gives leaves red old train shop apples coins each every".split()
    proper, units = ["Anna", "Berlin", "New York", "Marcus", "Rome"], ["km", "hours", "kilometres", "bags", "kg"]

    def sentence(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(proper) if x < 0.12 else f"{rng.choice(['2', '60', 'seven', '1,500', '3.5'])} {rng.choice(units)}" if x < 0.3 else rng.choice(common))
        return (" ".join(out)[0].upper() + " ".join(out)[1:]).replace(" and ", ". ", 1) + rng.choice(".!?")

    items = [(i, sentence(rng.randint(3, 24))) for i in range(14)] + [(90, "12 + 7 = 19"), (91, "1 2 3"), (92, "Anna Berlin 5 km")]
    rows = []
    for _ in range(150):
        text = rng.choice(items)[1]
        for a, b in rng.sample([("Anna", "Clara"), ("60", "75"), ("2 ", "nine "), ("km", "miles"), ("bags", "boxes"), ("old", "new"), ("the ", ""), ("Rome", "Oslo"), ("1,500", "40")], rng.randint(0, 3)):
            text = text.replace(a, b, rng.choice((1, -1)))
        text = rng.choice((str, str, str, str.upper, str.lower, str.title))(text)
        rows.append((len(rows), rng.choice(("", "so ", "Well. ", sentence(4) + "\n")) + text + rng.choice(("", " " + sentence(3)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["kind"]) for r in decontam.find_leaks(docs_of(spark, rows), bench).collect()}
    want = {(d, i): found for d, text in rows for i, item in items if (found := leak_by_hand(text, item))}
    assert got == want and len({k for _, k in got.values()}) == 2


def test_leaks_against_brute_force(spark):
    sf = Path("/root/testdata/sf0.001")
    docs, bench = (spark.read.parquet(str(sf / f"{n}.parquet")) for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    words = lambda t: re.findall(r"\w+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = {r["item_id"]: grams(words(r["text"])) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        g = grams(words(r["text"]))
        want |= {(r["doc_id"], i) for i, k in items.items() if k and len(g & k) >= 0.8 * len(k)}
    assert want <= got and got


def test_leaks_are_the_same_however_windows_are_joined(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    found = lambda: sorted(map(tuple, decontam.find_leaks(read("documents"), read("benchmark")).collect()))
    want = found()
    monkeypatch.setattr(decontam, "FILTER_BITS", 15)  # as good as no filter
    assert want and found() == want


def test_names_that_open_sentences(spark):
    bench = spark.createDataFrame(
        [(1, "Natalia sold 48 clips in April."), (2, "She went home early. Anna then lost her old red kite near Paris. Anna cried all day long over it.")],
        "item_id long, text string",
    )
    rows = [
        (1, "Marcus sold 60 clips in March."), (2, "Natalia sold 48 clips in April."), (3, "Then Marcus sold 60 clips in March."), (4, "In May he sold clips."),
        (5, "She went home early. Bella then lost her old red kite near Rome. Bella cried all day long over it."),
        (6, "He went home early. Bella then lost her old red kite near Rome. Bella cried all day long over it."),
        (7, "She went home early. Bella then lost her old red kite near Rome. Clara cried all day long over it."),
    ]
    out = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.find_leaks(docs_of(spark, rows), bench).collect()}
    assert out == {(1, 1): "reparameterised", (2, 1): "verbatim", (3, 1): "reparameterised", (5, 2): "reparameterised", (6, 2): "reparameterised"}


def test_leaks_in_empty_tables_and_with_clashing_names(spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    docs = docs_of(spark, [(1, ITEM)], item=5, hash=6, th=7, pos=8, named=True, item_id=9, _id=3, m="m")
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaking(docs, bench).count() == 0
    assert decontam.drop_leaking(docs, bench.limit(0)).collect() == docs.collect()


def test_one_of_each_group_stays_whatever_else_is_there(spark):
    docs = docs_of(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (3, None)], _h=1, _id=2, _th=3, h=4, node=5, comp=6)
    kept = jaccard.keep_one(docs, jaccard.Spec(words=5, num=80, den=100))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert jaccard.keep_one(docs.limit(0), jaccard.Spec(words=5, num=80, den=100)).count() == 0


# 3. Token counts


@pytest.fixture(scope="module")
def counter():
    return tokencount.PrefixCounter(vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_every_prefix_is_exact(counter, library):
    rng = random.Random(4)
    texts = ["", "they'll we'l 'll ' x", "x<|endoftext|>y <|endo", "émoji 😀😀 123 45a  ", "   x", "a  b  \n\n c", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    texts += ["".join(rng.choice("ab c'lsrev\n\t 19é!<|") for _ in range(40)) for _ in range(60)]
    parts = ["'s", "'re", "'ll", "'", "'v", "e", " ", "  ", "\n", " Don't", "12", "<|endoftext|>", "<|endof", "!", " ?", "日本", "😀", "l"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["word " + "y" * 90 + "  \n " + " " * 70 + "<|endoftext|>", "." * 70 + "<|endoftext|>"]
    for t in texts:
        assert counter.prefixes(t).tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_counts_and_budgets(spark, library):
    rows = [*ODD, (9, "Hello there, it's 2024!\n\n  Yes <|endoftext|> no.")]
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t in rows)
    out = tokencount.count_tokens(docs_of(spark, rows, n_tokens="clash"), vocabulary(), limit=100).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in out)
    for r in out:
        t = r["text"] or ""
        n = lambda i: len(library.encode(t[:i], add_special_tokens=False).ids)  # noqa: B023, E731
        assert r["tokens_of_half"] == n(len(t) // 2) and n(r["chars_in_limit"]) <= 100
        assert all(n(i) > 100 for i in range(r["chars_in_limit"] + 1, min(len(t), r["chars_in_limit"] + 20) + 1))
    assert tokencount.count_tokens(docs_of(spark, []), vocabulary()).count() == 0
    store = tokencount.prefix_store(docs_of(spark, rows[-1:]), vocabulary())
    cut = tokencount.cut_for_budget(store, 5).first()
    assert cut["counts"][cut["n_chars"]] <= 5 and all(n > 5 for n in cut["counts"][cut["n_chars"] + 1 :])
    assert tokencount.tokens_of_prefix(store, 10**6).first()["n_tokens"] == cut["counts"][-1]


def test_prefixes_of_very_long_texts(counter, library):
    for t in (" " * 200_000, "x" * 200_000, "a\n\n b's " * 30_000):
        counts = counter.prefixes(t)
        assert len(counts) == len(t) + 1 and counts[-1] == len(library.encode(t, add_special_tokens=False).ids)


# 4. Line dedup


def brute_lines(rows, min_chars=40, min_lines=4):
    """Fingerprints, origins and extension, step by step over lists; rows in order of distinct ids."""
    lines = [[(i, x.strip(" \t\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")] if t is not None else [] for _, t in rows]
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()

    def gram(ls, j):
        for k in range(1, min_lines + 1):
            run = [x for _, x in ls[j : j + k]]
            if len(run) == k and (sum(map(len, run)) >= min_chars or k == min_lines):
                return digest(run[0]) if k == 1 else digest("".join(map(digest, run))), k
        return None, 0

    prints = defaultdict(list)
    for d, ls in enumerate(lines):
        grams = [gram(ls, j) for j in range(len(ls))]
        chosen = {min((grams[i][0], i) for i in range(j, j + k) if grams[i][1]) for j, (_, k) in enumerate(grams) if k}
        for key, j in sorted(chosen):
            prints[key].append((d, j))
    gone = [set() for _ in rows]
    for places in prints.values():
        (o, p), *later = sorted(places)
        for d, j in later:
            gone[d].add(lines[d][j][0])
            for step, most in ((-1, min_lines - 1), (1, 2 * min_lines - 1)):
                for k in range(1, most + 1):
                    x, y = j + step * k, p + step * k
                    if min(x, y) < 0 or x >= len(lines[d]) or y >= len(lines[o]) or lines[d][x][1] != lines[o][y][1] or len(lines[d][x][1]) >= min_chars:
                        break
                    gone[d].add(lines[d][x][0])
    return {rows[k][0]: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, (_, t) in enumerate(rows)}


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    stock = ["", "ok", "short line", "a line of some length, thirty ch", "x" * 45, "y" * 39, "one more line that is certainly long enough", " tail "]
    rows = [(i, "\n".join(rng.choice([*stock, f"own line number {rng.randrange(60)}"]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(98, None), (99, "")]
    out = linededup.dedup_lines(docs_of(spark, rows, _th=1, n_lines="x")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute_lines(rows)


def test_repeated_rows_are_one_place(spark):
    long = "this line is long enough to count as a run of its own"
    out = linededup.dedup_lines(docs_of(spark, [(1, long), (1, long), (2, long), (None, "other " + long)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, "other " + long), (1, long), (1, long), (2, "")]
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0
    assert linededup.dedup_lines(docs_of(spark, ODD)).count() == len(ODD)


def test_repeated_long_lines_and_runs_are_all_found(spark):
    """Without knowing the fingerprints: what the docstring guarantees."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = [word(rng.randint(5, 30)) for _ in range(12)]
    tune = [word(3) for _ in range(9)]
    rows = []
    for i in range(40):
        own = [word(rng.randint(3, 90)) for _ in range(rng.randint(1, 9))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join([*own[:at], *(passage if i % 2 else tune), *own[at:], f"{word(5)} a long line that many share, word for word, {word(2)}"[6 if i % 3 else 0 :][:51]])))
    out = {r["doc_id"]: r["text"].split("\n") for r in linededup.dedup_lines(docs_of(spark, rows)).collect()}
    for i, _ in rows:
        shared = set(passage if i % 2 else tune)
        assert (shared & set(out[i]) == set()) == (i > 1) and (i > 1 or shared <= set(out[i]))
    long = [x for ls in out.values() for x in ls if len(x) >= 40]
    assert len(long) == len(set(long)) == len({x for _, t in rows for x in t.split("\n") if len(x) >= 40})


def test_line_scan_is_thinned_and_has_no_python(spark):
    short = docs_of(spark, [(i, "\n".join(f"row {j} {i % 2}" for j in range(200))) for i in range(4)])
    n = short.select(F.explode(linededup._fingerprints(F.col("text"), 40, 4)).alias("w")).count()
    assert 4 * 50 <= n < 4 * 160
    assert "Python" not in linededup.dedup_lines(short)._jdf.queryExecution().toString()


# 5. Mixing


def test_pivot_keeps_mass():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        size, p = rng.integers(1, 500, n).astype(float), rng.random(n)
        mass, before = (size * p).sum(), p.copy()
        left = mixing.pivot(size, p, rng.random(n))
        assert (size * p).sum() == pytest.approx(mass)
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        assert ((before > 0) | (p == 0)).all()


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (5 + i % 40), f"s{i % 3}" if i % 7 else None) for i in range(3000)] + [(9000, None, "s1"), (9001, "", "void"), (None, "a b c", "s0"), (5, "w " * 10, "s2"), (5, "w " * 10, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1))
    a, b = (sorted(map(tuple, mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=str) for _ in range(2))
    assert a == b and len(a) == len(rows)
    total = defaultdict(lambda: [0, 0.0, 0, 0])
    for _, size, source_size, target, taken, source in a:
        assert taken <= 3 * size and (not size or taken % size == 0)
        t = total[source]
        t[0], t[1], t[2], t[3] = source_size, target, t[2] + taken, max(t[3], size)
    assert sum(t[1] for t in total.values()) == pytest.approx(sum(t[0] for t in total.values()))
    assert all(abs(t[2] - t[1]) <= t[3] for t in total.values())
    want = {"s0": 1, "s1": 2, "s2": 3, "void": 1, None: 2}
    free = [s for s, t in total.items() if t[0] and t[1] < 3 * t[0] - 1e-6]
    assert len({round(total[s][1] / want[s], 6) for s in free}) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def shared_by_hand(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    """Targets by resharing what stands above the cap, source by source, until nothing does."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        w = sum(weight[n] for n in free)
        over = {n for n in free if left * weight[n] / w > most * sizes[n]}
        if not over:
            return target | {n: left * weight[n] / w for n in free}
        target |= {n: most * sizes[n] for n in over}
        left -= sum(most * sizes[n] for n in over)
        free -= over
    return target


def test_mix_against_targets_by_hand(spark):
    rng = random.Random(31)
    for trial in range(3):
        sources = [f"s{k}" for k in range(rng.randint(1, 12))] + [None, "é", ""]
        rows = [(i, "w " * rng.choice((0, 1, 3, 50, 400)), rng.choices(sources, [1 / (k + 1) ** 2 for k in range(len(sources))])[0]) for i in range(600)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        sizes = defaultdict(int)
        for _, t, src in rows:
            sizes[src] += len(t.split())
        want = shared_by_hand(sizes)
        taken, biggest = defaultdict(int), defaultdict(int)
        for r in got:
            ratio = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
            assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
            assert r["copies"] in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) or r["size"] == 0
            taken[r["source"]] += r["taken"]
            biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert len(got) == len(rows) and all(abs(taken[k] - want[k]) <= biggest[k] for k in sizes)


def test_rounding_keeps_each_documents_expectation():
    """Over many seeds a document is taken as often as its fraction says, whatever its partners."""
    rng = np.random.default_rng(7)
    size, p = np.array([5.0, 1, 20, 7, 7, 3, 50]), np.array([0.2, 0.9, 0.5, 0.35, 0.65, 0.1, 0.8])
    total = np.zeros(len(p))
    for _ in range(20_000):
        q = p.copy()
        left = mixing.pivot(size, q, rng.random(len(q)))
        if left >= 0:
            q[left] = rng.random() < q[left]
        total += q
    assert np.abs(total / 20_000 - p).max() < 0.015


# 6. Quality


def area(scores, truth):
    """Share of pairs of a good and a bad row in the right order."""
    good, bad = (np.array([s for s, y in zip(scores, truth, strict=True) if y == k]) for k in (1, 0))
    return float(((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2)


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.95), ("sf0.1", 0.94)])
def test_quality_on_held_out_rows(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.93
    assert area([r["score"] for r in out], [r["quality"] for r in out]) > least
    # The score by hand: two sizes of the whole text, their difference, one curve that never falls.
    for r in sorted(out, key=lambda r: -len(r["text"] or ""))[:20]:
        data, sizes = (r["text"] or "").encode(), []
        for d in (model.good, model.bad):
            z = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(data[i : i + quality.PIECE])) for i in range(0, len(data), quality.PIECE)))
        x = (sizes[1] - sizes[0]) / max(*sizes, 1)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * x))), abs=0.01)
    assert model.curve[1] > 0


def test_quality_of_odd_rows(spark):
    rows = docs_of(spark, [(i, f"good plain words in a row {i} and more of them") for i in range(1, 40)] + [(i, "### $$$ !!!") for i in range(40, 80)])
    labels = spark.createDataFrame([*((i, int(i < 40)) for i in range(1, 80)), (None, 1), (3, None), (500, 1), (7, 1)], "doc_id long, quality int")
    model = quality.fit(rows, labels)
    out = quality.score(docs_of(spark, [*ODD, (9, "x y " * 200_000)], score="x"), model).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1
    one = quality.fit(rows, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs_of(spark, ODD), one).collect()} == {1.0}
    none = quality.fit(rows, labels.limit(0))
    assert {r["score"] for r in quality.score(docs_of(spark, ODD), none).collect()} == {0.5}
    assert quality.score(docs_of(spark, []), model).count() == 0
    assert quality.fit(docs_of(spark, []), labels).curve is None


# 7. Archive


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u1", big), (5, "u2", big), (3, None, big), (None, "u4", big), (7, "u\r\n5", "small"), (8, "u6", "small"), (9, "u7", None), (5, "u2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    warc.write_archive(pages, str(tmp_path / "a"), date="2024-05-06T07:08:09Z")
    out = warc.read_archive(spark, str(tmp_path / "a"))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "revisit", 5, 1200), (5, "response", None, 1200), (3, "revisit", 5, 1200), (None, "revisit", 5, 1200), (7, "response", None, 5),
                          (8, "response", None, 5), (9, "response", None, 0), (5, "response", None, 1200)], key=str)
    assert out.where("NOT verified").count() == 0
    assert sorted(((r["page_id"], r["url"]) for r in out.collect()), key=str) == sorted(((i, u) for i, u, _ in rows), key=str)
    payloads = {r[0]: (r[2] or "").encode() for r in rows}
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3
    for r in warc.record_bytes(out).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[n:] == b"\r\n\r\n" and len(rest) == n + 4
        assert b"\r\nWARC-Date: 2024-05-06T07:08:09Z" in head and (b"\r\nContent-Type: " in head) == (b"WARC-Type: response" in head)
        assert rest[:n] == (payloads[r["page_id"]] if b"WARC-Type: response" in head else b"")
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


# 8. Jaccard join


def brute_components(rows, spec):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        n = spec.words
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and spec.den * common >= spec.num * (len(sets[a]) + len(sets[b]) - common):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_no_shingles_of_a_long_text_merge():
    n = 3_000_000  # with 40 bits four pairs would be expected to merge
    sizes, _, values = shingles.sets_of([b" ".join(b"%d" % i for i in range(n)), b"a b"], 1)
    assert sizes.tolist() == [n, 2] and (shingles.unpack(shingles.pack(values)) == values).all()


@pytest.mark.parametrize("spec", [jaccard.Spec(3, 90, 100), jaccard.Spec()])
def test_components_against_brute_force(spark, spec):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(-1, None), (-2, ""), (-3, " \t"), (-4, "a b"), (-5, "A b"), (None, "a b"), (-6, "a"), (-7, "z z z z z z"), (None, None), (-7, "q r s t u v")]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 40, 160]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    out = jaccard.jaccard_components(docs_of(spark, rows, node=1, th="x"), spec).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute_components(rows, spec)


def test_pairs_made_do_not_grow_with_the_square_of_a_passages_texts(spark, monkeypatch):
    # Two of six passages are 70 % of every text, so no two link by them; each tenth text has a copy.
    spec, write = jaccard.Spec(), jaccard.written

    def made(n):
        rng, met = random.Random(n), []
        words = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(k)]
        passages = [words(70) for _ in range(6)]
        rows = [(i, " ".join(sum(rng.sample(passages, 2), words(60)))) for i in range(n)]
        rows += [(n + i, t.rsplit(" ", 1)[0] + " changed") for i, t in rows[::10]]

        def counted(df, name):
            out = write(df, name)
            if name == "weighed":  # the leaders of a bucket meet its members
                few = jaccard.FEW ** len(met)
                met.append(sum(r["count"] * min(r["count"], few) for r in out.groupBy("key").count().collect()))
            return out

        monkeypatch.setattr(jaccard, "written", counted)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs_of(spark, rows), spec).collect()}
        assert got == {i: i - n if i >= n else i for i, _ in rows}
        return sum(met)

    few, many = made(100), made(400)
    assert many < 6 * few


def test_a_text_gives_its_rarest_shingles_once_whoever_leads_its_buckets(spark, monkeypatch):
    # Two of six passages are 84 % of every text, so no two link by them, yet some of their shingles must be keys; each tenth text has a copy.
    spec, write, made = jaccard.Spec(), jaccard.written, {}
    rng = random.Random(5)
    words = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(k)]
    passages = [words(80) for _ in range(6)]
    n = 300
    rows = [(i, " ".join(sum(rng.sample(passages, 2), words(30)))) for i in range(n)]
    rows += [(n + i, t.rsplit(" ", 1)[0] + " changed") for i, t in rows[::10]]

    def counted(df, name):
        out = write(df, name)
        if name == "nodes":
            made["n"] = {r["node"]: r["n"] for r in out.select("node", "n").collect()}
        if name == "prefixes" and name not in made:
            made[name] = {r["node"]: r["count"] for r in out.groupBy("node").count().collect()}
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, spec).collect()}
    assert got == {i: i - n if i >= n else i for i, _ in rows}
    assert len(made["prefixes"]) > n / 2 and all(k <= made["n"][node] // 5 + 1 for node, k in made["prefixes"].items())


def test_one_of_each_group_stays(spark):
    w = " ".join(f"w{i}" for i in range(100))
    rows = [(3, w), (2, w + " more"), (2, w + " more"), (None, w), (9, "another text of some words here"), (10, None), (11, "")]
    kept = jaccard.keep_one(docs_of(spark, rows, lang="en"), jaccard.Spec())
    assert sorted((r["doc_id"] for r in kept.collect())) == [2, 9, 10, 11] and kept.columns == ["doc_id", "text", "lang"]


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["comp"] for r in graph.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 9. Nearest neighbours


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(4000, None), (4020, [0.0] * 32), (4040, [float("nan")] * 32), (4060, [1.0] * 5), (None, [1.0] * 32), (4080, [1.0] * 31 + [None])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 3000, 20)) and all(len(v) == 20 for v in by.values())
    hits, big = 0, x.astype(float)
    for q, found in by.items():
        s = big @ big[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {v for v, _ in found})
        assert all(score == pytest.approx(s[v]) for v, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(by)) >= 0.9


def brute_neighbours(ids, x, every=20, k=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.cumsum(x.astype(float) * x[i].astype(float), axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found_neighbours(spark, ids, x, **more):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    out = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **more).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_no_neighbour_is_lost_far_beyond_the_fitting_sample(spark):
    x = np.random.default_rng(6).normal(size=(12_000, 64)).astype(np.float32)
    ids = np.arange(len(x))
    assert found_neighbours(spark, ids, x, every=100, sample=300) == brute_neighbours(ids, x, every=100)


def test_double_vectors_are_scored_as_they_are(spark):
    x = np.random.default_rng(8).normal(size=(400, 8)) * (1 + 1e-9)
    x[7] *= 1e40  # beyond single precision
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q, rows in got.items():
        score = np.cumsum(x * x[q], axis=1)[:, -1]
        want = sorted((j for j in range(400) if j != q), key=lambda j: (-score[j], j))[:5]
        assert rows == [(j, score[j]) for j in want]


def test_copies_push_no_neighbour_out(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2_000, 16)).astype(np.float32)
    x[np.arange(2_000) % 3 == 1] = x[1]
    x[0], x[20], x[40] = x[1] * 0.999, -x[1], x[1]
    x[5], x[7] = x[1] * 1.5, np.where(np.arange(16) == 0, -0.0, x[1])
    ids = rng.permutation(2_000)
    assert found_neighbours(spark, ids, x) == brute_neighbours(ids, x)


def test_rows_that_repeat_an_id_are_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (600, 4)).astype(np.float32)
    x[~x.any(axis=1)] = 1
    ids = rng.integers(0, 50, 600)
    ids[:40], x[:40] = 20, x[0]  # one row, forty times
    df = spark.createDataFrame([(int(i), v.tolist(), 1, 2) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, query_id int, h int")
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x.astype(float) @ x[i].astype(float)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        want += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    assert sorted(map(tuple, ann.search(df).collect())) == sorted(want)


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [r for r in df.collect() if r[1] is not None]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == brute_neighbours(ids, x)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df).orderBy("rank").collect()] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert ann.search(df.limit(0)).count() == 0


def test_queries_in_many_turns(spark, monkeypatch):
    """However many queries go to the tasks at once, the lists are those of brute force, and no vector is exchanged."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({"block": F.lit("clash"), "h": F.lit(1)})
    monkeypatch.setattr(ann, "QUERIES", 9)
    monkeypatch.setattr(ann, "BLOCK", 64)
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = {}
    for q in range(0, 1500, 20):
        scores = np.cumsum(x.astype(float) * x[q].astype(float), axis=1)[:, -1]
        want[q] = [i for i in sorted(range(1500), key=lambda i: (-scores[i], i)) if i != q][:20]
    assert got == want


# 10. Personal data


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[ -]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", " ", ".", "é", "7", "--", "a@b@c.de.f"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_patterns_discover_identifiers(spark):
    rows = [(i, f"please mail to user{i}@mail.example.com today and more") for i in range(30)] + [(100, "please mail to AKIA99XX77YY55 today and more"), (101, "version 12345678 of it"), *ODD]
    out = {r["doc_id"]: r for r in pii.find_personal_data(docs_of(spark, rows)).collect() if r["doc_id"] and r["doc_id"] > 20}
    assert out[100]["spans"] == "id:15:29" and out[100]["n_id"] == 1 and out[101]["spans"] == ""
    assert out[25]["spans"] == "email:15:38" and out[25]["n_email"] == 1
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0


def test_accepted_identifiers_make_new_patterns_trusted(spark):
    rows = [(i, f"please mail to user{i}@mail.example.com today and more") for i in range(30)]
    rows += [(100 + i, f"please mail to KEY{i}99XX77YY55 today and more") for i in range(4)]
    rows += [(200 + i, f"vault entry KEY{i}99XX77YY55 closed") for i in range(4)] + [(300, "vault entry NEW123456789 closed")]
    # Where ordinary words stand three times as often as seeds, a pattern tells nothing.
    rows += [(400 + i, f"ticket no box{i}@mail.example.com done") for i in range(10)] + [(500 + i, f"ticket no {12345600 + i} done") for i in range(30)]
    rows += [(600 + i, "ticket no more done") for i in range(30)]
    out = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert out[300] == "id:12:24" and out[203] == "id:12:26" and out[103] == "id:15:29"
    assert {out[500 + i] for i in range(30)} == {""}


def hops(n=20):
    """Codes that no shape gives away: first beside emails, then in two more contexts, each with new ones; ordinary words and numbers."""
    code = lambda k, i: f"q{k}{'abcdefghij'[i % 10]}{i:02d}z{i * 7 % 89:02d}"
    rows = [(f"your login name is user{i}@mail.example.com as agreed", []) for i in range(n)]
    rows += [(f"your login name is {code(1, i)} as agreed", [code(1, i)]) for i in range(n)]
    rows += [(f"badge number: {code(k, i)} (valid)", [code(k, i)]) for k in (1, 2) for i in range(n)]
    rows += [(f"open the gate with pin={code(k, i)} tonight", [code(k, i)]) for k in (2, 3) for i in range(n)]
    rows += [(f"a house of {1000000 + 37 * i} bricks and a {word} by the sea in order {200000 + i}", []) for i in range(n) for word in ("door", "wall", "tree")]
    rows += [(f"the {word} is {word} and of no use", []) for word in ("badge", "gate", "login", "house", "bricks") for _ in range(n)]
    return [(k, text, secrets) for k, (text, secrets) in enumerate(rows)]


def test_discovery_goes_on_over_hops_without_shapes(spark):
    rows = hops()
    out = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs_of(spark, [(k, t) for k, t, _ in rows]), shapes=False).collect()}
    at = {k: [f"id:{t.index(s)}:{t.index(s) + len(s)}" for s in secrets] for k, t, secrets in rows}
    for first in ("q1", "q2", "q3"):  # beside seeds, one hop on, two hops on
        own = [k for k, _, s in rows if s and s[0].startswith(first)]
        assert sum(at[k][0] in out[k] for k in own) >= 0.9 * len(own)
    assert not [k for k, _, secrets in rows if not secrets and "id:" in out[k]]


def bootstrap_by_hand(edges, against, seeds, accept):
    seed = {i for _, i, s, _ in edges if s}
    score: dict[int, float] = {}
    while True:
        known, new = seed | set(score), {}
        for p in {e[0] for e in edges}:
            if p not in against:
                continue
            here = {i: n for q, i, _, n in edges if q == p}
            for i in here:
                others = [n for j, n in here.items() if j != i and j in known]
                if i not in seed and len(others) >= seeds:
                    new[i] = max(new.get(i, 0), sum(others) / (sum(others) + against[p]))
        more = {i: max(x, score.get(i, 0)) for i, x in (new | {}).items() if x >= accept} | {i: max(x, new.get(i, 0)) for i, x in score.items()}
        if len(more) == len(score):
            return more
        score = more


def test_bootstrap_scores_by_hand(spark):
    rng = random.Random(12)
    for trial in range(3):
        seed = {i for i in range(60) if rng.random() < 0.2}
        edges = sorted({(rng.randrange(25), rng.randrange(60)) for _ in range(260)})
        edges = [(p, i, i in seed, rng.randint(1, 4)) for p, i in edges]
        against = {p: rng.choice((0, 1, 6, 20, 80)) for p in range(25)}
        df = spark.createDataFrame(edges, "pattern long, instance long, seed boolean, n long")
        _, got = pii.bootstrap(df, spark.createDataFrame(list(against.items()), "pattern long, against long"), 3, 0.5)
        want = bootstrap_by_hand(edges, against, 3, 0.5)
        assert {r["instance"]: pytest.approx(r["score"]) for r in got.collect()} == want
        assert trial or want


def test_words_against_a_pattern_are_counted_over_all_texts(spark):
    rows = [(i, f"Key: A{i}B22{i}C done") for i in range(5)] + [(10 + i, f"key: word{'s' * i} of key: none") for i in range(7)] + [(20, "PIN=abc pin=x1y2z3 pin=q1q2q3 pin=w1w2w3 pin=e1e2e3")]
    docs = docs_of(spark, rows)
    seen = pii.scan(docs).select("doc_id", "th", F.explode("seen").alias("x"))
    edges = pii.edges_of(seen)
    got = {r["pattern"]: r["against"] for r in pii.ordinary(docs, edges).collect()}
    key = spark.sql("SELECT xxhash64('<key:') AS a, xxhash64('=pin=') AS b").first()
    assert got[key["a"]] == 14 and got[key["b"]] == 1


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert name == cp.STAGES[-1][0] or out.columns == list(cp.COLUMNS)
        docs = out.cache()
        assert 0 < docs.count() <= 3 * before
    assert docs.where("copy > copies OR copies > 3").count() == 0


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, th long, copy int, item string"


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_of_odd_and_no_rows(spark, number):
    import corpus_pipeline as cp

    name, stage = cp.STAGES[number]
    sf = "/root/testdata/sf0.001"
    odd = [(i, t, None, "s" if i else None, None, 1, 2, 3, "x") for i, t in ODD] + [(70, "one two three four five six", "en", "s", 27, 1, 2, 3, "y")] * 2
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = given.unionByName(spark.createDataFrame(odd, ODD_DOCS), allowMissingColumns=True)
    columns = [*cp.COLUMNS, *(["copies", "copy"] if name == "mixing" else [])]
    none = stage(spark, docs.limit(0), sf)
    assert none.columns == columns and none.count() == 0
    if name == "quality":  # learns from the labels of the given documents
        docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(odd, ODD_DOCS), allowMissingColumns=True)
    out = stage(spark, docs, sf)
    assert out.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in out.collect() if (r["doc_id"], r["text"]) in {(i, t) for i, t, *_ in odd}]
    if name in ("lines", "benchmark"):  # nothing of theirs repeats or leaks; rows that are equal stay so
        assert sorted(rows, key=str) == sorted(((i, t) for i, t, *_ in odd), key=str)
    if name == "near":  # of rows that repeat id and text one stays
        assert sorted(rows, key=str) == sorted({(i, t) for i, t, *_ in odd}, key=str)
    if name == "mixing":  # texts without words have nothing to take
        assert not {r for r in rows if not (r[1] or "").strip()}


# All


def test_empty_tables_and_names_like_ours(spark, tmp_path):
    more = dict.fromkeys(("_norm", "_base", "_found", "_t", "_id", "_th", "_h", "_y", "_n", "_sha1", "_source", "node", "seed", "nth", "p"), "their own")
    docs = docs_of(spark, [(1, "mit license\n" + "a line that is well over forty characters long\n" * 2), (2, None)], **more).withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    learn = docs_of(spark, [(i, ("good words in order " if i % 2 else "x1 x2 zz qq ") * 30 + str(i)) for i in range(10)])
    model = quality.fit(learn, labels)
    runs = {
        "licenses": lambda d: licenses.scan_licenses(d), "tokens": lambda d: tokencount.count_tokens(d, vocabulary()), "lines": lambda d: linededup.dedup_lines(d),
        "mix": lambda d: mixing.mix(d), "quality": lambda d: quality.score(d, model), "jaccard": lambda d: jaccard.jaccard_components(d, jaccard.Spec(3, 90, 100)),
        "personal": lambda d: pii.find_personal_data(d),
    }
    for name, run in runs.items():
        assert run(docs.limit(0)).count() == 0, name
        assert sorted(r["doc_id"] for r in run(docs).collect()) == [1, 2], name
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in more.items()})
    for n, some in enumerate((pages.limit(0), pages)):
        folder = f"file://{tmp_path}/archive{n}"
        warc.write_archive(some, folder)
        assert [r["page_id"] for r in warc.read_archive(spark, folder).collect()] == [1] * n
