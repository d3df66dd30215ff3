"""Language ID, decontamination, packing, licence scan: edge cases and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, langid, license_scan, packing

SCHEMA = "doc_id long, text string, lang string, n_words long, score double, lang_pred string, items string, spans int, w string"
LONG = " ".join(f"word{i % 97}" for i in range(30000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda MU", "en", 0, 0.0, "x", "y", 1, "z"),
        (2, None, None, 0, 0.0, "x", "y", 1, "z"),
        (3, "", "de", None, None, None, None, None, None),
        (None, "12 34 !!", "fr", 0, 0.0, "x", "y", 1, "z"),
        (4, LONG, "en", 0, 0.0, "x", "y", 1, "z"),
        (5, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "en", 0, 0.0, "x", "y", 1, "z"),
        (5, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "en", 0, 0.0, "x", "y", 1, "z"),
        (6, "x beta gamma delta epsilon zeta eta theta iota kappa lambda y one two", "en", 0, 0.0, "x", "y", 1, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


# -- language ID


def test_gradient_is_the_numeric_one():
    net = langid.Network(["a", "b", "c"], hidden=5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    random = np.random.default_rng(0)
    s = random.integers(97, 110, (4, langid.SEGMENT)).astype(np.int16)
    s[1, 40:] = langid.PAD
    y = np.array([0, 1, 2, 0])
    _, g = net.gradient(s, y)
    for k, at in (("u", (0, 1, 2)), ("u", (1, 3, 11)), ("v", (1, 2, 1)), ("c", (2,)), ("x", (0, int(s[0, 3]), 7)), ("x", (1, int(s[2, 9]), 1))):
        net.w[k][at] += 1e-3
        up, _ = net.gradient(s, y)
        net.w[k][at] -= 2e-3
        down, _ = net.gradient(s, y)
        net.w[k][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=2e-3, abs=1e-6)


def test_padding_changes_nothing():
    net = langid.Network(["a", "b"])
    text = "abc def"
    p = net.documents([text])[0]
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int16)[None]
    q = net.probabilities(net.states(raw))[:, 0].mean(0)
    assert p == pytest.approx(q, abs=1e-5)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 100
    assert (out.lang == out.lang_pred).mean() >= 0.95
    assert out.score.between(0, 1).all()


def test_langid_edges(spark, docs):
    net = langid.train(docs, steps=3)
    out = {(r.doc_id, r.n_words): r for r in langid.predict(docs, net).collect()}
    assert len(langid.predict(docs, net).collect()) == docs.count()
    by = {r.doc_id: (r["lang_pred_"], r["score_"]) for r in out.values()}
    assert by[2] == by[3] == by[None] == ("und", 0.0)
    assert by[4][0] in net.langs
    empty = docs.limit(0)
    assert langid.train(empty) is None
    assert langid.languages(empty).count() == 0
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- decontamination


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            m = min(window, len(v))
            for i in range(len(v) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == v[i : i + m]:
                        hit.update(range(j, j + m))
                        found.add(str(item) if item is not None else "")
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [
    (1, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "MIT license"), (2, "MIT license"), (3, None), (4, ""), (10, "one"), (None, "gamma delta"),
    (7, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (8, "not in here at all but quite long as an item"),
]


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_decontamination_is_brute_force(spark, docs, shard):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    small = docs.where("doc_id IS NULL OR doc_id <> 4").unionByName(docs.where("doc_id = 4").withColumn("text", F.substring("text", 1, 3000)))
    got = [tuple(r) for r in decontaminate.contamination(small, items, shard_bytes=shard).collect()]
    want = brute_contamination([(r.doc_id, r.text) for r in small.collect()], ITEMS)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_edges(spark, docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, None}
    whole = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert whole[4].n_words == 30000 and whole[4].n_hit == sum(1 <= i % 97 <= 12 for i in range(30000))


def test_shift_table_never_skips():
    random = np.random.default_rng(5)
    for m in (1, 2, 3, 10):
        ids = random.integers(0, 4, 3000)
        patterns = np.unique(random.integers(1, 4, (5, m)), axis=0)
        ends, which = decontaminate.WuManber(patterns).search(ids)
        got = sorted(zip(ends.tolist(), which.tolist(), strict=True))
        assert got == sorted((e, p) for p, pat in enumerate(patterns) for e in range(m - 1, len(ids)) if (ids[e - m + 1 : e + 1] == pat).all())


# -- packing


def check_packing(rows, texts, capacity=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d is None, d or 0, len(ids := [*t.encode(x or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids[:1024], "<u4").tobytes())) for d, x in texts)
    starts = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.ids_crc32 if r.length == min(1024, r.doc_tokens) else -1) for r in rows if r.start == 0)
    assert [w[:3] for w in want] == [s[:3] for s in starts]
    assert sum(r.length for r in rows) == sum(w[2] for w in want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark, docs):
    rows = packing.pack(docs).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_a_table_has_little_padding(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(d).collect()
    assert check_packing(rows, [(r.doc_id, r.text) for r in d.collect()]) <= 0.005 * sum(r.length for r in rows)


def test_encoder_is_the_tokenizer():
    import public_tokenizers as public

    e = packing.Encoder(public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"))
    for t in ("a<|endoftext|>b", "  \u3000 x\x85y \u200b \x1c z", "Íñ ½ ² ١٢ 漢字 \r\n\t a", "🤦‍♂️ don't DON'T 'll", "a" * 5000, " " * 3000 + "x", ""):
        assert e(t) == e.exact(t)


def test_fill_is_the_best_subset_sum():
    random = np.random.default_rng(3)
    for _ in range(200):
        cap = int(random.integers(5, 40))
        lengths = random.integers(1, cap, int(random.integers(1, 9))).tolist()
        counts = [0] * (cap + 1)
        for n in lengths:
            counts[n] += 1
        used = packing.fill(counts, cap)
        top = max(lengths)
        rest = sorted(lengths)
        rest.remove(top)
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums}
        assert all(counts[n] >= k for n, k in used.items()) and used[top] >= 1
        assert sum(n * k for n, k in used.items()) == top + max(s for s in sums if s <= cap - top)


# -- licences


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label, len(p.split())) for p, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    norm = "".join(f" {w} " for w in words)
    found = []
    for n, (label, prio, kw, rx) in enumerate(license_scan.RULES):
        if kw.replace(" ", "  ") in norm:
            for m in re.finditer(license_scan.spaced(rx), norm):
                s = norm[: m.start()].count(" ") // 2
                found.append((s, s + m[0].count(" ") // 2, int(prio), n, label))
    keep = []
    for d in found:
        beaten = False
        for e in found:
            inside = e[0] <= d[0] and e[1] >= d[1]
            if e is not d and inside and (e[1] - e[0] > d[1] - d[0] or e[1] - e[0] == d[1] - d[0] and (e[2], -e[3]) > (d[2], -d[3])):
                beaten = True
            if e[0] < d[1] and e[1] > d[0] and not inside and not (d[0] <= e[0] and d[1] >= e[1]) and e[2] > d[2]:
                beaten = True
        if not beaten:
            keep.append(d)
    base = sorted({x[1] for x in places})
    return (len(words), len(places), min((x[0] for x in places), default=None), max((x[0] for x in places), default=None), ",".join(base), ",".join(sorted({*base, *(d[4] for d in keep)})))


def test_licence_scan_is_brute_force(spark, docs):
    texts = [
        "under the MIT license under the mit license", "Apache License, Version 2.0; apache license version 2.1", "CC-BY-NC-SA 4.0 and cc by nc", "éunder the mit licenseé",
        "SPDX-License-Identifier: GPL-2.0-or-later GNU General Public License version 3 as published by the Free Software Foundation, either version 3",
        " ".join(["Licensed under the MIT License.", "GNU GPL v3."] * 40), "BSD 3-Clause License, MPL 2.0, see opensource.org/licenses/MIT",
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + n, t) for n, t in enumerate(texts)], "doc_id long, text string"))
    got = [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in license_scan.scan(df).collect()]
    want = [(r.doc_id, brute_scan(r.text)) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 for r in license_scan.scan(df).collect())
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert len(license_scan.RULES) >= 200


def test_common_licence_names_have_their_labels(spark):
    cc = "Creative Commons Attribution"
    want = {
        f"{cc}-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa-4.0", f"{cc} Non-Commercial Share-Alike 4.0": "cc-by-nc-sa-4.0",
        f"{cc}-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd-4.0", f"{cc}-NonCommercial-NoDerivs 4.0": "cc-by-nc-nd-4.0", f"{cc}-NonCommercial 4.0": "cc-by-nc-4.0",
        f"{cc}-ShareAlike 4.0": "cc-by-sa-4.0", f"{cc}-NoDerivatives 4.0": "cc-by-nd-4.0", f"{cc}-ShareAlike 3.0 Unported": "cc-by-sa-3.0", f"{cc} 4.0": "cc-by-4.0",
        "the OpenRAIL-M license": "openrail", "CreativeML Open RAIL-M License": "openrail", "OpenRAIL license": "openrail", "Tcl/Tk license": "tcl",
        "No part of this publication may be reproduced": "proprietary",
        "Linking this library statically or dynamically with other modules is making a combined work based on this library": "gpl-classpath",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.labels for r in license_scan.scan(df).orderBy("doc_id").collect()] == list(want.values())


def test_licence_scan_is_native(spark, docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
