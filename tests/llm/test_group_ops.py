"""SimHash, passages, top-k, WARC, URL filter, preference formatting, components, pipeline."""

import base64
import hashlib
import io
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import bloom, passages, preference, simhash, topk, urlfilter, warc
from textloom.llm.common import Scratch
from textloom.llm.components import components

BASE = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
NEAR = BASE.replace("w0 ", "changed ", 1)


def groups(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    random = np.random.default_rng(1)
    pairs = [tuple(map(int, random.integers(0, 300, 2))) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2001 + i) for i in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    want = groups([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


# -- SimHash

SIM = "doc_id long, text string, id long, key long, w0 string, component_id string, first string"


@pytest.fixture(scope="module")
def sim_docs(spark):
    texts = [(5, BASE), (3, BASE), (9, NEAR), (1, None), (2, ""), (4, "one two"), (8, "One TWO"), (7, "x y z"), (7, "x y z"), (None, "null id"), (None, BASE), (11, "q " * 40000)]
    texts += [(100 + i, " ".join(f"v{i * j % 61}" for j in range(30))) for i in range(40)]
    return spark.createDataFrame([(i, t, 0, 0, "a", "b", "c") for i, t in texts], SIM)


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s)) if s else 0


def test_simhash_is_brute_force(spark, sim_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in sim_docs.collect()]
    links = groups([(i, j) for i in range(len(rows)) for j in range(i, len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2])
    want = []
    for i, (d, f) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if links[j] == links[i] and rows[j][0] is not None]
        want.append((d, f"{f:016x}", min(ids, default=None)))
    got = [tuple(r) for r in simhash.simhash_classes(sim_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.simhash_classes(sim_docs.limit(0)).count() == 0


@pytest.mark.parametrize("n, words, radius", [(3000, 1, 2), (700, 1, 9), (600, 4, 38)])
def test_shard_trees_find_all_links(n, words, radius):
    random = np.random.default_rng(n)
    x = random.integers(0, 1 << 63, (n, words), dtype=np.uint64)
    for i in range(n // 2, n):  # near copies of earlier points, and of each other
        x[i] = x[int(random.integers(0, i))]
        for b in random.integers(0, 64 * words, int(random.integers(0, radius + 3))).tolist():
            x[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    root = simhash.link(x, radius)
    near = [(i, j) for i in range(n) for j in (i + np.flatnonzero(np.bitwise_count(x[i:] ^ x[i]).sum(-1) <= radius)).tolist()]
    want = groups(near)
    assert root.tolist() == [want[i] for i in range(n)]


def test_exact_keys_lose_no_pair():
    masks = simhash.exact_keys(2, 4)
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for (m,) in masks)


def test_near_copies_go(spark, sim_docs):
    near = sim_docs.where("text IS NOT NULL AND text <> ''")
    kept = simhash.deduplicate(near)
    assert kept.columns == sim_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and 5 not in ids and 9 not in ids and ids.count(None) == 2 and 7 in ids and 11 in ids and 4 in ids and 8 not in ids
    assert simhash.deduplicate(near.limit(0)).count() == 0


def pair_at(random, jaccard, n=300):
    """Two texts of n shingles each whose sets have about this similarity (the last words differ)."""
    a = [f"v{k}" for k in random.integers(0, 1 << 40, n + 4).tolist()]
    b = list(a)
    new = round(n * (1 - jaccard) / (1 + jaccard))
    b[len(b) - new :] = [f"u{k}" for k in random.integers(0, 1 << 40, new).tolist()]
    return " ".join(a), " ".join(b)


def test_near_copies_are_those_of_exact_similarity(spark):
    random = np.random.default_rng(5)
    rows = [(1000 * g + 2 * i + j, t) for g, s in enumerate((0.81, 0.78)) for i in range(150) for j, t in enumerate(pair_at(random, s))]
    same, other = (" ".join(["the same five words here"] * 200 + [f"{w}{k}" for k in range(100)]) for w in "ab")  # equal fingerprints of repeated shingles
    rows += [(5000, same), (5001, other)]
    gone = {i for i, _ in rows} - {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([i for i in gone if i < 1000]) >= 0.95 * 150
    assert not [i for i in gone if i >= 1000]


@pytest.mark.parametrize("block", [1024, 3])
def test_blocks_of_candidates_lose_no_link(spark, block):
    words = [f"k{i}" for i in range(400)]
    rows = [(n, " ".join(words[n : n + 300])) for n in range(0, 100, 10)]  # a chain: each is like the next, the ends are not alike
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert [r.doc_id for r in kept.collect()] == [0]


# -- joins that move no text without need


def moved(spark):
    """Bytes written to shuffles so far."""
    time.sleep(0.3)
    spark.range(1).collect()  # the store of figures is brought up to date with a later task
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize("remove", [simhash.deduplicate, passages.remove_passages])
def test_texts_without_copies_are_not_moved(spark, tmp_path, remove):
    random = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in random.integers(0, 1 << 62, 600).tolist()) for _ in range(300)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([*enumerate(texts), (300, texts[0]), (301, texts[7])], "doc_id long, text string").write.parquet(path)
    before, threshold = moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on larger tables
    try:
        kept = remove(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r.doc_id for r in kept) == list(range(300)) and {r.text for r in kept} == set(texts)
    assert moved(spark) - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_rows_with_a_partner_pass(spark, tmp_path, most):
    path = str(tmp_path / "keys")
    spark.range(0, 9000, 3).write.parquet(path)
    rows = spark.range(9000).select(F.lit("x").alias("block"), "id", F.lit(None).cast("long").alias("m0"))
    some, others = bloom.split(rows, F.col("id"), spark.read.parquet(path), Scratch(spark, "t"), most)
    got, rest = [r.id for r in some.collect()], [r.id for r in others.collect()]
    assert some.columns == others.columns == rows.columns
    assert sorted(got + rest) == list(range(9000)) and set(range(0, 9000, 3)) <= set(got)
    assert most == 1 or len(got) < 3100
    assert bloom.possible(rows, F.col("id"), spark.read.parquet(path).limit(0), Scratch(spark, "t"), most).count() == 0


# -- passages


def brute_passages(rows, least=passages.MIN_WORDS):
    paras = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = re.findall(rb"[^\x20\x09-\x0D]+", line.encode().lower())
            if len(w) >= least:
                paras.append((d, k, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))))
    links = groups([(i, j) for i in range(len(paras)) for j in range(i, len(paras)) if len(paras[i][2] & paras[j][2]) >= 0.8 * len(paras[i][2] | paras[j][2])])
    size = {}
    for r in links.values():
        size[r] = size.get(r, 0) + 1
    order = lambda i: (paras[i][0] is not None, paras[i][0] or 0, paras[i][1])
    out = set()
    for i in range(len(paras)):
        if size[links[i]] > 1:
            kept = min((j for j in range(len(paras)) if links[j] == links[i]), key=order)
            out.add((paras[i][0], paras[i][1], paras[kept][0], paras[kept][1], order(i) != order(kept)))
    return out


@pytest.fixture(scope="module")
def passage_docs(spark):
    line = lambda s, n: " ".join(f"p{s}_{i * 31 % 101}" for i in range(n))
    a, b = line(1, 60), line(2, 80)
    near = b.replace("p2_31 ", "other ", 1)
    rows = [(1, f"short\n{a}\nend"), (2, f"{a}\n{b}"), (3, f"x\n{near}\n{a}"), (4, None), (5, ""), (None, f"{line(3, 50)}\n{line(3, 50)}"), (6, line(4, 5000)), (7, line(4, 5000).upper()), (8, a), (9, "only\nshort\nlines"), (2, f"{a}\n{b}")]
    chain = [f"{' '.join(f'c{i}' for i in range(k, k + 60))}" for k in range(0, 30, 3)]
    rows += [(50 + n, t) for n, t in enumerate(chain)]
    return spark.createDataFrame([(d, t, 0, len(t or "") if t is not None else None, "k", "f") for d, t in rows], "doc_id long, text string, id int, n_chars long, key string, first string")


@pytest.mark.parametrize("block", [4096, 4])
def test_passages_are_brute_force(spark, passage_docs, block):
    out = passages.classes(passage_docs, block=block).collect()
    got = {(r.doc_id, r.para, r.class_doc, r.class_para, r.removed) for r in out}
    assert got == brute_passages([(r.doc_id, r.text) for r in passage_docs.collect()])
    assert passages.classes(passage_docs.limit(0)).count() == 0


def test_passages_are_removed(spark, passage_docs):
    kept = passages.remove_passages(passage_docs)
    assert kept.columns == passage_docs.columns
    by = {}
    for r in kept.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == passage_docs.where("doc_id = 1").head().text
    assert by[3][0].text == "x" and by[3][0].n_chars == 1
    assert 8 not in by and 7 not in by and by[4][0].text is None and by[5][0].text == "" and by[9][0].text == "only\nshort\nlines"
    assert "\n" not in by[None][0].text


def test_runs_of_words_go_wherever_lines_break(spark):
    own = lambda s, n: " ".join(f"o{s}_{i}" for i in range(n))
    run = [f"r{i}" for i in range(54)]
    short = [f"s{i}" for i in range(49)]
    text = " ".join(run)
    rows = [
        (1, f"{own(1, 200)} {text} {own(2, 200)}\nlast"),  # inside a longer line
        (2, f"{own(3, 15)} {' '.join(run[:11])}\n{' '.join(run[11:])} {own(4, 40)}"),  # across a line break
        (3, "first\n" + "\n".join(" ".join(run[i : i + 9]) for i in range(0, 54, 9)) + "\nlast"),  # short lines
        (4, f"{own(5, 100)} {' '.join(short)} {own(6, 100)}"), (5, f"{own(7, 100)} {' '.join(short)} {own(8, 100)}"),  # not long enough
        (None, None), (6, f"{own(9, 60)}"), (6, f"{own(9, 60)}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r.text for r in passages.remove_passages(docs).collect()}
    was = dict(rows)
    assert by == was | {2: f"{own(3, 15)} {own(4, 40)}", 3: "first\nlast"}
    found = {(r.doc_id, r.para, r.n_words, r.class_doc, r.class_para, r.removed) for r in passages.repeated_passages(docs).collect()}
    assert {(2, 0, 54, 1, 0, True), (3, 1, 54, 1, 0, True), (1, 0, 54, 1, 0, False)} == {x for x in found if x[0] != 6}  # with the run that stays


# -- top-k


def test_topk_is_brute_force(spark):
    random = np.random.default_rng(2)
    vecs = [(i, random.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(300)] + [(100, [0.25] * 8), (7, [0.1] * 8)]
    vecs += [(5000, None), (5001, [None] * 8), (5002, [float("nan")] * 8), (5003, [float("inf")] * 8), (None, [1.0] * 8), (5100, [1.0, 2.0]), (5101, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "l") for i, v in vecs], "vec_id long, embedding array<double>, label string")
    for block, leaf, qb in ((4096, 64, 16384), (90, 4, 3)):
        got = topk.topk(topk.vectors(df), F.col("vec_id") % 100 == 0, block=block, leaf=leaf, query_block=qb).collect()
        ok = [(i, [float(np.floor(1024 * c)) for c in v]) for i, v in vecs if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
        asked = {}
        for i, v in ok:
            if i % 100 == 0:
                asked[i] = min(asked.get(i, v), v)
        want = set()
        for q, x in asked.items():
            s = sorted((-int(np.dot(x, v)), i) for i, v in ok if i != q and len(v) == len(x))
            want |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s[:10])}
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.topk(topk.vectors(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_trees_prune_where_vectors_gather():
    random = np.random.default_rng(4)
    centres = random.integers(-300, 300, (30, 16))
    x = (centres[np.repeat(np.arange(30), 60)] + random.integers(-5, 6, (1800, 16))).astype(float)
    ids = random.permutation(1800)
    tree = topk.CoverTree(x, ids, leaf=16)
    q = topk.CoverTree(x[:60], ids[:60], leaf=16)
    best = topk.Best(60, 5)
    scored, pruned = topk.dual_tree(q, tree, best)
    assert scored + pruned == 60 * 1800 and scored < 60 * 1800 / 2
    assert len(tree.centre) > 30 and len(q.centre) >= 1
    s = x[:60] @ x.T
    s[np.arange(60), np.arange(60)] = -np.inf
    for i in range(60):
        assert best.id[i].tolist() == ids[np.lexsort((ids, -s[i]))[:5]].tolist()


def test_scores_beyond_floats(spark):
    df = spark.createDataFrame([(0, [2.0**19 + 1, 1.0]), (1, [2.0**19 + 3, 5.0]), (2, [2.0**19 + 3, 4.0])], "vec_id long, embedding array<double>")
    got = topk.topk(topk.vectors(df), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    a, s = 1024 * (2**19 + 1), 1024
    assert [r.score for r in got] == [a * s * (2**19 + 3) + s * s * 5, a * s * (2**19 + 3) + s * s * 4]


# -- WARC


def test_warc_round_trip(spark):
    rows = [(4, "http://a/", "same"), (2, None, "same"), (9, "http://b\r\nX: y", None), (8, "u", ""), (None, "n", "same"), (5, "u", "é" * 100000), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, None, "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = [tuple(r) for r in warc.round_trip(df, roll_bytes=200).collect()]
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = min(x[0] for x in rows if (x[2] or "") == (h or "") and x[0] is not None)
        again = p != first
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_long_header_fields_are_read(spark):
    url = "http://long/" + "x" * 100_000
    for make in (warc.member, bytes):
        data = b"".join(make(warc.record(i, url, b"page", None)) for i in range(3))
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert [(reason, fields and fields["warc-target-uri"]) for _, _, reason, fields, _ in found] == [(None, url)] * 3
    df = spark.createDataFrame([(1, url, "a"), (2, "http://short/", "b")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == [1, 2]


def records_and_gaps(data):
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert sum(n for _, n, r, *_ in found if r) + sum({o: n for o, n, r, *_ in found if not r}.values()) == len(data)
    return [warc._page(f["warc-record-id"]) for _, _, r, f, _ in found if r is None], [(o, n, r) for o, n, r, *_ in found if r]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    make = (lambda r: warc.member(r)) if zipped else (lambda r: r)
    parts = [make(warc.record(i, "http://x/", (f"page {i} WARC/1.1\r\n " * 20).encode(), None)) for i in range(6)]
    good = b"".join(parts)
    assert records_and_gaps(good) == ([0, 1, 2, 3, 4, 5], [])
    at = [sum(map(len, parts[:k])) for k in range(7)]
    hurt = bytearray(good)
    hurt[at[2] + len(parts[2]) // 2] ^= 0x55
    ids, gaps = records_and_gaps(bytes(hurt))
    assert ids == [0, 1, 3, 4, 5] and [g[:2] for g in gaps] == [(at[2], len(parts[2]))]
    ids, gaps = records_and_gaps(good[: at[4] + 40])
    assert ids == [0, 1, 2, 3] and gaps[0][0] == at[4]
    ids, gaps = records_and_gaps(parts[0] + b"\x00garbage\x1f\x8b\x08WARC/1.1\r\n" * 3 + good[at[1] :])
    assert ids == [0, 1, 2, 3, 4, 5] and len(gaps) == 1 and gaps[0][0] == at[1]
    ids, gaps = records_and_gaps(good[10:])
    assert ids == [1, 2, 3, 4, 5] and gaps[0][:2] == (0, at[1] - 10)
    ids, gaps = records_and_gaps(parts[0] + parts[1][: len(parts[1]) // 2] + good[at[2] :])
    assert ids == [0, 2, 3, 4, 5] and len(gaps) == 1
    assert records_and_gaps(b"") == ([], []) and records_and_gaps(b"nothing here")[0] == []


def test_members_of_several_records_lose_only_bad_ones():
    def records_and_gaps(data):  # a gap here has the bytes of a member that gave records as well
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        return [warc._page(f["warc-record-id"]) for _, _, r, f, _ in found if r is None], [(o, n, r) for o, n, r, *_ in found if r]

    made = [warc.record(i, "http://x/", f"page {i} ".encode() * 30, None) for i in range(5)]
    hurt = [*made[:2], made[2].replace(b"page 2", b"page X", 1), *made[3:]]
    ids, gaps = records_and_gaps(warc.member(b"".join(hurt)) + warc.member(made[0]))
    assert ids == [0, 1, 3, 4, 0] and [g[2] for g in gaps] == ["block digest"]
    whole = warc.member(b"".join(made))
    ids, gaps = records_and_gaps(whole[:-12] + warc.member(made[1]))  # the first member is cut off
    assert ids[-1] == 1 and ids[:-1] == list(range(len(ids) - 1)) and len(ids) > 3 and len(gaps) == 1
    assert warc._whole("12") == 12 and warc._whole("x") is None and warc._whole("") is None


# -- URL filter


def test_url_rules_and_list(spark):
    urls = [
        "http://a.example.net/en/x", "http://example.net/de/", "http://NET/q", "http://x.net", "https://www.example.com/de/1?x#y", "http://my.org/fr/2", "http://notnet/en", "nothing", None, "", "ftp://bad.site/p/?utm_source=f&a=1#z",
        "http://WWW.bad.site/p?a=1&ref=q", "http://bad.site/p?a=2", "http://bad.site/p", "x://y://z/w",
    ]
    pages = spark.createDataFrame([(n, u, "c", "d") for n, u in enumerate([*urls, urls[0]])], "page_id long, url string, canon string, block string")
    listed = spark.createDataFrame([("https://bad.site/p/?a=1",), ("https://bad.site/p/?a=1",), (None,), ("http://free.net/",)], "url string")
    for most in (1 << 26, 0):
        got = {r.page_id: r for r in urlfilter.judge(pages, listed, broadcast_bytes=most).collect()}
        assert len(got) == len(urls) + 1
        assert [(got[n].rule, got[n].verdict) for n in range(len(urls))] == [
            ("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
            (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"),
        ]
        assert (got[7].host, got[7].path) == ("", "") and (got[8].host, got[8].path) == ("", "") and (got[14].host, got[14].path) == ("y:", "//z/w") and got[2].host == "net"
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert not any(r.listed for r in urlfilter.judge(pages, listed.limit(0)).collect())


# -- preference formatting


def test_preference_pairs(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "B"), (1, 2, "user", "more"), (2, 0, "user", "alone"), (None, 0, "user", "x"),
        (4, 0, "system", None), (4, None, "assistant", "z"), (5, 0, "system", None), (5, None, "assistant", "z"), (0, 0, "user", "hi"), (6, 0, None, "a"), (6, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*t, "e", "f") for t in turns], "conv_id long, turn long, role string, text string, side string, first string")
    rows = preference.format_pairs(preference.neighbours(df)).collect()
    got = sorted((r.pair_id, r.part, r.turn, r.role, r.rendered[r.loss_start : r.loss_end]) for r in rows)
    last = preference.LAST
    assert got == sorted([
        (0, "prompt", 0, "user", ""), (0, "chosen", 1, "assistant", "A<|end|>"), (0, "rejected", 1, "assistant", "B<|end|>"), (0, "rejected", 2, "user", ""), (1, "chosen", 0, "user", ""),
        (2, "prompt", 0, "system", ""), (2, "prompt", last, "assistant", ""), (3, "chosen", 0, "unknown", ""), (3, "chosen", 0, "user", ""), (3, "rejected", 0, "user", ""),
    ])
    whole = {(r.pair_id, r.piece): r for r in preference.assemble(preference.format_pairs(preference.neighbours(df))).collect()}
    assert whole[0, 0].prompt == "<|user|>\nhi<|end|>\n"
    assert [whole[0, 0].rejected[s.start : s.end] for s in whole[0, 0].rejected_spans] == ["B<|end|>"]
    pairs = spark.createDataFrame([(9, 0, 1), (10, 1, 0)], "pair_id long, chosen_id long, rejected_id long")
    again = preference.format_pairs(preference.pair_up(df, pairs)).where("pair_id = 10 AND part = 'chosen'").count()
    assert again == 2
    assert preference.format_pairs(preference.neighbours(df.limit(0))).count() == 0


def test_pairs_share_their_turns(spark):
    turns = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"), (1, 0, "user", "x"), (1, 1, "assistant", "other"),
        (2, 0, "user", "no reply"), (3, 0, "assistant", "c"), (4, 0, "user", "s"), (4, 1, "assistant", "same"), (5, 0, "user", "t"), (5, 7, "assistant", "same"), (None, 0, "assistant", "n"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, piece int")
    got = {r.pair_id: r for r in preference.assemble(preference.format_pairs(preference.other_replies(df))).collect()}
    assert sorted(got) == [0, 1, 4, 5]
    assert got[0].prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n"
    assert got[0].chosen == "<|assistant|>\nb<|end|>\n" and got[0].rejected == "<|assistant|>\nother<|end|>\n"
    assert [got[0].rejected[s.start : s.end] for s in got[0].rejected_spans] == ["other<|end|>"]
    assert got[4].chosen == "" and got[4].prompt.endswith("same<|end|>\n")


def test_a_turn_of_very_many_rows(spark):
    rows = spark.range(100_000).select(F.floor(F.col("id") / 50_000).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = preference.assemble(preference.format_pairs(preference.neighbours(rows)))
    pieces = out.select("piece", "part", F.char_length("chosen").alias("n"), F.char_length("rejected").alias("m")).collect()
    assert len(pieces) > 50 and {r.piece for r in pieces} == {preference.LAST // preference.PIECE} and max(r.n + r.m for r in pieces) < 200_000


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    scratch, now = Scratch(spark, "t"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = scratch.keep(stage(spark, now, d), name)
        assert then.columns == docs.columns and then.schema == docs.schema
        assert 0 < then.count() <= now.count()
        now = then
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), d).count()
