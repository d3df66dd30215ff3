"""Every query over the small tables, against its SQL or a plain Python version."""

import re
import sys
import unicodedata
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

from textloom import queries as own  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(D)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_is_its_sql(spark, con, name):
    assert oracle.compare(own.QUERIES[name](spark, D), own.SQL[name], con) is None


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


@pytest.mark.parametrize("form", ["NFD", "NFKD"])
def test_decompositions(spark, texts, form):
    got = {r.doc_id: r.text for r in own.QUERIES[form.lower()](spark, D).collect()}
    assert got == {k: unicodedata.normalize(form, t) for k, t in texts.items()}


@pytest.mark.parametrize("name, pattern", [("grep_lookaround", r"(?<=\w{3}ing) (?!the)"), ("grep_backreference", r"(\w{3,})\1")])
def test_searches_beyond_sql(spark, texts, name, pattern):
    want = sorted((k, n + 1) for k, t in texts.items() for n, line in enumerate(t.split("\n")) if re.search(pattern, line))
    assert sorted((r.doc_id, r.line_no) for r in own.QUERIES[name](spark, D).collect()) == want


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_other_queries_are_stable(spark, name):
    a, b = (sorted(map(repr, own.QUERIES[name](spark, D).collect())) for _ in range(2))
    assert a == b and a


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source", "matches"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def slow_pieces(ranks, token):
    parts = list(token)
    while len(parts) > 1:
        rank, i = min((ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_merges_are_those_of_the_lowest_rank_first():
    import random

    from textloom.functions.tokens import Bpe

    r, pool, merges = random.Random(1), list("abc"), []
    while len(merges) < 40:
        pair = (r.choice(pool), r.choice(pool))
        if pair not in merges:
            merges.append(pair)
            pool.append("".join(pair))
    bpe = Bpe(merges)
    for _ in range(1000):
        token = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        assert bpe.pieces(token) == slow_pieces(bpe.ranks, token)


@pytest.mark.parametrize(
    "rules, text, want",
    [
        ("sch > š; ä <> ae; k } [ei] > c;", "schäke schk", "šaece šk"), ("ab > x; a > ; b } c > yy; [cd]+ > z;", "abacbcddb", "xzyyzb"),
        ("a { b > c;", "abb", "acb"), ("a > |b; b > c;", "aab", "ccc"),
    ],
)
def test_rules(rules, text, want):
    from textloom.plans.transforms import Transform

    assert Transform(rules)(text) == want
    assert Transform(rules)(text * 20_000 if rules[:2] != "a " else text) == (want * 20_000 if rules[:2] != "a " else want)


def test_rules_without_end_are_an_error():
    from textloom.plans.transforms import Transform

    with pytest.raises(ValueError):
        Transform("a > |aa;")("a" * 10)


def test_json_is_one_value(spark):
    import json

    from pyspark.sql import functions as F

    from textloom.operators import jsonops

    def good(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    texts = ["1", " null ", "[]", '{"a":[1]}', '"]"', "", " ", "1,2", "1,0", "1,0]", "1]", "[1] ]", "]", "0,0", '1,"0"', "1,null", "1,0,null", "{} {}", "nul", '{"a":1} x']
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    got = {r.t: r.ok for r in df.select("t", jsonops.is_valid(F.col("t")).alias("ok")).collect()}
    assert got == {**{t: good(t) for t in texts}, None: None}


def test_named_groups_and_running_sums(spark):
    from pyspark.sql import functions as F

    from textloom.operators.lines import running_sums
    from textloom.plans import regex

    assert regex.pcre("(?<a>x)(?<=y)") == "(?<a>x)(?<=y)"
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "n array<int>")
    assert [r.s for r in df.select(running_sums(F.col("n")).alias("s")).collect()] == [[1, 3, 6], [], None]


def test_tests_of_a_pattern_find_the_same_texts_in_linear_time(spark):
    import random
    import time

    from pyspark.sql import functions as F

    from textloom.operators import search
    from textloom.plans import regex

    r = random.Random(3)
    texts = ["".join(r.choice("ttgo  ab\n\r\u2028x.é𝒳") for _ in range(r.randint(0, 24))) for _ in range(2000)]
    plain = ["t.*?g {1,2}?o", "a.+b.*g", "[ab].*x|go", "(t.*g)o", "t+.*b", "t.*", ".*t.*g", "é.*[a-b]{2}", "ab?.*g", "t.g.*(a|b)", "(?:t.*x)|a.*b", "a.*^|t.*$", r"\..*\bx", r"[a\]-].*(?<=o)t", "𝒳.*t", "a.*(?=b).*t"]
    made = [regex.translate(p) for p in plain] + [regex.translate(p, ignore_case=True) for p in ("T.*G", "A.*B.*O")] + [regex.translate("t*[ab]?x", "glob"), regex.translate(["t.*g", "b.*x"]), regex.translate("a.*b", word=True), regex.translate("a.*b.*", line=True)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", *(F.col("t").rlike(j).alias(f"a{n}") for n, j in enumerate(made)), *(search.found_in(F.col("t"), j).alias(f"b{n}") for n, j in enumerate(made))).collect()
    for n, j in enumerate(made):
        assert [x[f"a{n}"] for x in both] == [x[f"b{n}"] for x in both], (j, regex.for_test(j))
        assert any(x[f"a{n}"] for x in both) or n == 11
    began = time.monotonic()
    long = spark.createDataFrame([("t" * 300_000 + "g",), ("th" * 150_000,)], "text string")
    assert search.grep(long, search.Pattern("t.*?g {1,2}?o")).count() + search.grep(long, search.Pattern("th*[aeiou]?ng", "glob")).count() == 0
    assert time.monotonic() - began < 20


def test_slices_of_a_batch_are_bounded_and_whole():
    import pyarrow as pa

    from textloom.functions.batches import slices

    texts = pa.array(["x" * (k % 7 * 1000) if k % 5 else None for k in range(400)] + ["y" * 100_000, "z"])
    words = pa.array([["w" * (k % 9 * 100)] * (k % 4) if k % 6 else None for k in range(400)])
    numbers = pa.array([list(range(k % 50)) for k in range(400)], pa.list_(pa.int32()))
    cost = {0: lambda v: len(v or ""), 1: lambda v: sum(map(len, v or [])), 2: lambda v: 32 * len(v or [])}
    for n, a in enumerate((texts, words, numbers)):
        for whole in (a, a.slice(7, 300), a.slice(3, 0)):
            parts = list(slices(whole, 20_000))
            assert [v for p in parts for v in p.to_pylist()] == whole.to_pylist()
            assert all(len(p) == 1 or sum(cost[n](v) for v in p.to_pylist()) <= 20_000 for p in parts)
            assert len(parts) > 3 or not len(whole)


def test_python_functions_hold_a_slice_of_a_batch(spark):
    from pyspark.sql import functions as F, types as T

    from textloom.functions.batches import SLICE_BYTES, sliced
    from textloom.operators.lines import running_sums

    rows = sliced(T.IntegerType(), lambda: lambda part: [len(part)] * len(part))
    df = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("a"), 4096).alias("t"))
    assert df.select(F.max(rows("t"))).collect()[0][0] <= SLICE_BYTES / 4096
    sums = df.select("id", running_sums(F.when(F.col("id") % 3 > 0, F.sequence(F.lit(1), (F.col("id") % 90 + 1).cast("int")))).alias("s")).collect()
    assert all((r.s and r.s[-1]) == (None if r.id % 3 == 0 else (r.id % 90 + 1) * (r.id % 90 + 2) // 2) for r in sums)


def test_errors_of_bytes(spark):
    from pyspark.sql import functions as F

    from textloom.functions import chars

    data = [b"", b"ok", b"a\xffb\xc3", b"\xe2\x82", b"\xf0\x9f\x92 \x80\x80", None, b"\xff" * 3]

    def slow(raw):
        out, at = [], 0
        while raw is not None and at < len(raw):
            try:
                raw[at:].decode()
                break
            except UnicodeDecodeError as e:
                out.append((at + e.start, e.end - e.start))
                at += e.end
        return None if raw is None else out

    df = spark.createDataFrame([(d,) for d in data], "d binary")
    got = [r.e for r in df.select(chars.utf8_errors(F.col("d")).alias("e")).collect()]
    assert [None if e is None else [tuple(x) for x in e] for e in got] == [slow(d) for d in data]


def test_compressed_texts():
    import random
    import time

    from textloom.functions import compress

    def elided(data):
        out, last, i = bytearray(), None, 0
        while i < len(data):
            b = data[i]
            n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF8 else 1
            out += data[i + (n > 1 and b == last) : i + n]
            last = last if n == 1 else None if n == 4 else b
            i += n
        return bytes(out)

    r = random.Random(5)
    texts = ["".join(r.choice("aaéèüßжд中文字😀 \n") * r.choice((1, 1, 1, 2, 5, 200)) for _ in range(r.randint(0, 40))).encode() for _ in range(1500)]
    texts += [" ".join(r.choice(("Straße", "über", "the", "thing", "中文字", "x" * 40, "écoute", "абвг")) for _ in range(r.randint(0, 60))).encode() for _ in range(500)]
    for kind, (code, back) in compress._KINDS.items():
        assert all(back(code(t)) == t for t in texts), kind
    assert all(compress.elide_prefixes(t) == elided(t) for t in texts)
    assert compress.code_runs(b"ab" + b"c" * 300 + b"\n" * 4) == b"abc\xf9\xac\x02\n\xf9\x04"
    long = ("the quick brown fox took the road; " * 19 + "é ").encode() * 6000  # 4 MB
    assert all(back(code(long)) == long for code, back in compress._KINDS.values())
    began = time.process_time()
    compress.restore_prefixes(compress.elide_prefixes(long))
    assert time.process_time() - began < 0.6
