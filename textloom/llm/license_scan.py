"""Licence scan: ordered signature rules over words. DataFrame functions only.

A text is cut into words (A-Z lowered; runs of digits, a-z and non-ASCII). *Base* phrases are counted at every place.
The *rules* (``license_rules``) are regexes on the words, each tried only on texts that hold its keyword; a text
without any keyword costs one pass. Overlapping detections are resolved: a detection inside a longer one is
suppressed, of two in the same place the one of higher priority (then of the earlier rule) stays, and of two that
overlap in part the one of lower priority goes. Labels of what stays and the base labels are returned.

Words stand with a space on either side of each, so neighbouring matches share no space and a regex matches whole
words only.

Scale: a projection of one pass; no row moves, and the rules are constants of the plan. Detections are resolved within
clusters of overlapping ones, so a long text full of licence lines does not cost the square of their number.

Cases: a null text is empty: no words, no labels, score 0. Repeated rows are judged one by one. Other columns are not
read. Very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.license_rules import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: What a detection of each priority is worth as evidence.
WEIGHTS = {1: 0.5, 2: 0.8, 3: 0.9, 4: 0.99}
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(phrase: str) -> str:
    """A phrase or regex of words in the form in which words stand."""
    return " " + phrase.replace(" ", "  ") + " "


def words_column(text: Column) -> Column:
    """`` w0  w1 ... wn ``: every word with a space on either side; empty without words."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), _BREAK, " "))
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(flat, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _text(s: str) -> str:
    """A string literal for Spark and DuckDB; neither rules nor labels hold a quote or a backslash."""
    if "'" in s or "\\" in s:
        raise ValueError(s)
    return f"'{s}'"


def _words(part) -> Column:
    return ((F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(words: Column, rule) -> Column:
    """Detections of one rule: starts and ends in words, with the rule's own fields."""
    found, parts = F.regexp_extract_all(words, rule["re"], F.lit(0)), F.split(words, rule["re"], -1)
    pieces = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(_words(p).alias("gap"), _words(m).alias("n")))
    empty = F.expr("CAST(array() AS array<struct<s: bigint, e: bigint, prio: int, ord: int, label: string>>)")

    def add(acc, x):
        s = acc["at"] + x["gap"]
        one = F.struct(s.alias("s"), (s + x["n"]).alias("e"), rule["prio"].alias("prio"), rule["ord"].alias("ord"), rule["label"].alias("label"))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["made"], F.array(one)).alias("made"))

    return F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("made")), add, lambda acc: acc["made"])


def _beaten(d, e) -> Column:
    """Whether detection e suppresses d."""
    inside = (e["s"] <= d["s"]) & (e["e"] >= d["e"])
    longer = (e["e"] - e["s"]) > (d["e"] - d["s"])
    first = (e["prio"] > d["prio"]) | (e["prio"] == d["prio"]) & (e["ord"] < d["ord"])
    overlap = (e["s"] < d["e"]) & (e["e"] > d["s"]) & ~inside & ~((d["s"] <= e["s"]) & (d["e"] >= e["e"]))
    return inside & (longer | (e["e"] - e["s"] == d["e"] - d["s"]) & first) | overlap & (e["prio"] > d["prio"])


def _standing(found: Column) -> Column:
    """The detections that no other suppresses."""
    one = "struct<s: bigint, e: bigint, prio: int, ord: int, label: string>"
    zero = F.expr(f"named_struct('done', CAST(array() AS array<array<{one}>>), 'cur', CAST(array() AS array<{one}>), 'end', -1L)")

    def add(acc, d):
        joins = d["s"] < acc["end"]
        return F.struct(
            F.when(joins | (F.size(acc["cur"]) == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(joins, F.concat(acc["cur"], F.array(d))).otherwise(F.array(d)).alias("cur"),
            F.when(joins, F.greatest(acc["end"], d["e"])).otherwise(d["e"]).alias("end"),
        )

    clusters = F.aggregate(F.array_sort(found), zero, add, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    return F.flatten(F.transform(clusters, lambda c: F.filter(c, lambda d: ~F.exists(c, lambda e: _beaten(d, e)))))


def scan(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of ``docs`` (doc_id, text)."""
    # one SQL text: thousands of literals one by one take the driver seconds
    rule_array = F.expr("array(" + ", ".join(
        f"named_struct('re', {_text(spaced(r))}, 'kw', {_text(k.replace(' ', '  '))}, 'label', {_text(label)}, 'prio', {int(p)}, 'ord', {n})"
        for n, (label, p, k, r) in enumerate(rules)
    ) + ")")
    keywords = sorted({k.replace(" ", "  ") for _, _, k, _ in rules})
    # keywords that hold another keyword need no test of their own in the gate
    gate = F.lit(False)
    for k in keywords:
        if not any(o != k and o in k for o in keywords):
            gate = gate | F.contains(F.col("w"), F.lit(k))
    rows = docs.select("doc_id", words_column(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "w", (F.char_length("w") - F.char_length(F.replace("w", F.lit(" "), F.lit("")))).alias("spaces"), gate.alias("gate"))
    rows = rows.withColumn("n_words", (F.col("spaces") / 2).cast("long"))
    count, first, last, names = F.lit(0).cast("long"), [], [], []
    for phrase, label in base:
        p = F.lit(spaced(phrase))
        n = ((F.char_length("w") - F.char_length(F.replace("w", p, F.lit("")))) / len(spaced(phrase))).cast("long")
        there = F.contains(F.col("w"), p)
        count = count + F.when(there, n).otherwise(0)
        first.append(F.when(there, _words(F.substring_index("w", spaced(phrase), 1))))
        last.append(F.when(there, F.col("n_words") - len(phrase.split()) - _words(F.substring_index("w", spaced(phrase), -1))))
        names.append(F.when(there, F.lit(label)))
    rows = rows.select(
        "doc_id", "n_words", "w", "gate", count.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("base"),
    )
    w = F.col("w")
    found = F.flatten(F.transform(F.filter(rule_array, lambda r: F.contains(w, r["kw"])), lambda r: _places(w, r)))
    none = F.expr("CAST(array() AS array<struct<s: bigint, e: bigint, prio: int, ord: int, label: string>>)")
    rows = rows.withColumn("detections", F.when(F.col("gate"), _standing(found)).otherwise(none))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    prios = F.transform("detections", lambda d: d["prio"])
    weight = F.greatest(F.lit(0.0), *(F.when(F.array_contains(prios, p), v) for p, v in WEIGHTS.items()), F.when(F.col("n_base") > 0, 1.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), weight.alias("score"), "detections",
    )


def sql() -> str:
    """The same scan for DuckDB, with detections as rows."""
    rules = ",\n".join(f"({n}, {_text(label)}, {p}, {_text(k.replace(' ', '  '))}, {_text(spaced(r))})" for n, (label, p, k, r) in enumerate(RULES))
    base = ", ".join(f"({_text(spaced(p))}, {_text(label)}, {len(p.split())})" for p, label in BASE)
    weights = " ".join(f"WHEN {p} THEN {v}" for p, v in WEIGHTS.items())
    words = "CAST((length({0}) - length(replace({0}, ' ', ''))) // 2 AS BIGINT)".format
    return rf"""
WITH rule(ord, label, prio, kw, re) AS (VALUES {rules}),
     base(phrase, label, n) AS (VALUES {base}),
     f AS (SELECT row_number() OVER () AS rn, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS t FROM documents),
     d AS (SELECT rn, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || replace(t, ' ', '  ') || ' ' END AS w FROM f),
     b1 AS (SELECT rn, label, n, string_split(w, phrase) AS parts FROM d, base WHERE contains(w, phrase)),
     b2 AS (SELECT rn, label, n, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM b1),
     b3 AS (SELECT rn, label, (i - 1) * n + CAST(list_sum(list_transform(parts[1:i], lambda p: {words('p')})) AS BIGINT) AS s FROM b2),
     b AS (SELECT rn, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b3 GROUP BY rn),
     h1 AS (SELECT rn, ord, label, prio, regexp_extract_all(w, re) AS ms, string_split_regex(w, re) AS parts FROM d JOIN rule ON contains(w, kw)),
     h2 AS (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM h1),
     h3 AS (SELECT rn, ord, label, prio, CAST(list_sum(list_transform(parts[1:i], lambda p: {words('p')})) AS BIGINT) +
            CAST(coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: {words('p')})), 0) AS BIGINT) AS s, {words('ms[i]')} AS n FROM h2),
     h AS (SELECT rn, ord, label, prio, s, s + n AS e FROM h3),
     k AS (SELECT * FROM h AS x WHERE NOT EXISTS (SELECT 1 FROM h AS y WHERE y.rn = x.rn AND (
           (y.s <= x.s AND y.e >= x.e AND (y.e - y.s > x.e - x.s OR (y.e - y.s = x.e - x.s AND (y.prio > x.prio OR (y.prio = x.prio AND y.ord < x.ord)))))
           OR (y.s < x.e AND y.e > x.s AND NOT (y.s <= x.s AND y.e >= x.e) AND NOT (x.s <= y.s AND x.e >= y.e) AND y.prio > x.prio)))),
     a AS (SELECT rn, label FROM k UNION SELECT rn, label FROM b3),
     l AS (SELECT rn, string_agg(label, ',' ORDER BY label) AS labels FROM a GROUP BY rn),
     v AS (SELECT rn, max(CASE prio {weights} END) AS score FROM k GROUP BY rn)
SELECT doc_id, {words('w')} AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (rn) LEFT JOIN l USING (rn) LEFT JOIN v USING (rn)
"""
