"""The queries over the supplied tables and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import chars, compress, normalize, tokens
from textloom.operators import approx, audio, counts, csvops, jsonops, lines, positional as P, search, xmlops
from textloom.operators.search import Pattern
from textloom.plans import charset, program, transforms
from textloom.sources import files
from textloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", *more, "text")


def _lines_sql(select: str, more: str = "") -> str:
    return f"""
WITH a AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents),
     b AS (SELECT doc_id, source, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM a),
     l AS (SELECT doc_id, source, i AS line_no, p[i] AS line FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM b)){more}
{select}"""


# -- search


@query(_lines_sql("SELECT source, count(*) AS matches FROM l WHERE regexp_matches(line, '(?:tion|ment)[a-z]* [a-z]{2,4} ') GROUP BY source"))
def grep_by_source(spark, d):
    rows = search.grep(docs(spark, d, "source"), Pattern("(tion|ment)[a-z]* [a-z]{2,4} "))
    return rows.groupBy("source").agg(F.count("*").alias("matches"))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'th[a-z]+ing')"))
def grep_lines(spark, d):
    return search.grep(docs(spark, d), Pattern("th[a-z]+ing"))


@query(_lines_sql("SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(line, 'the')) AS BIGINT) AS matches FROM l GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM b WHERE len(p) = 0"))
def grep_count(spark, d):
    return search.count(docs(spark, d), Pattern("the"))


@query(_lines_sql("SELECT DISTINCT doc_id FROM l WHERE regexp_matches(line, '[0-9]{3}')"))
def grep_files_with_match(spark, d):
    return search.files(docs(spark, d), Pattern("[0-9]{3}"))


@query(_lines_sql("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE regexp_matches(line, '[0-9]{3}'))"))
def grep_files_without_match(spark, d):
    return search.files(docs(spark, d), Pattern("[0-9]{3}"), matching=False)


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE NOT regexp_matches(line, '[aeiou][^ ]*[.]$')"))
def grep_invert(spark, d):
    return search.grep(docs(spark, d), Pattern("[aeiou][^ ]*[.]$", invert=True))


@query(_lines_sql("SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM l WHERE contains(line, 'an')) WHERE r <= 2"))
def grep_max_count(spark, d):
    return search.grep(docs(spark, d), Pattern("an", "fixed"), max_count=2)


@query(_lines_sql("SELECT doc_id, line_no, line, h AS is_match FROM (SELECT *, max(h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM (SELECT *, regexp_matches(line, '[0-9]{2}') AS h FROM l)) WHERE n"))
def grep_context(spark, d):
    return search.context(docs(spark, d), Pattern("[0-9]{2}"), before=1, after=2)


@query(_lines_sql("SELECT doc_id, line_no, doc_id || ':' || line_no || ':' || line AS report FROM l WHERE regexp_matches(line, '^In ')"))
def grep_line_numbers(spark, d):
    return search.report(search.grep(docs(spark, d), Pattern("^In ")), "doc_id").select("doc_id", "line_no", "report")


@query(_lines_sql("SELECT doc_id, line_no, pattern_id FROM l, (VALUES (1, 'tion'), (2, '^[A-Z][a-z] '), (3, '[0-9]'), (4, 'ß|ü|ö')) AS t(pattern_id, re) WHERE regexp_matches(line, re)"))
def grep_multi_pattern(spark, d):
    pats = spark.createDataFrame([(1, "tion"), (2, "^[A-Z][a-z] "), (3, "[0-9]"), (4, "ß|ü|ö")], "pattern_id int, pattern string")
    return search.which_patterns(docs(spark, d), pats)


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(?:qu)|(?:[0-9]+ )')"))
def grep_any_of(spark, d):
    return search.grep(docs(spark, d), Pattern(("qu", "[0-9]+ ")))


@query(_lines_sql("SELECT doc_id, line_no, regexp_replace(line, '([a-z]+)tion', '<\\1>$', 'g') AS line FROM l WHERE regexp_matches(line, '([a-z]+)tion')"))
def grep_replace(spark, d):
    return search.replace(docs(spark, d), Pattern("([a-z]+)tion"), r"<${1}>\$")


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(?i)éa|ö[a-z]h')"))
def grep_ignore_case(spark, d):
    return search.grep(docs(spark, d), Pattern("ÉA|Ö[A-Z]H", ignore_case=True))


@query(_lines_sql(r"SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(?:^|[^\pL\pM\p{Nd}\p{Pc}])(?:the|les|und)(?:[^\pL\pM\p{Nd}\p{Pc}]|$)')"))
def grep_word(spark, d):
    return search.grep(docs(spark, d), Pattern("the|les|und", word=True))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_full_match(line, '[A-Z][a-z ]*[.]')"))
def grep_whole_line(spark, d):
    return search.grep(docs(spark, d), Pattern("[A-Z][a-z ]*[.]", line=True))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE contains(line, '. A') OR contains(line, 'x')"))
def grep_fixed(spark, d):
    return search.grep(docs(spark, d), Pattern(". A\nx", "fixed"))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(ab|cd)+e?f{2,}|x[+]')"))
def grep_ere(spark, d):
    return search.grep(docs(spark, d), Pattern("(ab|cd)+e?f{2,}|x[+]", "ere"))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(?:er){2}[+]?')"))
def grep_bre(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\(er\)\{2\}[+]*", "bre"))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'th.*[aeiou].ng')"))
def grep_glob(spark, d):
    return search.grep(docs(spark, d), Pattern("th*[aeiou]?ng", "glob"))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'A[ACDEFGHIKLMNPQRSTVWY]{1,2}[ST][ACDEFGHIKLMNQRSTVWY]')"))
def grep_prosite(spark, d):
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    found = search.grep(docs(spark, d).withColumn("text", upper), Pattern("A-x(1,2)-[ST]-{P}", "prosite")).select("doc_id", "line_no")
    return lines.keep_lines(lines.lines(docs(spark, d)), found)


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(?:abc|acb|bac|bca|cab|cba)')"))
def grep_permutation(spark, d):
    return search.grep(docs(spark, d), Pattern("[|abc|]"))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '[b-df-hj-np-tv-z]{5}')"))
def grep_class_difference(spark, d):
    return search.grep(docs(spark, d), Pattern("[a-z--[aeiou]]{5}"))


@query(_lines_sql(r"SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '\p{Lu}\p{Ll}+[^\pL\pM\p{Nd}\p{Pc}]+\p{Nd}')"))
def grep_property(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\p{Lu}\p{gc=Ll}+\W+\d"))


@query()
def grep_lookaround(spark, d):
    return search.grep(docs(spark, d), Pattern(r"(?<=\w{3}ing) (?!the)"))


@query()
def grep_backreference(spark, d):
    return search.grep(docs(spark, d), Pattern(r"(\w{3,})\1"))


@query(_lines_sql("SELECT doc_id, line_no, regexp_replace(line, '([0-9]+)', chr(27) || '[01;31m\\1' || chr(27) || '[m', 'g') AS line FROM l WHERE regexp_matches(line, '[0-9]')"))
def grep_colors(spark, d):
    return search.colorize(docs(spark, d), Pattern("[0-9]+"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS matches FROM documents")
def grep_count_positions(spark, d):
    return search.count_starts(docs(spark, d), Pattern("e"))


@query()
def grep_count_all(spark, d):
    return search.count_all(docs(spark, d), "e[a-z]*")


@query("WITH a AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS m, string_split_regex(text, '[A-Z][a-z]+') AS p FROM documents), b AS (SELECT doc_id, m, p, unnest(generate_series(1, len(m))) AS i FROM a), c AS (SELECT doc_id, m, i, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM b) SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(s + length(m[i]) AS INTEGER) AS span_end FROM c")
def grep_spans(spark, d):
    return docs(spark, d).select("doc_id", F.explode(search.match_spans("text", Pattern("[A-Z][a-z]+"))).alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(_lines_sql("SELECT doc_id, line_no, i - 1 AS match_no, m[i] AS match FROM (SELECT doc_id, line_no, m, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[0-9]+') AS m FROM l))"))
def grep_only_matching(spark, d):
    return search.only_matching(docs(spark, d), Pattern("[0-9]+"))


@query("SELECT doc_id FROM documents WHERE NOT contains(text, chr(0))")
def grep_not_binary(spark, d):
    return search.not_binary(docs(spark, d)).select("doc_id")


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'é[a-z]')"))
def grep_bytes(spark, d):
    rows = lines.lines(docs(spark, d))
    return rows.where(search.byte_text(F.col("line")).rlike(r"\x{C3}\x{A9}[a-z]"))


# -- lines


@query(_lines_sql("SELECT doc_id, line_no, line FROM l"))
def lines_unix(spark, d):
    return lines.lines(docs(spark, d))


@query("WITH a AS (SELECT conv_id, turn, string_split_regex(text, '\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]') AS p FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM a) SELECT conv_id, turn, i AS line_no, p[i] AS line FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM b)")
def lines_unicode(spark, d):
    return lines.lines(table(spark, d, "conversations", "conv_id", "turn", "text"), mode="unicode")


@query("SELECT doc_id, 1 AS line_no, text AS line FROM documents WHERE text <> ''")
def lines_null(spark, d):
    return lines.lines(docs(spark, d), mode="null").withColumn("line_no", F.col("line_no").cast("int"))


@query(_lines_sql("SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS line_end FROM l"))
def line_spans(spark, d):
    return lines.spans_of(docs(spark, d))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM l WHERE length(line) > 200)"))
def filter_line_spans(spark, d):
    rows = lines.lines(docs(spark, d))
    return lines.keep_lines(rows, rows.where(F.char_length("line") > 200))


@query(_lines_sql("SELECT doc_id, coalesce(string_agg(line || chr(10), '' ORDER BY line_no) FILTER (WHERE contains(line, 'the')), '') AS text FROM l GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM b WHERE len(p) = 0"))
def match_filter(spark, d):
    return lines.matched_text(docs(spark, d), lambda x: F.contains(x, F.lit("the")))


# -- counts


@query(r"SELECT doc_id, CAST(strlen(text) - strlen(replace(text, chr(10), '')) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS BIGINT) AS words, length(text) AS chars, strlen(text) AS bytes FROM documents")
def wc(spark, d):
    return counts.wc(docs(spark, d))


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)")
def wc_totals(spark, d):
    c = counts.wc(docs(spark, d, "source")).groupBy("source").agg(F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"))
    return counts.with_total(c, "source")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[aeiouéèêäöü]')) AS BIGINT) AS n FROM documents")
def ucount_class(spark, d):
    return docs(spark, d).select("doc_id", counts.count_set(F.col("text"), "[aeiouéèêäöü]").alias("n"))


@query(r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '\p{Lu}'))) AS BIGINT) AS upper, CAST(sum(len(regexp_extract_all(text, '\p{Nd}'))) AS BIGINT) AS digit, CAST(sum(len(regexp_extract_all(text, '\p{P}'))) AS BIGINT) AS punct FROM documents GROUP BY lang")
def ustats(spark, d):
    return counts.property_table(docs(spark, d, "lang"), {"upper": r"\p{Lu}", "digit": r"\d", "punct": r"\p{P}"}, "lang")


@query(r"SELECT word, count(*) AS n, strlen(word) AS length FROM (SELECT unnest(regexp_extract_all(text, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 2")
def word_dictionary(spark, d):
    return counts.word_table(docs(spark, d))


@query("SELECT doc_id, CAST(len(list_filter(generate_series(1, strlen(text)), lambda i: b[i] = CASE WHEN i > 2 THEN b[i - 2] ELSE '00' END)) AS BIGINT) AS n FROM (SELECT doc_id, text, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)")
def match_prior(spark, d):
    hexed = docs(spark, d).select("doc_id", F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".."), F.lit(0)).alias("b"))
    pairs = F.zip_with(F.concat(F.array(F.lit("00"), F.lit("00")), "b"), "b", lambda x, y: x.eqNullSafe(y) & y.isNotNull())
    return hexed.select("doc_id", F.size(F.filter(pairs, lambda x: x)).cast("long").alias("n"))


# -- characters


@query("SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') AS text FROM documents")
def ufilter_class(spark, d):
    return docs(spark, d).withColumn("text", chars.keep(F.col("text"), "[a-zA-Z0-9 ]"))


@query("SELECT item_id, string_agg(hex(encode(l)), chr(10) ORDER BY i) AS hexed FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM benchmark) GROUP BY item_id")
def hexlines(spark, d):
    return table(spark, d, "benchmark").select("item_id", chars.hex_lines(F.col("text")).alias("hexed"))


@query("SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents")
def base64_encode(spark, d):
    return docs(spark, d).select("doc_id", chars.base64(F.col("text")).alias("b64"))


@query("SELECT doc_id, translate(text, 'abcdeé', '12333' || '3') AS text FROM documents")
def xch_translate(spark, d):
    return docs(spark, d).withColumn("text", chars.translate(F.col("text"), "abcdeé", "123"))


# full upper-casing turns ß into SS, which DuckDB's upper does not
@query("SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS upper_text, lower(text) AS lower_text FROM documents")
def xch_property(spark, d):
    return docs(spark, d).select("doc_id", chars.map_property(F.col("text"), "uc").alias("upper_text"), chars.map_property(F.col("text"), "lc").alias("lower_text"))


@query("SELECT item_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS cps FROM benchmark")
def utf8_decode(spark, d):
    return table(spark, d, "benchmark").select("item_id", chars.codepoints(F.col("text")).alias("cps"))


@query("SELECT item_id, text FROM benchmark")
def utf8_round_trip(spark, d):
    return table(spark, d, "benchmark").select("item_id", chars.from_codepoints(chars.codepoints(F.col("text"))).alias("text"))


@query("SELECT item_id, string_agg('U+' || lpad(printf('%X', unicode(c)), 4, '0'), '' ORDER BY i) AS escaped FROM (SELECT item_id, unnest(string_split(text, '')) AS c, unnest(generate_series(1, length(text))) AS i FROM benchmark) GROUP BY item_id")
def hex_unicode(spark, d):
    return table(spark, d, "benchmark").select("item_id", chars.escape(F.col("text"), "unicode").alias("escaped"))


@query("SELECT item_id, text FROM benchmark")
def hex_any(spark, d):
    return table(spark, d, "benchmark").select("item_id", chars.unescape(chars.escape(F.col("text"), "java")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc(spark, d):
    return docs(spark, d).withColumn("text", normalize.normalize(normalize.normalize(F.col("text"), "NFD"), "NFC"))


@query()
def nfd(spark, d):
    return docs(spark, d).withColumn("text", normalize.normalize(F.col("text"), "NFD"))


@query()
def nfkd(spark, d):
    return docs(spark, d).withColumn("text", normalize.normalize(F.col("text"), "NFKD"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(spark, d):
    return docs(spark, d).withColumn("text", normalize.strip_accents(F.col("text")))


@query("SELECT doc_id, -1 AS first_error, text FROM documents")
def utf8_check(spark, d):
    return docs(spark, d).select("doc_id", chars.first_utf8_error(F.col("text")).alias("first_error"), chars.repair(F.encode("text", "UTF-8")).alias("text"))


@query("SELECT item_id, text FROM benchmark")
def utf16_round_trip(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.decode(chars.to_utf16(F.col("text"), "LE"), "UTF-16LE").alias("text"))


@query("SELECT item_id, encode(text) AS utf8 FROM benchmark")
def gb18030_round_trip(spark, d):
    return table(spark, d, "benchmark").select("item_id", chars.gb18030_to_utf8(chars.transcode(F.col("text"), "utf-8", "gb18030")).alias("utf8"))


# -- positions


def _pos(spark, d, eof: bool = False):
    p = P.positions(table(spark, d, "benchmark", "item_id", "text"), eof=eof)
    vowel, a, space = (F.coalesce(F.col("ch").isin(*x), F.lit(False)) for x in ("aeiou", "a", " \n"))
    return p.withColumns({"v": vowel, "a": a, "sp": space})


_POS = """WITH t AS (SELECT item_id, text, unnest(generate_series(1, length(text))) AS i FROM benchmark),
     p AS (SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, substr(text, i, 1) AS ch, unicode(substr(text, i, 1)) AS cp, substr(text, i, 1) IN ('a', 'e', 'i', 'o', 'u') AS v,
           substr(text, i, 1) = 'a' AS a, substr(text, i, 1) IN (' ', chr(10)) AS sp FROM t)
"""


@query(_POS + "SELECT x.item_id, x.pos, coalesce(y.v, false) AS m FROM p x LEFT JOIN p y ON x.item_id = y.item_id AND y.pos = x.pos - 3")
def advance(spark, d):
    return _pos(spark, d).select("item_id", "pos", P.advance("v", 3).alias("m"))


@query(_POS + "SELECT x.item_id, x.pos, coalesce(y.v, false) AS m FROM p x LEFT JOIN p y ON x.item_id = y.item_id AND y.pos = x.pos + 2")
def lookahead(spark, d):
    return _pos(spark, d).select("item_id", "pos", P.lookahead("v", 2).alias("m"))


@query(_POS + ", k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM p WHERE v) SELECT p.item_id, p.pos, coalesce(y.a, false) AS m FROM p LEFT JOIN k x ON x.item_id = p.item_id AND x.pos = p.pos LEFT JOIN k y ON y.item_id = x.item_id AND y.n = x.n - 1")
def indexed_advance(spark, d):
    return P.indexed_advance(_pos(spark, d), "a", "v", "m").select("item_id", "pos", "m")


@query(_POS + ", k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM p WHERE v) SELECT p.item_id, p.pos, coalesce(y.a, false) AS m FROM p LEFT JOIN k x ON x.item_id = p.item_id AND x.pos = p.pos LEFT JOIN k y ON y.item_id = x.item_id AND y.n = x.n + 1")
def indexed_shift_back(spark, d):
    return P.indexed_shift_back(_pos(spark, d), "a", "v", "m").select("item_id", "pos", "m")


_NEXT = """, n AS (SELECT *, min(CASE WHEN NOT v THEN pos END) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop,
           min(CASE WHEN sp THEN pos END) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS space FROM p)"""


@query(_POS + _NEXT + " SELECT item_id, pos, EXISTS (SELECT 1 FROM n y WHERE y.item_id = p.item_id AND y.a AND y.stop = p.pos) AS m FROM p")
def scan_thru(spark, d):
    return P.scan_thru(_pos(spark, d), "a", "v", "m").select("item_id", "pos", "m")


@query(_POS + _NEXT + " SELECT item_id, pos, EXISTS (SELECT 1 FROM n y WHERE y.item_id = p.item_id AND y.a AND y.space = p.pos) AS m FROM p")
def scan_to(spark, d):
    return P.scan_to(_pos(spark, d), "a", "sp", "m").select("item_id", "pos", "m")


@query(_POS + _NEXT + " SELECT item_id, pos, EXISTS (SELECT 1 FROM n y WHERE y.item_id = p.item_id AND y.a AND p.pos BETWEEN y.pos AND coalesce(y.stop, 1000000000)) AS m FROM p")
def match_star(spark, d):
    return P.match_star(_pos(spark, d), "a", "v", "m").select("item_id", "pos", "m")


@query(_POS + _NEXT + " SELECT item_id, pos, EXISTS (SELECT 1 FROM n y JOIN p z ON z.item_id = y.item_id AND z.pos = y.pos - 1 WHERE y.item_id = p.item_id AND z.a AND y.stop = p.pos) AS m FROM p")
def advance_then_scan_thru(spark, d):
    return P.advance_then_scan_thru(_pos(spark, d), "a", "v", "m").select("item_id", "pos", "m")


@query(_POS + _NEXT + " SELECT item_id, pos, EXISTS (SELECT 1 FROM n y JOIN p z ON z.item_id = y.item_id AND z.pos = y.pos - 1 WHERE y.item_id = p.item_id AND z.a AND y.space = p.pos) AS m FROM p")
def advance_then_scan_to(spark, d):
    return P.advance_then_scan_to(_pos(spark, d), "a", "sp", "m").select("item_id", "pos", "m")


@query(_POS + "SELECT item_id, pos FROM (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM p WHERE v) WHERE n % 3 = 1")
def every_nth(spark, d):
    return _pos(spark, d).withColumn("m", P.every_nth("v", 3)).where("m").select("item_id", "pos")


_BR = _POS + """, q AS (SELECT item_id, pos, ch, ch BETWEEN 'A' AND 'Z' AS l, ch = '.' AS r FROM p),
     c AS (SELECT *, sum(CASE WHEN l THEN 1 ELSE 0 END) OVER w - coalesce(sum(CASE WHEN r THEN 1 ELSE 0 END) OVER b, 0) AS depth,
           sum(CASE WHEN l THEN 1 WHEN r THEN -1 ELSE 0 END) OVER w AS o, max(pos) OVER (PARTITION BY item_id) AS last FROM q
           WINDOW w AS (PARTITION BY item_id ORDER BY pos), b AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def _brackets(spark, d):
    return _pos(spark, d).withColumns({"l": F.col("ch").between("A", "Z"), "r": F.col("ch") == "."}).select("item_id", "pos", "l", "r")


@query(_BR + "SELECT item_id, pos, o > 0 AS up_to, o > 0 OR r AS inclusive, o > 0 AND NOT l AS exclusive FROM c")
def span_masks(spark, d):
    return _brackets(spark, d).select("item_id", "pos", P.span_up_to("l", "r").alias("up_to"), P.inclusive_span("l", "r").alias("inclusive"), P.exclusive_span("l", "r").alias("exclusive"))


@query(_BR + "SELECT item_id, pos, CAST(depth AS BIGINT) AS depth, (r AND depth <= 0) OR depth > 2 OR (pos = last AND depth - CASE WHEN r THEN 1 ELSE 0 END > 0) AS nest_error FROM c")
def nesting_depth(spark, d):
    return P.nesting_depth(_brackets(spark, d), "l", "r", 2).select("item_id", "pos", "depth", "nest_error")


@query(_POS + "SELECT item_id, pos, CASE WHEN v THEN pos - coalesce(max(CASE WHEN NOT v THEN pos END) OVER (PARTITION BY item_id ORDER BY pos), -1) - 1 ELSE 0 END AS n FROM p")
def run_index(spark, d):
    return P.run_index(_pos(spark, d), "v", "n").select("item_id", "pos", "n")


@query(_POS + "SELECT item_id, pos, v OR EXISTS (SELECT 1 FROM p y, p z WHERE y.item_id = p.item_id AND z.item_id = p.item_id AND y.v AND z.v AND y.pos < p.pos AND z.pos > p.pos AND y.pos >= p.pos - 2 AND z.pos - y.pos - 1 <= 2 AND z.pos <= p.pos + 2) AS m FROM p")
def fill_run_gaps(spark, d):
    return P.fill_run_gaps(_pos(spark, d), "v", "m", 2).select("item_id", "pos", "m")


@query(_POS + "SELECT item_id, pos, EXISTS (SELECT 1 FROM p y WHERE y.item_id = p.item_id AND y.a AND y.pos BETWEEN p.pos - 2 AND p.pos + 1) AS m FROM p")
def context_span(spark, d):
    return _pos(spark, d).select("item_id", "pos", P.context_span("a", 1, 2).alias("m"))


@query(_POS + "SELECT item_id, pos FROM (SELECT item_id, pos, v, lag(v) OVER (PARTITION BY item_id ORDER BY pos) AS o FROM p) WHERE v <> o")
def boundaries(spark, d):
    return _pos(spark, d).withColumn("m", P.transitions("v")).where("m").select("item_id", "pos")


@query(_POS + ", s AS (SELECT item_id, pos, ch = chr(10) AS b FROM p) SELECT item_id, pos, CAST(1 + (SELECT count(*) FROM s y WHERE y.item_id = s.item_id AND y.b AND y.pos < s.pos) AS BIGINT) AS line_no, (pos = 0 OR EXISTS (SELECT 1 FROM s y WHERE y.item_id = s.item_id AND y.b AND y.pos = s.pos - 1)) AS is_start FROM s")
def line_numbers(spark, d):
    p = _pos(spark, d).withColumn("b", F.col("ch") == "\n")
    return p.select("item_id", "pos", P.line_numbers("b").alias("line_no"), P.line_starts("b").alias("is_start"))


@query(_POS + "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS INTEGER) AS pos, ch FROM p WHERE v")
def filter_by_mask(spark, d):
    return P.filter_by_mask(_pos(spark, d), "v").select("item_id", "pos", "ch")


@query(_POS + "SELECT p.item_id, p.pos, CASE WHEN v THEN cp ELSE 0 END AS cp FROM p")
def spread_by_mask(spark, d):
    p = _pos(spark, d)
    return P.spread_by_mask(p.select("item_id", "pos", "v"), "v", P.filter_by_mask(p, "v"), "cp").select("item_id", "pos", "cp")


@query(_POS + "SELECT item_id, pos, cp FROM p")
def merge_by_mask(spark, d):
    p = _pos(spark, d)
    other = p.withColumn("w", ~F.col("v"))
    return P.merge_by_mask(p.select("item_id", "pos", "v"), "v", P.filter_by_mask(p, "v"), P.filter_by_mask(other, "w"), "cp").select("item_id", "pos", "cp")


@query(_POS + ", g AS (SELECT item_id, pos, ch, unnest(generate_series(0, CASE WHEN v THEN 2 ELSE 0 END)) AS k, CASE WHEN v THEN 2 ELSE 0 END AS n FROM p) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos, k) - 1 AS INTEGER) AS pos, ch, k < n AS is_gap FROM g")
def insertion_mask(spark, d):
    p = _pos(spark, d).withColumn("n", F.when(F.col("v"), 2).otherwise(0))
    return P.insertion_mask(p, "n").select("item_id", "pos", "ch", "is_gap")


@query(_POS + "SELECT item_id, pos, CASE WHEN v THEN cp ELSE 0 END AS cp FROM p")
def zero_by_mask(spark, d):
    return _pos(spark, d).select("item_id", "pos", P.zero_by_mask("cp", "v").alias("cp"))


@query(_POS + ", r AS (SELECT *, pos - row_number() OVER (PARTITION BY item_id, v ORDER BY pos) AS run FROM p) SELECT item_id, CASE WHEN v THEN min(pos) OVER (PARTITION BY item_id, v, run) + CAST(row_number() OVER (PARTITION BY item_id, v, run ORDER BY cp, pos) AS INTEGER) - 1 ELSE pos END AS pos, cp FROM r")
def sort_runs(spark, d):
    return P.sort_runs(_pos(spark, d), "v", "cp").select("item_id", "pos", "cp")


@query(_POS + "SELECT item_id, pos, v AND (SELECT count(*) FROM p y WHERE y.item_id = p.item_id AND y.v AND y.pos <= p.pos) <= 4 AS m FROM p")
def until_n(spark, d):
    return P.until_n(_pos(spark, d), "v", "m", 4).select("item_id", "pos", "m")


@query(_POS + "SELECT item_id, pos, ch FROM p WHERE pos < coalesce((SELECT min(pos) FROM p y WHERE y.item_id = p.item_id AND y.ch = '.'), 1000000000)")
def terminate_at(spark, d):
    p = _pos(spark, d).withColumn("dot", F.col("ch") == ".")
    return P.terminate_at(p, "dot").select("item_id", "pos", "ch")


@query(_POS + "SELECT item_id, pos, CASE WHEN coalesce(lead(a) OVER w, false) THEN lead(cp) OVER w WHEN a THEN lag(cp) OVER w ELSE cp END AS cp FROM p WINDOW w AS (PARTITION BY item_id ORDER BY pos)")
def swap_back(spark, d):
    return P.swap_back(_pos(spark, d), "cp", "a", "cp").select("item_id", "pos", "cp")


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: reverse(w)), ' ') AS text FROM benchmark")
def region_reversal(spark, d):
    return table(spark, d, "benchmark").select("item_id", P.reverse_regions(F.col("text"), " ").alias("text"))


@query(_POS + "SELECT item_id, pos FROM p WHERE v UNION SELECT item_id, pos FROM p WHERE sp")
def set_union(spark, d):
    p = _pos(spark, d)
    return P.union_positions(p.where("v"), p.where("sp"))


@query(_POS + "SELECT item_id, pos FROM p WHERE v INTERSECT SELECT item_id, pos FROM p WHERE pos % 3 = 0")
def set_intersect(spark, d):
    p = _pos(spark, d)
    return P.intersect_positions(p.where("v"), p.where("pos % 3 = 0"))


@query(_POS + "SELECT item_id, pos FROM p WHERE v EXCEPT SELECT item_id, pos FROM p WHERE a")
def set_difference(spark, d):
    p = _pos(spark, d)
    return P.difference_positions(p.where("v"), p.where("a"))


@query(_POS + "SELECT item_id, pos, CASE WHEN a THEN 1 WHEN v THEN 2 WHEN sp THEN 3 ELSE 0 END AS code, (v AND sp) OR (v AND a) OR (sp AND a) AS maj, [1, 5, 7][pos % 3 + 1] AS cyc FROM p")
def multiplex(spark, d):
    p = _pos(spark, d)
    return p.select("item_id", "pos", P.multiplex({"a": F.col("a"), "v": F.col("v"), "sp": F.col("sp")}).alias("code"), P.majority3(F.col("v"), F.col("sp"), F.col("a")).alias("maj"), P.repeating([1, 5, 7]).alias("cyc"))


@query(_POS + "SELECT item_id, pos, (cp + 200) % 256 AS s, (cp - 200 + 512) % 256 AS t, (cp * 5) % 256 AS m, cp // 7 AS q, cp % 7 AS r, CASE WHEN cp % 256 >= 128 THEN cp % 256 - 256 ELSE cp % 256 END AS signed, CASE cp WHEN 97 THEN 1 WHEN 101 THEN 2 ELSE 0 END AS looked FROM p")
def bixnum_arithmetic(spark, d):
    p, c = _pos(spark, d), F.col("cp")
    dv = P.divide(c, 7)
    return p.select("item_id", "pos", P.add_modular(c, 200, 8).alias("s"), P.sub_modular(c, 200, 8).alias("t"), P.mul_modular(c, 5, 8).alias("m"), dv["quotient"].alias("q"), dv["remainder"].alias("r"), P.sign_extend(P.truncate(c, 8), 8).alias("signed"), P.lookup(c, {97: 1, 101: 2}).alias("looked"))


@query(_POS + "SELECT item_id, pos, cp FROM p")
def basis_bits(spark, d):
    return _pos(spark, d).select("item_id", "pos", P.from_bits(P.basis_bits(F.col("cp"), 21)).alias("cp"))


@query("WITH s AS (SELECT doc_id, unnest(generate_series(1, 3)) AS start, doc_id % 5 AS w FROM documents), x AS (SELECT doc_id AS item_id, start * 3 AS start, start * 3 + w + start AS e FROM s), b AS (SELECT item_id, start, max(e) AS e FROM x GROUP BY ALL) SELECT item_id, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM b WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.item_id = b.item_id AND y.start < b.start AND y.e >= b.e)")
def longest_matches(spark, d):
    s = docs(spark, d).select(F.col("doc_id").alias("item_id"), F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("k"))
    return P.longest_matches(s.select("item_id", (F.col("k") * 3).alias("start"), (F.col("k") * 4 + F.col("item_id") % 5).alias("end")))


# -- CSV, JSON, markup

_CSV = "'id,name,\"note, x\"' || chr(10) || n_nationkey || ',' || n_name || ',\"a \"\"' || n_regionkey || '\"\", b\"' || chr(13) || chr(10) || ',,' || chr(10)"


def _csv(spark, d):
    return table(spark, d, "nation").selectExpr("n_nationkey", f"{_CSV.replace('chr', 'char')} AS text")


@query("SELECT n_nationkey, 0 AS record_no, '\"note, x\",id' AS record FROM nation UNION ALL SELECT n_nationkey, 1, '\"a \"\"' || n_regionkey || '\"\", b\",' || n_nationkey FROM nation UNION ALL SELECT n_nationkey, 2, ',' FROM nation")
def csv_cut(spark, d):
    return csvops.cut(_csv(spark, d), [2, 0])


@query("SELECT n_nationkey, 1 AS record_no, n_nationkey || ',' || n_name || ',\"a \"\"' || n_regionkey || '\"\", b\"' AS record FROM nation WHERE n_regionkey = 1")
def csv_grep(spark, d):
    return csvops.search(_csv(spark, d), '"1"', [2])


@query("SELECT n_nationkey, 'id,name,\"note, x\"' || chr(10) || n_nationkey || ',' || n_name || ',\"a \"\"' || n_regionkey || '\"\", b\"' || chr(10) || ',,' || chr(10) AS text FROM nation")
def csv_standardize(spark, d):
    return _csv(spark, d).select("n_nationkey", csvops.standardize(F.col("text")).alias("text"))


@query("SELECT n_nationkey, '[{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"note, x\":\"a \\\"' || n_regionkey || '\\\", b\"},{\"id\":\"\",\"name\":\"\",\"note, x\":\"\"}]' AS json FROM nation")
def csv_to_json(spark, d):
    return _csv(spark, d).select("n_nationkey", csvops.to_json(F.col("text")).alias("json"))


@query("SELECT n_nationkey, 2 AS record_no, ',,' AS record, unnest([0, 1, 2]) AS field_no FROM nation")
def csv_empty_fields(spark, d):
    return csvops.empty_fields(_csv(spark, d))


@query("SELECT event_id, json_valid(props) AND NOT contains(props, '9') AS ok FROM events")
def json_validate(spark, d):
    e = table(spark, d, "events", "event_id", "props")
    broken = F.when(F.contains("props", F.lit("9")), F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props"))
    return e.select("event_id", jsonops.is_valid(broken).alias("ok"))


@query("SELECT n_nationkey, 'a,b' || chr(10) || ',' || n_name || chr(10) || n_regionkey || ',' || chr(10) AS csv FROM nation")
def json_to_csv(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('[{"b":"'), "n_name", F.lit('"},{"a":"'), F.col("n_regionkey").cast("string"), F.lit('"}]')).alias("text"))
    return t.select("n_nationkey", jsonops.to_csv(F.col("text")).alias("csv"))


@query("SELECT event_id, CAST(1 AS INTEGER) AS depth FROM events")
def json_depth(spark, d):
    return table(spark, d, "events", "event_id", "props").select("event_id", jsonops.depth(F.col("props")).alias("depth"))


@query(r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<(/?[A-Za-z_:][^\s/>]*)', 1)) AS tag FROM pages) GROUP BY tag")
def html_tags(spark, d):
    return table(spark, d, "pages", "page_id", "html").select(F.explode(xmlops.tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(r"SELECT ref, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z_:][\w:.-]*);', 1)) AS ref FROM pages) GROUP BY ref")
def html_refs(spark, d):
    return table(spark, d, "pages", "page_id", "html").select(F.explode(xmlops.references(F.col("html"))).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<\\?.*?\\?>', '', 'g') AS html FROM pages")
def html_preprocess(spark, d):
    return table(spark, d, "pages", "page_id", "html").withColumn("html", xmlops.without(F.col("html")))


@query()
def xml_check(spark, d):
    return table(spark, d, "pages", "page_id", "html").select("page_id", xmlops.check(F.col("html")).alias("c")).select("page_id", "c.*")


# -- tokens


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\pL\pM\p{Nd}\p{Nl}\p{Pc}]+|[^\pL\pM\p{Nd}\p{Nl}\p{Pc}\s\x0B]+')) AS INTEGER) AS n FROM documents")
def pretok_whitespace(spark, d):
    return docs(spark, d).select("doc_id", F.size(tokens.pretokenize(F.col("text"), "whitespace")).alias("n"))


@query("SELECT doc_id, array_to_string(string_split_regex(trim(text, ' ' || chr(10) || chr(9)), '[ \\n\\t]+'), '|') AS pieces FROM documents")
def pretok_split(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tokens.pretokenize(F.col("text"), "whitespacesplit"), "|").alias("pieces"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '(?s)[0-9]+|[^0-9]+'), '|') AS pieces FROM documents")
def pretok_digits(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tokens.pretokenize(F.col("text"), "digits"), "|").alias("pieces"))


@query(r"SELECT item_id, array_to_string(regexp_extract_all(text, '(?s)[!-/:-@\[-`{-~\pP]|[^!-/:-@\[-`{-~\pP]+'), '|') AS isolated, array_to_string(regexp_extract_all(text, '(?s)[^!-/:-@\[-`{-~\pP]+'), '|') AS removed, array_to_string(regexp_extract_all(text, '(?s)[^!-/:-@\[-`{-~\pP]*[!-/:-@\[-`{-~\pP]|[^!-/:-@\[-`{-~\pP]+'), '|') AS previous, array_to_string(regexp_extract_all(text, '(?s)[!-/:-@\[-`{-~\pP]+|[^!-/:-@\[-`{-~\pP]+'), '|') AS contiguous FROM benchmark")
def split_behaviours(spark, d):
    t = F.col("text")
    made = {n: F.array_join(tokens.pretokenize(t, "punctuation", b), "|") for n, b in (("isolated", "isolated"), ("removed", "removed"), ("previous", "mergedwithprevious"), ("contiguous", "contiguous"))}
    return table(spark, d, "benchmark").select("item_id", *(c.alias(n) for n, c in made.items()))


@query("SELECT doc_id, length(text) AS covered FROM documents")
def pretok_gpt2(spark, d):
    pieces = F.regexp_extract_all("text", F.lit(tokens.GPT2), F.lit(0))
    return docs(spark, d).select("doc_id", F.aggregate(pieces, F.lit(0), lambda n, p: n + F.char_length(p)).alias("covered"))


@query("SELECT doc_id, lower(strip_accents(regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g'))) AS text FROM documents")
def normalizer_chain(spark, d):
    return docs(spark, d).withColumn("text", tokens.normalize(F.col("text"), "strip", "stripaccents", "lowercase"))


@query("SELECT doc_id, strlen(text) AS n FROM documents")
def byte_level(spark, d):
    return docs(spark, d).select("doc_id", F.char_length(tokens.to_byte_level(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{1}-\x{8}\x{B}\x{E}-\x{1F}\x{7F}\x{8F}\x{9F}]', '', 'g'), '[\x{9}\x{A}\x{C}\x{D}\x{1680}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}]', ' ', 'g') AS text FROM documents")
def normalizer_nmt(spark, d):
    return docs(spark, d).withColumn("text", tokens.normalize(F.col("text"), "nmt"))


_MERGES = [("t", "h"), ("th", "e"), ("i", "n"), ("Ġ", "the"), ("e", "r"), ("o", "n"), ("a", "n"), ("ti", "on"), ("t", "i"), ("ti", "on"), ("Ġ", "a")]


@query()
def bpe(spark, d):
    return tokens.bpe_tokens(docs(spark, d), _MERGES).select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("ids"))


# -- approximate matching, audio


@query("WITH w AS (SELECT item_id, i, substr(regexp_replace(text, '[\\r\\n]', '', 'g'), CAST(i + 2 - m AS BIGINT), CAST(m AS BIGINT)) AS s FROM (SELECT item_id, text, unnest(generate_series(0, length(regexp_replace(text, '[\\r\\n]', '', 'g')) - 1)) AS i FROM benchmark), (SELECT unnest(generate_series(0, 7)) AS m) WHERE m <= i + 1) SELECT item_id, 0 AS pattern_no, CAST(i AS INTEGER) AS \"end\", CAST(min(levenshtein(s, 'thing')) AS INTEGER) AS distance FROM w GROUP BY item_id, i HAVING min(levenshtein(s, 'thing')) <= 2")
def edit_distance(spark, d):
    return approx.approximate_matches(table(spark, d, "benchmark", "item_id", "text"), ["thing"], 2)


@query("WITH e AS (SELECT DISTINCT doc_id, length(text) % 50 + k * 3 AS e FROM documents, (VALUES (1), (2), (9)) AS t(k)) SELECT doc_id, CAST(e AS INTEGER) AS \"end\", (SELECT count(*) FROM e y WHERE y.doc_id = e.doc_id AND y.e BETWEEN e.e - 4 AND e.e) AS n FROM e WHERE (SELECT count(*) FROM e y WHERE y.doc_id = e.doc_id AND y.e BETWEEN e.e - 4 AND e.e) >= 2")
def second_filter(spark, d):
    hits = docs(spark, d).select("doc_id", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(9)), lambda k: F.char_length("text") % 50 + k * 3)).alias("end"))
    return approx.dense_windows(hits, "doc_id", 5, 2)


@query("SELECT p_partkey, pattern, CAST(levenshtein(p_type, pattern) AS INTEGER) AS distance FROM part, (VALUES ('STANDARD'), ('SMALL')) AS t(pattern) WHERE levenshtein(p_type, pattern) <= 3")
def near_patterns(spark, d):
    return approx.near_patterns(table(spark, d, "part", "p_partkey", "p_type"), "p_type", ["STANDARD", "SMALL"], 3).select("p_partkey", "pattern", "distance")


@query("SELECT event_id, greatest(least(CAST(round(value) AS BIGINT) * 900, 32767), -32768) AS x FROM events")
def amplify(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", audio.amplify(F.round("value").cast("long"), 900).alias("x"))


@query("SELECT event_id, CAST(floor((CAST(round(value) AS BIGINT) + user_id - 40) / 2.0) AS BIGINT) AS x FROM events")
def stereo_to_mono(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "value").select("event_id", audio.to_mono(F.round("value").cast("long"), F.col("user_id") - 40).alias("x"))


@query("SELECT event_id, coalesce(abs(CAST(round(value) AS BIGINT) - lag(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id)) >= 20, false) AS m FROM events")
def discontinuity(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value").withColumn("x", F.round("value").cast("long"))
    return e.select("event_id", audio.discontinuities(F.col("x"), 20, "user_id", "event_id").alias("m"))


@query("SELECT l_orderkey, l_linenumber, [l_partkey, l_partkey + 1] AS l, [l_suppkey, l_suppkey + 1] AS r FROM lineitem")
def interleave_channels(spark, d):
    t = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    both = audio.interleave(F.array("l_partkey", F.col("l_partkey") + 1), F.array("l_suppkey", F.col("l_suppkey") + 1))
    return t.select("l_orderkey", "l_linenumber", audio.channel(both, 0, 2).alias("l"), audio.channel(both, 1, 2).alias("r"))


# -- compression, transforms, programs


def _round_trip(spark, d, kind):
    return docs(spark, d).select("doc_id", F.decode(compress.decompress(compress.compress(F.col("text"), kind), kind), "UTF-8").alias("text"))


@query("SELECT doc_id, text FROM documents")
def ztf_prefix(spark, d):
    return _round_trip(spark, d, "prefix")


@query("SELECT doc_id, text FROM documents")
def ztf_runs(spark, d):
    return _round_trip(spark, d, "runs")


@query("SELECT doc_id, text FROM documents")
def ztf_words(spark, d):
    return _round_trip(spark, d, "words")


@query(r"SELECT length_group, count(*) AS n FROM (SELECT CASE WHEN strlen(w) <= 4 THEN 0 WHEN strlen(w) <= 8 THEN 1 WHEN strlen(w) <= 16 THEN 2 ELSE 3 END AS length_group FROM (SELECT unnest(regexp_extract_all(text, '\pL+')) AS w FROM documents)) GROUP BY length_group")
def word_length_groups(spark, d):
    return docs(spark, d).select(F.explode(compress.word_groups(F.col("text"))).alias("g")).groupBy("g.length_group").agg(F.count("*").alias("n"))


@query("SELECT doc_id, upper(replace(nfc_normalize(text), 'ß', 'SS')) AS text FROM documents")
def named_transforms(spark, d):
    return docs(spark, d).withColumn("text", transforms.transform(transforms.transform(F.col("text"), "Any-NFC"), "Any-Upper"))


@query("SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, 'sch', 'š'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'k([ei])', 'c\\1', 'g') AS text FROM documents")
def rule_transform(spark, d):
    return docs(spark, d).withColumn("text", transforms.Transform("sch > š; ä <> ae; ö <> oe; ü <> ue; k } [ei] > c;").column(F.col("text")))


@query(_POS + _NEXT + " , s AS (SELECT item_id, pos, a AND NOT coalesce(lag(a) OVER (PARTITION BY item_id ORDER BY pos), false) AS st FROM p) SELECT p.item_id, p.pos, EXISTS (SELECT 1 FROM n y JOIN s z ON z.item_id = y.item_id AND z.pos = y.pos WHERE y.item_id = p.item_id AND z.st AND y.stop = p.pos) OR p.sp AS m FROM p")
def bit_program(spark, d):
    k = program.Kernel("""
        kernel ends :: [<i1> a, <i1> v, <i1> sp] -> [<i1> m] {
            start = a & ~Advance(a, 1)
            m = ScanThru(start, v) | sp
        }""")
    return k(_pos(spark, d)).select("item_id", "pos", "m")


# -- sources and streams


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'part%7%' THEN false WHEN p_name LIKE '%1_' THEN true ELSE false END AS ok FROM part")
def select_names(spark, d):
    rules = [("include", "*1?"), ("exclude", "part*7*")]
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", files.selected(F.col("p_name"), rules, "file").alias("ok"))


@query()
def random_numbers(spark, d):
    return files.random_stream(spark, 1000, 8, 3)


@query("SELECT doc_id, text FROM documents WHERE false")
def empty_stream(spark, d):
    return files.empty_stream(docs(spark, d))


@query(_lines_sql("SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'th[a-z]+ing')"))
def stream_grep(spark, d):
    s = streams.read_table_stream(spark, f"{d}/documents.parquet").select("doc_id", "text")
    return streams.on_stream(s, lambda df: search.grep(df, Pattern("th[a-z]+ing")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, d):
    s = streams.read_table_stream(spark, f"{d}/events.parquet").select("event_type")
    return streams.drain(s.groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT conv_id, turn AS piece, CAST(1 + coalesce(sum(strlen(text) - strlen(replace(text, chr(10), ''))) OVER w, 0) AS BIGINT) AS first_line, CAST(coalesce(sum(2 * strlen(text) - 2 * strlen(replace(text, '(', '')) - (strlen(text) - strlen(replace(text, '(', ''))) - (strlen(text) - strlen(replace(text, ')', '')))) OVER w, 0) AS BIGINT) AS depth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def stream_pieces(spark, d):
    s = streams.read_table_stream(spark, f"{d}/conversations.parquet").select("conv_id", F.col("turn").alias("piece"), "text")
    return streams.drain(streams.number_pieces(s, "conv_id"))


# -- pattern constructs, against their plain form

_W = r"\pL\pM\p{Nd}\p{Pc}"


def _grep_sql(condition: str) -> str:
    return _lines_sql(f"SELECT doc_id, line_no, line FROM l WHERE {condition}")


SQL["grep_lookaround"] = _grep_sql(rf"regexp_matches(line, '[{_W}]{{3}}ing (?:$|t$|th$|[^t]|t[^h]|th[^e])')")
SQL["grep_backreference"] = _lines_sql(
    "SELECT doc_id, line_no, line FROM l WHERE list_has_any(regexp_extract_all(line, 'WORD{6,}'), (SELECT coalesce(list(w), []) FROM g))".replace("WORD", f"[{_W}]"),
    f""", w AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[{_W}]{{6,}}')) AS w FROM l),
     g AS (SELECT w FROM w WHERE len(list_filter(generate_series(3, length(w) // 2), lambda k: len(list_filter(generate_series(1, length(w) - 2 * k + 1),
           lambda i: substr(w, i, k) = substr(w, i + k, k))) > 0)) > 0)""",
)
SQL["grep_count_all"] = "SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, 'e[a-z]*'), lambda m: length(m))), 0) AS BIGINT) AS matches FROM documents"


@query(_grep_sql(rf"regexp_matches(line, '(?:^|[^{_W}])th[{_W}]')"))
def grep_boundary(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\bth\B"))


@query(_grep_sql(rf"regexp_matches(line, '(?:^|[^{_W}])in(?:[^{_W}]|$)')"))
def grep_word_edges(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\<in\>"))


@query(_grep_sql("regexp_matches(line, 'An|Th|er |é')"))
def grep_escapes(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\x41\x{6E}|Th|e\o{162}\040|\U000000E9"))


@query(_grep_sql("regexp_matches(line, '(?i:the) [a-z]+|X')"))
def grep_mode_flags(spark, d):
    return search.grep(docs(spark, d), Pattern("(?i:the)(?#a comment) (?-i:[a-z]+)|(?|X|Xy)"))


@query(_grep_sql("regexp_matches(line, '(?:an|a)d ')"))
def grep_possessive(spark, d):
    return search.grep(docs(spark, d), Pattern("[0-9]++[0-9]|(?>an|a)d "))


@query(_grep_sql("regexp_matches(line, 't.*g {1,2}o')"))
def grep_lazy(spark, d):
    return search.grep(docs(spark, d), Pattern("t.*?g {1,2}?o"))


@query(_grep_sql("regexp_matches(line, '[éè]')"))
def grep_character_names(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\N{LATIN SMALL LETTER E WITH (ACUTE|GRAVE)}"))


@query(_grep_sql(r"regexp_matches(line, '[\p{Nd}\p{Lu}]{2}')"))
def grep_property_values(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\p{gc=/^(Nd|Lu)$/}{2}"))


@query(_grep_sql(r"regexp_matches(line, '[\p{Nd}\p{Lu}][b-df-hj-np-tv-z]{2}')"))
def grep_posix_classes(spark, d):
    return search.grep(docs(spark, d), Pattern("[[:digit:][:upper:]][[a-z]--[aeiou]]{2}"))


@query(_grep_sql("length(line) BETWEEN 1 AND 60"))
def grep_graphemes(spark, d):
    return search.grep(docs(spark, d), Pattern(r"^\X{1,60}$"))


@query(_grep_sql("regexp_matches(line, '(?:abc|acb|cab)|(?:der|dre|rde)')"))
def grep_interleaved(spark, d):
    return search.grep(docs(spark, d), Pattern(r"\A{a<b|c}|\A{d<e|r}"))


@query(_grep_sql("regexp_matches(nfc_normalize(line), 'é[a-z]')"))
def grep_equivalence(spark, d):
    return search.grep(docs(spark, d), Pattern("é[a-z]", equivalence="NFC"))


@query(_lines_sql("SELECT count(*) > 0 AS found, false AS other FROM l WHERE regexp_matches(line, 'th[a-z]+ing')"))
def grep_quiet(spark, d):
    made = search.quiet(docs(spark, d), Pattern("th[a-z]+ing")), search.quiet(docs(spark, d), Pattern("\x01\x02", "fixed"))
    return spark.createDataFrame([made], "found boolean, other boolean")


@query(_lines_sql("SELECT doc_id, line_no, regexp_replace(line, '([a-z]+)(tion|ment)', '\\2-\\1' || chr(9), 'g') AS line FROM l WHERE regexp_matches(line, '[a-z]+(?:tion|ment)')"))
def grep_replace_names(spark, d):
    return search.replace(docs(spark, d), Pattern("(?<stem>[a-z]+)(?<end>tion|ment)"), r"${end}\x2D${stem}\t")


# -- more positions


@query(_POS + "SELECT item_id, pos, cp = 101 AS eq, cp <> 101 AS ne, cp > 101 AS gt, cp >= 101 AS ge, cp < 101 AS lt, cp <= 101 AS le, cp % 16 < pos % 16 AS below FROM p")
def number_compare(spark, d):
    c = F.col("cp")
    tests = {n: P.compare(c, op, 101).alias(n) for n, op in (("eq", "EQ"), ("ne", "NEQ"), ("gt", "UGT"), ("ge", "UGE"), ("lt", "ULT"), ("le", "ULE"))}
    return _pos(spark, d).select("item_id", "pos", *tests.values(), P.compare(c, "ULT", F.col("pos"), 4).alias("below"))


@query(_POS + "SELECT item_id, pos, CASE WHEN cp BETWEEN 48 AND 57 THEN 1 WHEN cp BETWEEN 65 AND 90 THEN 2 WHEN cp BETWEEN 97 AND 122 THEN 3 ELSE 0 END AS code, cp // 8 AS high, cp % 8 AS low FROM p")
def range_table(spark, d):
    c = F.col("cp")
    return _pos(spark, d).select("item_id", "pos", P.lookup_ranges(c, [(48, 57, 1), (65, 90, 2), (97, 122, 3)]).alias("code"), P.high_bits(c, 3).alias("high"), P.truncate(c, 3).alias("low"))


@query(_POS + "SELECT item_id, pos FROM p WHERE a")
def marked_positions(spark, d):
    return P.marked(_pos(spark, d), "a").select("item_id", "pos")


@query(_POS + "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS INTEGER) AS pos, ch FROM p WHERE v AND a")
def combined_filters(spark, d):
    p = P.combined_mask(_pos(spark, d), "v", "a", "both")
    return P.filter_by_mask(p, "both").select("item_id", "pos", "ch")


@query("SELECT item_id, CAST(unnest(generate_series(0, length(text))) AS INTEGER) AS pos, length(text) = unnest(generate_series(0, length(text))) AS last FROM benchmark")
def eof_marks(spark, d):
    return _pos(spark, d, eof=True).select("item_id", "pos", P.at_eof().alias("last"))


@query(_POS + ", s AS (SELECT item_id, pos, ch = '.' AS x, CAST(1 + coalesce(sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no FROM p) SELECT item_id, line_no, true AS matched FROM s WHERE x GROUP BY ALL")
def matched_records(spark, d):
    p = _pos(spark, d).withColumns({"b": F.col("ch") == "\n", "x": F.col("ch") == "."})
    return P.matched_records(p.withColumn("line_no", P.line_numbers("b")), "x", "line_no")


@query(_POS + "SELECT item_id, pos, EXISTS (SELECT 1 FROM p y WHERE y.item_id = p.item_id AND y.a AND y.pos <= p.pos AND p.pos < y.pos + y.cp % 5) AS m FROM p")
def span_cover(spark, d):
    return P.cover(_pos(spark, d).withColumn("n", F.col("cp") % 5), "a", "n", "m").select("item_id", "pos", "m")


@query(_POS + "SELECT item_id, string_agg(CASE WHEN v THEN '1' ELSE '.' END, '' ORDER BY pos) AS v, string_agg(CASE WHEN a THEN '1' ELSE '.' END, '' ORDER BY pos) AS a FROM p GROUP BY item_id")
def shown_streams(spark, d):
    return files.show_positions(_pos(spark, d), ["v", "a"]).select("item_id", "v", "a")


@query(_POS + "SELECT item_id, pos, v OR sp AS any_of, v AND a AS all_of, v <> a AS one_of, CASE WHEN v THEN a ELSE sp END AS chosen FROM p")
def stream_sets(spark, d):
    made = P.union_streams("v", "sp").alias("any_of"), P.intersect_streams("v", "a").alias("all_of"), P.xor(F.col("v"), F.col("a")).alias("one_of"), P.select_by(F.col("v"), F.col("a"), F.col("sp")).alias("chosen")
    return _pos(spark, d).select("item_id", "pos", *made)


# -- more characters and normal forms


@query("SELECT doc_id, strlen(text) AS first_error FROM documents")
def utf8_first_error(spark, d):
    broken = F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff"), F.encode("text", "UTF-8"))
    return docs(spark, d).select("doc_id", chars.first_utf8_error(broken).cast("long").alias("first_error"))


@query("SELECT doc_id, text FROM documents")
def utf32_round_trip(spark, d):
    return docs(spark, d).select("doc_id", chars.from_utf32(F.encode("text", "UTF-32")).alias("text"))


@query("SELECT n_nationkey, chr(1040 + n_nationkey) || chr(1024 + 32 + n_nationkey) AS text FROM nation")
def iso8859_5(spark, d):
    data = F.concat(F.unhex(F.hex(F.col("n_nationkey").cast("long") + 0xB0)), F.unhex(F.hex(F.col("n_nationkey").cast("long") + 0xC0)))
    return table(spark, d, "nation").select("n_nationkey", F.decode(chars.iso8859_5_to_utf16(data), "UTF-16BE").alias("text"))


_SYLLABLE = "44032 + n_nationkey * 447"


@query(f"SELECT n_nationkey, chr(4352 + (n_nationkey * 447) // 588) || chr(4449 + (n_nationkey * 447) % 588 // 28) || CASE WHEN (n_nationkey * 447) % 28 = 0 THEN '' ELSE chr(4519 + (n_nationkey * 447) % 28) END AS jamo, chr({_SYLLABLE}) AS again FROM nation")
def hangul(spark, d):
    syllable = F.decode(F.unhex(F.lpad(F.hex(F.expr(f"CAST({_SYLLABLE} AS BIGINT)")), 8, "0")), "UTF-32")
    t = table(spark, d, "nation").select("n_nationkey", normalize.hangul_decompose(syllable).alias("jamo"))
    return t.select("n_nationkey", "jamo", normalize.hangul_compose(F.col("jamo")).alias("again"))


@query("SELECT doc_id, [CAST(length(text) AS INTEGER) + 2] AS failures FROM documents")
def fcd_check(spark, d):
    return docs(spark, d).select("doc_id", normalize.fcd_failures(F.concat("text", F.lit("ẹ́"))).alias("failures"))


@query("SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS text FROM documents")
def nfd_masked(spark, d):
    return docs(spark, d).withColumn("text", normalize.normalize_where(F.col("text"), "NFD", charset.CharSet([(0xE9, 0xE9)])))


# -- more tokens


_SPACES = r"[ \x{9}-\x{D}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{{1}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{FFFD}}\p{{Cf}}\p{{Co}}]', '', 'g'), '{_SPACES}', ' ', 'g') AS clean, regexp_replace(text || '中文a', '([\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}])', ' \1 ', 'g') AS spaced FROM documents")
def normalizer_bert(spark, d):
    return docs(spark, d).select("doc_id", tokens.normalize(F.col("text"), "bertcleantext").alias("clean"), tokens.normalize(F.concat("text", F.lit("中文a")), "bertchinesechars").alias("spaced"))


_OFFSETS = rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[{_W}]+|[^{_W}]+') AS p FROM documents), b AS (SELECT doc_id, unnest(p) AS piece, unnest(generate_series(1, len(p))) AS i FROM a)
SELECT doc_id, piece, CAST(sum(SIZE(piece)) OVER w - SIZE(piece) AS INTEGER) AS span_start, CAST(sum(SIZE(piece)) OVER w AS INTEGER) AS span_end FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def _offsets(spark, d, unit):
    pieces = tokens.pretokenize(F.col("text"), "simplewordboundaries")
    return docs(spark, d).select("doc_id", F.explode(tokens.with_offsets(pieces, unit)).alias("p")).select("doc_id", "p.piece", F.col("p.start").alias("span_start"), F.col("p.end").alias("span_end"))


@query(_OFFSETS.replace("SIZE", "length"))
def token_offsets(spark, d):
    return _offsets(spark, d, "char")


@query(_OFFSETS.replace("SIZE", "strlen"))
def token_byte_offsets(spark, d):
    return _offsets(spark, d, "byte")


@query(r"SELECT item_id, array_to_string(regexp_extract_all(text, '(?s)[!-/:-@\[-`{-~\pP][^!-/:-@\[-`{-~\pP]*|[^!-/:-@\[-`{-~\pP]+'), '|') AS next, array_to_string(regexp_extract_all(text, '(?s)[!-/:-@\[-`{-~\pP]|[^!-/:-@\[-`{-~\pP\s]+'), '|') AS bare FROM benchmark")
def split_behaviours_more(spark, d):
    made = {n: F.array_join(tokens.pretokenize(F.col("text"), "punctuation", b), "|") for n, b in (("next", "mergedwithnext"), ("bare", "excludewhitespace"))}
    return table(spark, d, "benchmark").select("item_id", *(c.alias(n) for n, c in made.items()))


# -- more JSON, audio, transforms, files and streams


@query("SELECT event_id, 1 AS line, CAST(length(props) + 2 AS INTEGER) AS \"column\", 'Extra data' AS message FROM events")
def json_first_error(spark, d):
    broken = F.concat("props", F.lit(" ]"))
    return table(spark, d, "events", "event_id", "props").select("event_id", jsonops.first_error(broken).alias("e")).select("event_id", "e.*")


@query("SELECT event_id, ['null', 'true', 'number', 'string', 'object', 'array', 'invalid'][event_id % 7 + 1] AS kind FROM events")
def json_kinds(spark, d):
    made = F.array(*map(F.lit, ("null", " true ", "-1.5e3", '"a\\"b"')), F.col("props"), F.lit("[1]"), F.lit("nul"))
    return table(spark, d, "events", "event_id", "props").select("event_id", jsonops.kind(F.element_at(made, (F.col("event_id") % 7 + 1).cast("int"))).alias("kind"))


@query("SELECT n_nationkey, CAST(1 + n_regionkey % 2 AS BIGINT) AS channels, CAST(8000 AS BIGINT) AS sample_rate, CAST(16 AS BIGINT) AS bits, CAST(4 AS BIGINT) AS data_bytes, [CAST(n_nationkey AS BIGINT), -2] AS samples FROM nation")
def wav_files(spark, d):
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    head = (
        F.lit(b"RIFF".hex() + "28000000" + b"WAVEfmt ".hex() + "10000000" + "0100"), byte(1 + F.col("n_regionkey") % 2), F.lit("00" + "401f0000" + "007d0000" + "0400" + "1000" + b"data".hex() + "04000000"),
        byte(F.col("n_nationkey")), F.lit("00" + "feff"),
    )
    t = audio.wav_header(table(spark, d, "nation").withColumn("content", F.unhex(F.concat(*head))))
    return t.select("n_nationkey", "channels", "sample_rate", "bits", "data_bytes", audio.wav_samples(F.col("content")).alias("samples"))


@query("SELECT doc_id, replace(replace(replace(text, 'ae', 'ä'), 'oe', 'ö'), 'ue', 'ü') AS text FROM documents")
def rule_inverse(spark, d):
    return docs(spark, d).withColumn("text", transforms.Transform("sch > š; ä <> ae; ö <> oe; ü <> ue;", inverse=True).column(F.col("text")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN true WHEN p_partkey % 2 = 0 THEN substr(CAST(p_partkey AS VARCHAR), 1, 1) <> '1' ELSE false END AS ignored FROM part")
def ignore_files(spark, d):
    key = F.col("p_partkey")
    path = F.concat(F.lit("a/b"), (key % 3).cast("string"), F.lit("/f"), key.cast("string"), F.when(key % 2 == 0, ".o").otherwise(".c"))
    rules = {"": ["# objects", "*.o", "!f1*.o", "/a/b2/"]}
    return table(spark, d, "part", "p_partkey").select("p_partkey", files.ignored(path, rules).alias("ignored"))


@query("SELECT * FROM (VALUES (0, 'one'), (1, 'two')) AS t(doc_id, text)")
def memory_source(spark, d):
    return files.from_memory(spark, ["one", "two"]).select(F.col("doc_id").cast("int").alias("doc_id"), "text")


@query(_lines_sql("SELECT line, count(*) AS n FROM l GROUP BY line"))
def written_lines(spark, d):
    folder = streams.shared_folder(spark)
    files.write_lines(lines.lines(docs(spark, d)), folder)
    return files.read_lines(spark, folder).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label FROM part")
def written_csv(spark, d):
    folder = streams.shared_folder(spark)
    t = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    files.write_csv(t.select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label")), folder)
    return files.read_csv(spark, folder).select(F.col("p_partkey").cast("long").alias("p_partkey"), "label")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    s = streams.read_table_stream(spark, f"{d}/events.parquet").select("ts", "event_type")
    made = streams.drain(streams.windowed_counts(s, "ts", "1 hour", "1 day", "event_type"), "complete")
    return made.withColumn("start", F.col("start").cast("timestamp_ntz"))
