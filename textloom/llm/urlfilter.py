"""URL filters: path rules, then a blocked Bloom filter and an exact join. DataFrame functions only.

A url is judged by the longest rule (host and path) that fits it. Where none does, it is blocked if its
canonical form is listed. The list becomes a blocked Bloom filter: a table of 256-bit blocks (four longs),
in which each listed url sets eight bits of one block. Pages look up their block, and only rows whose bits are all
set go on to the exact hash join with the list, which removes false positives; the others never move.

Canonical form: host in lower case without ``www.``, path without trailing slashes, query without ``utm_*`` and
``ref`` parameters, no scheme, no fragment.

Scale: the filter takes about 4 bytes a listed url and is broadcast only if its counted blocks stay below
``broadcast_bytes``; beyond that it is joined by block number, which deals evenly whatever the hosts. The list is
written before the exact join, so that a listed url that a third of all pages share can be split by AQE.

Cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed. Repeated
rows are judged one by one, repeated or null entries of the list count once or not at all. Columns besides
``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS_PER_URL = 24
BROADCAST_BYTES = 64 << 20
_BLOCK_BYTES = 40
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.concat(F.regexp_replace(F.regexp_extract(url, _PARTS, 3), r"^\?", ""), F.lit("&"))
    query = F.regexp_replace(F.regexp_replace(query, "(?:utm_[a-z]+|ref)=[^&]*&", ""), "&+$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block and the four words' bits of a url."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")) for k in range(8)]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(bit[2 * k].bitwiseOR(bit[2 * k + 1]).alias(f"m{k}") for k in range(4))]


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_url: int = BITS_PER_URL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for ``pages`` (page_id, url); ``listed``: (url)."""
    scratch = Scratch(pages.sparkSession, "urls")
    exact = scratch.keep(listed.select(canonical(F.col("url")).alias("canon")).where("canon IS NOT NULL").distinct(), "listed")
    blocks = max(1, -(-exact.count() * bits_per_url // 256))
    bloom = exact.select(*_bits(F.col("canon"), blocks)).groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"b{k}") for k in range(4)))
    bloom = scratch.keep(bloom, "bloom")
    if blocks * _BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canon"))
    rows = rows.select("page_id", "host", "path", "canon", rule.alias("rule"), verdict.alias("by_rule"))
    tested = rows.select("*", *_bits(F.col("canon"), blocks)).join(bloom, "block", "left")
    possible = F.col("canon").isNotNull()
    for k in range(4):
        possible = possible & F.coalesce(F.col(f"b{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"), F.lit(False))
    tested = tested.select("page_id", "host", "path", "canon", "rule", "by_rule", possible.alias("possible"))
    passed = tested.where("possible").join(exact.withColumn("found", F.lit(True)), "canon", "left")
    out = tested.where("NOT possible").withColumn("found", F.lit(False)).unionByName(passed)
    found = F.coalesce(F.col("found"), F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(found, F.lit("block")).otherwise("allow")).alias("verdict"), found.alias("listed"))


#: The supplied tables hold no list of urls. The list of the query is made of the pages of these two sites.
LISTED_SITES = r"(?:^|\.)(?:spam-farm|cheap-pills)\."


def listed_pages(pages: DataFrame) -> DataFrame:
    return pages.select("url").where(host_of(F.col("url")).rlike(LISTED_SITES))


_SQL_PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)'"
SQL = rf"""
WITH a AS (SELECT page_id, coalesce(translate(regexp_extract(url, {_SQL_PARTS}, 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, {_SQL_PARTS}, 2), '') AS path, regexp_extract(url, {_SQL_PARTS}, 3) AS q FROM pages),
     b AS (SELECT page_id, host, path,
           regexp_replace(regexp_replace(regexp_replace(q, '^\?', '') || '&', '(?:utm_[a-z]+|ref)=[^&]*&', '', 'g'), '&+$', '') AS query FROM a),
     c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
           CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon FROM b),
     l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(?:^|\.)(?:spam-farm|cheap-pills)\.') AND canon IS NOT NULL),
     r AS (SELECT c.*, l.canon IS NOT NULL AS listed, CASE
           WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
           WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
           FROM c LEFT JOIN l USING (canon))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
       WHEN 'net/' THEN 'block' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM r
"""
