"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the word: text is lower-cased (A-Z) and cut into runs of digits, letters and
non-ASCII characters. A pattern is a window of ``window`` consecutive words of a benchmark item (an
item of fewer words is one pattern). Patterns of one length form a Wu-Manber table:

* a block is two words (one for patterns of one word); the *shift table* says how far the search
  may jump when a block ends at a position, so that positions where no pattern can end are skipped;
* where the shift is zero, the block is the suffix of some patterns: the *suffix-hash bucket*
  selects them;
* a direct comparison of all words confirms each of them.

Texts are laid end to end and searched in many lanes at once (numpy); every lane jumps by its own shift.

Scale: documents are never shuffled and each task holds one document and the tables. Tables are
broadcast; they are built from at most ``shard_bytes`` of benchmark text. A larger benchmark is
split by item id into shards of at most about that size, which rows pass through one after the
other in the same stage, so the broadcast per search stays bounded whatever the benchmark's size.

Cases: a null text has no words and an item without words no pattern. A null ``item_id`` is the
empty string. Equal ``item_id`` in several rows count once. Repeated documents are judged row by
row. Other columns of the documents are not read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm.common import append_columns

WINDOW = 10
SHARD_BYTES = 16_000_000
_TABLE_BITS = 18
_LANE = 128
_WORDS = 400_000
_PIECE = 1 << 20

#: Bytes to word characters: A-Z lowered, all that is no word character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Tables for patterns of one length, given as rows of word numbers (1 and up)."""

    def __init__(self, patterns: np.ndarray):
        self.m = m = patterns.shape[1]
        self.block = b = min(2, m)
        order = np.argsort(self._hash(patterns, m - 1), kind="stable")
        self.patterns, self.order = patterns[order], order
        suffix = self._hash(self.patterns, m - 1)
        size = 1 << _TABLE_BITS
        self.shift = np.full(size, m - b + 1, np.int32)
        for end in range(b - 1, m):
            np.minimum.at(self.shift, self._hash(patterns, end), m - 1 - end)
        self.first = np.searchsorted(suffix, np.arange(size), "left").astype(np.int32)
        self.many = (np.searchsorted(suffix, np.arange(size), "right") - self.first).astype(np.int32)

    def _hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._mix(rows[:, end - self.block + 1], rows[:, end])

    @staticmethod
    def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all occurrences in ``ids`` and the numbers of the patterns there."""
        n, m, b = len(ids), self.m, self.block
        none = np.empty(0, np.int64)
        if n < m:
            return none, none
        at = np.arange(m - 1, n, _LANE)  # each lane looks at the ends from here to before the next
        stop = np.minimum(at + _LANE, n)
        found = []
        while len(at):
            h = self._mix(ids[at - b + 1], ids[at])
            jump = self.shift[h]
            zero = jump == 0
            if zero.any():
                found.append((at[zero], h[zero]))
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return none, none
        ends, h = (np.concatenate(x) for x in zip(*found, strict=True))
        out_e, out_p = [], []
        for k in range(0, len(ends), 4096):  # bounded memory when much of a text is benchmark
            e, many = ends[k : k + 4096], self.many[h[k : k + 4096]]
            who = np.repeat(np.arange(len(e)), many)
            place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            pattern = self.first[h[k : k + 4096]][who] + place
            end = e[who]
            for j in range(m):  # the direct comparison, the earliest words first
                same = ids[end - m + 1 + j] == self.patterns[pattern, j]
                end, pattern = end[same], pattern[same]
            out_e.append(end)
            out_p.append(pattern)
        return np.concatenate(out_e), self.order[np.concatenate(out_p)]


class Matcher:
    """All patterns of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                m = min(window, len(ids))
                for i in range(len(ids) - m + 1):
                    by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
        self.tables = [(WuManber(np.array(list(p), np.int64)), [sorted(x) for x in p.values()]) for m, p in sorted(by_length.items())]

    def numbers(self, text: str | None) -> np.ndarray:
        """The text's words as numbers, 0 for words of no item. Read piece by piece: a very long
        text never stands in memory as a list of all its words."""
        get, out = self.vocabulary.get, []
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD)
        at = 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= _PIECE else raw.find(b" ", at + _PIECE)
            end = len(raw) if end < 0 else end
            out.append(np.array([get(w, 0) for w in raw[at:end].split()], np.int64))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def hits(self, texts: list[np.ndarray], hit: np.ndarray, items: list[set[str]]) -> None:
        """Marks the words inside occurrences and gathers the items of each text they come from.

        ``hit`` covers the texts laid end to end, one word apart (0, which is in no pattern), so that all lanes are busy.
        """
        zero = np.zeros(1, np.int64)
        ids = np.concatenate([part for t in texts for part in (t, zero)])
        edge = np.cumsum([len(t) + 1 for t in texts])
        for table, owners in self.tables:
            ends, patterns = table.search(ids)
            if len(ends):
                steps = np.zeros(len(ids) + 1, np.int64)
                starts = np.unique(ends) - table.m + 1
                steps[starts] += 1
                np.add.at(steps, starts + table.m, -1)
                hit |= np.cumsum(steps[:-1]) > 0
                pairs = np.unique(np.searchsorted(edge, ends, "right") * len(owners) + patterns)
                for text, p in zip((pairs // len(owners)).tolist(), (pairs % len(owners)).tolist(), strict=True):
                    items[text].update(owners[p])


def _shards(items: DataFrame, shard_bytes: int) -> list[DataFrame]:
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).head()[0]
    n = max(1, -(-size // shard_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` (any columns, with ``text``) plus ``n_words``, ``n_hit``, ``items`` (sorted item ids)
    and ``spans`` (starts and ends of the runs of hit words, counted in words from 0)."""
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns}
    names = []
    for c in ("n_words", "n_hit", "items", "spans"):
        while c in taken:
            c = f"{c}_"
        names.append(c)
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.LongType())]
    added = [T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]
    out = docs.withColumn("text", F.col("text").cast("string"))
    for k, shard in enumerate(_shards(items, shard_bytes)):
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in shard.collect()])  # at most about shard_bytes

        def start(shared=shared, again=k > 0, place=out.columns.index("text")):
            matcher = Matcher(shared.value, window)

            def mark(batch: pa.RecordBatch) -> list[list]:
                made: list[list] = [[], [], [], []]
                before = zip(*(batch.column(batch.num_columns - n).to_pylist() for n in (2, 1)), strict=True) if again else ((None, None),) * batch.num_rows
                texts: list[np.ndarray] = []
                known: list[tuple] = []

                def flush() -> None:
                    hit = np.zeros(sum(map(len, texts)) + len(texts), bool)
                    found = [set(items if again else ()) for items, _ in known]
                    at = 0
                    for ids, (_, spans) in zip(texts, known, strict=True) if again else ():
                        for a, b in zip(spans[::2], spans[1::2], strict=True):
                            hit[at + a : at + b] = True
                        at += len(ids) + 1
                    if texts:
                        matcher.hits(texts, hit, found)
                    at = 0
                    for ids, items in zip(texts, found, strict=True):
                        own = hit[at : at + len(ids)]
                        at += len(ids) + 1
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))) if own.any() else np.empty(0, np.int64)
                        for column, value in zip(made, (len(ids), int(own.sum()), sorted(items), edges.tolist()), strict=True):
                            column.append(value)
                    texts.clear()
                    known.clear()

                size = 0
                for text, one in zip(batch.column(place).to_pylist(), before, strict=True):
                    texts.append(matcher.numbers(text))
                    known.append(one)
                    size += len(texts[-1])
                    if size > _WORDS:
                        flush()
                        size = 0
                flush()
                return made

            return mark

        made = append_columns(out, [T.StructField(f"_shard_{n}", t) for n, t in zip(names, kinds, strict=True)] if k else added, start)
        out = made.select(*docs.columns, *(F.col(f"_shard_{n}").alias(n) for n in names)) if k else made
    return out


def digest(found: list[str]) -> str:
    return hashlib.sha256(",".join(found).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The digest columns: one row per document."""
    found = decontaminate(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, window, shard_bytes)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    found = decontaminate(docs, items)
    hit = found.columns[len(docs.columns) + 1]
    return found.where(F.col(hit) == 0).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT item, least(len(w), 10) AS m, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0),
     p AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM bw),
     ms AS (SELECT DISTINCT m FROM p),
     dw AS (SELECT rn, m, unnest(generate_series(1, len(w) - m + 1)) AS i, w FROM d, ms WHERE len(w) >= m),
     hits AS (SELECT rn, dw.i, dw.m, p.item FROM dw JOIN p ON p.m = dw.m AND p.t = array_to_string(dw.w[dw.i : dw.i + dw.m - 1], ' ')),
     hw AS (SELECT rn, count(DISTINCT k) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + m - 1)) AS k FROM hits) GROUP BY rn),
     hi AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rn, item FROM hits) GROUP BY rn)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rn) LEFT JOIN hi USING (rn)
"""
