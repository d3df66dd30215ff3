"""Preference formatting of chosen and rejected conversations. DataFrame functions only.

For each pair the longest common prefix of turns is found and rendered once as the prompt. The turns after it
are rendered as two completions, one of each side. Every rendered turn carries the span of its text that a
loss may see: the text of an assistant's turn in a completion; the prompt, headers and other roles are masked.

``format_pairs`` has one row a rendered turn, in the order (pair_id, part, turn, place); ``assemble`` makes one row a pair of them:
the prompt, both completions and the spans of their masks. A conversation that holds a third of all rows is not gathered in one row: it
comes in numbered pieces of ``PIECE`` turns, and a turn of very many rows in numbered parts.

Scale: a pair's first differing turn comes from two aggregations, by (pair, turn) and by pair, both combined before
their shuffles; no turn is compared with more than its counterpart and no text is shuffled for it but as a digest.
The result of both is written and joined to the turns, so AQE can split a hot pair.

Cases: turns are ordered by ``turn``, a null turn is the last. Rows that repeat a turn exactly count once; different
rows of one turn are kept, ordered by role and text, and compare as a set. A null role is ``unknown``, a null text
empty. A conversation without a partner has an empty other side: no prompt, one completion. A null conv_id belongs to no
pair and is left out. Two equal conversations are all prompt. A very long text is one turn like others. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import Scratch

LAST = (1 << 63) - 1
#: Turns of a row of ``assemble``.
PIECE = 1024
OPEN, CLOSE = "<|", "<|end|>\n"


def neighbours(turns: DataFrame) -> DataFrame:
    """The default pairs: conversations 2n (chosen) and 2n + 1 (rejected)."""
    return turns.where("conv_id IS NOT NULL").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text"
    )


def other_replies(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Pairs that share their turns: a conversation up to its last reply (chosen), and the same with the last reply of its neighbour (the
    conversation whose number differs in the last bit) in that place (rejected). The pair has the conversation's number. Conversations
    without a reply, or whose neighbour has none, make no pair; of several replies in one last turn the greatest text counts."""
    scratch = Scratch(turns.sparkSession, "replies")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    last = rows.where(F.col("role") == role).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("pair_id", "last.turn", "last.text")
    last = scratch.keep(last, "last")
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("text").alias("reply"))
    pairs = scratch.keep(last.select("pair_id", F.col("turn").alias("at")).join(other, "pair_id"), "pairs")
    shared = rows.join(pairs.select("pair_id", "at"), "pair_id").where("turn <= at")
    sides = F.when(F.col("turn") < F.col("at"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    shared = shared.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")
    return shared.union(pairs.select("pair_id", F.lit("rejected"), "at", F.lit(role), "reply"))


def pair_up(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The turns of given ``pairs`` (pair_id, chosen_id, rejected_id)."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    return turns.select("conv_id", "turn", "role", "text").join(sides.select("pair_id", "s.side", "s.conv_id"), "conv_id").select("pair_id", "side", "turn", "role", "text")


def format_pairs(sides: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``sides``: (pair_id, side, turn, role, text). One row a rendered turn: pair_id, part (prompt, chosen or rejected), turn,
    role, rendered, loss_start, loss_end (characters of ``rendered``; equal where all is masked)."""
    scratch = Scratch(sides.sparkSession, "preference")
    rows = sides.select(
        "pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = scratch.keep(rows, "rows")
    mark = F.sha2(F.concat_ws("\u0000", "role", "text"), 256)
    # number, least, greatest and exclusive or of 120 bits of the digests stand for a turn's set of rows; none of them overflows
    bits = [F.conv(F.substring("mark", at, 15), 16, 10).cast("long") for at in (1, 16)]
    of = [(F.count, F.col("mark")), (F.min, F.col("mark")), (F.max, F.col("mark")), *((F.bit_xor, b) for b in bits)]
    turn = rows.select("pair_id", "turn", "side", mark.alias("mark")).groupBy("pair_id", "turn").agg(
        F.count("*").alias("n"), *(f(F.when(F.col("side") == s, v)).alias(f"{s}{k}") for s in ("chosen", "rejected") for k, (f, v) in enumerate(of))
    )
    turn = scratch.keep(turn, "turns")
    same = F.lit(True)
    for k in range(len(of)):
        same = same & F.col(f"chosen{k}").eqNullSafe(F.col(f"rejected{k}"))
    first = turn.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("first"))
    first = scratch.keep(first, "first")
    out = rows.join(first, "pair_id").withColumn("common", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    out = out.where("NOT common OR side = 'chosen'")
    head = F.concat(F.lit(OPEN), "role", F.lit("|>\n"))
    trains = ~F.col("common") & (F.col("role") == trained_role)
    return out.select(
        "pair_id", F.when(F.col("common"), "prompt").otherwise(F.col("side")).alias("part"), "turn", "role",
        F.concat(head, "text", F.lit(CLOSE)).alias("rendered"),
        F.char_length(head).alias("loss_start"),
        (F.char_length(head) + F.when(trains, F.char_length("text") + len(CLOSE) - 1).otherwise(0)).alias("loss_end"),
    )


def assemble(formatted: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and for both completions the spans that a loss may see.

    A pair whose turns reach beyond ``piece`` comes in several rows, numbered by ``piece`` (turns divided by it), and a turn of more than ``piece``
    rows in parts, numbered by ``part``: in their order they are the whole pair, and no row has more than about ``piece`` squared turns.
    """
    scratch = Scratch(formatted.sparkSession, "pairs")
    named = formatted.withColumn("piece", F.expr(f"turn DIV {piece}"))
    large = named.groupBy("pair_id", "turn").agg(F.ceil(F.count("*") / piece).alias("parts")).where("parts > 1")
    large = scratch.keep(large.withColumnRenamed("turn", "_turn").withColumnRenamed("pair_id", "_pair"), "large")
    named = named.join(large, (F.col("pair_id") == F.col("_pair")) & (F.col("turn") == F.col("_turn")), "left")
    named = named.withColumn("dealt", F.coalesce(F.pmod(F.xxhash64("role", "rendered"), F.col("parts")) + 1, F.lit(0)).cast("long"))
    one = F.struct("turn", "role", "rendered", "loss_start", "loss_end")
    gathered = named.groupBy("pair_id", "piece", F.col("dealt").alias("_part")).agg(*(F.array_sort(F.collect_list(F.when(F.col("part") == p, one))).alias(p) for p in ("prompt", "chosen", "rejected")))
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "")

    def spans(p: str):
        zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, end: int>>)").alias("made"))

        def add(acc, x):
            span = F.struct((acc["at"] + x["loss_start"]).cast("int").alias("start"), (acc["at"] + x["loss_end"]).cast("int").alias("end"))
            return F.struct(
                (acc["at"] + F.char_length(x["rendered"])).cast("int").alias("at"),
                F.when(x["loss_end"] > x["loss_start"], F.concat(acc["made"], F.array(span))).otherwise(acc["made"]).alias("made"),
            )

        return F.aggregate(p, zero, add, lambda acc: acc["made"])

    return gathered.select("pair_id", "piece", F.col("_part").alias("part"), text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def formatted_pairs(turns: DataFrame) -> DataFrame:
    """The query's columns; spans as text, such as ``14-30,52-60``."""
    out = assemble(format_pairs(other_replies(turns)))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("pair_id", "piece", "part", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(CAST(turn AS BIGINT), 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
     l AS (SELECT conv_id, max(turn) AS tl FROM t WHERE role = 'assistant' GROUP BY conv_id),
     y AS (SELECT conv_id, tl, max(text) AS text FROM t JOIN l USING (conv_id) WHERE role = 'assistant' AND turn = tl GROUP BY conv_id, tl),
     p AS (SELECT a.conv_id AS pair_id, a.tl, b.text FROM y AS a JOIN y AS b ON b.conv_id = xor(CAST(a.conv_id AS BIGINT), CAST(1 AS BIGINT))),
     r AS (SELECT pair_id, 'chosen' AS side, turn, role, t.text FROM t JOIN p ON conv_id = pair_id WHERE turn <= tl
           UNION SELECT pair_id, 'rejected', turn, role, t.text FROM t JOIN p ON conv_id = pair_id WHERE turn < tl
           UNION SELECT pair_id, 'rejected', tl, 'assistant', text FROM p),
     s AS (SELECT pair_id, turn, coalesce(list_sort(list({'r': role, 't': text}) FILTER (WHERE side = 'chosen')), []) AS c,
           coalesce(list_sort(list({'r': role, 't': text}) FILTER (WHERE side = 'rejected')), []) AS d FROM r GROUP BY pair_id, turn),
     f AS (SELECT pair_id, min(CASE WHEN c IS DISTINCT FROM d THEN turn END) AS first FROM s GROUP BY pair_id),
     j AS (SELECT r.*, (first IS NULL OR turn < first) AS common FROM r JOIN f USING (pair_id)),
     k AS (SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE side END AS part, turn, role, length(role) + 5 AS head,
           CASE WHEN NOT common AND role = 'assistant' THEN length(text) + 7 ELSE 0 END AS trained,
           '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM j WHERE NOT common OR side = 'chosen'),
     w AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, turn // 1024, part ORDER BY turn, role, rendered) - length(rendered) AS before FROM k),
     x AS (SELECT *, CASE WHEN trained > 0 THEN CAST(CAST(before + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(before + head + trained AS BIGINT) AS VARCHAR) END AS span FROM w)
SELECT pair_id, CAST(turn // 1024 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS part,
       coalesce(string_agg(rendered, '' ORDER BY turn, role, rendered) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY turn, role, rendered) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY turn, role, rendered) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY turn, role, rendered) FILTER (WHERE part = 'chosen'), '') AS chosen_spans,
       coalesce(string_agg(span, ',' ORDER BY turn, role, rendered) FILTER (WHERE part = 'rejected'), '') AS rejected_spans
FROM x GROUP BY pair_id, turn // 1024
"""
