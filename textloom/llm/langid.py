"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments of ``SEGMENT`` bytes, forward and backward, gives every
byte a probability of each language from both states there, and a document's probabilities are the mean over all
its bytes. It is written and trained in numpy: backpropagation through time over whole segments, Adam.

Training uses a bounded sample, ``SAMPLE_DOCS`` documents a language and ``WINDOWS`` windows each, drawn by hash
from the labelled documents that are not held out; every language that occurs is learned. Two passes of the driver's query do it: counts by language, then the sample, whose expected size
does not follow the input. All texts are predicted whole, in blocks of segments of bounded size.

Scale: prediction is a projection without shuffle; the model is a few thousand numbers in the closure.

Cases: text null, empty or without a letter: ``und``, score 0. A null lang teaches nothing. No usable
labelled document at all: every text is ``und``. Equal probabilities: the first language in sorted order.
A null doc_id is never held out and never learned from. Repeated rows are predicted one by one. Other columns
are not read by ``predict`` (whose columns get a ``_`` where the names are taken); a very long text is read whole, in blocks of segments,
and an empty table gives an empty result. ``lang``, ``source`` and ``doc_id`` are no input of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from textloom.llm.common import append_columns

SEGMENT = 64
HIDDEN = 8
SAMPLE_DOCS = 1500
WINDOWS = 2
STEPS = 220
BATCH = 128
PAD = 256
_BLOCK = 1024


class Network:
    """Weights by name; gates z, r, n lie side by side. The padding symbol holds z at 1, so states pass it unchanged."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        random = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        k = len(langs)
        self.w = {
            "x": (random.standard_normal((2, 257, 3 * hidden)) * 0.3).astype(np.float32),
            "u": (random.standard_normal((2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "v": (random.standard_normal((2, hidden, k)) / np.sqrt(hidden)).astype(np.float32),
            "c": np.zeros(k, np.float32),
        }
        self._pad()

    def _pad(self) -> None:
        self.w["x"][:, PAD] = 0
        self.w["x"][:, PAD, : self.hidden] = 40

    def states(self, s: np.ndarray, keep: bool = False):
        """``s``: (segments, length) symbols. States (length, 2, segments, hidden); the backward ones lie in reading order of the text."""
        w, h_ = self.w, self.hidden
        n, length = s.shape
        h = np.zeros((2, n, h_), np.float32)
        out = np.empty((length, 2, n, h_), np.float32)
        kept = []
        for t in range(length):
            a = np.stack([w["x"][0][s[:, t]], w["x"][1][s[:, length - 1 - t]]])
            g = h @ w["u"]
            zr = a[..., : 2 * h_] + g[..., : 2 * h_]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :h_], zr[..., h_:]
            m = r * g[..., 2 * h_ :]
            m += a[..., 2 * h_ :]
            np.tanh(m, out=m)
            if keep:
                kept.append((h, z, r, m, g[..., 2 * h_ :]))
            h = m + z * (h - m)
            out[t, 0], out[length - 1 - t, 1] = h[0], h[1]
        return (out, kept) if keep else out

    def probabilities(self, out: np.ndarray) -> np.ndarray:
        """(length, segments, languages) at every position."""
        y = out[:, 0] @ self.w["v"][0] + out[:, 1] @ self.w["v"][1] + self.w["c"]
        y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        return y

    def gradient(self, s: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradient, through time."""
        w, h_ = self.w, self.hidden
        n, length = s.shape
        out, kept = self.states(s, keep=True)
        p = self.probabilities(out)
        real = (s.T != PAD).astype(np.float32)
        total = max(float(real.sum()), 1.0)
        loss = float(-(np.log(p[:, np.arange(n), label] + 1e-9) * real).sum() / total)
        dy = p
        dy[:, np.arange(n), label] -= 1
        dy *= real[..., None] / total
        g = {name: np.zeros_like(x) for name, x in w.items()}
        g["c"] = dy.sum((0, 1))
        dh_out = np.empty_like(out)
        for d in range(2):
            g["v"][d] = np.tensordot(out[:, d], dy, ((0, 1), (0, 1)))
            dh_out[:, d] = dy @ w["v"][d].T
        dh = np.zeros((2, n, h_), np.float32)
        ut = w["u"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            dh[0] += dh_out[t, 0]
            dh[1] += dh_out[length - 1 - t, 1]
            h, z, r, m, gn = kept[t]
            da = np.empty((2, n, 3 * h_), np.float32)
            da[..., :h_] = dh * (h - m) * z * (1 - z)
            dm = dh * (1 - z) * (1 - m * m)
            da[..., h_ : 2 * h_] = dm * gn * r * (1 - r)
            da[..., 2 * h_ :] = dm
            dg = da.copy()
            dg[..., 2 * h_ :] *= r
            g["u"] += h.transpose(0, 2, 1) @ dg
            for d, at in ((0, t), (1, length - 1 - t)):
                np.add.at(g["x"][d], s[:, at], da[d])
            dh = dh * z + dg @ ut
        g["x"][:, PAD] = 0
        return loss, g

    def fit(self, s: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 2) -> list[float]:
        random, losses = np.random.default_rng(seed), []
        mean, square = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = random.integers(0, len(s), min(batch, len(s)))
            loss, g = self.gradient(s[pick], label[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x *= min(1.0, 1.0 / (norm + 1e-9))
                mean[k] += 0.1 * (x - mean[k])
                square[k] += 0.01 * (x * x - square[k])
                self.w[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            self._pad()
        return losses

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Pooled probabilities of each text, (texts, languages); zero where there is no byte."""
        sums, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        rows, owner, size = [], [], 0

        def flush() -> None:
            nonlocal rows, owner, size
            if rows:
                s, who = np.concatenate(rows), np.repeat(owner, [len(r) for r in rows])
                p = self.probabilities(self.states(s)) * (s.T != PAD)[..., None]
                np.add.at(sums, who, p.sum(0, dtype=np.float64))
                rows, owner, size = [], [], 0

        for i, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            count[i] = max(len(raw), 1)
            for k in range(0, len(raw), SEGMENT * _BLOCK):
                part = segments(raw[k : k + SEGMENT * _BLOCK])
                rows.append(part)
                owner.append(i)
                size += len(part)
                if size >= _BLOCK:
                    flush()
        flush()
        return sums / count[:, None]


def segments(raw: np.ndarray) -> np.ndarray:
    """Rows of ``SEGMENT`` symbols, the last padded."""
    out = np.full(-(-len(raw) // SEGMENT) * SEGMENT, PAD, np.int16)
    out[: len(raw)] = raw
    return out.reshape(-1, SEGMENT)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS, steps: int = STEPS) -> Network | None:
    """The network, or none if no labelled document may be learned from."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    part = F.create_map(*(F.lit(v) for row in counts for v in (row["lang"], min(1.0, 1.25 * sample_docs / row["count"]))))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))
    # doc_ids that repeat may be drawn more often than expected: a limit for each language, which keeps k rows of each task before the shuffle
    width = SEGMENT
    place = [F.lit(1) + F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.lit(1), F.char_length("text") - width)).cast("int") for k in range(windows)]
    drawn = chosen.select("lang", "doc_id", F.xxhash64("text").alias("hash"), F.array(*(F.substr("text", at, F.lit(width)) for at in place)).alias("parts"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "hash")
    rows = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * sample_docs).select("lang", "parts").collect()
    langs = sorted(r["lang"] for r in counts)
    number = {x: k for k, x in enumerate(langs)}
    s, label = [], []
    for lang, parts in sorted((r["lang"], tuple(r["parts"])) for r in rows):
        for p in parts:
            if any(c.isalpha() for c in p):
                s.append(segments(np.frombuffer(p.encode("utf-8", "replace")[:width], np.uint8))[0])
                label.append(number[lang])
    if not s:
        return None
    s, label = np.array(s), np.array(label)
    by = [np.flatnonzero(label == k) for k in range(len(langs))]
    most = max(map(len, by))
    even = np.concatenate([np.resize(b, most) for b in by if len(b)])  # languages count alike
    network = Network(langs)
    network.fit(s[even], label[even], steps)
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    names = []
    for c in ("lang_pred", "score"):
        while c in {x.lower() for x in docs.columns}:
            c = f"{c}_"
        names.append(c)
    if network is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})

    def start():
        def label(batch: pa.RecordBatch) -> list[list]:
            p = network.documents(batch.column(place).to_pylist())
            best = p.argmax(1)
            return [np.array(network.langs, object)[best].tolist(), np.clip(p[np.arange(len(p)), best], 0, 1).tolist()]

        return label

    place = docs.columns.index("text")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    made = append_columns(docs.withColumn("text", F.col("text").cast("string")), [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], start)
    return made.withColumns({names[0]: F.when(letter, F.col(names[0])).otherwise(F.lit("und")), names[1]: F.when(letter, F.col(names[1])).otherwise(F.lit(0.0))})


def languages(docs: DataFrame) -> DataFrame:
    """The digest columns."""
    network = train(docs)
    out = predict(docs.select("doc_id", "text"), network)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Clean prose scores far above this; below it no language has most of a text's bytes.
KEEP_SCORE = 0.4


def keep_identified(docs: DataFrame, least: float = KEEP_SCORE) -> DataFrame:
    """The documents whose language the network can tell; columns as they were."""
    out = predict(docs, train(docs))
    lang, score = out.columns[-2:]
    return out.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)
