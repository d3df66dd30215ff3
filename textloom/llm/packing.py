"""Packing of tokenized documents into windows by minimum bin slack.

A document is its token ids and a closing id. Whole windows of ``capacity`` ids are cut off its front;
what remains (1 to ``capacity - 1`` ids) is one length of a multiset. Minimum bin slack fills window
after window from the multiset: the largest length opens a window, then a bitset subset-sum dynamic
program over the counted lengths (a set bit is a reachable sum) finds the sum closest to capacity, and
walking the bitsets back gives how often each length is used. The same filling is repeated while the
counts allow.

A filling within 1/128 of capacity is padded. Pieces of a filling with more slack are cut freely: they are laid
end to end and cut into whole windows, and at the end of a task what is left (less than a window) is dealt
into sequences whose lengths are powers of two, which need no padding.

Scale: one pass, no shuffle. Each task tokenizes its rows and packs their remainders in a pool of
bounded size (``pool`` pieces, each shorter than a window), so that memory does not follow the
partition. Hot sources or groups of copies make no difference: nothing is dealt by key. A task that is
run again writes the same rows, as sequence ids are made of the partition's number and a counter.

Cases: a null text is the empty text and a document of the closing id alone. Null or repeated doc_ids
are documents like others. Text is encoded with ``tiktoken`` from the rank file, which gives the ids of
``tokenizers`` and the JSON file several times faster (tests compare both); what it cannot encode
goes to ``tokenizers``.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import map_slices

CAPACITY = 1024
CLOSING_ID = 0
POOL = 16384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Byte-level BPE: ids as ``tokenizers`` gives them for ``json_file``."""

    def __init__(self, rank_file: str | None, json_file: str):
        self.json_file, self.plain = json_file, None
        self.fast = None
        if rank_file:
            import public_tokenizers
            import tiktoken

            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def exact(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.json_file)
        return self.plain.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None:
            return self.exact(text)
        try:
            return self.fast.encode(text, allowed_special="all")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a panic of the native code, such as a too deep regex, is no Exception
            return self.exact(text)


def fill(counts: list[int], capacity: int) -> dict[int, int]:
    """The counts of lengths that fill a window closest to capacity, the largest length among them.

    ``counts[n]`` pieces of length n are there. Equal slack: larger lengths are used first.
    """
    largest = next(n for n in range(min(capacity, len(counts) - 1), 0, -1) if counts[n])
    room = capacity - largest
    full = (1 << (room + 1)) - 1
    steps, reach = [], 1  # bit s: sum s can be reached
    for n in range(min(room, largest), 0, -1):
        many = min(counts[n] - (n == largest), room // n)
        if many <= 0:
            continue
        steps.append((n, many, reach))
        shift = 1
        while many > 0:  # powers of two: all counts from 0 to many
            take = min(shift, many)
            reach |= (reach << (n * take)) & full
            many -= take
            shift *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {largest: 1}
    for n, many, before in reversed(steps):  # backtracking: the fewest of each of the smallest lengths
        k = next(k for k in range(many + 1) if total >= k * n and before >> (total - k * n) & 1)
        if k:
            used[n] = used.get(n, 0) + k
            total -= k * n
    return used


class Pool:
    """Remainders that wait for a window, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 0
        self.counts = [0] * (capacity + 1)
        self.pieces: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> None:
        self.counts[piece[2]] += 1
        self.pieces[piece[2]].append(piece)
        self.size += 1

    def windows(self, down_to: int) -> Iterator[list[tuple]]:
        while self.size > down_to:
            used = fill(self.counts, self.capacity)
            for _ in range(min(self.counts[n] // k for n, k in used.items())):
                yield [self.pieces[n].pop() for n, k in used.items() for _ in range(k)]
                for n, k in used.items():
                    self.counts[n] -= k
                    self.size -= k
                if self.size <= down_to:
                    break


def pack_partition(frames: Iterator[pd.DataFrame], encode, number: int, capacity: int, closing_id: int, pool_size: int) -> Iterator[pd.DataFrame]:
    pool, rows, counter = Pool(capacity), [], 0
    rest: deque[tuple] = deque()
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def place(window: list[tuple]) -> None:
        nonlocal counter
        offset = 0
        for piece in window:
            rows.append((*piece[:5], (number << 40) | counter, offset))
            offset += piece[2]
        counter += 1

    def cut(room: int) -> None:
        """A sequence of ``room`` ids off the front of the rest."""
        taken = []
        while room:
            piece = rest.popleft()
            if piece[2] > room:
                head, tail = piece[5][:room], piece[5][room:]
                rest.appendleft((piece[0], piece[1] + room, len(tail), zlib.crc32(tail.tobytes()), piece[4], tail))
                piece = (piece[0], piece[1], room, zlib.crc32(head.tobytes()), piece[4], head)
            taken.append(piece)
            room -= piece[2]
        place(taken)

    def settle(window: list[tuple]) -> None:
        """Nearly full windows and powers of two stand; the pieces of others are cut freely."""
        total = sum(p[2] for p in window)
        if total >= capacity - capacity // 128 or total & (total - 1) == 0 and total >= capacity // 2:
            place(window)
            return
        rest.extend(window)
        while sum(p[2] for p in rest) >= capacity:
            cut(capacity)

    def out() -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=columns).astype({c: "int64" for c in columns[1:]}).astype({"doc_id": "Int64"})
        rows.clear()
        return frame

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
            ids = np.array([*encode(text or ""), closing_id], "<u4")
            for start in range(0, len(ids), capacity):
                part = ids[start : start + capacity]
                piece = (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), part)
                if len(part) == capacity:
                    place([piece])
                else:
                    pool.add(piece)
        if pool.size > pool_size:
            for window in pool.windows(pool_size // 2):
                settle(window)
        if rows:
            yield out()
    for window in pool.windows(0):
        settle(window)
    while rest:
        cut(1 << (sum(p[2] for p in rest).bit_length() - 1))
    if rows:
        yield out()


def pack(docs: DataFrame, json_file: str | None = None, rank_file: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, pool: int = POOL) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it lies in its document and its sequence.

    ``json_file``: a file of ``tokenizers``, on each executor; none: the public byte-level BPE there.
    ``rank_file``: the same vocabulary as ranks, for speed; taken with the default ``json_file``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, ranks = json_file, rank_file
        if file is None:
            import public_tokenizers

            file, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
        yield from pack_partition(frames, Encoder(ranks, file), TaskContext.get().partitionId(), capacity, closing_id, pool)

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)
