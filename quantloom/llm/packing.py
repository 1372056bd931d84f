"""Packing by minimum bin slack.

Each task packs its own rows, so nothing is shuffled or collected. A document's ids are cut into full sequences and a
rest; rests wait in a window of at most `window` documents. A sequence is begun with the longest rest, and a subset
sum over the waiting lengths (a bitset in one big integer, counts split into powers of two) finds the multiset that
fills it closest to the limit; backtracking gives the counts, and the pattern is used as often as the counts allow.
Where no multiset fills a sequence, the next rest is cut to fill it. The last rests of a task, fewer ids than a
sequence, are cut into sequences whose lengths are powers of two, which need no padding.

Defined cases. Null or empty text: the end id alone. Ties: rests of one length go in reading order. Repeated rows and
null doc_ids are packed like any other. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Encoder

LIMIT, WINDOW, END = 1024, 4096, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(sum, {length: count}) of the multiset within counts whose sum is the largest up to room."""
    reach, mask, steps, goal = 1, (1 << (room + 1)) - 1, [], 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach & goal:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach & goal:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return best, used


class Packer:
    """Takes documents, gives pieces (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, limit: int, window: int, first_id: int) -> None:
        self.limit, self.window, self.next = limit, window, first_id
        self.rests: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        self.waiting = 0

    def put(self, rest: tuple, front: bool = False) -> None:
        n = len(rest[2])
        (self.rests.setdefault(n, deque()).appendleft if front else self.rests.setdefault(n, deque()).append)(rest)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.waiting += 1

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.waiting -= 1
        if not self.counts[n]:
            del self.counts[n]
            rest = self.rests.pop(n).popleft()
        else:
            rest = self.rests[n].popleft()
        return rest

    def sequence(self, rests: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in rests:
            yield doc, start, ids, total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, full = len(ids), len(ids) // self.limit * self.limit
        for s in range(0, full, self.limit):
            yield from self.sequence([(doc, s, ids[s : s + self.limit], n)])
        if full < n:
            self.put((doc, full, ids[full:].copy(), n))
            if self.waiting >= self.window:
                yield from self.drain(self.window // 2)

    def drain(self, leave: int) -> Iterator[tuple]:
        while self.waiting > leave:
            longest = max(self.counts)
            self.counts[longest] -= 1  # the seed
            got, used = fill({k: c for k, c in self.counts.items() if c}, self.limit - longest)
            self.counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            slack = self.limit - longest - got
            times = 1 if slack else min(self.counts[k] // c for k, c in used.items())
            for _ in range(times):
                taken = [self.take(k) for k, c in sorted(used.items(), reverse=True) for _ in range(c)]
                if slack and self.waiting:
                    doc, start, ids, total = self.take(min(k for k in self.counts if k > slack))
                    taken.append((doc, start, ids[:slack], total))
                    self.put((doc, start + slack, ids[slack:], total), front=True)
                elif slack:  # the last ids of the task
                    yield from self.powers(taken)
                    continue
                yield from self.sequence(taken)

    def powers(self, rests: list[tuple]) -> Iterator[tuple]:
        left, todo = sum(len(r[2]) for r in rests), deque(rests)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            part = []
            while room:
                doc, start, ids, total = todo.popleft()
                part.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    todo.appendleft((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self.sequence(part)
            left -= size


def pack(docs: DataFrame, limit: int = LIMIT, window: int = WINDOW, end: int | None = END, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text); with_ids adds each piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = Encoder.of(vocabulary), Packer(limit, window, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").data) for x in cols[2]]
            arrays = [pa.array(x, pa.int64()) for x in (cols[0], cols[1], list(map(len, cols[2])), crc, cols[3], cols[4], cols[5])]
            names = SCHEMA.replace(" long", "").split(", ")
            if with_ids:
                arrays.append(pa.array([x.view(np.int32) for x in cols[2]], pa.list_(pa.int32())))
                names.append("ids")
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, ends = encoder.batch(part.column(1).to_pylist(), end)
                start = 0
                for doc, e in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    out.extend(packer.add(doc, ids[start:e]))
                    start = e
                if len(out) > 2000:
                    yield flush()
        out.extend(packer.drain(0))
        encoder.rest()
        yield flush()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
