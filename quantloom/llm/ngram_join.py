"""N-gram Jaccard join over prefix trees.

A document's set holds its distinct shingles of `width` words (A-Z lower-cased; fewer words: the whole sequence), as
64-bit hashes. Equal sets are one node, so copies cost nothing further. Two nodes link when
100 * intersection >= percent * union.

1. Elimination. A node of n shingles whose partner must share all but p - 1 of them, p = n - ceil(percent * n / 100)
   + 1, needs at least s - p + 1 of any s of its shingles in some other node. For s the shingles with a hash divisible
   by `every(percent)` are taken (small sets: all), so that partners look at the same shingles. Tasks first settle which of them
   they hold for several nodes and send one row for each shingle, however often they have it; nodes below their need
   can't link and go no further.
2. Order. For the nodes left, shingles are ordered by how many of these nodes have them (exact counts), then by hash. A
   linked pair shares a shingle within the first p of each (the prefix). Each such shingle joins its nodes, in runs of
   compatible sizes, to the run's first; the components of these edges are blocks, and all links lie within blocks.
3. Trees. A block's sets are stored in a compressed trie, most frequent shingle first, and each set traverses it:
   sets with a common beginning share its partial overlap, and a subtree is left when its sizes don't fit or when the
   overlap so far plus what can remain on either side is too little. Links found join a union-find; a block gives back
   a spanning forest. A block of more than `max_block` nodes is split by shingle, and a shingle's nodes into tiles of
   two chunks, so that no task holds more than a tile; no pair is skipped. Every link is counted where it is found; a
   pair of several tiles counts in that of its least common prefix shingle.
4. The components of the forests are the result.

Result: doc_id, n_shingles, component_id (least doc_id reachable, itself included), n_links (other rows with a doc_id
whose sets link with the row's, equal ones included). Defined cases. Null, empty or blank text: 0 shingles, no links, its
own component. Null doc_id: no component, n_links null. Rows that repeat a doc_id are one vertex, each with its own
n_shingles and n_links. Empty table: no rows. Other columns are ignored by `join` and passed through by `keep_one`, which
groups rows by their sets alone: two texts under one doc_id are two documents, and a null doc_id is like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, named, quoted, staged, table
from .components import components

WIDTH, PERCENT, SMALL, MAX_BLOCK, CHUNK = 3, 90, 200, 2048, 1024
_FLUSH = 1 << 19
MAX_BROADCAST = 200_000  # rows of 32 bytes
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_HASHES[w] for w in words], np.uint64)
    k = min(width, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):  # order matters: each step mixes before the next word comes in
        x = (x ^ h[j : len(h) - k + 1 + j]) * _M[j % 5]
        x ^= x >> np.uint64(32)
    return np.unique(x * _M[1] ^ (x >> np.uint64(29)))


def fingerprint(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def _key(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "little", signed=True) or 1


def every(percent: int) -> int:
    """Shingles with a hash divisible by this are looked at: enough that a need is most of them."""
    return max(1, 40 // max(100 - percent, 1))


def _posted(s: np.ndarray, percent: int) -> np.ndarray:
    """The shingles looked at in the elimination. A set that a set of up to SMALL may link with posts all of its own."""
    return s if len(s) * percent <= SMALL * 100 else s[s % np.uint64(every(percent)) == 0]


def _need(s: np.ndarray, percent: int) -> int:
    n = len(s)
    looked_at = n if n <= SMALL else int((s % np.uint64(every(percent)) == 0).sum())
    return looked_at - (n - least_shared(n, percent))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that no more texts than these are Python strings at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def nodes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th, fp, key, n, need of docs (doc_id, text); th: a hash of the text, fp is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps, keys, ns, needs = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                fp = fingerprint(s) if len(s) else None
                fps.append(fp)
                keys.append(_key(fp) if fp else None)
                ns.append(len(s))
                needs.append(_need(s, percent))
            plain = [pa.array(x, pa.int64()) for x in (keys, ns, needs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.binary()), *plain], names=["doc_id", "th", "fp", "key", "n", "need"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp binary, key long, n long, need long")


def _shared_here(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens, keys sorted and distinct -> (begins of the groups, sizes, each row's group's size)."""
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(tokens)))
    return first, sizes, np.repeat(sizes, sizes)


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    k, c = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(k, pa.int64()), pa.array(c.astype(np.int64))], names=["token", "key", "n"])


def _postings(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (token, key, 0) for a node alone with a shingle in its task, (token, 0, 0) for several, (key, key, n) for n
    shingles that a node shares within the task."""

    def settled(tokens: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, k = np.concatenate(tokens), np.concatenate(keys)
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        fresh = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        t, k = t[fresh], k[fresh]
        first, sizes, size = _shared_here(t, k)
        out_t, out_k = t[first], np.where(sizes > 1, 0, k[first])
        for lo in range(0, len(out_t), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(out_t[part].view(np.int64)), pa.array(out_k[part]), pa.array(np.zeros(len(out_t[part]), np.int64))], names=["token", "key", "n"])
        yield _counted(k[size > 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, held = [], [], 0
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                s = shingles(text, width)
                if len(s):
                    p = _posted(s, percent)
                    tokens.append(p)
                    keys.append(np.full(len(p), _key(fingerprint(s)), np.int64))
                    held += len(p)
                    if held >= _FLUSH:
                        yield from settled(tokens, keys)
                        tokens, keys, held = [], [], 0
        if tokens:
            yield from settled(tokens, keys)

    return docs.select("text").mapInArrow(run, "token long, key long, n long")


def _shared_counts(postings: DataFrame) -> DataFrame:
    """(key, shared): how many of its posted shingles a node shares with others, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_t, rest_k = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flagged(t: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            fresh = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (k[1:] == 0)) if len(t) else np.zeros(0, bool)
            t, k = t[fresh], k[fresh]
            *_, size = _shared_here(t, k)
            # A row of several nodes (key 0) counts as two: whoever else has the shingle shares it.
            return _counted(k[(size > 1) & (k != 0)])

        for b in batches:
            t, k, n = (c.to_numpy() for c in b.columns)
            if (n > 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(x[n > 0]) for x in (t, k, n)], names=["token", "key", "n"])
            t, k = np.concatenate([rest_t, t[n == 0]]), np.concatenate([rest_k, k[n == 0]])
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1], "left"))  # the last group may go on in the next batch
            rest_t, rest_k = t[cut:], k[cut:]
            if cut:
                yield flagged(t[:cut], k[:cut])
        if len(rest_t):
            yield flagged(rest_t, rest_k)

    dealt = postings.repartition("token").sortWithinPartitions("token", "key")
    return dealt.mapInArrow(run, "token long, key long, n long").groupBy("key").agg(F.sum("n").alias("shared"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, key, n, tokens, copies of docs (doc_id, text, fp, copies) whose text gives fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            rows = []
            for d, t, fp, copies in zip(*(c.to_pylist() for c in part.columns), strict=True):
                s = shingles(t, width)
                if fingerprint(s) == fp:
                    rows.append((d, _key(fp), len(s), s.view(np.int64), copies))
            if rows:
                cols = list(zip(*rows, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cols[2]]), pa.int32()), pa.array(np.concatenate(cols[3])))
                plain = [pa.array(cols[k], pa.int64()) for k in (0, 1, 2, 4)]
                yield pa.RecordBatch.from_arrays([*plain[:3], lists, plain[3]], names=["node", "key", "n", "tokens", "copies"])

    return docs.mapInArrow(run, "node long, key long, n long, tokens array<long>, copies long").dropDuplicates(["node", "key"])


class Trie:
    """Compressed trie of sorted sequences, as arrays in preorder."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray) -> None:
        """seqs: in lexicographic order. sizes: the full sizes of their sets."""
        self.seqs, self.sizes = seqs, sizes
        shared = [0]
        for x, y in zip(seqs, seqs[1:], strict=False):
            m = min(len(x), len(y))
            d = np.flatnonzero(x[:m] != y[:m])
            shared.append(int(d[0]) if len(d) else m)
        self.begin, self.end, self.parent, self.lo, self.hi, self.sets = [0], [0], [-1], [0], [0], [[]]
        stack = [0]
        for i, s in enumerate(seqs):
            keep = shared[i]
            while self.end[stack[-1]] > keep:
                top = stack[-1]
                if self.begin[top] >= keep:
                    self.hi[top] = i
                    stack.pop()
                else:  # the new set leaves the path inside this node: split it
                    self._split(top, keep)
                    stack[-1:] = [top]
                    self.hi[self._below] = i
            if len(s) > self.end[stack[-1]]:
                self._node(self.end[stack[-1]], len(s), stack[-1], i)
                stack.append(len(self.begin) - 1)
            self.sets[stack[-1]].append(i)
        for top in stack:
            self.hi[top] = len(seqs)
        order = sorted(range(len(self.begin)), key=lambda v: (self.lo[v], self.begin[v], self.end[v]))
        at = {v: k for k, v in enumerate(order)}
        for name in ("begin", "end", "lo", "hi", "sets"):
            setattr(self, name, [getattr(self, name)[v] for v in order])
        self.parent = [at.get(self.parent[v], -1) for v in order]
        self.skip = [0] * len(order)
        ends: list[int] = []
        for v in range(len(order)):
            while ends and self.hi[ends[-1]] <= self.lo[v] and self.parent[v] != ends[-1]:
                self.skip[ends.pop()] = v
            ends.append(v)
        for v in ends:
            self.skip[v] = len(order)
        lengths = np.array([len(s) for s in seqs] or [0])
        span = [slice(a, b) if b > a else slice(0, 1) for a, b in zip(self.lo, self.hi, strict=True)]
        self.least = [int(sizes[x].min()) if len(sizes) else 0 for x in span]
        self.most = [int(sizes[x].max()) if len(sizes) else 0 for x in span]
        self.longest = [int(lengths[x].max()) for x in span]
        self.part = [seqs[self.lo[v]][self.begin[v] : self.end[v]] if self.end[v] else np.zeros(0, np.int64) for v in range(len(order))]

    def _node(self, begin: int, end: int, parent: int, lo: int) -> None:
        for name, x in (("begin", begin), ("end", end), ("parent", parent), ("lo", lo), ("hi", lo), ("sets", [])):
            getattr(self, name).append(x)

    def _split(self, v: int, at: int) -> None:
        """Cut node v at depth `at`: v keeps the upper part, a new node gets the rest, v's sets and v's children."""
        below = self._below = len(self.begin)
        self._node(at, self.end[v], v, self.lo[v])
        self.sets[below], self.sets[v] = self.sets[v], []
        for c in range(below):
            if self.parent[c] == v:
                self.parent[c] = below
        self.end[v] = at

    def matches(self, i: int, mask: np.ndarray, percent: int) -> Iterator[int]:
        """Sets after the i-th that link with it. mask: a zeroed bool array over the vocabulary, zero again after."""
        q, n = self.seqs[i], int(self.sizes[i])
        mask[q] = True
        overlap, v, nodes_ = [0] * len(self.begin), 0, len(self.begin)
        while v < nodes_:
            low, high = self.least[v], self.most[v]
            if self.hi[v] <= i + 1 or 100 * high < percent * n or percent * low > 100 * n:
                v = self.skip[v]
                continue
            o = overlap[self.parent[v]] if v else 0
            part = self.part[v]
            if len(part):
                o += int(np.count_nonzero(mask[part]))
                left = len(q) - int(np.searchsorted(q, part[-1], "right"))
                if (100 + percent) * (o + min(left, self.longest[v] - self.end[v])) < percent * (n + low):
                    v = self.skip[v]
                    continue
            overlap[v] = o
            for j in self.sets[v]:
                if j > i and 100 * o >= percent * (n + int(self.sizes[j]) - o):
                    yield j
            v += 1
        mask[q] = False


def block_links(members: list[tuple], percent: int = PERCENT, partners: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among members (node, n, tokens, side, ...). Pairs of one side are looked at only if
    all members are of that side. With partners (a zero for each member; members go on with copies, below) every link
    adds each end's copies to the other's place, unless both ends have a shingle in their `below`: such a pair is met
    again in the tile of that shingle and counts there."""
    tokens = np.concatenate([m[2] for m in members])
    vocabulary, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, -counts))] = np.arange(len(vocabulary))
    several = (counts > 1)[at]
    ends = np.cumsum([len(m[2]) for m in members])
    seqs = [np.sort(rank[at[a:b][several[a:b]]]) for a, b in zip(ends - [len(m[2]) for m in members], ends, strict=True)]
    order = sorted(range(len(members)), key=lambda i: seqs[i].astype(">u4").tobytes())
    trie = Trie([seqs[i] for i in order], np.array([members[i][1] for i in order]))
    sides = [members[i][3] for i in order]
    cross, mask, root, links = len(set(sides)) > 1, np.zeros(len(vocabulary), bool), list(range(len(order))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(order)):
        x = members[order[i]]
        for j in trie.matches(i, mask, percent):
            if cross and sides[i] == sides[j]:
                continue
            y = members[order[j]]
            if partners is not None and x[5].isdisjoint(y[5]):
                partners[order[i]] += y[4]
                partners[order[j]] += x[4]
            if (a := find(i)) != (b := find(j)):
                root[a] = b
                links.append((x[0], y[0]))
    return links


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, key, links) of rows (block, node, key, n, tokens, side, copies, below), each block in one task: links
    (a, b) of a spanning forest, and for nodes (a, key) how many rows of other sets they link with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, keys = None, [], []

        def done() -> pa.RecordBatch:
            partners = [0] * len(members)
            links = block_links(members, percent, partners) if len(members) > 1 else []
            some = [i for i, k in enumerate(partners) if k]
            none = [None] * len(links)
            cols = [
                [x[0] for x in links] + [members[i][0] for i in some],
                [x[1] for x in links] + [None] * len(some),
                none + [keys[i] for i in some],
                none + [partners[i] for i in some],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "key", "links"])

        for batch in batches:
            lists = batch.column(4)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            plain = (batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7))
            for r, (name, node, key, n, side, copies, below) in enumerate(zip(*plain, strict=True)):
                if name != block:
                    if members:
                        yield done()
                    block, members, keys = name, [], []
                members.append((node, n, values[ends[r] : ends[r + 1]].copy(), side, copies, frozenset(below or ())))
                keys.append(key)
        if members:
            yield done()

    dealt = rows.select("block", "node", "key", "n", "tokens", "side", "copies", "below").repartition("block")
    return dealt.sortWithinPartitions("block", "node", "key", "side").mapInArrow(run, "a long, b long, key long, links long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, key, n): the prefix shingles that several nodes have."""
    each = sets.select("node", "key", "n", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(counts, "token").groupBy("node", "key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    wanted = f"n - (({percent} * n + 99) div 100) + 1 - (n - size(s))"  # the prefix's length less the shingles nobody shares
    return shared.withColumn("w", F.expr(wanted)).where("w > 0").selectExpr("node", "key", "n", "explode(slice(s, 1, cast(w as int))) as e").selectExpr("e.token as token", "node", "key", "n")


def _runs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(token, head, lo, hi, a): within a task's rows of a shingle, runs of compatible sizes. A row with a: node a and
    the run's first; a row without: the run and the sizes it spans. So a shingle that many nodes share sends one row a
    task, not one a node."""

    def settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, node, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        new = np.append(True, (token[1:] != token[:-1]) | (percent * n[1:] > 100 * n[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(n)) - 1
        head = node[first][np.cumsum(new) - 1]
        other = np.flatnonzero(node != head)
        cols = [np.concatenate([token[first], token[other]]), np.concatenate([node[first], head[other]]), np.concatenate([n[first], n[other]]), np.concatenate([n[last], n[other]])]
        a = pa.array(np.concatenate([first * 0, node[other]]), pa.int64(), mask=np.arange(len(first) + len(other)) < len(first))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), a], names=["token", "head", "lo", "hi", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            parts.append(tuple(c.to_numpy() for c in b.columns))
            held += b.num_rows
            if held >= _FLUSH:
                yield settled(parts)
                parts, held = [], 0
        if held:
            yield settled(parts)

    return prefixes.select("token", "node", "n").mapInArrow(run, "token long, head long, lo long, hi long, a long")


def _edges(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes with the first of their run of compatible sizes, for each prefix shingle: within tasks first, then
    between the tasks' runs, which are one where the sizes they span meet or are compatible."""
    runs = staged(_runs(prefixes, percent), "ngram-runs")
    w = Window.partitionBy("token").orderBy("lo", "hi", "head")
    heads = runs.where("a is null").withColumn("before", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    heads = heads.withColumn("first", F.expr(f"case when before is null or {percent} * lo > 100 * before then head end"))
    heads = heads.withColumn("first", F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.where("a is not null").select("a", F.col("head").alias("b")).unionAll(heads.where("head <> first").select(F.col("head").alias("a"), F.col("first").alias("b")))
    return found.distinct()


def _blocks(prefixes: DataFrame, sets: DataFrame, labels: DataFrame, max_block: int, chunk: int) -> DataFrame:
    """(block, node, key, side, below): a block for each component, or for each tile of a shingle of a too large one.
    below: the node's lesser prefix shingles, by which a pair that several tiles hold is counted in one only."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > max_block).select("label")
    small = labels.join(large, "label", "left_anti").join(sets.select("node", "key"), "node")
    small = small.select(F.concat(F.lit("c"), F.col("label")).alias("block"), "node", "key", F.lit(0).alias("side"), F.lit(None).cast("array<long>").alias("below"))
    rows = prefixes.join(labels.join(large, "label", "left_semi"), "node")
    rows = rows.withColumn("all", F.collect_list("token").over(Window.partitionBy("node", "key")))  # no more than a prefix
    rows = rows.select("token", "node", "key", "n", F.expr("filter(all, x -> x < token)").alias("below"))
    w = Window.partitionBy("token").orderBy("n", "node", "key")
    rows = rows.withColumn("c", ((F.row_number().over(w) - 1) / chunk).cast("int")).withColumn("last", F.max("c").over(Window.partitionBy("token")))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("last"))))
    name = F.concat_ws(":", F.lit("t"), "token", F.least("c", "d"), F.greatest("c", "d"))
    return small.unionAll(rows.select(name.alias("block"), "node", "key", F.col("c").alias("side"), "below"))


def _linked(docs: DataFrame, all_: DataFrame, reps: DataFrame, width: int, percent: int, max_block: int, chunk: int, by_text: bool) -> tuple[DataFrame, DataFrame]:
    """(links, sets) among the sets of reps (fp, key, n, need, rep, th, copies): links as _verified has them, sets with
    rep, key and node. A set's node is its rep, or with by_text a number of its own."""
    shared = _shared_counts(_postings(docs if by_text else docs.where("doc_id is not null"), width, percent))
    alive = reps.join(shared, "key", "left").where("need <= 0 or coalesce(shared, 0) >= need").selectExpr("rep as doc_id", "th", "fp", "copies")
    alive = staged(alive, "ngram-alive")
    few = alive.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # then texts needn't be shuffled
    side = (F.broadcast(alive) if few else alive).withColumnsRenamed({"doc_id": "rep", "th": "rep_th"})
    same = docs.doc_id.eqNullSafe(side.rep) & (F.xxhash64(docs.text) == side.rep_th)
    sets = _sets(docs.join(side, same).select("doc_id", "text", "fp", "copies"), width).withColumn("rep", F.col("node"))
    if by_text:
        sets = sets.withColumn("node", F.monotonically_increasing_id())
    sets = staged(sets, "ngram-sets")  # node numbers are fixed from here on
    prefixes = staged(_prefixes(sets, percent), "ngram-prefixes")
    blocks = _blocks(prefixes, sets, components(_edges(prefixes, percent)), max_block, chunk)
    return staged(_verified(blocks.join(sets, ["node", "key"]), percent), "ngram-links"), sets


def labelled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, max_block: int = MAX_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, label, links of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = staged(nodes(docs, width, percent), "ngram-nodes")
    reps = all_.where("doc_id is not null and n > 0").groupBy("fp", "key", "n", "need")
    reps = reps.agg(F.min(F.struct("doc_id", "th")).alias("r"), F.count("*").alias("copies")).selectExpr("fp", "key", "n", "need", "r.doc_id as rep", "r.th as th", "copies")
    found, _ = _linked(docs, all_, reps, width, percent, max_block, chunk, False)
    links = found.where("b is not null").select("a", "b")
    others = found.where("b is null").groupBy(F.col("a").alias("rep"), "key").agg(F.sum("links").alias("others"))
    # Rows of one doc_id are one vertex, so a node that stands for copies links to the doc_ids that share its set.
    reps = reps.join(others, ["rep", "key"], "left").selectExpr("fp", "rep", "copies - 1 + coalesce(others, 0) as links")
    reps = staged(reps, "ngram-reps")
    of = all_.where("doc_id is not null and n > 0").join(reps.select("fp", "rep"), "fp").select("doc_id", "rep").where("doc_id <> rep").distinct()
    repeated = all_.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.countDistinct("fp").alias("k")).where("k > 1").select("doc_id")
    odd = of.join(repeated, "doc_id", "left_semi")  # such rows tie several sets together
    found = components(links.unionAll(odd.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    rows = all_.join(reps, "fp", "left").withColumn("__v", F.coalesce("rep", "doc_id"))
    rows = rows.join(found, F.col("__v") == F.col("node"), "left")
    named_ = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "n", F.when(named_, F.coalesce("label", "__v")).alias("label"), F.when(named_, F.coalesce("links", F.lit(0))).alias("links"))


def surplus(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, th): the rows of docs (doc_id, text) that are not the first of their group, a group being the rows whose
    sets are equal or linked. The first: least doc_id (null last), then least hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = staged(nodes(docs, width, percent), "ngram-nodes").where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    reps = all_.groupBy("fp", "key", "n", "need").agg(F.min(place).alias("r"), F.count("*").alias("copies"))
    reps = staged(reps.selectExpr("fp", "key", "n", "need", "r.doc_id as rep", "r.th as th", "copies"), "ngram-reps")
    found, sets = _linked(docs, all_, reps, width, percent, MAX_BLOCK, CHUNK, True)
    label = sets.select("rep", "key", "node").join(components(found.where("b is not null").select("a", "b")), "node").withColumnsRenamed({"rep": "of", "key": "of_key"})
    one = reps.join(label, reps.rep.eqNullSafe(label.of) & (reps.key == label.of_key), "left").select("fp", "label", F.struct(F.col("rep").isNull().alias("last"), F.col("rep").alias("doc_id"), "th").alias("r"))
    best = one.where("label is not null").groupBy("label").agg(F.min("r").alias("best"))
    one = one.join(best, "label", "left").select("fp", F.coalesce("best", "r").alias("first"))
    rows = all_.join(one, "fp").where("not (doc_id <=> first.doc_id and th = first.th)")
    return rows.select("doc_id", "th").distinct()


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, max_block: int = MAX_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links."""
    found = labelled(docs, width, percent, max_block, chunk)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of rows whose sets are equal or linked, with docs' columns: that of the least doc_id (null
    last), then of the least text hash; of rows equal in both, the one with the least hash of its other columns. Rows
    without words stay."""
    d, h, key = named(docs, "__drop", "__drop_hash", "__text_hash")
    drop = staged(surplus(docs, width, percent).select(F.col("doc_id").alias(d), F.col("th").alias(h)), "ngram-surplus")
    docs_ = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(quoted(d))) & (F.col(quoted(key)) == F.col(quoted(h)))
    kept = docs_.join(drop, same, "left_anti")
    equal = docs_.where(r"text rlike '[^\\x20\\x09-\\x0D]'").groupBy(F.col("doc_id").cast("long").alias(d), F.col(quoted(key)).alias(h)).agg(F.count("*").alias("k")).where("k > 1").select(d, h)
    equal = staged(equal, "ngram-repeated")
    if not equal.limit(1).count():
        return kept.select(*columns(docs))
    rest = [f.name for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]
    many = kept.join(equal, same, "left_semi").groupBy(F.col("doc_id").alias("__g"), F.col(quoted(key)).alias("__k"))
    one = many.agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*(F.col(quoted(c)) for c in rest))).alias("__row")).select("__row.*")  # partial minima: no hot task
    return kept.join(equal, same, "left_anti").select(*columns(docs)).unionAll(one)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
with t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as materialized (select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id < y.doc_id join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))),
both_ as materialized (select a, b from e union all select b, a from e),
r as (with recursive reach(a, b) as (select a, b from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a) select * from reach)
select t.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(t.doc_id, coalesce(min(r.b), t.doc_id)) as component_id, coalesce(k.k, 0) as n_links
from t left join n on t.doc_id = n.doc_id left join r on r.a = t.doc_id left join (select a, count(*) as k from both_ group by a) k on k.a = t.doc_id
group by t.doc_id, n.n, k.k
"""
QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES = {"op6_ngram_join": ORACLE}
