"""Spelling variants by letter-parity bitmasks.

A word's mask has a bit for each letter (the 26 of a-z; a code point from U+00C0 on shares the bit of its last five
binary digits): set if the letter occurs an odd number of times. One inserted or deleted code point flips one bit, a
replaced one two bits or none. The bits are dealt in turn to three bands, the usual letters evenly, so two words one
edit apart agree in a band at least.

1. Words: every whole text is read in slices at word ends; tasks hold a bounded count of words and send partial counts.
2. Blocks: for each band, words of one value and of length L meet those of lengths L and L - 1. A block of more than
   `chunk` words is split by a hash of the word into tiles of two chunks; no pair is skipped.
3. Within a tile masks are compared as arrays: the parities of the other bands say which ranges can meet, at most two
   bits may differ, and the pair belongs to its first equal band, so it counts once. What is left is verified on the
   code points. A tile gives, for each word, how many near words it found and the best of them.
4. The best ones are combined (partial minima). A form has ten times its word's occurrences, so a chain has fewer than
   twenty links; roots are found by pointer jumping. At most some 120 words a code point are near a word, so no form has
   an unbounded number of direct variants.

Result: word, form, root, n, n_near, form_n. Defined cases. Null or empty text: no words. A null doc_id deletes no code
point. Repeated rows count each time, rows that repeat a doc_id too. Ties of n: the form smallest in code-point order.
Empty table: no rows. Other columns are ignored. Very long runs are words; a tile holds `TILE_BYTES` of code points at
most (or two words)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, new_folder, staged, staged_in, table

MIN_LENGTH, MIN_COUNT, RATIO, DELETE, CHUNK, TILE_BYTES = 7, 2, 10, 31, 32_768, 64 << 20
HELD, SLICE, PAIRS = 200_000, 1 << 20, 1 << 16  # pairs are compared in parts that fit a processor's cache
BANDS, LETTERS = 3, "etaoinshrdlcumwfgypbvkjxqz"  # the letters as they are dealt to the bands
_OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")


def _bits() -> np.ndarray:
    """Code point below 256 -> its bit."""
    at = np.zeros(256, np.uint64)
    for c in [*map(ord, LETTERS), *range(0xC0, 0x100)]:
        at[c] = LETTERS.index(chr(c)) if c < 128 else 26 + (c & 31)
    return np.where(at >= 0, np.uint64(1) << at, np.uint64(0))


BIT = _bits()
BAND = [np.uint64(sum(1 << j for j in range(b, 58, BANDS))) for b in range(BANDS)]


def runs(text: str | None, least: int = MIN_LENGTH) -> Iterator[list[str]]:
    """The lower-cased letter runs of at least `least` code points, slice by slice."""
    text, lo = text or "", 0
    wanted = re.compile("[a-zÀ-ÿ]{%d,}" % least)
    while lo < len(text):
        end = _OUTSIDE.search(text, lo + SLICE)
        hi = end.start() if end else len(text)
        part = text[lo:hi].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone
        yield wanted.findall(part)
        lo = hi


def spelt(doc_id: int | None, run: str, prefix: int, delete: int = DELETE) -> str:
    """The run as it counts; prefix: crc32 of the doc_id and a colon."""
    h = zlib.crc32(run.encode(), prefix)
    if doc_id is None or h % delete:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def words(docs: DataFrame, least: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for part in runs(text, least):
                    for run, n in Counter(part).items():
                        word = spelt(doc_id, run, prefix)
                        if len(word) >= least:
                            held[word] += n
                    if len(held) >= HELD:
                        yield rows()
        if held:
            yield rows()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def masks(batch: list[str]) -> np.ndarray:
    """The masks of some words (not empty, code points below 256)."""
    codes = np.frombuffer("".join(batch).encode("latin-1"), np.uint8)
    starts = np.cumsum([0, *map(len, batch[:-1])])
    return np.bitwise_xor.reduceat(BIT[codes], starts) if len(batch) else np.zeros(0, np.uint64)


def _masked(found: DataFrame) -> DataFrame:
    """word, n, size, mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            more = [pa.array(list(map(len, names)), pa.int32()), pa.array(masks(names).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=["word", "n", "size", "mask"])

    return found.select("word", "n").mapInArrow(run, "word string, n long, size int, mask long")


def tiles(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """band, value, size, c, d (the tile) and word, n, length, mask, side (the word's chunk): each word in the blocks of
    its own length and of the next, in every tile of its chunk."""
    masked = _masked(found)
    values = ", ".join(f"named_struct('band', {b}, 'value', mask & {int(BAND[b])}L, 'size', size + {k})" for b in range(BANDS) for k in (0, 1))
    rows = masked.selectExpr("word", "n", "size as length", "mask", f"explode(array({values})) as e").selectExpr("word", "n", "length", "mask", "e.*")
    sizes = rows.groupBy("band", "value", "size").agg(F.count("*").alias("k"))
    room = F.greatest(F.least(F.lit(chunk), F.floor(F.lit(TILE_BYTES) / F.col("size"))), F.lit(1))
    large = staged(sizes.where(F.col("k") > room).select("band", "value", "size", F.ceil(F.col("k") / room).cast("int").alias("parts")), "spelling-large")
    # At most 6 * words / chunk rows, and one for each block of very long words.
    small = large.limit(200_001).count() <= 200_000
    rows = rows.join(F.broadcast(large) if small else large, ["band", "value", "size"], "left")
    rows = rows.withColumn("side", F.expr("cast(pmod(xxhash64(word), coalesce(parts, 1)) as int)"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
    return rows.select("band", "value", "size", F.least("side", "o").alias("c"), F.greatest("side", "o").alias("d"), "word", "n", "length", "mask", "side")


def _codes(names: list[str], size: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(names).encode("latin-1"), np.uint8).reshape(len(names), size)


def _verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y differ by one edit; y's words are as long as x's, or shorter by one."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    width = y.shape[1]
    left, right = x[:, :width] != y, x[:, 1:][:, ::-1] != y[:, ::-1]
    first = lambda m: np.where(m.any(1), m.argmax(1), width)
    return first(left) + first(right) >= width


def near_pairs(band: int, size: int, cross: bool, names: list[str], length: np.ndarray, mask: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of near words of a tile whose first equal band is `band`, each once: of length `size` both, or j's
    shorter by one. With cross words of one side don't meet: they do in a tile of their own."""
    others = [BAND[k] for k in range(BANDS) if k != band]
    parity = sum((np.bitwise_count(mask & m).astype(np.int64) & 1) << k for k, m in enumerate(others))
    group = {(s, p): np.flatnonzero((length == s) & (parity == p)) for s in (size, size - 1) for p in range(4)}
    codes = {s: _codes([names[i] for i in np.flatnonzero(length == s)], s) for s in (size, size - 1)}
    place = np.zeros(len(names), np.int64)
    for s in (size, size - 1):
        at = np.flatnonzero(length == s)
        place[at] = np.arange(len(at))
    before = BAND[:band]
    for p in range(4):
        rows = group[size, p]
        # Same length: none or both of the other parities change. One letter less: one of them does.
        for s, q in ((size, p), (size, p ^ 3), (size - 1, p ^ 1), (size - 1, p ^ 2)):
            cols = group[s, q]
            if not len(rows) or not len(cols) or (s == size and q < p):
                continue
            step, found, held = max(PAIRS // len(cols), 1), [], 0
            for lo in range(0, len(rows), step):
                differ = (mask[rows[lo : lo + step]][:, None] ^ mask[cols][None, :]).ravel()
                at = np.flatnonzero(np.bitwise_count(differ) <= 2)
                differ = differ[at]
                for m in before:
                    keep = (differ & m) != 0
                    at, differ = at[keep], differ[keep]
                found.append(at + lo * len(cols))
                held += len(at)
                if held >= PAIRS or lo + step >= len(rows):
                    i, j = np.divmod(np.concatenate(found), len(cols))
                    if s == size and q == p:
                        keep = i < j
                        i, j = i[keep], j[keep]
                    i, j = rows[i], cols[j]
                    if cross:
                        keep = side[i] != side[j]
                        i, j = i[keep], j[keep]
                    right = _verified(codes[size][place[i]], codes[s][place[j]])
                    yield i[right], j[right]
                    found, held = [], 0


def _best(names: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, best near word) by place, from pairs."""
    word, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.empty(len(names), np.int64)
    order[sorted(range(len(names)), key=lambda k: (-n[k], names[k]))] = np.arange(len(names))
    at = np.lexsort((order[other], word))
    word, other = word[at], other[at]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    return word[first], np.diff(np.append(first, len(word))), other[first]


def near(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, best (n, word of the near word of largest n) of found (word, n); no row for words alone."""
    key = ["band", "value", "size", "c", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            if t.num_rows < 2:
                return
            names, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            band, size, c, d = (t.column(k)[0].as_py() for k in ("band", "size", "c", "d"))
            arrays = (t.column("length").to_numpy(), t.column("mask").to_numpy().view(np.uint64), t.column("side").to_numpy())
            pairs = list(near_pairs(band, size, c != d, names, *arrays))
            if any(len(x) for x, _ in pairs):
                word, k, best = _best(names, n, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
                cols = [pa.array([names[x] for x in word], pa.string()), pa.array(k, pa.int64()), pa.array(n[best]), pa.array([names[x] for x in best], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "k", "best_n", "best"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in range(len(key))]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1
            if rest and any(rest[-1].column(c)[0].as_py() != x[0] for c, x in enumerate(cols)):
                yield from done(rest)
                rest = []
            cuts = [0, *new.tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                rest.append(b.slice(lo, hi - lo))
                if hi < b.num_rows:
                    yield from done(rest)
                    rest = []
        if rest:
            yield from done(rest)

    dealt = tiles(found, chunk).repartition(*key).sortWithinPartitions(*key)
    rows = dealt.mapInArrow(run, "word string, k long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word")))
    return rows.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).selectExpr("word", "n_near", "-b.m as best_n", "b.word as best")


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which holds words with a form alone; by pointer jumping."""
    spark, last = forms.sparkSession, new_folder(forms.sparkSession, "spelling-roots")
    at = staged_in(forms.select("word", F.col("form").alias("root")), last)
    while True:
        up, path = at.select(F.col("word").alias("root"), F.col("root").alias("up")), new_folder(spark, "spelling-roots")
        new = staged_in(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), path)
        discard(spark, last)
        at, last = new.select("word", "root"), path
        if not new.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, least: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n of docs (doc_id, text)."""
    found = staged(words(docs, least, min_count), "spelling-words")
    rows = found.join(near(found, chunk), "word", "left").withColumn("has", F.expr(f"coalesce(best_n >= {ratio} * n, false)"))
    rows = rows.selectExpr("word", "n", "coalesce(n_near, 0) as n_near", "if(has, best, null) as form", "if(has, best_n, null) as form_n")
    rows = staged(rows, "spelling-forms")
    roots = _rooted(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 by its table, byte by byte. Near words by deletion: words of one length that are equal without the code point at
#: one place, and words that are another without a code point.
ORACLE = rf"""
with recursive crc as materialized (select list(c order by i) as t from (select i,
    list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(0, 256)) as i))),
r as (select doc_id, run, count(*) as k from (select doc_id,
    unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{{MIN_LENGTH},}}')) as run from documents) group by all),
b as (select doc_id, run, k, hex(encode(doc_id || ':' || run)) as x from r),
h as (select run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))),
    lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]))) as h from b, crc),
s as (select case when h % {DELETE} = 0 then left(run, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else run end as word, k from h),
w as materialized (select word, cast(sum(k) as bigint) as n from s where length(word) >= {MIN_LENGTH} group by word having sum(k) >= {MIN_COUNT}),
d as materialized (select word, n, i, left(word, i) || substr(word, i + 2) as g from (select word, n, unnest(range(0, length(word))) as i from w)),
e as (select distinct d.word as a, d.n as an, w.word as b, w.n as bn from d join w on d.g = w.word),
p as materialized (select x.word as a, y.word as b, y.n from d x join d y on x.g = y.g and x.i = y.i and x.word <> y.word
  union all select a, b, bn from e union all select b, a, an from e),
f as materialized (select word, w.n, count(b) as n_near, max(p.n) as top, min((-p.n, b)) as best from w left join p on p.a = w.word group by word, w.n),
o as materialized (select word, n, n_near, case when top >= {RATIO} * n then best[2] end as form, case when top >= {RATIO} * n then top end as form_n from f),
c as (select word, form as up, 1 as depth from o where form is not null union all select c.word, o.form, depth + 1 from c join o on o.word = c.up where o.form is not null),
z as (select word, arg_max(up, depth) as root from c group by word)
select o.word, form, coalesce(root, o.word) as root, n, n_near, form_n from o left join z on z.word = o.word
"""
QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": ORACLE}
