"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

An item becomes windows of `window` consecutive words (an item of fewer words is one window), equal windows are one.
Containing a window means containing all its shingles of `shingle` words, so one necessary token a window is enough:
its prefix, the shingle that is rarest in the documents (their counts come from a pass over all documents; ties by
hash). Each document position meets the windows whose prefix is its shingle in a broadcast hash join; length and
positional bounds say where the window would have to start, and the words are compared exactly there, all in the task
that reads the document. Only verified occurrences and a row for each document (its id, a hash and a count) are
shuffled, never a text or a context.

Bounds: shingles and windows are joined in blocks of at most about `block_bytes`, estimated from their own sizes; a
larger benchmark takes several passes over the documents with the same plan. Nothing is pasted into a plan, and no
size changes what is computed.

Defined cases. Null or empty text has no words and is clean; null items likewise. A row's document is (doc_id, text):
rows equal in both give one row of `find`, or one each with `each_row`. Empty benchmark: every document is clean. An
item repeated under several ids counts once for each id. Other columns, whatever their names, are ignored by `find` and
passed through by `remove`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, columns, named, quoted, staged, table

WINDOW, SHINGLE, BLOCK_BYTES, MAX_BROADCAST = 10, 3, 64 << 20, 2_000_000
NOT_WORD = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> str:
    t = f"coalesce({text}, '')"
    lowered = f"if(octet_length({t}) = length({t}), lower({t}), translate({t}, '{UPPER}', '{LOWER}'))"
    return f"filter(split({lowered}, '{NOT_WORD}'), x -> x != '')"


def _hash(words: str, at: str, k: int) -> str:
    """The k-word shingle at a position; k is hashed too, so that lengths don't meet."""
    return f"xxhash64({', '.join(f'get({words}, {at} + {j})' for j in range(k))}, {k})"


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: win (words), len, k (words a shingle), items (ids), shingles (offset, hash)."""
    w = benchmark.selectExpr("item_id", f"{_words('text')} as w").where("size(w) > 0")
    w = w.selectExpr("item_id", f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window})) as ws")
    w = w.selectExpr("item_id", "explode_outer(ws) as win").groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    w = w.selectExpr("*", "size(win) as len", f"least(size(win), {shingle}) as k")
    by_k = " ".join(f"when k = {k} then {_hash('win', 'o', k)}" for k in range(1, shingle + 1))
    return w.selectExpr("*", f"transform(sequence(0, len - k), o -> named_struct('o', o, 'h', case {by_k} end)) as shingles")


def _positions(docs: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """keep, w (words), n, and a row for each shingle of the lengths: i (its word), h; last a row with h null."""
    docs = docs.selectExpr(*keep, f"{_words('text')} as w")
    each = [f"if(size(w) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {k}), i -> {_hash('w', 'i', k)}))" for k in lengths]
    docs = docs.selectExpr(*keep, "w", "cast(size(w) as long) as n", f"array_append({f'concat({chr(44).join(each)})' if each else 'cast(array() as array<bigint>)'}, null) as hs")
    # The array is never empty; the outer form keeps the optimiser from testing that by computing it a second time.
    docs = docs.selectExpr(*keep, "w", "n", "posexplode_outer(hs) as (at, h)")
    before, place = "0", ""
    for k in lengths:
        place += f" when at < {before} + greatest(size(w) - {k - 1}, 0) then at - ({before})"
        before += f" + greatest(size(w) - {k - 1}, 0)"
    return docs.selectExpr(*keep, "w", "n", "h", f"case{place} end as i" if lengths else "0 as i")


def _blocks(df: DataFrame, size: str, key: str, block_bytes: int) -> list[DataFrame]:
    """df in parts of about block_bytes each, by a hash of key; at least one."""
    total = df.agg(F.sum(F.expr(size))).first()[0] or 0
    parts = max(-(-total // block_bytes), 1)
    return [df.where(f"pmod(xxhash64({key}), {parts}) = {p}") if parts > 1 else df for p in range(parts)]


def prefixes(docs: DataFrame, wins: DataFrame, lengths: list[int], block_bytes: int) -> DataFrame:
    """wins with the offset `o` and hash `h` of each window's rarest shingle."""
    each = wins.selectExpr("win", "explode(shingles) as s").selectExpr("win", "s.o as o", "s.h as h")
    wanted = each.select("h").distinct()
    counts = [_positions(docs, lengths).select("h").join(F.broadcast(b), "h").groupBy("h").agg(F.count("*").alias("df")) for b in _blocks(wanted, "32", "h", block_bytes)]
    rare = each.join(reduce(DataFrame.unionAll, counts), "h", "left")
    rare = rare.groupBy("win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "o")).alias("p"))
    return wins.drop("shingles").join(rare, "win").selectExpr("win", "len", "items", "p.h as h", "p.o as o")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int, with_rows: bool) -> DataFrame:
    """doc_id, key, n (words), start, len, items of each occurrence of a window in docs (doc_id, text, key); with_rows:
    also a row with start null for every document row."""
    wins = staged(windows(benchmark.select("item_id", "text"), window, shingle), "bench-windows")
    lengths = sorted((r["k"] for r in wins.select("k").distinct().collect()), reverse=True)  # at most `shingle` rows
    rare = staged(prefixes(docs, wins, lengths, block_bytes), "bench-prefixes")
    parts = []
    for block in _blocks(rare, "160 + 24 * len + octet_length(array_join(win, '')) + 8 * size(items)", "win", block_bytes):
        block = block.select("win", "len", "items", "o", F.col("h").alias("wh"))
        rows = _positions(docs, lengths, "doc_id", "key").join(F.broadcast(block), F.col("h") == F.col("wh"), "left")
        fits = "i >= o and i - o + len <= n and slice(w, i - o + 1, len) = win"
        row = "h is null" if with_rows and not parts else "false"
        rows = rows.where(f"{row} or (wh is not null and {fits})")
        parts.append(rows.selectExpr("doc_id", "key", "n", "case when wh is not null then i - o end as start", "len", "items"))
    return reduce(DataFrame.unionAll, parts)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, each_row: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Equal rows give one, or as many as they
    are with each_row."""
    found = occurrences(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), benchmark, window, shingle, block_bytes, True)
    per = found.groupBy("doc_id", "key", "n").agg(
        F.sort_array(F.collect_set(F.expr("case when start is not null then named_struct('s', start, 'e', start + len) end"))).alias("spans"),
        F.collect_set(F.expr("case when start is not null then items end")).alias("items"),
        F.count_if(F.col("start").isNull()).alias("copies"),
    )
    covered = "aggregate(spans, named_struct('end', 0, 'sum', 0), (a, v) -> named_struct('end', greatest(a.end, v.e), 'sum', a.sum + greatest(v.e - greatest(a.end, v.s), 0)), a -> cast(a.sum as long))"
    per = per.selectExpr("doc_id", "n as n_words", f"{covered} as n_hit", "array_distinct(flatten(items)) as items", "explode(array_repeat(0, cast(copies as int))) as __row" if each_row else "0 as __row")
    return per.selectExpr(
        "doc_id", "n_words", "n_hit", "cast(size(items) as long) as n_items",
        "sha2(array_join(array_sort(transform(items, x -> cast(x as string))), ','), 256) as items_sha256", "n_hit > 0 as contaminated",
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no window occurs, with docs' columns. The contaminated documents' ids and hashes are
    broadcast behind a count (up to MAX_BROADCAST rows of 16 bytes), else joined by shuffle."""
    d, h, key = named(docs, "__hit", "__hit_key", "__key")
    hits = occurrences(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), benchmark, window, shingle, block_bytes, False)
    hits = staged(hits.select(F.col("doc_id").alias(d), F.col("key").alias(h)).distinct(), "decontaminate-hits")
    small = hits.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    same = F.col("doc_id").eqNullSafe(F.col(quoted(d))) & (F.col(quoted(key)) == F.col(quoted(h)))
    return docs.withColumn(key, F.xxhash64("text")).join(F.broadcast(hits) if small else hits, same, "left_anti").select(*columns(docs))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), each_row=True)


_W = "list_filter(string_split_regex(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
with d as (select doc_id, {_W} as w from documents),
b as (select item_id, {_W} as w from benchmark),
bw as (select distinct item_id, w[i:i + {WINDOW} - 1] as g from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct len(g) as n from bw),
dw as (select doc_id, i, n, w[i:i + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select doc_id, i, n, item_id from dw join bw on dw.g = bw.g),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, i + unnest(range(0, n)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos on d.doc_id = pos.doc_id left join it on d.doc_id = it.doc_id
"""
QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLES = {"op10_benchmark_decontamination": ORACLE}
