"""Quality rules with adaptive thresholds (DataFrame operations only).

Every document gets word and line measures in its own row, without a shuffle. Four integer rates (ten-thousandths) are
summed up per (lang, source) in a mergeable quantile sketch: counts of values rounded down to six significant bits, so
a quantile has a relative error below 1/32 however the rows are dealt, and sketches merge by adding counts.

Thresholds. A sketch's upper fence is  q90 + spread * (q90 - q50), its lower fence (mean word length only) the mirror
image with q10; documents that fail the base rules are in no sketch. A group's fence is averaged with that of its
language, and a language's with that of all documents, weighted by documents : `min_group`, so that small groups lean
on what is known more widely and nothing switches at a size. No metric has a fixed cutoff. What a single document may
show by chance is allowed on top, in occurrences: MARGIN of them (a repeated header isn't a rate), and for repeated
words SLACK, two hundredths of the words.

Defined cases. Null or empty text: no words, so base_failed. Null lang or source: a group of its own. Ties: a value on
a fence is kept. Repeated rows: each is judged by itself. Empty table: empty result. A group of which every document
fails the base rules has no fence. Other columns, whatever their names, are ignored by `judge` and passed through by
`keep`. Five-word windows are compared by 64-bit hash within one text. A group with many rows costs no hot task: its
sketch is a partial count; beyond `MAX_BROADCAST_GROUPS` groups the fences are joined by shuffle, where adaptive
execution splits a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, named, quoted, staged, table

SPACE = r"[\\x20\\x09-\\x0D]+"
METRICS = ("word_len", "symbols", "dup_lines", "repeats")
MARGIN = {"word_len": 30, "symbols": 5, "dup_lines": 3, "repeats": 20}
SLACK = {"word_len": 0, "symbols": 0, "dup_lines": 0, "repeats": 200}
SPREAD, MIN_GROUP, MAX_BROADCAST_GROUPS = 4, 50, 20_000


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _covered(h: str) -> str:
    """Words that lie in a five-word window found twice or more; h: the windows' hashes by position."""
    seen_twice = "filter(transform(s, (e, k) -> if((k > 0 and get(s, k - 1).x = e.x) or coalesce(get(s, k + 1).x = e.x, false), e.i, -1)), v -> v >= 0)"
    total = f"aggregate(sort_array({seen_twice}), named_struct('prev', -5, 'sum', 0), (a, v) -> named_struct('prev', v, 'sum', a.sum + least(5, v - a.prev)), a -> a.sum)"
    body = f"if(size(array_distinct({h})) = size({h}), 0, {_let(f'sort_array(transform({h}, (x, i) -> named_struct(' + chr(39) + 'x' + chr(39) + ', x, ' + chr(39) + 'i' + chr(39) + ', i)))', 's', total)})"
    return body


def measures(text: str) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long) of a text column."""
    t = f"coalesce({text}, '')"
    words = f"filter(split({t}, '{SPACE}'), x -> x != '')"
    windows = "transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)))"
    lines = f"filter(split({t}, '\\\\n'), x -> trim(both ' \\t\\n\\u000B\\f\\r' from x) != '')"
    of_words = (
        "named_struct('n', cast(size(w) as long), 'chars', cast(length(array_join(w, '')) as long), "
        f"'rep', cast(if(size(w) < 6, 0, {_let(windows, 'h', _covered('h'))}) as long))"
    )
    of_lines = "named_struct('n', cast(size(l) as long), 'dup', cast(size(l) - size(array_distinct(l)) as long))"
    w, ln = F.expr(_let(words, "w", of_words)), F.expr(_let(lines, "l", of_lines))
    return F.struct(w.alias("w"), ln.alias("l"), F.expr(f"cast(size(split({t}, '[#*$%&|<>]', -1)) - 1 as long)").alias("sym"))


def _parts(name: str, m: str) -> tuple[str, str]:
    """Occurrences and units of a metric, from the measures in column m."""
    return {"word_len": (f"{m}.w.chars", f"{m}.w.n"), "symbols": (f"{m}.sym", f"{m}.w.chars"), "dup_lines": (f"{m}.l.dup", f"{m}.l.n"), "repeats": (f"{m}.w.rep", f"{m}.w.n")}[name]


def _base_failed(m: str) -> str:
    return f"({m}.w.n < 10 or 100 * {m}.w.rep > 20 * {m}.w.n)"


#: The size of the bucket that v falls in (its six highest bits are kept).
WIDTH = "shiftleft(1L, greatest(length(bin({0})) - 6, 0))"


def sketches(measured: DataFrame, m: str) -> DataFrame:
    """lang, source, metric, b, n: how many documents of a group lie in the bucket that begins at b."""
    each = ", ".join(f"'{k}', (10000 * {num}) div greatest({den}, 1L)" for k in METRICS for num, den in [_parts(k, m)])
    rows = measured.where(f"not {_base_failed(m)}").selectExpr("lang", "source", f"stack({len(METRICS)}, {each}) as (metric, v)")
    return rows.groupBy("lang", "source", "metric", F.expr(f"v - v % {WIDTH.format('v')}").alias("b")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """keys, metric, total, hi, lo of the sketches merged by keys."""
    at = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
    over = f"over (partition by {', '.join([*keys, 'metric'])}"
    at = at.selectExpr("*", f"b + {WIDTH.format('b')} - 1 as top", f"sum(n) {over} order by b rows unbounded preceding) as upto", f"sum(n) {over}) as total")
    q = lambda p, side: F.min(F.expr(f"case when 100 * upto >= {p} * total then {side} end"))
    at = at.groupBy(*keys, "metric").agg(F.max("total").alias("total"), q(10, "b").alias("q10"), q(50, "b").alias("b50"), q(50, "top").alias("t50"), q(90, "top").alias("q90"))
    return at.selectExpr(*keys, "metric", "total", f"q90 + {spread} * (q90 - b50) as hi", f"greatest(q10 - {spread} * (t50 - q10), 0L) as lo")


def thresholds(sketch: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <metric>_hi, <metric>_lo): a row for each group."""
    group, language, all_ = (_fences(sketch, keys, spread) for keys in (["lang", "source"], ["lang"], []))
    mean = lambda total, own, wider: f"({total} * {own} + {min_group} * {wider}) div ({total} + {min_group})"
    language = language.join(F.broadcast(all_.select("metric", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))), "metric")  # four rows
    language = language.selectExpr("lang as lang1", "metric as metric1", f"{mean('total', 'hi', 'hi2')} as hi1", f"{mean('total', 'lo', 'lo2')} as lo1")
    rows = group.join(language, group["lang"].eqNullSafe(language["lang1"]) & (group["metric"] == language["metric1"]))
    rows = rows.selectExpr("lang", "source", "metric", f"{mean('total', 'hi', 'hi1')} as hi", f"{mean('total', 'lo', 'lo1')} as lo")
    return rows.groupBy("lang", "source").agg(*(F.max(F.expr(f"case when metric = '{k}' then {side} end")).alias(f"{k}_{side}") for k in METRICS for side in ("hi", "lo")))


def _verdicts(docs: DataFrame, with_text: bool, spread: int, min_group: int) -> tuple[DataFrame, str, str]:
    """docs with their measures (staged) and whether they are kept; the names of these columns. The fences are
    broadcast only if they have few rows, else joined by shuffle."""
    m, kept, lang, source, f = named(docs, "__m", "__kept", "__lang", "__source", "__f")
    measured = docs.withColumn(m, measures("text"))
    measured = staged(measured if with_text else measured.drop("text"), "quality-rows")
    fences = staged(thresholds(staged(sketches(measured, m), "quality-sketch"), spread, min_group), "quality-fences")
    small = fences.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    fences = fences.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*(c for c in fences.columns if c not in ("lang", "source"))).alias(f))
    joined = measured.join(F.broadcast(fences) if small else fences, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    bad = [_beyond(k, *_parts(k, m), f"{f}.{k}_hi") for k in METRICS] + [_below("word_len", *_parts("word_len", m), f"{f}.word_len_lo")]
    return joined.withColumn(kept, F.expr(f"not ({_base_failed(m)} or {' or '.join(bad)})")), m, kept


def _beyond(name: str, num: str, den: str, fence: str) -> str:
    """SQL: more occurrences than the fence and the margin allow (in doubles: no product overflows)."""
    return f"coalesce(1e4D * ({num} - {MARGIN[name]}) > cast({fence} + {SLACK[name]} as double) * {den}, false)"


def _below(name: str, num: str, den: str, fence: str) -> str:
    return f"coalesce(1e4D * ({num} + {MARGIN[name]}) < cast({fence} as double) * {den}, false)"


def judge(docs: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): measures, base_failed and kept."""
    rows, m, kept = _verdicts(docs.select("doc_id", "text", "lang", "source"), False, spread, min_group)
    return rows.selectExpr(
        "doc_id", f"{m}.w.n as n_words", f"{m}.w.chars as word_chars", f"{m}.sym as n_symbols", f"{m}.l.dup as n_dup_lines", f"{m}.w.rep as n_repeat_words", f"{_base_failed(m)} as base_failed", f"{kept} as kept"
    )


def keep(docs: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of docs that pass, with docs' columns."""
    rows, _, kept = _verdicts(docs, True, spread, min_group)
    return rows.where(F.col(quoted(kept))).select(*columns(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    trim = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    part = {"word_len": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    width = "(cast(1 as bigint) << greatest(length(bin({0})) - 6, 0))"
    quantile = lambda p, side: f"min(case when 100 * upto >= {p} * total then {side} end)"

    def level(k: int, keys: str) -> str:
        over = f"over (partition by {keys}metric"
        return (
            f"c{k} as (select {keys}metric, b, sum(n) as n from sketch group by {keys}metric, b),\n"
            f"u{k} as (select *, b + {width.format('b')} - 1 as top, sum(n) {over} order by b rows unbounded preceding) as upto, sum(n) {over}) as total from c{k}),\n"
            f"q{k} as (select {keys}metric, max(total) as total, {quantile(10, 'b')} as q10, {quantile(50, 'b')} as b50, {quantile(50, 'top')} as t50, {quantile(90, 'top')} as q90 from u{k} group by {keys}metric),\n"
            f"f{k} as (select *, q90 + {SPREAD} * (q90 - b50) as hi, greatest(q10 - {SPREAD} * (t50 - q10), 0) as lo from q{k})"
        )

    mean = lambda t, own, wider: f"({t}.total * {own} + {MIN_GROUP} * {wider}) // ({t}.total + {MIN_GROUP})"
    vals = " union all ".join(f"select lang, source, '{m}' as metric, 10000 * {num} // greatest({den}, 1) as v from f where not base_failed" for m, (num, den) in part.items())
    wide = ", ".join(f"max(case when metric = '{m}' then {side} end) as {m}_{side}" for m in METRICS for side in ("hi", "lo"))
    bad = " or ".join(
        [f"coalesce(cast(10000 as double) * ({num} - {MARGIN[m]}) > cast({m}_hi + {SLACK[m]} as double) * {den}, false)" for m, (num, den) in part.items()]
        + [f"coalesce(cast(10000 as double) * (word_chars + {MARGIN['word_len']}) < cast(word_len_lo as double) * n_words, false)"]
    )
    return rf"""
with t as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: {trim.format("x")} <> '') as l from t),
win as (select r, i, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
rep as (select r, g from win group by r, g having count(*) > 1),
hit as (select r, count(distinct p) as n from (select r, i + d as p from win join rep using (r, g), (select unnest(range(0, 5)) as d)) group by r),
m as (select w.r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(len(l) as bigint) as n_lines, cast(coalesce(hit.n, 0) as bigint) as n_repeat_words from w left join hit on w.r = hit.r),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
vals as ({vals}),
sketch as (select lang, source, metric, v - v % {width.format('v')} as b, count(*) as n from vals group by all),
{level(0, "lang, source, ")},
{level(1, "lang, ")},
{level(2, "")},
l as (select f1.lang, f1.metric, {mean("f1", "f1.hi", "f2.hi")} as hi, {mean("f1", "f1.lo", "f2.lo")} as lo from f1 join f2 using (metric)),
g as (select f0.lang, f0.source, f0.metric, {mean("f0", "f0.hi", "l.hi")} as hi, {mean("f0", "f0.lo", "l.lo")} as lo from f0 join l on f0.metric = l.metric and f0.lang is not distinct from l.lang),
fences as (select lang, source, {wide} from g group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or {bad}) as kept
from f left join fences on f.lang is not distinct from fences.lang and f.source is not distinct from fences.source
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": _oracle()}
