"""License scan: fuzzy search for short notices.

A text becomes its words (A-Z lower-cased) joined by single blanks. A notice of L characters may have k = `edits(L)` edits
(inserted, deleted or replaced characters, blanks included). It is cut into k + 1 pieces; where at most k edits were made
one piece is left whole, so one pass of an Aho-Corasick automaton over the text finds a seed of every match. Around a
seed the only window that can hold the match is verified by the regex library's bounded-error matching, which gives the
best span that begins and ends at a word's ends and its edits. Of matches of one notice that overlap, the one with the
fewest edits stays (then the first). The base phrases are exact patterns of the same automaton.

`scan` gives doc_id, n_words and places: label, base (an exact base phrase), edits, allowed (k), word (its first word, from
0), words (how many), text. The query derives from them doc_id, n_words, n_base, first_word, last_word, base_labels, labels
and score, the largest 1 - edits / (k + 1) of a place (0 without one; 1 for an exact one).

Cost is a pass over the text, and a window of at most L + 2 k characters a seed; windows that come again are looked up.
Defined cases. Null or empty text: no words, no places. Rows that repeat a doc_id are scanned one by one. Whole texts, any
length. Empty table: no rows. Other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# The base phrases of the contract, and short forms of well-known licence notices.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2"),
    ("boost", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("epl", "eclipse public license"),
    ("gpl", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "mozilla public license"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]
PER_EDIT, MOST_EDITS, MAX_MEMO = 12, 4, 100_000
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLACE = "label string, base boolean, edits int, allowed int, word long, words long, text string"


def edits(length: int) -> int:
    return min(max(length // PER_EDIT, 1), MOST_EDITS)


def normalised(text: str | None) -> str:
    """A blank, then each word and a blank; no words: empty."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone
    inner = _NOT_WORD.sub(" ", lowered).strip(" ")
    return f" {inner} " if inner else ""


def pieces(notice: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece) of a notice in about equal parts."""
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """The automaton and the verifying patterns of some base phrases and notices."""

    def __init__(self, base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> None:
        import ahocorasick
        import regex

        self.base, self.notices, self.memo = base, notices, {}
        seeds: dict[str, list[tuple[int, int]]] = {f" {phrase} ": [(-1 - i, 0)] for i, (_, phrase) in enumerate(base)}
        self.allowed = [edits(len(n)) for _, n in notices]
        for i, (_, notice) in enumerate(notices):
            for offset, piece in pieces(notice, self.allowed[i] + 1):
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, at in seeds.items():
            self.automaton.add_word(seed, (len(seed), at))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n)}){{e<={k}}}(?= )") for (_, n), k in zip(notices, self.allowed, strict=True)]

    def verify(self, i: int, window: str) -> tuple[int, int, int] | None:
        """(begin, end, edits) of notice i's best match in a window."""
        key = (i, window)
        if key not in self.memo:
            if len(self.memo) >= MAX_MEMO:
                self.memo.clear()
            m = self.patterns[i].search(window)
            self.memo[key] = m and (*m.span(), sum(m.fuzzy_counts))
        return self.memo[key]

    def places(self, norm: str) -> list[tuple[str, bool, int, int, int, int]]:
        """(label, base, edits, allowed, begin, end) in the normalised text, sorted by begin."""
        out, found = [], {}
        for last, (length, at) in self.automaton.iter(norm):
            for i, offset in at:
                if i < 0:
                    out.append((self.base[-1 - i][0], True, 0, 0, last - length + 2, last))
                    continue
                start, k = last - length + 1 - offset, self.allowed[i]
                lo, hi = max(start - k - 1, 0), start + len(self.notices[i][1]) + k + 1
                if m := self.verify(i, norm[lo:hi]):
                    found.setdefault(i, set()).add((m[2], lo + m[0], lo + m[1]))
        for i, some in found.items():
            ends: dict[int, int] = {}  # taken spans by slices of the notice's length: a span meets its neighbours' only
            width = len(self.notices[i][1]) + self.allowed[i]
            for e, a, b in sorted(some):
                slot = a // width
                if all(not (s in ends and ends[s] // (1 << 32) < b and a < ends[s] % (1 << 32)) for s in (slot - 1, slot, slot + 1)):
                    ends[slot] = a * (1 << 32) + b
                    out.append((self.notices[i][0], False, e, self.allowed[i], a, b))
        return sorted(out, key=lambda x: (x[4], x[5], x[0], x[1]))


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, places of docs (doc_id, text)."""
    kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    place = pa.struct([(f.split()[0], kind) for f, kind in zip(PLACE.split(", "), kinds, strict=True)])
    names = [f.name for f in place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b, counts, found = whole.slice(lo, 256), [], []
                for text in b.column(1).to_pylist():
                    norm = normalised(text)
                    rows = scanner.places(norm) if norm else []
                    blanks = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32) == 32) if rows else ()
                    at = lambda p: int(np.searchsorted(blanks, p)) - 1  # noqa: B023, E731  word that begins at a place
                    counts.append(max(norm.count(" ") - 1, 0))
                    found.append([dict(zip(names, (*r[:4], at(r[4]), at(r[5]) - at(r[4]) + 1, norm[r[4] : r[5]]), strict=True)) for r in rows])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], names=["doc_id", "n_words", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_words long, places array<struct<{PLACE.replace(' ', ':').replace(',:', ', ')}>>")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from a scan."""
    joined = "array_join(array_sort(array_distinct(transform({}, p -> p.label))), ',')"
    found = found.withColumn("b", F.expr("filter(places, p -> p.base)"))
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(b) as long) as n_base",
        "array_min(b.word) as first_word",
        "array_max(b.word) as last_word",
        f"{joined.format('b')} as base_labels",
        f"{joined.format('places')} as labels",
        "coalesce(array_max(transform(places, p -> 1 - p.edits / (p.allowed + 1))), cast(0 as double)) as score",
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Every span of whole words of about a notice's length against it by edit distance; code points beyond ASCII, which no
#: notice has, are one byte, as DuckDB's levenshtein counts bytes.
ORACLE = rf"""
with n(label, notice, size, k) as (values {_values([(label, x, len(x), edits(len(x))) for label, x in NOTICES])}),
b(label, phrase) as (values {_values(BASE)}),
d as materialized (select row_number() over () as r, doc_id,
  regexp_replace(translate(coalesce(text, ''), '~{UPPER}', ' {LOWER}'), '[^\x00-\x7F]', '~', 'g') as x from documents),
t as materialized (select r, doc_id, list_filter(string_split_regex(x, '[\x00-\x2F\x3A-\x60\x7B-\x7D\x7F]+'), lambda x: x <> '') as w from d),
bp as (select r, i - 1 as word, label from (select r, w, label, phrase, len(string_split(phrase, ' ')) as m, unnest(range(1, len(w) - len(string_split(phrase, ' ')) + 2)) as i from t, b)
  where array_to_string(w[i:i + m - 1], ' ') = phrase),
bs as (select r, count(*) as n_base, min(word) as first_word, max(word) as last_word, string_agg(distinct label, ',' order by label) as base_labels from bp group by r),
s as (select r, w[i] as x, i from (select r, w, unnest(range(1, len(w) + 1)) as i from t)),
c as materialized (select r, i, sum(length(x) + 1) over (partition by r order by i) as stop, sum(length(x) + 1) over (partition by r order by i) - length(x) - 1 as start from s),
z as (select distinct size - k as low, size + k as high from n),
q as (select distinct a.r, a.i, o.i as j from c a join c o on a.r = o.r and o.i between a.i and a.i + 20 join z on o.stop - 1 - a.start between low and high),
u as materialized (select q.r, array_to_string(w[q.i:q.j], ' ') as x from q join t on t.r = q.r),
f as (select x, label, k, levenshtein(x, notice) as e from (select distinct x from u) join n on length(x) between size - k and size + k where levenshtein(x, notice) <= k),
g as (select r, label, 1 - e / (k + 1) as score from u join f using (x) union all select r, label, 1.0 from bp),
l as (select r, string_agg(distinct label, ',' order by label) as labels, max(score) as score from g group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score
from t left join bs using (r) left join l using (r)
"""
QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES = {"op13_license_scan": ORACLE}
