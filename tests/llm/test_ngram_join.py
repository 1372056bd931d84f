import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import ngram_join
from quantloom.llm.components import components

SCHEMA = "doc_id long, text string, n long, fp string"


def brute(rows, width, percent):
    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    sets = [(d, shingle_set(t)) for d, t, *_ in rows]
    label = {d: d for d, _ in sets if d is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            i, j = sorted((find(a), find(b)))
            label[j] = i
    return sorted((d if d is not None else -1, len(s), find(d) if d is not None else -1) for d, s in sets)


def found(spark, rows, **kw):
    out = ngram_join.join(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in out)


def corpus(seed=1, families=14, size=9, shared=True):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "  \n ", "A", "a", "b", "a b", "A B", "b a", "a b c", "a B c", "a b c d"]
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 20, 60, 200, 450]))]
        if shared and f % 3 == 0:
            base += passage
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            texts.append(" ".join(w))
    rows = [(i, t, 5, "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (3, "A", 5, ""), (None, "a b c d", 5, "")]


@pytest.mark.parametrize("width,percent,kw", [(3, 90, {}), (5, 80, {}), (3, 90, {"max_block": 3, "chunk": 2}), (2, 80, {"max_block": 1, "chunk": 3})])
def test_equals_brute_force(spark, width, percent, kw):
    rows = corpus()
    assert found(spark, rows, width=width, percent=percent, **kw) == brute(rows, width, percent)


def test_rows_that_repeat_an_id_are_one_vertex(spark):
    rows = [(5, "a b c d e f", 0, ""), (5, "u v w x y z", 0, ""), (7, "u v w x y z", 0, ""), (2, "A b c d e f", 0, ""), (9, "q", 0, "")]
    got = {(d, c) for d, _, c in found(spark, rows)}
    assert got == {(5, 2), (7, 2), (2, 2), (9, 9)}


def test_empty(spark):
    assert found(spark, []) == []


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = corpus(2, 6, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute(rows, 5, 80) if d == c}
    got = [r.doc_id if r.doc_id is not None else -1 for r in kept.collect()]
    assert set(got) == want - {-1}  # the row without doc_id holds a copy


@given(st.lists(st.lists(st.integers(0, 14), min_size=1, max_size=10, unique=True), min_size=2, max_size=14), st.sampled_from([50, 80, 90]), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_block_links_span_the_links(sets, percent, salt):
    members = [(i, len(s), np.array(sorted((x * 7919 + salt) % 10007 for x in s), np.int64), 0) for i, s in enumerate(sets)]
    links = ngram_join.block_links(members, percent)

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        return [label.index(v) for v in label]

    true = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= percent * len(set(sets[a]) | set(sets[b]))]
    assert groups(links) == groups(true)
    assert {tuple(sorted(x)) for x in links} <= set(true)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_leave_one_table(spark, monkeypatch):
    from quantloom.llm import components as module
    from quantloom.llm.common import shared_dir

    paths = []
    monkeypatch.setattr(module, "new_folder", lambda s, name: paths.append(f"{shared_dir(s)}/once-{len(paths)}-{name}") or paths[-1])
    got = components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert {r.label for r in got.collect()} == {0}
    left = [p for p in paths if Path(p.removeprefix("file://")).exists()]
    assert len(paths) > 3 and left == [paths[-1]]


def test_keep_one_works_by_text_not_by_id(spark):
    long = "one two three four five six seven eight nine ten"
    other = "quite another text of more than five words"
    near = " ".join(f"w{i}" for i in range(60))
    nearer = near.replace("w59", "v59")
    rows = [(1, long, 1, "x"), (1, long, 1, "x"), (1, other, 2, "y"), (2, long, 3, "z"), (3, None, 0, ""), (3, None, 0, "")]
    rows += [(None, long, 9, ""), (None, near, 4, "a"), (None, near, 5, "b"), (None, nearer, 6, ""), (None, "lonely text of its own with words", 7, ""), (None, "", 8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __drop long, `a.b` string").repartition(3)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    first = {r.text for r in docs.where("text like 'w0 %'").selectExpr("min_by(text, xxhash64(text)) as text").collect()}
    assert got == Counter([(1, long), (1, other), (3, None), (3, None), (None, "lonely text of its own with words"), (None, "")] + [(None, t) for t in first])


def test_keep_one_against_plain_groups(spark):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(30)) for _ in range(rng.choice([3, 20, 60]))) for _ in range(12)]
    texts += [t.rsplit(" ", k)[0] for t in texts for k in (1, 2, 6)]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts + [None, ""])) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {t: grams(t) for t in texts}
    label = {t: t for t in texts}
    for x, y in combinations(texts, 2):
        if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            old, new = label[x], label[y]
            label = {t: new if v == old else v for t, v in label.items()}
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    first = {}
    for d, t in rows:
        if t:
            place = (d is None, d or 0, hashed[t])
            first[label[t]] = min(first.get(label[t], (place, d, t)), (place, d, t), key=lambda x: x[0])
    want = Counter((d, t) for _, d, t in first.values()) + Counter((d, t) for d, t in rows if not t)
    assert Counter(map(tuple, ngram_join.keep_one(docs).collect())) == want


@pytest.mark.parametrize("kw", [{}, {"max_block": 3, "chunk": 2}, {"max_block": 1, "chunk": 3}, {"max_block": 1, "chunk": 50}])
def test_links_are_counted_once_for_every_other_row(spark, kw):
    def shingle_set(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()

    rows = corpus(4, 8, 8) + [(1000, "a b c d", 0, ""), (1000, "A b c d", 0, "")]
    out = ngram_join.join(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    got = sorted((r.doc_id, r.n_shingles, r.n_links) for r in out if r.doc_id is not None)
    sets = [(d, shingle_set(t)) for d, t, *_ in rows if d is not None]
    want = []
    for i, (d, x) in enumerate(sets):
        links = sum(100 * len(x & y) >= 90 * len(x | y) for j, (_, y) in enumerate(sets) if j != i) if x else 0
        want.append((d, len(x), links))
    assert got == sorted(want) and max(k for *_, k in want) > 3
    assert [r.n_links for r in out if r.doc_id is None] == [None]
