"""Spelling variants, centroid clusters and license scan against plain versions, on small awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quantloom.llm import centroid_clusters, license_scan, spelling_variants

DOCS = "doc_id long, text string, word string, n long, mask int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple(str(x) for x in r))


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(docs):
    n, near = brute_words(docs), defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()), key=lambda r: tuple(str(x) for x in r))


def variant_docs():
    rng = random.Random(5)
    base = ["".join(rng.choice("aaeioünrst") for _ in range(rng.randrange(7, 11))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "ÉÉÉéééé", "ÉÉÉÉééé", "straßenbahn", "strasenbahn", "naïveté", "naivete", "x÷y×zab", "abcdefgh" * 5000]
    some = [b[:i] + rng.choice(["", "z", "é", b[i]]) + b[i + rng.randrange(2) :] for b in base for i in rng.sample(range(len(b)), 3)]
    pick = lambda k: rng.choices(base + some, weights=[300] * 5 + [20] * 20 + [3] * (len(base) + len(some) - 25), k=k)
    made = [None, "", " 12 34 ", "short one", "A1bcdefghi2Jklmnopq"] + [rng.choice([" ", "-", "_1 ", "\n"]).join(x.title() if rng.random() < 0.3 else x for x in pick(60)) for _ in range(60)]
    return [(i, t) for i, t in enumerate(made)] + [(7, made[7]), (7, made[8]), (None, made[9]), (None, made[9])]


def test_variants_equal_brute_force(spark):
    docs = variant_docs()
    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in docs], DOCS).repartition(3)
    want = brute_variants(docs)
    assert sum(r[1] is not None for r in want) > 5
    assert rows_of(spelling_variants.variants(df)) == want
    assert rows_of(spelling_variants.variants(df, chunk=3)) == want  # every block in tiles
    assert spelling_variants.variants(df.limit(0)).collect() == []
    no_null = [(d, t) for d, t in docs if d is not None]
    con = duckdb.connect()
    con.register("documents", df.where("doc_id is not null").toPandas())
    got = sorted(con.execute(spelling_variants.ORACLE).fetchall(), key=lambda r: tuple(str(x) for x in r))
    assert got == brute_variants(no_null)


def test_variants_chain_and_slices(spark, monkeypatch):
    text = " ".join(["abcdefg"] * 2 + ["abcdefh"] * 20 + ["abcdehh"] * 200 + ["abcddhh"] * 2000)
    df = spark.createDataFrame([(None, text, "", 1, 1)], DOCS)
    assert {r.word: (r.form, r.root) for r in spelling_variants.variants(df).collect()} == {
        "abcdefg": ("abcdefh", "abcddhh"), "abcdefh": ("abcdehh", "abcddhh"), "abcdehh": ("abcddhh", "abcddhh"), "abcddhh": (None, "abcddhh"),
    }
    whole = list(spelling_variants.runs(text))
    monkeypatch.setattr(spelling_variants, "SLICE", 100)
    parts = list(spelling_variants.runs(text))
    assert len(parts) > 10 and sum(parts, []) == whole[0]


def test_one_edit_keeps_a_band():
    rng = random.Random(2)
    letters = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]
    for _ in range(3000):
        w = "".join(rng.choices(letters, k=rng.randrange(7, 14)))
        i = rng.randrange(len(w))
        v = w[:i] + rng.choice(["", rng.choice(letters)]) + w[i + rng.randrange(2) :]
        x = int(np.bitwise_xor.reduce(spelling_variants.masks([w, v])))
        assert x.bit_count() <= 2 and any(not x & int(m) for m in spelling_variants.BAND)


def brute_clusters(rows, k=8, rounds=10):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(1024 * float(x))) for x in e]))
    if not kept:
        return []
    x = np.array([v for _, v in kept], dtype=object)
    key = lambda i: (kept[i][0] is None, hashlib.sha256(f"3:{kept[i][0]}".encode()).hexdigest(), np.array(kept[i][1], np.int32).tobytes())
    c = x[sorted(range(len(kept)), key=key)[:k]].copy()
    for r in range(rounds + 1):
        d = np.stack([((x - m) ** 2).sum(1) for m in c], 1)
        at = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
        if r < rounds:
            for j in set(at.tolist()):
                c[j] = x[at == j].sum(0) // int((at == j).sum())
    own = [int(d[i, j]) for i, j in enumerate(at)]
    sums = Counter()
    for j, v in zip(at, own, strict=True):
        sums[int(j)] += v
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((kept[i][0], int(at[i]), own[i], sums[int(at[i])], sum(own), names[at[i]]) for i in range(len(kept))), key=lambda r: tuple(str(v) for v in r))


VECTORS = "vec_id long, embedding array<double>, x int, cluster string"


def vector_rows(n=300, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    rows = [(i, list(map(float, np.round(centres[i % 5] + rng.normal(size=64) * 0.3, 2)))) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5], (5, rows[6][1]), (None, rows[7][1]), (2000, [100000.0] * 64)]
    return rows + [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [None] + [1.0] * 63), (3004, [float("nan")] * 64), (3005, [float("-inf")] + [0.0] * 63)]


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows(8), [(i, [float(i % 2)] * 64) for i in range(30)], [(1, [0.5] * 64)], []])
def test_clusters_equal_plain_version(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS).repartition(3)
    assert rows_of(centroid_clusters.cluster(df)) == brute_clusters(rows)
    if rows and all(r[0] is not None for r in rows) and len({r[0] for r in rows}) == len(rows):
        con = duckdb.connect()
        con.register("embeddings", df.toPandas())
        assert sorted(con.execute(centroid_clusters.ORACLE).fetchall(), key=lambda r: tuple(str(v) for v in r)) == brute_clusters(rows)


def test_exponion_skips_centroids_and_keeps_ties():
    rng = np.random.default_rng(1)
    centroids = np.concatenate([rng.integers(-2000, 2000, (6, 4)), [[0, 0, 0, 0], [4, 0, 0, 0]]]).astype(np.int64)
    x = np.concatenate([centroids[rng.integers(0, 8, 3000)] + rng.integers(-3, 4, (3000, 4)), [[2, 0, 0, 0]] * 5]).astype(np.int64)
    cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x))
    before, taken = None, []
    for _ in range(6):
        taken.append(centroid_clusters.assign(x, cluster, upper, lower, centroid_clusters.Geometry(centroids, before)))
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()  # argmin: the smaller number of a tie
        rest = d.copy()
        rest[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        assert (upper**2 >= d.min(1)).all() and (np.maximum(lower, 0) ** 2 <= rest.min(1)).all()
        before, centroids = centroids, centroids + rng.integers(-1, 2, centroids.shape)
    assert taken[0] <= 7 * len(x) and max(taken[1:]) < len(x)


def test_clusters_refuse_what_no_long_holds(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 1, "")], VECTORS)
    with pytest.raises(Exception, match="components beyond"):
        centroid_clusters.cluster(df).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for label, p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best = {("base", label): 0.0 for _, label in base}
    for label, notice in license_scan.NOTICES:
        k = license_scan.edits(len(notice))
        for i in range(len(w)):
            size = -1
            for j in range(i, len(w)):
                size += len(w[j]) + 1
                if size > len(notice) + k:
                    break
                if size >= len(notice) - k and (e := distance(" ".join(w[i : j + 1]), notice)) <= k:
                    best[label, notice] = min(best.get((label, notice), 1.0), e / (k + 1))
    labels = {key[1] if key[0] == "base" else key[0] for key in best}
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1 - min(best.values(), default=1.0)


def licensed():
    rng = random.Random(9)
    known = [x for _, x in license_scan.NOTICES + license_scan.BASE]
    made = [None, "", " ... ", "Released under the MIT License.", "under the mit license under the mit license", "Licensed under CC BY-NC 4.0", "~under~the~mit~license~", "under the mitlicense", "émunder the mit license"]
    for _ in range(90):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            x = list(rng.choice(known))
            for _ in range(rng.randrange(0, 6)):
                i = rng.randrange(len(x))
                x[i : i + rng.randrange(2)] = rng.choice(["", "x", " ", "e", "é", x[i]])
            parts += ["".join(x), " ".join(rng.choices(["the", "license", "gnu", "public", "all", "rights", "日本"], k=rng.randrange(0, 5)))]
        made.append(rng.choice([" ", ".\n", " -- "]).join(parts).title())
    return made


def test_scan_equals_brute_force_and_sql(spark):
    texts = licensed()
    rows = [(i, t, "", 1, 1) for i, t in enumerate(texts)] + [(3, texts[3], "", 1, 1), (None, texts[4], "", 1, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    got = rows_of(license_scan.digest(license_scan.scan(df)))
    want = sorted(((r[0], *brute_scan(r[1])) for r in rows), key=lambda r: tuple(str(x) for x in r))
    assert got == want and sum(0 < r[-1] < 1 for r in want) > 20
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(license_scan.ORACLE).fetchall(), key=lambda r: tuple(str(x) for x in r)) == want
    assert license_scan.digest(license_scan.scan(df.limit(0))).collect() == []


def test_scan_reports_spans_and_long_texts(spark):
    text = "w " * 200_000 + "Gnu generall public license" + " under the mit licence" * 3
    (row,) = license_scan.scan(spark.createDataFrame([(1, text, "", 1, 1)], DOCS)).collect()
    assert row.n_words == 200_016
    assert [(p.label, p.base, p.edits, p.word, p.words, p.text) for p in row.places] == [
        ("gpl", False, 1, 200_000, 4, "gnu generall public license"),
        *(("mit", False, 1, 200_004 + 4 * i, 4, "under the mit licence") for i in range(3)),
    ]


def test_notices_cannot_be_taken_for_each_other():
    for (la, a), (lb, b) in itertools.permutations(license_scan.NOTICES, 2):
        if la != lb:
            words = a.split()
            spans = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
            assert min(distance(s, b) for s in spans) > license_scan.edits(len(b)), (a, b)
