"""Language ID, quality classifier and the pipeline: awkward rows, determinism, held-out accuracy, brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import language_id, quality_classifier
from quantloom.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def test_language_accuracy_and_contract(spark):
    docs = table(spark, SF, "documents")
    got = language_id.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert not got.rejected.mean() > 0.02


def test_language_awkward_rows(spark):
    rng = random.Random(1)
    words = {"aa": ["kata", "bolo", "zuzu"], "bb": ["wyrm", "flyn", "spry"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, "s", 0.0, "") for i, k in enumerate(["aa", "bb"] * 60)]
    odd = [(900, None, "aa", "s", 0.0, ""), (901, "12 34 !?", None, "s", 0.0, ""), (902, "", "bb", "s", 0.0, ""), (None, "kata bolo", None, None, 0.0, ""), (903, "KATA zuzu " * 300_000, None, "s", 0.0, ""), (904, "wyrm", None, "s", 0.0, ""), (904, "wyrm", None, "s", 0.0, "")]
    docs = spark.createDataFrame([*rows, *odd], SCHEMA).repartition(3)
    model = language_id.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(900, "und"), (901, "und"), (902, "und"), (None, "aa"), (903, "aa"), (904, "bb")} <= got
    assert all((i, k) in got for i, _, k, *_ in rows)
    kept = language_id.keep(docs, model)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect())
    none = language_id.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(docs.limit(5), none).collect()} == {"und"}
    assert language_id.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_language_slices_change_nothing_but_their_borders(monkeypatch):
    text = "Straße, Ünder 12 x" * 50
    whole, n = language_id.grams(text)
    monkeypatch.setattr(language_id, "SLICE", 100)
    cut, m = language_id.grams(text)
    assert n == m and abs(whole.sum() - cut.sum()) <= 3 * (len(text) // 100 + 1)


def test_quality_accuracy_and_contract(spark):
    got = quality_classifier.op9_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "", "", 0.0, ""), (2, "", "", "", 0.0, ""), (2, " \n", "", "", 0.0, ""), (None, "a b", "", "", 0.0, ""), (3, "x" * 200_000, "", "", 0.0, "")], SCHEMA)
    rows = quality_classifier.measured(docs)
    for labels in ([], [(1, 1), (2, 1)], [(1, 0), (3, 1), (3, 1), (77, 0)]):
        model = quality_classifier.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = quality_classifier.score(rows, model).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    empty = quality_classifier.measured(docs.limit(0))
    assert quality_classifier.score(empty, model).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_classifier.Gam(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert {model.pairs[0][:2]} == {(0, 1)}


@pytest.fixture(scope="module")
def stages(spark):
    from quantloom.llm.common import staged

    docs, seen = table(spark, SF, "documents"), []
    seen.append(docs)
    for name, f in corpus_pipeline.STAGES:
        seen.append(docs := staged(f(spark, docs, SF), f"test-{name}"))
    return seen


def test_pipeline_stages_against_brute_force(spark, stages):
    from .test_ngram_join import brute
    from .test_rules import brute_hits
    from .test_tokens import check_packing

    start, language, quality, near, bench, packed = stages
    assert all(s.columns == start.columns for s in stages[:5])
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    und = {d for d, t in rows(start) if not any(c.isalpha() for c in t or "")}
    assert und.isdisjoint(ids(language)) and len(ids(language)) >= 0.99 * start.count()
    from quantloom.llm import quality_rules

    assert ids(quality) == Counter(r.doc_id for r in quality_rules.judge(language).where("kept").collect())
    assert set(ids(near)) == {d for d, _, c in brute(rows(quality), 5, 80) if d == c}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    short = [(i, t) for i, t in items]
    want = {d for d, t in rows(near) if brute_hits(t, short)[1] == 0} if near.count() <= 50 else None
    if want is None:  # brute force by sets of windows: the items here all have ten words or more
        import re

        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        windows = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        assert all(len(words(t)) >= 10 for _, t in items)
        bad = set().union(*(windows(words(t)) for _, t in items))
        want = {d for d, t in rows(near) if not windows(words(t)) & bad}
    assert set(ids(bench)) == want
    check_packing(packed.collect(), rows(bench), 1024)


def by_hand(text, dim):
    """Hashed gram counts in plain integers."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    x = [ord(c) for i, c in enumerate(low) if c != " " or i == 0 or low[i - 1] != " "]
    m, (a, b, c) = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    counts = Counter()
    for n in range(3):
        for i in range(len(x) - n):
            key = ((x[i] + 1) * a + sum(x[i + j] * k for j, k in ((1, b), (2, c)) if j <= n)) & m
            key = ((key ^ (key >> 29)) * c + n) & m
            counts[((key * a) & m) >> (64 - dim.bit_length() + 1)] += 1
    return counts


def test_language_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        counts = by_hand(r.text, model.dim)
        v = {k: (1 + np.log(n)) * float(model.idf[k]) for k, n in counts.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        cos = {}
        for lang, c in zip(model.owner, model.centroids, strict=True):
            cos[lang] = max(cos.get(lang, -1), sum(x * float(c[k]) for k, x in v.items()) / max(size, 1e-9))
        top = max(cos, key=lambda k: (cos[k], -k))
        want[r.doc_id] = (model.langs[top], 1 / sum(np.exp(25 * (x - cos[top])) for x in cos.values()))
    for r in language_id.predict(docs, model).collect():
        if r.lang_pred != "und":
            lang, score = want[r.doc_id]
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_language_rejects_foreign_texts_short_and_long(spark):
    model = language_id.fit(table(spark, SF, "documents"))
    foreign = ["これは日本語のテキストです", "Привет мир как дела", "xkcd zxqv wqrt pfft bcdf ghjk"]
    for text in [*foreign, *(t * 40 for t in foreign)]:
        assert model.predict([text])[0][2], text
    docs = spark.createDataFrame([(i, t, "en", "s", 0.0, "") for i, t in enumerate(foreign)], SCHEMA)
    assert language_id.keep(docs, model).count() == 0


def test_language_ties_and_clashing_names(spark):
    rows = [(i, "tok tak tik", k, 1, 2) for i, k in enumerate(["bb", "aa"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __p long, `x.y` long")
    model = language_id.fit(docs)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"aa"}
    kept = language_id.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert kept.select("__p", "`x.y`").distinct().collect() == [(1, 2)]


def test_language_too_many_values_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "abc", str(i), "s", 0.0, "") for i in range(30)], SCHEMA)
    with pytest.raises(ValueError):
        language_id.fit(docs)


def test_pipeline_awkward_and_empty_tables(spark, tmp_path):
    start = table(spark, SF, "documents")
    texts = [r.text for r in start.where("n_chars > 300").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    odd = [(100, None, None, None, 0), (101, "", "en", None, 0), (0, texts[0], "en", "s", 1), (102, texts[0], None, "s", 1), (None, texts[1], "en", None, 1), (103, "long " * 200_000, "en", "s", 1)]
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, data in (("some", [*rows, *odd]), ("none", [])):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], stage
            got = [r.doc_id for r in docs.collect()]
            assert {100, 101}.isdisjoint(got)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == set(got) and len(got) == len(set(got))
        assert bool(got) == bool(data) and 102 not in got and 103 not in got


def test_quality_scores_against_plain_lookups(spark):
    from bisect import bisect_right

    sf = "/root/testdata/sf0.01"
    rows = quality_classifier.measured(table(spark, sf, "documents"))
    model = quality_classifier.fit(rows, table(spark, sf, "labels"))
    assert model.tables and model.pairs
    got = {r.doc_id: r for r in quality_classifier.score(rows, model).collect()}
    for r in rows.collect():
        total = model.base + sum(t[bisect_right(model.edges[j].tolist(), r.x[j])] for j, t in enumerate(model.tables))
        total += sum(t[bisect_right(model.coarse[i].tolist(), r.x[i])][bisect_right(model.coarse[j].tolist(), r.x[j])] for i, j, t in model.pairs)
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-total))) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_quality_measures_by_hand():
    m = dict(zip(quality_classifier.MEASURES, quality_classifier.measures("Ab cde, 12\nAb cde, 12\nx | y\n"), strict=True))
    assert m["word_len"] == (2 + 4 + 2) * 2 / 9 + 3 / 9 and m["pipes"] == 1 / 28 and m["digits"] == 4 / 28 and m["upper"] == 2 / 28
    assert m["distinct"] == 6 / 9 and m["dup_lines"] == 1 - 2 / 3 and m["longest"] == 4 and m["first_upper"] == 2 / 3 and m["top_word"] == 2 / 9
    assert quality_classifier.measures(None) == quality_classifier.measures(" ") == [0.0] * len(quality_classifier.MEASURES)


def test_language_sample_loses_none_and_is_bounded(spark):
    n = 2000
    many = spark.range(n * 10).selectExpr("id as doc_id", "concat('wort ', id % 10, ' x', id) as text", f"concat('l', id % {n}) as lang")
    sample = language_id._sample(many, 1500, 6000).collect()
    held = {f"l{i % n}" for i in range(n * 10) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r.lang for r in sample} == held and max(Counter(r.lang for r in sample).values()) == 3
    equal = spark.range(40_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'the same words', concat('le mot ', id)) as text", "if(id % 2 = 0, 'en', 'fr') as lang")
    blank = spark.createDataFrame([(i, "12 34", "xx") for i in range(9)] + [(i, None, "yy") for i in range(9)] + [(i, "..", "zz") for i in range(9)] + [(20, "letters", "zz")], "doc_id long, text string, lang string")
    sample = language_id._sample(equal.unionAll(blank), 100, 6000).collect()
    assert Counter(r.lang for r in sample) == {"en": 1, "fr": 100, "zz": 1}
    rows = {r.text for r in equal.where("lang = 'fr'").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    keys = {r.text: r.k for r in spark.createDataFrame([(t,) for t in rows], "text string").selectExpr("text", "xxhash64(text) as k").collect()}
    assert {r.text for r in sample if r.lang == "fr"} == set(sorted(rows, key=keys.get)[:100])
    model = language_id.fit(equal.unionAll(blank), dim=256)
    assert model.langs == ["en", "fr", "zz"]
    assert model.predict(["the same words", "le mot 7"])[0][0] == "en"


def test_language_training_by_a_plain_second_version(spark):
    """Document frequencies, clusters and floors in plain Python over the sampled texts."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    dim, k = 256, 2
    model = language_id.fit(docs, dim=dim, clusters=k)
    sample = sorted((r.lang, r.key, r.text) for r in language_id._sample(docs, language_id.PER_LANGUAGE, language_id.MAX_SAMPLE).collect())
    counts = [by_hand(t, dim) for _, _, t in sample]
    df = Counter(g for c in counts for g in c)
    idf = [np.log(1 + len(sample)) + 1 - np.log(1 + df[g]) if df[g] else np.log(1 + len(sample)) + 1 for g in range(dim)]
    assert np.allclose(model.idf, idf, rtol=1e-5)

    def vector(c):
        v = np.zeros(dim)
        for g, n in c.items():
            v[g] = (1 + np.log(n)) * idf[g]
        return v / max(np.linalg.norm(v), 1e-9)

    each = {}
    for lang in sorted({x for x, _, _ in sample}):
        v = [vector(c) for c, (x, _, _) in zip(counts, sample, strict=True) if x == lang]
        mean = sum(v) / len(v)
        chosen = [max(range(len(v)), key=lambda i: v[i] @ mean)]
        while len(chosen) < min(k, len(v)):
            chosen.append(min(range(len(v)), key=lambda i: max(v[i] @ v[j] for j in chosen)))
        centres = [v[i] for i in chosen]
        for _ in range(8):
            at = [max(range(len(centres)), key=lambda j: x @ centres[j]) for x in v]
            for j in range(len(centres)):
                if j in at:
                    m = sum(x for x, a in zip(v, at, strict=True) if a == j)
                    centres[j] = m / np.linalg.norm(m)
        each[lang] = centres
    assert model.langs == sorted(each)
    assert np.allclose(model.centroids, np.concatenate([each[x] for x in model.langs]), atol=1e-3)
    found = {}
    for lang, key, text in sample:
        for piece in [text, *(text[(key % (1 << 30)) % (len(text) - n) :][:n] for n in language_id.CUTS if n < len(text))]:
            letters = sum(c.isalpha() for c in piece)
            if letters:
                x = vector(by_hand(piece, dim))
                cos = {g: max(x @ c for c in each[g]) for g in each}
                if max(sorted(cos), key=cos.get) == lang:
                    found.setdefault(int(np.log2(letters + 1)), []).append(cos[lang])
    last = 0.0
    for size in range(64):
        if len(found.get(size, ())) >= language_id.LEAST:
            last = language_id.REJECT_SHARE * np.quantile(found[size], language_id.LOW)
        assert abs(model.floor[size] - last) < 0.02, size


def test_quality_training_counts_repeated_rows_once_and_is_bounded(spark):
    sf = "/root/testdata/sf0.001"
    rows = quality_classifier.measured(table(spark, sf, "documents")).select("doc_id", "x")
    labels = table(spark, sf, "labels")
    once = quality_classifier.fit(rows, labels)
    many = quality_classifier.fit(rows.unionAll(rows).unionAll(rows.limit(50)), labels.unionAll(labels))
    assert once.tables and len(once.tables) == len(many.tables) and once.base == many.base
    assert all((a == b).all() for a, b in zip(once.tables, many.tables, strict=True))
    hot = spark.range(5000).selectExpr("7L as doc_id", "array_repeat(id * 1.0D, 16) as x")  # one id with very many texts
    seen = []
    original = quality_classifier.Gam
    try:
        quality_classifier.Gam = lambda x, y: seen.append(len(x)) or original(x[:0], y[:0])
        quality_classifier.fit(hot.selectExpr("doc_id", f"slice(x, 1, {len(quality_classifier.MEASURES)}) as x"), spark.createDataFrame([(7, 1)], "doc_id long, quality int"), max_rows=100)
    finally:
        quality_classifier.Gam = original
    assert seen == [100]
