import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import packing, token_counts, token_output
from quantloom.llm.common import new_folder
from quantloom.llm.tokens import Encoder

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, n_tokens int, ids string"


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def corpus(n=60):
    rng = random.Random(3)
    words = ["the", "of", "don't", "naïve", "日本", "x1", "(a)", "end.", "\n", "line\nbreak", "", " ", "👍", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(n)]
    return [(i, t, 7, "clash") for i, t in enumerate([None, "", "same", "same", "word " * 4000, *texts])] + [(2, "same", 7, "clash"), (None, "no id", 7, "clash")]


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab é\n\t '.,1²  日👍s\x1c_-"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library(texts):
    ids, ends = Encoder.of().batch(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ids_of(t) for t in texts] if texts else len(ids) == 0


def test_encoder_memo_restarts(monkeypatch):
    monkeypatch.setattr("quantloom.llm.tokens.MAX_MEMO", 10)
    texts = [t for _, t, *_ in corpus()] * 2
    ids, ends = Encoder.of().batch(texts, end=2)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*ids_of(t), 2] for t in texts]


def test_orc_round_trip(spark):
    rows = corpus()
    path = new_folder(spark, "test-ids")
    token_output.write(spark.createDataFrame(rows, SCHEMA), path)
    read = token_output.read(spark, path)
    want = sorted(((d if d is not None else -1), [*ids_of(t), 2]) for d, t, *_ in rows)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.ids) for r in read.collect()) == want
    got = sorted(token_output.positions(token_output.digests(read)).collect(), key=lambda r: (r.start))
    start = 0
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [d for d, _ in want]
    for r in got:
        assert (r.start, r.ids_crc32) == (start, r.ids_crc32)
        start += r.n_tokens
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, len(x), crc(x)) for d, x in want)
    assert read.where("doc_id = 3").count() == 1


def test_orc_empty(spark):
    path = new_folder(spark, "test-ids")
    token_output.write(spark.createDataFrame([], SCHEMA), path)
    assert token_output.positions(token_output.digests(token_output.read(spark, path))).count() == 0


def check_packing(pieces, rows, limit):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d, len(ids_of(t)) + 1].append([*ids_of(t), 0])
    assert docs.keys() == want.keys()
    for key, ps in docs.items():
        n, copies = key[1], len(want[key])
        covered = sorted((p.start, p.length) for p in ps)
        assert sum(x for _, x in covered) == n * copies
        for p in ps:
            assert p.ids_crc32 == crc(want[key][0][p.start : p.start + p.length])
    padding = 0
    for ps in sequences.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        total = sum(p.length for p in ps)
        assert 0 < total <= limit
        padding += 0 if total & (total - 1) == 0 else limit - total
    assert padding == 0


@pytest.mark.parametrize("limit,window", [(1024, 4096), (64, 16), (8, 4)])
def test_packing(spark, limit, window):
    rows = corpus()
    check_packing(packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), limit, window).collect(), rows, limit)


def test_packing_copies_and_ids(spark):
    rows = [(i, "one two three four five six seven", 0, "") for i in range(500)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA), 32, 64, with_ids=True).collect()
    check_packing(pieces, rows, 32)
    assert all(crc(p.ids) == p.ids_crc32 and len(p.ids) == p.length for p in pieces)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best_subset_sum(counts, room):
    sums = {0}
    for k, c in counts.items():
        sums = {s + k * j for s in sums for j in range(c + 1) if s + k * j <= room}
    best, used = packing.fill(counts, room)
    assert best == max(sums) == sum(k * c for k, c in used.items())
    assert all(c <= counts[k] for k, c in used.items())


def by_hand(text, rule):
    """(start, end, n_tokens, n_crossing) of each line, from the library's own tokens (a character of one is a byte)."""
    raw = (text or "").encode()
    starts = [0, *(i + 1 for i, b in enumerate(raw) if b == 10 and i + 1 < len(raw))]
    ends = [*starts[1:], len(raw)]
    at, n, cross = 0, [0] * len(starts), [0] * len(starts)
    for token in WHOLE.encode(text or "", add_special_tokens=False).tokens:
        end = at + len(token)
        share = [max(0, min(e, end) - max(s, at)) for s, e in zip(starts, ends, strict=True)]
        k = next(i for i, x in enumerate(share) if x) if rule == "first" else share.index(max(share))
        n[k] += 1
        cross[k] += sum(x > 0 for x in share) > 1
        at = end
    assert at == len(raw)
    return [(len(raw[:s].decode()), len(raw[:e].decode()), a, c) for s, e, a, c in zip(starts, ends, n, cross, strict=True)]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_token_counts(spark, rule):
    rows = [*corpus(), (900, "a\n\n\nb  \n \n  c\n", 0, ""), (901, "\n\n\n", 0, ""), (902, "日\n本", 0, ""), (903, "\n", 0, "")]
    got = defaultdict(list)
    for r in token_counts.attribute(spark.createDataFrame(rows, SCHEMA), rule).collect():
        got[r.doc_id].append((r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing))
        assert r.n_tokens <= r.doc_tokens
    for d, t, *_ in rows:
        want = sorted([(k, *x) for k, x in enumerate(by_hand(t, rule))] * sum(1 for e, *_ in rows if e == d))
        assert sorted(got[d]) == want, (d, t)
    assert token_counts.attribute(spark.createDataFrame([], SCHEMA), rule).count() == 0


def test_added_tokens_are_the_library_s(spark):
    texts = ["<|endoftext|>", "a <|endoftext|>", "a  <|endoftext|>  b\n", "x<|endoftext|><|endoftext|>y", "日 <|endoftext|> 本", "<|endoftext", "<|endoftext|>" * 500]
    ids, ends = Encoder.of().batch(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ids_of(t) for t in texts]
    assert 50256 in ids_of(texts[1]) and 50256 not in ids_of(texts[5])


def test_orc_stripes_row_groups_and_skipping(spark):
    """Several files, stripes and row groups; a filter on doc_id reads only the row groups that can hold it."""
    from pyarrow import orc

    from quantloom.llm.common import open_fs

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), 0, "") for i in range(6000)]
    path = new_folder(spark, "test-stripes")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    token_output.write(docs, path, stride=1000, stripe_bytes=200_000)
    fs, root = open_fs(path)
    from pyarrow.fs import FileSelector

    files = [f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".orc")]
    footers = []
    for name in files:
        with fs.open_input_file(name) as f:
            footers.append(orc.ORCFile(f))
            footers[-1] = (footers[-1].nrows, footers[-1].nstripes, footers[-1].row_index_stride)
    assert sum(n for n, *_ in footers) == 6000 and sum(k for _, k, _ in footers) > len(files) and {s for *_, s in footers} == {1000}
    read = token_output.read(spark, path)
    ranges = sorted((r.lo, r.hi) for r in read.groupBy("file").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "lo").join(read.groupBy("file").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "hi"), "file").collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    one = read.where("doc_id = 4321").select("ids")
    assert [r.ids for r in one.collect()] == [[*ids_of(rows[4321][1]), 2]]
    assert "EqualTo(doc_id,4321)" in one._jdf.queryExecution().executedPlan().toString()
    seen = spark.read.schema("doc_id long, ids array<int>").orc(path).where("doc_id = 4321")
    seen._jdf.collectToPython()
    leaf = seen._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() <= 2 * 1000  # of 6,000 rows: the row groups that may hold it
