"""Token counts by section, from one encoding of each whole document.

A document is encoded once; every token's span in the text follows from the bytes its id stands for. Sections are the
text's lines, each with its line break. Tokens and sections are both in text order, so a sorted search joins each
token's span with the sections it lies in. A token that crosses a boundary is counted by an explicit rule: `first`,
the section of its first byte (the default), or `most`, the section that holds most of its bytes (ties: the earlier).
The counts of a document's sections add up to its tokens.

Result: doc_id, section (from 0), char_start, char_end (code points), n_tokens, n_crossing (its tokens that reach into
another section), doc_tokens. Defined cases. Null or empty text: one empty section 0 without tokens. Blank lines are
sections. Repeated rows give their sections again; a null doc_id stays null. Empty table: no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Encoder

SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def attribute(docs: DataFrame, rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """Token counts of docs (doc_id, text) by section."""
    if rule not in ("first", "most"):
        raise ValueError(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        spans = encoder.byte_lengths()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield _sections(part.column(0), part.column(1).to_pylist(), encoder, spans, rule)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _sections(doc_ids: pa.Array, texts: list[str | None], encoder: Encoder, spans: np.ndarray, rule: str) -> pa.RecordBatch:
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    starts = ends - np.array([len(x) for x in raw], np.int64)
    ids, id_ends = encoder.batch(texts)
    upto = np.cumsum(spans[ids])
    at = upto - spans[ids]
    # Sections: at each document's start, and after each line break that is not its last byte. An empty document
    # keeps its own section, so sections are (document, start) pairs in order.
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(ends, breaks, "left")
    inner = breaks < ends[np.minimum(owner, len(ends) - 1)]
    doc = np.concatenate([np.arange(len(raw)), owner[inner]])
    pos = np.concatenate([starts, breaks[inner]])
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    first = np.searchsorted(doc, np.arange(len(raw)), "left")
    stop = np.append(pos[1:], len(data))
    token_doc = np.repeat(np.arange(len(raw)), np.diff(np.concatenate([[0], id_ends])))
    # The last section that starts at or before the token; the empty ones that share a start come earlier.
    s = np.searchsorted(pos, at, "right") - 1
    crossing = upto > stop[s]
    if rule == "most":
        for i in np.flatnonzero(crossing):
            k = np.arange(s[i], np.searchsorted(pos, upto[i], "left"))
            k = k[doc[k] == token_doc[i]]
            s[i] = k[np.argmax(np.minimum(stop[k], upto[i]) - np.maximum(pos[k], at[i]))]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[starts][doc]
    tokens = np.diff(np.concatenate([[0], id_ends]))
    cols = [
        doc_ids.take(pa.array(doc)), doc * 0 + np.arange(len(doc)) - first[doc], chars[pos] - base, chars[stop] - base,
        np.bincount(s, minlength=len(doc)), np.bincount(s[crossing], minlength=len(doc)), tokens[doc],
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in cols], names=SCHEMA.replace(" long", "").split(", "))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
