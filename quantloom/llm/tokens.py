"""Byte-level BPE encoding of whole texts with the tokenizers library, and an exact memo of what it returned.

A text of printable characters up to U+024F and line breaks is cut by the vocabulary's pre-token pattern, and each
distinct pre-token goes through the library's BPE model once. In any other text a single space between two non-space
characters always starts a new pre-token, whatever stands around it: the text is cut there into units, and units with
other characters go through the library's whole encoder. A string of an added token (`<|endoftext|>`) in a text is that
token, as the library has it: texts are split there first. The memo has two generations of bounded size: when one is full it becomes the old one, from which what is seen again is
taken over.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import public_tokenizers

MAX_MEMO = 300_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile(r"[\x20-\x7E\n¡-ɏ]*")
#: The vocabulary's pre-token pattern for plain characters.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Letters come first, as no contraction begins with one.
_PIECES = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^ \n{_L}{_N}]+|[ \n]+(?![^ \n])|[ \n]+")
#: The byte-to-character table of byte-level BPE vocabularies.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_MAPPED = {b: chr(b) for b in _KEPT} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(_KEPT))}


class _Memo(dict):
    """Plain pre-token or other unit -> its number; its ids are ids[ends[number] : ends[number + 1]]."""

    def __init__(self, whole, added: dict[str, int], old: _Memo | None) -> None:
        super().__init__()
        self.whole, self.model, self.added, self.old = whole, whole.model, added, old
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, text: str | int) -> int:
        old = self.old
        if isinstance(text, int):  # an id as it is
            self.ids.append(text)
        elif old is not None and (k := old.get(text)) is not None:
            self.ids.extend(old.ids[old.ends[k] : old.ends[k + 1]])
        elif text in self.added:
            self.ids.append(self.added[text])
        elif _PLAIN.fullmatch(text):
            mapped = text.replace(" ", "Ġ") if text.isascii() and "\n" not in text else text.encode().decode("latin-1").translate(_MAPPED)
            self.ids.extend([t.id for t in self.model.tokenize(mapped)])
        else:
            self.ids.extend(self.whole.encode(text, add_special_tokens=False).ids)
        self.ends.append(len(self.ids))
        self[text] = number = len(self.ends) - 2
        return number


class Encoder:
    """Encodes batches of texts; one per process and vocabulary file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens of this kind are not supported")
        self.added = {t.content: i for i, t in added.items()}
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.memo = _Memo(self.whole, self.added, None)

    @classmethod
    def of(cls, path: str | None = None) -> Encoder:
        path = path or public_tokenizers.path("byte_bpe_50k.json")
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def codes(self, text: str) -> list[int]:
        get = self.memo.__getitem__
        if self.at_added is not None and any(t in text for t in self.added):
            parts = [x for x in self.at_added.split(text) if x]
            return list(chain.from_iterable([get(x)] if x in self.added else self._codes(x) for x in parts))
        return self._codes(text)

    def _codes(self, text: str) -> list[int]:
        get = self.memo.__getitem__
        if _PLAIN.fullmatch(text):
            return list(map(get, _PIECES.findall(text)))
        at, found = [0, *(m.start() for m in _CUT.finditer(text)), len(text)], []
        for a, b in zip(at, at[1:], strict=False):
            unit = text[a:b]
            if _PLAIN.fullmatch(unit):
                found += map(get, _PIECES.findall(unit))
            else:
                found.append(get(unit))
        return found

    def batch(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, where each text's ids end); null texts are empty; `end`: an id after each text."""
        parts, bounds, total = [], [], 0
        for lo in range(0, len(texts), 64):
            if len(self.memo) > MAX_MEMO:
                self.memo.old = None
                self.memo = _Memo(self.whole, self.added, self.memo)
            each = [self.codes(t) if t else [] for t in texts[lo : lo + 64]]
            if end is not None:
                last = self.memo[end]
                for x in each:
                    x.append(last)
            codes = np.fromiter(chain.from_iterable(each), np.int64, sum(map(len, each)))
            ids, ends = np.frombuffer(self.memo.ids, np.uint32) if self.memo.ids else np.zeros(0, np.uint32), np.frombuffer(self.memo.ends, np.int64)
            starts = ends[codes]
            sizes = ends[codes + 1] - starts
            upto = np.cumsum(sizes)
            flat = ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)]
            cuts = np.concatenate([[0], upto])[np.cumsum([len(x) for x in each])]
            parts.append(flat.astype(np.uint32, copy=False))
            bounds.append(cuts + total)
            total += len(flat)
            del ids, ends
        return (np.concatenate(parts), np.concatenate(bounds).astype(np.int64)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def rest(self) -> None:
        """After a task: let the memo's older generation go, so that an idle worker holds one at most."""
        self.memo.old = None

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text each id stands for."""
        out = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)
        for token, i in self.added.items():
            out[i] = len(token.encode())
        return out
