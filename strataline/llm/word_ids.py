"""Token ids of whole texts by the ``tokenizers`` library, with one library call per
distinct unit instead of one per text.

It is for byte-level BPE tokenizers whose normalizer is NFC, white space to
blanks, lower case, and whose pre-tokenizer drops white space and cuts the rest
into contractions, letter runs, single digits and runs of other characters. There the
ids of a text are the ids of its units one after the other. Two kinds of unit:

* in chunks (between ASCII white space) that hold only ASCII and precomposed
  Latin-1 letters, no apostrophe and no ``<|``, a unit is a lower-cased letter run, a
  digit, or a run of the rest, found by byte classes for a whole batch at once and
  given to the library's BPE model;
* any other chunk is one unit and goes through the whole library pipeline.

A direct-mapped table of fixed size keeps the ids of units between batches of a
worker. Units are compared by a 64-bit hash and an independent 64-bit check (their
length, first and last eight bytes); if two units of a batch had equal hashes and
unequal checks, the batch would go through the library text by text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import text_hash as H

WIDTH = 8  # ids kept per unit; longer units aren't kept
SLOTS = 1 << 20

_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_CLASS[0x80:] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[H.IS_SPACE] = _SPACE


def _byte_letters() -> str:
    """The printable letter that byte-level BPE has for each byte: itself where
    it is printable in Latin-1, else the next one from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        printable = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE
        out.append(chr(b if printable else spare))
        spare += not printable
    return "".join(out)


_LETTERS = {i: x for i, x in enumerate(_byte_letters())}
_tables: dict[str, _Table] = {}  # by tokenizer file, for the life of a worker


class _Table:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.key = np.zeros(SLOTS, np.uint64)
        self.check = np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.uint8)  # 0: free
        self.ids = np.zeros((SLOTS, WIDTH), np.uint32)


def _checks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)[np.minimum(size, 8)]
    first, last = eight[start] & keep, eight[np.maximum(end - 8, start)] & keep
    return first * np.uint64(0xA24BAED4963EE407) + last * np.uint64(0x9FB21C651E98DF25) + size.astype(np.uint64)


def _units(texts: H.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, lower-cased in simple chunks; start; end; text; whether simple) of all units."""
    data = texts.data
    words = H.words_of(texts)
    low = H.lowered(texts).data
    # bytes that make a chunk not simple
    odd = (data >= 0x80) | (data == 0x27)
    latin = np.zeros(len(data), bool)
    if len(data) > 1:
        lead = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        latin[:-1] |= lead
        latin[1:] |= lead
        odd &= ~latin
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    total = np.concatenate(([0], np.cumsum(odd)))
    simple = total[words.end] == total[words.start]
    if not simple.all():
        for s, e in zip(words.start[~simple], words.end[~simple]):
            low[s:e] = data[s:e]
    kind = _CLASS[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    opens[words.end] = True
    if not simple.all():
        for s, e in zip(words.start[~simple], words.end[~simple]):
            opens[s + 1 : e] = False
    opens[words.start] = True
    inside = np.append(kind != _SPACE, False)
    start = np.flatnonzero(opens & inside)
    # a unit ends where the next one opens or its chunk ends
    bounds = np.flatnonzero(opens)
    end = bounds[np.searchsorted(bounds, start) + 1] if len(start) else start
    chunk = np.searchsorted(words.start, start, "right") - 1
    return low, start, end, words.text[chunk], simple[chunk]


class WordEncoder:
    """``encode(column)``: for each text its ids as little-endian unsigned 32-bit
    integers, then ``end_id`` unless that is None. Null texts count as empty. Special
    tokens' strings in a text are found as the library finds them by default."""

    def __init__(self, path: str, end_id: int | None = None):
        self.path, self.end_id = path, end_id

    @property
    def _table(self) -> _Table:
        if self.path not in _tables:
            _tables[self.path] = _Table(self.path)
        return _tables[self.path]

    @property
    def vocabulary(self) -> int:
        return self._table.tokenizer.get_vocab_size(with_added_tokens=True)

    def library_ids(self, text: str) -> list[int]:
        return self._table.tokenizer.encode(text, add_special_tokens=False).ids

    def _unit_ids(self, raw: bytes, simple: bool) -> list[int]:
        if simple:
            return [t.id for t in self._table.model.tokenize(raw.decode("latin-1").translate(_LETTERS))]
        return self.library_ids(raw.decode("utf-8"))

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has), with the end ids."""
        texts = H.texts_of(column)
        extra = 0 if self.end_id is None else 1
        data, start, end, text, simple = _units(texts)
        keys = H.Hasher(data).ranges(start, end) ^ np.where(simple, np.uint64(0), np.uint64(0x5BD1E9955BD1E995))
        checks = _checks(data, start, end)
        table = self._table
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (table.key[slot] == keys) & (table.check[slot] == checks) & (table.size[slot] > 0)
        sizes = table.size[slot].astype(np.int64)
        rows = table.ids[slot]
        new = np.flatnonzero(~known)
        long: list[tuple[np.ndarray, list[int]]] = []
        if len(new):
            distinct, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            if (checks[new] != checks[new][first][which]).any():
                return self._text_by_text(texts)
            made = np.zeros((len(distinct), WIDTH), np.uint32)
            n = np.zeros(len(distinct), np.int64)
            raw = data.tobytes()
            for i, (a, b, s) in enumerate(zip(start[new][first].tolist(), end[new][first].tolist(), simple[new][first].tolist())):
                ids = self._unit_ids(raw[a:b], s)
                n[i] = len(ids)
                if len(ids) <= WIDTH:
                    made[i, : len(ids)] = ids
                else:
                    long.append((new[which == i], ids))
            rows[new], sizes[new] = made[which], n[which]
            keep = (n > 0) & (n <= WIDTH)
            at = slot[new][first][keep]
            table.key[at], table.check[at], table.size[at], table.ids[at] = distinct[keep], checks[new][first][keep], n[keep], made[keep]
        lengths = np.bincount(text, weights=sizes, minlength=len(texts)).astype(np.int64) + extra
        out = np.zeros(int(lengths.sum()), np.uint32)
        place = np.cumsum(sizes) - sizes + text * extra
        short = sizes.copy()
        for at, ids in long:
            short[at] = 0
            for p in place[at]:
                out[p : p + len(ids)] = ids
        for k in range(int(short.max(initial=0))):
            some = short > k
            out[place[some] + k] = rows[some, k]
        if extra:
            out[np.cumsum(lengths) - 1] = self.end_id
        return out, lengths

    def _text_by_text(self, texts: H.Texts) -> tuple[np.ndarray, np.ndarray]:
        raw, tail = texts.data.tobytes(), [] if self.end_id is None else [self.end_id]
        ids = [self.library_ids(raw[a:b].decode()) + tail for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
        return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, column: pa.Array) -> list[bytes]:
        ids, lengths = self.flat(column)
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
