"""Whole texts to ids by a tokenizers file, each distinct piece of text encoded once.

A text is cut where both vocabularies' pre-tokenizers end a piece whatever stands around: before a single white space
between two other characters, on either side of a single newline, and between letters or digits and punctuation. The
ids of the pieces, one after the other, are the ids of the whole. Cuts, 64-bit names of the pieces and the lookup of
those met before are NumPy steps over UTF-8 bytes, so Python works only once for each piece not yet remembered (pieces
are told apart by name: among a worker's millions two share one with a chance below 1e-6). Pieces longer than LONG bytes
are encoded each time, and a text that holds a special token's string is encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import concat_ranges, strings
from .textvec import span_hashes

#: Longest piece, in bytes, that is remembered; bytes whose pieces are looked up at a time.
LONG, CHUNK = 64, 2 << 20
#: The usual piece: Latin letters without case rules of their own, a space before them or none.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: ASCII white space, and the UTF-8 bytes of other white space (a separator once counted as such too).
_SPACES = np.array([i == 32 or 9 <= i <= 13 or 28 <= i <= 31 for i in range(256)])
_WIDE_SPACES = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_PUNCT = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])
#: First bytes of two-byte characters that are all letters, but for two signs; a dotted capital I ends in a mark when lower-cased.
_LETTER_LEADS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])
_NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]


def _byte_table() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_table()


def _space_flags(data: np.ndarray) -> np.ndarray:
    """Whether each byte is part of white space."""
    flags = _SPACES[data]
    leads = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(leads):
        for wide in _WIDE_SPACES:
            at = leads[leads + len(wide) <= len(data)]
            for k, byte in enumerate(wide):
                at = at[data[at + k] == byte]
            for k in range(len(wide)):
                flags[at + k] = True
    return flags


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte, by the two bytes before it and the three from it on."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        space = _space_flags(data)
        lone = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~space[:-2] & ~space[2:]
        cut[1:-1] = lone
        cut[2:] |= lone & (data[1:-1] == 10)
    if len(data) > 1:
        alnum, punct = _ALNUM[data], _PUNCT[data]
        ends = alnum[:-1].copy()  # of letters and digits
        leads = np.flatnonzero(_LETTER_LEADS[data[:-1]])
        pair = data[leads].astype(np.int32) << 8 | data[leads + 1]
        leads = leads[~np.isin(pair, _NO_LETTERS)] + 1
        ends[leads[leads < len(ends)]] = True
        cut[1:] |= ends & punct[1:]
        cut[1:] |= punct[:-1] & (data[:-1] != 39) & alnum[1:]  # after an apostrophe a contraction may go on
    return cut


def piece_starts(data: np.ndarray, offsets: np.ndarray, window: int = CHUNK) -> np.ndarray:
    """Ascending starts of the pieces of UTF-8 texts that lie one after the other; each text that is not empty begins one."""
    cut = np.empty(len(data), bool)
    for at in range(0, len(data), window):  # a few bytes more on either side decide the cuts at the edges
        low = max(0, at - 8)
        cut[at : at + window] = _cuts(data[low : at + window + 8])[at - low : at - low + window]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class WordEncoder:
    """Ids of texts. words: how many distinct pieces are remembered; beyond that half of them, those met least, are forgotten.

    Plain words go straight to the file's BPE model; every other piece goes through the whole tokenizer.
    """

    def __init__(self, path: str, words: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if json.loads(self.tokenizer.to_str())["model"]["type"] != "BPE":
            raise ValueError(f"{path} holds no BPE model")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = words
        #: Whether some id needs more than 16 bits.
        self.large = self.tokenizer.get_vocab_size() > 1 << 16
        #: Whether a space before a word belongs to it; else texts are lower-cased and white space is dropped.
        self.spaced = self.tokenizer.normalizer is None
        # known pieces by ascending name: where their ids lie in flat, how many they are, how often the piece was met
        self.names, self.begin, self.size, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, piece: bytes) -> list[int]:
        text = piece.decode()
        if not _PLAIN.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if not self.spaced:
            text = text.strip(" ").lower()
        if not text.isascii():
            word = text.encode().decode("latin-1").translate(_BYTES)
        else:
            word = "\u0120" + text[1:] if text[0] == " " else text
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, names: np.ndarray, pieces: list[bytes]) -> None:
        found = list(map(self._ids, pieces))
        size = np.fromiter(map(len, found), np.int32, len(found))
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, len(self.flat) // 2), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), np.uint32, total)
        begin = self.used + np.cumsum(size) - size
        self.used += total
        at = np.searchsorted(self.names, names)
        self.names, self.begin = np.insert(self.names, at, names), np.insert(self.begin, at, begin)
        self.size, self.met = np.insert(self.size, at, size), np.insert(self.met, at, 0)

    def _forget(self) -> None:
        """Keep the half of the memory that was met most often since the last time."""
        kept = np.sort(np.argpartition(-self.met, self.words // 2)[: self.words // 2])
        size = self.size[kept]
        self.flat = self.flat[concat_ranges(self.begin[kept], size.astype(np.int64))]
        self.used = len(self.flat)
        self.names, self.begin, self.size, self.met = self.names[kept], np.cumsum(size.astype(np.int64)) - size, size, np.zeros(len(kept), np.int32)

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces, one after the other, and how many each has."""
        if len(self.names) > self.words:
            self._forget()
        long = np.flatnonzero(stops - starts > LONG)
        names, first, which = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        of_long = np.zeros(len(names), bool)
        of_long[which[long]] = True
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        if len(self.names):
            known = self.names[np.minimum(at, len(self.names) - 1)] == names
        new = np.flatnonzero(~known & ~of_long)
        raw = data.tobytes()
        if len(new):
            where = first[new]
            self._learn(names[new], [raw[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist())])
            at = np.searchsorted(self.names, names)
        own = np.flatnonzero(~of_long)
        self.met[at[own]] += np.bincount(which, minlength=len(names))[own].astype(np.int32)
        if not len(long):
            at = at[which]
            size = self.size[at].astype(np.int64)
            return self.flat[concat_ranges(self.begin[at], size)], size
        ids = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(starts[long].tolist(), stops[long].tolist())]
        short = np.ones(len(starts), bool)
        short[long] = False
        at = at[which[short]]
        size = np.zeros(len(starts), np.int64)
        size[short], size[long] = self.size[at], list(map(len, ids))
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[concat_ranges(begin[short], size[short])] = self.flat[concat_ranges(self.begin[at], size[short])]
        for a, some in zip(begin[long].tolist(), ids):
            out[a : a + len(some)] = some
        return out, size

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the offset of each text's first; null counts as empty."""
        data, offsets = strings(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
        data = data[: offsets[-1]]
        starts = piece_starts(data, offsets)
        raw, whole = data.tobytes(), set()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                whole.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(special, at + 1)
        del raw
        if whole:
            keep = np.ones(len(starts), bool)
            for i in whole:
                keep[np.searchsorted(starts, offsets[i], "right") : np.searchsorted(starts, offsets[i + 1])] = False
            starts = starts[keep]
        stops = np.r_[starts[1:], len(data)]
        ids, sizes, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(stops, starts[i] + CHUNK, "right")))
            a, b = int(starts[i]), int(stops[j - 1])
            some, size = self._looked_up(data[a:b], starts[i:j] - a, stops[i:j] - a)
            ids.append(some)
            sizes.append(size)
            i = j
        ends = np.r_[0, np.cumsum(np.concatenate(sizes))]
        return np.concatenate(ids), ends[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = np.diff(offsets)
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, offsets + np.arange(len(offsets))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
