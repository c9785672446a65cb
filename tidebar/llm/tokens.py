"""Token ids of whole texts with a public tokenizer, through a per-worker cache of chunks.

A text is cut only where the tokenizer itself always ends a pre-token (white space, and between an ASCII letter and
ASCII punctuation), so the joined ids of the chunks are those of the whole text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code points of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
PUNCTUATION = r"!-/:-@\[-`{-~"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


class ChunkIds(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes; emptied when it holds `limit` chunks."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_white = self.tokenizer.normalizer is not None
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.byte_level = not self.drops_white and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        word = f"[^{WHITE}]*[A-Za-z](?=[{PUNCTUATION}])|[^{WHITE}]+"
        self.chunks = re.compile(word if self.drops_white else f" ?(?:{word})|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[chunk] = self.ids_of(chunk)
        return out

    def ids_of(self, chunk: str) -> bytes:
        word = chunk.lower() if self.drops_white else chunk[1:]
        if word.isalpha() and (self.drops_white or chunk[0] == " ") and max(word) < "ɐ":  # one pre-token of Latin letters, composed
            text = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = [t.id for t in self.model.tokenize(text if self.drops_white else f"Ġ{text}")]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join([self[c] for c in self.chunks(text)])


#: Classes of bytes: a letter, a digit or punctuation of ASCII.
_LETTER, _DIGIT, _MARK = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _MARK
#: The lowest bytes of a 64-bit word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_level_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a chunk starts at each byte of UTF-8 texts, one behind the other from the given places on.

    Cuts are made where a byte-level tokenizer always ends a pre-token: before a blank or line break after what surely is no
    white space, before punctuation after a letter or digit, between punctuation and a digit, and after a single line break.
    Of the letters beyond ASCII those of two bytes that begin with C3 are known, which but for two signs are letters all.
    """
    kind = _CLASS[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    word = (kind & (_LETTER | _DIGIT) > 0) | latin
    solid = (kind > 0) | latin
    new = np.zeros(len(data), bool)
    new[1:] = solid[:-1] & ((data[1:] == 32) | (data[1:] == 10))
    new[1:] |= word[:-1] & (kind[1:] == _MARK)
    new[1:] |= (kind[:-1] == _MARK) & (kind[1:] == _DIGIT)
    new[2:] |= solid[:-2] & (data[1:-1] == 10) & ((kind[2:] > 0) | (data[2:] == 0xC3))
    new[texts] = True
    return new


class ByteLevelIds:
    """Ids of many texts at once, by a byte-level tokenizer without normalizer.

    Chunks of up to 24 bytes are looked up all at a time in a hash table of numpy arrays, by their whole bytes and length, so
    that equal entries are equal chunks; new chunks and longer ones go through the tokenizer one by one. The table is emptied
    between calls when it holds `limit` chunks.
    """

    MOST = 24

    def __init__(self, single: ChunkIds, limit: int = 1 << 20):
        self.single, self.limit = single, limit
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys = np.zeros((4, 1 << 12), np.uint64)  # three words of bytes, and the length
        self.at, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, "<u4")
        self.table = np.full(1 << 14, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        x = (keys[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[2] * np.uint64(0x165667B19E3779F9)) ^ keys[3]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((x ^ (x >> np.uint64(29))) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot = self._slots(keys)
        out = self.table[slot]
        todo = np.flatnonzero(out >= 0)
        while len(todo):
            own = out[todo]
            other = self.keys[0][own] != keys[0][todo]
            for k in (1, 2, 3):
                other |= self.keys[k][own] != keys[k][todo]
            todo = todo[other]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            out[todo] = self.table[slot[todo]]
            todo = todo[out[todo] >= 0]
        return out

    def _place(self, lo: int) -> None:
        """Put the entries from lo on into the table."""
        todo = np.arange(lo, self.n)
        slot = self._slots(self.keys[:, lo : self.n])
        while len(todo):
            here = slot[todo - lo]
            free = self.table[here] < 0
            self.table[here[free]] = todo[free]
            todo = todo[self.table[here] != todo]
            slot[todo - lo] = (slot[todo - lo] + 1) & (len(self.table) - 1)

    def _add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New entries with their ids."""
        lo, self.n = self.n, self.n + len(ids)
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.n > len(self.at):
            size = 1 << self.n.bit_length()
            grown = lambda x: np.concatenate((x, np.zeros((*x.shape[:-1], size - x.shape[-1]), x.dtype)), axis=-1)
            self.keys, self.at, self.count = grown(self.keys), grown(self.at), grown(self.count)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros((1 << (self.used + len(flat)).bit_length()) - len(self.pool), "<u4")))
        self.keys[:, lo : self.n] = keys
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.count[lo : self.n], self.at[lo : self.n] = n, self.used + np.cumsum(n) - n
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        if 2 * self.n > len(self.table):
            self.table, lo = np.full(4 << self.n.bit_length(), -1, np.int32), 0
        self._place(lo)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and how many each text has."""
        if self.n >= self.limit:
            self.clear()
        texts = pc.fill_null(texts, "")
        rows = texts.cast(pa.large_binary())
        edges = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        size = int(edges[-1] - edges[0])
        if not size:
            return np.zeros(0, "<u4"), np.zeros(len(rows), np.int64)
        raw = rows.buffers()[2].slice(int(edges[0]), size).to_pybytes() + bytes(32)
        data, edges = np.frombuffer(raw, np.uint8), edges - edges[0]
        first = edges[:-1][edges[1:] > edges[:-1]]
        new = byte_level_starts(data[:size], first)
        alone = np.zeros(len(rows), bool)
        for s in self.single.special:  # a text with a special token is one chunk
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(alone).tolist():
            new[edges[k] + 1 : edges[k + 1]] = False
        start = np.flatnonzero(new)
        length = np.diff(start, append=size)
        long = length > self.MOST
        long[np.searchsorted(start, edges[:-1][alone])] = True
        words = np.ndarray(size + 24, "<u8", raw, strides=(1,))
        keys = np.stack([*(words[start + at] & _LOW[np.clip(length - at, 0, 8)] for at in (0, 8, 16)), length.astype(np.uint64)])
        entry = self._find(keys)
        entry[long] = -1
        met: dict[bytes, int] = {}
        missed = np.flatnonzero((entry < 0) & ~long)
        number = [met.setdefault(raw[a:b], len(met)) for a, b in zip(start[missed].tolist(), (start + length)[missed].tolist(), strict=True)]
        if met:
            number, lo = np.array(number), self.n
            self._add(keys[:, missed[np.unique(number, return_index=True)[1]]], [self.single.ids_of(c.decode()) for c in met])
            entry[missed] = lo + number
        del keys
        count = self.count[entry]
        rest = np.flatnonzero(long)
        found = [np.frombuffer(self.single.encode(raw[a:b].decode()), "<u4") for a, b in zip(start[rest].tolist(), (start + length)[rest].tolist(), strict=True)]
        count[rest] = [len(x) for x in found]
        upto = np.concatenate(([0], np.cumsum(count)))
        at = self.at[entry]
        at[rest] = 0
        out = self.pool[np.minimum(np.arange(upto[-1]) + np.repeat(at - upto[:-1], count), len(self.pool) - 1)]
        for x, a in zip(found, upto[rest].tolist(), strict=True):
            out[a : a + len(x)] = x
        return out, np.diff(upto[np.searchsorted(start, edges)])


@lru_cache(maxsize=4)
def byte_level_ids(path: str) -> ByteLevelIds:
    """One table per tokenizer file and Python worker."""
    return ByteLevelIds(ChunkIds(path))


@lru_cache(maxsize=4)
def chunk_ids(path: str) -> ChunkIds:
    """One cache per tokenizer file and Python worker."""
    return ChunkIds(path)
