"""Suffix-array dedup: bytes covered by a string of `width` bytes that also starts elsewhere.

Blockwise, with difference covers. (1) Pruning: the suffixes at the positions of a difference cover (12 residues modulo
133) are named by their first width - 132 bytes, one bucket of names at a time. For two equal strings of `width` bytes
there is always an offset below 133 at which both sides are in the cover, so a start that has no repeated cover suffix in
its next 133 positions can't repeat and is dropped. Names are 32 bits beside the bucket: a collision merely keeps a start.
(2) The remaining suffixes are dealt into buckets by the least name of the 20-byte blocks in their first `width` bytes,
so equal strings share a bucket; neighbouring suffixes mostly do too, and a run of them travels as one stretch of text.
(3) One bucket at a time is sorted in a task's memory: by the suffixes' first 32 bytes, and longer ties by the ranks of
the suffixes in a second cover (6 residues modulo 31) of the bucket's text, computed before. Neighbours that agree in
`width` bytes are repeats. Ranks are made from bytes, so no equality rests on a hash.

Prefix splitters would ship `width` bytes for each suffix, so buckets are dealt by a block's name instead. A bucket of
more than HEAVY bytes of text, such as that of a passage in very many documents, is dealt anew by content: its stretches
are cut where a suffix's distance to its least block passes a multiple of a step, so equal suffixes lie in like pieces, and
a piece is dealt by a name of the bytes that all suffixes of such a piece have. What is still heavy is dealt again with a
smaller step, at last suffix by suffix. Pieces are sorted and compared like stretches; names only say where they meet.

A sample, stretch or piece that occurs several times in one slice of a task travels once; its owners are told directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions, slices

#: A perfect difference set; every residue modulo 133 is a difference of two of them.
MODULUS = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
SEGMENT = 1 << 20
BLOCK = 20
KEY = 16
#: Another perfect difference set, for the suffixes of one bucket; every residue modulo 31 is a difference.
INNER_MODULUS = 31
INNER_COVER = (1, 5, 11, 24, 25, 27)
SAMPLES = "bucket int, known boolean, keys binary, counts binary, places binary, names binary, again binary"
FLAGS = "shard int, keys binary, counts binary, places binary"
STRETCHES = "bucket int, known boolean, keys binary, starts binary, sizes binary, again binary, data binary, n long"
#: A bucket of more bytes of stretches than this is dealt anew, into parts of about a quarter of it; the steps of that.
HEAVY, STEPS = 1 << 22, (48, 12, 3, 1)
#: Text that a worker turns into samples, stretches or pieces at a time.
SLICE = 1 << 24
#: Bytes of heavy stretches that are cut into pieces at a time; numbers of about 30 bytes for each are held meanwhile.
PIECE = 1 << 22


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of a random odd base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(77)
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    power = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(SEGMENT + 4096, x, np.uint64))))
    up, down = power(base), power(pow(base, -1, 2**64))
    return table, up, down


def block_names(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of data[p:p+length] for each p of the ascending places; equal bytes, equal names."""
    table, up, down = _constants()
    out = np.empty(len(places), np.uint64)
    for lo in range(0, len(data), SEGMENT):
        a, b = np.searchsorted(places, (lo, lo + SEGMENT))
        if a == b:
            continue
        part = data[lo : lo + SEGMENT + length]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        p = places[a:b] - lo
        x = (sums[p + length] - sums[p]) * down[p]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        out[a:b] = x ^ (x >> np.uint64(32))
    return out


def cover_places(n: int, width: int) -> np.ndarray:
    """Cover positions whose suffix can lie in a string of `width` bytes of a text of n bytes."""
    if n < width:
        return np.zeros(0, np.int64)
    last = n - (width - MODULUS + 1)
    places = (np.arange(0, last + 1, MODULUS)[:, None] + np.array(COVER)).ravel()
    return places[places <= last]


def starts_near(flagged: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts of strings of `width` bytes that have one of the flagged cover positions in their first 133 bytes."""
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(flagged - (MODULUS - 1), 0), 1)
    np.add.at(edge, flagged + 1, -1)
    return np.flatnonzero(np.cumsum(edge[: max(0, n - width + 1)]) > 0)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first, so that small ones compress."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def deal_samples(docs: list[tuple[bytes, np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple]:
    """(8-byte key, cover places, names) of several texts -> packed rows per bucket.

    Of equal names one travels, marked as met again; all places that have them are told in rows of the key's bucket.
    """
    docs = [d for d in docs if len(d[1])]
    if not docs:
        return
    key = np.frombuffer(b"".join(d[0] for d in docs), "<u8")
    doc = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    place, name = np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs])
    order = np.argsort(name, kind="stable")
    new = np.diff(name[order], prepend=~name[order[:1]]) != 0
    lead = np.zeros(len(name), bool)
    lead[order[new]] = True
    again = np.zeros(len(name), bool)
    again[order] = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
    bucket = ((name >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    for known, own, at in ((False, np.flatnonzero(lead), bucket), (True, np.flatnonzero(again), (key % np.uint64(buckets)).astype(np.int32)[doc])):
        own = own[np.argsort(at[own], kind="stable")]
        edges = np.flatnonzero(np.diff(at[own], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x = own[a:b]
            yield int(at[x[0]]), known, *_pack_places(key[doc[x]], doc[x], place[x]), b"" if known else name[x].astype("<u4").tobytes(), b"" if known else np.packbits(again[x]).tobytes()


def _pack_places(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places of consecutive owners: the owners' keys, how many each has, and the gaps between them."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    gap = np.diff(place, prepend=0)
    gap[first] = place[first]
    return key[first].astype("<u8").tobytes(), _planes(np.diff(first, append=len(owner))), _planes(gap)


def _unpack_places(keys: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of every place."""
    count, total = _unplanes(counts), np.cumsum(_unplanes(places))
    return np.repeat(np.frombuffer(keys, "<u8"), count), total - np.repeat(np.concatenate(([0], total[np.cumsum(count)[:-1] - 1])), count)


def match_samples(rows: pd.DataFrame, shards: int) -> pd.DataFrame:
    """One bucket: sort its names; the places of those met more than once, packed in a row per shard of keys."""
    told, key, place, name, again = [], [], [], [], []
    for known, k, c, p, n, g in zip(rows["known"], rows["keys"], rows["counts"], rows["places"], rows["names"], rows["again"], strict=True):
        own = _unpack_places(k, c, p)
        if known:
            told.append(own)
            continue
        key.append(own[0])
        place.append(own[1])
        name.append(np.frombuffer(n, "<u4"))
        again.append(np.unpackbits(np.frombuffer(g, np.uint8), count=len(own[0])) > 0)
    if key:
        hit = _repeated(np.concatenate(name)) & ~np.concatenate(again)
        told.append((np.concatenate(key)[hit], np.concatenate(place)[hit]))
    key, place = np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told])
    shard = (key >> np.uint64(20)) % np.uint64(shards)
    order = np.lexsort((place, key, shard))
    key, place, shard = key[order], place[order], shard[order].astype(np.int64)
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        owner = np.cumsum(np.diff(key[a:b], prepend=key[a]) != 0)
        out.append((int(shard[a]), *_pack_places(key[a:b], owner, place[a:b])))
    return pd.DataFrame(out, columns=["shard", "keys", "counts", "places"])


def gather_places(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of keys: a row per key with all its places."""
    found = [_unpack_places(k, c, p) for k, c, p in zip(rows["keys"], rows["counts"], rows["places"], strict=True)]
    key, place = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order].astype("<u4")
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    names = key[edges[:-1]].astype("<u8").tobytes()
    return pd.DataFrame({"key8": [names[i : i + 8] for i in range(0, len(names), 8)], "places": [place[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]})


def _repeated(*names: np.ndarray) -> np.ndarray:
    """Whether all names of an item equal those of another item."""
    order = np.lexsort(names[::-1]) if len(names) > 1 else np.argsort(names[0])
    tie = np.zeros(len(order) + 1, bool)
    tie[1:-1] = np.logical_and.reduce([n[order][1:] == n[order][:-1] for n in names])
    out = np.zeros(len(order), bool)
    out[order] = tie[1:] | tie[:-1]
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks of numbers from 0, equal ones alike."""
    order = np.argsort(x)
    new = np.zeros(len(x), bool)
    sorted_ = x[order]
    new[1:] = sorted_[1:] != sorted_[:-1]
    del sorted_
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _joined_ranks(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the pairs of each item and that `shift` items on; past the end lies the least."""
    n = len(rank)
    key = rank.astype(np.int64) * (n + 1)
    key[: max(0, n - shift)] += rank[shift:] + 1
    return _ranks(key)


@lru_cache(maxsize=1)
def _common_offsets() -> np.ndarray:
    """[p, q]: the least offset that takes both residues into the inner cover."""
    inside = np.isin(np.arange(INNER_MODULUS), INNER_COVER)
    d = np.arange(INNER_MODULUS)
    both = inside[(d[:, None, None] + d[None, :, None]) % INNER_MODULUS] & inside[(d[:, None, None] + d[None, None, :]) % INNER_MODULUS]
    return both.argmax(axis=0).astype(np.int32)


def repeats_in_bucket(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which suffixes at the starts share their first `width` bytes with another of them, by sorting the suffixes.

    `width` bytes lie behind every start. Suffixes are ordered by ranks of their first 32 bytes; ties are split, all
    groups at a time, by comparing each member with one of its group at their common offset into the inner cover. Places
    and groups are 32-bit numbers, since a bucket's memory is mostly theirs.
    """
    starts = starts.astype(np.int32, copy=False)
    n = -(-len(text) // INNER_MODULUS) * INNER_MODULUS
    data = np.zeros(n + 40, np.uint8)
    data[: len(text)] = text
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | data[j : j + n]
    by8 = _ranks(word)
    del word
    by32 = _joined_ranks(_joined_ranks(by8, 8), 16)
    # ranks of the cover's suffixes: 32 bytes, and with the next 31, 62, 124 positions 63, 125, 249 bytes and more
    cover = (np.arange(0, n, INNER_MODULUS)[:, None] + np.array(INNER_COVER)).ravel()
    rank, reach, step = _ranks(by32[cover]), 32, 1
    while reach < width + INNER_MODULUS:
        rank = _joined_ranks(rank, step * len(INNER_COVER))
        reach, step = reach + step * INNER_MODULUS, 2 * step
    place = np.zeros(INNER_MODULUS, np.int32)
    place[list(INNER_COVER)] = np.arange(len(INNER_COVER))
    offset = _common_offsets()

    def rank_at(p: np.ndarray) -> np.ndarray:
        at = p // INNER_MODULUS * len(INNER_COVER) + place[p % INNER_MODULUS]
        return np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)], -1)

    order = starts[np.argsort(by32[starts])]
    head = by32[order]
    same = np.zeros(len(order), bool)  # whether a suffix agrees with the one before it
    slots = np.arange(len(order), dtype=np.int32)
    group = np.cumsum(np.diff(head, prepend=head[:1]) != 0, dtype=np.int32)
    while True:
        tied = (np.bincount(group) > 1)[group]
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        group = np.cumsum(np.diff(group, prepend=group[:1]) != 0, dtype=np.int32)
        first = np.flatnonzero(np.diff(group, prepend=np.int32(-1)))
        size = np.bincount(group)
        p, q = order[slots], order[slots[first + size // 2]][group]
        d = offset[p % INNER_MODULUS, q % INNER_MODULUS]
        side = np.sign(rank_at(p + d) - rank_at(q + d)).astype(np.int8)
        del q, d
        by = np.argsort(group.astype(np.int64) * 3 + side + 1, kind="stable")
        order[slots] = p[by]
        group, side = group[by], side[by]
        same[slots[1:]] |= (side[1:] == 0) & (side[:-1] == 0) & (group[1:] == group[:-1])
        group = np.cumsum((np.diff(group, prepend=np.int32(-1)) != 0) | (np.diff(side, prepend=np.int8(-9)) != 0), dtype=np.int32)
        slots, group = slots[side != 0], group[side != 0]
    # neighbours of different ranks can still agree in `width` bytes: 8 at a time, the last ones overlapping
    left = np.flatnonzero(~same[1:] & (head[1:] == head[:-1])) + 1
    for at in [*range(32, width - 8, 8), width - 8]:
        left = left[by8[order[left] + at] == by8[order[left - 1] + at]]
    same[left] = True
    same = np.append(same, False)
    out = np.zeros(len(text), bool)
    out[order] = same[:-1] | same[1:]
    return out[starts]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(least name, first start, number of starts) of the maximal runs of neighbouring starts with one least name."""
    edges = np.flatnonzero(np.diff(starts, prepend=-9) != 1)
    for a, b in zip(edges, np.append(edges[1:], len(starts)), strict=True):
        lo, hi = int(starts[a]), int(starts[b - 1])
        for s in range(lo, hi + 1, SEGMENT):  # very long runs in parts
            e = min(hi, s + SEGMENT - 1)
            least = sliding_least(block_names(data[s : e + width], np.arange(e - s + width - BLOCK + 1), BLOCK), width - BLOCK + 1)
            cuts = np.flatnonzero(np.diff(least, prepend=~least[0]))
            for x, y in zip(cuts, np.append(cuts[1:], len(least)), strict=True):
                yield int(least[x]), s + int(x), int(y - x)


def deal_stretches(docs: list[tuple[bytes, bytes, np.ndarray]], buckets: int, width: int) -> Iterator[tuple]:
    """(16-byte key, text, candidate starts) of several texts -> packed rows per bucket."""
    owners: dict[tuple[int, bytes], list[tuple[bytes, int]]] = {}
    for key, text, starts in docs:
        for least, first, n in stretches(np.frombuffer(text, np.uint8), starts, width) if len(starts) else ():
            owners.setdefault((least, text[first : first + n + width - 1]), []).append((key, first))
    dealt: dict[tuple[int, bool], list] = {}
    for (least, part), own in owners.items():
        _deal(dealt, ((least ^ (least * 0x9E3779B97F4A7C15)) >> 20) % buckets, buckets, part, own, len(own) > 1, own)
    yield from _packed(dealt)


def _deal(dealt: dict, bucket: int, buckets: int, part: bytes, own: list[tuple[bytes, int]], again: bool, tell: list[tuple[bytes, int]]) -> None:
    """Put one text with its first owner into its bucket; where it occurs again, tell those owners."""
    dealt.setdefault((bucket, False), []).append((own[0][0], own[0][1], len(part), again, part))
    for key, first in tell if len(own) > 1 else ():
        dealt.setdefault((key[0] % buckets, True), []).append((key, first, len(part), True, b""))


def _packed(dealt: dict[tuple[int, bool], list]) -> Iterator[tuple]:
    for (bucket, known), items in dealt.items():
        yield bucket, known, b"".join(i[0] for i in items), _planes(np.array([i[1] for i in items])), _planes(np.array([i[2] for i in items])), bytes(i[3] for i in items), b"".join(i[4] for i in items), 0 if known else sum(i[2] for i in items)


def deal_pieces(rows: list[tuple], step: int, parts: int, width: int) -> Iterator[tuple]:
    """Stretches of heavy buckets (keys, starts, sizes, again, data) -> packed rows of their pieces, dealt by content."""
    keys = [r[0][i : i + KEY] for r in rows for i in range(0, len(r[0]), KEY)]
    sizes = [_unplanes(r[2]) for r in rows]
    owner, begin, once, text, at = _starts([_unplanes(r[1]) for r in rows], sizes, [np.frombuffer(r[3], np.uint8) > 0 for r in rows], [r[4] for r in rows], width)
    size, data = np.concatenate(sizes), text.tobytes()
    base = np.cumsum(size) - size
    names = np.append(block_names(text, np.arange(len(text) - BLOCK + 1), BLOCK), np.full(BLOCK, np.iinfo(np.uint64).max))
    least = np.minimum.reduceat(names, np.stack((base, base + width - BLOCK + 1), axis=1).ravel())[::2]
    block = np.flatnonzero(names[: len(text)] == np.repeat(least, size))  # those that reach into the next stretch are no window's first
    ahead = block[np.searchsorted(block, at)] - at
    cuts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(ahead, prepend=-9) != -1) | (np.diff(ahead // step, prepend=-1) != 0))
    place = ahead[cuts] // step
    name = block_names(text, at[cuts] + ahead[cuts] - place * step, width - step + 1)
    met: dict[tuple[int, int, bytes], list[int]] = {}
    ends = np.append(cuts[1:], len(at))
    for cut_, n, k, x, a in zip(cuts.tolist(), (ends - cuts).tolist(), place.tolist(), name.tolist(), at[cuts].tolist(), strict=True):
        met.setdefault((x, k, data[a : a + n + width - 1]), []).append(cut_)
    dealt: dict[tuple[int, bool], list] = {}
    for (x, k, part), own in met.items():
        who = [(keys[owner[c]], int(begin[c])) for c in own]
        tell = [w for w, c in zip(who, own, strict=True) if once[c]]
        _deal(dealt, ((x ^ (k * 0x9E3779B97F4A7C15)) >> 20) % parts, parts, part, who, len(own) > 1 or not once[own[0]], tell)
    yield from _packed(dealt)


def match_stretches(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """One bucket: sort its suffixes; (key, runs) with runs of repeated starts, as pairs first, after."""
    keys, starts, sizes, again, data, out = [], [], [], [], [], []
    for known, k, a, n, g, d in zip(rows["known"], rows["keys"], rows["starts"], rows["sizes"], rows["again"], rows["data"], strict=True):
        ks, a, n = [k[i : i + KEY] for i in range(0, len(k), KEY)], _unplanes(a), _unplanes(n)
        if known:
            out += [(x, s, s + z - width + 1) for x, s, z in zip(ks, a.tolist(), n.tolist(), strict=True)]
            continue
        keys, data = keys + ks, [*data, d]
        starts.append(a)
        sizes.append(n)
        again.append(np.frombuffer(g, np.uint8) > 0)
    if keys:
        owner, begin, once, text, at = _starts(starts, sizes, again, data, width)
        hit = repeats_in_bucket(text, at, width) & once
        out += [(keys[k], s, e) for k, s, e in _runs(owner, begin, np.flatnonzero(hit))]
    return _by_key(out)


def _starts(starts: list, sizes: list, again: list, data: list[bytes], width: int) -> tuple:
    """Of all starts in stretches: the stretch, the start in its text, and whether its owners are not told yet; the stretches' joined text, and each start in it."""
    start, size, text = np.concatenate(starts), np.concatenate(sizes), np.frombuffer(b"".join(data), np.uint8)
    base, count = np.concatenate(([0], np.cumsum(size)[:-1])), size - width + 1
    owner = np.repeat(np.arange(len(size), dtype=np.int32), count)
    at = np.arange(len(owner), dtype=np.int32) + np.repeat((base - np.cumsum(count) + count).astype(np.int32), count)
    return owner, at + np.repeat((start - base).astype(np.int32), count), ~np.repeat(np.concatenate(again), count), text, at


def pieces_at_a_time(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows of stretches (keys, starts, sizes, again, data) in lists of about `most` bytes of text; larger rows are taken apart."""
    held, n = [], 0
    for keys, starts, sizes, again, data in rows:
        start, size = _unplanes(starts), _unplanes(sizes)
        upto = np.concatenate(([0], np.cumsum(size)))
        edges = [0, *(np.flatnonzero(np.diff((n + upto[:-1]) // most)) + 1).tolist(), len(size)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append((keys[a * KEY : b * KEY], _planes(start[a:b]), _planes(size[a:b]), again[a:b], data[upto[a] : upto[b]]))
            n += int(upto[b] - upto[a])
            if b < len(size) or n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _runs(owner: np.ndarray, begin: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, first start, after the last) of neighbouring starts of one owner; the hits are in order of owner and start."""
    if len(hits):
        first = np.flatnonzero((np.diff(begin[hits], prepend=-9) != 1) | (np.diff(owner[hits], prepend=-1) != 0))
        last = hits[np.append(first[1:], len(hits)) - 1]
        yield from zip(owner[hits[first]].tolist(), begin[hits[first]].tolist(), (begin[last] + 1).tolist(), strict=True)


def _by_key(found: list[tuple[bytes, int, int]]) -> pd.DataFrame:
    by: dict[bytes, list[int]] = {}
    for key, a, b in found:
        by.setdefault(key, []).extend((a, b))
    return pd.DataFrame({"key": list(by), "runs": [np.array(v, "<u4").tobytes() for v in by.values()]})


def covered(n: int, runs: list[bytes], whole: bool, width: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes of a text of n bytes."""
    if whole and n >= width:
        return [(0, n)]
    pairs = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64)
    out: list[tuple[int, int]] = []
    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + width - 1))
        else:
            out.append((a, b + width - 1))
    return out


def _raw(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """All rows of docs as (id, text, spans array<struct<start, end>>): the maximal byte runs that repeats cover.

    Bytes are those of the text in UTF-8; a null text is empty; matches never cross texts; a text shorter than `width`
    has no spans. A copy of a whole text repeats all of it, in either row. Repeated rows and ids are separate texts.
    Further columns are ignored; an empty table gives no rows.
    """
    if width < MODULUS + BLOCK + 4:
        raise ValueError(f"width must be at least {MODULUS + BLOCK + 4}")
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    length = width - MODULUS + 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, KEY).alias("key"))

    def sample(batches):
        seen: set[bytes] = set()
        for batch in slices(batches, "text", SLICE):
            held = []
            for key, data in zip(batch.column("key").to_pylist(), _raw(batch.column("text")), strict=True):
                if key not in seen and len(data) >= width:
                    seen.add(key)
                    places = cover_places(len(data), width)
                    held.append((key[:8], places, block_names(np.frombuffer(data, np.uint8), places, length)))
            yield _batch(deal_samples(held, buckets), [pa.int32(), pa.bool_(), *[pa.binary()] * 5], SAMPLES)

    def stretch(batches):
        seen: set[bytes] = set()
        for batch in slices(batches, "text", SLICE):
            held = []
            for key, data, places in zip(batch.column("key").to_pylist(), _raw(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    flagged = np.frombuffer(places, "<u4").astype(np.int64)
                    held.append((key, data, starts_near(flagged[flagged <= len(data) - length], len(data), width)))
            yield _batch(deal_stretches(held, buckets, width), [pa.int32(), pa.bool_(), *[pa.binary()] * 5, pa.int64()], STRETCHES)

    def remove(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            spans = [covered(len(t), r or [], bool(w), width) for t, r, w in zip(_raw(batch.column("text")), batch.column("runs").to_pylist(), batch.column("whole").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)], names=["id", "text", "spans"])

    long = rows.where(F.octet_length("text") >= width)
    # a row per bucket and shard of keys, and then one per key: rows grow with the texts, not with texts times buckets
    shards = partitions(spark)
    flags = long.mapInArrow(sample, SAMPLES).groupBy("bucket").applyInPandas(lambda x: match_samples(x, shards), FLAGS)
    flags = cut(flags.groupBy("shard").applyInPandas(gather_places, "key8 binary, places binary"), "cover-repeats")
    wanted = long.join(flags, F.substring("key", 1, 8) == F.col("key8")).select("key", "text", "places")
    dealt = cut(wanted.mapInArrow(stretch, STRETCHES), "stretches")
    match = lambda x: match_stretches(x, width)
    found = []
    for step in (*STEPS, 0):
        heavy = dealt.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
        loads = {r["bucket"]: r["n"] for r in heavy.collect()} if step else {}  # at most a number per bucket
        again = F.col("bucket").isin(list(loads)) & ~F.col("known")
        found.append(dealt.where(~again).groupBy("bucket").applyInPandas(match, "key binary, runs binary"))
        if not loads:
            break
        parts = sum(loads.values()) // max(1, HEAVY // 4) + 1

        def piece(batches, step=step, parts=parts):
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5, pa.int64()]
            for batch in batches:
                packed = (tuple(x.as_py() for x in row) for row in zip(*[batch.column(c) for c in ("keys", "starts", "sizes", "again", "data")], strict=True))
                for held in pieces_at_a_time(packed, PIECE):
                    yield _batch(deal_pieces(held, step, parts, width), kinds, STRETCHES)

        dealt = cut(dealt.where(again).mapInArrow(piece, STRETCHES), "pieces")
    runs = reduce(DataFrame.unionByName, found)
    runs = runs.groupBy("key").agg(F.collect_list("runs").alias("runs"))
    copies = rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("whole"))
    state = cut(runs.join(copies, "key", "full_outer"), "repeated-runs")
    id_type = dict(docs.dtypes)[id_col]
    return rows.join(state, "key", "left").select("id", "text", "runs", "whole").mapInArrow(remove, f"id {id_type}, text string, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def _batch(rows: Iterator[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
