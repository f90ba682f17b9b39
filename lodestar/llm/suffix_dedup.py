"""Removal of repeated strings by suffix arrays (operator 6).

A byte goes if a string of `least` bytes that covers it also starts anywhere else, in the
same document or another; strings are judged on the input. Texts are UTF-8 bytes. With
Units of words a text is the codes of its words, of CODE bytes each, white space does not
count, and strings have `least` words. Several Units can be judged in one go.

1. Equal texts are one text (their digest); a text that occurs twice goes whole.
2. Each window of `least` symbols has one anchor: its string of `gram` symbols of least hash, the
   leftmost of equals. That depends on the window alone, so equal windows have the same anchor at
   the same place. Consecutive windows with one anchor are a run. Runs whose anchor is in one
   text and at one place only cannot repeat and end here.
3. The other runs' symbols (contexts: a run's windows and nothing else) are dealt by anchor
   over shards, equal contexts as one. An anchor with more than KEY_CONTEXTS different contexts
   (a passage or group of copies that a large part of the corpus shares) is dealt over as many
   shards as it needs. A shard sorts the suffixes of its contexts (Larsson-Sadakane refinement),
   takes the common prefixes of neighbours (Kasai) and finds each window that has an equal in it.
4. Equal windows of one anchor that lie in different shards: each shard's different windows go on
   as a sorted array, of 128-bit digests in place of their symbols. It is cut into ranges by binary
   search for the ranges' borders, and the arrays of one range are merged two by two, by binary
   search for the places of one array's members in the other; a member that is met there repeats.
5. Runs of repeated windows go back to the texts they came from, where their union is cut.

Texts are shuffled once. Python sees Arrow buffers in bounded pieces, so a text may have any length.

Defined cases: a null text is an empty one; texts shorter than `least` keep all bytes;
rows that repeat a text lose it whole if it has `least` symbols; equal or null doc_id values
do not matter; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import ship
from lodestar.llm.common import Scratch, dropped, hold, lead_columns, shuffle_partitions, table, written

CODE = 4  # bytes that stand for a word; a false repeat needs two words of one code in otherwise equal windows
KEY_CONTEXTS = 128
CHUNK = 1 << 20  # bytes of contexts that one suffix array sorts
PIECE = 1 << 16  # symbols that are hashed at a time
_WORD = re.compile(rb"\S+")
_PLACE = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Units:
    """Strings of `least` symbols of `size` bytes (1: bytes; CODE: words); anchors have `gram` symbols, a power of two."""

    least: int
    gram: int
    size: int = 1


def gram_for(least: int) -> int:
    """About a third of a window: longer anchors are shared by chance less often, shorter ones stand for more windows."""
    return 1 << max(0, (least // 3).bit_length() - 1) if least < 384 else 128


#: Of the contract.
BYTES = Units(400, 128)


def words_of(words: int) -> Units:
    return Units(words, gram_for(words), CODE)


#: Passages of over 50 words.
PASSAGE = words_of(51)


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


@functools.lru_cache(maxsize=32)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_codes(raw: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A code of CODE bytes for each word of a text's bytes: a polynomial hash by sums over all places at once, in blocks that end at white space."""
    out, at = [np.zeros(0, np.uint32)], 0
    while at < len(raw):
        piece = raw[at : at + block]
        if at + block < len(raw):
            gaps = np.flatnonzero(_SPACE[piece])
            if len(gaps):
                piece = piece[: gaps[-1] + 1]
            else:  # a word that is longer than a block
                gaps = np.flatnonzero(_SPACE[raw[at + block :]])
                piece = raw[at : at + block + int(gaps[0]) + 1] if len(gaps) else raw[at:]
        at += len(piece)
        space = np.ones(len(piece) + 2, np.int8)
        space[1:-1] = _SPACE[piece]
        edges = np.flatnonzero(np.diff(space))
        size = max(1 << 12, 1 << len(piece).bit_length())
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_drawn(6)[piece] * _powers(_BASE, size)[: len(piece)], out=sums[1:])
        code = (sums[edges[1::2]] - sums[edges[::2]]) * _powers(pow(_BASE, -1, 1 << 64), size)[edges[::2]]
        code ^= code >> np.uint64(31)
        out.append(((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(out) if len(out) > 2 else out[-1]


@functools.lru_cache(maxsize=8)
def _drawn(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def symbols(text: pa.Scalar, units: Units) -> np.ndarray:
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    return raw if units.size == 1 else word_codes(raw)


def gram_hashes(data: np.ndarray, gram: int, seed: int = 6) -> np.ndarray:
    """A 64-bit hash of each string of gram symbols."""
    if data.dtype == np.uint8:
        h = _drawn(seed)[data]
    else:
        h = (data.astype(np.uint64) + _drawn(seed)[0]) * (_drawn(seed)[1] | np.uint64(1))
        h ^= h >> np.uint64(32)
    out, done, t = None, 0, 1
    while True:
        if gram & t:
            part = h[done : len(h) - (gram - done - t)]
            out = part if out is None else out * _MIX + part
            done += t
        if 2 * t > gram:
            return out * np.uint64(0xBF58476D1CE4E5B9)
        h = h[:-t] * _MIX + h[t:]
        h ^= h >> np.uint64(29)
        t *= 2


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours: prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs(data: np.ndarray, ends: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """first start, last start, anchor, anchor's hash of each run of windows in data, which holds pieces that end at ends."""
    least, none = units.least, np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, units.gram)
    low = window_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), least - units.gram + 1)
    anchor = (low & _PLACE).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    fresh = np.ones(len(anchor) + 1, bool)
    fresh[1:-1] = anchor[1:] != anchor[:-1]
    whole = np.zeros(len(data) + 1, np.int32)
    long_enough = ends - begins >= least
    np.add.at(whole, begins[long_enough], 1)
    np.add.at(whole, ends[long_enough] - least + 1, -1)
    inside = np.cumsum(whole[: len(anchor)]) > 0
    fresh[begins[begins < len(anchor)]] = True
    past = ends[long_enough] - least + 1
    fresh[past[past < len(anchor)]] = True
    cuts = np.flatnonzero(fresh)
    first, last = cuts[:-1], cuts[1:] - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    at = anchor[first]
    return first, last, at, h[at]


def chunks(texts: pa.Array, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """symbols, piece ends, piece rows, piece offsets in their rows: about PIECE symbols a time; long texts come in overlapping pieces."""
    views, rows, offsets, size = [], [], [], 0
    for i, text in enumerate(texts):
        raw = symbols(text, units)
        for at in range(0, len(raw) - units.least + 1, PIECE):
            views.append(raw[at : at + PIECE + units.least - 1])
            rows.append(i)
            offsets.append(at)
            size += len(views[-1])
            if size >= PIECE:
                yield np.concatenate(views), np.cumsum([len(v) for v in views]), np.array(rows), np.array(offsets)
                views, rows, offsets, size = [], [], [], 0
    if views:
        yield np.concatenate(views), np.cumsum([len(v) for v in views]), np.array(rows), np.array(offsets)


def _anchor_rows(kinds: list[Units]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffix", int)
        for batch in batches:
            ids = batch.column("tid")
            for kind, units in enumerate(kinds):
                for data, ends, rows, offsets in chunks(batch.column("body"), units):
                    first, _, at, h = runs(data, ends, units)
                    piece = np.searchsorted(ends, first, side="right")
                    place = at - np.concatenate([[0], ends[:-1]])[piece] + offsets[piece]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[piece])), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(place)], ["tid", "kind", "h", "at"])

    return run


def _context_rows(kinds: list[Units]):
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffix", int)
        sent: set[bytes] = set()
        for batch in batches:
            ids, shared = batch.column("tid"), batch.column("hs").flatten()
            of, hs = shared.field("kind").to_numpy(), shared.field("h").to_numpy()
            for kind, units in enumerate(kinds):
                own = np.unique(hs[of == kind])
                for data, ends, rows, offsets in chunks(batch.column("body"), units) if len(own) else ():
                    first, last, at, h = runs(data, ends, units)
                    h = h.view(np.int64)
                    keep = np.isin(h, own)
                    first, last, at, h = first[keep], last[keep], at[keep], h[keep]
                    piece = np.searchsorted(ends, first, side="right")
                    begins = np.concatenate([[0], ends[:-1]])
                    raw, s = data.tobytes(), units.size
                    roots, contexts = [], []
                    for a, b, p in zip(first.tolist(), (last + units.least).tolist(), at.tolist(), strict=True):
                        context = raw[a * s : b * s]
                        root = xxh3_128_digest(context, 2 * (p - a) + (s > 1))
                        roots.append(root)
                        contexts.append(None if root in sent else context)
                        sent.add(root)
                    if len(sent) > 200_000:
                        sent.clear()
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows[piece])), pa.array(np.full(len(h), kind, np.int32)), pa.array(first - begins[piece] + offsets[piece]), pa.array(roots, pa.binary()), pa.array(h), pa.array(contexts, pa.binary())],
                        ["tid", "kind", "start", "root", "h", "context"],
                    )

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of text (integers from 0) in order.

    Larsson-Sadakane: groups of suffixes that agree in h characters are refined by the
    group of the suffix h places on, which doubles h; groups of one are left alone.
    """
    n = len(text)
    used = np.zeros(int(text.max()) + 1, np.int64)
    used[text] = 1
    used[0] = 0
    letters = np.cumsum(used)[text] * (text > 0)  # 0, and the others by rank: fewer bits a character
    bits = max(1, int(letters.max()).bit_length())
    h = 63 // bits
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        if j < n:
            key[: n - j] += letters[j:]
    order = np.argsort(key)
    group = np.zeros(n + 1, np.int64)  # of each suffix: the place of its group's first member, from 1; 0 beyond the end
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while True:
        edge = np.append(new, True)
        open_ = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(open_):
            break
        suffixes = order[open_]
        key = group[suffixes] * (n + 2) + group[np.minimum(suffixes + h, n)]
        by = np.argsort(key)
        order[open_], key = suffixes[by], key[by]
        new[open_] = np.concatenate([[True], key[1:] != key[:-1]])
        firsts = np.maximum.accumulate(np.where(new[open_], open_, 0))
        group[order[open_]] = firsts + 1
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each suffix the length it shares with the one before it in order, up to most and within its context.

    Kasai: the length falls by at most one from a suffix to the next in the text, so all of
    a context's lengths cost twice its size. All contexts take their steps together. Suffixes
    that are shorter than most are left at 0.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.zeros(n + most + 8, text.dtype)
    wide[:n] = text
    eight = np.lib.stride_tricks.as_strided(wide, (n + most, 8), (wide.itemsize, wide.itemsize))
    shared = np.zeros(n, np.int64)
    at, length, end = begins.copy(), np.zeros(len(begins), np.int64), ends
    while len(at):
        other = before[at]
        length[other < 0] = 0
        limit = np.where(other < 0, 0, np.minimum(np.minimum(most, end - at), n - other))
        active = np.flatnonzero(length < limit)
        while len(active):
            i, j = at[active] + length[active], other[active] + length[active]
            differ = eight[i] != eight[j]
            step = np.where(differ.any(1), differ.argmax(1), 8)
            length[active] = np.minimum(length[active] + step, limit[active])
            active = active[(step == 8) & (length[active] < limit[active])]
        shared[at] = length
        at = at + 1
        length = np.maximum(length - 1, 0)
        on = at + most <= end
        at, length, end = at[on], length[on], end[on]
    return shared


class Shard:
    """The suffix array of some contexts: which windows have an equal here, and one of each equal windows."""

    def __init__(self, contexts: list[bytes], units: Units):
        least = units.least
        sizes = np.array([len(c) // units.size + 1 for c in contexts])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        body = np.ones(self.ends[-1], bool)
        body[self.ends - 1] = False
        self.codes = np.frombuffer(b"".join(contexts), np.uint8 if units.size == 1 else "<u4")
        self.body, self.units = body, units
        text = np.zeros(self.ends[-1], np.int16 if units.size == 1 else np.int32)  # a 0 after each context
        text[body] = (self.codes.astype(np.int16) if units.size == 1 else np.unique(self.codes, return_inverse=True)[1]) + 1
        self.order = suffix_array(text)
        shared = common_prefixes(text, self.order, self.begins, self.ends - 1, least)
        self.hit = shared >= least
        self.head = np.zeros(len(text), bool)
        for a, b in zip(self.begins, self.ends, strict=True):
            self.head[a : b - least] = ~self.hit[a : b - least]
        place = np.flatnonzero(self.hit[self.order])
        self.hit[self.order[place - 1]] = True  # the one before it in order

    def windows(self) -> list[np.ndarray]:
        """For each context, which of its windows has an equal."""
        return [self.hit[a : b - self.units.least] for a, b in zip(self.begins, self.ends, strict=True)]

    def different(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the windows (one of each) of the marked contexts, and where these start."""
        heads = np.flatnonzero(self.head & np.repeat(context, self.ends - self.begins))
        padded = np.zeros(len(self.body), self.codes.dtype)
        padded[self.body] = self.codes
        digest = np.empty((len(heads), 2), ">u8")
        for k in range(2):
            digest[:, k] = gram_hashes(padded, self.units.least, 11 + k)[heads]
        return digest.view("S16").ravel(), heads


def repeated_windows(contexts: list[bytes], units: Units) -> list[np.ndarray]:
    """For each context, which of its windows equals another window of these contexts."""
    return Shard(contexts, units).windows()


SOLVED = "kind int, root binary, first long, last long, key long, range int, digests binary, roots binary, places binary"


def _solve(kinds: list[Units]):
    """Rows (kind, key, part, parts, root, context) to runs of repeated windows (root, first, last) and, of keys
    with several parts, to sorted arrays of different windows for each range. Contexts without a root are known
    to repeat and only stand against the others."""

    def solved(held: list[tuple]) -> pa.RecordBatch:
        size: dict[tuple, int] = {}
        open_: dict[tuple, bool] = {}
        for kind, key, part, _, root, _ in held:
            size[kind, key, part] = size.get((kind, key, part), 0) + 1
            open_[kind, key, part] = open_.get((kind, key, part), False) or root is not None
        out: list[tuple] = []
        for kind, units in enumerate(kinds):
            rest = [r for r in held if r[0] == kind and (r[3] > 1 or size[r[:3]] > 1 and open_[r[:3]])]
            if not rest:
                continue
            shard = Shard([r[5] for r in rest], units)
            for (_, _, _, _, root, _), hit in zip(rest, shard.windows(), strict=True):
                if root is not None and hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
                    out += [(kind, root, a, b - 1, None, None, None, None, None) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            parts = np.array([r[3] for r in rest])
            if (parts > 1).any():
                out += _arrays(kind, rest, shard, parts)
        cols = list(zip(*out, strict=True)) or [[] for _ in range(9)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], [c.split()[0] for c in SOLVED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition sorted by kind, key and part: whole parts, about CHUNK bytes of contexts a time."""
        held, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "part", "parts", "root", "context")), strict=True):
                if size >= CHUNK and r[:3] != held[-1][:3]:
                    yield solved(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield solved(held)

    return run


TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_KNOWN = bytes(16)


def _arrays(kind: int, rest: list[tuple], shard: Shard, parts: np.ndarray) -> list[tuple]:
    """For each key and part among rest with several parts, its windows as one sorted array cut at the borders of ranges."""
    digest, at = shard.different(parts > 1)
    of = np.searchsorted(shard.ends, at, side="right")  # the context of each window
    own = np.frombuffer(b"".join(r[4] or _KNOWN for r in rest), np.uint8).reshape(-1, 16)[of]
    own[shard.hit[at]] = 0  # told already
    place = (at - shard.begins[of]).astype("<i4")
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rest):
        if r[3] > 1:
            groups.setdefault((r[1], r[2], r[3]), []).append(i)
    out = []
    for (key, _, n), members in groups.items():
        mine = np.flatnonzero(np.isin(of, members))
        mine = mine[np.argsort(digest[mine], kind="stable")]
        d = digest[mine]
        borders = np.array([(-(-(r << 64) // n)).to_bytes(8, "big") + bytes(8) for r in range(n)], "S16")
        cuts = np.append(np.searchsorted(d, borders), len(d))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            some = mine[cuts[r] : cuts[r + 1]]
            out.append((kind, None, None, None, key, r, digest[some].tobytes(), own[some].tobytes(), place[some].tobytes()))
    return out


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of two (digests, owners); owners of digests in both go to found and become -1, which stands for known."""
    (x, own_x), (y, own_y) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    at = np.searchsorted(x, y)
    same = np.zeros(len(y), bool)
    inside = at < len(x)
    same[inside] = x[at[inside]] == y[inside]
    found += [own_x[at[same]], own_y[same]]
    own_x = own_x.copy()
    own_x[at[same]] = -1
    return np.insert(x, at[~same], y[~same]), np.insert(own_x, at[~same], own_y[~same])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by kind, key and range: the arrays of one range are merged two by two."""

    def solved(held: list[tuple]) -> pa.RecordBatch:
        roots = np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(-1, 16)
        place = np.frombuffer(b"".join(r[5] for r in held), "<i4")
        owner = np.where(roots.any(1), np.arange(len(roots)), -1)
        arrays, done = [], 0
        for r in held:
            d = np.frombuffer(r[3], "S16")
            arrays.append((d, owner[done : done + len(d)]))
            done += len(d)
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        while len(arrays) > 1:
            arrays = [merged(*arrays[i : i + 2], found) if i + 1 < len(arrays) else arrays[i] for i in range(0, len(arrays), 2)]
        told = np.concatenate(found)
        told = told[told >= 0]
        at = pa.array(place[told].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(told), held[0][0], np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(told), [None, pa.py_buffer(roots[told].tobytes())]).cast(pa.binary()), at, at], ["kind", "root", "first", "last"])

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "range", "digests", "roots", "places")), strict=True):
            if held and r[:3] != held[-1][:3]:
                yield solved(held)
                held = []
            held.append(r)
    if held:
        yield solved(held)


FOUND = "kind int, root binary, first long, last long"


def shared_windows(contexts: DataFrame, kinds: list[Units], key_contexts: int = KEY_CONTEXTS) -> DataFrame:
    """kind, root, first, last: the runs of windows that occur again, for contexts(kind, root, h, context, n), a written table of different contexts.

    n is how often a context occurs: from 2 on all its windows are found, and it only
    stands against the other contexts of its anchor from here on (without its root).
    """
    n = shuffle_partitions(contexts.sparkSession)
    windows = F.element_at(F.array(*(F.length("context") / k.size - k.least for k in kinds)), F.col("kind") + 1).cast("long")
    whole = contexts.where("n > 1").select("kind", "root", F.lit(0).cast("long").alias("first"), windows.alias("last"))
    parts = F.ceil(F.count("*") / key_contexts).cast("int")
    hot = written(contexts.groupBy("kind", "h").agg(parts.alias("parts"), F.count_if(F.col("n") == 1).alias("open")).where("parts > 1 and open > 0").select("kind", "h", "parts"))
    dealt = contexts.join(hot, ["kind", "h"], "left").select("kind", F.col("h").alias("key"), F.coalesce("parts", F.lit(1)).alias("parts"), F.when(F.col("n") == 1, F.col("root")).alias("root"), "context", F.xxhash64("root").alias("deal"))
    dealt = dealt.withColumn("part", F.expr("cast(pmod(deal, parts) as int)")).drop("deal")
    solved = written(dealt.repartition(n, "kind", "key", "part").sortWithinPartitions("kind", "key", "part").mapInArrow(_solve(kinds), SOLVED))
    out = whole.unionByName(solved.where("key is null").select("kind", "root", "first", "last"))
    if not hot.isEmpty():
        arrays = solved.where("key is not null").select("kind", "key", "range", "digests", "roots", "places")
        out = out.unionByName(written(arrays.repartition(n, "kind", "key", "range").sortWithinPartitions("kind", "key", "range").mapInArrow(_merge, FOUND)))
    return out


def repeats(bodies: DataFrame, kinds: list[Units], key_contexts: int = KEY_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(tid, body) of the texts that share anchors, and (tid, kind, first, last) runs of repeated windows in them.

    bodies(tid, body): a row for each document, tid a digest of body. A text's copies
    count as one text here. kind is the place in kinds.
    """
    shortest = min(k.least * min(k.size, 2) - (k.size > 1) for k in kinds)  # bytes: words have one at least, and one between
    long_ones = bodies.where(F.length("body") >= shortest)
    found = long_ones.mapInArrow(_anchor_rows(kinds), "tid binary, kind int, h long, at long")
    anchors = written(found.groupBy("tid", "kind", "h").agg(F.min("at").alias("low"), F.max("at").alias("high")))
    t = F.xxhash64("tid")
    spread = anchors.groupBy("kind", "h").agg(F.min(t).alias("t"), F.max(t).alias("u"), F.min("low").alias("low"), F.max("high").alias("high"))
    # In two texts, or at two places of one. Written, so that the join has a shuffle on either side, which can be split.
    shared = written(spread.where("t <> u or low <> high").select("kind", "h"))
    wanted = anchors.select("tid", "kind", "h").join(shared, ["kind", "h"]).groupBy("tid").agg(F.collect_list(F.struct("kind", "h")).alias("hs"))
    texts = written(long_ones.groupBy("tid").agg(F.first("body").alias("body")).join(wanted, "tid"))
    dropped(anchors, shared)
    found = written(texts.mapInArrow(_context_rows(kinds), "tid binary, kind int, start long, root binary, h long, context binary"))
    contexts = written(found.groupBy("kind", "root").agg(F.first("h").alias("h"), F.first("context", True).alias("context"), F.count("*").alias("n")))
    windows = shared_windows(contexts, kinds, key_contexts)
    here = found.select("tid", "kind", "start", "root").join(windows, ["kind", "root"])
    return texts.select("tid", "body"), here.select("tid", "kind", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def covered(n: int, firsts: np.ndarray, lasts: np.ndarray, least: int) -> np.ndarray:
    """Which of n symbols the windows from firsts to lasts cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, lasts + least, -1)
    return np.cumsum(change[:-1]) > 0


def cut(raw: bytes, firsts: np.ndarray, lasts: np.ndarray, least: int) -> tuple[bytes, int, int]:
    """What is left of raw without the windows from firsts to lasts; bytes and maximal runs removed."""
    gone = covered(len(raw), firsts, lasts, least)
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def cut_words(raw: bytes, firsts: np.ndarray, lasts: np.ndarray, words: int) -> bytes:
    """What is left of raw without the runs of words that the windows from firsts to lasts cover."""
    at = np.array([m.span() for m in _WORD.finditer(raw)], np.int64)
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, at[firsts, 0], 1)
    np.add.at(change, at[lasts + words - 1, 1], -1)
    return np.frombuffer(raw, np.uint8)[np.cumsum(change[:-1]) == 0].tobytes()


def removed(bodies: DataFrame, units: Units = BYTES, more: Units | None = None, key_contexts: int = KEY_CONTEXTS) -> DataFrame:
    """tid, kept (binary), n_removed, n_spans for every text that loses bytes by units, each text once.

    With more, also n_words: how many words its runs of repeated words cover (texts with either).
    """
    texts, found = repeats(bodies, [units, *([more] if more else [])], key_contexts)
    per_text = found.groupBy("tid").agg(F.collect_list(F.struct("kind", "first", "last")).alias("found"))
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tid, body, spans in zip(*(batch.column(c) for c in ("tid", "body", "found")), strict=True):
                raw, flat = body.as_py(), spans.values
                kind, first, last = (flat.field(c).to_numpy() for c in ("kind", "first", "last"))
                n = int(covered(int((last + more.least).max()), first[kind == 1], last[kind == 1], more.least).sum()) if more and kind.any() else 0
                out.append((tid.as_py(), *cut(raw, first[kind == 0], last[kind == 0], units.least), n))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["tid", "kept", "n_removed", "n_spans", "n_words"])

    return texts.join(per_text, "tid").mapInArrow(run, "tid binary, kept binary, n_removed long, n_spans long, n_words long")


def digest_of(body) -> F.Column:
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def with_body(docs: DataFrame) -> DataFrame:
    """docs with body (the text's bytes) and tid (128 bits of their SHA-256)."""
    ship(docs.sparkSession)
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.withColumn("body", body).withColumn("tid", digest_of(body))


def without_repeats(docs: DataFrame, least: int = BYTES.least, words: int | None = None) -> DataFrame:
    """docs with text (and n_chars, if it is there) after removal; bytes of characters that are cut through go too.

    With words, runs of so many words that occur again go, however many bytes they have.
    Other columns stay as they are, whatever their names.
    """
    units = words_of(words) if words is not None else Units(least, gram_for(least))
    bodies = with_body(lead_columns(docs, ["text"])).select("tid", "body")
    copies = bodies.groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1")
    with Scratch() as scratch:
        _, found = repeats(bodies, [units])
        spans = found.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        verdicts = scratch.keep(written(copies.join(spans, "tid", "full_outer").select("tid", F.col("copies").isNotNull().alias("copied"), "spans")))
    # Columns go by place, so that no name can clash.
    names = docs.columns
    places = [f"c{i}" for i in range(len(names))]
    numbered = docs.toDF(*places)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    told = numbered.withColumn("tid", digest_of(F.encode(F.coalesce(F.col(f"c{at}"), F.lit("")), "UTF-8"))).join(verdicts, "tid", "left").drop("tid")

    def left(text: str, copied: bool, spans: pa.Scalar) -> str:
        raw = text.encode()
        if copied and (len(raw) if units.size == 1 else len(raw.split())) >= units.least:
            return ""
        if not spans.is_valid:
            return text
        first, last = (spans.values.field(c).to_numpy() for c in ("first", "last"))
        return (cut_words(raw, first, last, units.least) if units.size > 1 else cut(raw, first, last, units.least)[0]).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = zip(b.column(at), b.column("copied").to_pylist(), b.column("spans"), strict=True)
            texts = [left(t.as_py(), copied, spans) if t.is_valid and (copied or spans.is_valid) else t.as_py() for t, copied, spans in judged]
            columns = b.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, places)

    return told.mapInArrow(run, numbered.schema).toDF(*names)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns n_passage_words: how many words of the text lie in runs of over 50 words that occur again.

    For texts that occur twice n_passage_words is of what they share with other texts or within themselves.
    """
    docs = with_body(lead_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    bodies = docs.select("tid", "body")
    copies = bodies.groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1")
    with Scratch() as scratch:
        cuts = removed(bodies, BYTES, PASSAGE).select("tid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_words")
        # One row a text; written, so that the join has a shuffle on either side, which can be split where a text has many copies.
        verdicts = scratch.keep(written(copies.join(cuts, "tid", "full_outer")))
    rows = docs.select("doc_id", "tid", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("own"))
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= BYTES.least)
    none = hashlib.sha256(b"").hexdigest()
    return rows.join(verdicts, "tid", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(none)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.coalesce("n_words", F.lit(0)).alias("n_passage_words"),
    )
