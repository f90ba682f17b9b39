"""Best-fit packing by minimum bin slack (operator 2).

Documents become token ids with one separator id after each; only longer ones are cut,
into pieces of a sequence's size. Whole-size pieces fill a sequence alone. The others are
dealt over packing shards of a bounded number of pieces; in each shard one bin after
another takes the fullest feasible combination of the lengths still available, which a
subset-sum dynamic programme over bits finds (bit s: some combination has sum s), and its
pieces are then removed. A shard leaves at most one bin that is not as full as its
lengths allow, so with SHARD_PIECES pieces a shard the loss against one global packing is
below one sequence for thousands.

Defined cases: a null or empty text is the separator alone (length 1); a long text gives
as many pieces as it needs; equal lengths are interchangeable and taken in the order of
(doc_id, piece); rows that repeat a doc_id are packed each by itself; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import default_path
from lodestar.llm.common import hold, lead_columns, table, written

SEQUENCE = 2048
SEPARATOR = 0
SHARD_PIECES = 20_000  # pieces in a packing shard, on average
CHUNKS_KEPT = 600_000  # words that a worker remembers; it forgets all beyond
CHUNK_CHARS = 64  # longer words are forgotten at once
_ODD = re.compile("[\x1c-\x1fΣ]")
_MARKS = string.punctuation


class Tokens:
    """ids by the tokenizers library, which is only asked for words that this worker has not met lately.

    The vocabulary drops white space and never joins across it, and a word's last token
    is marked as such; so the pieces of unseen words go to the library together, in strings of some thousands.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        with open(path, encoding="utf-8") as f:
            self.pieces = regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> list[str]:
        """Notes the ids of words (without white space) that are not known, and says what else it noted: the pieces that the pattern cuts them into.

        A piece's ids do not depend on what is beside it, so words that share pieces ask for them once.
        """
        known, cut = self.known, self.pieces.findall
        alone, split = [], {}
        for w in words:
            if w.isalpha():
                alone.append(w)
            else:
                letters = w.rstrip(_MARKS)
                split[w] = (letters, w[len(letters) :]) if letters.isalpha() else cut(w)
        fresh = alone + list(set(itertools.chain.from_iterable(split.values())).difference(known, alone))
        for k in range(0, len(fresh), 2000):
            some = fresh[k : k + 2000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(some) + 1 or cuts[-1] != 4 * len(ids):
                raise ValueError("the vocabulary does not mark each piece's last token")
            raw = ids.tobytes()
            known.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        for w, pieces_of in split.items():
            known[w] = b"".join(map(known.__getitem__, pieces_of))
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            if not t:
                split.append([])
            elif "<|" in t or _ODD.search(t):
                split.append(None)
            else:
                if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                    t = unicodedata.normalize("NFC", t)
                split.append(t.lower().split())
        known = self.known
        if len(known) > CHUNKS_KEPT:
            known.clear()
        unseen = list(set().union(*filter(None, split)).difference(known))
        fresh = self.learn(unseen)
        out = [self.whole(t) if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, split, strict=True)]
        for w in itertools.chain(unseen, fresh):
            if len(w) > CHUNK_CHARS:
                known.pop(w, None)
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row; the ids stay in the worker."""
    path = path or default_path()
    last = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", load.cache_clear)
        tokens = load(path)
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.slice(k, 500)
                rows = []
                for i, ids in enumerate(tokens.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += last
                    rows += [(i, p, at // 4, len(cut) // 4, zlib.crc32(cut)) for p, at in enumerate(range(0, len(ids), 4 * size)) for cut in [ids[at : at + 4 * size]]]
                of, *cols = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], NAMES[:5])

    return lead_columns(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], size: int) -> list[int]:
    """The lengths, from those available, whose sum is the largest that is at most size.

    reach[k] has bit s set if some combination of the first k lengths' copies has sum s.
    Copies are added in blocks of 1, 2, 4, ...; walking back from the best sum names them.
    counts' keys are in falling order.
    """
    mask = (1 << (size + 1)) - 1
    reach, blocks, now = [], [], 1
    for length in counts:
        if length > size:
            continue
        left, block = min(counts[length], size // length), 1
        while left:
            block = min(block, left)
            reach.append(now)
            blocks.append((length, block))
            now |= now << (length * block) & mask
            left -= block
            block *= 2
        if now >> size & 1:
            break
    best, taken = now.bit_length() - 1, []
    for (length, block), before in zip(reversed(blocks), reversed(reach), strict=True):
        if not before >> best & 1:
            best -= length * block
            taken += [length] * block
    return taken


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each of the lengths (each from 1 to size); equal lengths are taken in order."""
    order = np.argsort(lengths, kind="stable")
    values, firsts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    free = dict(zip(values[::-1].tolist(), counts[::-1].tolist(), strict=True))
    following = {v: iter(order[a : a + n].tolist()) for v, a, n in zip(values.tolist(), firsts.tolist(), counts.tolist(), strict=True)}
    bins, offsets, k = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while free:
        at = 0

        def take(length: int) -> None:
            nonlocal at
            i = next(following[length])
            bins[i], offsets[i] = k, at
            at += length
            free[length] -= 1
            if not free[length]:
                del free[length]

        take(next(iter(free)))
        for length in fullest(free, size - at) if at < size else []:
            take(length)
        k += 1
    return bins, offsets


def best_fit(cut: DataFrame, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """cut, as from pieces(), with sequence_id and offset. cut is read twice: give it from a written table.

    Shards are equal in number of pieces whatever documents repeat, as pieces are dealt by
    a hash of all that they hold; full pieces are not dealt at all.
    """
    spark = cut.sparkSession
    full = F.col("length") == size
    shards = max(1, cut.where(~full).count() // shard_pieces)
    dealt = cut.where(~full).withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", F.rand(7)), F.lit(shards)))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack(t["length"].to_numpy(), size)
        return t.select(NAMES[:5]).append_column("sequence_id", pa.array(2 * (bins * shards + key[0].as_py()), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = dealt.groupBy("_shard").applyInArrow(run, SCHEMA)
    alone = cut.where(full).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.select(NAMES))


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    return best_fit(written(pieces(docs, path, size)), size)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
