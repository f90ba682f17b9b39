"""BPE encoding and decoding by dynamic programming over prefixes (operator 3).

For every prefix of a word exactly one token can stand last in its encoding: the one
whose predecessor (the last token of the shorter prefix) and itself would not have been
merged across their border. A suffix automaton over the vocabulary (Aho-Corasick) names the tokens that are
suffixes of each prefix, a compatibility test of two neighbouring tokens picks the one
that holds, and back-pointers from the last prefix give the ids. The work is linear in a
word's length; nothing is merged step by step.

The vocabulary is a ``tokenizers`` file of a byte-level BPE with word ends
(``end_of_word_suffix``), NFC, white space and lower-case normalisers. Its path is a
parameter; nothing is trained and no file is copied.

Defined cases: a null or empty text has no ids and decodes to an empty text; a text may
have any length (words are encoded one by one, a word costs its own length); repeated rows
give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import hold, lead_columns, table

END = "\x00"  # stands for the word end inside the automaton; never a byte-level character
CHUNKS_KEPT = 250_000  # entries of the per-worker cache of encoded words; it is emptied beyond
PAIRS_KEPT = 1_500_000
CHUNK_CHARS = 64  # longer words are not remembered
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the vocabulary's \s


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    """Chunk of text without white space -> its ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(chunk)
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = found
        return found


class PrefixBpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.split: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of its merge
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            self.split.setdefault(whole, (left, right, rank))
        self._right = functools.lru_cache(None)(lambda t: self._spine(t, 1))
        self._left = functools.lru_cache(None)(lambda t: self._spine(t, 0))
        self._alone: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            if (i in self.split or len(token) == (len(suffix) + 1 if ends else 1)) and self._stands(i):
                letters = token[: -len(suffix)] if ends else token
                self.automaton.add_word(letters + END if ends else letters, (len(letters), i))
        self.automaton.make_automaton()
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spaces = regex.compile(r"\s+")
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.as_bytes = dict(enumerate(byte_characters()))
        self._pairs: dict[int, bool] = {}
        self._pieces = _Cache(self._encode_piece, CHUNKS_KEPT)
        self._chunks = _Cache(self._encode_chunk, CHUNKS_KEPT)

    def _spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """The tokens at one edge of token while it is built, each with the rank of the merge that ends it."""
        out, ended = [], float("inf")
        while True:
            out.append((token, ended))
            if token not in self.split:
                return tuple(out)
            parts = self.split[token]
            token, ended = parts[side], parts[2]

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge across the border of two neighbouring tokens comes before rank limit.

        x at the right edge of one meets y at the left edge of the other if their merge is
        due before x's own next merge and not after y's (the left of two equal pairs goes first).
        """
        rank = self.rank
        for x, until in self._right(left):
            for y, till in self._left(right):
                r = rank.get((x, y))
                if r is not None and r < limit and r < until and r <= till:
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """Whether a token's own text encodes to it alone."""
        if token not in self._alone:
            parts = self.split.get(token)
            self._alone[token] = parts is None or self._stands(parts[0]) and self._stands(parts[1]) and self._apart(*parts)
        return self._alone[token]

    def _encode_word(self, word: str) -> bytes:
        """word: byte-level characters."""
        n = len(word)
        last, start_of, pairs = [-1] * (n + 1), [0] * (n + 1), self._pairs
        for end, (length, token) in self.automaton.iter(word + END):
            at = end + 1 if end < n else n
            if end == n - 1 or last[at] >= 0:  # the last character only stands with the word end
                continue
            start = at - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                holds = pairs.get(key)
                if holds is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    holds = pairs[key] = self._apart(before, token)
                if not holds:
                    continue
            last[at], start_of[at] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = start_of[at]
        return np.array(ids[::-1], "<u4").tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        """chunk: normalised text without white space; its letters alone, or but for one last mark, need no pattern."""
        if chunk.isalpha():
            return self._pieces[chunk]
        if chunk[-1] in ",.!?;:" and chunk[:-1].isalpha():
            return self._pieces[chunk[:-1]] + self._pieces[chunk[-1]]
        return b"".join(map(self._pieces.__getitem__, self.pieces.findall(chunk)))

    def _encode_piece(self, piece: str) -> bytes:
        as_bytes = self.as_bytes
        return self._encode_word("".join([as_bytes[b] for b in piece.encode()]))

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _ODD_SPACE.search(text):
            text = self.spaces.sub(" ", text)
            chunks = [c for c in text.replace("Σ", "σ").lower().split(" ") if c]
        else:
            chunks = (text.replace("Σ", "σ") if "Σ" in text else text).lower().split()
        return b"".join(map(self._chunks.__getitem__, chunks))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or "<|" not in text and not self.specials.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between: the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """One per Python worker; it stays for later tasks."""
    return PrefixBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded for each row of docs(doc_id, text)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", load.cache_clear)
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode_bytes(t) for t in b.column("text").to_pylist()]
            decoded = [bpe.decode(np.frombuffer(i, "<u4")) for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return lead_columns(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As encode_decode, with digests in place of the ids and the text, which then never leave the worker."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", load.cache_clear)
        bpe = load(path)
        for b in batches:
            rows = []
            for text in b.column("text"):
                ids = bpe.encode_bytes(text.as_py())
                decoded = bpe.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, z = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return lead_columns(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
