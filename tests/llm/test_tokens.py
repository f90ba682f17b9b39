"""Operators 2 and 3 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestar.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def made_up(n, seed):
    r = random.Random(seed)
    letters = "abcdeéèñ th in er an'’s.!0 1\t\nÀÅßΣ漢😀<|>"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_ids_and_text_are_the_librarys(library, odd_texts):
    model, tokens = bpe.load(bpe.default_path()), packing.load(bpe.default_path())
    texts = [t or "" for _, t in odd_texts] + made_up(1500, 1) + ["a" * 700, "." * 200 + "!?" * 40, "don't_won't—“q”"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [model.encode(t).tolist() for t in texts] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encode(texts)] == want
    assert [model.decode(model.encode(t)) for t in texts] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_small_caches_change_nothing(monkeypatch):
    texts = made_up(300, 2)
    want = [bpe.load(bpe.default_path()).encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 3)
    small = bpe.PrefixBpe(bpe.default_path())
    assert [small.encode(t).tolist() for t in texts] == want


def test_op3(spark, library, odd_texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in odd_texts], "doc_id long, text string, ids string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect())
    want = []
    for i, t in odd_texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0)).count() == 0
    full = bpe.encode_decode(df).where("doc_id = 1").collect()[0]
    assert np.frombuffer(full.ids, "<u4").tolist() == library.encode(odd_texts[0][1], add_special_tokens=False).ids


def test_fullest_is_the_best_subset():
    r = random.Random(4)
    for _ in range(200):
        lengths = sorted((r.randint(1, 30) for _ in range(r.randint(1, 9))), reverse=True)
        size = r.randint(1, 60)
        counts = {}
        for v in lengths:
            counts[v] = counts.get(v, 0) + 1
        taken = packing.fullest(counts, size)
        sums = {0}
        for v in lengths:
            sums |= {s + v for s in sums if s + v <= size}
        assert sum(taken) == max(sums)
        assert all(taken.count(v) <= counts[v] for v in taken)


def test_op2(spark, library, odd_texts):
    r = random.Random(5)
    rows = odd_texts + [(1000 + i, " ".join(r.choice(["the", "cat", "zyx", "of"]) for _ in range(r.randint(0, 900)))) for i in range(300)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, sequence_id string")
    got = packing.pack_documents(df).collect()
    by_doc, by_seq, want = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] += [(p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    for x in got:
        by_doc[x.doc_id].append((x.piece, x.start, x.length, x.ids_crc32))
        by_seq[x.sequence_id].append((x.offset, x.length))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x.length for x in got)
    assert len(by_seq) <= -(-total // 2048) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_words_that_share_pieces_ask_the_library_once():
    tokens = packing.Tokens(bpe.default_path())
    library, asked = tokens.library, []

    class Spy:
        def encode(self, text, **how):
            asked.extend(text.split())
            return library.encode(text, **how)

    tokens.library = Spy()
    texts = ["Zebrules zebrules, zebrules. (zebrules) zebrules*** 10.20.10.2", "", "zebrules's don't 'sx x'sy ''' a_b naïve, École! ŉ x́! i̇. " + "q" * 70 + ",", "zebrules; 漢字, 한국어. 12,5%"]
    got = tokens.encode(texts)
    assert [w for w in asked if "zebrules" in w] == ["zebrules"]
    assert not any(len(w) > packing.CHUNK_CHARS for w in tokens.known)
    assert got == [tokens.whole(t) for t in texts]
