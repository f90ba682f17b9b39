"""Operators 4, 6 and 10 and the pipeline against brute force and held-out rows."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lodestar.llm import simhash, suffix_dedup, toxicity


def words(r, n):
    w = ["the", "of", "and", "thing", "er", "on", "at", "x", "qu", "lo"]
    return " ".join(r.choice(w) + r.choice(w) for _ in range(n))


def texts(seed, n=250):
    """Texts with shared passages, copies, near copies and periodic ones."""
    r = random.Random(seed)
    passages = [words(r, r.randint(8, 60)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = words(r, r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            t += " " + r.choice(passages)[r.randint(0, 30) :] + " " + words(r, r.randint(0, 20))
        out.append(t)
    base = words(r, 120).split()
    for _ in range(100):
        x = list(base)
        x[r.randint(0, 119)] = words(r, 1)
        out.append(" ".join(x))
    return out + out[:20] + ["Re " * 200, "Re " * 180 + "x", "", None, "é" * 300, "a" * 39, "漢" * 100]


def brute_repeats(bodies, least):
    seen = collections.Counter(b[i : i + least] for b in bodies for i in range(len(b) - least + 1))
    out = []
    for b in bodies:
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                change[i] += 1
                change[i + least] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        out.append((np.frombuffer(b, np.uint8)[~gone].tobytes(), int(gone.sum()), spans))
    return out


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(25):
        contexts = [bytes(r.choice(b"ab") for _ in range(r.randint(12, 60))) for _ in range(r.randint(1, 12))]
        seen = collections.Counter(c[i : i + 12] for c in contexts for i in range(len(c) - 11))
        assert [h.tolist() for h in suffix_dedup.repeated_windows(contexts, suffix_dedup.Units(12, 4))] == [[seen[c[i : i + 12]] > 1 for i in range(len(c) - 11)] for c in contexts]
    text = np.array([r.randint(0, 3) for _ in range(300)], np.int16)
    order = suffix_dedup.suffix_array(text)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("key_contexts", [128, 4])
def test_repeats_are_exact(spark, key_contexts):
    rows = texts(3)
    bodies = [(t or "").encode() for t in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {bytes(r.tid): (bytes(r.kept), r.n_removed, r.n_spans) for r in suffix_dedup.removed(suffix_dedup.with_body(df).select("tid", "body"), suffix_dedup.Units(64, 16), None, key_contexts).collect()}
    copies = collections.Counter(bodies)
    for body, want in zip(bodies, brute_repeats(bodies, 64), strict=True):
        have = got.get(hashlib.sha256(body).digest()[:16], (body, 0, 0))
        if copies[body] > 1 and len(body) >= 64:
            have = (b"", len(body), 1)
        assert have == want


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rows = texts(4, 30) + [" ".join(t or "" for t in texts(5, 20))]
    bodies = [(t or "").encode() for t in rows]
    import pyarrow as pa

    whole, units = {}, suffix_dedup.Units(64, 16)
    for piece in (500, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        found = set()
        for data, ends, of, offsets in suffix_dedup.chunks(pa.array(bodies, pa.binary()), units):
            first, last, at, _ = suffix_dedup.runs(data, ends, units)
            k = np.searchsorted(ends, first, side="right")
            begin = np.concatenate([[0], ends[:-1]])[k]
            for a, z, p, o, s, b in zip(first, last, at, of[k], offsets[k], begin, strict=True):
                found |= {(int(o), int(x - b + s), int(p - b + s)) for x in range(a, z + 1)}
        whole[piece] = found
    assert whole[500] == whole[1 << 20]  # each window has the same anchor
    assert len(whole[500]) == sum(max(0, len(b) - 63) for b in bodies)


def test_without_repeats_keeps_columns(spark):
    rows = [(1, "x" * 100 + "abc", "k", None), (1, "x" * 100 + "abc", "k", 3), (2, None, "k", 1), (None, "short", "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid string, n_chars long")
    got = suffix_dedup.without_repeats(df, 64)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.tid, r.n_chars) for r in got.collect()) == [("1", "", "k", 0), ("1", "", "k", 0), ("2", None, "k", None), ("None", "short", "z", 5)]
    assert suffix_dedup.without_repeats(df.limit(0), 64).count() == 0


def test_op6_at_400_bytes(spark, tmp_path, monkeypatch):
    r = random.Random(21)
    passages = [words(r, 200) for _ in range(3)]
    short = " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60))  # over 50 words, below 400 bytes
    rows = [words(r, r.randint(0, 90)) + " " + r.choice(passages)[r.randint(0, 500) :] + words(r, r.randint(0, 60)) for _ in range(60)]
    base = words(r, 400).split()
    for _ in range(90):  # a group of near copies: anchors with many contexts
        x = list(base)
        for _ in range(r.randint(1, 3)):
            x[r.randint(0, 399)] = words(r, 1)
        rows.append(" ".join(x))
    rows += [f"{words(r, 5)} {short} {words(r, 9)}" for _ in range(3)] + rows[:5] + [None, "", "é" * 500, "x" * 900, "x" * 399, "y" * 400, "y" * 400]
    df = spark.createDataFrame([(i if i % 9 else None, t, "a", 1, "b") for i, t in enumerate(rows)], "doc_id long, text string, body string, n_bytes int, tid string")
    bodies = [(t or "").encode() for t in rows]
    seen = collections.Counter(w for t in rows for w in {tuple(p[i : i + 51]) for p in [(t or "").split()] for i in range(len(p) - 50)})
    want = []
    for i, (b, (kept, n, spans)) in enumerate(zip(bodies, brute_repeats(bodies, 400), strict=True)):
        want.append((str(i if i % 9 else None), len(b), n, spans, hashlib.sha256(kept).hexdigest()))
    for key_contexts in (128, 4):
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        monkeypatch.setattr(suffix_dedup.removed, "__defaults__", (suffix_dedup.BYTES, None, key_contexts))
        got = suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()
        assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted(want)
    by = {x.doc_id: x for x in got}
    for i, t in enumerate(rows):
        p = (t or "").split()
        if i % 9 and rows.count(t) == 1:
            gone = {j for k in range(len(p) - 50) if seen[tuple(p[k : k + 51])] > 1 for j in range(k, k + 51)}
            assert by[i].n_passage_words == len(gone)
    assert any(x.n_passage_words and not x.n_removed for x in got)
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect() == []


def test_word_codes():
    r = random.Random(23)
    text = b"".join(r.choice([b" ", b"\n", b"\t ", b"a", b"b", b"ab", "é".encode(), b"x" * 40]) for _ in range(4000)) + b"z" * 900
    whole = suffix_dedup.word_codes(np.frombuffer(text, np.uint8))
    split = text.split()
    assert len(whole) == len(split) and len(set(zip(split, whole.tolist(), strict=True))) == len(set(split)) == len(set(whole.tolist()))
    for block in (1, 7, 300):
        assert (suffix_dedup.word_codes(np.frombuffer(text, np.uint8), block) == whole).all()
    assert [len(suffix_dedup.word_codes(np.frombuffer(t, np.uint8))) for t in (b"", b" ", b"a", b" a ", b"a\x1cb")] == [0, 0, 1, 1, 1]


def test_merging_sorted_arrays():
    r = random.Random(22)
    for _ in range(50):
        runs = [sorted({bytes([r.randint(0, 3)]) * 15 + bytes([r.randint(0, 3)]) for _ in range(r.randint(0, 9))}) for _ in range(r.randint(2, 7))]
        n = collections.Counter(x for run in runs for x in run)
        arrays, owners, done = [], [], 0
        for run in runs:
            arrays.append((np.array(run, "S16"), np.arange(done, done + len(run))))
            owners += run
            done += len(run)
        found = []
        while len(arrays) > 1:
            arrays = [suffix_dedup.merged(*arrays[i : i + 2], found) if i + 1 < len(arrays) else arrays[i] for i in range(0, len(arrays), 2)]
        assert sorted(k for f in found for k in f.tolist() if k >= 0) == [k for k, x in enumerate(owners) if n[x] > 1]
        assert (arrays[0][0] == np.array(sorted(n), "S16")).all()


def brute_fingerprint(text):
    w = [x.encode() for x in "".join(c.lower() if c.isascii() else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_masks_cover_every_difference():
    masks = simhash.covering_masks(list(range(64)), 3)
    for k in (1, 2, 3):
        assert all(any(sum(1 << b for b in c) & m == 0 for m in masks) for c in itertools.combinations(range(64), k))
    free = [b for b in range(64) if not masks[0] >> b & 1]
    finer = simhash.covering_masks(free, 3)
    assert all(any(sum(1 << b for b in c) & m == 0 for m in finer) for c in itertools.combinations(free, 3))


def test_op10(spark, odd_texts, tmp_path):
    r = random.Random(8)
    rows = list(odd_texts) + [(100 + i, t) for i, t in enumerate(texts(6, 60))]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, fp int")
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [simhash.fingerprint(t) for _, t in rows] == fps
    root = brute_components(fps, 3)
    least = {}
    for (i, _), k in zip(rows, root, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    import pyspark.sql.functions as F

    for bucket in (256, 3):
        simhash_links = simhash.links
        try:
            simhash.links = lambda d, radius, b=bucket: simhash_links(d, radius, b)
            got = simhash.near_duplicates(df.withColumn("digest", F.lit(0).cast("long"))).collect()
        finally:
            simhash.links = simhash_links
        assert sorted((str(x.doc_id), x.fp % 2**64, str(x.component_id)) for x in got) == sorted((str(i), f, str(least[k])) for (i, _), f, k in zip(rows, fps, root, strict=True))
    assert r


def test_views_join_what_any_view_joins(spark):
    import pyspark.sql.functions as F

    r = random.Random(9)
    pool = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(400)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(500 + i, " ".join([*w[:k], "changed", *w[k + 1 :]])) for i, (_, t) in enumerate(rows[:60]) for w in [t.split()] for k in [r.randint(0, len(w))]]
    rows += [(900 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(None, rows[3][1]), (None, None)]
    views = 3
    fps = [simhash.views_of(t, views) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True)):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.monotonically_increasing_id())
    got = simhash.near_duplicates(df, 3, views).collect()
    heads = {}
    for x in got:
        heads.setdefault(x.head, []).append(str(x.doc_id))
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(find(i), []).append(str(d))
    assert sorted(map(sorted, heads.values())) == sorted(map(sorted, want.values()))
    assert sorted(str(x.doc_id) for x in simhash.one_of_each(df.drop("digest"), 3, views).collect()) == sorted(min(v, key=lambda d: (d == "None", int(d) if d != "None" else 0)) for v in want.values())


def test_components_by_rounds_and_by_one_task(spark):
    r = random.Random(31)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(r.randint(200, 330), r.randint(200, 330)) for _ in range(90)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e} | {999})
    root = {x: x for x in nodes}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    n, e = spark.createDataFrame([(x, 5000 - x) for x in nodes], "node long, label long"), spark.createDataFrame(edges, "a long, b long")
    for finish in (500_000, 20):
        got = simhash.components(n, e, finish).collect()
        least = {}
        for x in nodes:
            least[root[x]] = min(5000 - x, least.get(root[x], 5000))
        assert {x.node: x.least for x in got} == {x: least[root[x]] for x in nodes}
        assert len({x.head for x in got}) == len(set(root.values()))


def test_dense_buckets(spark):
    r = np.random.default_rng(2)
    low = np.unique(r.integers(0, 2**14, 3000, dtype=np.uint64))
    want = brute_components([int(x) for x in low[:400]], 3)
    for a, b in (simhash.links_among(low[:400], 3), simhash.links_by_listing(low[:400], 2**14 - 1, 3)):
        root = {int(x): int(x) for x in low[:400]}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            old, new = max(root[x], root[y]), min(root[x], root[y])
            root = {k: new if v == old else v for k, v in root.items()}
        first = {}
        assert [first.setdefault(root[int(x)], i) for i, x in enumerate(low[:400])] == want
        assert len(a) == 400 - len(set(want))


def test_one_of_each(spark, odd_texts):
    df = spark.createDataFrame([(*x, "l") for x in odd_texts], "doc_id long, text string, _digest string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    fps = [simhash.fingerprint(t) for _, t in odd_texts]
    root = brute_components(fps, 3)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(min((i for (i, _), k in zip(odd_texts, root, strict=True) if k == c and i is not None), default=None)) for c in set(root))
    assert simhash.one_of_each(df.limit(0)).count() == 0


BAD, GOOD = ["scum", "moron", "loser"], ["tree", "house", "river", "cloud", "stone", "bird"]


def labelled(seed, n):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.2)
        w = [r.choice(GOOD) + r.choice(["", "s", "ly"]) for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(2, 5) if toxic else 0):
            w.insert(r.randint(0, len(w)), r.choice([*BAD, "vequ" + r.choice("abcdefgh")]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(r.random() < 0.8), toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, odd_texts):
    docs, labels = labelled(1, 900)
    more = [(10_000 + i, t) for i, (_, t) in enumerate(docs[600:])] + [(None, None), (20_000, ""), (20_000, "scum moron loser " * 4000)]
    d = spark.createDataFrame([(*x, "c", None) for x in docs[:600] + more], "doc_id long, text string, lang string, n_chars long")
    lab = spark.createDataFrame(labels[:600] + [labels[0], (3, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, lab)
    got = {r.doc_id: r for r in toxicity.judge(d, chain).collect()}
    truth = {10_000 + i: t for i, (_, _, t) in enumerate(labels[600:])}
    assert np.mean([got[k].is_toxic == bool(t) for k, t in truth.items()]) >= 0.97
    assert not got[None].is_toxic
    assert toxicity.judge(d.limit(0), chain).count() == 0
    odd = d.toDF("doc_id", "text", "is_toxic", "p_toxic")
    left = toxicity.without_toxic(odd, chain)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in toxicity.judge(d, chain).collect() if not r.is_toxic)
    assert {r.is_toxic for r in left.collect()} == {"c"}
    none = toxicity.train(d, lab.limit(0))
    assert not any(r.is_toxic for r in toxicity.judge(d.limit(20), none).collect())


def test_later_models_see_out_of_fold_predictions():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3)).astype(np.float32)
    first = (x[:, 0] + 0.3 * r.normal(size=600) > 0).astype(float)
    second = first * (x[:, 1] > 0)
    weights, held_out = toxicity.fit_chain(x, np.column_stack([first, second]), np.arange(600) % 5)
    assert [len(w) for w in weights] == [4, 5]
    inside = toxicity.sigmoid(np.column_stack([x, np.ones(600)]) @ weights[0])
    assert not np.allclose(inside, held_out[:, 0]) and np.corrcoef(inside, held_out[:, 0])[0, 1] > 0.99
    assert weights[1][3] > 0  # the earlier category speaks for the later one


def test_chain_against_plain_gradient_descent():
    """The same chain written out: penalised logistic loss minimised by many small steps, fold by fold."""
    r = np.random.default_rng(7)
    n = 200
    x = r.normal(size=(n, 2))
    labels = np.column_stack([(x[:, 0] + r.normal(size=n) > 0).astype(float), (x[:, 0] + x[:, 1] + r.normal(size=n) > 0).astype(float)])
    labels[:20, 0] = np.nan
    folds = np.arange(n) % toxicity.FOLDS

    def fitted(a, y):
        w, penalty = np.zeros(a.shape[1]), np.array([0.3] * (a.shape[1] - 1) + [1e-6])
        for _ in range(6000):
            w -= (a.T @ (1 / (1 + np.exp(-a @ w)) - y) + penalty * w) / len(y)
        return w

    want, earlier = [], np.zeros((n, 0))
    for j in range(2):
        a, y = np.column_stack([x, earlier, np.ones(n)]), labels[:, j]
        known = ~np.isnan(y)
        want.append(fitted(a[known], y[known]))
        out = np.zeros(n)
        for k in range(toxicity.FOLDS):
            out[folds == k] = 1 / (1 + np.exp(-a[folds == k] @ fitted(a[known & (folds != k)], y[known & (folds != k)])))
        earlier = np.column_stack([earlier, out])
    weights, held_out = toxicity.fit_chain(x.astype(np.float32), labels, folds)
    assert all(np.allclose(a, b, atol=0.03) for a, b in zip(weights, want, strict=True))
    assert np.allclose(held_out, earlier, atol=0.01)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= before and all(len(r.text) == r.n_chars for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_views_of_texts_with_few_long_words():
    r = random.Random(5)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(3000)]
    found = {6: 0, 16: 0}
    for _ in range(300):
        w = [r.choice(pool) for _ in range(60)]
        x = [*w[:30], "zz", *w[31:]]  # shingles of five words: 51 of 61 are shared
        for views in found:
            found[views] += any((a ^ b).bit_count() <= 3 for a, b in zip(simhash.views_of(" ".join(w), views), simhash.views_of(" ".join(x), views), strict=True))
    assert found[6] < 150 and found[16] > 240
    # A pair across a bound of the number of long words has views of one kind in common.
    for n in (simhash.FEW_WORDS, 2 * simhash.FEW_WORDS):
        w = ["longword" + "abcdefgh"[k % 8] + "ijklmnop"[k // 8] for k in range(n)] + [r.choice(pool) for _ in range(100)]
        a, b = (simhash.views_of(" ".join(t), 16) for t in (w, w[1:]))
        assert sum(x != a[0] and y != b[0] for x, y in zip(a[1:], b[1:], strict=True)) >= 5


def test_one_of_each_keeps_what_is_not_similar(spark):
    r = random.Random(11)
    pool = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(300)]
    rows = []
    for k in range(12):
        w = [r.choice(pool) for _ in range(80)]
        rows.append((100 * k, " ".join(w)))
        for n in range(1, 9):  # up to eight words changed: similarity 0.9 down to about 0.35
            x = list(w)
            for i in r.sample(range(80), n):
                x[i] = r.choice(pool)
            rows.append((100 * k + n, " ".join(x)))
        w.sort()
        rows.append((100 * k + 50, " ".join(w)))  # the same words in another order
    rows += [(5000, rows[0][1]), (5000, rows[0][1]), (None, rows[0][1]), (5001, None), (5002, ""), (5003, "one two"), (5004, "One  two")]
    df = spark.createDataFrame([(*x, "l") for x in rows], "doc_id long, text string, lang string")
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    want = {}
    root = list(range(len(rows)))
    linked = simhash.near_duplicates(df.selectExpr("doc_id", "text", "xxhash64(text) as digest"), 3, 16).collect()
    head = {x.doc_id: x.head for x in linked}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if head[rows[i][0]] == head[rows[j][0]] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    for (i, _), k in zip(rows, root, strict=True):
        want[k] = min((x for x in (want.get(k), i) if x is not None), default=None)
    got = simhash.one_of_each(df, 3, 16, 0.8)
    assert got.columns == df.columns
    assert sorted(str(x.doc_id) for x in got.collect()) == sorted(map(str, want.values()))
    # In small blocks too what goes is connected to what stays, and no two that stay for each other's group are missed next to each other.
    some = {x.doc_id for x in simhash.one_of_each(df, 3, 16, 0.8, 2).collect()}
    assert set(want.values()) <= some and len(some) <= len(want) + 12
    assert {100 * k + 50 for k in range(12)} <= set(want.values())
    assert len(want) > len({x.head for x in linked})
    assert simhash.one_of_each(df.limit(0), 3, 16, 0.8).count() == 0


def test_many_near_copies_are_one_group(spark):
    import pyspark.sql.functions as F

    r = random.Random(13)
    pool = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    base = [r.choice(pool) for _ in range(100)]
    sets = [base, *([*base[:k], f"x{n}", *base[k + 1 :]] for n in range(300) for k in [r.randint(0, 99)])]
    sets += [[r.choice(pool) for _ in range(100)] for _ in range(40)]  # unlike all others, in the same component
    rows = [(1, i, simhash.shingle_set(" ".join(t)).tobytes()) for i, t in enumerate(sets)] + [(2, 900, b""), (2, 901, b""), (3, 950, b"")]
    df = simhash.written(spark.createDataFrame(rows, "head long, node long, shingles binary"))
    for block in (256, 16):
        links = simhash.grouped_by_similarity(df, 0.8, block)
        parts = simhash.components(df.select("node", F.col("node").alias("label")), links).collect()
        heads = collections.Counter(x.head for x in parts)
        assert sorted(heads.values()) == [1] * 41 + [2, 301]


def test_links_of_texts_that_do_not_stand(spark):
    import pyspark.sql.functions as F

    # Chains: each text is alike to the next alone, and in random blocks others stand for it before it meets its next one.
    rows = [(1, i, np.arange(10 * i, 10 * i + 100, dtype="<u8").tobytes()) for i in range(0, 120)]
    rows += [(2, 1000 + i, np.arange(10**6 + 12 * i, 10**6 + 12 * i + 100, dtype="<u8").tobytes()) for i in range(120)]  # 88 of 112: not alike
    # Stars of unequal sizes, joined by outer members alone; 80 of 100 is the very threshold.
    for k in range(6):
        base = np.arange(10**7 * (k + 1), 10**7 * (k + 1) + 100, dtype="<u8")
        rows += [(3, 2000 + 100 * k + i, np.concatenate([base[:i], base[i + 1 :], [10**9 + 100 * k + i]]).astype("<u8").tobytes()) for i in range(40)]
        rows += [(3, 2090 + 100 * k, base[:80].tobytes()), (3, 2091 + 100 * k, base[:64].tobytes()), (3, 2092 + 100 * k, base[:52].tobytes()), (3, 2093 + 100 * k, base[:41].tobytes())]
    rows += [(4, 5000, b""), (4, 5001, b""), (4, 5002, b""), (4, 5003, base[:7].tobytes())]
    df = simhash.written(spark.createDataFrame(rows, "head long, node long, shingles binary"))
    sets = [(h, n, set(np.frombuffer(x, "<u8").tolist())) for h, n, x in rows]
    root = {n: n for _, n, _ in sets}
    for (h, a, x), (g, b, y) in itertools.combinations(sets, 2):
        if h == g and root[a] != root[b] and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    assert len(set(root.values())) > 120
    for block in (8, 1000):
        links = simhash.grouped_by_similarity(df, 0.8, block)
        parts = simhash.components(df.select("node", F.col("node").alias("label")), links)
        assert {x.node: x.least for x in parts.collect()} == root


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, is_toxic string, digest string, tid string, c0 int, head string, n int"


def test_pipeline_on_odd_rows(spark, odd_texts):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    long_one = words(random.Random(14), 900)
    texts_in = [*odd_texts, (None, None), (77, long_one), (78, "a b " + long_one[:600]), (79, "y " * 30_000)]
    rows = [(i, t, "en", "s", None if t is None else len(t), "keep", "d", None, 3, "h", k) for k, (i, t) in enumerate(texts_in)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, ODD_COLUMNS)
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = {(x.doc_id, x.n) for x in now.collect()}
            now = corpus_pipeline.written(stage(spark, now, sf))
            after = now.collect()
            assert now.columns == docs.columns and {(x.doc_id, x.n) for x in after} <= before
            assert all(x.is_toxic == "keep" and x.tid is None and x.digest == "d" and x.c0 == 3 and x.head == "h" for x in after)
            assert all((x.text is None) == (x.n_chars is None) and (x.text is None or len(x.text) == x.n_chars) for x in after)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
        assert {x.doc_id for x in packed} == {x.doc_id for x in now.collect()}
        if frame is docs:
            kept = now.collect()
            assert sorted(str(x.doc_id) for x in kept if x.doc_id in (1, 5, 6)) == ["1", "5"]  # copies and repeated rows: one of each
            assert sum(x.text is None or not x.text.strip() for x in kept if x.doc_id in (2, 3, 4, None)) == 1
        else:
            assert packed == []


def test_passages_are_judged_in_words(spark):
    r = random.Random(12)

    def say(n, longest=3):
        return ["".join(r.choice("abcdefghijklé") for _ in range(r.randint(1, longest))) for _ in range(n)]

    passage, short, wide = say(51), say(50, 12), say(400)  # 51 words of about 150 bytes; 50 words of about 380
    texts = [[*say(30, 9), *passage, *say(20, 9)], [*say(5, 9), *passage, *say(70, 9)], [*say(9, 9), *short, *say(9, 9)], [*say(3, 9), *short, *say(4, 9)]]
    texts += [wide[:250], [*say(3, 9), *wide[120:]], [*say(8, 9), *passage], wide[:60], wide[:60], say(50), ["re"] * 90, ["re"] * 50]
    rows = [(i, "  ".join(t) + "\n" if i % 2 else " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, " ")]
    seen = collections.Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n_chars long")
    got = {x.doc_id: x for x in suffix_dedup.without_repeats(df, words=51).collect()}
    for i, t in enumerate(texts):
        gone = {j for k in range(len(t) - 50) if seen[tuple(t[k : k + 51])] > 1 for j in range(k, k + 51)}
        assert got[i].text.split() == [w for j, w in enumerate(t) if j not in gone]
        assert got[i].n_chars == len(got[i].text)
    assert got[0].text.split() == texts[0][:30] + texts[0][81:] and got[2].text == rows[2][1]
    assert (got[90].text, got[91].text, got[92].text) == (None, "", " ")
    assert suffix_dedup.without_repeats(df.limit(0), words=51).count() == 0


def test_links_of_later_tables_join_only_parts(spark):
    """Tables solved in two steps, the later ones between parts alone, connect what all tables connect at once."""
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 3))) for c in centres for _ in range(60)}
    signed = sorted({(v, f - (1 << 64) if f >> 63 else f) for f in fps for v in range(2)})
    nodes = simhash.written(spark.createDataFrame(signed, "view long, fp long"))

    def joined(pairs, start):
        root = dict(start)
        for v, a, b in pairs:
            x, y = root[v, a], root[v, b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
        return root

    alone = {n: i for i, n in enumerate(signed)}
    whole = joined([tuple(r) for r in simhash.links(nodes).collect()], alone)
    first = joined([tuple(r) for r in simhash.links(nodes, some=slice(2)).collect()], alone)
    parted = simhash.written(spark.createDataFrame([(*n, p) for n, p in first.items()], "view long, fp long, part long"))
    later = [tuple(r) for r in simhash.links(parted, some=slice(2, None)).collect()]
    assert all(first[v, a] != first[v, b] for v, a, b in later)
    assert joined(later, first) == whole
