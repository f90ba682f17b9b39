"""SimHash near-duplicates by covering locality-sensitive hashing (operator 10).

A fingerprint has 64 bits; two documents are linked if theirs differ in at most RADIUS
bits, and components are what links connect. Structured masks (a covering family): bit i
has a vector m(i) of RADIUS + 1 bits, and for each of the 2^(RADIUS+1) - 1 nonzero vectors
v the mask of v keeps the bits with an odd product of m(i) and v. For any difference of
at most RADIUS bits some nonzero v is orthogonal to all their vectors, so its mask leaves
them out and the pair has equal masked values in the table of v: no pair is missed, by construction.

Equal fingerprints are one representative before anything else, so copies cost nothing.
Within a table's bucket, pairs of distinct fingerprints are compared and only a spanning
forest of the links leaves the task, without those pairs that an earlier table connects. A bucket of more than BUCKET fingerprints
(known from a count) is dealt anew by the covering masks of its free bits (half the
fingerprint), which makes buckets whose members agree in at least 48 bits; those hold at
most 2^16 fingerprints, and the largest of them are solved by listing each member's
neighbours within the radius. No bucket is capped.

With several views (views_of) a text has further fingerprints, of its distinct words under
different hashes, and is linked to what is within the radius in any view. The query uses one.
Then the first tables' links are joined to components of texts before the other tables are solved, which
tell only links between different components: a group of near copies is told once, not in every table of every view.

With a similarity (one_of_each) links are only candidates: a component's distinct texts are dealt over blocks
of at most BLOCK or so, where every pair is judged by the exact Jaccard similarity of its shingle sets. Texts
that pairs connect are one group, and the one of them with most partners stands for it when those that still
stand are dealt anew, until a component has one block or dealing joins next to nothing any more. So a group of many near
copies costs in proportion to its size. A component of up to BLOCK texts is judged pair by pair; in larger ones texts of groups
that are still apart, whether they stand or not, are then compared over every pair of blocks, so no link is missed.

Components: edges and maps stay in tables; each round contracts them by a share, until one task can hold them.

Defined cases: a null or empty text (no words) has fingerprint zero and is linked like any
other; with fewer than three words the whole sequence is the one shingle; a long text is
read whole; rows that repeat a doc_id are kept as rows; a null doc_id keeps its fingerprint
and takes part, and a component of nulls alone has a null id; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import ship
from lodestar.llm.common import Scratch, hold, lead_columns, shuffle_partitions, table, written

SHINGLE = 3
SEED = 42
RADIUS = 3
LONG_WORD = re.compile(rb"[a-z\x80-\xff]{7,}")
FEW_WORDS = 16
LONG_VIEWS = 5  # further views of long words; those after them are of all words
SIMILAR_SHINGLE = 5  # words of a shingle by which similarity is judged
BLOCK = 256  # texts of a component that are compared with as many others in one task
BUCKET = 256  # fingerprints that one bucket holds before it is dealt anew
FINISH = 500_000  # edges that one task joins
FIRST_TABLES = 5  # with several views: tables whose links are joined before the other tables tell theirs


def fingerprint(text: str | None, words_in: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 majority bits of the hashes of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_in:
        return h(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words_in] + 1]).tolist()
    return majority(np.array([h(line[a:b], seed) for a, b in zip(starts, ends[words_in - 1 :].tolist(), strict=True)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def views_of(text: str | None, views: int) -> list[int]:
    """The fingerprint, and views - 1 more: majorities of different hashes of the text's distinct words.

    A changed word changes three shingles but one word, so texts that are alike but not equal
    come closer. LONG_VIEWS views are of long words, as common short words, which all texts share,
    say little; those after them are of all words, for texts with few long ones. Texts with
    FEW_WORDS to twice as many long words have both, so a pair across either bound shares a kind.
    A view that a text has not is its fingerprint.
    """
    from xxhash import xxh64_intdigest as h

    out = [fingerprint(text)] * views
    if views == 1:
        return out
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    long_words = set(LONG_WORD.findall(raw))
    kinds = []
    if len(long_words) >= FEW_WORDS:
        kinds.append((long_words, range(1, min(views, LONG_VIEWS + 1))))
    if len(long_words) < 2 * FEW_WORDS:
        kinds.append((set(raw.split()), range(LONG_VIEWS + 1, views)))
    for words, places in kinds:
        base = np.array([h(w, SEED) for w in words], "<u8")
        for k in places if len(base) else ():
            z = base + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[k] = majority(z ^ (z >> np.uint64(31)))
    return out


def fingerprints(docs: DataFrame, views: int = 1) -> DataFrame:
    """doc_id, digest and fps (each view's bits as a signed long) of each row of docs(doc_id, text, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", int)
        for b in batches:
            fps = np.array([views_of(t, views) for t in b.column("text").to_pylist()], np.uint64).reshape(len(b), views)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(list(fps.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "digest", "fps"])

    return docs.select("doc_id", "text", "digest").mapInArrow(run, "doc_id long, digest long, fps array<long>")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit places such that any radius of them are all left out by some mask."""
    dims = radius + 1
    vectors = {b: 1 + i % ((1 << dims) - 1) for i, b in enumerate(bits)}  # m(i), every nonzero vector about equally often
    return [sum(1 << b for b in bits if (vectors[b] & v).bit_count() % 2) for v in range(1, 1 << dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_among(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints (uint64): each is compared once with all not yet reached."""
    rest, out = fps, []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                out.append((np.full(int(near.sum()), x), rest[near]))
                reached += list(rest[near])
                rest = rest[~near]
    return _pairs(out)


def links_by_listing(fps: np.ndarray, free: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As links_among, for fingerprints that differ only in the few bits of free: each one's neighbours are looked up."""
    flips = {0}
    for _ in range(radius):
        flips |= {x ^ 1 << b for x in flips for b in range(64) if free >> b & 1}
    fps = np.sort(fps)
    fresh, out = np.ones(len(fps), bool), []
    while fresh.any():
        front = np.flatnonzero(fresh)[:1]
        fresh[front] = False
        while len(front):
            after = []
            for x in flips - {0}:
                want = fps[front] ^ np.uint64(x)
                at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
                hit = (fps[at] == want) & fresh[at]
                if hit.any():
                    after.append(at[hit])  # one flip leads from distinct members to distinct members
                    fresh[at[hit]] = False
                    out.append((fps[front[hit]], want[hit]))
            front = np.concatenate(after) if after else np.zeros(0, np.int64)
    return _pairs(out)


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)])


BUCKET_OF = ["view", "mask", "key"]


def _solve(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a partition sorted by (view, mask, key): whole buckets, one after another; small ones by offset, all at once."""
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size >= 200_000:
                f = pd.concat(held, ignore_index=True)
                other = np.flatnonzero((f[BUCKET_OF].to_numpy() != f[BUCKET_OF].to_numpy()[-1]).any(1))
                tail = int(other[-1]) + 1 if len(other) else 0
                yield _between(_links(f.iloc[:tail], radius), f)
                held, size = [f.iloc[tail:]], len(f) - tail
        if held:
            f = pd.concat(held, ignore_index=True)
            yield _between(_links(f, radius), f)

    return run


def _between(found: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
    """Of the found links one for each two components of the rows f (column part, if there): those within one say nothing new."""
    if "part" not in f or not len(found):
        return found
    part = f.drop_duplicates(["view", "fp"]).set_index(["view", "fp"])["part"]
    a, b = (part.reindex(pd.MultiIndex.from_frame(found[["view", c]])).to_numpy() for c in "ab")
    ends = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return found[(a != b) & ~ends.duplicated().to_numpy()]


def _links(f: pd.DataFrame, radius: int) -> pd.DataFrame:
    view, mask, key, fps = (f[c].to_numpy(np.int64).view(np.uint64) for c in (*BUCKET_OF, "fp"))
    start = np.concatenate([[True], (view[1:] != view[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]) if len(f) else np.zeros(0, bool)
    bucket = np.cumsum(start)
    first = np.flatnonzero(start)
    sizes = np.diff(np.append(first, len(f)))
    a, b, of, by = [], [], [], []
    top = int(sizes.max()) if len(sizes) else 0
    for d in range(1, min(top, 9)):  # neighbours at each distance inside small buckets
        i = np.arange(len(f) - d)
        i = i[bucket[d:] == bucket[:-d]]
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        a.append(fps[i])
        b.append(fps[i + d])
        of.append(view[i])
        by.append(mask[i])
    for k in np.flatnonzero(sizes > 9):
        own = fps[first[k] : first[k] + sizes[k]]
        free = ~int(mask[first[k]]) & (1 << 64) - 1
        found = links_by_listing(own, free, radius) if len(own) > 16 * BUCKET and free.bit_count() <= 20 else links_among(own, radius)
        a.append(found[0])
        b.append(found[1])
        of.append(np.full(len(found[0]), view[first[k]]))
        by.append(np.full(len(found[0]), mask[first[k]]))
    none = np.zeros(0, np.uint64)
    a, b, of, by = (np.concatenate([none, *x]) for x in (a, b, of, by))
    mine = first_here(a ^ b, by, radius)
    a, b, of = (x[mine].view(np.int64) for x in (a, b, of))
    return pd.DataFrame({"view": of, "a": np.minimum(a, b), "b": np.maximum(a, b)})


@functools.lru_cache(maxsize=2)
def _tables(radius: int) -> list[tuple[int, list[int]]]:
    """Each mask, and the masks by which its large buckets are dealt anew."""
    masks = covering_masks(list(range(64)), radius)
    return [(m, [m | x for x in covering_masks([b for b in range(64) if not m >> b & 1], radius)]) for m in masks]


def first_here(difference: np.ndarray, mask: np.ndarray, radius: int) -> np.ndarray:
    """Whether a link, found under mask, is in no earlier table: an earlier one connects the pair, so it is told only once."""
    out = np.ones(len(difference), bool)
    seen = np.zeros(len(difference), bool)
    for m, finer in _tables(radius):
        here = ~seen & (difference & np.uint64(m) == 0)
        seen |= here
        inside = mask & np.uint64(m) == np.uint64(m)
        out &= ~here | inside
        deeper = here & inside & (mask != np.uint64(m))
        for x in finer if deeper.any() else ():
            hit = deeper & (difference & np.uint64(x) == 0)
            out[hit & (mask != np.uint64(x))] = False
            deeper &= ~hit
    return out


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, some: slice = slice(None)) -> DataFrame:
    """view, a, b: links a < b that connect what all links of distinct(view, fp) connect in each view. distinct: a written table.

    some: the tables to look into, of all. With a column part, which earlier tables' links have joined, only links between different parts.
    """
    spark = distinct.sparkSession
    tables = _tables(radius)[some]
    own = [c for c in distinct.columns if c == "part"]
    dealt = distinct.select("view", "fp", *own, F.explode(F.array(*(F.lit(_signed(m)) for m, _ in tables))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    # A bucket of one part alone has nothing to tell.
    worth = F.min("part") != F.max("part") if own else F.count("*") > 1
    sizes = dealt.groupBy(*BUCKET_OF).agg(F.count("*").alias("n"), worth.alias("worth")).where("worth").drop("worth")
    shared = written(dealt.join(sizes, BUCKET_OF))
    finer = F.lit(None)
    for m, deeper in tables:
        finer = F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(x)) for x in deeper))).otherwise(finer)
    small = shared.where(F.col("n") <= bucket).select(*BUCKET_OF, "fp", *own)
    large = shared.where(F.col("n") > bucket).select("view", "fp", *own, F.explode(finer).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    both = small.unionByName(large.select(*BUCKET_OF, "fp", *own))
    n = shuffle_partitions(spark)
    return both.repartition(n, *BUCKET_OF).sortWithinPartitions(*BUCKET_OF, "fp").mapInPandas(_solve(radius), "view long, a long, b long").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, to: each node of all the edges and the first node of its component. Roots are hooked to lower ones and paths halved."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = (edges.column(c).to_numpy() for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["node", "to"])


def components(nodes: DataFrame, edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """node, least, head: the smallest label of the nodes that edges(a, b) connect, and one node for each component; nodes(node, label) as given.

    Contraction: each round every node goes to the first of itself and its neighbours in a
    random order of the round, and on to where that one goes; edges go along and those within a
    node end. So nodes and edges shrink by a share each round, chains and stars alike. Once at
    most `finish` edges are left, one task joins their nodes. The rounds' maps are then followed back from the last.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while (n := left.count()) > finish:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("k"), F.col(c).alias("n"))  # noqa: B023,E731
        sides = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = sides.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        step = written(near.select("node", F.least(F.col("m"), order("node"))["n"].alias("to")))
        # Written, so that the joins have a shuffle on either side, which can be split where many nodes go to one.
        told = step.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        maps.append(written(step.join(told, "to").select("node", F.col("beyond").alias("to"))))
        here = lambda c: maps[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        half = written(left.join(here("a"), "a").select("b", "to_a"))
        moved = half.join(here("b"), "b").where("to_a <> to_b")
        left = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if n:
        maps.append(written(left.coalesce(1).mapInArrow(_joined, "node long, to long")))
    if not maps:
        return nodes.select("node", F.col("label").alias("least"), F.col("node").alias("head"))
    final = maps.pop()
    while maps:
        later = final.select(F.col("node").alias("to"), F.col("to").alias("end"))
        final = written(maps.pop().join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
    headed = written(nodes.join(final, "node", "left").select("node", "label", F.coalesce("to", "node").alias("head")))
    least = written(headed.groupBy("head").agg(F.min("label").alias("least")))
    return headed.select("node", "head").join(least, "head").select("node", "least", "head")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, views: int = 1) -> DataFrame:
    """doc_id, digest, fp, component_id, head (one for each component) for each row of docs(doc_id, text, digest).

    With several views documents are linked that are within the radius in any of them.
    """
    made = written(fingerprints(docs, views))
    kinds = written(made.groupBy("fps").agg(F.min("doc_id").alias("label")))
    node = F.col("fp") if views == 1 else F.xxhash64("view", "fp")
    each = kinds.select("fps", "label", F.col("fps")[0].alias("own"), F.posexplode("fps").alias("view", "fp")).where("view = 0 or fp <> own").drop("own").withColumn("view", F.col("view").cast("long")).withColumn("node", node)
    nodes = written(each.groupBy("view", "fp", "node").agg(F.min("label").alias("label"), F.count("*").alias("n")))
    if views == 1:
        parts = components(nodes.select("node", "label"), links(nodes.select("view", "fp"), radius).select("a", "b"))
        told = parts.select(F.array("node").alias("fps"), F.col("least").alias("component_id"), "head")
    else:
        ends = [F.xxhash64("view", c).alias(c) for c in "ab"]
        first = written(links(nodes.select("view", "fp"), radius, some=slice(FIRST_TABLES)).select(*ends))
        known = written(_texts(each, nodes, first, views).select("fps", "head"))
        parted = each.join(known, "fps").groupBy("view", "fp").agg(F.min("head").alias("part"))
        later = written(links(written(parted), radius, some=slice(FIRST_TABLES, None)).select(*ends))
        told = _texts(each, nodes, first.unionByName(later), views)
    return made.join(told, "fps").select("doc_id", "digest", F.col("fps")[0].alias("fp"), "component_id", "head")


def _texts(each: DataFrame, nodes: DataFrame, found: DataFrame, views: int) -> DataFrame:
    """fps, component_id, head: what the links found(a, b) connect, if views of one text belong together."""
    # Views that no other text has need no edge.
    active = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).unionByName(nodes.where("n > 1").select("node"))
    active = written(active.distinct())
    held = each.join(active, "node", "left_semi").groupBy("fps").agg(F.array_sort(F.collect_set("node")).alias("own")).where("size(own) > 1")
    edges = found.unionByName(held.select(F.col("own")[0].alias("a"), F.explode(F.slice("own", 2, views)).alias("b")).distinct())
    parts = components(nodes.select("node", "label"), edges)
    # A text's component is that of any of its active views; without one it is alone.
    first = F.min(F.struct(F.col("act").isNull().alias("alone"), F.col("least").isNull().alias("no"), "least", "head")).alias("m")
    known = parts.join(active.withColumn("act", F.lit(True)), "node", "left")
    linked = each.select("fps", "node").join(known, "node").groupBy("fps").agg(first)
    return linked.select("fps", F.col("m.least").alias("component_id"), F.col("m.head").alias("head"))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of SIMILAR_SHINGLE words; of fewer words the whole is one; none of no words."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    starts = range(max(1, len(words) - SIMILAR_SHINGLE + 1)) if words else ()
    return np.unique(np.array([h(b" ".join(words[i : i + SIMILAR_SHINGLE]), SEED) for i in starts], "<u8"))


def alike(sets: list[np.ndarray], similarity: float, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """(hub, member) for the sets that pairs of the given Jaccard similarity connect; the hub has most partners, of equals the first. Empty sets are equal.

    With groups, one for each set, only pairs of different groups count.
    """
    size = np.array([len(x) for x in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), size)
    _, token, times = np.unique(np.concatenate([np.zeros(0, "<u8"), *sets]), return_inverse=True, return_counts=True)
    common = times[token] > 1
    of, token = of[common], np.unique(token[common], return_inverse=True)[1]
    by = np.argsort(token, kind="stable")
    of, token = of[by], token[by]
    both = np.zeros((len(sets), len(sets)))
    last = int(token[-1]) + 1 if len(token) else 0
    for t in range(0, last, 4096):
        a, b = np.searchsorted(token, [t, t + 4096])
        has = np.zeros((len(sets), min(4096, last - t)), np.float32)
        has[of[a:b], token[a:b] - t] = 1
        both += has @ has.T
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    if groups is not None:
        near &= np.not_equal.outer(np.array(groups), np.array(groups))
    partners = near.sum(1)
    fresh, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not fresh[i]:
            continue
        fresh[i] = False
        group, k = [i], 0
        while k < len(group):
            hit = np.flatnonzero(near[group[k]] & fresh)
            fresh[hit] = False
            group += hit.tolist()
            k += 1
        hub = max(sorted(group), key=lambda j: partners[j])
        out += [(hub, j) for j in group if j != hub]
    return out


def _compare(similarity: float):
    def solved(held: list[tuple[int, bytes, int | None]]) -> pa.RecordBatch:
        nodes, sets, groups = zip(*held, strict=True)
        pairs = alike([np.frombuffer(x, "<u8") for x in sets], similarity, None if groups[0] is None else groups)
        return pa.RecordBatch.from_pydict({k: pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i, k in enumerate("ab")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition sorted by (head, i, j, node): one block, or pair of blocks, after another."""
        held: list[tuple[int, bytes, int | None]] = []
        at = None
        for b in batches:
            for *key, node, shingles, group in zip(*(b.column(c).to_pylist() for c in ("head", "i", "j", "node", "shingles", "group")), strict=True):
                if key != at and held:
                    yield solved(held)
                    held = []
                at = key
                held.append((node, shingles, group))
        if held:
            yield solved(held)

    return run


def _judged(dealt: DataFrame, similarity: float) -> DataFrame:
    """a, b: links in each block (head, i, j) of dealt(head, i, j, node, shingles, group); group is null, or links are between groups."""
    n = shuffle_partitions(dealt.sparkSession)
    places = ["head", "i", "j"]
    return written(dealt.select(*places, "node", "shingles", "group").repartition(n, *places).sortWithinPartitions(*places, "node").mapInArrow(_compare(similarity), "a long, b long"))


def grouped_by_similarity(sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all alike texts of each component. sets(head, node, shingles): a written table.

    A component of one block is compared whole. In larger ones rounds over random blocks make groups, for each of which one
    text stands in the next round, until hardly any more meet; then between_groups finds what links of others than those that stood were not met.
    """

    def with_blocks(level: DataFrame) -> DataFrame:
        sizes = written(level.groupBy("head").agg(F.count("*").alias("m")).where("m > 1"))
        return level.join(sizes, "head").withColumn("blocks", F.ceil(F.col("m") / block))

    whole = with_blocks(sets)
    level, out, turn = whole, None, 0
    while True:
        dealt = level.withColumn("i", F.expr(f"pmod(xxhash64(node, {turn}), blocks)")).withColumns({"j": F.lit(0).cast("long"), "group": F.lit(None).cast("long")})
        found = _judged(dealt, similarity)
        out = found if out is None else out.unionByName(found)
        several = level.where("blocks > 1").select("head", "node", "shingles")
        standing = written(several.join(found.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("head", "node", "shingles"))
        before, after = several.count(), standing.count()
        if not before and not turn:
            return out
        level, turn = with_blocks(standing), turn + 1
        if not after or after > 0.9 * before:
            break
    return out.unionByName(between_groups(whole.where("blocks > 1").select("head", "node", "shingles"), out, similarity, block))


def between_groups(sets: DataFrame, found: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: links between texts of one component that found(a, b) leaves in different groups; together they connect all that are alike.

    Blocks are of texts of about one size, as alike sets differ by the similarity at most in size; a group of a block or more
    has blocks of its own. Every pair of blocks of neighbouring sizes is compared, but for those of one group: no text stands for another.
    """
    group = components(sets.select("node", F.col("node").alias("label")), found).select("node", F.col("head").alias("group"))
    # Slightly wide, so that rounding puts no two sizes of the very ratio two levels apart.
    width = 1e-6 - math.log(similarity)
    size = F.floor(F.log(F.greatest(F.length("shingles") / 8, F.lit(1.0))) / width)
    placed = written(sets.select("head", "node", size.alias("level"), "shingles").join(group, "node"))
    apart = placed.groupBy("head").agg((F.min("group") != F.max("group")).alias("apart")).where("apart").select("head")
    counts = placed.groupBy("head", "level", "group").agg(F.count("*").alias("n")).join(apart, "head")
    counts = written(counts.withColumn("own", F.when(F.col("n") >= block, F.col("group"))))
    piles = written(counts.groupBy("head", "level", "own").agg(F.ceil(F.sum("n") / block).alias("blocks")))
    at = F.xxhash64("level", F.col("own").isNull(), F.coalesce("own", F.lit(0)), "which").alias("at")
    blocks = written(piles.withColumn("which", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("head", "level", "own", at))
    left = blocks.select("head", *(F.col(c).alias(f"{c}_i") for c in ("level", "own", "at")))
    right = blocks.select("head", *(F.col(c).alias(f"{c}_j") for c in ("level", "own", "at")))
    near = "level_j = level_i + 1 or level_j = level_i and at_i <= at_j"
    pairs = left.join(right, "head").where(near).where("own_i is null or own_j is null or own_i <> own_j")
    jobs = pairs.select("head", F.col("at_i").alias("i"), F.col("at_j").alias("j"), F.explode(F.array_distinct(F.array("at_i", "at_j"))).alias("at"))
    of = placed.join(counts.select("head", "level", "group", "own"), ["head", "level", "group"])
    of = of.join(piles.withColumnRenamed("own", "o").withColumnsRenamed({"head": "h", "level": "l"}), (F.col("head") == F.col("h")) & (F.col("level") == F.col("l")) & F.col("own").eqNullSafe(F.col("o")))
    of = written(of.withColumn("which", F.expr("pmod(xxhash64(node), blocks)")).select("head", "node", "shingles", "group", at))
    return _judged(of.join(jobs, ["head", "at"]), similarity)


def confirmed(rows: DataFrame, found: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """doc_id, digest, head as found, but components are of texts linked by a Jaccard similarity that is reached. rows: doc_id, text and digest."""
    several = written(found.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head"))
    member = found.join(several, "head", "left_semi").select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "head").distinct()
    text = F.coalesce("text", F.lit(""))
    # Texts told apart by a 128-bit digest; a node's name is of 64 bits.
    node = F.xxhash64("head", F.md5(text), text)
    told = written(rows.join(member, (rows["digest"] == member["d"]) & rows["doc_id"].eqNullSafe(member["id"])).select("doc_id", "digest", "head", text.alias("text")).withColumn("node", node))
    kinds = written(told.groupBy("node").agg(F.first("head").alias("head"), F.first("text").alias("text")))
    sizes = written(kinds.groupBy("head").agg(F.count("*").alias("m")).where("m > 1").select("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", int)
        for b in batches:
            sets = pa.array([shingle_set(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("head"), b.column("node"), sets], ["head", "node", "shingles"])

    sets = written(kinds.join(sizes, "head").select("head", "node", "text").mapInArrow(run, "head long, node long, shingles binary"))
    pairs = grouped_by_similarity(sets, similarity, block)
    parts = written(components(kinds.select("node", F.col("node").alias("label")), pairs))
    alone = found.join(several, "head", "left_anti").select("doc_id", "digest", "head")
    return alone.unionByName(told.select("doc_id", "digest", "node").join(parts.select("node", "head"), "node").select("doc_id", "digest", "head"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, views: int = 1, similarity: float | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of least doc_id (null last), then of least digest.

    With a similarity, links are candidates and only those stand whose shingle sets reach it. Columns keep their names and values, whatever they are.
    """
    ship(docs.sparkSession)
    names = docs.columns
    # Columns go by place, so that no name can clash.
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    rows = numbered.withColumn("digest", F.xxhash64(*numbered.columns))
    texts = rows.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"), "digest")
    with Scratch() as scratch:
        found = written(near_duplicates(texts, radius, views))
        if similarity is not None:
            found = written(confirmed(texts, found, similarity, block))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("keep")
        keep = scratch.keep(written(found.groupBy("head").agg(first).select(F.col("keep.doc_id").alias("id"), F.col("keep.digest").alias("d"))))
        repeated = not found.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    own = f"c{names.index('doc_id')}"
    kept = rows.join(keep, (rows["digest"] == keep["d"]) & rows[own].eqNullSafe(keep["id"]), "left_semi")
    if repeated:  # rows that repeat in all columns
        kept = kept.dropDuplicates([own, "digest"])
    return kept.drop("digest").toDF(*names)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lead_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    with Scratch() as scratch:
        found = scratch.keep(written(near_duplicates(docs.withColumn("digest", F.lit(0).cast("long")))))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
