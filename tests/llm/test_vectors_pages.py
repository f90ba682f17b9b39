"""Operators 1, 5, 7, 8 and 9."""

import random

import duckdb
import numpy as np
import pytest

from lodestar.llm import chat, html_text, ivfpq, url_filter, voronoi
from lodestar.llm.vectors import ranked, usable

SF = "/root/testdata/sf0.01"


def vectors(spark, n, seed, dims=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows alike
    rows = [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)]
    rows += [(n, None, 0), (n + 1, [float("nan")] * dims, 0), (n + 2, [None, *[1.0] * (dims - 1)], 0), (n + 3, [0.0] * dims, 0), (n + 4, [1.0], 0), (None, [1.0] * dims, 0), (n + 5, [float("inf")] * dims, 0), (n + 6, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int"), x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize(("n", "group"), [(700, 9), (40, 4096), (3, 1)])
def test_voronoi_join_is_exact(spark, n, group):
    df, x = vectors(spark, n, 1)
    got = sorted(map(tuple, ranked(voronoi.nearest_join(usable(df, True), every=7, group=group), 5).collect()))
    ids = [*range(n), n + 3]
    v = np.floor(np.vstack([x, np.zeros((1, x.shape[1]))]) * 256).astype(np.int64)
    want = []
    for a, i in enumerate(ids):
        if i % 7 == 0:
            s = v @ v[a]
            near = sorted((-s[b], j) for b, j in enumerate(ids) if j != i)[:5]
            want += [(i, k + 1, j, int(-t)) for k, (t, j) in enumerate(near)]
    assert got == sorted(want)


def test_voronoi_without_rows(spark):
    df, _ = vectors(spark, 10, 1)
    assert voronoi.nearest_join(usable(df.limit(0), True)).count() == 0
    assert ivfpq.search(usable(df.limit(0), False)).count() == 0


@pytest.mark.parametrize(("n", "group"), [(4, 4096), (60, 2), (1500, 20), (12000, 4096)])
def test_ivfpq_recall(spark, n, group):
    df, x = vectors(spark, n, 2)
    every = 10 if n < 5000 else 50
    got = ranked(ivfpq.search(usable(df, False), every=every, group=group), 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert abs(u[r.query_id] @ u[r.vec_id] - r.score) < 1e-12 and r.query_id != r.vec_id
    queries = range(0, n, every)
    assert set(by) == set(queries)
    hits = []
    for q in queries:
        s = np.delete(u @ u[q], q)
        worst = np.sort(s)[::-1][min(5, n - 1) - 1]
        assert len(by[q]) == min(5, n - 1)
        assert [r for r, _, _ in sorted(by[q])] == list(range(1, len(by[q]) + 1))
        hits += [t >= worst - 1e-12 for _, _, t in by[q]]
        for (_, i, s1), (_, j, s2) in zip(sorted(by[q]), sorted(by[q])[1:], strict=False):
            assert (-s1, i) < (-s2, j)
    assert np.mean(hits) >= 0.9


def test_probed_share_falls_where_lists_tell_rows_apart():
    r = np.random.default_rng(3)
    shares = []
    for rows, clusters in ((400, 20), (8000, 400)):
        centres = r.normal(size=(clusters, 16))
        sample = ivfpq.unit(centres[r.integers(0, clusters, rows)] + 0.1 * r.normal(size=(rows, 16)))
        index = ivfpq.Index(sample)
        shares.append(index.probes / len(index.centres))
    assert shares[1] < shares[0] and shares[1] < 0.3


def brute_top(rows, every, score, k=5):
    """Ranks by hand: every distinct (id, vector) that is asked, against every row of another id."""
    out = []
    for q in {i for i, _ in rows if i % every == 0}:
        asked = {tuple(v) for i, v in rows if i == q}
        found = sorted((-score(a, v), i) for a in asked for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_repeated_rows_and_ids_in_searches(spark):
    rows = [(0, (1.0, 0.0)), (0, (1.0, 0.0)), (1, (1.0, 0.125)), (3, (0.5, 0.25)), (2, (0.0, 1.0))]
    for extra in ([], [(1, (1.0, 0.125))], [(0, (0.0, 1.0)), (5, (0.5, 0.25)), (5, (0.25, 0.75))]):
        df = spark.createDataFrame([(i, list(v)) for i, v in rows + extra], "vec_id long, embedding array<float>")
        exact = sorted(map(tuple, ranked(voronoi.nearest_join(usable(df, True), every=5), 5).collect()))
        assert exact == brute_top(rows + extra, 5, lambda a, b: int(sum(np.floor(256 * x) * np.floor(256 * y) for x, y in zip(a, b, strict=True))))
        near = sorted(map(tuple, ranked(ivfpq.search(usable(df, False), every=5), 5).collect()))
        want = brute_top(rows + extra, 5, lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))
        assert [x[:2] for x in near] == [x[:2] for x in want] and np.allclose([x[3] for x in near], [x[3] for x in want])
        if not extra:
            assert [x[2] for x in exact] == [1, 3, 2] and near == [pytest.approx(x) for x in want]


def test_large_scores_stay_exact(spark):
    big = 2.0**20
    rows = [(0, [big, 1.0, 0.0]), (1, [big, 0.0, 0.0]), (2, [big, 1 / 256, 0.0]), (3, [big, 2 / 256, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ranked(voronoi.nearest_join(usable(df, True), every=5), 5).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 2**56 + 512), (2, 2**56 + 256), (1, 2**56)]


def test_chat_template_is_reversible():
    r = random.Random(1)
    parts = ["\\", "#", "###", "### Assistant:", "</turn>", "<\\/turn>", "\n", ":", "é", "x", "\\#", "<", "/turn>"]
    for _ in range(2000):
        role, text = ("".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(2))
        seg, _, _ = chat.segment(role, text)
        assert chat.parse(seg) == (role, text)
        assert "</turn>" not in seg[: -len(chat.FOOT)] and "###" not in seg[3:]
    seg, a, z = chat.segment("assistant", "\\### Assistant: </turn> ok")
    assert chat.unescape(seg[a:z]) == "\\### Assistant: </turn> ok"


def joined(stretches):
    out = []
    for a, b in sorted(stretches):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_prefix_tree(spark):
    r = random.Random(2)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", r.choice("abc") * r.randint(1, 2), "x") for c in range(60) for t in range(r.randint(1, 7))]
    rows += [(None, None, None, None, "x"), (61, None, "user", None, "x"), (61, None, "user", None, "x"), (62, 0, "assistant", "long " * 20_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    made, tree = chat.format_conversations(df)
    nodes = sorted(tree.collect(), key=lambda n: n.place)
    by = {bytes(n.node): n for n in nodes}
    assert len(by) == len(nodes) and nodes[0].place == 0
    assert all(b.place == a.place + a.chars for a, b in zip(nodes, nodes[1:], strict=False))
    above = []
    for n in nodes:  # depth first: the parent is the last open node
        while above and above[-1] != (bytes(n.parent) if n.parent is not None else None):
            above.pop()
        assert above or n.parent is None
        above.append(bytes(n.node))
        seen, k = [], n
        while k is not None:
            seen.append((k.place, k.place + k.chars))
            k = by[bytes(k.parent)] if k.parent is not None else None
        assert joined(seen) == joined(map(tuple, n.attention)) and sum(b - a for a, b in seen) == n.position + n.chars
    paths = {}
    for c, _, role, text, _ in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        paths.setdefault(c, []).append(((role or ""), (text or "")))
    assert len(nodes) == len({tuple(p[: k + 1]) for p in paths.values() for k in range(len(p))})
    back = {x.conv_id: x for x in chat.read_back(made, tree).collect()}
    assert {c: x.n_turns for c, x in back.items()} == {c: len(p) for c, p in paths.items()}
    assert all(x.formatted_chars == sum(len(chat.segment(*t)[0]) for t in paths[c]) for c, x in back.items())
    assert chat.read_back(*chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize(("query", "table", "sql"), [(chat.op1_chat, "conversations", chat.ORACLE_SQL), (voronoi.op8_voronoi, "embeddings", voronoi.ORACLE_SQL)])
def test_sql(spark, query, table, sql):
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = c.sql(sql)
    assert sorted(map(tuple, query(spark, SF).select(*want.columns).collect())) == sorted(want.fetchall())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">More</a></li></ul></nav><!-- x --><div class="ad">Buy now cheap.</div>
<article><h1>A  title &amp; more</h1><p><b>First paragraph of the text, which
goes on for a while &lt;here&gt;.<br><p>Second paragraph of the text, it has a few words too.</p><p>Third.</article>
<section class="comments"><div class="comment"><p>I do not agree at all with this, friend.</p></div></section><footer>&copy; example.com</footer></body></html>"""


def test_main_text():
    trees = html_text.trained()
    want = "A title & more\nFirst paragraph of the text, which goes on for a while <here>.\nSecond paragraph of the text, it has a few words too.\nThird."
    assert html_text.main_texts([PAGE], trees) == [want]
    odd = ["", "plain", "<p", "<script>x", "<!-- x", "<" * 50, "<div>" * 3000 + "deep", "</p></div>", "<a b='", "&amp &#x41; &bogus;"]
    assert len(html_text.main_texts(odd, trees)) == len(odd)


def test_no_contradictions_and_held_out_pages():
    trees, r, right, leaves = html_text.trained(), random.Random(99), 0, 0
    for _ in range(120):
        page, main = html_text._layout(r)
        order = html_text.nodes_of(html_text.parse(page))
        keep = html_text.decode(order, trees.margin(html_text.features(order)))
        assert all(not k or n.parent is None or keep[n.parent.row] for n, k in zip(order, keep, strict=True))
        for n, k in zip(order, keep, strict=True):
            if n.text is not None:
                leaves += 1
                right += k == (n.text.split()[0] in main)
    assert right / leaves >= 0.97


def test_decoding_is_the_best_labelling():
    import itertools

    r = random.Random(3)
    for _ in range(60):
        page = "".join(r.choice(["<div>", "</div>", "x ", "<p>y</p>"]) for _ in range(9))
        order = html_text.nodes_of(html_text.parse(page))
        margin = np.array([r.uniform(-3, 3) for _ in order])
        if len(order) > 12:
            continue
        worth = [sum(m for m, k in zip(margin, ks, strict=True) if k) for ks in itertools.product([False, True], repeat=len(order)) if all(not k or n.parent is None or ks[n.parent.row] for n, k in zip(order, ks, strict=True))]
        keep = html_text.decode(order, margin)
        assert abs(max(worth) - sum(m for m, k in zip(margin, keep, strict=True) if k)) < 1e-9


def test_op7(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a"), (2, None, None, "b"), (None, "v", "", "c"), (1, "u", PAGE, "a")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars > 0, r.n_chars == len(r.text)) for r in got) == [("1", True, True), ("1", True, True), ("2", False, True), ("None", False, True)]
    assert html_text.extract(df.limit(0)).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
    path = rest[k:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(h + p, v) for v, h, p in url_filter.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


def test_op9(spark):
    urls = ["https://a.COM/x?y", "http://www.example.com/en/1", "http://example.com/en/1", "x://m.example.com/en/", "http://b.net/es/", "http://b.net/fr/a#b", "http://b.net/de/", "http://com", "http://notcom/", "nothing", None, "", "http://freecasinobonus.org/x", "http://dailynewsblog.org/x", "http://É.com/", "a://b?c/d", "://x.com/", "http://" + "ab" * 3000 + ".org/" + "z" * 5000]
    df = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)] + [(None, urls[0], None, "r")], "page_id long, url string, html string, rule string")
    got = url_filter.judge_urls(df, url_filter.title_words(df)).collect()
    for r in got:
        host, path, rule = brute_url(urls[r.page_id] if r.page_id is not None else urls[0])
        assert (r.host, r.path) == (host, path)
        if rule:
            assert (r.rule, r.verdict) == rule
        else:
            assert r.rule is None and r.verdict in ("allow", "block")
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict[12] == "block" and verdict[13] == "allow" and verdict[9] == "allow"
    assert url_filter.judge_urls(df.limit(0), {}).count() == 0


def test_segmentation_is_the_cheapest():
    import itertools
    import math

    s = url_filter.Segmenter({"free": 10, "casino": 5, "cas": 7, "in": 9, "o": 2, "freec": 1})
    run = "freecasino"
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        words, last = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                words.append(run[last:i])
                last = i
        best = min(best, sum(s.cost.get(w, s.unknown(len(w))) for w in words))
    assert abs(best - sum(s.cost.get(w, s.unknown(len(w))) for w in s(run))) < 1e-9
    assert s("freecasino") == ["free", "casino"]


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_voronoi_with_repeated_query_ids(spark, spread):
    r = np.random.default_rng(4)
    rows = [(50, [1.0, spread * i]) for i in range(12)] + [(1, [0.5, 0.0]), (2, [0.2, 0.0])] + [(int(i), [float(x) for x in r.normal(size=2) / 9]) for i in range(101, 130)]
    for kept in (rows[:14], rows):
        df = spark.createDataFrame(kept, "vec_id long, embedding array<float>")
        got = sorted(map(tuple, ranked(voronoi.nearest_join(usable(df, True)), 5).collect()))
        whole = [(i, tuple(np.floor(np.array(x, np.float32).astype(float) * 256).astype(int).tolist())) for i, x in kept]
        assert got == brute_top(whole, 50, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_op9_keeps_all_counted_words(spark):
    # 25,000 words that occur once: one of them holds the seed word "casino"; the counts decide the split.
    titles = ["".join("abcdefghij"[int(c)] for c in str(100_000 + i)) for i in range(25_000)] + ["xcasinox"]
    urls = ["http://xcasinox.org/", "http://casino.org/", "http://q.org/bookxcasinox", "http://q.org/freecasinobonus"]
    df = spark.createDataFrame([(i, u, f"<title>{' '.join(titles[i::4])}</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    counts = {r.w: r.n for r in url_filter.title_words(df).collect()}
    assert len(counts) == 25_001
    model = url_filter.UrlModel(counts)
    want = {}
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        seen = [model.weight[w] for w in model.words(host) + model.words(path) if w in model.weight]
        want[i] = "block" if seen and model.prior + sum(seen) > 0 else "allow"
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df, url_filter.title_words(df)).collect()} == want
    assert want[0] == "allow" and want[1] == "block"


def test_pages_go_on_after_unpaired_quotes():
    def said(page):
        return [n.text for n in html_text.nodes_of(html_text.parse(page)) if n.tag == "#text"]

    for attrs in ("title=it's", 'width=5"', "title='open", 'title="open', 'a=b="c'):
        assert said(f"<div><p {attrs}>one</p><p>two</p></div>") == ["one", "two"]
    assert said("<p title=it's>one</p><p title=it's>two</p>") == ["one", "two"]
    assert said("<p title = 'a > b' alt=\"x>y\">one</p>") == ["one"]
    assert said("<p>" + "İ" * 40 + "</p><SCRIPT>x</Script><p>kept</p><p>also</p>")[1:] == ["kept", "also"]
