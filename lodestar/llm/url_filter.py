"""URL filters: explicit rules, then host word segmentation and naive Bayes (operator 9).

A url's host and path are judged by the longest rule that fits: a rule fits its host and
all subdomains, if the path starts with the rule's. Else the method decides: runs of
letters in host and path are split into words by unigram Viterbi, and a multinomial naive
Bayes scores the words. Unigram counts are those of all words of all page titles and of the
seed names; naive Bayes is fitted on the seed
names, split the same way. A word that no class has seen says nothing; without known words
a url is allowed.

Each distinct run is split once: its substrings meet the counted words in a shuffle join, and
it takes along those that are words, so no word list is broadcast. The driver sees the counts
of the seed names' substrings alone.

Defined cases: a null url, or one without ://, has an empty host and path and is allowed;
an empty path fits no rule, as each has one; long hosts and paths are read whole (Viterbi is
linear in their length, words have at most LONGEST letters); repeated rows are judged each
alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import lead_columns, table, written

#: verdict, host, path; fixed by the contract
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: names that train the classifier
BLOCKED = (
    "ads", "ads track", "ad server", "ad click", "ad banner", "ad network", "ad tracker", "click track", "click bait", "pop up ads",
    "pixel track", "track pixel", "track click", "banner click", "telemetry", "casino", "free casino bonus", "casino bonus", "online casino",
    "poker bet", "sports bet", "betting bonus", "slots bonus", "win cash", "cash loan", "pay day loan", "cheap pills", "pills online", "viagra",
    "porn", "free porn", "xxx video", "sex cam", "adult cam", "adult video", "escort", "spam", "spam link", "link farm", "malware", "phishing", "warez crack",
    "crack keygen", "torrent warez", "fake watches", "replica watches", "bitcoin doubler",
)
ALLOWED = (
    "news", "daily news", "world news", "news blog", "blog", "my blog", "travel blog", "food blog", "science", "science daily", "school",
    "university", "college", "library", "book club", "book store", "museum", "history", "health care", "weather", "music", "film review", "sports news",
    "football", "garden", "home garden", "kitchen recipes", "recipes", "open source", "software docs", "docs", "wiki", "forum", "photo gallery",
    "city guide", "travel guide", "job board", "art gallery", "radio", "magazine", "research", "journal", "online store", "video library", "mobile", "community",
)
LONGEST = 24
SEED_COUNT = 50  # occurrences that a seed word counts as
KEPT = 100_000
_RUNS = re.compile("[a-z]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:end].translate(_AZ), path[:stop]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """rule and verdict of the longest rule that fits."""
    fits = [(h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=None)


class Segmenter:
    """The most probable words of a run of letters under a unigram model; unknown words pay for each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items() if n > 0}
        self.known: dict[str, list[str]] = {}

    def unknown(self, length: int) -> float:
        return math.log(self.total) + 2.3 * length

    def __call__(self, run: str) -> list[str]:
        if run in self.known:
            return self.known[run]
        best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for i in range(1, len(run) + 1):
            for j in range(max(0, i - LONGEST), i):
                c = best[j] + self.cost.get(run[j:i], math.inf)
                if c == math.inf:
                    c = best[j] + self.unknown(i - j)
                if c < best[i]:
                    best[i], back[i] = c, j
        words, i = [], len(run)
        while i:
            words.append(run[back[i] : i])
            i = back[i]
        words.reverse()
        if len(self.known) > KEPT:
            self.known.clear()
        if len(run) <= 200:
            self.known[run] = words
        return words


class UrlModel:
    def __init__(self, counts: dict[str, int], alpha: float = 0.5, total: int | None = None):
        """counts: of the words that can occur; total: of all words, if those are more."""
        seeds = Counter(w for name in (*BLOCKED, *ALLOWED) for w in name.split())
        total = None if total is None else total + SEED_COUNT * sum(seeds.values())
        self.segment = Segmenter(Counter(counts) + Counter({w: SEED_COUNT * n for w, n in seeds.items()}), total)
        by_class = [Counter(w for name in names for w in self.words(name.replace(" ", ""))) for names in (BLOCKED, ALLOWED)]
        vocabulary = set().union(*by_class)
        totals = [sum(c.values()) + alpha * len(vocabulary) for c in by_class]
        self.prior = math.log(len(BLOCKED) / len(ALLOWED))
        self.weight = {w: math.log((by_class[0][w] + alpha) / totals[0]) - math.log((by_class[1][w] + alpha) / totals[1]) for w in vocabulary}

    def words(self, text: str) -> list[str]:
        return [w for run in _RUNS.findall(text.translate(_AZ)) for w in self.segment(run)]

    def known(self, run: str, counts: dict[str, int]) -> list[float]:
        """The weights of the run's words that a class has seen, where counts are those of the counted words in it."""
        own = Segmenter({}, self.segment.total)
        own.cost = {w: -math.log(n / own.total) for w, n in counts.items()} | self.segment.cost
        return [self.weight[w] for w in own(run) if w in self.weight]


def title_words(pages: DataFrame) -> DataFrame:
    """w, n: every word of all titles with its count."""
    title = F.regexp_extract(F.col("html"), "(?is)<title[^>]*>([^<]*)<", 1)
    words = pages.select(F.explode(F.split(F.lower(title), "[^a-z]+")).alias("w")).where(f"length(w) between 2 and {LONGEST}")
    return written(words.groupBy("w").agg(F.count("*").alias("n")))


def judge_urls(pages: DataFrame, counts: DataFrame | dict[str, int], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url)."""
    spark = pages.sparkSession
    counted = spark.createDataFrame(list(counts.items()), "w string, n long") if isinstance(counts, dict) else counts

    def by_rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                out.append((host, path, *(rule_for(host, path, rules) or (None, None))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    ruled = written(lead_columns(pages, ["page_id", "url"]).mapInArrow(by_rule, "page_id long, host string, path string, rule string, verdict string"))
    names = [name.replace(" ", "") for name in (*BLOCKED, *ALLOWED)]
    parts = {(n[i:j],) for n in names for i in range(len(n)) for j in range(i + 2, min(len(n), i + LONGEST) + 1)}
    seen = counted.join(F.broadcast(spark.createDataFrame(sorted(parts), "w string")), "w", "left_semi").collect()
    model = UrlModel({r["w"]: r["n"] for r in seen}, total=counted.agg(F.sum("n")).first()[0] or 0)

    letters = F.translate(F.concat_ws(" ", "host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = written(ruled.where("verdict is null").select("host", "path").distinct().select("host", "path", F.explode(F.regexp_extract_all(letters, F.lit("([a-z]+)"), F.lit(1))).alias("run")))
    runs = written(each.select("run").distinct().withColumn("id", F.xxhash64("run")))  # a shared id brings words that do not occur
    starts = runs.where("length(run) > 1").select("id", "run", F.expr("explode(sequence(1, length(run) - 1))").alias("i"))
    inside = starts.select("id", F.expr(f"explode(transform(sequence(2, least({LONGEST}, length(run) - i + 1)), l -> substring(run, i, l)))").alias("w"))
    words = written(inside.join(counted, "w").groupBy("id").agg(F.collect_set(F.struct("w", "n")).alias("words")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.known(run, {x["w"]: x["n"] for x in own or ()}) for run, own in zip(b.column("run").to_pylist(), b.column("words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array([sum(x) if x else None for x in found], pa.float64())], ["run", "score"])

    scores = written(runs.join(words, "id", "left").select("run", "words").mapInArrow(score, "run string, score double").where("score is not null"))
    blocked = written(each.join(scores, "run").groupBy("host", "path").agg(F.sum("score").alias("score")).where(F.col("score") + model.prior > 0).select("host", "path", F.lit("block").alias("judged")))
    return ruled.join(blocked, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("rule").isNull(), F.col("judged")), F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, title_words(pages))
