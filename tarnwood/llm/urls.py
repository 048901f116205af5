"""URL filter: the ratio of two variable-order Markov models of characters."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwood.llm import common

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Words in a host's name that mark the seeds of the rejected class.
REJECTED_WORDS = "casino casinos poker bet bets betting slots jackpot lottery porn xxx adult sex escort pills viagra cialis pharmacy spam ads adserver adtrack track tracker banner popup phishing malware warez torrent crack payday loans".split()
#: How often each of these words counts in the rejected model besides the corpus.
WORD_WEIGHT = 5
#: Longest context of the models.
ORDER = 5
#: A character of which nothing is known has one part in so many.
ALPHABET = 256
#: A context deeper than one character is a state of its own from so many occurrences on; shallower ones stand in for it.
LEAST = 4
#: Characters of URLs that are scored together; bounds a worker's memory, never results.
BLOCK = 250_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of the contract; a null url or one without :// has both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cut = [F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(cut[0], upper, lower), cut[1]


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def seed_of(host: Column) -> Column:
    """The class a URL is learned as: block where a REJECTED_WORDS word stands in the
    host's name, bounded by points, hyphens or the ends; else allow."""
    return F.when(host.rlike(rf"(^|[.\-])({'|'.join(REJECTED_WORDS)})([.\-]|$)"), "block").otherwise("allow")


def symbols(url: str | None) -> str:
    """What the models read: without scheme, lower-cased, every digit as 0, an end mark."""
    text = re.sub(r"\A[^:/?#]*://", "", url or "").lower()
    return re.sub(r"[0-9]", "0", text) + "\x03"


@dataclass
class Markov:
    """Interpolated counts: a state's own frequencies, and, in proportion to the number
    of different characters seen after it, those of the next shorter context. This is the
    definition, in one process; `ratios` computes the same by joins."""

    counts: dict[str, int]
    order: int = ORDER

    def __post_init__(self):
        total, kinds = defaultdict(int), defaultdict(int)
        for gram, n in self.counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        self.states = {k: (n, kinds[k]) for k, n in total.items() if len(k) <= 1 or n >= LEAST}
        self.alphabet = ALPHABET

    def log_prob(self, context: str, char: str) -> float:
        p = 1 / self.alphabet
        for k in range(min(self.order, len(context)) + 1):
            state = context[len(context) - k :]
            found = self.states.get(state)
            if not found:
                break
            p = (self.counts.get(state + char, 0) + found[1] * p) / (found[0] + found[1])
        return math.log(p)


def _text(url: str | None) -> str:
    return "\x02" + symbols(url)


def _windows(text: str) -> list[str]:
    """Of each character but the first, it and up to ORDER characters before."""
    return [text[max(0, i - ORDER) : i + 1] for i in range(1, len(text))]


@dataclass
class Model:
    """Every n-gram of the corpus, a written table (gram, a, r: how often accepted and
    rejected text has it), and the threshold."""

    grams: DataFrame
    threshold: float


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, a, r) of all n-grams of the rows' urls by their class y, and of the rejected
    words; none is left out. Rows are folded map-side to windows, whose suffixes the n-grams are."""
    schema = T.StructType([T.StructField("window", T.StringType()), T.StructField("a", T.LongType()), T.StructField("r", T.LongType())])

    def count():
        def work(columns):
            both = Counter(), Counter()
            for (url, y), n in Counter(zip(*columns, strict=True)).items():
                for window in _windows(_text(url)):
                    both[1 - y][window] += n
            keys = list(both[0] | both[1])
            return keys, [both[0][k] for k in keys], [both[1][k] for k in keys]

        return work

    sums = common.map_arrow(labelled, ["url", "y"], schema, count).groupBy("window").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    grams = _suffixes(sums, "a", "r")
    seeds = Counter()
    for word in REJECTED_WORDS:
        for i in range(len(word)):
            for k in range(min(i, ORDER) + 1):
                seeds[word[i - k : i + 1]] += WORD_WEIGHT
    grams = grams.unionByName(labelled.sparkSession.createDataFrame([(g, 0, n) for g, n in seeds.items()], "gram string, a long, r long"))
    return common.written(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url-grams")


def _suffixes(windows: DataFrame, *columns: str) -> DataFrame:
    each = windows.select("window", *columns, F.explode(F.expr("sequence(1, length(window))")).alias("n"))
    return each.select(F.expr("right(window, n)").alias("gram"), *columns)


def train(urls: DataFrame, url_col: str = "url", verdict_col: str = "verdict") -> Model:
    """Counts over all rows whose verdict is allow or block, then the threshold by `calibrate`."""
    labelled = urls.where(F.col(verdict_col).isin("allow", "block")).select(F.col(url_col).alias("url"), (F.col(verdict_col) == "allow").cast("int").alias("y"))
    grams = count_grams(labelled)
    return Model(grams, calibrate(_scores(labelled, grams, "url", "y").withColumnRenamed("key", "y"), grams))


def calibrate(scored: DataFrame, grams: DataFrame) -> float:
    """The score that best parts the rows of the classes y, each class weighing the same;
    ties go to the value nearest to 0. The driver gets a histogram. Where no row is rejected,
    the rejected words stand for that class, each as a url of its own. Without accepted rows
    there is nothing to compare: the threshold accepts everything."""

    def counted(scored):
        return scored.groupBy("y", F.round("score", 2).alias("s")).count().collect()

    histogram = counted(scored)
    if histogram and all(r["y"] == 1 for r in histogram):
        words = scored.sparkSession.createDataFrame([(w, 0) for w in REJECTED_WORDS], "url string, y int")
        histogram += counted(_scores(words, grams, "url", "y").withColumnRenamed("key", "y"))
    sizes = Counter()
    for r in histogram:
        sizes[r["y"]] += r["count"]
    if len(sizes) < 2:
        return -math.inf
    best, threshold, right = -1.0, 0.0, 1.0  # everything accepted so far: all of class 1, none of class 0
    by = defaultdict(float)
    for r in histogram:
        by[r["s"]] += r["count"] / sizes[r["y"]] * (1 if r["y"] == 0 else -1)
    edges = sorted(by)
    for s, after in zip(edges, [*edges[1:], None], strict=True):
        if (right > best + 1e-12) or (abs(right - best) <= 1e-12 and abs(s - 0.005) < abs(threshold)):
            best, threshold = right, s - 0.005
        right += by[s]
    return threshold


def ratios(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """(window, ratio): log of accepted over rejected likelihood of each window's last
    character, as two `Markov` over all of `grams` give it.

    An n-gram's probability comes from that of its tail, so each distinct suffix is joined
    once to the counts, to the sums of its context and to its tail, lengths in turn. No key
    has more rows than there are characters."""
    sums = [F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.count_if(F.col("a") > 0).alias("ka"), F.count_if(F.col("r") > 0).alias("kr")]
    context = F.expr("substring(gram, 1, length(gram) - 1)").alias("context")
    states = grams.groupBy(context).agg(*sums)
    wanted = _suffixes(windows).distinct().join(grams, "gram", "left").withColumn("context", context).join(states, "context", "left").drop("context")
    wanted = common.written(wanted.na.fill(0), "url-states")
    out = before = None
    for n in range(1, ORDER + 2):
        now = wanted.where(F.length("gram") == n)
        if before is None:
            now = now.withColumns({"pa": F.lit(1 / ALPHABET), "pr": F.lit(1 / ALPHABET)})
        else:
            now = now.withColumn("tail", F.expr(f"right(gram, {n - 1})")).join(before.select(F.col("gram").alias("tail"), "pa", "pr"), "tail")

        def step(x, n=n):
            count, total, kinds, p = (F.col(c + x) for c in ("", "t", "k", "p"))
            return F.when(total >= (1 if n <= 2 else LEAST), (count + kinds * p) / (total + kinds)).otherwise(p)

        before = common.written(now.select("gram", step("a").alias("pa"), step("r").alias("pr")), "url-odds")
        out = before if out is None else out.unionByName(before)
    return out.select(F.col("gram").alias("window"), (F.ln("pa") - F.ln("pr")).alias("ratio"))


def _scores(urls: DataFrame, grams: DataFrame, url_col: str, key_col: str) -> DataFrame:
    """(key, url, score) of every row: the mean ratio of the url's windows, written.

    Rows lie in blocks of some BLOCK characters, and a block asks for each of its windows
    once, so that a window that all urls share is a row a block."""
    spark = urls.sparkSession
    number, key, url = T.StructField("block", T.LongType()), common.field(urls, key_col, "key"), common.field(urls, url_col, "url")

    def deal():
        first = TaskContext.get().partitionId() << 32
        seen = 0

        def work(columns):
            nonlocal seen
            block = []
            for _, part in common.portions(columns[0], BLOCK):
                block += [first + seen] * len(part)
                seen += 1
            return block, columns[1], columns[0]

        return work

    def ask():
        def work(columns):
            asked = {(block, window) for block, url in zip(*columns, strict=True) for window in _windows(_text(url))}
            return [x[0] for x in asked], [x[1] for x in asked]

        return work

    scored = T.StructType([key, url, T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(scored)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ratio = dict(zip(answers["window"].to_pylist(), answers["ratio"].to_pylist(), strict=True))
        means = []
        for url in rows["url"].to_pylist():
            each = [ratio[w] for w in _windows(_text(url))]
            means.append(sum(each) / len(each))
        return pa.table([rows["key"], rows["url"], pa.array(means, pa.float64())], schema=arrow)

    rows = common.written(common.map_arrow(urls, [url_col, key_col], T.StructType([number, key, url]), deal), "url-blocks")
    asked = common.map_arrow(rows, ["block", "url"], T.StructType([number, T.StructField("window", T.StringType())]), ask)
    answers = asked.join(ratios(asked.select("window").distinct(), grams), "window")
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, scored)
    return common.written(out, "url-scores")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: Model | None = None) -> DataFrame:
    """id, host, path, rule, score and verdict of every row.

    The verdict is the longest fitting rule's, else the method's: block where the
    length-normalised log-likelihood difference is under the calibrated threshold. The
    models learn from all rows, by the classes of `seed_of`; the rules, which sort sites
    by language, teach them nothing. Null urls have an empty host and path
    and are judged as an empty url. Repeated rows and null ids get a row each; other columns
    are not read; an empty table gives an empty result."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col)).withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    accepted = (seed_of(F.col("host")) == "allow").cast("int")
    grams = model.grams if model else count_grams(rows.select(F.col(url_col).alias("url"), accepted.alias("y")))
    scored = _scores(pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url")), grams, "url", "key")
    host, path = parts(F.col("url"))
    threshold = model.threshold if model else calibrate(scored.withColumn("host", host).withColumn("y", accepted), grams)
    out = scored.withColumn("host", host).withColumn("path", path).withColumn("rule", name).withColumn("__tw_v", verdict)
    return out.select(F.col("key").alias(id_col), "host", "path", "rule", "score", F.coalesce("__tw_v", F.when(F.col("score") < threshold, "block").otherwise("allow")).alias("verdict"))
