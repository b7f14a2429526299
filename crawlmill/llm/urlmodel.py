"""URL filter: rules by host and path first, then a ratio of two character language models.

Both models are smoothed Markov models of variable order: the probability of a character mixes the orders 0 to ORDER by Witten and Bell's
weights, so a context counts as far as it was seen. One learns from URLs that a rule allows, the other from URLs that a rule blocks. A URL
without a rule gets the difference of both log-likelihoods over its length; the limit is the one that errs least on URLs held out.

What follows what is counted over all distinct URLs that rules decide, but for a quarter by hash, and the limit is fitted on all of that
quarter: nothing is sampled and no n-gram is left out. So models may be of any size and stay tables. The probability of a character needs its
last ORDER + 1 characters only, so these windows are looked up, each distinct one once for both models, and URLs add up what their windows say.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the models as the text it is
(null: empty); with only one class to learn from, every URL without a rule gets `allow`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, discard, written

ORDER = 5
#: What stands before a URL's first character, and its end.
START, END = "\x02", "\x03"
ALLOW, BLOCK = "allow", "block"
#: The rules of the query, host and start of the path with their verdict.
RULES = {"org/": ALLOW, "example.org/es/": BLOCK, "example.org/en/1": BLOCK, "com/fr/": ALLOW, "com/de/": BLOCK}
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        of, start = rule.partition("/")[0], "/" + rule.partition("/")[2]
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = None
    for r, v in rules.items():
        out = F.when(rule == r, v) if out is None else out.when(rule == r, v)
    return out if out is not None else F.lit(None).cast("string")


def grams_of(url: str, order: int = ORDER) -> list[str]:
    """Each character, and the end, behind contexts of 0 to `order` characters; the order stands before, so that starts of URLs tell lengths apart."""
    padded = START * order + url + END
    return [padded[i - k : i + 1] for i in range(order, len(padded)) for k in range(order + 1)]


class Markov:
    """Counts of what follows each context of up to `order` characters, in one process."""

    def __init__(self, counts: dict[str, int], order: int = ORDER):
        self.order, self.after = order, {}
        for gram, n in counts.items():
            self.after.setdefault(gram[:-1], {})[gram[-1]] = n
        self.sums = {k: sum(c.values()) for k, c in self.after.items()}

    @classmethod
    def of(cls, urls: list[str], order: int = ORDER) -> Markov:
        return cls(Counter(g for u in urls for g in grams_of(u, order)), order)

    def log_likelihood(self, url: str) -> float:
        padded, total = START * self.order + url + END, 0.0
        for i in range(self.order, len(padded)):
            p = 1 / 256
            for k in range(self.order + 1):
                c = self.after.get(padded[i - k : i])
                if c is None:
                    break
                p = (c.get(padded[i], 0) + len(c) * p) / (self.sums[padded[i - k : i]] + len(c))
            total += log(p)
        return float(total)


@dataclass
class Ratio:
    good: Markov
    bad: Markov
    limit: float

    def score(self, url: str) -> float:
        """The difference of log-likelihoods per character, the end included."""
        return (self.good.log_likelihood(url) - self.bad.log_likelihood(url)) / (len(url) + 1)


def best_limit(scores: list[float], good: list[bool]) -> float:
    """The limit that errs least over both classes alike: scores over it count as good. Between equal ones the middle of the widest gap."""
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(good)[order]
    up, down = max(1, y.sum()), max(1, (~y).sum())
    wrong = np.concatenate(([0], np.cumsum(y))) / up + np.concatenate((np.cumsum((~y)[::-1])[::-1], [0])) / down
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    cuts, gaps = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    k = max((i for i in range(len(cuts)) if gaps[i] > 0), key=lambda i: (-round(wrong[i], 9), gaps[i] if 0 < i < len(s) else 0))
    return float(cuts[k])


def tallied(urls: DataFrame) -> DataFrame:
    """gram, good, bad: how often each n-gram occurs in the good and in the other urls (url, good). Tasks add up before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("urlmodel", dict)
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for good, some in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array([bool(good)] * len(some), pa.bool_()), pa.array(list(some.values()), pa.int64())], ["gram", "good", "n"])
                some.clear()

        for batch in batches:
            for u, good in zip(batch.column("url").to_pylist(), batch.column("good").to_pylist()):
                held[good].update(grams_of(u))
                if len(held[0]) + len(held[1]) > 500_000:
                    yield from out()
        yield from out()

    sum_of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return urls.select("url", "good").mapInArrow(counted, "gram string, good boolean, n long").groupBy("gram").agg(sum_of(F.col("good")).alias("good"), sum_of(~F.col("good")).alias("bad"))


def counts(urls: DataFrame, most: int | None = None) -> dict[str, int]:
    """How often each n-gram of urls (a column `url`) occurs, or the most frequent of them (shorter ones first among equals)."""
    sums = tallied(urls.select("url", F.lit(True).alias("good"))).orderBy(F.desc("good"), F.length("gram"), "gram")
    got = (sums if most is None else sums.limit(most)).toArrow()
    return dict(zip(got.column("gram").to_pylist(), got.column("good").to_pylist()))


def windows(urls: DataFrame) -> DataFrame:
    """id, gram: the last ORDER + 1 characters at each character of urls (id, url), and at the end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("urlmodel", dict)
        for batch in batches:
            ids, grams = [], []
            for i, u in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist()):
                padded = START * ORDER + u + END
                ids += [i] * (len(u) + 1)
                grams += [padded[k : k + ORDER + 1] for k in range(len(u) + 1)]
                if len(ids) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], ["id", "gram"])
                    ids, grams = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], ["id", "gram"])

    return urls.select("id", "url").mapInArrow(cut, "id long, gram string")


def probabilities(asked: DataFrame, tallies: DataFrame) -> DataFrame:
    """gram, good, bad: the probability of the last character of each asked gram (distinct ones of ORDER + 1 characters) behind the others, by both models.

    From the shortest contexts on, each distinct one once; where a context was never seen, the shorter one's word holds."""
    both = ("good", "bad")
    after = tallies.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(*(f(n).alias(f"{name}_{n}") for n in both for name, f in (("sum", F.sum), ("kinds", lambda n: F.count_if(F.col(n) > 0)))))
    after = written(after, "contexts")
    tables, below = [after], None
    for k in range(ORDER + 1):
        own = asked.select(F.expr(f"right(gram, {k + 1})").alias("gram")).distinct()
        own = own.join(tallies.where(F.length("gram") == k + 1), "gram", "left").withColumn("context", F.expr(f"left(gram, {k})"))
        own = own.join(after.where(F.length("context") == k), "context", "left")
        if below is None:
            own = own.withColumns({f"p_{n}": F.lit(1 / 256) for n in both})
        else:
            own = own.withColumn("short", F.expr(f"right(gram, {k})")).join(below.select(F.col("gram").alias("short"), *(F.col(n).alias(f"p_{n}") for n in both)), "short")
        mixed = lambda n: (F.coalesce(n, F.lit(0)) + F.col(f"kinds_{n}") * F.col(f"p_{n}")) / (F.col(f"sum_{n}") + F.col(f"kinds_{n}"))
        below = written(own.select("gram", *(F.when(F.col(f"sum_{n}") > 0, mixed(n)).otherwise(F.col(f"p_{n}")).alias(n) for n in both)), "probabilities")
        tables.append(below)
    discard(*tables[:-1])
    return below


def scored(urls: DataFrame, tallies: DataFrame) -> DataFrame:
    """url, ratio: the difference of log-likelihoods per character, the end included, of distinct urls."""
    urls = written(urls.select("url").distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    # tables of their own: a window that very many URLs hold is split by Spark's handling of skewed joins
    each = written(windows(urls), "windows")
    said = probabilities(written(each.select("gram").distinct(), "asked"), tallies)
    sums = each.join(said.select("gram", (F.log("good") - F.log("bad")).alias("r")), "gram").groupBy("id").agg(F.sum("r").alias("r"))
    return written(urls.join(sums, "id").select("url", (F.col("r") / (F.length("url") + 1)).alias("ratio")), "scores")


def fitted_limit(held: DataFrame) -> float:
    """best_limit over all rows (ratio, good), with at least one; counted within ranges of scores, behind those of the ranges before."""
    each = held.groupBy("ratio").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    each = written(each.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "limits")
    parts = each.groupBy("part").agg(F.min("ratio").alias("least"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()  # a row a range
    good, bad = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    base, done = [], [0, 0]
    for r, after in zip(parts, [*parts[1:], None]):
        base.append((r["part"], *done, after and after["least"]))
        done = [done[0] + r["good"], done[1] + r["bad"]]
    at = Window.partitionBy("part").orderBy("ratio")
    seen = each.join(F.broadcast(held.sparkSession.createDataFrame(base, "part int, good_before long, bad_before long, following double")), "part")
    upto = lambda n: F.col(f"{n}_before") + F.sum(n).over(at)
    wrong = F.round(upto("good") / max(1, good) + (bad - upto("bad")) / max(1, bad), 9)
    cuts = seen.select("ratio", wrong.alias("wrong"), F.coalesce(F.lead("ratio").over(at), "following").alias("next"))
    gap = F.coalesce(F.col("next") - F.col("ratio"), F.lit(0.0))
    best = cuts.agg(F.min(F.struct("wrong", (-gap).alias("gap"), "ratio", "next")).alias("best")).first()["best"]
    before = (round(bad / max(1, bad), 9), 0.0)
    if before <= (best["wrong"], best["gap"]):
        return parts[0]["least"] - 0.5
    return best["ratio"] + 0.5 if best["next"] is None else (best["ratio"] + best["next"]) / 2


def learn(judged: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """From rows (url, verdict) with a verdict: the n-grams of both models (gram, good, bad), and the rows (url, good) held out for the limit.

    Of a class with few URLs all are learned from and held out; without URLs of both classes there is nothing to learn."""
    bounded_batches(judged.sparkSession)
    known = judged.where("url is not null").select("url", (F.col("verdict") == ALLOW).alias("good"), F.pmod(F.xxhash64("url"), F.lit(4)).alias("h")).distinct()
    known = written(known, "known")
    some = {(r["good"], r["held"]): r["n"] for r in known.groupBy("good", (F.col("h") == 0).alias("held")).agg(F.count("*").alias("n")).collect()}
    if not all(some.get((v, True), 0) + some.get((v, False), 0) for v in (True, False)):
        return None
    apart = all(some.get((v, held), 0) for v in (True, False) for held in (True, False))
    return written(tallied(known.where("h <> 0") if apart else known), "grams"), known.where("h = 0") if apart else known


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where a rule decides)."""
    bounded_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict_of(F.col("rule"), rules))
    learned = learn(ruled.where("rule is not null").select("url", F.col("ruled").alias("verdict")))
    if learned is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    tallies, held = learned
    # a table of its own: a URL that very many pages have is split by Spark's handling of skewed joins
    ruled = written(ruled.withColumn("asked", F.when(F.col("ruled").isNull(), F.coalesce("url", F.lit("")))).drop("url"), "ruled")
    scores = scored(ruled.where("asked is not null").select(F.col("asked").alias("url")).unionByName(held.select("url")), tallies)
    limit = fitted_limit(held.join(scores, "url").select("ratio", "good"))
    decided, open_ = ruled.where("ruled is not null"), ruled.where("ruled is null").join(scores.withColumnRenamed("url", "asked"), "asked")
    out = lambda df, verdict, ratio: df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), ratio.alias("ratio"))
    return out(decided, F.col("ruled"), F.lit(None).cast("double")).unionByName(out(open_, F.when(F.col("ratio") > limit, ALLOW).otherwise(BLOCK), F.col("ratio")))
