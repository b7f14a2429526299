"""Toxicity by noisy-channel deobfuscation.

Writers of insults hide them: digits and signs for letters (leetspeak), letters repeated or spaced out. A word, or a run of single letters,
that shows such signs becomes a lattice: each character may stand for itself, for a letter it resembles, for a repetition of the one before,
or for a break. Viterbi decoding under a character trigram model (symbols of langid, counted over all documents) finds the likeliest plain
reading. Words without such signs have one path, themselves, and skip the search.

The restored text is scored by a lexicon and a logistic regression: terms (restored words and their beginnings) with their log-odds among
labelled documents, then three features of a document: its strongest term, its sum of strong terms, and their share of its words.

Bounds: the labels learned from are at most LABELLED rows, those whose mixed id comes first; the lexicon holds all strong terms of these rows.

Defined results: null and empty texts have no terms and get the score of a document without any; without both classes to learn from every
score is 0; repeated labels of one document count once, toxic if one of them says so; null ids and null labels are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.llm import langid
from crawlmill.llm.common import begin, bounded_batches, pieces, written

LABELLED = 20_000
LEAST_SEEN = 3
LEAST_ODDS = float(np.log(6))
STEMS = (4, 5, 6, 7)
#: The letters that signs are used for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Costs in nats of what the channel does to a character.
LOOK_COST, REPEAT_COST, DROP_COST, BREAK_COST = 1.0, 0.5, 1.0, 3.0
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(r"[0-9@$!|+€£]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(?:^|\s)[^\s|](?:\s+[^\s|]){2,}(?:\s|$)")
_SPACED = re.compile(r"^[^\W_](?:[.\-_*~][^\W_]){2,}$")


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a b) of symbols, mixed from three orders; counted over all documents. The driver gets SYMBOLS^3 counts at most."""
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity", _current.clear)
        c = np.zeros(langid.GRAMS, np.int64)
        for batch in pieces(batches, langid.COUNTED_BYTES):
            some = [langid.codes_of(t) for t in batch.column("text").to_pylist() if t]
            if some:
                c += np.bincount(np.concatenate(some), minlength=langid.GRAMS)
        found = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(c[found], pa.int64())], ["gram", "n"])

    c = np.zeros(langid.GRAMS)
    sums = docs.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    c[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    c = c.reshape((langid.SYMBOLS,) * 3)
    two, one = c.sum(axis=0), c.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + 2 * p1) / (two.sum(axis=1, keepdims=True) + 2)
    p3 = (c + 2 * p2) / (c.sum(axis=2, keepdims=True) + 2)
    return np.log(p3).astype(np.float32)


def _symbol(c: str) -> int:
    return int(langid.symbols(c)[1]) if c.isalpha() else 0


def decode(noisy: str, model: np.ndarray) -> str:
    """The likeliest plain reading of a word or of spaced letters; breaks become single spaces."""
    # said as a chain (what was said before, letter): nothing is copied, so the search is linear in the length
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, c in enumerate(noisy):
        options = [(_symbol(c), c, 0.0)] if c.isalpha() else [(0, " ", BREAK_COST if c != " " else 0.0)]
        options += [(_symbol(x), x, LOOK_COST) for x in LOOKS.get(c, "")]
        if i and noisy[i - 1] == c:
            options.append((-1, "", REPEAT_COST))
        elif c in " .-_*~" and i:
            options.append((-1, "", DROP_COST if c != " " else DROP_COST / 2))
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, said) in states.items():
            for s, out, extra in options:
                if s < 0 or (s == 0 and b == 0):
                    to, now = (a, b), (cost + extra, said)
                else:
                    to, now = (b, s), (cost + extra - float(model[a, b, s]), (said, out))
                if to not in new or now[0] < new[to][0]:
                    new[to] = now
        states = new
    said = min(((cost - float(model[a, b, 0]), said) for (a, b), (cost, said) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while said:
        said, out = said
        letters.append(out)
    return "".join(reversed(letters)).strip()


def _inner(c: str, signs: str) -> bool:
    return c.isalnum() or c == "_" or c in signs


def core_of(word: str) -> str:
    """A word without the signs around it that stand for no letter, or without one sign three times or more; "!" may begin a word, not end it."""
    i, j = 0, len(word)
    while i < j and not _inner(word[i], "@$!|+€£"):
        i += 1
    if not i:
        i = _same(word, range(j))
    while j > i and not _inner(word[j - 1], "@$|+€£"):
        j -= 1
    if j == len(word):
        j -= _same(word, range(j - 1, i - 1, -1))
    return word[i:j]


def _same(word: str, places: range) -> int:
    """How many of the places, from the first on, hold one and the same sign; 0 for fewer than three."""
    if not places or word[places[0]].isalnum() or word[places[0]] == "_":
        return 0
    n = 0
    for k in places:
        if word[k] != word[places[0]]:
            break
        n += 1
    return n if n > 2 else 0


class Restorer:
    """Restores words; remembers those it has seen."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def word(self, word: str) -> str:
        """The plain words that a case-folded word without white space stands for."""
        core = core_of(word)
        if core.isalpha() and not _TRIPLE.search(core):
            return core
        if _SPACED.match(core) or _TRIPLE.search(core) or _LETTER.search(core) and _SIGN.search(core):
            return decode(core, self.model)
        return " ".join(re.findall(r"[^\W\d_]+", core))

    def words(self, text: str) -> Iterator[str]:
        """The restored words of a text, in order."""
        if len(self.known) > 100_000:
            self.known.clear()
        single: list[str] = []
        for w in text.lower().split():
            if len(w) == 1 and (w.isalpha() or w in LOOKS) and w != "|":
                single.append(w)
                continue
            if single:
                yield from self._run(single)
                single = []
            got = self.known.get(w)
            if got is None:
                got = self.known[w] = self.word(w).split()
            yield from got
        yield from self._run(single)

    def _run(self, single: list[str]) -> list[str]:
        if len(single) < 3:
            return single
        return decode(" ".join(single), self.model).split()


def terms(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in STEMS if len(word) >= n]


_current: dict = {}


class _Strengths(dict):
    """The strength of words as they are written; of several words in one, their sum."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer = scorer

    def __missing__(self, token: str) -> float:
        if len(self) > 200_000:
            self.clear()
        got = self[token] = sum(self.scorer.strength(w) for w in _current["restorer"].word(token).split())
        return got


@dataclass
class Scorer:
    model: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray

    def strength(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The strongest written word, the logarithm of all strengths' sum, and that of their share of the words."""
        if _current.get("of") is not self:
            _current.clear()  # what a worker remembers for one scorer ends with the next
            _current.update({"of": self, "restorer": Restorer(self.model)})
            _current["tokens"] = _Strengths(self)
        text = text or ""
        written_words = text.lower().split()
        if not written_words:
            return 0.0, 0.0, 0.0
        if _RUN.search(text):
            values = [self.strength(w) for w in _current["restorer"].words(text)] or [0.0]
        else:
            values = list(map(_current["tokens"].__getitem__, written_words))
        total = sum(values)
        return max(values), float(np.log1p(total)), float(np.log1p(100 * total / len(written_words)))

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        z = float(np.dot(self.weights, (1.0, *self.features(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, restored: each text's restored words joined by spaces."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS^3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity", _current.clear)
        r = Restorer(shared.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if t is None else " ".join(r.words(t)) for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, restored string")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a bias and the columns of x, by Newton's method; the bias is not held down."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    hold = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold + 1e-9 * np.eye(len(w)), a.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "toxic", most: int = LABELLED) -> Scorer:
    """A scorer from the letters of all docs and at most `most` labelled ones. may_learn: a condition on the labels' doc_id."""
    model = letter_model(docs)
    doc = F.col("doc_id").cast("long")
    usable = labels.where(F.col(label).isNotNull() & doc.isNotNull() & (may_learn if may_learn is not None else F.lit(True)))
    picked = usable.groupBy(doc.alias("labelled_id")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most)
    joined = docs.select(doc.alias("labelled_id"), "text").join(F.broadcast(picked), "labelled_id")  # `most` small rows
    sample = written(joined.select("labelled_id", "text", "label"), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity", _current.clear)
        r = Restorer(shared.value)
        for batch in pieces(batches):
            c: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for t in {t for w in set(r.words(text or "")) for t in terms(w)}:
                    c.setdefault(t, [0, 0])[int(y > 0)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *(pa.array([v[k] for v in c.values()], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Scorer(model, {}, np.zeros(0))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[True] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[False] + 1.0))
    found = sample.mapInArrow(counted, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = found.where(F.col("toxic") >= LEAST_SEEN).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    strong = strong.select("term", "odds").toArrow()  # of terms in LEAST_SEEN toxic rows of the sample
    lexicon = dict(sorted(zip(strong.column("term").to_pylist(), strong.column("odds").to_pylist())))
    scorer = Scorer(model, lexicon, np.zeros(0))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity", _current.clear)
        for batch in pieces(batches):
            rows = np.array([held.value.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("labelled_id"), batch.column("label"), *(pa.array(rows[:, k]) for k in range(3))], ["labelled_id", "label", "a", "b", "c"])

    rows = sample.mapInArrow(featured, "labelled_id long, label int, a double, b double, c double").toArrow()  # five numbers of a labelled row
    rows = sorted(zip(*(c.to_pylist() for c in rows.columns)))
    x = np.array([r[2:] for r in rows])
    return Scorer(model, lexicon, fit_logistic(x, np.array([float(r[1] > 0) for r in rows])))


def scored(docs: DataFrame, scorer: Scorer, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # terms of LABELLED rows and SYMBOLS^3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity", _current.clear)
        for batch in pieces(batches):
            got = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity", _current.clear)
        for batch in pieces(batches):
            yield batch.filter(pa.array([shared.value.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
