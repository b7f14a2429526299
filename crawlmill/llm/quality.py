"""Distribution divergence as a quality rule.

Each text's histogram of character classes and of its language's common words is compared with that language's reference histogram by the
Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). References are counted over all documents. A text too short for a
stable histogram is not judged by it: characters need `min_words` words, common words need `min_common_words`.

Defined results: a null text has no words and fails the base rule; a language without a reference (null, or unknown) is compared with
every reference and takes the nearest; with no reference at all the distances are null and only the base rule decides. Repeated rows are
judged one by one, and further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, pieces, texts

#: Character classes by byte of UTF-8; continuation bytes count for nothing, so that a character counts once.
LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER, LETTER, WIDE, INNER = range(10)
CLASSES = 9
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def _class_of(byte: int) -> int:
    if 97 <= byte <= 122:
        return LOWER
    if 65 <= byte <= 90:
        return UPPER
    if 48 <= byte <= 57:
        return DIGIT
    if byte in BLANKS:
        return SPACE
    if byte in SYMBOLS:
        return SYMBOL
    if byte in b".,;:?!'\"()-":
        return STOP
    if byte < 128:
        return OTHER
    if byte < 192:
        return INNER
    return LETTER if byte < 224 else WIDE


CLASS_TABLE = np.array([_class_of(b) for b in range(256)], np.uint8)
#: Lower-cases ASCII letters and blanks all other ASCII characters; what is left between blanks are the words that are compared.
WORD_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Limits:
    min_base_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    common_words: int = 100
    min_words: int = 20
    min_common_words: int = 50
    max_char_distance: float = 0.22
    max_word_distance: float = 0.45
    #: Added to the limits over the root of the number of words: short texts scatter more.
    char_slack: float = 0.8
    word_slack: float = 2.0


def char_histogram(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_TABLE[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


_BASE = 0x9E3779B97F4A7C15


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many of the words lie in a window that occurs twice or more. Windows that look alike by a sum of 64 bits are compared word by word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += ids[k : n + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple, int] = {}
    starts = np.zeros(n, np.int32)
    for i in np.flatnonzero(np.isin(key, twice)).tolist():
        first = seen.setdefault(tuple(words[i : i + window]), i)
        if first != i:
            starts[[first, i]] = 1
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += starts
    edge[window : window + n] -= starts
    return int((np.cumsum(edge)[:-1] > 0).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Of two histograms; 1 if one of them is empty and the other not."""
    if not p.sum() or not q.sum():
        return 0.0 if p.sum() == q.sum() else 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("quality", dict)
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "item", "n"])
        held.clear()

    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
            if lang is None or not text:
                continue
            c = held.setdefault(lang, Counter())
            c.update(text.translate(WORD_TABLE).split())
            for k, n in enumerate(char_histogram(text).tolist()):
                if n:
                    c[b"%d" % k] += n
        if sum(map(len, held.values())) > 400_000:
            yield from out()
    yield from out()


@dataclass
class References:
    """By language: the reference histograms. words holds the common words of all languages, lists the places of each language's own."""

    langs: dict[str, int]
    chars: np.ndarray
    words: dict[bytes, int]
    lists: list[np.ndarray]
    shares: list[np.ndarray]


def references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """Counted over all documents; the driver gets `common_words` rows and the class counts of each language."""
    bounded_batches(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(_counts, "lang string, item binary, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    is_class = F.col("item").cast("string").rlike("^[0-9]$")
    place = F.row_number().over(Window.partitionBy("lang", "class").orderBy(F.desc("n"), "item"))
    top = counted.withColumn("class", is_class).withColumn("place", place).where(F.col("place") <= limits.common_words)
    found = sorted((r["lang"], r["class"], -r["n"], bytes(r["item"])) for r in top.collect())
    langs = {x: k for k, x in enumerate(dict.fromkeys(r[0] for r in found))}
    chars, words = np.zeros((len(langs), CLASSES)), {}
    own: list[list[tuple[bytes, int]]] = [[] for _ in langs]
    for lang, cls, n, item in found:
        if cls:
            chars[langs[lang], int(item)] = -n
        else:
            own[langs[lang]].append((item, -n))
            words.setdefault(item, len(words) + 1)
    lists = [np.array([words[w] for w, _ in x], np.int64) for x in own]
    return References(langs, chars, words, lists, [np.array([n for _, n in x], float) for x in own])


def measure(text: bytes | None, lang: str | None, ref: References, limits: Limits) -> tuple:
    text = text or b""
    words = text.split()
    hist = char_histogram(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = repeated_words(words, limits.window)
    n = len(words)
    failed = n < limits.min_base_words or 100 * repeated > limits.max_repeat_percent * n
    near: tuple[float | None, float | None] = (None, None)
    if ref.langs:
        plain = text.translate(WORD_TABLE).split()
        seen = np.bincount(np.fromiter((ref.words.get(w, 0) for w in plain), np.int64, len(plain)), minlength=len(ref.words) + 1)
        own = [ref.langs[lang]] if lang in ref.langs else range(len(ref.langs))
        near = min((js_distance(hist, ref.chars[k]), js_distance(seen[ref.lists[k]], ref.shares[k])) for k in own)
    slack = max(1, n) ** -0.5
    odd_chars = near[0] is not None and n >= limits.min_words and near[0] > limits.max_char_distance + limits.char_slack * slack
    odd_words = near[1] is not None and n >= limits.min_common_words and near[1] > limits.max_word_distance + limits.word_slack * slack
    return n, int(hist.sum() - hist[SPACE]), int(hist[SYMBOL]), len(lines) - len(set(lines)), repeated, failed, not (failed or odd_chars or odd_words), *near


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, ref: References | None = None, limits: Limits = Limits()) -> DataFrame:
    """A row for each document: the base counts, both distances and the verdict."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ref or references(docs, limits))  # common_words rows a language

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality", dict)
        for batch in pieces(batches):
            rows = [measure(t, lang, held.value, limits) for t, lang in zip(texts(batch), batch.column("lang").to_pylist())]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(judged, SCHEMA)
