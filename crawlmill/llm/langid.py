"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted (rotated) by its place, by their
product. A document bundles (adds) the vectors of all its n-grams, a language those of all its learning documents, each document scaled by
its number of n-grams. The language of the prototype with the largest cosine is predicted; that cosine, at 0 at least, is the score.

Characters: a case-folded letter is a symbol, every run of other characters one space. ASCII letters have symbols of their own, further
letters share the rest by their code point.

Defined results: `und` with score 0 for a null text or one without letters, or if there is nothing to learn from. Rows with a null doc_id are
not learned from and not held out. Equal cosines go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, pieces

DIMENSIONS = 1024
GRAM = 3
SEED = 7
#: Symbols: 0 the space, 1 to 26 the ASCII letters, the rest other letters by code point.
SYMBOLS = 64
GRAMS = SYMBOLS**GRAM
#: Texts whose n-grams are counted at once; numbers take eight times the room of the text.
COUNTED_BYTES = 1 << 20
UNKNOWN = "und"
_made: dict = {}


def symbol_table() -> np.ndarray:
    """The symbol of each code point below 0x3000; letters above get theirs by rule, see symbols()."""
    if "table" not in _made:
        t = np.zeros(0x3000, np.uint8)
        for c in range(0x3000):
            if chr(c).isalpha():
                low = chr(c).lower()[0]
                t[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
        _made["table"] = t
    return _made["table"]


def symbols(text: str) -> np.ndarray:
    """The text as symbols, one space at each end and between words."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    table = symbol_table()
    s = table[np.minimum(points, len(table) - 1)]
    for i in np.flatnonzero(points >= len(table)):
        c = chr(points[i])
        s[i] = 27 + ord(c.lower()[0]) % (SYMBOLS - 27) if c.isalpha() else 0
    s = np.concatenate(([0], s, [0])).astype(np.int64)
    return s[(s != 0) | np.append(True, s[:-1] != 0)]


def codes_of(text: str) -> np.ndarray:
    """The number of each n-gram of a text, in order; empty without letters."""
    s = symbols(text)
    n = max(0, len(s) - GRAM + 1)
    code = s[:n]
    for k in range(1, GRAM):
        code = code * SYMBOLS + s[k : n + k]
    return code


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as numbers, and how often each occurs."""
    code = codes_of(text)
    if len(code) < 30_000:
        return np.unique(code, return_counts=True)
    c = np.bincount(code, minlength=1)
    found = np.flatnonzero(c)
    return found, c[found]


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bound vectors of n-grams, as float32."""
    key = ("rolled", dimensions)
    if key not in _made:
        letters = letter_vectors(dimensions)
        _made[key] = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
    v = np.ones((len(codes), dimensions), np.int8)
    for k in range(GRAM):
        v *= _made[key][k][codes // SYMBOLS ** (GRAM - 1 - k) % SYMBOLS]
    return v


@dataclass
class Prototypes:
    langs: list[str]
    vectors: np.ndarray  # a unit vector each


#: Bound vectors a worker keeps, at most. They belong to the worker, not to prototypes: those come and go with each query.
KEPT_GRAMS = 1 << 14


def similarity(text: str | None, of: Prototypes) -> np.ndarray | None:
    """The cosine with each prototype; None without letters."""
    codes, n = grams(text or "")
    if not len(codes) or not of.langs:
        return None
    cache = _made.setdefault(("kept", of.vectors.shape[1]), {})
    if not cache:
        cache |= {"place": np.full(GRAMS, -1, np.int32), "rows": np.zeros((KEPT_GRAMS, of.vectors.shape[1]), np.float32), "used": 0}
    place = cache["place"]
    new = codes[place[codes] < 0]
    if cache["used"] + len(new) > KEPT_GRAMS:
        place[:] = -1
        cache["used"], new = 0, codes
    if len(new) > KEPT_GRAMS:  # as good as never: a text with more distinct n-grams than are kept
        v = sum(n[i : i + 4096].astype(np.float32) @ gram_vectors(codes[i : i + 4096], of.vectors.shape[1]).astype(np.float32) for i in range(0, len(codes), 4096))
    else:
        if len(new):
            at = cache["used"] + np.arange(len(new))
            cache["rows"][at] = gram_vectors(new, of.vectors.shape[1])
            place[new] = at
            cache["used"] += len(new)
        v = n.astype(np.float32) @ cache["rows"][place[codes]]
    size = float(np.linalg.norm(v))
    return of.vectors @ v / size if size else np.zeros(len(of.langs))


def learn(docs: DataFrame, label: str = "lang", dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototypes from all rows with a label. The driver gets a number for each language and n-gram, so GRAMS numbers a language at most."""
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid", _made.clear)
        held: dict[str, np.ndarray] = {}

        def out(lang: str) -> pa.RecordBatch:
            c = held.pop(lang)
            found = np.flatnonzero(c)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(c[found], pa.float64())], ["lang", "gram", "n"])

        for batch in pieces(batches, COUNTED_BYTES):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if len(codes := codes_of(text)):
                    by_lang.setdefault(lang, []).append(codes)
            for lang, some in by_lang.items():
                if lang not in held and len(held) >= 64:
                    yield out(next(iter(held)))
                each = np.repeat([round(1e9 / len(x)) for x in some], [len(x) for x in some])  # whole numbers: sums don't depend on their order
                held[lang] = held.get(lang, 0) + np.bincount(np.concatenate(some), each, GRAMS)
        for lang in list(held):
            yield out(lang)

    some = docs.select(F.col(label).cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    sums: dict[str, list] = {}
    for r in some.mapInArrow(counted, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        sums.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    langs, vectors = sorted(sums), []
    for lang in langs:
        codes, n = (np.array(x) for x in zip(*sorted(sums[lang])))
        v = sum(n[i : i + 4096] @ gram_vectors(codes[i : i + 4096], dimensions).astype(np.float64) for i in range(0, len(codes), 4096))
        vectors.append(v / max(np.linalg.norm(v), 1e-9))
    return Prototypes(langs, np.array(vectors, np.float32).reshape(len(langs), dimensions))


def _guess(text: str | None, of: Prototypes) -> tuple[str, float]:
    s = similarity(text, of)
    if s is None:
        return UNKNOWN, 0.0
    return of.langs[int(np.argmax(s))], min(1.0, max(0.0, float(s.max())))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's digits modulo by; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % by


def predict(docs: DataFrame, of: Prototypes, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(of)  # dimensions numbers a language

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid", _made.clear)
        for batch in pieces(batches):
            got = [_guess(t, shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, of: Prototypes, least_score: float = 0.05) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised with a score of least_score. One clean word alone scores about 0.1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid", _made.clear)
        for batch in pieces(batches):
            got = [_guess(t, shared.value) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
