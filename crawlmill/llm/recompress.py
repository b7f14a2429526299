"""Substring deduplication by recompression.

A document is a string of words, each named by a hash. Rounds of recompression shorten it: runs of one name get a name of their own, then
names are halved into left and right by a hash of name and round, and each left followed by a right becomes a pair with a name of its own.
Names are hashes of what they stand for, so all tasks give equal substrings equal names without asking each other.

Around its ends a substring's names depend on what stands beside it; inside they don't. Each name carries the span of words that its making
looked at (`lo` to `hi`). A name whose span lies within a window is an interior name of that window: every other occurrence of the window has
it at the same place. A window's anchor is the interior name whose key is least, and of equal ones the first; a window without one takes a word, a name of round 0, in the same way. So equal windows have equal anchors, and an anchor that is not shared by two
documents rules out all its windows at once. That leaves far fewer rows to shuffle than there are windows:

1. reveal: rows (key, run, document) of all anchors; a key is shared if its least and greatest document differ. `run` hashes the words of
   all consecutive windows of that anchor. If a shared key has one run only, equality of its windows is thereby verified.
2. verify: for shared keys with several runs (ends of repeats), the windows themselves are compared by 128 bits.
3. remove: words under windows that also start in a smaller document go.

Defined results: a null text has no words; a null doc_id counts as larger than any other, and is returned as null; rows with the same doc_id
don't remove each other's words; texts of fewer words than a window are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, discard, pieces, texts, written

WINDOW = 13
ROUNDS = 2
#: Words handled at once; a longer document is handled in parts that overlap by a window less one word.
CHUNK = 1 << 14
#: Bytes of text whose words are named at once.
AT_ONCE = 2 << 20
#: Shares of the keys that are shuffled one after another.
PASSES = 4
FAR = 1 << 40
NO_ID = (1 << 63) - 1
_P, _Q = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes are hashed one by one.
LONG = 512


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A well mixed 64-bit hash of each number."""
    x = (x ^ np.uint64(salt * _Q & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def named_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name, not 0, for each word of many texts, and at which word each text begins. data: their bytes, one text after another.

    A word's hash takes in eight bytes after eight, each time well mixed; a word's place doesn't matter."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inner = ~_BLANK[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]  # a text may begin or end without a blank
    first[edge], last[edge - 1] = inner[edge], inner[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    eight = np.ndarray((n,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,))
    left = ends - starts
    name = mix(left.astype(np.uint64) + np.uint64(_P), 31)
    long = np.flatnonzero(left > LONG)
    on, at, left = np.arange(len(starts)), starts, np.where(left > LONG, 0, left)
    while True:
        more = np.flatnonzero(left > 0)
        if not len(more):
            break
        on, at, left = on[more], at[more], left[more]
        block = eight[at]
        tail = left < 8
        block[tail] &= (np.uint64(1) << (left[tail] * 8).astype(np.uint64)) - np.uint64(1)
        name[on] = mix((name[on] ^ block) + np.uint64(_Q), 33)
        at, left = at + 8, left - 8
    if len(long):
        from xxhash import xxh3_64_intdigest as xxh

        name[long] = [xxh(data[i:j].tobytes()) for i, j in zip(starts[long].tolist(), ends[long].tolist())]
    name[name == 0] = 1
    return name, np.searchsorted(starts, offsets)


def batch_names(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """named_words of a column of texts; a null text has no words."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return named_words(data, offsets - offsets[0])


def forget() -> None:
    _powers.clear()


class Spans:
    """Hashes of any spans of a string of names."""

    def __init__(self, names: np.ndarray, base: int = _P):
        up, self.down = _power(len(names) + 1, base)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * up[: len(names)])))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo], 77)


def rounds(names: np.ndarray, rounds_: int = ROUNDS) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, start, lo, hi) of the string's names after each round, from round 0. A zero name separates strings and never joins others."""
    n = len(names)
    sym, start = names, np.arange(n)
    lo, hi = start, start + 1
    wall = sym == 0
    lo, hi = np.where(wall, -FAR, lo), np.where(wall, FAR, hi)
    yield sym, start, lo, hi
    for r in range(1, rounds_ + 1):
        # runs of one name
        first = np.flatnonzero(np.concatenate(([True], (sym[1:] != sym[:-1]) | wall[1:])))
        length = np.diff(np.append(first, len(sym)))
        wide_lo, wide_hi = lo.copy(), hi.copy()
        np.minimum(wide_lo[1:], lo[:-1], out=wide_lo[1:])
        np.minimum(wide_lo[:-1], lo[1:], out=wide_lo[:-1])
        np.maximum(wide_hi[1:], hi[:-1], out=wide_hi[1:])
        np.maximum(wide_hi[:-1], hi[1:], out=wide_hi[:-1])
        lo, hi = np.minimum.reduceat(wide_lo, first), np.maximum.reduceat(wide_hi, first)
        one = sym[first]
        sym, start, wall = np.where(length > 1, mix(one + length.astype(np.uint64) * np.uint64(_P), 2 * r), one), start[first], wall[first]
        # pairs of a left and a right name
        right = (mix(sym, 100 + r) >> np.uint64(63)).astype(bool)
        left = ~right & ~wall
        right &= ~wall
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & right[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        # a pair looked at both; a left alone at the next, a right alone at the one before
        ahead, behind = left, right & ~second
        new_lo, new_hi = lo.copy(), hi.copy()
        a = np.flatnonzero(ahead[:-1])
        new_lo[a], new_hi[a] = np.minimum(lo[a], lo[a + 1]), np.maximum(hi[a], hi[a + 1])
        b = np.flatnonzero(behind[1:]) + 1
        new_lo[b], new_hi[b] = np.minimum(lo[b], lo[b - 1]), np.maximum(hi[b], hi[b - 1])
        p = np.flatnonzero(pair)
        sym = sym.copy()
        sym[p] = mix(mix(sym[p], 200 + r) + sym[p + 1], 300 + r)
        kept = ~second
        sym, start, lo, hi, wall = sym[kept], start[kept], new_lo[kept], new_hi[kept], wall[kept]
        yield sym, start, lo, hi


def anchors(names: np.ndarray, window: int = WINDOW, rounds_: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, key, run) of each run of consecutive windows with one anchor. names: strings with zeros around."""
    n = len(names)
    span = Spans(names)
    last = n - window
    none = np.zeros(0, np.int64)
    if last < 0:
        return none, none, none, none
    open_ = np.cumsum(np.concatenate(([0], names == 0)))
    valid = open_[window:] == open_[: last + 1]
    where = np.full(last + 1, -1, np.int64)

    def chosen(c: np.ndarray, weight: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int, free: np.ndarray | None) -> None:
        at, to = np.maximum(hi - window, 0), np.minimum(lo, last)
        order = np.lexsort((-start, ~weight))  # the last to write wins
        count = np.maximum(to - at + 1, 0)[order]
        ends = np.cumsum(count)
        target = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - at[order], count)
        value = np.repeat(c[order] + base, count)
        if free is not None:
            value, target = value[free[target]], target[free[target]]
        where[target] = value

    level0, *levels = rounds(names, rounds_)
    parts = []
    for r, (sym, start, lo, hi) in enumerate([level0, *levels]):
        inside = (hi - lo <= window) & (sym != 0)
        if r == 0 and levels:
            parts.append(None)
            continue
        c = np.flatnonzero(inside)
        key = mix(sym[c] + np.uint64(r) + mix(span(lo[c], hi[c]) + (start[c] - lo[c]).astype(np.uint64), 5), 6)
        parts.append((key, key, start[c], lo[c], hi[c]))
    if any(parts):
        key, *rest = (np.concatenate(x) for x in zip(*(x for x in parts if x)))
    else:
        key, rest = np.zeros(0, np.uint64), [np.zeros(0, np.uint64), none, none, none]
    if len(key):
        chosen(np.arange(len(key)), *rest, 0, None)
    free = (where < 0) & valid
    if free.any():
        under = np.concatenate(([0], np.cumsum(free)))
        i = np.arange(n)
        c = np.flatnonzero((under[np.minimum(i, last) + 1] > under[np.maximum(i - window + 1, 0)]) & (names != 0))
        word = mix(names[c], 9)
        chosen(np.arange(len(c)), word, c, c, c + 1, len(key), free)
        key = np.concatenate((key, word))
    if not valid.any():
        return none, none, none, none
    place = np.where(valid, where, -1)
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    size = np.diff(np.append(head, last + 1))
    real = place[head] >= 0
    head, size = head[real], size[real]
    return head, size, key[place[head]], span(head, head + size + window - 1)


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """(names with zeros around each document, its documents' rows: (place, words before it, columns of the row))."""
    held: list[np.ndarray] = [np.zeros(1, np.uint64)]
    rows: list[tuple] = []
    size = 1
    for batch in pieces(batches, AT_ONCE):
        names, firsts = batch_names(batch.column("text"))
        for doc, th, a, b in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), firsts.tolist(), firsts[1:].tolist()):
            for i in range(a, max(a + 1, b - window + 1), CHUNK - window + 1):
                part = names[i : min(b, i + CHUNK)]
                if len(part) < window:
                    continue
                if size + len(part) > CHUNK and rows:
                    yield np.concatenate(held), rows
                    held, rows, size = [np.zeros(1, np.uint64)], [], 1
                rows.append((size, i - a, doc, th))
                held += [part, np.zeros(1, np.uint64)]
                size += len(part) + 1
    if rows:
        yield np.concatenate(held), rows


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def anchor_table(docs: DataFrame, window: int = WINDOW, rounds_: int = ROUNDS) -> DataFrame:
    """key, run, doc, th (hash of the text, which tells rows with one doc_id apart), at (first window), n (windows)."""
    bounded_batches(docs.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("recompress", forget)
        with np.errstate(over="ignore"):
            for names, rows in _chunks(batches, window):
                head, size, key, run = anchors(names, window, rounds_)
                place, before, doc, th = (np.array(x, np.int64) for x in zip(*rows))
                of = np.searchsorted(place, head, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), pa.array(doc[of]), pa.array(th[of]), pa.array(head - place[of] + before[of]), pa.array(size.astype(np.int32))], ["key", "run", "doc", "th", "at", "n"])

    return _numbered(docs).mapInArrow(parsed, "key long, run long, doc long, th long, at long, n int")


def window_hashes(names: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(Spans(names, b)(starts, starts + window).view(np.int64) for b in (_P, _Q))


def repeats(docs: DataFrame, window: int = WINDOW, rounds_: int = ROUNDS) -> DataFrame:
    """doc, th, spans: for documents with windows that also start in a smaller document, the runs (at, n) of such windows.

    Each step is written, and the tables it was made of are deleted."""
    found = written(anchor_table(docs, window, rounds_), "anchors")
    shared, revealed = [], []
    for k in range(PASSES):  # a share of the keys at a time, so that only its rows lie shuffled on disk
        part = found.where(F.pmod(F.shiftrightunsigned("key", 7), F.lit(PASSES)) == k)
        keys = part.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("run").alias("r0"), F.max("run").alias("r1"))
        # what is joined is a table of its own: a key that very many rows share is split by Spark's handling of skewed joins
        shared.append(written(keys.where("least < most").select("key", "least", (F.col("r0") == F.col("r1")).alias("sure")), "shared"))
        revealed.append(written(part.join(shared[-1], "key").where("not sure or doc > least").select("key", "run", "doc", "th", "at", "n", "sure"), "revealed"))
    discard(found, *shared)
    tables, revealed = revealed, reduce(DataFrame.unionByName, revealed)
    # equal runs are equal windows: of each run only the rows of its smallest document are left to be looked at window by window
    unsure = revealed.where("not sure").drop("sure")
    runs = written(unsure.groupBy("key", "run").agg(F.min("doc").alias("least")), "runs")
    told = written(unsure.join(runs, ["key", "run"]).select("doc", "th", "at", "n", (F.col("doc") > F.col("least")).alias("sure")), "told")
    spans = ["doc", "th", "at", "n"]
    sure = revealed.where("sure").select(*spans).unionByName(told.where("sure").select(*spans))
    open_ = told.where("not sure").groupBy("doc", "th").agg(F.collect_list(F.struct("at", "n")).alias("runs"))  # of one document

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("recompress", forget)
        for batch in pieces(batches, AT_ONCE):
            with np.errstate(over="ignore"):
                every, firsts = batch_names(batch.column("text"))
                for doc, th, i, j, runs in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), firsts.tolist(), firsts[1:].tolist(), batch.column("runs").to_pylist()):
                    names, k = every[i:j], 0
                    starts = np.unique(np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in runs]))
                    while k < len(starts):  # a long document goes by parts
                        part = starts[k : np.searchsorted(starts, starts[k] + CHUNK)]
                        a, b = window_hashes(names[part[0] : part[-1] + window], part - part[0], window)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), th)), pa.array(part)], ["a", "b", "doc", "th", "at"])
                        k += len(part)

    near = _numbered(docs).join(open_, ["doc", "th"]).select("doc", "th", "text", "runs")
    rows = written(near.mapInArrow(windows, "a long, b long, doc long, th long, at long"), "windows")
    first = written(rows.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "first")
    verified = rows.join(first, ["a", "b"]).where("doc > least").select("doc", "th", "at", F.lit(1).alias("n"))
    spans = written(sure.unionByName(verified).groupBy("doc", "th").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    discard(*tables, runs, told, rows, first)
    return spans


def keep_mask(n: int, spans: list, window: int = WINDOW) -> np.ndarray:
    """Which of n words stay."""
    edge = np.zeros(n + 1, np.int64)
    at = np.array([s["at"] for s in spans], np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + [s["n"] + window - 1 for s in spans], n), -1)
    return np.cumsum(edge)[:n] <= 0


def removed(docs: DataFrame, window: int = WINDOW, rounds_: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, th and kept_text (kept words joined by one space)."""
    bounded_batches(docs.sparkSession)
    joined = _numbered(docs).join(repeats(docs, window, rounds_), ["doc", "th"], "left").select("doc", "th", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("recompress", forget)
        for batch in pieces(batches):
            out = []
            for doc, th, text, spans in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), texts(batch), batch.column("spans").to_pylist()):
                words = (text or b"").split()
                kept = [w for w, k in zip(words, keep_mask(len(words), spans, window).tolist()) if k] if spans else words
                whole = b" ".join(kept)
                out.append((None if doc == NO_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), th, whole))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            arrays[5] = arrays[5].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays[: 6 if keep_text else 4], ["doc_id", "n_words", "n_removed", "kept_sha256", "th", "kept_text"][: 6 if keep_text else 4])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", th long, kept_text string" * keep_text)


def cut_texts(docs: DataFrame, window: int = WINDOW, rounds_: int = ROUNDS) -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut out of text and n_chars (if there) counted anew.

    A text of which nothing is cut stays as it is, white space included; else its kept words are joined by one space. A document of which
    nothing is left stays, with an empty text."""
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    spans = repeats(docs, window, rounds_)
    # the row goes as one column, so that no name of its own meets another
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.struct(*(f"`{c}`" for c in names)).alias("row"))
    joined = keyed.join(spans, ["doc", "th"], "left").select("row", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("recompress", forget)
        for batch in pieces(batches):
            cols = dict(zip(names, batch.column("row").flatten()))
            out = []
            for text, spans in zip(texts(pa.RecordBatch.from_arrays([cols["text"]], ["text"])), batch.column("spans").to_pylist()):
                if spans:
                    words = text.split()
                    text = b" ".join([w for w, k in zip(words, keep_mask(len(words), spans, window).tolist()) if k])
                out.append(text)
            cols["text"] = pa.array(out, pa.binary()).cast(pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pc.utf8_length(cols["text"]).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return joined.mapInArrow(cut, schema)
