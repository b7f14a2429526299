"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths and equal lengths are bucketed.

A document of t tokens gives t // 4096 pieces of 4096 and one piece for each bit of the rest, longest first. Every piece is a sequence of
its own, so no sequence crosses documents and, lengths being powers of two, none is padded. Sequences are numbered by bucket, so that a run
of equal numbers of tokens makes a batch.

Defined results: a null or empty text is the end token alone; repeated rows give a set of pieces each; a null doc_id stays null.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, pieces, texts, written

CAPACITY = 4096
END = 2
_held: dict = {}
#: Bytes that the remembered words of a worker take, about; beyond that it starts anew.
MEMORY = 128 << 20
#: ASCII signs but for the apostrophe, which may begin a token of letters.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters beyond ASCII that every version of Unicode in use calls letters, as UTF-8.
LATIN = frozenset(chr(c).encode() for c in range(0xC0, 0x250) if chr(c).isalpha() and len(chr(c).lower()) == 1)
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")  # U+0130 is two characters in lower case
#: Plain words that the tokenizer gets as one text.
TOGETHER = 2000


class Words:
    """The ids of words as little-endian unsigned 32-bit numbers.

    ASCII signs behind a letter or digit are tokens of their own, and letter case is lost: a word's ids are those of its core and its signs,
    which are remembered. Of plain cores (letters only) many are encoded as one text; tokens that end a word tell them apart again."""

    def __init__(self, tok, most: int = MEMORY):
        self.tok, self.most, self.held = tok, most, 0
        ids = lambda x: tok.encode(x, add_special_tokens=False).ids
        signs = SIGNS.decode()
        self.low = ids("Ab Ba") == ids("ab ba")
        self.signs = SIGNS if all(ids(x + s) == ids(x) + ids(s) for x in ("ab", "x1", "\u00e9") for s in (*signs, signs, *(a + b for a in signs for b in signs))) else b""
        suffix = getattr(tok.model, "end_of_word_suffix", None)
        vocab = tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {b"": b""}

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words."""
        if self.held > self.most:
            self.known, self.held = {b"": b""}, 0
        small = b"\n".join(words).lower().split(b"\n") if self.low and words else words
        cores, tails = small, []
        if self.signs:
            cores = [w.rstrip(self.signs) for w in small]
            cores = [c if c[-1:].isalnum() or c[-2:] in LATIN else w for c, w in zip(cores, small)]
            tails = [w[len(c) :] for c, w in zip(cores, small)]
        self._learn(list({*cores, *tails} - self.known.keys()))
        of = self.known.__getitem__
        return [of(c) + of(t) if t else of(c) for c, t in zip(cores, tails)] if tails else list(map(of, cores))

    def _learn(self, new: list[bytes]) -> None:
        as_text = [w.decode("utf-8", "replace") for w in new]
        plain = [bool(_PLAIN.fullmatch(w)) for w in as_text] if self.ends.any() else [False] * len(new)
        rest = [k for k, p in enumerate(plain) if not p]
        many = [k for k, p in enumerate(plain) if p]
        for i in range(0, len(many), TOGETHER):
            part = many[i : i + TOGETHER]
            ids = np.array(self.tok.encode_batch_fast([" ".join([as_text[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stop) != len(part) or stop[-1] != 4 * len(ids):
                rest += part
                continue
            packed, at = ids.tobytes(), 0
            for k, to in zip(part, stop.tolist()):
                self.known[new[k]] = packed[at:to]
                at = to
        for i in range(0, len(rest), TOGETHER):
            part = rest[i : i + TOGETHER]
            for k, e in zip(part, self.tok.encode_batch_fast([as_text[k] for k in part], add_special_tokens=False)):
                self.known[new[k]] = array("I", e.ids).tobytes()
        self.held += sum(map(len, new)) + sum(len(self.known[w]) for w in new) + 160 * len(new)


def encoder(path: str):
    """A function from UTF-8 texts to their ids as little-endian unsigned 32-bit numbers, by the tokenizer file at path.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its words one after another; each distinct
    word is encoded once for many texts. A file whose pre-tokenizer doesn't separate at white space is encoded text by text, and so are
    texts with a word that holds an added token (like <|endoftext|>) in any letter case: those are looked for before case is lost."""
    if path in _held:
        return _held[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core already
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = lambda x: tok.encode(x, add_special_tokens=False).ids
    added = [a.content for a in tok.get_added_tokens_decoder().values()]
    apart = ids("a b") == ids("a") + ids("b") and not any(a.split() != [a] for a in added)

    def whole(some: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch([t.decode("utf-8", "replace") for t in some], add_special_tokens=False)]

    words = Words(tok) if apart else None
    marks = [a.lower().encode() for a in added]

    def by_word(some: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(some, pa.large_binary()).view(pa.large_string()))
        ends = split.offsets.to_numpy()
        coded = split.flatten().view(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = pa.array(words(distinct), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [b""] * len(some)
        at = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[ends].tolist()
        held = memoryview(ids.buffers()[2] or b"")
        out = [bytes(held[a:b]) for a, b in zip(at, at[1:])]
        every = b"\n".join(distinct).lower()
        if any(m in every for m in marks):
            marked = np.array([any(m in w.lower() for m in marks) for w in distinct])[coded.indices.to_numpy()]
            marked = np.concatenate(([0], np.cumsum(marked)))[ends]
            for k in np.flatnonzero(np.diff(marked)).tolist():
                out[k] = whole([some[k]])[0]
        return out

    _held[path] = by_word if apart else whole
    return _held[path]


def binary_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """n as a sum of capacity again and again and of smaller powers of two, longest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if rest >> b & 1]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, its part (the task that cut it) and place (among the part's pieces of this
    length) and, if asked for, its ids. A table to be written before parts and places are used."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"] + ["ids"] * ids

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing", _held.clear)
        encode, stop = encoder(tokenizer), end.to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), dict.fromkeys((capacity >> b for b in range(capacity.bit_length())), 0)
        for batch in pieces(batches):
            cols: list[list] = [[] for _ in names]
            for doc, own in zip(batch.column("doc_id").to_pylist(), encode([t or b"" for t in texts(batch)])):
                view, total, at = memoryview(own + stop), len(own) // 4 + 1, 0
                for n in binary_lengths(total, capacity):
                    piece = view[4 * at : 4 * (at + n)]
                    for c, v in zip(cols, (doc, at, n, zlib.crc32(piece), total, part, seen[n], np.frombuffer(piece, "<u4") if ids else None)):
                        c.append(v)
                    seen[n] += 1
                    at += n
            kinds = [pa.int64()] * 7 + [pa.list_(pa.uint32())] * ids
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if ids:
                arrays[7] = arrays[7].cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cutting, ", ".join(f"{x} long" for x in names[:7]) + ", ids array<bigint>" * ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces with sequence_id (gapless from 0, longest bucket first), offset (0) and batch (within the bucket, of capacity tokens each).

    The pieces are written once, with the numbers of their parts and places: whatever reads the table again, in whichever splits and after
    whichever executors are lost, finds the same numbers. Only counts by part and length, a few numbers a part, are put in order."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity is a power of two")
    kept = written(cut(docs, tokenizer, capacity, end, ids), "pieces")
    counts = kept.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    within = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # the table is as large as the number of parts makes it: Spark broadcasts it only if its files are small
    base = written(counts.select("length", "part", "n", F.coalesce(within, F.lit(0)).alias("within")), "places")
    longer = F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each power of two
    buckets = base.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(longer, F.lit(0)).alias("longer"))
    joined = kept.join(base.drop("n"), ["length", "part"]).join(F.broadcast(buckets), "length")
    at = F.col("within") + F.col("place")
    a_batch = F.greatest(F.lit(1), F.lit(capacity) / F.col("length"))
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("longer") + at).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.floor(at / a_batch).alias("batch"), *["ids"] * ids)
