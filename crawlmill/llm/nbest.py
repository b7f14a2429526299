"""N-best SentencePiece segmentation over the piece lattice.

A forward Viterbi pass gives the best score from the text's start to every place. A search from the end backwards then has exact heuristics:
what a partial path from the end costs plus the forward score of its place is the score of its best completion, so A* yields whole paths in
the order of their scores and never expands a path that isn't part of an answer or next to one.

Places between two characters that no piece spans cut the lattice into parts whose segmentations are chosen independently; no piece goes on
into a word's leading space. Each distinct word is looked at once by a worker. The N best of a text use, besides each word's best, only the
words with the N - 1 smallest second-best losses; the A* search over those words' alternatives gives the N best of the whole text, however
long it is.

Texts are escaped as the model does it: a space before the text, spaces as U+2581. Characters without a piece become their UTF-8 bytes.

Defined results: null and empty texts have one segmentation, of no pieces; texts with fewer than N segmentations give all they have;
equal scores are ordered by the search (later places first).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, pieces

SPACE = "▁"
BEST = 4
#: How far below the least score of any piece but mere spaces a character without a piece scores.
UNKNOWN_LOSS = 10.0
#: Bytes that the words a worker remembers take, about, and those of one word without its letters; beyond that it starts anew.
KEPT_BYTES, WORD_BYTES = 128 << 20, 400
#: Words of one length that are looked at together: their number, at least and at most, and the longest such.
FEWEST_AT_ONCE, AT_ONCE, LONGEST_AT_ONCE = 8, 2048, 40
#: Characters with a column in the table of the trie.
CLASSES = 256
_models: dict[str, Lattice] = {}


class Lattice:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes = {}, {}, [0] * 256
        self.text = {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, float(m.get_score(i))
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.least = min(v for p, v in self.scores.items() if p.strip(SPACE)) - UNKNOWN_LOSS
        self.longest = max(map(len, self.ids))
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, tuple] = {}
        self.known_bytes = 0
        self.lists: dict[str, list] = {}
        self.words, self.spaced = _Known(self, ""), _Known(self, SPACE)
        self.trie = _Trie(self)
        self.lines = not any("\n" in pair for pair in self.joined)

    def parts(self, word: str) -> list[str]:
        """A word, cut wherever no piece spans two characters."""
        out, a = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                out.append(word[a:i])
                a = i
        out.append(word[a:])
        return out

    def found(self, text: str) -> tuple[list[str], list[tuple]]:
        """The words of the escaped text, spaces before them included, and what is known of each. Empty without a text."""
        if not text:
            return [], []
        words: list[str] = []
        known: list[tuple] = []
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            if k:
                words.append("\n")
                known.append(self.words["\n"])
            if "  " in line or line[-1:] == " " or line[:1] == " " or SPACE in line:
                some = list(_words((SPACE if not k else "") + line.replace(" ", SPACE)))
                words += some
                known += map(self.words.__getitem__, some)
                continue
            first, *rest = line.split(" ")
            if not k or first:
                words.append(first if k else SPACE + first)
                known.append(self.words[words[-1]])
            words += rest
            known += map(self.spaced.__getitem__, rest)
        return words, known

    def _of(self, word: str) -> tuple:
        """ids, their number, score, least loss, the word and its text, from the word's parts."""
        some = [self.summary(x) for x in self.parts(word)]
        return b"".join(x[0] for x in some), sum(x[1] for x in some), sum(x[2] for x in some), min(x[3] for x in some), word

    def prepare(self, some: list[str]) -> None:
        """Looks at the new words of many texts at once: all words of one length go through the trie, forward and backward together."""
        plain, spaced = set(), set()
        for text in some:
            for line in text.split("\n") if self.lines else ():
                first, *rest = line.split(" ")
                plain.add(first)
                spaced.update(rest)
        for known, words in ((self.words, plain), (self.spaced, spaced)):
            words.discard("")
            known.make_room()
            words -= known.keys()
            by_length: dict[int, list[str]] = {}
            for w in words:
                by_length.setdefault(len(w), []).append(w)
            for n, alike in by_length.items():
                if n <= LONGEST_AT_ONCE and len(alike) >= FEWEST_AT_ONCE:
                    for i in range(0, len(alike), AT_ONCE):
                        known.learn(alike[i : i + AT_ONCE])

    def edges(self, s: str) -> list[list[tuple[int, float]]]:
        """For each end the (start, score) of the pieces that end there."""
        scores, n = self.scores, len(s)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if s[i] not in scores:
                ends[i + 1].append((i, self.least))
            for j in range(i + 1, min(n, i + self.longest) + 1):
                v = scores.get(s[i:j])
                if v is not None:
                    ends[j].append((i, v))
        return ends

    @staticmethod
    def forward(ends: list[list[tuple[int, float]]]) -> list[float]:
        best = [0.0]
        for j in range(1, len(ends)):
            best.append(max([best[i] + v for i, v in ends[j]]))
        return best

    def search(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a part: score and ids."""
        ends = self.edges(s)
        best = self.forward(ends)
        out: list[tuple[float, tuple[int, ...]]] = []
        heap: list[tuple] = [(-best[-1], 0, len(s), 0.0, None)]
        made = 0
        while heap and len(out) < n:
            _, _, j, tail, chain = heapq.heappop(heap)
            if not j:
                ids: list[int] = []
                while chain:
                    (i, k), chain = chain
                    ids += [self.ids[s[i:k]]] if s[i:k] in self.ids else [self.bytes[b] for b in s[i:k].encode("utf-8", "replace")]
                out.append((tail, tuple(ids)))
                continue
            for i, v in ends[j]:
                made += 1
                heapq.heappush(heap, (-(best[i] + v + tail), -made, i, tail + v, ((i, j), chain)))
        return out

    def summary(self, s: str) -> tuple[bytes, int, float, float]:
        """Ids of the best segmentation as bytes, their number, its score, and the loss of the second best (infinite if there is none)."""
        got = self.known.get(s)
        if got is not None:
            return got
        if self.known_bytes > KEPT_BYTES // 2:
            self.known.clear()
            self.known_bytes = 0
        self.known_bytes += WORD_BYTES + 5 * len(s)
        get, longest, n = self.scores.get, self.longest, len(s)
        best, start = [0.0] * (n + 1), [0] * (n + 1)
        edges: list[tuple[int, int, float]] = []
        for j in range(1, n + 1):
            top = -np.inf
            for i in range(j - longest if j > longest else 0, j):
                v = get(s[i:j])
                if v is None:
                    if i + 1 < j or s[i] in self.scores:
                        continue
                    v = self.least
                edges.append((i, j, v))
                x = best[i] + v
                if x >= top:
                    top, start[j] = x, i
            best[j] = top
        on, j, ids = [False] * (n + 1), n, []
        while j:
            i, on[j] = start[j], True
            piece = s[i:j]
            ids[:0] = [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode("utf-8", "replace")]
            j = i
        back, second = [-np.inf] * n + [0.0], -np.inf
        for i, j, v in reversed(edges):
            x = back[j] + v
            if x > back[i]:
                back[i] = x
            if not (on[j] and start[j] == i) and best[i] + x > second:
                second = best[i] + x
        got = self.known[s] = (b"".join([x.to_bytes(4, "little") for x in ids]), len(ids), best[n], best[n] - second)
        return got

    def best(self, text: str | None, n: int = BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: score and ids as little-endian unsigned 32-bit numbers."""
        _, found = self.found(text or "")
        base = float(sum([f[2] for f in found]))
        loss = np.array([f[3] for f in found])
        near = np.sort(np.argsort(loss, kind="stable")[: n - 1]) if len(loss) < 4 * n else np.sort(np.argpartition(loss, n - 2)[: n - 1])
        near = near[np.isfinite(loss[near])] if len(near) else near
        choices = [self._list(found[k][4], n) for k in near]
        # the lattice of these words: the best of those before is the forward score, so its loss is none
        picked: list[tuple[float, tuple]] = []
        heap: list[tuple] = [(0.0, 0, len(near), ())]
        made = 0
        while heap and len(picked) < n:
            lost, _, k, chosen = heapq.heappop(heap)
            if not k:
                picked.append((lost, chosen))
                continue
            for score, ids in choices[k - 1]:
                made += 1
                heapq.heappush(heap, (lost + choices[k - 1][0][0] - score, -made, k - 1, (ids, *chosen)))
        whole, out = [f[0] for f in found], []
        for lost, chosen in picked:
            for k, ids in zip(near, chosen):
                whole[k] = np.array(ids, "<u4").tobytes()
            out.append((base - lost, b"".join(whole)))
        return out

    def _list(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        got = self.lists.get(part)
        if got is None or len(got) < n:
            if len(self.lists) > 50_000:
                self.lists.clear()
            got = self.lists[part] = self.search(part, n)
        return got[:n]

    def decode(self, ids) -> str:
        """The text of ids: the pieces' texts without the leading space."""
        return b"".join(self.text.get(int(i), b"") for i in ids).decode("utf-8", "replace").removeprefix(" ")


class _Known(dict):
    """By word without its leading space: what the lattice knows of the word with it."""

    def __init__(self, of: Lattice, space: str):
        super().__init__()
        self.of, self.space, self.held = of, space, 0

    def make_room(self, most: int = KEPT_BYTES) -> None:
        if self.held > most:
            self.clear()
            self.held = 0

    def __missing__(self, word: str) -> tuple:
        self.make_room(2 * KEPT_BYTES)  # what a batch was prepared with stays for it
        got = self[word] = self.of._of(self.space + word)
        self.held += WORD_BYTES + 5 * len(word)
        return got

    def learn(self, words: list[str]) -> None:
        """Words of one length, at once; those with characters that are no pieces are left for later."""
        space = self.space
        for w, got in self.of.trie.summaries([space + w for w in words]):
            self[w[len(space) :]] = got
            self.held += WORD_BYTES + 5 * len(w)


class _Trie:
    """The pieces by their characters, as tables, so that many words of one length are looked at together.

    Only the CLASSES characters that most pieces hold have columns; words with others go the usual way."""

    def __init__(self, of: Lattice):
        self.of = of
        often = Counter(c for p in of.ids for c in set(p))
        letters = [c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0])) if c in of.ids][:CLASSES]
        classes = {c: k for k, c in enumerate(letters, 1)}
        self.classes = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        for c, k in classes.items():
            self.classes[ord(c)] = k
        steps: list[dict[int, int]] = [{}]
        ids, scores = [-1], [-np.inf]
        for piece, i in of.ids.items():
            at = 0
            for c in piece:
                k = classes.get(c)
                if k is None:
                    break
                if k not in steps[at]:
                    steps[at][k] = len(steps)
                    steps.append({})
                    ids.append(-1)
                    scores.append(-np.inf)
                at = steps[at][k]
            else:
                ids[at], scores[at] = i, of.scores[piece]
        # nodes with children come first: only they have rows; node 0 is the root, the last row stands for no node
        order = [0, *(k for k in range(1, len(steps)) if steps[k]), *(k for k in range(1, len(steps)) if not steps[k])]
        new = {old: k for k, old in enumerate(order)}
        self.inner, self.none = sum(map(bool, steps)) or 1, len(steps)
        self.next = np.full((self.inner, len(letters) + 1), self.none, np.int32)
        for old in order[: self.inner]:
            for k, to in steps[old].items():
                self.next[new[old], k] = new[to]
        self.ids = np.array([*(ids[k] for k in order), -1], np.int64)
        self.scores = np.array([*(scores[k] for k in order), -np.inf])

    def summaries(self, words: list[str]) -> Iterator[tuple[str, tuple]]:
        """(word, (ids, their number, score, loss of the second best, word)) of words of one length, but for those with other characters."""
        n, deep = len(words[0]), min(len(words[0]), self.of.longest)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
        cls = self.classes[np.minimum(points, len(self.classes) - 1)]
        fit = cls.all(axis=1)
        if not fit.all():
            words, cls = [w for w, f in zip(words, fit.tolist()) if f], cls[fit]
        m = len(words)
        if not m:
            return
        edge = np.full((deep + 1, n, m), -np.inf)  # by length, start and word
        piece = np.full((deep + 1, n, m), -1, np.int64)
        for i in range(n):
            alive, node = np.arange(m), np.zeros(m, np.int32)
            for k in range(1, min(deep, n - i) + 1):
                node = self.next[node, cls[alive, i + k - 1]]
                on = node < self.none
                alive, node = alive[on], node[on]
                if not len(alive):
                    break
                edge[k, i, alive], piece[k, i, alive] = self.scores[node], self.ids[node]
                on = node < self.inner
                alive, node = alive[on], node[on]
        every = np.arange(m)
        best, length = np.zeros((n + 1, m)), np.zeros((n + 1, m), np.int64)
        for j in range(1, n + 1):
            ks = np.arange(min(j, deep), 0, -1)  # of equal scores the latest start
            x = best[j - ks] + edge[ks, j - ks]
            at = len(ks) - 1 - x[::-1].argmax(axis=0)
            best[j], length[j] = x[at, every], ks[at]
        back = np.full((n + 1, m), -np.inf)
        back[n] = 0.0
        for i in range(n - 1, -1, -1):
            ks = np.arange(1, min(deep, n - i) + 1)
            back[i] = (edge[ks, i] + back[i + ks]).max(axis=0)
        # the best path, from its end; its edges are taken out before the second best is looked for
        chosen, count, at = np.zeros((n, m), np.int64), np.zeros(m, np.int64), np.full(m, n)
        second = np.full(m, -np.inf)
        while True:
            on = np.flatnonzero(at)
            if not len(on):
                break
            k = length[at[on], on]
            start = at[on] - k
            chosen[count[on], on] = piece[k, start, on]
            count[on] += 1
            edge[k, start, on] = -np.inf
            at[on] = start
        for k in range(1, deep + 1):
            np.maximum(second, (best[: n - k + 1] + edge[k, : n - k + 1] + back[k:]).max(axis=0), out=second)
        score = best[n]
        with np.errstate(invalid="ignore"):
            loss = (score - second).tolist()
        packed = np.ascontiguousarray(chosen.T.astype("<u4"))
        for w, row, c, v, lost in zip(words, packed, count.tolist(), score.tolist(), loss):
            yield w, (row[:c][::-1].tobytes(), c, v, lost, w)


def _words(s: str) -> Iterator[str]:
    """Spaces stay with the word after them: no piece has a space behind another character."""
    at, n = 0, len(s)
    for chunk in s.replace(SPACE, "\x00" + SPACE).split("\x00") if "\x00" not in s else [s]:
        if not chunk:
            continue
        if chunk == SPACE:
            at += 1
            continue
        yield SPACE * at + chunk
        at = 0
    if at:
        yield SPACE * at


def lattice(path: str) -> Lattice:
    if path not in _models:
        _models[path] = Lattice(path)
    return _models[path]


def segmentations(docs: DataFrame, model: str, n: int = BEST, ids: bool = False) -> DataFrame:
    """doc_id, rank (from 1), score, n_pieces, ids_crc32 (little-endian unsigned 32-bit), decodes (the ids give the text back) and, if asked for, ids."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decodes"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("nbest", _models.clear)
        of = lattice(model)
        for batch in pieces(batches):
            rows, own = [], batch.column("text").to_pylist()
            of.prepare([t for t in own if t])
            for doc, text in zip(batch.column("doc_id").to_pylist(), own):
                back: dict[bytes, bool] = {}
                for k, (score, packed) in enumerate(of.best(text, n), 1):
                    numbers = np.frombuffer(packed, "<u4").tolist()
                    said = b"".join(map(of.text.__getitem__, numbers))
                    ok = back.get(said)
                    if ok is None:
                        ok = back[said] = said.decode("utf-8", "replace").removeprefix(" ") == (text or "")
                    rows.append((doc, k, score, len(numbers), zlib.crc32(packed), ok, numbers if ids else None)[: len(names)])
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decodes boolean" + ", ids array<bigint>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
