"""The pipeline on the smallest tables, and every stage on awkward rows against a plain version of it."""

import itertools
import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crawlmill.llm import langid, packing, toxicity
from crawlmill.llm.common import table

SF = "/root/testdata/sf0.001"
#: Columns that stages use inside.
CLASH = ["__doc", "__th", "__spans", "row", "spans", "doc", "th", "node", "root", "size", "prefix", "kept_id", "kept_hash", "text_hash", "label", "score", "part", "place"]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    schema, before = docs.schema, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema], name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert all(sum(r["length"] for r in x) == x[0]["doc_tokens"] for x in by_doc.values())


def words(n, seed, of=3000):
    r = random.Random(seed)
    return " ".join(r.choice(["gar", "tol", "min", "pes", "lat"]) + r.choice(["en", "is", "or"]) + "abcdefghij"[r.randrange(10)] * (1 + r.randrange(of) % 2) for _ in range(n))


PASSAGE = words(60, 999)
ROWS = [
    (1, words(200, 1), "a"), (2, words(200, 1), "a"), (3, words(200, 1) + " end", None), (4, None, None), (None, None, "a"), (5, "", "b"), (6, " \n ", None), (7, "12 34 !!", "b"),
    (8, words(80, 8) + " " + PASSAGE, "a"), (9, PASSAGE + " " + words(80, 9), "a"), (10, PASSAGE, "b"), (None, words(90, 10), "a"), (None, words(90, 10), "a"), (11, words(50, 11) + " 1di0t moron", "b"), (12, words(60, 12), "b"), (12, words(60, 13), "b"),
    (12, words(60, 12), "b"), (13, words(12_000, 14), "a"), (14, "x" * 30_000, "a"),
] + [(20 + k, words(60, 100 + k) + (" idiot moron" if k % 3 == 0 else ""), "ab"[k % 2]) for k in range(24)]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *(f"{k}" for k in range(len(CLASH)))) for i, t, lang in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(t is not None and "moron" in t)) for i, t, _ in ROWS if i is not None] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def kept(df):
    out = df.collect()
    assert all(r[c] == f"{k}" for r in out for k, c in enumerate(CLASH))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    return sorted(((r["doc_id"], r["text"]) for r in out), key=str)


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_language_stage(spark, folder):
    docs = frame(spark, ROWS)
    of = langid.learn(docs)
    guessed = {t: langid._guess(t, of) for _, t, _ in ROWS}
    expected = [(i, t) for i, t, _ in ROWS if guessed[t][0] != "und" and guessed[t][1] >= 0.05]
    assert kept(corpus_pipeline.language(spark, docs, folder)) == sorted(expected, key=str)
    assert not {4, 5, 6, 7} & {i for i, _ in expected} and (12, words(60, 13)) in expected


def test_toxicity_stage(spark, folder):
    docs = frame(spark, ROWS)
    scorer = toxicity.learn(docs, table(spark, folder, "labels"))
    expected = sorted(((i, t) for i, t, _ in ROWS if scorer.score(t) < 0.5), key=str)
    assert kept(corpus_pipeline.toxic(spark, docs, folder)) == expected
    assert not any(t and "moron" in t for _, t in expected) and (4, None) in expected


def test_near_duplicates_stage(spark, folder):
    distinct = list(dict.fromkeys((i, t) for i, t, _ in ROWS))
    sets, root = [plain_shingles(t) for _, t in distinct], list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(distinct)), 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            root[find(b)] = find(a)
    groups = {}
    for k, row in enumerate(distinct):
        groups.setdefault(find(k), []).append(row)
    out = kept(corpus_pipeline.near_duplicates(spark, frame(spark, ROWS), folder))
    assert len(out) == len(groups)
    for rows in groups.values():
        least = min((i for i, _ in rows if i is not None), default=None)
        assert sum(row in rows and row[0] == least for row in out) == 1


def test_repeated_passages_stage(spark, folder):
    seen = {}
    for i, t, _ in ROWS:
        w = (t or "").split()
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            seen[x] = min(seen.get(x, 1 << 63), (1 << 63) - 1 if i is None else i)
    expected = []
    for i, t, _ in ROWS:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < ((1 << 63) - 1 if i is None else i) for j in range(k, k + 13)}
        expected.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    assert kept(corpus_pipeline.repeated_passages(spark, frame(spark, ROWS), folder)) == sorted(expected, key=str)


def test_packing_stage(spark, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t, _ in ROWS:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        at = 0
        for size in packing.binary_lengths(n):
            expected.append((i, at, size, n))
            at += size
    out = corpus_pipeline.packed(spark, frame(spark, ROWS), folder).collect()
    assert sorted(((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in out), key=str) == sorted(expected, key=str)
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))


def test_empty_tables(spark, folder):
    docs = frame(spark, ROWS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
