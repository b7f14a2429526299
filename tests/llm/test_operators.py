"""Each operator against a plain version of it, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import inspect
import io
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from crawlmill.llm import langid, media, nbest, nearcopies, packing, quality, recompress, sharding, simhash, toxicity, urlmodel

#: Columns that operators use inside; those of the input must not get in their way.
CLASH = ["fp", "doc", "th", "key", "kept", "score", "label", "spans", "root", "shard", "part", "media"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(n, seed=0, of=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}" for _ in range(n))


PASSAGE = words(60, 99, 10_000)
TEXTS = [
    (1, words(300, 1)), (2, None), (3, ""), (4, words(300, 1)), (5, words(50, 5) + " " + PASSAGE), (6, PASSAGE + "\n" + words(40, 6)),
    (7, "a " * 500), (8, "a " * 40 + "b"), (9, "one two"), (10, " \n\t "), (11, words(30_000, 11, 30)), (None, words(300, 1)), (12, words(300, 1) + " end"),
    (12, words(40, 12)), (12, words(40, 12)), (13, "x" * 20_000), (14, "Ünïcode \u3000 wide\u00a0space " + words(30, 14)), (15, "ab " * 300), (16, "ab " * 301 + PASSAGE), (None, None),
]


def rows(texts=TEXTS):
    return [(i, t, "en" if k % 3 else None, "s", None if t is None else len(t), *["x"] * len(CLASH)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def split(text):
    return (text or "").encode().split()


# 1


def plain_repeats(w, window=8):
    seen = {}
    for i in range(len(w) - window + 1):
        seen.setdefault(tuple(w[i : i + window]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def test_quality_counts(docs):
    expected = []
    for i, t in TEXTS:
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        n = plain_repeats(w)
        expected.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)))
    assert got(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(expected, key=str)


def test_quality_distance():
    assert quality.js_distance(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1)
    assert quality.js_distance(np.array([2, 4]), np.array([1, 2])) == pytest.approx(0, abs=1e-6)
    assert quality.js_distance(np.zeros(2), np.array([1, 2])) == 1


def test_quality_against_plain(docs):
    """Every column of every row, from histograms kept as plain counts."""
    from collections import Counter

    limits = quality.Limits()
    kind = lambda c: quality._class_of(c.encode()[0])
    plain_words = lambda t: "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in t).encode().split()
    chars, common = {}, {}
    for k, (_, t) in enumerate(TEXTS):
        if t and k % 3:
            chars.setdefault("en", Counter()).update(map(kind, t))
            common.setdefault("en", Counter()).update(plain_words(t))
    ref = dict(sorted(common["en"].items(), key=lambda x: (-x[1], x[0]))[: limits.common_words])

    def distance(p, q):
        if not sum(p.values()) or not sum(q.values()):
            return 0.0 if sum(p.values()) == sum(q.values()) else 1.0
        p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (p, q))
        total = 0.0
        for x, y in ((p, q), (q, p)):
            total += sum(v * np.log2(2 * v / (v + y.get(k, 0))) for k, v in x.items() if v)
        return float(np.sqrt(max(0.0, total / 2)))

    expected = {}
    for i, t in TEXTS:
        w, n = split(t), len(split(t))
        failed = n < 20 or 100 * plain_repeats(w) > 30 * n
        near = distance(Counter(map(kind, t or "")), chars["en"]), distance({k: v for k, v in Counter(plain_words(t or "")).items() if k in ref}, ref)
        slack = max(1, n) ** -0.5
        odd = n >= limits.min_words and near[0] > limits.max_char_distance + limits.char_slack * slack or n >= limits.min_common_words and near[1] > limits.max_word_distance + limits.word_slack * slack
        expected.setdefault((i, t), (not (failed or odd), *near))
    out = quality.judge(docs).collect()
    assert len(out) == len(TEXTS)
    by_id = {}
    for (i, _), x in expected.items():
        by_id.setdefault(i, []).append(x)
    for r in out:
        assert any(r["kept"] == x[0] and (r["char_distance"], r["word_distance"]) == pytest.approx(x[1:], abs=1e-6) for x in by_id[r["doc_id"]]), r


def test_repeats_are_compared_word_by_word(monkeypatch):
    w = words(500, 3, 12).encode().split()
    expected = [plain_repeats(w, n) for n in (1, 2, 8, 90)]
    assert [quality.repeated_words(w, n) for n in (1, 2, 8, 90)] == expected
    monkeypatch.setattr(quality, "_BASE", 0)  # all windows look alike
    assert [quality.repeated_words(w, n) for n in (1, 2, 8, 90)] == expected


def test_quality_judges_by_divergence(spark):
    plain = [(i, words(200, i, 150)) for i in range(40)]
    odd = [(100, "#% $& *| " * 5 + words(150, 7, 150).upper())]
    verdict = dict(got(quality.judge(spark.createDataFrame([(i, t, "en") for i, t in plain + odd], "doc_id long, text string, lang string")), "doc_id", "kept"))
    assert not verdict.pop(100) and all(verdict.values())


# 2


@pytest.mark.parametrize("shape", [(5, 7), (3, 4, 3), (1, 1), (9, 64), (2, 5, 3)])
def test_media_round_trips(shape):
    a = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_ppm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()


def test_media_formats():
    assert media.decode(b"P1 # c\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n2 1\n15\n15 0\n").tolist() == [[255, 0]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5\n2 2\n255\nab", b"BM", b"GIF89a", b"P7"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_refuses_what_it_cannot_hold():
    huge = media.struct.pack("<2sIHHI", b"BM", 99, 0, 0, 54) + media.struct.pack("<IiiHHIIiiII", 40, 2**31 - 1, -(2**31), 1, 24, 0, 0, 0, 0, 0, 0)
    palette = media.struct.pack("<2sIHHI", b"BM", 99, 0, 0, 54) + media.struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 8, 0, 0, 0, 0, 2**31, 0) + b"\0" * 8
    for bad in (b"P5 99999999999 99999999999 255\n", b"P2 1 1 255 " + b"9" * 23, b"P2 1 1 255 -1", b"P2 1 1 15 16", b"P5 1 1 15 \xff", b"P1 2 1 1 7", b"P4 99999999 9 \n", b"P2 1 1 255 x", b"P5 " + b"1" * 5000, huge, palette):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_is_kept_and_read_back(docs, monkeypatch):
    """The stored table holds images that decode to the padded texts; tiles and hashes follow from area means in fractions."""
    from fractions import Fraction

    def mean(a, h, w):
        high, wide = a.shape
        out = np.zeros((h, w))
        for y, x in itertools.product(range(h), range(w)):
            total = Fraction(0)
            for i in range(high * y // h, -(-high * (y + 1) // h)):
                tall = min(Fraction(i + 1), Fraction(high * (y + 1), h)) - max(Fraction(i), Fraction(high * y, h))
                for j in range(wide * x // w, -(-wide * (x + 1) // w)):
                    total += tall * (min(Fraction(j + 1), Fraction(wide * (x + 1), w)) - max(Fraction(j), Fraction(wide * x, w))) * int(a[i, j])
            out[y, x] = float(total * h * w / (high * wide))
        return out

    stored = media.kept(docs)
    texts_of = {}
    for i, t in TEXTS:
        texts_of.setdefault(i, set()).add((t or "").encode())
    out = {r["media_sha256"]: r for r in media.featured(stored, tiles=True).collect()}
    some = stored.collect()
    assert len(some) == len(TEXTS)
    for r in some:
        a = media.decode(bytes(r["media"]))
        assert a.tobytes()[: r["n_bytes"]] in texts_of[r["doc_id"]]
        f = out[hashlib.sha256(bytes(r["media"])).hexdigest()]
        grey = a if a.ndim == 2 else np.array([[sum(int(v) * k for v, k in zip(p, (299, 587, 114))) // 1000 for p in row] for row in a], np.uint8)
        t = np.load(io.BytesIO(bytes(f["tile"])))
        assert t.shape == (32, 32) and hashlib.sha256(bytes(f["tile"])).hexdigest() == f["tile_sha256"]
        if len(grey) < 12:
            small = np.round(mean(grey, 8, 9), 6)
            assert f["feature"] == np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()
            assert np.abs(t - mean(grey, 32, 32)).max() <= 0.5 + 1e-6
    monkeypatch.setattr(media, "BLOCK", 100)
    a = np.random.default_rng(1).integers(0, 256, (77, 64), dtype=np.uint8)
    assert np.allclose(media.area_resize(a, 8, 9), mean(a, 8, 9))


def test_area_resize_is_a_mean():
    a = np.arange(12.0).reshape(3, 4)
    assert np.allclose(media.area_resize(a, 1, 1), a.mean()) and np.allclose(media.area_resize(a, 3, 4), a)
    up = np.kron(a, np.ones((5, 7)))
    assert np.allclose(media.area_resize(up, 3, 4), a)
    assert np.load(io.BytesIO(media.tile(a.astype(np.uint8), 4))).shape == (4, 4)


def test_media_columns(docs):
    expected = []
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        expected.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    out = media.featured(media.store(docs))
    assert got(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(expected, key=str)
    assert not out.where("error is not null or length(feature) <> 16").count()


# 3


def every_segmentation(of, part):
    if not part:
        return [(0.0, ())]
    out = []
    for n in range(1, len(part) + 1):
        if part[:n] in of.scores:
            out += [(s + of.scores[part[:n]], (of.ids[part[:n]], *r)) for s, r in every_segmentation(of, part[n:])]
        if n == 1 and part[0] not in of.scores:
            out += [(s + of.least, (*(of.bytes[b] for b in part[0].encode()), *r)) for s, r in every_segmentation(of, part[1:])]
    return out


@pytest.mark.parametrize("text", ["hello", "the cat sat", "a  b", "", "x\ny", "日本 zé", "nation of", "   "])
def test_nbest_is_exhaustive(text):
    of = nbest.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    whole = nbest.SPACE + text.replace(" ", nbest.SPACE) if text else ""
    every = sorted(every_segmentation(of, whole), key=lambda x: -x[0])
    best = of.best(text, 6)
    assert [s for s, _ in best] == pytest.approx([s for s, _ in every[:6]])
    known = {ids: s for s, ids in every}
    assert len({b for _, b in best}) == len(best) and all(known[tuple(np.frombuffer(b, "<u4").tolist())] == pytest.approx(s) for s, b in best)
    assert all(of.decode(np.frombuffer(b, "<u4")) == text for _, b in best)


def test_words_looked_at_together():
    of, r = nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model")), random.Random(5)
    some = sorted({"".join(r.choice("aeinrstÉé漢9,.$") for _ in range(r.randrange(1, 45))) for _ in range(4000)})
    of.prepare([" ".join(some)])
    assert len(of.spaced) > 300
    assert all(of.spaced[w] == of._of(nbest.SPACE + w) for w in of.spaced)


def test_nbest_query(docs):
    out = nbest.segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), 3)
    assert not out.where("not decodes").count()
    assert got(out.where("rank = 1"), "doc_id") == sorted([(i,) for i, _ in TEXTS], key=str)


# 4


def test_binary_lengths():
    for n in (1, 2, 4095, 4096, 4097, 12_345):
        parts = packing.binary_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 for p in parts)
        assert len(set(p for p in parts if p < 4096)) == len([p for p in parts if p < 4096])


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    expected = []
    for i, t in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.binary_lengths(len(ids)):
            expected.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    out = packing.pack(docs, path).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in out), key=str) == sorted(expected, key=str)
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out))) and not any(r["offset"] for r in out)
    by_length = [r["length"] for r in sorted(out, key=lambda r: r["sequence_id"])]
    assert by_length == sorted(by_length, reverse=True)


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    tok, signs = Tokenizer.from_file(path), "ab'sSt.!$%<>|é É1٣ \u0301\u0307Iİßäﬁ漢カ゛\u200b-_\n\t日本'llredve’K"
    some = ["".join(r.choice(signs) for _ in range(r.randrange(1, 40))) for _ in range(3000)] + [words(3000, 8), "x" * 5000, "-" * 5000]
    encode = packing.encoder(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in some])] == [tok.encode(t, add_special_tokens=False).ids for t in some]
    assert encode([]) == [] and encode([b"", b" "]) == [b"", b""]


def test_a_full_memory_starts_anew(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    some = [words(200, k, 10_000).encode() for k in range(9)]
    first = packing.encoder(path)(some)
    monkeypatch.setattr(packing, "MEMORY", 10_000)
    monkeypatch.setattr(packing, "_held", {})
    monkeypatch.setattr(packing.Words.__init__, "__defaults__", (10_000,))
    assert [packing.encoder(path)([t])[0] for t in some] == first


def test_pieces_keep_their_places(spark, docs):
    """However the written pieces are split when they are read."""
    path, seen = public_tokenizers.path("word_bpe_49k.json"), []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        out = packing.pack(docs, path, capacity=64).collect()
        assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
        seen.append(sorted((r["length"], r["ids_crc32"]) for r in out))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]


def test_packing_keeps_added_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    some = ["a <|endoftext|> b", "A<|endoftext|>.B", "<|startoftext|>", "a <|ENDOFTEXT|> b", "plain words, again", "<|endoftext|>!", "x<|EndOfText|><|endoftext|>y", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(path)([t.encode() for t in some])] == [tok.encode(t, add_special_tokens=False).ids for t in some]


# 5


def plain_removed(texts, window=13):
    first, out = {}, []
    order = lambda i: float("inf") if i is None else i
    for i, t in texts:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), order(i))
    for i, t in texts:
        w = split(t)
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < order(i) for j in range(k, k + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_recompression(docs):
    assert got(recompress.removed(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removed(TEXTS)


def test_recompression_random(spark):
    r = random.Random(3)
    base = [words(60, s, 6) for s in range(6)]
    texts = []
    for i in range(80):
        parts = [r.choice(base).split() for _ in range(r.randrange(1, 4))]
        w = [x for p in parts for x in p[r.randrange(10) : 60 - r.randrange(20)]]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "edit"
        texts.append((r.randrange(60), " ".join(w)))
    out = recompress.removed(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removed(texts)


def test_anchors_follow_windows():
    r = np.random.default_rng(5)
    with np.errstate(over="ignore"):
        for size in (2, 3, 50):
            names = np.concatenate([np.append(recompress.mix(r.integers(1, size + 1, n).astype(np.uint64), 1), np.uint64(0)) for n in (400, 300, 13, 12)])
            names = np.append(np.zeros(1, np.uint64), names)
            head, n, key, _ = recompress.anchors(names)
            at = np.concatenate([np.arange(h, h + k) for h, k in zip(head, n)])
            each = np.repeat(key, n)
            assert len(at) == sum(not (names[i : i + 13] == 0).any() for i in range(len(names) - 12))
            seen = {}
            for i, k in zip(at, each):
                assert seen.setdefault(names[i : i + 13].tobytes(), k) == k


def test_words_are_named_by_their_bytes():
    import pyarrow as pa

    r = random.Random(1)
    some = [bytes(r.choice(b"abcxyz01") for _ in range(r.randrange(1, 30))) for _ in range(20_000)] + [b"a" * k for k in range(1, 700)] + ["é漢".encode() * k for k in range(1, 40)]
    held = [b" ".join(some[i : i + 97]) + r.choice([b"", b"\n", b"  "]) for i in range(0, len(some), 97)] + [b"", None, b"   ", b"q"]
    with np.errstate(over="ignore"):
        names, at = recompress.batch_names(pa.array(held, pa.binary()).slice(3))
    flat = [w for t in held[3:] for w in (t or b"").split()]
    known = {}
    assert len(flat) == len(names) and all(known.setdefault(w, n) == n for w, n in zip(flat, names.tolist()))
    assert len(set(known.values())) == len(known) and 0 not in known.values()
    assert np.diff(at).tolist() == [len((t or b"").split()) for t in held[3:]]


def test_cut_texts_keeps_any_columns(spark, docs):
    names = ["__doc", "__th", "__spans", "row", "spans", "doc", "th"]
    more = docs.selectExpr("doc_id", "text", "n_chars", *(f"concat(source, '{k}') as {n}" for k, n in enumerate(names)))
    out = recompress.cut_texts(more)
    assert out.columns == more.columns and out.count() == len(TEXTS)
    assert all(r[n] == f"s{k}" for r in out.collect() for k, n in enumerate(names))
    assert got(out, "doc_id", "text", "n_chars") == got(recompress.cut_texts(docs), "doc_id", "text", "n_chars")


def test_cut_texts(docs):
    out = recompress.cut_texts(docs)
    assert out.schema == docs.schema and out.count() == len(TEXTS)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[6] == words(40, 6)
    assert not out.where("n_chars <> length(text)").count()


# 6


def test_url_rules(spark):
    urls = ["http://example.org/es/1", "https://A.EXAMPLE.ORG/en/12", "http://x.org/", "http://x.org", "http://a.com/fr/1?q#f", "http://com/de/", None, "no scheme", "http://a.net/x://org/", "http://notexample.org/es/", "http://org:80/", "http://a.com/FR/1", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: r for r in urlmodel.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in urlmodel.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert rule is None or out[i]["verdict"] == urlmodel.RULES[rule]
        assert out[i]["verdict"] in ("allow", "block")


def test_url_model_separates():
    good, bad = [f"http://site.example/news/{i}" for i in range(50)], [f"http://pills.example/buy?id={i}" for i in range(50)]
    ratio = urlmodel.Ratio(urlmodel.Markov.of(good[:40]), urlmodel.Markov.of(bad[:40]), 0.0)
    assert min(map(ratio.score, good[40:])) > max(map(ratio.score, bad[40:]))
    m = urlmodel.Markov.of(["ab", "aa"])
    seen = {c for x in m.after.values() for c in x}
    assert len(seen) == 3 and sum(np.exp(m.log_likelihood(c) - 0) for c in ("ab", "aa")) < 1
    assert urlmodel.best_limit([1, 2, 3, 4], [False, False, True, True]) == pytest.approx(2.5)


def test_url_verdicts_against_plain(spark):
    """Both models, the limit and every verdict, from all URLs that rules decide, in one process."""
    import xxhash

    r = random.Random(6)
    urls = []
    for k in range(300):
        good = k % 2
        rest = "/".join(r.choice(["news", "story", "help"] if good else ["pills", "bet", "win"]) + str(r.randrange(40)) for _ in range(2))
        urls.append(f"https://a{r.randrange(9)}." + r.choice(["org/" if good else "com/de/", "net/"]) + rest)
    urls += [None, "", "no scheme", "http://x.net/" + "y" * 20_000, urls[0], urls[1], "http://é.net/ü"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, ruled string").repartition(3)
    out = {x["page_id"]: x for x in urlmodel.judge(df).collect()}
    decided = {v: sorted({urls[k] for k, x in out.items() if x["rule"] and x["verdict"] == v}) for v in ("allow", "block")}
    h = lambda u: xxhash.xxh64_intdigest(u.encode(), 42)
    held = lambda u: (h(u) - (h(u) >> 63 << 64)) % 4 == 0
    model = {}
    for v, some in decided.items():
        after = model[v] = {}
        for u in (u for u in some if not held(u)):
            p = "\x02" * 5 + u + "\x03"
            for i in range(5, len(p)):
                for k in range(6):
                    c = after.setdefault(p[i - k : i], {})
                    c[p[i]] = c.get(p[i], 0) + 1

    def likelihood(after, u):
        p, total = "\x02" * 5 + u + "\x03", 0.0
        for i in range(5, len(p)):
            x = 1 / 256
            for k in range(6):
                if p[i - k : i] not in after:
                    break
                c = after[p[i - k : i]]
                x = (c.get(p[i], 0) + len(c) * x) / (sum(c.values()) + len(c))
            total += np.log(x)
        return total

    score = lambda u: (likelihood(model["allow"], u) - likelihood(model["block"], u)) / (len(u) + 1)
    limit = urlmodel.best_limit(*map(list, zip(*[(score(u), v == "allow") for v in decided for u in decided[v] if held(u)])))
    for k, u in enumerate(urls):
        if out[k]["rule"] is None:
            assert out[k]["ratio"] == pytest.approx(score(u or ""), abs=1e-9)
            assert out[k]["verdict"] == ("allow" if score(u or "") > limit else "block")
    right = [out[k]["verdict"] == ("allow" if k % 2 else "block") for k in range(300) if out[k]["rule"] is None]
    assert sum(right) > 0.95 * len(right)


def test_a_full_url_model_takes_the_most_frequent(spark):
    df = spark.createDataFrame([("ab",), ("ab2",), ("ab3",)], "url string")
    assert urlmodel.counts(df, 3) == {"a": 3, "b": 3, "\x03": 3}
    assert sum(urlmodel.counts(df).values()) == 6 * (3 + 4 + 4)


def test_url_limit_from_all_held_out(spark):
    """The limit over ranges is that of one process, whatever ties and ends there are; learning takes no bound on rows or n-grams."""
    r = random.Random(16)
    for some in ([(r.randrange(400) / 64 + good / 2, good) for good in (True, False) for _ in range(700)], [(1.0, True), (1.0, False)], [(1.0, True), (0.0, False)], [(0.0, True), (1.0, False)], [(2.0, True)] * 3, [(2.0, False)]):
        for n in (1, 5):
            held = spark.createDataFrame(some, "ratio double, good boolean").repartition(n)
            assert urlmodel.fitted_limit(held) == pytest.approx(urlmodel.best_limit(*map(list, zip(*some)))), some[:4]
    assert {"most", "grams"}.isdisjoint(inspect.signature(urlmodel.learn).parameters)


# 7


def test_language_vectors_are_bundles():
    of = langid.Prototypes(["x"], np.ones((1, 256), np.float32) / 16)
    text = "Héllo, wörld 42!"
    s = langid.symbols(text)
    letters, v = langid.letter_vectors(256), np.zeros(256)
    for i in range(len(s) - 2):
        v += np.roll(letters[s[i]], 2) * np.roll(letters[s[i + 1]], 1) * letters[s[i + 2]]
    assert float(langid.similarity(text, of)[0]) == pytest.approx(float(v.sum() / 16 / np.linalg.norm(v)), abs=1e-5)


def test_languages_against_plain(spark, docs):
    """Every prediction and score, bundling the vectors of all n-grams one after another."""
    letters = langid.letter_vectors().astype(float)

    def bundle(t):
        s, v = langid.symbols(t), np.zeros(langid.DIMENSIONS)
        for g, n in {tuple(g): None for g in zip(s, s[1:], s[2:])}.items():
            n = sum(1 for x in zip(s, s[1:], s[2:]) if x == g) if len(s) < 400 else None
            v += 0 if n is None else n * np.roll(letters[g[0]], 2) * np.roll(letters[g[1]], 1) * letters[g[2]]
        return v, max(0, len(s) - 2)

    some = [(i, t, "ab"[k % 2] if k % 5 else None) for k, (i, t) in enumerate(TEXTS) if not t or len(t) < 390] + [(50 + k, words(30, k) + " éü", "ab"[k % 2]) for k in range(6)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(2)
    sums = {}
    for _, t, lang in some:
        if t and lang and bundle(t)[1]:
            v, n = bundle(t)
            sums[lang] = sums.get(lang, 0) + v * round(1e9 / n)
    expected = []
    for i, t, _ in some:
        v, n = bundle(t or "")
        cosines = {lang: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for lang, p in sorted(sums.items())} if n else {}
        best = max(cosines, key=cosines.get, default="und")
        expected.append((i, best, round(max(0.0, cosines.get(best, 0.0)), 3)))
    out = [(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in langid.predict(df, langid.learn(df)).collect()]
    close = lambda a, b: a[:2] == b[:2] and abs(a[2] - b[2]) < 0.0021
    assert len(out) == len(some) and all(close(a, b) for a, b in zip(sorted(out, key=str), sorted(expected, key=str)))


def test_languages(spark, docs, empty):
    syllables = {"a": ["ba", "lo", "mi"], "b": ["kr", "zu", "th"], "c": ["éa", "ñu", "ße"]}
    r = random.Random(1)
    table = [(k, " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(30)), lang) for k, lang in enumerate("abc" * 40)]
    df = spark.createDataFrame(table + [(500, None, "a"), (501, "12 34 !", "b"), (502, "", None)], "doc_id long, text string, lang string")
    part = langid.remainder(df["doc_id"], 4)
    out = {x["doc_id"]: x for x in langid.predict(df, langid.learn(df.where(part != 2)), part == 2).collect()}
    assert all(out[k]["lang_pred"] == lang for k, _, lang in table) and all((out[k]["lang_pred"], out[k]["score"]) == ("und", 0.0) for k in (500, 501, 502))
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out) and all(0 <= x["score"] <= 1 for x in out.values())
    assert langid.predict(empty, langid.learn(empty)).count() == 0
    assert langid.predict(docs, langid.learn(docs)).count() == len(TEXTS)


# 8


def plain_model():
    c = {}
    text = "you idiot are a moron and the loser of the night that is not so good as it was before " * 50
    codes, n = langid.grams(text)
    x = np.zeros(langid.GRAMS)
    x[codes] = n
    x = x.reshape((langid.SYMBOLS,) * 3)
    return np.log((x + 0.01) / (x + 0.01).sum(axis=2, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("noisy, plain", [("1d10t", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("idiot!!", "idiot"), ("good", "good"), ("###night$$$", "night")])
def test_restores_words(noisy, plain):
    assert toxicity.Restorer(plain_model()).word(noisy) == plain


def test_restores_spacing():
    assert list(toxicity.Restorer(plain_model()).words("You  i d i o t are")) == ["you", "idiot", "are"]


def test_restores_long_runs():
    restorer = toxicity.Restorer(plain_model())
    for before in range(58, 66):  # letters before the insult
        letters = ("thenight" * 9)[-before:] + "idiot" + "thenight" * 2
        assert "idiot" in list(restorer.words(" ".join(letters))), before
    assert list(restorer.words(" ".join("thenight" * 5000))).count("night") > 4990


def test_decode_is_the_best_path():
    model = plain_model()

    def cost(noisy):  # every choice for every character, added up on its own
        best = {}
        for choice in itertools.product(*([((0, " ", toxicity.BREAK_COST) if not c.isalpha() else (int(langid.symbols(c)[1]), c, 0.0))] + [(int(langid.symbols(x)[1]), x, toxicity.LOOK_COST) for x in toxicity.LOOKS.get(c, "")] + [(-1, "", toxicity.REPEAT_COST)] * (i > 0 and noisy[i - 1] == c) for i, c in enumerate(noisy))):
            s, said, total = [0, 0], "", 0.0
            for symbol, letter, extra in choice:
                total += extra
                if symbol > 0 or symbol == 0 and s[-1]:
                    s.append(symbol)
                    said += letter
            s.append(0)
            total -= sum(float(model[s[k], s[k + 1], s[k + 2]]) for k in range(len(s) - 2))
            best[said.strip()] = min(total, best.get(said.strip(), 1e9))
        return min(best, key=best.get)

    for noisy in ("1diiot", "m00n", "l0s3r", "1111", "4$$", "n1gh7", "b00"):
        assert toxicity.decode(noisy, model) == cost(noisy)


def test_cores_of_words():
    import re

    edge = re.compile(r"^[^\w@$!|+€£]+|[^\w@$|+€£]+$|^([^\w])\1{2,}|([^\w])\2{2,}$")
    r = random.Random(7)
    for _ in range(20_000):
        w = "".join(r.choice("ab1_$!!..*-@é") for _ in range(r.randrange(0, 9)))
        assert toxicity.core_of(w) == edge.sub("", w), w


def test_very_long_words_take_linear_time():
    import time

    restorer, began = toxicity.Restorer(plain_model()), time.process_time()
    for w in ("a" + "-" * 400_000 + "b", "-" * 400_000, "ab-" * 130_000, "!" * 400_000 + "a", "a" * 20_000, "x" * 20_000 + "!" * 400_000):
        restorer.word(w)
    assert time.process_time() - began < 30


def test_toxicity(spark, docs, empty):
    r = random.Random(2)
    table, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        w = [f"{x}n" for x in r.choices(["gar", "tol", "min", "pes", "lat"], k=40)]
        if bad:
            for word in ("idiot", "moron") if k % 8 else ("1d1ot", "m o r o n"):
                w.insert(r.randrange(40), word)
        table.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    df, lab = spark.createDataFrame(table + [(900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    part = langid.remainder(lab["doc_id"], 5)
    out = {x["doc_id"]: x for x in toxicity.scored(df, toxicity.learn(df, lab, part != 0)).collect()}
    assert sum(out[k]["predicted"] != y for k, _, y in labels) <= 8
    assert out[900]["predicted"] == out[901]["predicted"] == 0
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.clean(docs, none).count() == len(TEXTS) and toxicity.scored(empty, none).count() == 0


def test_toxicity_against_plain(spark):
    """Lexicon, weights and every score, counted anew in one process over texts as the operator restores them."""
    from collections import Counter

    r = random.Random(3)
    table = [(k, " ".join(r.choices(["garn", "toln", "minn", "pesn", "latn"], k=20) + (["1di0t", "m.o.r.o.n"] if k % 3 == 0 else []))) for k in range(60)] + [(70, None), (71, ""), (72, "g 0 0 d  i d i o t"), (72, "idiot!! minn")]
    labels = [(k, int(k % 3 == 0)) for k in range(60)] + [(0, 0), (72, 1), (None, 1), (3, None)]
    df, lab = spark.createDataFrame(table, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.learn(df, lab)
    truth = {k: max(y for i, y in labels if i == k and y is not None) for k in {i for i, y in labels if i is not None and y is not None}}
    restorer = toxicity.Restorer(scorer.model)
    said = [(k, t, list(restorer.words(t or ""))) for k, t in table]
    seen = {0: Counter(), 1: Counter()}
    for k, _, w in said:
        if k in truth:
            seen[truth[k]].update({t for x in w for t in ["=" + x] + [x[:n] for n in (4, 5, 6, 7) if len(x) >= n]})
    size = {y: sum(truth.get(k) == y for k, _ in table) for y in (0, 1)}
    odds = {t: np.log((n + 0.5) / (size[1] + 1)) - np.log((seen[0][t] + 0.5) / (size[0] + 1)) for t, n in seen[1].items() if n >= 3}
    odds = {t: v for t, v in odds.items() if v >= np.log(6)}
    assert scorer.lexicon == pytest.approx(odds) and odds

    def features(text, w):
        value = [max([odds.get(t, 0.0) for t in ["=" + x] + [x[:n] for n in (4, 5, 6, 7) if len(x) >= n]]) for x in w]
        if not (text or "").split():
            return [0.0, 0.0, 0.0]
        of = {}
        if not toxicity._RUN.search(text):  # strengths by written word
            value = [sum(max([odds.get(t, 0.0) for t in ["=" + x] + [x[:n] for n in (4, 5, 6, 7) if len(x) >= n]]) for x in of.setdefault(y, restorer.word(y).split())) for y in text.lower().split()]
        return [max(value, default=0.0), np.log1p(sum(value)), np.log1p(100 * sum(value) / len(text.split()))]

    x = {(k, t): features(t, w) for k, t, w in said}
    weights = toxicity.fit_logistic(np.array([x[k, t] for k, t in table if k in truth]), np.array([float(truth[k]) for k, _ in table if k in truth]))
    assert scorer.weights == pytest.approx(weights, rel=1e-4, abs=1e-4)
    expected = sorted((k, round(float(1 / (1 + np.exp(-(weights @ [1.0, *x[k, t]])))), 4)) for k, t in table)
    out = sorted((y["doc_id"], round(y["score"], 4)) for y in toxicity.scored(df, scorer).collect())
    assert [k for k, _ in out] == [k for k, _ in expected] and [v for _, v in out] == pytest.approx([v for _, v in expected], abs=2e-3)


# 9


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    roots = {f: f for f in prints}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in itertools.combinations(list(prints), 2):
        if (a ^ b).bit_count() <= 3:
            roots[find(a)] = find(b)
    return {f: find(f) for f in prints}


def test_simhash(docs):
    prints = [plain_fingerprint(t) for _, t in TEXTS]
    root = plain_components(set(prints))
    least = {}
    for (i, _), f in zip(TEXTS, prints):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    expected = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(TEXTS, prints)), key=str)
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected


def test_links_are_complete(spark):
    r = random.Random(4)
    prints = set()
    for _ in range(40):
        f = r.getrandbits(64)
        prints.add(f)
        for d in range(1, 6):
            g = f
            for b in r.sample(range(64), d):
                g ^= 1 << b
            prints.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = sorted(tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    assert sorted(tuple(x) for x in simhash.links(df).collect()) == expected


def test_long_chains_settle(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101)]
    out = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 1 for i in range(1, 61)) and out[103] == 100


def test_one_of_each(docs):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 4 not in ids and None not in ids


def plain_groups(texts):
    """The smallest index of a text's group, by all pairs."""
    sets = []
    for t in texts:
        w = split((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    roots = list(range(len(sets)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = sorted((find(i), find(j)))
            roots[b] = a
    return [find(i) for i in range(len(sets))]


def test_near_copies_are_complete(spark):
    r = random.Random(9)
    made = [(line := words(30, 77, 1000)), line + " end"]
    for k in range(40):
        base = words(r.randrange(4, 300), k, 5000).split()
        made.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(1, 2 + len(base) // 25)):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            made.append(" ".join(copy + line.split() * r.randrange(2)))
    root = plain_groups(made)
    assert 60 < len(set(root)) < len(made) - 60
    assert any((plain_fingerprint(made[i]) ^ plain_fingerprint(made[j])).bit_count() > 3 for i, j in enumerate(root))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in simhash.one_of_each(df).collect()) == sorted(set(root))


def test_one_of_each_goes_by_simhash_balls(spark, monkeypatch):
    """What is within 3 bits and similar is linked by the balls alone, and the stage asks them."""
    base = [words(400, k, 10_000) for k in range(6)]
    some = base + [t + " end" for t in base] + [t[: len(t) // 2] for t in base] + ["one two", "one three", ""]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    whole = nearcopies.prefixed(df).cache()
    of = {r["doc_id"]: r["node"] for r in whole.collect()}
    sets = [nearcopies.shingles(t.encode()) for t in some]
    near = {(a, b) for a, b in itertools.combinations(range(len(some)), 2) if bin((simhash.bits(sets[a]) ^ simhash.bits(sets[b])) & (1 << 64) - 1).count("1") <= 3 and 9 * len(set(sets[a]) & set(sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert len(near) >= 4
    found = nearcopies.by_simhash(df, whole.select("node", "text_hash", "size", "fp", "prefix").distinct())
    assert {frozenset(r) for r in found.collect()} == {frozenset((of[a], of[b])) for a, b in near}
    asked = []
    monkeypatch.setattr(nearcopies, "by_simhash", lambda *x, f=nearcopies.by_simhash: asked.append(f(*x)) or asked[-1])
    assert simhash.one_of_each(df).count() == 15 and len(asked) == 1


def test_one_of_each_tells_rows(spark, docs):
    assert words(40, 12) in {r["text"] for r in simhash.one_of_each(docs).collect()}
    other, more = words(50, 200, 5000), words(50, 201, 5000)
    a, b, lone, third = (words(60, 300 + k, 5000) for k in range(4))
    # 1 twice, near 0 once; 2's second text the smallest of its own group; null ids near 0, alike, alone
    texts = [(0, a), (1, a + " end"), (1, b), (3, b + " end"), (2, a), (2, other), (5, other + " end"), (None, a), (None, lone), (None, lone + " end"), (None, third), (None, more), (7, more + " end"), (None, third)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    out = got(simhash.one_of_each(df), "doc_id", "text")
    assert len([t for _, t in out if t in (lone, lone + " end")]) == 1
    assert [x for x in out if x[1] not in (lone, lone + " end")] == sorted([(0, a), (1, b), (2, other), (None, third), (7, more + " end")], key=str)


# 10


@pytest.mark.parametrize("block", [3, sharding.BLOCK])
def test_sharding(docs, block, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", block)
    out = sharding.shards(docs).collect()
    md5 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16)
    best = lambda k, n: max(range(n), key=lambda s: (-1 / np.log((md5(f"{k}/{s}") + 0.5) / 2**52), -s))
    for r in out:
        k = "" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (best(k, 8), best(k, 9)) and r["grown_shard"] in (r["shard"], 8)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS), key=str)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_slots_depend_on_rows_alone(docs, monkeypatch):
    many = docs.unionByName(docs.where("doc_id = 12")).unionByName(docs.where("doc_id = 12 or doc_id is null"))
    plain = lambda df, **how: sorted(map(str, sharding.shards(df, **how).collect()))
    first = plain(many)
    assert plain(many.repartition(7, "lang")) == plain(many.coalesce(1)) == plain(many, parts=3) == first
    monkeypatch.setattr(sharding, "BLOCK", 2)
    assert plain(many) == first


@pytest.mark.parametrize("how", [{}, {"parts": 5}])
def test_slots_follow_the_hash_of_the_key(spark, how):
    """As the SQL does; a key of many texts is cut as well."""
    df = spark.createDataFrame([(k, "x" * (k % 3)) for k in range(300)] + [(7, f"t{k}") for k in range(200)] + [(None, "a")], "doc_id long, text string")
    out = sharding.shards(df, **how).collect()
    assert len(out) == 501
    for s in range(8):
        own = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        keys = [hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:13] for r in own]
        assert keys == sorted(keys) and [r["slot"] for r in own] == list(range(len(own)))


def test_weights(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    n = {r["shard"]: r["count"] for r in sharding.shards(df, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.7 < n[1] / 4000 < 0.8


# all


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    for out in (quality.judge(empty), media.featured(media.store(empty)), nbest.segmentations(empty, public_tokenizers.path("piece_bpe_32k.model")), packing.pack(empty, path), recompress.removed(empty), recompress.cut_texts(empty), simhash.near_duplicates(empty), simhash.one_of_each(empty), sharding.shards(empty), urlmodel.judge(spark.createDataFrame([], "page_id long, url string"))):
        assert out.count() == 0
