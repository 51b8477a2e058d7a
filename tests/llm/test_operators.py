"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and copies."""

import collections
import hashlib
import inspect
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("weftgraph.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from weftgraph.llm import blocks, bpe, count_tree, jaccard_join, langid, lm_scoring, neighbours, packing, pieces, quality, substring_dedup, token_counts, toxicity  # noqa: E402
from weftgraph.llm import queries as corpus  # noqa: E402

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
# columns with the names that operators give or use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, tid string, score double, n_tokens string, kept string"
ODD = [None, "", " ", "  a", "a  b", "a \n b", " \n\n x", "aaaa aaaaaa", "'s it's''s !'s", "<|endoftext|>a<|endoftext|><|endoftext|> b", "日本語 テスト 123", "x" * 700 + " " + "ab" * 900, "\x1c a\x1cb \x85 c", "é" * 600, "word　word  x", "a   ", "𝔘𝔫𝔦 ½ ² ٣ ՘a ", "Ab\tcd\x0bE"]


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(40), [make(rng.randint(60, 160)) for _ in range(40)]
    out = [*ODD, *base]
    for k in range(30):  # near copies of differing strength
        w = base[k % 6].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "new%d" % rng.randrange(1000)
        out.append(" ".join(w))
    out += [make(20) + " " + passage + "\n" + make(15) for _ in range(8)]
    out += [base[3]] * 5 + ["two words"] * 2 + [make(9000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3) if i % 5 else None, 1, 2, "x", 0.5, "y", "z") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts(docs, texts, empty):
    lib = Tokenizer.from_file(BYTE_BPE)
    want = [len(x.ids) for x in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    out = token_counts.count_tokens(docs, BYTE_BPE)
    got = by_id(out)
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (want[i] > 512) for i, t in enumerate(texts))
    assert out.count() == docs.count() and token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def test_merging_agrees_on_long_and_short_words():
    b, rng = bpe.ByteBPE(BYTE_BPE), random.Random(1)
    for n in (1, 2, 3, 7, 300, 700):
        piece = "".join(rng.choice("aabc") for _ in range(n)).encode()
        short, _ = b.merge([piece])
        assert b._merge_long(piece).tolist() == (short.tolist() if n <= bpe.LONG else short.tolist())
        assert Tokenizer.from_file(BYTE_BPE).encode(piece.decode(), add_special_tokens=False).ids == short.tolist()


def test_packing(docs, texts, empty):
    lib = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(docs, BYTE_BPE).collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0 and 1 << r["bucket"] == r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for piece in (1, 3)[i == 20 :] if i == 20 else (1,):
            own = sorted(found[i], key=lambda r: r["start"])
        own = own[:: 3 if i == 20 else 1]
        assert [x for r in own for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in own)
    assert packing.pack(empty, BYTE_BPE).count() == 0 and packing.pieces(2055, 1024) == [1024, 1024, 4, 2, 1]


def test_pieces(docs, texts, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    encoded = pieces.encode(docs, PIECE_BPE)
    got = by_id(encoded)
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == lib.encode(t or "") and got[i]["round_trip"], (i, t)
    back = by_id(pieces.decode(encoded, PIECE_BPE))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts))
    assert pieces.encode(empty, PIECE_BPE).count() == 0


def test_streaming_keeps_a_bounded_window():
    sp = pieces.Pieces(PIECE_BPE)
    text = "▁" + "theandofxq" * 3000
    taken, lag = 0, 0

    def chars():
        nonlocal taken
        for c in text:
            taken += 1
            yield c

    done, out = 0, []
    for p in sp.stream(chars()):
        out.append(p)
        done += len(p)
        lag = max(lag, taken - done)
    assert "".join(out) == text and lag < 12 * sp.longest
    assert out == sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).encode(text[1:], out_type=str)


def test_unigram_search_is_the_best(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as m

    spec = m.ModelProto()
    spec.ParseFromString(open(PIECE_BPE, "rb").read())
    spec.trainer_spec.model_type = 1
    sp = pieces.Pieces(proto=spec.SerializeToString())

    def brute(s):
        best = [0.0] + [-math.inf] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - sp.longest), e):
                score = sp.score.get(s[b:e], sp.worst if e - b == 1 else -math.inf)
                best[e] = max(best[e], best[b] + score)
        return best[-1]

    for s in ("▁hello", "▁tatitheandof", "▁x" + "ab" * 60):
        assert sum(sp.score.get(p, sp.worst) for p in sp.stream(s)) == pytest.approx(brute(s))


def test_lm_scoring(docs, texts, empty):
    train = F.col("doc_id") % 4 != 1
    got = by_id(lm_scoring.score(docs, train))
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\0end"]
    c = collections.Counter()
    for i in [*range(len(texts)), 20, 20]:
        if i % 4 != 1:
            c.update(tokens(texts[i]))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        r, own = got[i], tokens(t)
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["held_out"] == (i % 4 == 1)
        assert r["n_known"] == sum(c[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), abs=1e-9)
        assert r["score"] <= 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.score(empty, train).count() == 0
    assert {r["score"] for r in lm_scoring.score(docs.limit(5), F.lit(False)).collect()} == {0.0}


def test_lm_scores_depend_on_no_size_bound(docs, texts):
    train = F.col("doc_id") % 4 != 1
    bounds = {k: 64 for k in inspect.signature(lm_scoring.score).parameters if k.startswith("max_")}
    got = by_id(lm_scoring.score(docs, train, bits_per_entry=40.0, **bounds))
    counts, tokens = collections.Counter(), lambda t: ["start", *(t or "").encode().lower().split(), "end"]
    for i in [*range(len(texts)), 20, 20]:
        if i % 4 != 1:
            w = tokens(texts[i])
            counts.update(w)
            counts.update(zip(w, w[1:]))
    total = got[0]["train_tokens"] + sum(isinstance(k, (bytes, str)) and k != "start" for k in counts) + 1

    def count(gram):  # as the filter quantises it
        level = 1 + math.floor(math.log(counts[gram]) / math.log(1.5) + 1e-9) if counts[gram] else 0
        return (1.5 ** (level - 1) + 1.5**level - 1) / 2 if level else 0.0

    close = 0
    for i, t in enumerate(texts):
        w = tokens(t)
        want = sum(math.log10(min(1.0, (min(count((a, b)), count(a)) + 60 * (count(b) + 1) / total) / (count(a) + 60))) for a, b in zip(w, w[1:]))
        close += abs(got[i]["score"] - want) < 1e-6
    assert close >= 0.95 * len(texts) and {r["coverage"] for r in got.values()} == {1.0}


def test_log_frequency_filter():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 62, 20_000, dtype=np.uint64))
    counts = rng.integers(1, 500, len(h))
    bits, n, kept = lm_scoring.segment(h, counts, 1.5, 4, 10.0, 1 << 24)
    f = lm_scoring.LogFrequencyFilter(np.frombuffer(bits, np.uint8), np.zeros(1 << 3, np.int64), np.full(1 << 3, n), 3, 1.5, 4)
    want = 1 + np.floor(np.log(counts) / np.log(1.5) + 1e-9)
    got = f.levels(h)
    assert kept == len(h) and (got >= want).all() and (got == want).mean() > 0.9
    absent = rng.integers(1 << 62, 1 << 63, 20_000, dtype=np.uint64)
    assert (f.levels(absent) > 0).mean() < 0.05
    # a bound too small for all keeps the most frequent
    bits, n, kept = lm_scoring.segment(h, counts, 1.5, 4, 10.0, 1 << 19)
    part = lm_scoring.LogFrequencyFilter(np.frombuffer(bits, np.uint8), np.zeros(1 << 3, np.int64), np.full(1 << 3, n), 3, 1.5, 4)
    assert 0 < kept < len(h) and (part.levels(h[counts > 450]) > 0).all()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000 + k, x[7].tolist(), 1) for k in range(40)]  # many equal vectors
    rows += [(3000, None, 1), (3100, [0.0] * 12, 1), (3200, [1.0, None, *[0.0] * 10], 1), (3300, [float("nan")] * 12, 1), (3400, [1.0] * 5, 1), (3500, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).toPandas()
    ok = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 12}
    hit = total = 0
    for q in [i for i in ok if i % 100 == 0]:
        want = sorted((float(np.sqrt(((v - ok[q]) ** 2).sum())), i) for i, v in ok.items() if i != q)[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert all(abs(s - np.sqrt(((ok[i] - ok[q]) ** 2).sum())) < 1e-12 for i, s in zip(own["vec_id"], own["score"]))
        hit += len({i for _, i in want} & set(own["vec_id"]))
        total += 10
    assert hit / total >= 0.9 and set(got["query_id"]) == {i for i in ok if i % 100 == 0}
    assert neighbours.search(df.where("vec_id in (100, 200, 300)"), F.col("vec_id") % 100 == 0).count() == 6
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_in_pieces_and_under_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(900, 6)).astype(float)  # many ties
    x[~x.any(axis=1)] = 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[3].tolist()), (17, x[4].tolist()), (17, x[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = neighbours.search(df, F.col("vec_id") % 100 == 0, target=1.0).collect()
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 500)
    cut = neighbours.search(df, F.col("vec_id") % 100 == 0, target=1.0).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))
    many = collections.defaultdict(list)
    for i, v in rows:
        many[i].append(np.array(v))
    hit = 0
    for q in range(0, 900, 100):
        near = sorted((min(float(np.sqrt(((a - b) ** 2).sum())) for a in many[q] for b in many[j]), j) for j in many if j != q)[:10]
        got = [(r["score"], r["vec_id"]) for r in sorted((r for r in cut if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == sorted(got) and len(got) == 10
        hit += len(set(near) & set(got))
    assert hit >= 81


def test_language_id(spark, docs, texts, empty):
    rng = random.Random(2)
    kinds = {"xa": "abcde", "xb": "defgh"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(30)), k) for i, k in enumerate(["xa", "xb"] * 60)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.learn(data.where("doc_id < 80"))
    got = by_id(langid.predict(data.where("doc_id >= 80"), prototypes))
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows[80:])
    odd = by_id(langid.predict(docs, prototypes))
    assert all((odd[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(texts))
    assert langid.learn(empty) == {} and langid.predict(empty, prototypes).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}


@pytest.mark.parametrize("texts", [[None, "", "123 456", " \n"], [""], ["1 2"]])
def test_language_id_of_texts_without_letters(spark, texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    bare = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    prototypes = langid.learn(spark.createDataFrame([(0, "some words", "en")], bare.schema))
    assert langid.learn(bare) == {}
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(bare, prototypes).collect()} == {("und", 0.0)}
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert corpus_pipeline.language_id(spark, bare, "").count() == 0


def test_bundles_are_the_bound_ngrams():
    grams, owner, place = langid.gram_places(["Ab, cab", "ab"], 3)
    seen = collections.Counter((int(o), "".join(chr(c) if c else "_" for c in grams[p])) for o, p in zip(owner, place))
    assert seen == {(0, "_ab"): 1, (0, "ab_"): 2, (0, "_ca"): 1, (0, "cab"): 1, (1, "_ab"): 1, (1, "ab_"): 1}
    v = langid.gram_vectors(np.array([[97, 98, 99]], np.uint32), 64, 7)[0]
    a, b, c = langid.letter_vectors(np.array([97, 98, 99]), 64, 7)
    assert (v == np.roll(a, 2) * np.roll(b, 1) * c).all()
    dense = langid.bundles(owner, place, langid.gram_vectors(grams, 64, 7).astype(np.float32), 2)
    assert (dense[1] == sum(langid.gram_vectors(grams[[p]], 64, 7)[0] for o, p in zip(owner, place) if o == 1)).all()


def test_quality_statistics(docs, texts, empty):
    got = by_id(quality.apply_rules(docs))
    for i, t in enumerate(texts):
        w, text = words(t), (t or "").encode()
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split(b"\n") if x.split()]
        r = got[i]
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(covered)
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(text.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.apply_rules(docs).count() == docs.count() and quality.apply_rules(empty).count() == 0


def test_boilerplate_depletes(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    common = line(60)
    rows = [(i, common + "\n" + line(10), "h") for i in range(30)]  # mostly boilerplate
    rows += [(100 + i, line(100) + "\n" + common, "h") for i in range(5)]  # mostly their own
    rows += [(200 + i, common + "\n" + line(10), "other") for i in range(3)]  # rare on its host
    copy = "\n".join(line(20) for _ in range(5))
    rows += [(300 + i, copy + "\n" + line(20), "large") for i in range(40)]  # near copies, 4 % of their host
    rows += [(1000 + i, line(60), "large") for i in range(960)]
    got = by_id(quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(got[i]["kept"] for i in range(30))
    assert all(got[i]["kept"] for i in [*range(100, 105), *range(200, 203), *range(300, 340), *range(1000, 1960)])
    assert got[100]["left_words"] == 100 and got[300]["left_words"] == 120
    # the same lines over the share of a smaller host are boilerplate
    small = [(i, t, "h") for i, t, h in rows if h == "large"][:700]
    got = by_id(quality.apply_rules(spark.createDataFrame(small, "doc_id long, text string, source string")))
    assert not any(got[i]["kept"] for i in range(300, 340)) and got[300]["left_words"] == 20 and got[1000]["kept"]
    # a document is depleted below 50 words, or below 30 % of its words
    rows = [(i, common + "\n" + line(n), "h") for i, n in enumerate([49, 50, 300] + [10] * 30)]
    got = by_id(quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert [got[i]["kept"] for i in range(3)] == [False, True, True]


def test_lines_are_counted_over_all_different_documents(spark, tmp_path):
    """Pages that share several lines of boilerplate, and lines drawn from a pool: each line has over 200 documents."""
    rng = random.Random(6)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    common, pool = [line(12) for _ in range(12)], [line(8) for _ in range(30)]
    rows = [(i, "\n".join([*common, line(10)]), "page") for i in range(1000)]
    rows += [(2000 + i, "\n".join(rng.sample(pool, 10)), "pool") for i in range(1000)]
    rows += [(4000 + i, "\n".join([*common, line(10)]), "few") for i in range(200)]
    rows += [(5000 + i, rows[0][1], "copies") for i in range(300)]  # one text
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {i: r["kept"] for i, r in by_id(corpus.op8_quality_rules(spark, str(tmp_path))).items()}
    assert got == {i: i >= 5000 for i, _, _ in rows}


@pytest.mark.parametrize("common", [1, 2, 3])
def test_line_counts_against_brute_force(spark, common):
    """Documents of several hosts with common lines, at every place in the order of hashes."""
    rng = random.Random(common)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    shared = {h: [line(14) for _ in range(common)] for h in "abc"}
    rows = [(k, "\n".join([x for x in shared[h] if rng.random() < p] + [line(50)]), h) for k, (h, p) in enumerate((h, p) for h, p, n in (("a", 0.9, 120), ("b", 0.3, 90), ("c", 0.04, 100)) for _ in range(n))]
    rows += [(900, rows[0][1], "a"), (901, None, "a"), (902, "", None), (903, rows[0][1], None)]
    got = by_id(quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    for i, text, host in rows:
        own = {t for _, t, h in rows if h == host}
        gone = [x for x in (text or "").split("\n") if (n := sum(x in (t or "").split("\n") for t in own)) > 20 and n > 0.05 * len(own)]
        left = len((text or "").split()) - sum(len(x.split()) for x in gone)
        assert got[i]["kept"] == (left >= 50 and left >= 0.3 * len((text or "").split()))
        assert got[i]["left_words"] == (left if text else 0)


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, texts, empty, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    out = jaccard_join.join(docs, n=n, percent=percent)
    got, want = by_id(out), components(sets, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(texts) - 15 and out.count() == docs.count()
    if n == 4:
        assert jaccard_join.join(empty, n=n, percent=percent).count() == 0


def test_jaccard_join_in_small_tiles(spark, monkeypatch):
    """Keys that many nodes of different components have: each pair is found once, in one of the tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    rng = random.Random(12)
    base = ["w%d" % rng.randrange(10**6) for _ in range(60)]
    rows = []
    for k in range(40):  # a chain of texts that differ more and more, around one passage
        w = list(base)
        for j in range(k % 13):
            w[j] = "x%d" % rng.randrange(10**6)
        rows.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=70))
    assert {i: r["component_id"] for i, r in got.items()} == components(sets, 70)


def test_count_tree_loses_nothing_and_prunes():
    rng = np.random.default_rng(1)
    sets = []
    for size in (200, 520, 1030, 6000):  # around borders between numbers of groups
        base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        sets += [np.unique(np.r_[base[rng.random(size) < 0.97], rng.integers(0, 1 << 62, 9, dtype=np.uint64)]) for _ in range(30)]
        sets += [np.unique(rng.integers(0, 1 << 62, size - rng.integers(20), dtype=np.uint64)) for _ in range(30)]
    sizes = np.array(list(map(len, sets)))
    forest = count_tree.CountForest([count_tree.count_vector(s) for s in sets], sizes)
    kept = 0
    for i, s in enumerate(sets):
        near, _ = forest.search(i, 85)
        kept += len(near)
        assert len(near) == len(set(near.tolist()))
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert j in near or 100 * both < 85 * (len(s) + len(t) - both)
            assert count_tree.pair_bound(count_tree.count_vector(s), len(s), count_tree.count_vector(t), len(t)) >= both
    assert kept < 4 * 30 * 31 + 200  # little but the true pairs


def test_substring_dedup(docs, texts, empty):
    n, first = 13, {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = substring_dedup.remove_repeats(docs, keep={"mark": F.col("lang")})
    got, some = by_id(out), 0
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert words(r["text"]) == kept and (gone or r["text"] == t)
        copied = set()
        for f in r["factors"]:  # each is a copy of what an earlier document has, from its first place on
            a, size, source, at = f["start"], f["length"], f["source"], f["source_start"]
            assert size >= n and source < i and words(texts[source])[at : at + size] == w[a : a + size]
            assert first[tuple(w[a : a + n])] == source
            copied |= set(range(a, a + size))
        assert copied == gone
        some += bool(gone)
    assert some > 20 and out.count() == docs.count() and substring_dedup.remove_repeats(empty).count() == 0


def test_factors_meet_at_their_borders():
    there = np.array([0, 1, 1, 1, 0, 1, 0], bool)
    source, place = np.array([0, 7, 7, 5, 0, 5, 0]), np.array([0, 3, 4, 9, 0, 11, 0])
    found = substring_dedup.factors(source, place, there, 4)
    assert found == [(1, 5, 7, 3), (3, 4, 5, 9), (5, 4, 5, 11)]  # the second begins inside the first and crosses its border
    assert substring_dedup.merged(found) == [(1, 8)] and substring_dedup.factors(source, place, there & False, 4) == []


def test_packed_ints():
    for x in ([], [5], [7, 7, 262], [-(1 << 63), (1 << 63) - 1, 0], [1 << 40, (1 << 40) + 70000]):
        x = np.array(x, np.int64)
        blob = blocks.packed_ints(x) + blocks.packed_ints(x[::-1])
        a, b = blocks.unpacked_ints(blob, len(x), 2)
        assert (a == x).all() and (b == x[::-1]).all() and len(blob) >= 18


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    clean = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = clean(rng.randint(30, 400)).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile,", "awful", "nasty!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    data, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = toxicity.learn(data.where("doc_id < 400"), marks, ["quality", "toxic"])
    got = by_id(toxicity.predict(data, models, ["quality", "toxic"]))
    wrong = [i for i in range(400, 600) if got[i]["toxic"] != (i % 6 == 0)]
    assert len(wrong) <= 4 and len(models[1].chain) == 1
    assert toxicity.predict(docs, models, ["quality", "toxic"]).count() == docs.count()
    none = toxicity.learn(empty, marks.limit(0), ["quality", "toxic"])
    assert not any(r["toxic"] for r in toxicity.predict(docs, none, ["quality", "toxic"]).collect())


def test_toxicity_learns_from_a_bounded_sample_under_a_shared_id(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(20)) + " vile" * (i % 3 == 0)) for i in range(90)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    shared = [(9000, "one of many texts %d" % k) for k in range(400)]
    labels = marks.unionByName(spark.createDataFrame([(9000, 0)], marks.schema))
    models = lambda rows, most: toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, ["toxic"], train_rows=most, least_docs=2, least_z=2.0)
    one, same = models(rows, 200)[0], models(rows + rows[:30] * 3, 200)[0]
    assert (one.words == same.words).all() and np.allclose(one.weights, same.weights) and one.limit == same.limit  # copies teach once
    seen = []
    fit = toxicity.fit_chain
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "fit_chain", lambda hashes, owner, labels, *a, **k: seen.append(len(labels)) or fit(hashes, owner, labels, *a, **k))
        models(rows + shared, 1000)
        models(rows + shared, 100)
    assert seen == [490, 100]


def test_best_limit_lies_in_the_gap():
    assert toxicity.best_limit(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0]), 0.1) == pytest.approx(0.55)


def test_passages_of_chunks_without_phrases(spark):
    import numpy as np

    from weftgraph.llm import substring_dedup

    short = spark.createDataFrame([(k, "few words " * (k % 3)) for k in range(6)], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(short).collect()} == {0}
    h, d, p = np.array([5, 3, 5, 5, 3], np.uint64), np.array([2, 9, 1, 1, 9]), np.array([0, 4, 8, 6, 2])
    assert [x.tolist() for x in substring_dedup._least(h, d, p)] == [[3, 5], [9, 1], [2, 6], [False, True], [1, 0, 1, 1, 0]]
