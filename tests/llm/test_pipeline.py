"""The pipeline, stage by stage, on a small table."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7))) for _ in range(800)]
    make = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(n // 4)) for _ in range(4))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(i, make(120), "en", "h%d" % (i % 4), None) for i in range(60)]
    rows += [(100, rows[5][1], "en", "h1", 0), (101, rows[6][1] + " extra", "en", "h2", 0)]  # copies
    rows += [(200, make(100) + " " + passage, "en", "h3", 0), (201, make(100) + "\n" + passage + " " + make(20), None, None, 0)]
    rows += [(300, None, "en", "h0", 0), (301, "123 456", "en", "h0", 0), (302, "too short", "en", "h0", 0), (303, "same words here " * 60, "en", "h0", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = out
    clean = set(range(60)) | {200, 201}
    assert set(seen["language_id"]) & {300, 301} == set() and clean <= set(seen["language_id"])
    assert set(seen["quality_rules"]) & {302, 303} == set() and clean <= set(seen["quality_rules"])
    assert set(seen["near_duplicates"]) == clean
    before, after = seen["near_duplicates"], seen["repeated_passages"]
    assert len(before[201].split()) - len(after[201].split()) == 60 and after[200] == before[200]
    assert {i for i in after if after[i] != before[i]} == {201}


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(range(60)) | {200, 201}
    assert all(sum(r["length"] for r in rows if r["doc_id"] == i) == next(r["doc_tokens"] for r in rows if r["doc_id"] == i) for i in (0, 200))


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rng = random.Random(3)
    make = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(80))
    a, b, c, d, e, f, g, h = (make() for _ in range(8))
    rows = [(1, a, "x"), (None, a, "y")]  # a copy without an id
    rows += [(None, b, "x"), (None, c, "x")]  # no ids, no copies
    rows += [(None, d, "x"), (None, d, "y"), (None, d + " more", "z")]  # copies, none with an id
    rows += [(2, e, "x"), (3, e, "x"), (3, f, "x")]  # two texts under one id, one a copy
    rows += [(4, g, "x"), (4, g, "y"), (4, g, "z")]  # one id and text
    rows += [(5, h, "x"), (6, "", "x"), (None, None, "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows)
    no_id = [t for i, t, _ in got if i is None and t]
    assert len(no_id) == 3 and set(no_id) - {d, d + " more"} == {b, c}
    assert sorted((i, t) for i, t, _ in got if i is not None) == sorted([(1, a), (2, e), (3, f), (4, g), (5, h), (6, "")])
    assert [t for i, t, _ in got if i is None].count(None) == 2
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stages_take_odd_rows(spark, folder):
    """Null and repeated ids, null columns, an empty and a very long text, equal rows, clashing names, an empty table."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    a, b, c, d, few, long = make(90), make(90), make(90), make(90), make(3), make(60_000)
    rows = [(1, a, "en", "h"), (1, b, "en", "h"), (None, c, "en", None), (None, d, None, None), (2, long, "en", "h"), (3, None, None, None), (4, "", "en", "h"), (5, few, "en", "h")]
    rows += [(6, make(90), "en", "h")] * 2
    rows = [(*r, len(r[1] or ""), 1, "x", 0.5, True, None) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, chunk int, th string, score double, kept boolean, `the id` string"
    docs = spark.createDataFrame(rows, schema)
    key = lambda r: (r["doc_id"], r["text"])
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0 and none.dtypes == docs.dtypes
        out = stage(spark, at, folder)
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert {(r["chunk"], r["th"], r["score"], r["kept"]) for r in got} == {(1, "x", 0.5, True)}
        kept[name], at = sorted(map(key, got), key=str), spark.createDataFrame(got, docs.schema)
    clean = [key(r) for r in docs.collect() if r["text"] and len(r["text"]) > 50]
    assert [k for k in kept["language_id"] if k != (5, few)] == sorted(clean, key=str)
    assert kept["quality_rules"] == sorted(clean, key=str)
    assert kept["near_duplicates"] == kept["repeated_passages"] == sorted(set(clean), key=str)
    assert corpus_pipeline.repeated_passages(spark, docs, folder).count() == len(rows)
    packed = corpus_pipeline.packed(spark, docs, folder)
    assert sum(r["length"] for r in packed.where("doc_id = 3").collect()) == 1
    assert corpus_pipeline.packed(spark, docs.limit(0), folder).count() == 0


def test_limit_of_likeness_falls_for_short_texts(spark):
    rows = [("a" * 300, 0.39, False), ("a" * 300, 0.41, True), ("ab cd 12 3", 0.11, True), ("ab", 0.09, False), ("é" * 50, 0.21, True), ("é" * 50, 0.19, False)]
    df = spark.createDataFrame(rows, "text string, score double, want boolean")
    found = df.select("want", corpus_pipeline._like_a_language(df["text"], df["score"]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in found)


def test_no_memo_of_words_stays_beside_later_stages(spark, folder):
    """Workers are reused in turn, so many tasks reach them all; a stage of few tasks reaches some."""
    import public_tokenizers
    import pyarrow as pa

    from weftgraph.llm import bpe, jaccard_join, langid, quality, substring_dedup

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")

    def fill(batches):
        held = list(bpe.vocabulary(path).ids(pa.array(["some words"])))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)] * batch.num_rows, pa.int64())], ["n"])

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.vocabulary.cache_info().currsize] * batch.num_rows, pa.int64())], ["n"])

    rows = spark.range(0, 24, 1, 24)
    prototypes = langid.learn(docs)
    for stage in (
        lambda d: langid.predict(d, prototypes),
        lambda d: quality.line_stats(d),
        lambda d: substring_dedup.remove_repeats(d),
        lambda d: jaccard_join.join(d),
    ):
        rows.mapInArrow(fill, "n long").collect()
        assert {r["n"] for r in rows.mapInArrow(held, "n long").collect()} == {1}
        stage(docs.repartition(24, "doc_id")).collect()
        assert 0 in {r["n"] for r in rows.mapInArrow(held, "n long").collect()}


def test_shuffle_files_go_once_a_table_is_kept(spark):
    import time

    from weftgraph.plans.lineage import cut, written

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = files(), spark.conf.get(key)
    frames = [spark.range(1000).repartition(7, "id"), spark.range(1000).repartition(5, "id")]
    kept = [cut(frames[0]), written(frames[1], "kept")]
    for _ in range(50):
        if files() <= before[0]:
            break
        time.sleep(0.2)
    assert files() <= before[0] and spark.conf.get(key) == before[1]
    assert [x.count() for x in (*kept, *frames)] == [1000] * 4
