"""What the operators hold, and what they give back."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("weftgraph.llm")
import corpus_pipeline  # noqa: E402
from weftgraph.llm import common, lm_scoring, substring_dedup  # noqa: E402


def whole_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stage_lets_the_heap_shrink(spark, stage):
    rows = [(k, "one two three four five six %d" % k, "en", "s", 30) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    before = whole_collections(spark)
    assert stage(spark, docs, "").count() >= 0 and whole_collections(spark) > before


def test_places_of_phrases_are_small():
    text = b" ".join(b"w%d" % k for k in range(200_000))
    hashes, owner, first = substring_dedup.phrases([text[:1000], text], 13)
    assert owner.dtype == first.dtype == np.int32 and first[-1] == 200_000 - 13 and owner[-1] == 1
    tracemalloc.start()
    substring_dedup._least(hashes, owner.astype(np.int64), first)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 80 * len(hashes)


def test_words_are_told_apart_once():
    tokens, hashes, ends = lm_scoring.sequences([b"A b a", b"", b"b"])
    assert tokens.tolist() == [2, 3, 2, 0, 0, 3, 0] and ends.tolist() == [0, 4, 5, 7] and len(hashes) == 4
    left = lm_scoring.before(tokens, ends, 1)
    assert left.tolist() == [1, 2, 3, 2, 1, 1, 3]
    pairs = lm_scoring.pairs_of(tokens, hashes, ends)
    assert (pairs == lm_scoring.pair_hashes(hashes[left], hashes[tokens])).all() and len(set(pairs.tolist())) == 7
    assert (common.distinct(pairs)[common.ranks(pairs)] == pairs).all() and not len(common.ranks(pairs[:0]))
