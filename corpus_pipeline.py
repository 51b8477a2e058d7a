"""A corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes the Parquet that the one before wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jaccard_join, langid, packing, quality, substring_dedup
from weftgraph.llm.common import give_back
from weftgraph.plans.lineage import cut, written

#: The least cosine with the best language prototype; junk and unlearned scripts lie below. A text of few letters
#: is a small sample of its language's n-grams, so its limit falls with the root of their number, down to a floor
#: that is above what unrelated vectors reach by chance.
LEAST_COSINE, WHOLE_LETTERS, COSINE_FLOOR = 0.4, 200, 0.1


def _like_a_language(text: Column, score: Column) -> Column:
    letters = F.length(F.regexp_replace(text.cast("string"), r"[^\p{L}]", ""))
    limit = F.greatest(F.lit(COSINE_FLOOR), LEAST_COSINE * F.sqrt(F.least(F.lit(1.0), letters / WHOLE_LETTERS)))
    return (score >= LEAST_COSINE) | (score >= limit)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels teach; no text, no letters or no likeness go.

    Each row is judged by its text alone: ids may be null or repeated, equal rows stay or go together, further
    columns pass through whatever their names. Long texts are read whole. An empty table stays empty.
    """
    give_back(spark)
    columns = docs.columns
    found = langid.predict(docs, langid.learn(docs), keep={c: F.col(c) for c in columns})
    text = F.col(f"c{columns.index('text')}")
    named = found.toDF("__id", *[f"c{k}" for k in range(len(columns))], "__lang", "__score")
    kept = named.where((F.col("__lang") != "und") & _like_a_language(text, F.col("__score")))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Rows go by id and text: equal rows stay or go together, rows that only share an id, or have none, are judged
    apart. A null or empty text has no words and goes; a null source is a host of its own. Further columns pass
    through. An empty table stays empty.
    """
    give_back(spark)
    rejected = quality.apply_rules(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    text = F.xxhash64(F.col("text").cast("string"))
    return docs.join(rejected, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text == F.col("__hash")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row: that with the smallest id.

    Rows without an id come last. A row is known by id and text, so rows that only share an id, or have none, do
    not go with each other; of rows equal in both one stays. Texts without words are in no group and all stay.
    """
    give_back(spark)
    found = jaccard_join.join(docs, n=5, percent=80, with_keys=True).where("n_shingles > 0")
    rows = found.groupBy("component", "tid", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "tid")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tid") == F.col("best.tid"))
    marked = rows.join(best, "component").select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"), stays.alias("__stays"), "copies")
    marked = cut(marked.where("not __stays or copies > 1").drop("copies"))
    give_back(spark)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (jaccard_join.text_id("text") == F.col("__tid"))
    single = docs.join(marked, same, "left_anti")
    repeated = docs.join(marked.where("__stays"), same).groupBy("__id", "__tid").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return single.unionByName(repeated.select("__row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has.

    No row goes: a null text has nothing to remove, a text of repeats alone becomes empty. Rows without an id
    and further columns pass through; ``n_chars`` follows the text. An empty table stays empty.
    """
    give_back(spark)
    columns = [c for c in docs.columns if c != "text"]
    found = substring_dedup.remove_repeats(docs, keep={f"__{k}": F.col(c) for k, c in enumerate(columns)})
    kept = {c: F.col(f"__{k}") for k, c in enumerate(columns)} | {"text": F.col("text")}
    if "n_chars" in columns:
        kept["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[kept[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length; a null or empty text is the one id that ends a document."""
    give_back(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
