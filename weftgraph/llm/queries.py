"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, lm_scoring, neighbours, packing, pieces, quality, substring_dedup, token_counts, toxicity
from .common import held_out, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECE_BPE, with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 3, 1)
    prototypes = langid.learn(docs.where(~held))
    return langid.predict(docs, prototypes, keep={"held_out": held}).select("doc_id", "held_out", "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chain = table(spark, sf_dir, "documents"), ["quality", "toxic"]
    models = toxicity.learn(docs, table(spark, sf_dir, "labels"), chain)
    found = toxicity.predict(docs, models, chain)
    return found.select("doc_id", "toxic", F.col("toxic_score").alias("score"), F.col("quality_score").alias("quality_score"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lm_scoring, op3_nearest_neighbours, op4_packing, op5_sentencepiece, op6_language_id, op7_toxicity, op8_quality_rules, op9_jaccard_join, op10_substring_dedup)}
#: Words as DuckDB cuts them; A-Z alone are lowered.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The other operators hold a tokenizer or a fitted model, which SQL cannot express: tests/llm has brute force.
ORACLE: dict[str, str] = {
    "op8_quality_rules": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM d),
        win AS (SELECT doc_id, i, w[i : i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
        l AS (SELECT doc_id, source, text, line, {_WORDS.format("line")} AS lw FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM d)),
        k AS (SELECT *, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS key FROM l WHERE len(lw) > 0),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k GROUP BY 1),
        hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY 1),
        often AS (SELECT c.source, key FROM (SELECT source, key, count(DISTINCT text) AS n FROM k GROUP BY 1, 2) c JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n > 20 AND c.n > 0.05 * h.n),
        gone AS (SELECT doc_id, sum(len(lw)) AS n FROM k JOIN often o ON o.key = k.key AND o.source IS NOT DISTINCT FROM k.source GROUP BY 1),
        s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS gone FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN n_words ELSE n_words - gone END AS left_words,
            NOT base_failed AND n_words - gone >= 50 AND n_words - gone >= 0.3 * n_words AS kept FROM b""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
        e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.id = w.doc_id GROUP BY 1, 2""",
    "op10_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
        first AS (SELECT win, min(doc_id) AS first FROM win GROUP BY 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first USING (win) WHERE first < doc_id),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}
