"""The registered queries of the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsquall.llm import oracles
from gridsquall.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracles.SQL)


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; GRIDSQUALL_TOKENIZERS names another folder."""
    if folder := os.environ.get("GRIDSQUALL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles agree to 85 %."""
    from gridsquall.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).drop("component", "row_key")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    from gridsquall.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    from gridsquall.llm.wordpiece import LongestMatch, count_tokens, marked_pieces

    return count_tokens(table(spark, sf_dir, "documents"), LongestMatch(*marked_pieces(vocabulary("piece_bpe_32k.model"))))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labels."""
    from gridsquall.llm.quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels"), held_out=held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one, exactly or nearly."""
    from gridsquall.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of those with a language."""
    from gridsquall.llm.language import predict_language, train_language

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return predict_language(docs, train_language(docs, held_out=held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, read back: where each document starts, its length and digest."""
    from gridsquall.llm.wavelet import read_token_shards, token_shards

    return read_token_shards(token_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")), with_ids=False)


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    from gridsquall.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    from gridsquall.llm.html import extract_text, train_extractor

    return extract_text(table(spark, sf_dir, "pages"), train_extractor()).withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    from gridsquall.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    from gridsquall.llm.conversations import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")))


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the cascade of rules keeps it."""
    from gridsquall.llm.rules import judge, plan_cascade

    docs = table(spark, sf_dir, "documents")
    return judge(docs, plan_cascade(docs), counts=True).drop("rejected_by")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    from gridsquall.llm.spelling import spelling_variants, thinned_words

    return spelling_variants(thinned_words(table(spark, sf_dir, "documents")))
