"""The queries opN_* over the whole of their tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, mixing, neardup, paragraphs, phrases, ppm, prefixes, quality, secrets, suffixes, urls, vectors
from .common import documents, id_crc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.clusters(spark, documents(spark, sf_dir))


def op2_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(spark, documents(spark, sf_dir), width=3, percent=85)
    return found.withColumn("kept", F.expr("doc_id <=> component_id"))


def op3_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir), 200)


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), tokenizer_path(), ["doc_id"])


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return urls.judge(spark, pages).select("page_id", "host", "path", "rule", "verdict")


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False))
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out)
    return language.identify(docs, ~held_out, ["doc_id", "held_out"])


def op7_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.links(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)
    return found.withColumn("kept", F.expr("vec_id <=> component_id"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(documents(spark, sf_dir, "doc_id", "source", "text"))
    return found.select(F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(id_crc(), F.lit(5)) == 1, F.lit(False))
    docs = documents(spark, sf_dir).withColumn("held_out", held_out)
    return ppm.score(docs, ~held_out, ["doc_id", "held_out"])


def op11_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, documents(spark, sf_dir, "text", "lang"))


def op12_block_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return prefixes.digest(spark, prefixes.with_heads(turns, F.expr("conv - conv % 100"), id_crc("conv") % 6))


def op13_window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_paragraph_banding, op2_odd_sketch_minhash, op3_column_bwt, op4_bpe_tree, op5_redirect_equivalence, op6_hyperdimensional_language, op7_apportioned_mix, op8_spherical_caps, op9_line_frequency, op10_partial_matching, op11_quotient_phrases, op12_block_trie, op13_window_entropy)}
SQL = {"op5_redirect_equivalence": urls.URL_SQL, "op7_apportioned_mix": mixing.MIX_SQL, "op9_line_frequency": quality.QUALITY_SQL, "op11_quotient_phrases": phrases.PHRASE_SQL, "op12_block_trie": prefixes.TRIE_SQL}
