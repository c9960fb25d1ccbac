"""The corpus pipeline: five stages, each applied to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echomark.llm import bpe, mixing, neardup, quality, suffixes
from echomark.llm.common import SPACES, WORD, Cut, remove
from echomark.llm.queries import tokenizer_path

#: Length in bytes of a repeated string that is cut out.
REPEAT_BYTES = 200


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above their host's limit are removed, and documents that the quality rules reject go.

    Exact copies count as one text here, because the next stage is to find them: a group of copies does not turn its own prose into boilerplate.
    Null and empty texts are rejected, repeated rows share one verdict, an empty table gives an empty one, columns of any name stay.
    """
    return with_length(quality.clean(docs, count="texts"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays.

    Null and empty texts and rows without an id have no duplicates and stay; of rows of one id one stays; columns of any name stay as they are.
    """
    return neardup.keep_one(spark, docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES bytes that start anywhere else too are cut out; a document of which nothing but white space is left goes.

    So do null and empty texts. Of repeated rows nothing is left but what is shorter than such a string; an empty table gives an empty one; columns of any name stay as they are.
    """
    out = with_length(suffixes.remove_repeats(docs, REPEAT_BYTES))
    return out.where(F.regexp_replace("text", SPACES, "") != "")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes all of its words, and once more with the words of the remainder's blocks, each with the white space after it but for the last.

    Null and empty texts have no words and go; a null source is a source; repeated rows are mixed as separate documents; an empty table gives an empty one; columns named like the mix's own stay as they are.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c in mixing.RESULTS}
    rows = mixing.mix(spark, docs.withColumnsRenamed(own)).where("taken > 0")
    rows = rows.withColumn("__whole", F.explode(F.expr("concat(array_repeat(true, cast(taken div size as int)), if(taken % size > 0, array(false), cast(array() as array<boolean>)))")))
    words = F.regexp_extract_all("text", F.lit(f"{WORD}(?:{SPACES})?"), F.lit(0))
    # bound by a lambda, so that a text is cut into words once and not for every span
    taken = F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.transform("spans", lambda x: F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int"))))))
    text = F.when(F.col("__whole"), F.col("text")).otherwise(F.regexp_replace(F.array_join(taken, ""), f"{SPACES}\\z", ""))
    return with_length(rows.withColumn("text", text).drop(*mixing.RESULTS).withColumnsRenamed({v: k for k, v in own.items()})).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, and digests of ids and decoded text of every row, copies of a document included; null text is empty, other columns are left out."""
    return bpe.digest(docs, tokenizer_path(), keep=["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Near-duplicates, repeated strings and byte-pair merges are not expressible in SQL; tests/llm/test_pipeline.py tests the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs, cut, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Cut(spark), None
    for _, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir))
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
