"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.langid import identify

    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents"), carry=False).drop("source")


def op4_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm.shared import fresh_path
    from ledgerloom.llm.tokenstore import read_digests, write_store

    path = fresh_path(spark, "tokens")
    write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, path)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.pii import digest, find_personal_data

    return digest(find_personal_data(_table(spark, sf_dir, "documents")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"), detections=False)


def op8_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm.shared import fresh_path
    from ledgerloom.llm.tokencounts import count_tokens, write_flat

    path = fresh_path(spark, "flat")
    write_flat(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return count_tokens(spark, path)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm.bpe import encode_digest

    return encode_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.quality import judged

    judgement = judged(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judgement.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.conversations import damaged, repair_findings

    conversations = _table(spark, sf_dir, "conversations")
    return repair_findings(conversations, damaged(conversations))


def op13_vectordedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.vectordedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_language": op2_language,
        "op3_mixing": op3_mixing,
        "op4_tokenstore": op4_tokenstore,
        "op5_pii": op5_pii,
        "op6_neighbours": op6_neighbours,
        "op7_licenses": op7_licenses,
        "op8_tokencounts": op8_tokencounts,
        "op9_bpe": op9_bpe,
        "op10_quality": op10_quality,
        "op11_importance": op11_importance,
        "op12_conversations": op12_conversations,
        "op13_vectordedup": op13_vectordedup,
    }


def oracle_sql() -> dict[str, str]:
    from ledgerloom.llm import quality

    return {"op10_quality": quality.oracle()}
