"""Query of cross-tokenizer alignment. SQL cannot express it; it is tested against both libraries over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import aligned


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return aligned(docs, *tokenizer_paths())[0]


QUERIES = {"op13_alignment": op13_alignment}
SQL: dict[str, str] = {}
