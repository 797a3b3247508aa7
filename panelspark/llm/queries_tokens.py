"""Queries of token encoding and token files. SQL cannot express them; they are tested against the tokenizers library."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, token_files
from .tokens import Encoder

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(doc_id: pa.Array, ids: np.ndarray, at: np.ndarray, enc: Encoder) -> pa.RecordBatch:
    """Digest columns of the operator's ids and decoded texts."""

    def sha(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(np.diff(at)), sha(enc.decimal_arrow(ids, at)), sha(enc.decode_arrow(ids, at))],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encode_and_decode(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs, tokenizer_path(), finish=digests, schema=DIGESTS)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_files.read(token_files.write(docs, tokenizer_path(), END_ID), digest=True)


QUERIES = {"op1_bpe": op1_bpe, "op3_token_files": op3_token_files}
SQL: dict[str, str] = {}
