"""Public tokeniser files, read through Spark so that any store can hold them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"
MODEL = f"{FOLDER}/piece_bpe_32k.model"
RANKS = f"{FOLDER}/byte_bpe_50k.tiktoken"
# A vocabulary travels with the tasks, so a file above this size is refused.
MOST_BYTES = 16_000_000


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of one tokeniser file of at most ``MOST_BYTES``."""
    where = path if "://" in path else f"file://{path}"
    files = spark.read.format("binaryFile").load(where)
    size = files.select("length").first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{path}: {size} bytes are too many for a vocabulary that every task holds")
    return bytes(files.select("content").first()[0])
