"""Sizes of texts in tokens of a public byte-level BPE tokenizer, read from a rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to the rank file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """One tokenizer per Python worker and file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_of(name: str = "source"):
    return F.lower(F.trim(name))


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of every row; the text goes no further. Null and empty texts have 0 tokens."""

    docs.sparkSession.sparkContext.addFile(tokenizer)  # for executors whose machine has no such path

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer))).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", source_of().alias("source"), "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")
