"""Token counts of texts by a public byte-level BPE; its folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    ranks = {}
    for line in (Path(folder) / vocabulary).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(rows: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows (key, text) as (key, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(folder, vocabulary)
        for b in batches:
            n = np.fromiter((len(bpe.encode_ordinary(t.as_py())) for t in b.column("text")), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n)], names=["key", "tokens"])

    return rows.select("key", F.col("text")).mapInArrow(count, f"key {dict(rows.dtypes)['key']}, tokens bigint")
