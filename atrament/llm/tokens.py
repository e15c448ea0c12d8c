"""Sizes of texts in tokens of a public tokenizer, whose file every executor reads from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE file of ranks, in the format that tiktoken reads.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-splitting pattern that belongs to such files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(rows: DataFrame, text: str = "text", out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """Adds the number of tokens of a text; null for a null text."""

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return rows.withColumn(out, size(F.col(text)))
