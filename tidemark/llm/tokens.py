"""Sizes of texts in tokens of a public tokenizer whose file stays outside the repository."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts encoded at once; bounds the memory of their encodings.
BATCH = 64
#: Fixed value: how the byte-level vocabulary cuts a text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(path: str):
    """Tokenizer of a file: byte ranks (.tiktoken) or a tokenizer description (.json)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def counts(tokenizer, texts: list[str]) -> list[int]:  # noqa: ANN001
    """Tokens of each text, encoded in small batches."""
    if hasattr(tokenizer, "encode_ordinary"):
        return [len(tokenizer.encode_ordinary(t)) for t in texts]
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return [len(e) for at in range(0, len(texts), BATCH) for e in encode(texts[at : at + BATCH], add_special_tokens=False)]


def token_count(text: Column | str, path: str = DEFAULT_TOKENIZER) -> Column:
    """Tokens of a text (INT); NULL and empty texts have none."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(path)
        for batch in batches:
            yield pd.Series(counts(tokenizer, [t or "" for t in batch]), dtype="int32")

    return F.pandas_udf(count, T.IntegerType())(text)
