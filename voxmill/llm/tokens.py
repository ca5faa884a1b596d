"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import arrow_map

#: A rank file (tiktoken) or a tokenizer file (json); must be readable on every executor.
TOKENIZER = os.environ.get("VOXMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the public pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its token ids."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(texts: DataFrame, id_col: str, text_col: str, *extra: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens, ...extra): the size of every text; null and empty texts have 0 tokens."""
    src = texts.select(F.col(id_col), F.col(text_col).alias("_text"), *extra)

    def run(b: pa.RecordBatch) -> dict:
        enc = encoder(tokenizer)
        n = np.fromiter((len(enc(t)) if t else 0 for t in b.column("_text").to_pylist()), np.int64, b.num_rows)
        return {id_col: b.column(id_col), "n_tokens": n, **{c: b.column(c) for c in extra}}

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return arrow_map(src, run, ", ".join([f"`{id_col}` {kinds[id_col]}", "n_tokens bigint", *(f"`{c}` {kinds[c]}" for c in extra)]))
