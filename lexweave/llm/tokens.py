"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa

#: Where the tokenizer's ranks lie on every executor; a parameter of all operators that count tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("lexweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: pa.Array, path: str) -> list[int]:
    """Tokens of each whole text; 0 for null and empty."""
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts.to_pylist()]
