"""Problems 8 and 9 share the public tokenizers: their files, pre-tokens and encoders, loaded once in each worker."""

from __future__ import annotations

import base64
import importlib
import os
from functools import lru_cache

import numpy as np
import regex

#: Where the vocabulary files are, unless the installed module of public tokenizers says so itself.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: how byte-level BPE vocabularies of this family split text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)


def path(name: str = NAME, folder: str | None = None) -> str:
    if folder is None:
        try:
            return importlib.import_module("public_tokenizers").path(f"{name}.tiktoken")
        except ImportError:
            folder = FOLDER
    return os.path.join(folder, f"{name}.tiktoken")


@lru_cache(4)
def ranks(name: str = NAME, folder: str | None = None) -> dict[bytes, int]:
    with open(path(name, folder), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(4)
def encoder(name: str = NAME, folder: str | None = None):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})


@lru_cache(4)
def token_bytes(name: str = NAME, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and where each id's begin (one more than ids)."""
    by_id = sorted((rank, token) for token, rank in ranks(name, folder).items())
    sizes = np.zeros(by_id[-1][0] + 2, np.int64)
    for rank, token in by_id:
        sizes[rank + 1] = len(token)
    return np.frombuffer(b"".join(t for _, t in by_id), np.uint8), np.cumsum(sizes)
