"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def longest(path: str) -> int:
    """Bytes of the longest token."""
    return max(map(len, encoding(path).token_byte_values()))


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, capacity: int, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, in characters: the whole text if it fits, else as few
    pieces as filling each to the capacity takes. Cuts lie between characters, and the pieces
    put together give the text. A character of more tokens than the capacity is a piece alone.
    """
    enc = encoding(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))] if ids else []
    pieces, start, window = [], 0, capacity * longest(path)
    while start < len(text):
        # More characters than a piece can hold aren't looked at.
        rest = text[start : start + window]
        ids = enc.encode_ordinary(rest)
        size = len(rest)
        if len(ids) > capacity:
            size = max(1, len(b"".join(enc.decode_tokens_bytes(ids[:capacity])).decode("utf-8", "ignore")))
        count = len(enc.encode_ordinary(rest[:size]))
        while count > capacity and size > 1:
            size = max(1, min(size - 1, size * capacity // count))
            count = len(enc.encode_ordinary(rest[:size]))
        pieces.append((start, start + size, count))
        start += size
    return pieces
