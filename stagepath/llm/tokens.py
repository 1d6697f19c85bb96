"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's pattern goes back over a run of blanks, which fails on very long ones.
LONG_BLANK = 1000

# The characters that the vocabulary's pattern takes for white space.
_SPACES = "\t-\r \x85\xa0  -     　"
_LONG_BLANK = re.compile(f"[{_SPACES}]{{{LONG_BLANK}}}")
# The vocabulary's own pattern never crosses the border of such a chunk, so the
# chunks' ids in a row are the text's ids. A chunk of blanks is one piece of it.
_CHUNK = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


class Encoder:
    """Turns texts into ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(
            "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, text: str) -> np.ndarray:
        if _LONG_BLANK.search(text) is None:
            return np.array(self._encoding.encode_ordinary(text), np.uint32)
        ids: list[int] = []
        between: list[str] = []
        for chunk in _CHUNK.findall(text):
            if len(chunk) < LONG_BLANK or not chunk.isspace():
                between.append(chunk)
                continue
            ids += self._encoding.encode_ordinary("".join(between))
            ids += self._encoding._encode_single_piece(chunk)
            between = []
        ids += self._encoding.encode_ordinary("".join(between))
        return np.array(ids, np.uint32)


@cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)
