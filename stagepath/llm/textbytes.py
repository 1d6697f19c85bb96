"""Going through UTF-8 texts as bytes, in parts of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are taken apart at once.
PART = 1 << 22


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column in UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def parts(text: bytes, gap: re.Pattern[bytes], size: int = PART) -> Iterator[bytes]:
    """A text in parts that begin where `gap` matches, so that no word is cut."""
    start = 0
    while len(text) - start > size:
        found = gap.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text
