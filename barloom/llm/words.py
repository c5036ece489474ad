"""Words of whole texts as UTF-8 bytes, and small helpers the operators share."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word character is a digit, a lower-cased ASCII letter or any byte of a character beyond ASCII.
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
WORD_TABLE = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).lower())
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_list(text: bytes | None) -> list[bytes]:
    """Words of a text, ASCII letters lower-cased; null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words of ``word_list``."""
    return [m.span() for m in WORD.finditer(text)]


def text_bytes(column: str | Column) -> Column:
    """Text as bytes for Python tasks; null becomes empty."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def hash_share(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that is not a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_parts(texts: pa.Array, size: int = 1 << 18):
    """Lists of texts of about ``size`` bytes, so that long texts do not pile up in one numpy pass."""
    part, held = [], 0
    for text in texts:
        text = text.as_py()
        if part and held + len(text) > size:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part
