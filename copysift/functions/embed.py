"""Vectors of blocks. A provider has a ``model_id`` and a pandas function from texts to unit vectors.

The one here needs no model files: it counts the structural words and signs of a text, and pairs of them, in hash
buckets. It tells copies with changed names from other code, but thresholds that were set for a trained model
do not carry over to it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from copysift.functions.text import strip_comments

try:
    from _md5 import md5  # words are short, and OpenSSL takes longer to begin than to hash them
except ImportError:
    from hashlib import md5

STRUCTURE_WORDS = frozenset("if else elif for foreach while do switch case break continue return yield await async throw raise try catch except finally new delete function def class interface struct enum import from export const let var static public private protected void null None true false in of not and or is this self lambda match with".split())
_PIECE = re.compile(r"[A-Za-z_]\w*|[0-9][\w.]*|\"[^\"\n]*\"|'[^'\n]*'|=>|->|[<>=!]=|&&|\|\||[^\s\w]")


def structure(text: str) -> list[str]:
    """The pieces of a text, with names, numbers and strings each replaced by one sign."""
    out = []
    for piece in _PIECE.findall(strip_comments(text)):
        if piece[0].isalpha() or piece[0] == "_":
            out.append(piece if piece in STRUCTURE_WORDS else "N")
        else:
            out.append("0" if piece[0].isdigit() else "S" if piece[0] in "\"'" else piece)
    return out


def structure_vector(text: str, size: int) -> list[float]:
    pieces = structure(text)
    out = np.zeros(size)
    for piece in [*pieces, *map(" ".join, zip(pieces, pieces[1:], strict=False))]:
        out[zlib.crc32(piece.encode()) % size] += 1
    length = np.sqrt((out * out).sum())
    return (out / length if length else out).astype(np.float32).tolist()


@dataclass(frozen=True)
class StructureEmbedder:
    size: int = 64

    @property
    def model_id(self) -> str:
        return f"structure-{self.size}"

    def status(self) -> str:
        return "ready"

    def column(self, text: Column) -> Column:
        size = self.size

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: structure_vector(t or "", size))

        return vectors(text)


#: Pairs of words that are hashed at once.
HASHED = 1 << 16


def _signs(text: str, size: int) -> np.ndarray:
    """For each bucket, what the pairs of neighbouring words (a lone word by itself) that are hashed to it add up to."""
    words = text.lower().encode("utf-8", "surrogatepass").split()  # at \x20 and \x09-\x0D
    pairs = map(b" ".join, zip(words, words[1:], strict=False)) if len(words) > 1 else iter(words)
    out = np.zeros(size)
    for some in itertools.batched(pairs, HASHED):
        digests = np.frombuffer(b"".join([md5(pair).digest() for pair in some]), np.uint8).reshape(-1, 16)
        buckets = np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0] % size
        out += np.bincount(buckets, np.where(digests[:, 4] < 128, 1.0, -1.0), size)
    return out


def prose_vectors(texts: Iterable[str], size: int) -> np.ndarray:
    """A row for each text: pairs of neighbouring words (a lone word by itself), each a signed count in a bucket that its MD5 names, at unit length."""
    rows = np.zeros((0, size)) if not (found := [_signs(text, size) for text in texts]) else np.stack(found)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return (rows / np.where(length > 0, length, 1)).astype(np.float32)


def prose_vector(text: str, size: int) -> list[float]:
    return prose_vectors([text], size)[0].tolist()


@dataclass(frozen=True)
class ProseEmbedder:
    """Vectors of running text: texts that share most pairs of words are near, others nearly at right angles."""

    size: int = 256

    @property
    def model_id(self) -> str:
        return f"prose-{self.size}"

    def status(self) -> str:
        return "ready"

    def column(self, text: Column) -> Column:
        size = self.size

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series(list(prose_vectors(texts.fillna(""), size)), dtype=object)

        return vectors(text)
