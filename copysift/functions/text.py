"""Text functions: normal forms and hashes as DataFrame expressions, and the comment scanner as an Arrow function."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as a set of code points (it has the no-break and zero-width ones, and not U+0085).
SPACES = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_SPACE = SPACES.replace("\\x0B", "\\x0b").replace("\\f", "\\x0c")

#: What the scanner tells apart: comments (first group), templates that run over lines, and strings that end with their line.
_PIECES = re.compile(
    rf"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|\#[^\n]*|(?<![^{_SPACE}])--[^\n]*)|(?P<template>`(?:\\[^\n]?|[^`\\])*(?:`|\Z))|(?P<string>"(?:\\[^\n]?|[^"\\\n])*"?|'(?:\\[^\n]?|[^'\\\n])*'?)""".replace(" #", "#"),
    re.S,
)
_IN_TEMPLATE = re.compile(r"\\[^\n]?|\$\{|[`{}]|[^\\$`{}]+|\$")
_VISIBLE = re.compile(r"[^\n]")


def strip_comments(source: str) -> str:
    """The source without comments; strings are kept and so is every line."""
    if not ("#" in source or "//" in source or "/*" in source or "--" in source):
        return source
    return _PIECES.sub(lambda m: "\n" * m[0].count("\n") if m["comment"] else m[0], source)


def _blank(text: str) -> str:
    return _VISIBLE.sub(" ", text)


def _template_view(text: str) -> str:
    """A template with its text blanked; the code in ${ } stays, so its braces balance."""
    out, depth = ["`"], 0
    for m in _IN_TEMPLATE.finditer(text, 1):
        piece = m[0]
        if depth:
            depth += {"{": 1, "${": 1, "}": -1}.get(piece, 0)
            out.append(piece)
        elif piece == "${":
            depth = 1
            out.append(" {")
        else:
            out.append(piece if piece == "`" else _blank(piece))
    return "".join(out)


def _template_end(text: str, at: int) -> int:
    """The place behind the template that begins at ``at``; a ` inside ${ } does not end it."""
    depth = 0
    for m in _IN_TEMPLATE.finditer(text, at + 1):
        if depth:
            depth += {"{": 1, "${": 1, "}": -1}.get(m[0], 0)
        elif m[0] == "${":
            depth = 1
        elif m[0] == "`":
            return m.end()
    return len(text)


_OPENERS = re.compile(r"""`|"(?:\\[^\n]?|[^"\\\n])*"?|'(?:\\[^\n]?|[^'\\\n])*'?""")


def structural_view(source: str) -> str:
    """The source without comments and with what strings hold blanked: only structure is left."""
    text = strip_comments(source)
    out, at = [], 0
    while m := _OPENERS.search(text, at):
        out.append(text[at : m.start()])
        piece = m[0]
        if piece == "`":
            at = _template_end(text, m.start())
            out.append(_template_view(text[m.start() : at]))
        else:
            closed = len(piece) > 1 and piece[-1] == piece[0] and not re.search(r"(?<!\\)(?:\\\\)*\\.$", piece)
            out.append(piece[0] + _blank(piece[1:-1] if closed else piece[1:]) + (piece[-1] if closed else ""))
            at = m.end()
    out.append(text[at:])
    return "".join(out)


#: Texts that are Python strings at once.
AT_ONCE = 64


def stripped(source: pa.Array) -> pa.Array:
    """strip_comments() of an Arrow array, some texts at a time: what a batch holds twice is bytes, not strings."""
    parts = [pa.array([None if x is None else strip_comments(x) for x in source[at : at + AT_ONCE].to_pylist()], pa.string()) for at in range(0, len(source), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def without_comments(source: pa.Array) -> pa.Array:
    """strip_comments() as a column function; null stays null."""
    return stripped(source)


def normal_lines(text: Column) -> Column:
    """The lines of a text with runs of white space as one space, trimmed, without empty ones."""
    inside = SPACES.replace("\\n", "")  # line ends stay, so one pass over the text does for all lines
    lines = F.transform(F.split(F.regexp_replace(text, f"[{inside}]+", " "), "\n"), lambda x: F.btrim(x))
    return F.filter(lines, lambda x: x != "")


#: White space of str.split() that is none here, and the other way round.
_UNLIKE = re.compile("[\x1c-\x1f\x85\ufeff]")
_INSIDE = re.compile(f"[{_SPACE}]+".replace("\\n", ""))


def lines_of(text: str) -> list[str]:
    """normal_lines() of a string."""
    if _UNLIKE.search(text):
        lines = (_INSIDE.sub(" ", line).strip(" ") for line in text.split("\n"))
    else:
        lines = (" ".join(line.split()) for line in text.split("\n"))
    return [line for line in lines if line]


def hash_of(lines: list[str]) -> str:
    """short_hash() of the normal form that has these lines."""
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def normal_form(text: Column) -> Column:
    return F.array_join(normal_lines(text), "\n")


def short_hash(text: Column, length: int = 32) -> Column:
    """The first hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def preview(text: Column) -> Column:
    """The first two lines that are not blank, trimmed, on one line of at most 120 characters."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", ""))
    line = F.array_join(F.slice(F.filter(trimmed, lambda x: x != ""), 1, 2), " ")
    return F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 120), F.lit("..."))).otherwise(line)


def directory(file: Column) -> Column:
    return F.when(F.contains(file, F.lit("/")), F.regexp_extract(file, "(?s)^(.*)/[^/]*$", 1)).otherwise(".")


def top_folder(file: Column) -> Column:
    return F.when(F.contains(file, F.lit("/")), F.substring_index(file, "/", 1)).otherwise(".")


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
