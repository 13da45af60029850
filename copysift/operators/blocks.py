"""Candidate blocks of source files: bodies in braces, bodies by indentation, and windows of long ones."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copysift import config as C
from copysift.functions.text import _SPACE, strip_comments, structural_view

_STRIP = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_RUN = re.compile(f"[{_SPACE}]+")
_INDENT = re.compile(r"[ \t]*")


def net_braces(line: str) -> tuple[int, int]:
    """(opened, closed) of a line once pairs within it are taken out."""
    braces = re.sub(r"[^{}]", "", line)
    while "{}" in braces:
        braces = braces.replace("{}", "")
    return braces.count("{"), braces.count("}")


def indent_of(line: str) -> int:
    return len(_INDENT.match(line)[0].replace("\t", "    "))


class _Minima:
    """Range minima of some lines' values, to find the next line with a small one: level k holds the least of 2^k values from each place on."""

    def __init__(self, lines: np.ndarray, values: np.ndarray) -> None:
        self.lines, levels, span = lines, [values], 1
        while 2 * span <= len(values):
            levels.append(np.minimum(levels[-1][:-span], levels[-1][span:]))
            span *= 2
        self.levels = [level.tolist() for level in levels]

    def next(self, line: int, most: int) -> int | None:
        """The first line, from ``line`` on, whose value is ``most`` or less."""
        i = int(np.searchsorted(self.lines, line))
        level, rising = 0, True
        while i < len(self.lines):
            if i < len(self.levels[level]) and self.levels[level][i] > most:
                i += 1 << level  # none of these
                level += rising and level + 1 < len(self.levels)
            elif level:
                level, rising = level - 1, False
            else:
                return int(self.lines[i])
        return None


class _Outline:
    """The structure of a source as arrays over its lines: nesting once a line has closed what it closes, what it opens, and indents (-1 on blank lines)."""

    def __init__(self, source: str) -> None:
        lines = structural_view(source).split("\n")
        opened, closed = np.array([net_braces(line) for line in lines], np.int64).reshape(-1, 2).T
        self.depth = np.cumsum(opened - closed) - opened
        self.indent = np.array([indent_of(line) if line.strip(_STRIP) else -1 for line in lines], np.int64)
        shown = np.flatnonzero(self.indent >= 0)
        deeper = np.zeros(len(lines), bool)
        deeper[shown[:-1]] = np.diff(self.indent[shown]) > 0
        announced = np.array([line.rstrip(_STRIP).endswith((":", "-")) for line in lines], bool)
        self.by_brace = (opened > 0) & (self.indent >= 0)
        self.by_indent = ~self.by_brace & deeper & announced
        self.inside = self.depth + opened
        self.size = len(lines)
        closing = np.flatnonzero(closed > 0)
        self._closing = _Minima(closing, self.depth[closing])
        order = shown[np.argsort(self.depth[shown], kind="stable")]
        depths, firsts = np.unique(self.depth[order], return_index=True)
        self._at_depth = {int(d): _Minima(at, self.indent[at]) for d, at in zip(depths, np.split(order, firsts[1:]), strict=False)}  # none, if there are no lines

    def end_from(self, line: int, moment: int) -> int | None:
        """The first moment, from ``moment`` on, at which the block that begins on ``line`` may end: 2 * line for a closing brace, 2 * line + 1 for an indent."""
        if self.by_brace[line]:
            at = self._closing.next(max(line + 1, (moment + 1) // 2), int(self.inside[line]) - 1)
            return None if at is None else 2 * at
        at = self._at_depth[int(self.depth[line])].next(max(line + 2, moment // 2), int(self.indent[line]))  # a body has a line at least
        return None if at is None else 2 * at + 1


def extents(source: str) -> list[tuple[int, int]]:
    """(first, last) line, from 1, of every block in the order in which blocks end.

    A line with more opening than closing braces starts a block that lasts until nesting falls below the depth
    inside it. A line that ends in : or - and is followed by a deeper one starts a block that lasts until a line
    at its depth is indented no deeper. The innermost block ends first, so one that does not end holds
    back those around it; what is open at the end of the file ends there.

    When a block ends depends on it and on the blocks that begin within it, so blocks are settled from the last to the first:
    each takes the first of its natural ends at which none that began after it is open.
    """
    outline = _Outline(source)
    starts = np.flatnonzero(outline.by_brace | outline.by_indent)
    never = 2 * outline.size
    ends, begun = np.full(len(starts), never), 2 * starts + 1
    for k in range(len(starts) - 1, -1, -1):
        line, inner = int(starts[k]), k + 1  # the next block within that is not known to have ended
        moment = outline.end_from(line, 0)
        while moment is not None:
            if inner >= len(starts) or moment <= begun[inner]:
                ends[k] = moment
                break
            # nothing can end before that block has; a brace that ends with an indent waits for the next line, which its moments see to
            moment = outline.end_from(line, int(ends[inner]))
            inner = int(np.searchsorted(begun, ends[inner]))
    order = np.lexsort((-starts, ends))
    lasts = np.where(ends == never, outline.size, ends // 2 + 1 - ends % 2)
    return [(int(starts[k]) + 1, int(lasts[k])) for k in order]


def normalized(text: str) -> str:
    kept = (_RUN.sub(" ", line).strip(_STRIP) for line in strip_comments(text).split("\n"))
    return "\n".join(line for line in kept if line)


def windows(first: int, last: int, size: int) -> list[tuple[int, int]]:
    """Runs of ``size`` lines, each half a run further on, until one reaches the last line."""
    step = max(1, int(size * (1 - C.WINDOW_OVERLAP)))
    count = max(0, -(-(last - first + 1 - size) // step)) + 1
    return [(first + k * step, min(first + k * step + size - 1, last)) for k in range(count)]


def each_block(source: str, min_lines: int, max_lines: int) -> Iterator[dict]:
    """blocks_of(), one at a time: blocks hold each other, so all of their texts may be many times the file."""
    lines = source.split("\n")
    found: dict[tuple[int, int], dict] = {}

    def add(first: int, last: int, block: tuple[int, int] | None) -> int:
        normal = normalized("\n".join(lines[first - 1 : last]))
        count = normal.count("\n") + 1 if normal else 0
        if count >= min_lines and (block or count <= max_lines):
            found.setdefault((first, last), {"start_line": first, "end_line": last, "norm_hash": hashlib.sha256(normal.encode()).hexdigest()[:32], "sig_lines": count, "block_start": block and block[0], "block_end": block and block[1]})
        return count

    for first, last in extents(source):
        if add(first, last, None) > max_lines:
            for a, b in windows(first, last, max_lines):
                add(a, b, (first, last))
    for first, last in sorted(found):
        yield found[first, last] | {"text": "\n".join(lines[first - 1 : last])}


def blocks_of(source: str, min_lines: int, max_lines: int) -> list[dict]:
    """The blocks of one file with at least ``min_lines`` significant lines, ordered by place; one with more than ``max_lines`` in windows."""
    return list(each_block(source, min_lines, max_lines))


SCHEMA = "file string, start_line int, end_line int, text string, norm_hash string, sig_lines int, block_start int, block_end int"
_KIND = pa.schema([(name, {"string": pa.string(), "int": pa.int32()}[kind]) for name, kind in (x.split(" ") for x in SCHEMA.split(", "))])
#: Characters of texts after which blocks are handed on, and blocks.
HANDED, HANDED_ROWS = 1 << 20, 4096


def extract_blocks(files: DataFrame, min_lines: int = 6, max_lines: int = C.MAX_BLOCK_LINES) -> DataFrame:
    """Blocks of every file of (file, content); block_start and block_end are null but on windows. Null content has none.

    Files are read one at a time and blocks handed on in pieces, so a task holds a batch of files (of bounded bytes) and one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                for block in each_block(content.as_py() or "", min_lines, max_lines):
                    rows.append({"file": file.as_py()} | block)
                    size += len(block["text"])
                    if size >= HANDED or len(rows) >= HANDED_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _KIND)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _KIND)

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def line_windows(first: Column, last: Column, size: int) -> Column:
    """windows() as a column: an array of (start_line, end_line)."""
    step = max(1, int(size * (1 - C.WINDOW_OVERLAP)))
    count = F.greatest(F.lit(0), F.ceil((last - first + 1 - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.struct((first + k * step).alias("start_line"), F.least(first + k * step + size - 1, last).alias("end_line")))
