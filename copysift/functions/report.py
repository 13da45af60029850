"""A report as YAML text in block style with one space of indentation; YAML 1.1 and 1.2 readers give back what was written."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

_CHAR = r"[^\s:#\x00-\x1f\x7f-\x9f\ufeff\ud800-\udfff\ufffe\uffff]"
#: Text that may stand without quotes: YAML's production of plain scalars, narrowed to those that begin with a letter, _ or /.
#: No number, date, infinity, merge key or indicator begins so; what is left are the words of the boolean and null types.
_PLAIN = re.compile(rf"[A-Za-z_/](?:{_CHAR}|:(?={_CHAR})|(?<!\s)\#|\x20(?=[^\s#]))*")
_WORDS = frozenset("y n yes no on off true false null".split())
#: Characters that JSON leaves as they are and YAML takes for line breaks, or does not allow.
_ESCAPED = re.compile(r"[\x7f-\x9f\u2028\u2029\ufeff\ud800-\udfff\ufffe\uffff]")


def _text(text: str) -> str:
    if _PLAIN.fullmatch(text) and text.lower() not in _WORDS:
        return text
    return _ESCAPED.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def _number(x: float) -> str:
    """A finite number; floats without a fraction are written as integers while they are exact, and every exponent has a fraction before it, as YAML 1.1 wants."""
    if x == int(x) and abs(x) < 1 << 53:
        return str(int(x))
    text = repr(x)
    return text if isinstance(x, int) or "." in text else text.replace("e", ".0e")


def _inline(value: Any) -> str:
    if isinstance(value, dict):
        return "{}"
    if isinstance(value, (list, tuple)):
        return "[]"
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        # numbers that are none have no form that all readers know: they are text
        return _number(value) if math.isfinite(value) else json.dumps("NaN" if value != value else "Infinity" if value > 0 else "-Infinity")
    return _text(str(value))


def _lines(value: Any) -> Iterator[str]:
    """The lines of a value; one line if it is written in place."""
    if not isinstance(value, (dict, list, tuple)) or not value:
        yield _inline(value)
    elif isinstance(value, dict):
        for key, item in value.items():
            first, *rest = _lines(item)
            if isinstance(item, (dict, list, tuple)) and item:
                yield f"{_text(str(key))}:"
                yield from (f" {line}" for line in (first, *rest))
            else:
                yield f"{_text(str(key))}: {first}"
    else:
        for item in value:
            first, *rest = _lines(item)
            yield f"- {first}"
            yield from (f"  {line}" for line in rest)


def to_yaml(value: Any) -> str:
    return "\n".join(_lines(value))
