"""Comment stripping, normal forms, the block scanner and its windows."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from copysift.functions import text as X
from copysift.functions.text import strip_comments, structural_view
from copysift.operators import blocks
from copysift.operators.blocks import _Outline, blocks_of, extents, extract_blocks, line_windows, net_braces, normalized, windows


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('u = "http://x/y" + 1', 'u = "http://x/y" + 1'), ("x = 1 # note", "x = 1 "), ("/* a\nb\nc\n*/d", "\n\n\nd"), ("q -- note", "q "), ("-- note", ""), ("count--;", "count--;"),
        ("a/*x*/b", "ab"), ("color: #fff;", "color: "), ("it's // kept", "it's // kept"), ("`a // b\n# c` // d", "`a // b\n# c` "), ('"a\\" # b" # c', '"a\\" # b" '), ("/*/ a */b", "b"), ("x\u00a0-- y", "x\u00a0"), ("'open\n# gone", "'open\n"),
    ],
)
def test_comments(given, want):
    assert strip_comments(given) == want


def test_structure_hides_what_strings_hold():
    assert structural_view('a("{") // }') == 'a(" ") '
    assert structural_view("`{ ${ f({a}) } {`").count("{") == structural_view("`{ ${ f({a}) } {`").count("}") == 2


FUNCTION = "function f(a) {\n  let t = 0;\n  for (const x of a) {\n    t += x;\n  }\n  return t;\n}"


def spans(source, low=3, high=400):
    return [(b["start_line"], b["end_line"]) for b in blocks_of(source, low, high)]


def test_braces_and_nested_blocks():
    assert spans(FUNCTION) == [(1, 7), (3, 5)]
    assert spans("function f() {\n}") == []
    assert spans("// one\n// two\n" + FUNCTION)[0] == (3, 9)


def test_indentation():
    assert (1, 5) in spans("def f(a):\n    t = 0\n    for x in a:\n        t += x\n    return t")


def test_else_ends_one_block_and_starts_the_next():
    assert extents("if (a) {\n  b;\n} else {\n  c;\n}") == [(1, 3), (3, 5)]


def test_open_label_holds_back_the_blocks_around_it():
    # the brace that closes the switch finds the label on top, so both end with the file
    assert extents("switch (a) {\n  case 1:\n    b;\n}\nc;") == [(2, 5), (1, 5)]


def test_block_open_at_the_end_counts_the_last_empty_line():
    assert extents("f {\n a\n b\n") == [(1, 4)]


def plain_extents(source):
    """extents() as its definition says: every block looks at all later lines."""
    outline = _Outline(source)
    closes = [net_braces(line)[1] > 0 for line in structural_view(source).split("\n")]
    open_, out = [], []
    for moment in range(2 * outline.size):
        at, indent = divmod(moment, 2)

        def may_end(line, at=at, indent=indent):
            if outline.by_brace[line]:
                return not indent and at > line and closes[at] and outline.depth[at] < outline.inside[line]
            return indent and at > line + 1 and 0 <= outline.indent[at] <= outline.indent[line] and outline.depth[at] == outline.depth[line]

        while open_ and may_end(open_[-1]):
            out.append((open_.pop() + 1, at + 1 - indent))
        if indent and (outline.by_brace[at] or outline.by_indent[at]):
            open_.append(at)
    return out + [(line + 1, outline.size) for line in reversed(open_)]


def test_extents_against_the_definition():
    rng = random.Random(1)
    pieces = ["{", "}", "if a:", "x = 1", "for b in c:", "} else {", "", "- item:", "f(a) {", "return", "{}", "}}", "{{"]
    for _ in range(1500):
        source = "\n".join(" " * rng.choice([0, 0, 2, 4, 4, 8]) + rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        assert extents(source) == plain_extents(source), source


def test_extents_of_very_many_lines():
    began = time.monotonic()
    for line in (lambda i: "f() {" if i % 14 < 7 else "}", lambda i: "if a:", lambda i: "f {" if i % 2 else "g"):
        assert len(extents("\n".join("  " * (i % 7) + line(i) for i in range(100_000)))) >= 50_000
    assert time.monotonic() - began < 60


def test_layout_and_comments_do_not_change_the_hash():
    again = FUNCTION.replace("  ", "\t\t").replace("return t;", "return t; // done")
    assert blocks_of(FUNCTION, 3, 400)[0]["norm_hash"] == blocks_of(again, 3, 400)[0]["norm_hash"]
    assert normalized("a\u00a0 b\ufeff\n\n c") == "a b\nc"


def test_long_blocks_are_cut_into_windows():
    source = "function f() {\n" + "\n".join(f"  x{i} = {i};" for i in range(300)) + "\n}"
    found = blocks_of(source, 3, 50)
    assert len(found) > 1 and all(b["sig_lines"] <= 50 and (b["block_start"], b["block_end"]) == (1, 302) for b in found)
    assert blocks_of(FUNCTION, 3, 400)[0]["block_start"] is None
    assert windows(1, 10, 4) == [(1, 4), (3, 6), (5, 8), (7, 10)] and windows(1, 3, 4) == [(1, 3)] and windows(2, 2, 1) == [(2, 2)]


def test_columns(spark):
    texts = ["  a \u00a0b\r\n\n\tc ", "", "x" * 130 + "\ny"]
    row = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(X.normal_form(F.col("t")).alias("n"), X.short_hash(F.col("t")).alias("h"), X.preview(F.col("t")).alias("p")).collect()
    assert [r["n"] for r in row] == ["a b\nc", "", "x" * 130 + "\ny"]
    assert row[0]["h"] == hashlib.sha256(texts[0].encode()).hexdigest()[:32]
    assert [r["p"] for r in row] == ["a \u00a0b c", "", "x" * 120 + "..."]
    paths = spark.createDataFrame([("a/b/c.ts",), ("c.ts",)], "f string").select(X.directory(F.col("f")).alias("d"), X.top_folder(F.col("f")).alias("t")).collect()
    assert [tuple(r) for r in paths] == [("a/b", "a"), (".", ".")]
    got = spark.range(1, 60).select("id", line_windows(F.lit(1), F.col("id"), 7).alias("w")).collect()
    assert all([tuple(x) for x in r["w"]] == windows(1, r["id"], 7) for r in got)


def test_extract_blocks(spark):
    rows = extract_blocks(spark.createDataFrame([("a.ts", FUNCTION), ("b.ts", None), ("c.ts", "")], "file string, content string"), 3).collect()
    assert [(r["file"], r["start_line"], r["end_line"], r["block_start"]) for r in rows] == [("a.ts", 1, 7, None), ("a.ts", 3, 5, None)]


def test_blocks_are_handed_on_in_pieces(spark, monkeypatch):
    page = "\n".join(["a {"] * 60 + ["x" * 200] * 5 + ["}"] * 60)  # 60 blocks that hold each other
    files = spark.createDataFrame([(f"{i}.html", page) for i in range(40)], "file string, content string").coalesce(1)
    frames = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: frames.append((run, schema)) or self)
    monkeypatch.setattr(blocks, "HANDED", 20_000)
    extract_blocks(files, 3)
    batch = blocks.pa.RecordBatch.from_pydict({"file": [f"{i}.html" for i in range(40)], "content": [page] * 40})
    out = list(frames[0][0](iter([batch])))
    assert sum(b.num_rows for b in out) == 40 * len(blocks_of(page, 3, 120)) and max(b.nbytes for b in out) < 60_000 and sum(b.nbytes for b in out) > 2_000_000


def test_comments_go_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(X, "AT_ONCE", 3)
    given = ["a // b", None, "", "# x\ny", "/* a\n*/b", "é # ü", "'# kept'"]
    assert X.stripped(X.pa.array(given, X.pa.string())).to_pylist() == [None if t is None else strip_comments(t) for t in given] and X.stripped(X.pa.array([], X.pa.string())).to_pylist() == []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", X.without_comments("t").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [None if t is None else strip_comments(t) for t in given]


def test_lines_of_a_string_are_those_of_the_column(spark):
    from copysift.functions.text import hash_of, lines_of, normal_form, normal_lines, short_hash

    odd = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    texts = [f"{x}a{x}{x} b\n{x}\n \n{y}c {x}d{y}\n" for x in odd for y in odd] + ["", "\n\n", "a", " a  b "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: (r["lines"], r["h"]) for r in rows.select("t", normal_lines(F.col("t")).alias("lines"), short_hash(normal_form(F.col("t"))).alias("h")).collect()}
    assert got == {t: (lines_of(t), hash_of(lines_of(t))) for t in texts}
