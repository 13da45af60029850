"""WARC archives, also damaged ones, and main text of pages."""

import gzip
import hashlib
import random
import time

import pytest

from copysift.llm import warc, wrapper
from copysift.llm.wrapper import Page, decided, main_text, matching, merged, tree
from tests.llm import brute

KIND = "page_id long, url string, html string, payload string, refers_to int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], KIND)


def record(name, payload, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def names(found):
    return [r["warc-record-id"] for _, r in found]


def test_round_trip(spark, tmp_path):
    big = "é😀\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (2, "u\r\nX: y", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "z" * 2000), (8, "u", "z" * 2000), (8, "u", "z" * 2000)]
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.archived(pages(spark, rows), str(tmp_path / "a")).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    for i in (1, 3):
        r = got[i, sha(big)]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == ("revisit", 5, len(big.encode()))
    for i, text in ((5, big), (2, "short"), (4, "short"), (6, ""), (7, ""), (None, "z" * 2000), (8, "z" * 2000)):
        r = got[i, sha(text)]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == ("response", None, len(text.encode()))
    assert warc.archived(pages(spark, []), str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_goes_on_behind_damage(spark, tmp_path, packed):
    pack = gzip.compress if packed else bytes
    parts = [pack(record(i, b"payload %d " % i * 40)) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    parts[2] = bytes(broken)
    parts[4] = parts[4][: len(parts[4]) * 2 // 3]
    data = parts[0] + b"noise" * 3 + b"".join(parts[1:])
    found, gaps = warc.salvage(data)
    assert names(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    at = [0]
    for p in [parts[0], b"noise" * 3, *parts[1:]]:
        at.append(at[-1] + len(p))
    assert [(a, b) for a, b, _ in gaps] == [(at[1], at[2]), (at[3], at[4]), (at[5], at[6])]
    (tmp_path / "x.warc").write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sum(r["record_type"] == "quarantined" for r in rows) == 3 and sum(r["record_type"] == "response" for r in rows) == 4


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "http://a/", f"{i} " * (30_000 if i % 10 == 0 else 10)) for i in range(60)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "a"), most=100_000)
    sizes = [f.stat().st_size for f in (tmp_path / "a").rglob("*.txt")]
    assert len(sizes) > 2 and max(sizes) < 300_000
    assert {warc_id(r) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()} == set(range(60))


def warc_id(row):
    return int(row["record_id"].removeprefix("<urn:page:").removesuffix(">"))


def test_lost_records_are_an_error_and_logged(spark, tmp_path, monkeypatch):
    write = warc.write_archives

    def damaged(table, path, least):
        write(table, path, least)
        file = max((f for f in (tmp_path / "a").rglob("*.txt")), key=lambda f: f.stat().st_size)
        data = bytearray(file.read_bytes())
        data[len(data) // 2] ^= 0xFF
        file.write_bytes(bytes(data))
        for crc in file.parent.glob(".*.crc"):
            crc.unlink()

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(RuntimeError, match="9 pages were written and 8 read, 1 gaps"):
        warc.archived(pages(spark, [(i, "u", f"text {i} " * 50) for i in range(9)]).coalesce(1), str(tmp_path / "a"))
    gap = spark.read.parquet(str(tmp_path / "a" / "gaps")).first()
    assert gap["reason"] in ("block digest differs", "bad header", "no version line", "no end marker") and gap["gap_end"] > gap["place"]


def test_a_member_that_is_too_large_is_quarantined(monkeypatch):
    one = gzip.compress(record(1, b"x"))
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    found, gaps = warc.salvage(gzip.compress(record(2, b"y" * 5000)) + one)
    assert names(found) == ["<urn:page:1>"] and gaps[0][2] == "gzip member too large"


def test_salvage_of_nothing_and_of_noise():
    assert warc.salvage(b"") == ([], [])
    assert warc.salvage(b"WARC/1.1\r\nnothing")[1] == [(0, 17, "headers do not end")]


@pytest.mark.parametrize("noise", [b"WARC/1.1\r\n" * 200_000, b"WARC/1.1\r\nA: b\r\n" * 100_000, b"\x1f\x8b\x08" * 50_000])
def test_noise_of_marks_takes_linear_time(noise):
    start = time.time()
    found, gaps = warc.salvage(noise + b"\r\n\r\n" + record(1, b"x"))
    assert names(found) == ["<urn:page:1>"] and gaps[0][:2] == (0, len(noise) + 4) and time.time() - start < 10


def test_payload_that_looks_like_a_record_is_no_record():
    inner = record(9, b"x")
    assert names(warc.salvage(record(1, inner))[0]) == ["<urn:page:1>"]


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>N{0}</a></li></ul></nav><div class="ad">Buy {0}</div><article><h1>Head {0}</h1><p><b>Bold {0}.<br><p>One &amp; two {0}\n  lines</p><ul><li>item {0}</ul><p>A<span>B</span> C</article><div id="comments"><p>Reader {0}</p></div><footer>&copy; {0}</footer>'


def text_of(i):
    return f"Head {i}\nBold {i}.\nOne & two {i} lines\nitem {i}\nAB C"


def test_main_text_of_a_host(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{0}", str(i))) for i in range(30)] + [(40, "http://other.example/", PAGE.replace("{0}", "x")), (41, None, None), (42, "", ""), (43, "nothing", "<p>Just text"), (43, "nothing", "<p>Just text")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in wrapper.extracted(pages(spark, rows)).collect()]
    want = [(i, text_of(i)) for i in range(30)] + [(40, text_of("x")), (41, ""), (42, ""), (43, "Just text"), (43, "Just text")]
    assert sorted(got) == sorted((i, t, len(t)) for i, t in want)
    assert wrapper.extracted(pages(spark, [])).count() == 0


def test_constant_slots_are_template_and_varying_ones_content():
    make = lambda i: f"<body><div class=top><p>Always the same words here</p></div><div class=story><div><p>Story number {i} about thing {i}</p></div><p class=end>Thank you for reading</p></div>"
    parsed = [Page(make(i)) for i in range(10)]
    for some in (parsed, parsed[2:4]):
        assert main_text(make(3), decided(template_of(some))) == "Story number 3 about thing 3"
    # the page by itself does not show what is template
    assert main_text(make(3), None) != "Story number 3 about thing 3"
    # nor do copies of it, which are taken by themselves
    assert main_text(make(3), decided(template_of([parsed[3]] * 5))) == main_text(make(3), None)


def template_of(parsed):
    template = None
    for p in parsed:
        one = tree(p.labels, p.parents, 1, [int(h != 0) for h in p.hashes()], p.lengths, p.linked, p.hashes(), p.fingerprints())
        template = merged(template, one) if template else one
    return template


def texts_by_host(make, n=6):
    parsed = [Page(make(i)) for i in range(n)]
    return {main_text(make(i), decided(template_of(parsed))).replace(str(i), "#") for i in range(n)}, main_text(make(0), None).replace("0", "#")


LONG = "Story {0} tells of thing {0} and of much else, at some length, for several lines of prose."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<header><p>Site name and slogan</p></header><div class=post><h1>T{0}</h1><p>LONG</p></div>", "T#\nLONG"),
        ("<header><p>Hot now: {0}</p></header><p>LONG</p>", "LONG"),
        ("<article><header><h1>T{0}</h1></header><p>LONG</p></article>", "T#\nLONG"),
        ('<div class="entry social-science"><p>LONG</p></div>', "LONG"),
        ('<div class="share"><p>LONG</p></div><div class=ad>Buy {0}</div>', "LONG"),
        ('<body class="no-sidebar has-comments"><div class="content with-sidebar"><p>LONG</p></div><div class="sidebar"><p>Side {0}</p></div>', "LONG"),
        ('<article class="post has-comments"><p>LONG</p><div id="reader-comments"><p>I think {0}</p></div></article>', "LONG"),
        ("<article><p>LONG</p><math><mi>x</mi>=<mn>{0}</mn></math><svg><text>label</text></svg><noscript>more {0}</noscript></article>", "LONG\nx=#labelmore #"),
        ("<form id=aspnet><div class=c><p>LONG</p></div><input name=q></form>", "LONG"),
        ("<div class=c><p>LONG</p></div><div id=comments><p>" + "One says {0}. " * 40 + "</p></div>", "LONG"),
        ("<nav><a href=/>Home {0}</a></nav><footer>End {0}</footer>", ""),
    ],
)
def test_names_beside_induction(page, want):
    by_host, single = texts_by_host(lambda i: page.replace("LONG", LONG).replace("{0}", str(i)))
    want = want.replace("LONG", LONG.replace("{0}", "#"))
    assert by_host == {want}
    assert single == want or "slogan" in single or "labelmore" in want


def test_simple_tree_matching_keeps_order():
    node = lambda label, *children: [label, 1, 0, 0, 0, 0, list(children), 0]
    a, b = node("r", node("x"), node("y", node("z")), node("w")), node("r", node("y", node("z")), node("x"), node("w"))
    assert matching(a, b) == (4, [(1, 0), (2, 2)])
    assert [c[0] for c in merged(a, b)[6]] == ["x", "y", "x", "w"]


def test_deep_and_broken_pages():
    assert main_text(("<div>" * 5000 + "deep" + "</div>" * 5000), None) == "deep"
    assert main_text(("<p>a<p>b</i></p></div><b>c<script>never ends"), None) == "a\nb\nc"
    assert main_text(('<p title="x>y">t &#233; &unknown; &lt;</p><!-- <p>no --> <br>z'), None) == "t é &unknown; <\nz"


MENU, FOOT = "Home News Sport Weather Contact", "Copyright of the publisher, all rights reserved"
LAYOUTS = {
    "divs": "<body><div>{menu}</div><div><h1>{h}</h1>{body}</div><div>{foot}</div></body>",
    "nested divs": "<body><div><div>{menu}</div><div><div><h1>{h}</h1>{body}</div></div></div><div><div>{foot}</div></div></body>",
    "table": "<table><tr><td>{menu}</td></tr><tr><td><h1>{h}</h1>{body}</td></tr><tr><td>{foot}</td></tr></table>",
    "columns": "<table><tr><td>{menu}</td><td><h1>{h}</h1>{body}</td><td>{foot}</td></tr></table>",
    "sections": "<section class=block>{menu}</section><section class=block><h1>{h}</h1>{body}</section><section class=block>{foot}</section>",
    "generated": "<div class=css-{x}a><div class=css-{x}b>{menu}</div><div class=css-{x}c><h1>{h}</h1>{body}</div><div class=css-{x}d>{foot}</div></div>",
    "paragraphs": "<body><p>{menu}</p><h1>{h}</h1>{body}<p>{foot}</p></body>",
}


def laid_out(layout, i, n):
    x = "".join(chr(97 + (i >> k & 15)) for k in (0, 4, 8, 12))
    body = "".join(f"<p>Paragraph {k} of story {i} says this and that at length, as stories do.</p>" for k in range(1 + i % n))
    return LAYOUTS[layout].format(menu=MENU, foot=FOOT, h=f"Story {i}", body=body, x=x), "\n".join([f"Story {i}", *(f"Paragraph {k} of story {i} says this and that at length, as stories do." for k in range(1 + i % n))])


def test_menus_and_footers_among_siblings_with_equal_labels(spark):
    made = {(k, i): laid_out(layout, i, 5) for k, layout in enumerate(LAYOUTS) for i in range(30)}
    rows = [(100 * k + i, f"http://h{k}.example/{i}", html) for (k, i), (html, _) in made.items()]
    want = {100 * k + i: text for (k, i), (_, text) in made.items()}
    assert {r["page_id"]: r["text"] for r in wrapper.extracted(pages(spark, rows)).collect()} == want


def test_any_partitioning_gives_the_same_text(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", laid_out(layout, i, 7)[0]) for i, layout in enumerate([*LAYOUTS] * 20)]
    some = {n: sorted(map(tuple, wrapper.extracted(pages(spark, rows[::d]).repartition(n)).collect())) for n, d in ((1, 1), (7, -1), (16, 1))}
    assert some[1] == some[7] == some[16]


def test_articles_keep_what_they_share(spark):
    """A heading that all articles have among others, and paragraphs that copies of an article in article elements have, are content."""
    rows = [(i, f"http://h.example/{i}", f"<body><div>{MENU}</div><div><h1>Story {i}</h1><h2>About {i}</h2><p>Text of story {i}.</p><h2>Summary</h2><p>End of story {i}.</p></div></body>") for i in range(20)]
    rows += [(100 + i, f"http://k.example/{i}", f"<article><p>The same text.</p><p>Copy {i}</p></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in wrapper.extracted(pages(spark, rows)).collect()}
    assert got == {i: f"Story {i}\nAbout {i}\nText of story {i}.\nSummary\nEnd of story {i}." for i in range(20)} | {100 + i: f"The same text.\nCopy {i}" for i in range(20)}


def test_matching_against_all_order_preserving_ones():
    rng = random.Random(3)

    def some(depth):
        return [rng.choice("xyz"), 1, 0, 0, 0, 0, [some(depth - 1) for _ in range(rng.randrange(4))] if depth else [], 0]

    for _ in range(200):
        a, b = some(2), some(2)
        assert matching(a, b)[0] == brute.tree_matching(a[6], b[6])


def test_many_pages_with_generated_names_take_linear_time():
    def seconds(n):
        start, template = time.time(), None
        facts = frozenset()
        trees = {}
        for i in range(n):
            p = Page(laid_out("generated", i, 9)[0], facts)
            trees[p.signature()] = p
        for k in sorted(trees):
            p = trees[k]
            one = tree(p.labels, p.parents, 1, [int(h != 0) for h in p.hashes()], p.lengths, p.linked, p.hashes(), p.fingerprints())
            template = merged(template, one) if template else one
        assert len(trees) < 5
        return time.time() - start

    assert seconds(4000) < 20
