"""Main text of web pages by wrapper induction over the pages of a host.

First two things are counted over the distinct pages of each host of at least ``FEW`` of them: the pages that have a class
name, id or role, and the pages that have a text in one place (the tags from the root down). Names that fewer than
``SHARED`` of the pages have (generated ones) are no part of labels, unless they are words that say what a block is. A text that
``COMMON`` of the pages have in one place is constant there; headings and what is in main or article are left out of this,
as articles may share them.

Then a page is parsed into a tree of its block elements, labelled with tag, classes, id and role. Each constant text is a node
of its own, so siblings with equal labels (plain divs, table cells) stay apart where one is a menu or a footer; siblings with
equal labels whose texts vary are one repeated node. The trees of a host are aligned by simple tree matching (the largest
order-preserving matching of nodes with equal labels, by dynamic programming over child lists) and merged
into one template that counts pages and text for each node. Nodes whose text is the same on all pages that have them are
template; varying slots are candidates for content. The content root is the innermost block that holds nearly all
of the varying text; a page's main text is what its tree has below the root, less template nodes.

Names (a menu, an advert, comments ...) settle what variation cannot: slots that vary with every page and still are no
part of the article. They are read as whole class names, never on html, body, main, article or what holds one of these,
and do not count where nearly all varying text of the host is below them.

Every task adds up its pages with the same tree first. Trees are dealt to 64 parts of their host by their hash and merged in
order, one after the other, then the parts are: a host with a third of all pages holds two templates in memory at a
time, and the result does not depend on how pages are spread over tasks.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copysift.llm.frames import cut, within_bytes

BLOCKS = frozenset("html head body title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main nav header footer aside form fieldset blockquote pre figure figcaption address details summary select option button dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template iframe".split())
#: A start tag closes these open elements, up to one of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address title".split())
#: Elements that are no part of an article wherever they are, and those that may as well wrap a whole page.
NEVER = frozenset("head title nav footer aside select option button dialog menu".split())
WRAPS = frozenset("form fieldset".split())
#: Elements that hold content whatever they are called.
CONTENT = frozenset("html body main article".split())
#: Words of class names, ids and roles for what is no part of an article, and words that may stand beside them in one name.
BOILER_WORDS = frozenset("ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promotion related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tagcloud tags toolbar topbar widget widgets".split())
BESIDE = frozenset("article area bar block bottom box buttons container content entry form global group inline inner item items left link links list lower main outer page panel post posts primary reader right secondary section site slot text title top unit upper user wrap wrapper".split())
HEADER = frozenset("header site page top global main wrapper wrap container".split())
#: A name does not count if the varying text outside is less than this share of that below it.
LEFT = 0.1
#: Distinct pages from which a host's names and texts are counted; the shares of them from which a name is part of labels and a text is constant.
FEW, SHARED, COMMON = 4, 0.05, 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts that the trees of a host are merged in.
PARTS = 64
#: Elements nested deeper are folded into the node at this depth; their text stays.
DEPTH = 120

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<(?=/?[a-zA-Z])[^<]*+\Z", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


def names_of(attributes: str) -> set[str]:
    """Classes, id and role of a start tag, without digits."""
    if "=" not in attributes:
        return set()
    return {v for m in _NAMED.finditer(attributes) for v in re.sub(r"\d+", "", (m[2] or m[3] or m[4] or "").lower()).split()}


def name_item(name: str) -> int:
    """The even number that a name is counted by; 0 for names that are part of labels however few pages have them."""
    parts = set(_PART.findall(name))
    if parts and (parts <= BOILER_WORDS | BESIDE | HEADER):
        return 0
    return _hash(name) & ~1


def label_of(tag: str, attributes: str, facts: frozenset[int] | None = None) -> str:
    """The tag with its names; with ``facts`` only those among them."""
    found = names_of(attributes)
    if facts is not None:
        found = {v for v in found if (item := name_item(v)) == 0 or item in facts}
    return ".".join([tag, *sorted(found)])


def named(label: str) -> bool:
    """Whether a whole class name, id or role says that this is no part of an article."""
    tag, *names = label.split(".")
    if tag in CONTENT:
        return False
    for name in names:
        parts = set(_PART.findall(name))
        if not parts.isdisjoint(BOILER_WORDS) and parts <= BOILER_WORDS | BESIDE:
            return True
    return False


def is_header(label: str) -> bool:
    tag, *names = label.split(".")
    return tag == "header" or tag not in CONTENT and any("header" in (parts := set(_PART.findall(n))) and parts <= HEADER for n in names)


def tag_of(label: str) -> str:
    return label.partition(".")[0]


def _hash(text: str) -> int:
    """A hash of 63 bits, never 0."""
    return (int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()) >> 1) | 1


class Page:
    """A page's collapsed tree: labels and parents of nodes in order of appearance, and the text blocks with their nodes.

    ``facts`` are the numbers of the host's shared names and constant texts; without them all names count and no text is
    constant. ``items`` are the page's own numbers: even ones of names, odd ones of texts in their places.
    """

    def __init__(self, html: str | None, facts: frozenset[int] | None = None) -> None:
        self.facts, self.items, self._labels = facts, set(), {}
        self.places, self.holds = [_hash("")], [False]
        self.labels, self.parents, self.blocks = ["#page"], [-1], []
        self.lengths, self.linked, self.depths = [0], [0], [0]
        self._at: dict[tuple[int, str], int] = {}
        self._parse(html or "")

    def _node(self, parent: int, label: str) -> int:
        tag = tag_of(label)
        if self.depths[parent] >= DEPTH and tag[0] != "=" and tag not in NEVER and not named(label):
            return parent
        k = self._at.get((parent, label))
        if k is None:
            k = self._at[parent, label] = len(self.labels)
            self.labels.append(label)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.lengths.append(0)
            self.linked.append(0)
            self.places.append(_hash(f"{self.places[parent]} {tag}"))
            self.holds.append(self.holds[parent] or tag in ("main", "article"))
        return k

    def _slot(self, node: int, block: str) -> int:
        """The node of a text: one of its own if it is constant."""
        if self.holds[node] or tag_of(self.labels[node]) in HEADINGS:
            return node
        item = _hash(f"{self.places[node]} {block}")
        self.items.add(item)
        return self._node(node, f"={item:x}") if self.facts and item in self.facts else node

    def _label(self, tag: str, attributes: str) -> str:
        known = self._labels.get((tag, attributes))
        if known is None:
            if self.facts is None:
                self.items.update(map(name_item, names_of(attributes)))
            known = self._labels[tag, attributes] = label_of(tag, attributes, self.facts)
        return known

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements and their nodes (an inline element's is its block's)
        text: list[str] = []
        node, links, in_links, at = 0, 0, 0, 0

        def flush() -> None:
            nonlocal in_links
            if text:
                block = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if block:
                    slot = self._slot(node, block)
                    self.blocks.append((slot, block))
                    self.lengths[slot] += len(block)
                    self.linked[slot] += min(in_links, len(block))
                in_links = 0

        def close(k: int) -> None:
            nonlocal node, links
            if any(t in BLOCKS for t, _ in stack[k:]):
                flush()
            links = max(0, links - sum(t == "a" for t, _ in stack[k:]))
            del stack[k:]
            node = stack[-1][1] if stack else 0

        end = len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            piece = html[at : m.start()] if m else html[at:]
            if piece:
                text.append(piece)
                if links:
                    in_links += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, shut, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("table", "article", "body", "nav", "footer") and tag not in BLOCKS:
                        break
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = over.end() if over else end
                text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in BLOCKS:
                flush()
                shuts, until = CLOSES.get(tag, ((), ()))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shuts or stack[k][0] == "p":
                        close(k)
                    elif stack[k][0] in until or not shuts and stack[k][0] in BLOCKS:
                        break
                node = self._node(node, self._label(tag, attributes))
            elif tag == "a":
                links += 1
            stack.append((tag, node))
        flush()

    def signature(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels, strict=True))

    def hashes(self) -> list[int]:
        """Of the text of each node; 0 where there is none."""
        own: dict[int, list[str]] = {}
        for k, block in self.blocks:
            own.setdefault(k, []).append(block)
        return [_hash("\n".join(own[k])) if k in own else 0 for k in range(len(self.labels))]

    def fingerprints(self) -> list[int]:
        """The hash of the page's whole text, for each node that has text; copies of a page say nothing about what is template."""
        whole = _hash("\n".join(block for _, block in self.blocks))
        return [whole if n else 0 for n in self.lengths]


# A template node: [label, pages, pages with text, code points, of those in links, hash of the text or -1 if it varies, children,
# hash of the page or -1 if pages that differ have this text]
def tree(labels: list[str], parents: list[int], pages: int, filled: list[int], lengths: list[int], linked: list[int], hashes: list[int], whole: list[int]) -> list:
    nodes = [[x, pages, f, n, a, h, [], w] for x, f, n, a, h, w in zip(labels, filled, lengths, linked, hashes, whole, strict=True)]
    for k, p in enumerate(parents):
        if p >= 0:
            nodes[p][6].append(nodes[k])
    return nodes[0]


def _same(a: int, b: int) -> int:
    """The hash that two share, -1 if they differ; 0 stands for none."""
    return a if a == b else (a or b) if not (a and b) else -1


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with equal labels: the number of matched nodes, and the matched children."""
    x, y = a[6], b[6]
    if not x or not y:
        return 1, []
    w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    gain = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best = max(w[i][j + 1], w[i + 1][j])
            if p[0] == q[0]:
                gain[i, j] = matching(p, q)[0]
                best = max(best, w[i][j] + gain[i, j])
            w[i + 1][j + 1] = best
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if (i - 1, j - 1) in gain and w[i][j] == w[i - 1][j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif w[i][j] == w[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + w[-1][-1], pairs[::-1]


def merged(a: list, b: list) -> list:
    """The template of two templates with equal root labels; nodes of only one are kept in place."""
    children, i, j = [], 0, 0
    for p, q in [*matching(a, b)[1], (len(a[6]), len(b[6]))]:
        children += a[6][i:p] + b[6][j:q]
        if p < len(a[6]) and q < len(b[6]):
            children.append(merged(a[6][p], b[6][q]))
        i, j = p + 1, q + 1
    return [a[0], *(a[k] + b[k] for k in range(1, 5)), _same(a[5], b[5]), children, _same(a[7], b[7])]


KEEP, OWN, ALL = 0, 1, 2


def decided(template: list) -> list:
    """[label, is content root, what is no content (KEEP nothing of it, its OWN text, or ALL below it), children] of each node of a host's merged template."""
    pages = template[1]

    def constant(node: list) -> bool:
        return node[0][0] == "=" or node[5] > 0 and node[7] < 0 and 2 * node[2] >= pages

    def own(node: list) -> int:
        return 0 if constant(node) or 2 * node[4] > node[3] else node[3]

    def holds_content(node: list) -> bool:
        return any(tag_of(c[0]) in CONTENT or holds_content(c) for c in node[6])

    # top-most nodes that are named as something else, with the varying text outside all of them
    aside: dict[int, list] = {}

    def outside(node: list, in_content: bool = False) -> int:
        """Varying text of a node that lies outside named nodes, which are put aside."""
        tag = tag_of(node[0])
        in_content = in_content or tag in ("main", "article")
        if tag in NEVER or (tag in WRAPS or named(node[0])) and not holds_content(node) or is_header(node[0]) and not in_content and not holds_content(node):
            aside[id(node)] = node
            return 0
        return own(node) + sum(outside(c, in_content) for c in node[6])

    def all_below(node: list) -> int:
        return own(node) + sum(all_below(c) for c in node[6] if tag_of(c[0]) not in NEVER)

    left = outside(template)
    while True:
        large = [n for n in aside.values() if tag_of(n[0]) not in NEVER and left < LEFT * all_below(n)]
        if not large:
            break
        node = max(large, key=all_below)
        del aside[id(node)]
        left += own(node) + sum(outside(c) for c in node[6])

    def worth(node: list) -> int:
        return 0 if id(node) in aside else own(node) + sum(worth(c) for c in node[6])

    root = template
    while True:
        total = worth(root)
        inner = [c for c in root[6] if tag_of(c[0]) not in PROSE and worth(c) >= 0.9 * total > 0]
        if tag_of(root[0]) == "article" or any(re.match(r"h[1-3](\.|$)", c[0]) for c in root[6]) or not inner:
            break
        root = inner[0]

    def flat(node: list, in_root: bool = False) -> list:
        gone = id(node) in aside and not (is_header(node[0]) and in_root)  # a header inside the article is the article's own
        in_root = in_root or node is root and tag_of(node[0]) not in ("#page", "html", "body")
        return [node[0], int(node is root), ALL if gone else OWN if constant(node) else KEEP, [flat(c, in_root) for c in node[6]]]

    return flat(template)


def alone(page: Page) -> list:
    """The wrapper of a page that is compared with no other."""
    return decided(tree(page.labels, page.parents, 1, [int(n > 0) for n in page.lengths], page.lengths, page.linked, page.hashes(), page.fingerprints()))


def content_nodes(page: Page, wrapper: list) -> list[bool]:
    """Which nodes of a page's tree are content, by alignment with the host's wrapper. A part that the wrapper lacks goes with what it is in."""
    children: list[list] = [[] for _ in page.labels]
    for k, p in enumerate(page.parents):
        if p >= 0:
            children[p].append(k)
    keep = [False] * len(page.labels)

    def shape(k: int) -> list:
        return [page.labels[k], 0, 0, 0, 0, 0, [shape(c) for c in children[k]]]

    def walk(k: int, node: list | None, mine: list, inside: bool) -> None:
        if node[2] == ALL if node else tag_of(page.labels[k]) in NEVER or named(page.labels[k]) or page.labels[k][0] == "=":
            return
        inside = inside or bool(node and node[1])
        keep[k] = inside and not (node and node[2] == OWN)
        pairs = dict(matching(mine, [node[0], 0, 0, 0, 0, 0, _shaped(node)])[1]) if node else {}
        for i, c in enumerate(children[k]):
            walk(c, node[3][pairs[i]] if i in pairs else None, mine[6][i], inside)

    walk(0, wrapper, shape(0), False)
    return keep


def _shaped(node: list) -> list:
    return [[c[0], 0, 0, 0, 0, 0, _shaped(c)] for c in node[3]]


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, item, page): what a page is counted for, with the hash of its whole text; item 0 for each page."""
    for batch in batches:
        hosts, items, pages = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            found = sorted(page.items | {0})
            hosts += [host] * len(found)
            items += found
            pages += [_hash("\n".join(block for _, block in page.blocks))] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(items, pa.int64()), pa.array(pages, pa.int64())], names=["host", "item", "page"])


def facts_of(pages: DataFrame) -> DataFrame:
    """(host, facts): the numbers of shared names and constant texts of each host of at least FEW distinct pages; pages: host, html.

    Their number is bounded by what a page has, as each is on a fixed share of the pages.
    """
    counts = cut(pages.select("host", "html").mapInArrow(_items, "host string, item long, page long").distinct().groupBy("host", "item").count().where("item = 0 or count > 1"))
    totals = counts.where(f"item = 0 and count >= {FEW}").select("host", F.col("count").alias("pages"))
    common = F.when(F.col("item") == 0, True).when(F.col("item") % 2 == 0, F.col("count") >= SHARED * F.col("pages")).otherwise((F.col("count") >= FEW) & (F.col("count") >= COMMON * F.col("pages")))
    return counts.join(within_bytes(totals, F.octet_length("host") + 24), "host").where(common).groupBy("host").agg(F.array_sort(F.collect_list("item")).alias("facts"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, signature, sums): the pages of a task with the same tree, added up."""
    seen: dict[tuple[str, str], list] = {}
    known: dict[str, frozenset[int] | None] = {}

    def rows() -> pa.RecordBatch:
        hosts, signatures = [h for h, _ in seen], [s for _, s in seen]
        out = [pa.array(hosts, pa.string()), pa.array([_hash(s) // 2 % PARTS for s in signatures], pa.int32()), pa.array(signatures, pa.string()), pa.array(map(json.dumps, seen.values()), pa.string())]
        return pa.RecordBatch.from_arrays(out, names=["host", "part", "signature", "sums"])

    for batch in batches:
        for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            page = Page(html, _known(known, host, batch.column("facts")[k]))
            key, one = (host, page.signature()), [1, [int(n > 0) for n in page.lengths], page.lengths, page.linked, page.hashes(), page.fingerprints()]
            seen[key] = _added(seen[key], one) if key in seen else one
        if len(seen) > 2000:
            yield rows()
            seen.clear()
    yield rows()


def _known(known: dict[str, frozenset[int] | None], host: str, facts: pa.Scalar) -> frozenset[int] | None:
    """The facts of a host, made a set once in a task."""
    if host not in known:
        if len(known) > 5000:
            known.clear()
        known[host] = frozenset(facts.as_py()) if facts.is_valid else None
    return known[host]


def _added(a: list, b: list) -> list:
    """The sums of pages with the same tree."""
    sums = ([p + q for p, q in zip(x, y, strict=True)] for x, y in zip(a[1:4], b[1:4], strict=True))
    return [a[0] + b[0], *sums, *([*map(_same, x, y)] for x, y in zip(a[4:], b[4:], strict=True))]


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _merged_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, template) of rows in order of host, part and signature."""
    for (host, part), rows in groupby(_rows(batches, "host", "part", "signature", "sums"), lambda r: r[:2]):
        template = None
        for signature, same in groupby(rows, lambda r: r[2]):
            nodes = [x.split(" ", 1) for x in signature.split("\n")]
            one = tree([x for _, x in nodes], [int(p) for p, _ in nodes], *reduce(_added, (json.loads(r[3]) for r in same)))
            template = merged(template, one) if template else one
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([part], pa.int32()), pa.array([json.dumps(template)])], names=["host", "part", "template"])


def _merged_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper) of rows in order of host and part."""
    for host, rows in groupby(_rows(batches, "host", "template"), lambda r: r[0]):
        template = reduce(merged, (json.loads(t) for _, t in rows))
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(decided(template))])], names=["host", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): what is content on the pages of each host, as JSON; pages: host, html, facts."""
    trees = pages.select("host", "html", "facts").mapInArrow(_trees, "host string, part int, signature string, sums string")
    parts = trees.repartition("host", "part").sortWithinPartitions("host", "part", "signature").mapInArrow(_merged_trees, "host string, part int, template string")
    return parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(_merged_parts, "host string, wrapper string")


def main_text(html: str | None, wrapper: list | None, facts: frozenset[int] | None = None, known: dict | None = None) -> str:
    """The page's content blocks; ``known`` keeps what was decided for trees that were seen before. A page of which the wrapper leaves nothing is taken by itself."""
    known = {} if known is None else known
    page = Page(html, facts)
    key = page.signature()
    if wrapper and key not in known:
        known[key] = content_nodes(page, wrapper)
    keep = known.get(key)
    if not keep or not any(keep[k] for k, _ in page.blocks):
        page = Page(html)
        keep = content_nodes(page, alone(page))
    return "\n".join(block for k, block in page.blocks if keep[k])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, any other columns), whole pages.

    Blocks in page order, one on a line; character references decoded, runs of white space in a block one space.
    A null or empty page, or one without text, gives an empty text. Pages whose url is null or has no host
    are one host. Copies of a page count once for names and constant texts. A host with fewer than FEW distinct pages has
    none of these: there, siblings with equal labels are one node, and a menu or footer among them stays. A host with a single page, or
    with copies of one only, has no constant nodes that would tell; its pages are taken by themselves. A paragraph outside of
    main and article that COMMON of a host's pages have in one place goes, be it part of their articles or not.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    facts = cut(facts_of(rows))
    rows = rows.join(within_bytes(facts, 8 * F.size("facts") + F.octet_length("host") + 32), "host", "left")
    found = cut(wrappers(rows))
    rows = rows.join(within_bytes(found, F.octet_length("wrapper") + F.octet_length("host") + 32), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list | None, dict]] = {}
        sets: dict[str, frozenset[int] | None] = {}
        for batch in batches:
            texts = []
            for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                facts = _known(sets, host, batch.column("facts")[k])
                if host not in known or len(known[host][1]) > 5000:
                    if len(known) > 5000:
                        known.clear()
                    wrapper = batch.column("wrapper")[k].as_py()
                    known[host] = (json.loads(wrapper) if wrapper else None, {})
                wrapper, decisions = known[host]
                texts.append(main_text(html, wrapper, facts, decisions))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"
    return rows.select("page_id", "url", "host", "html", "facts", "wrapper").mapInArrow(run, kind)
