"""Plain-Python answers to compare the operators with, on small inputs."""

from __future__ import annotations

import re
from collections import defaultdict


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(docs, k, percent):
    """docs: (doc_id, text) with distinct ids. {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingle_set(t, k) for i, t in docs}
    having = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            having[s].append(i)
    shared = defaultdict(int)
    for group in having.values():
        for x, a in enumerate(group):
            for b in group[:x]:
                shared[b, a] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = smallest_reachable(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def contained_items(docs, items, k, percent):
    """{(doc_id, item_id): (n_shared, n_item)}"""
    wanted = {i: s for i, t in items if (s := shingle_set(t, k))}
    having = defaultdict(set)
    for i, s in wanted.items():
        for x in s:
            having[x].add(i)
    out = {}
    for d, text in docs:
        for i in {i for x in shingle_set(text, k) for i in having.get(x, ())}:
            n = len(wanted[i] & shingle_set(text, k))
            if 100 * n >= percent * len(wanted[i]):
                out[d, i] = (n, len(wanted[i]))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private_spans(text):
    """[(start, kind number, end)] of the four fixed kinds."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def sentences(text, longest):
    """[(words, start, end, sentence)]: the pieces of a text's sentences, with the code points from their first word to the next piece's."""
    out, now, of, sentence = [], [], [], 0
    found = list(re.finditer("[^\x20\x09-\x0d]+", text or ""))
    for i, m in enumerate(found):
        now.append(m)
        after = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        ends = m[0][-1] in ".!?" or "\n" in after
        if ends or len(now) == longest:
            out.append(now)
            of.append(sentence)
            now = []
        sentence += ends
    starts = [s[0].start() for s in out] + [len(text or "")]
    return [(words(" ".join(m[0] for m in s)), starts[k], starts[k + 1], of[k]) for k, s in enumerate(out)]


def without_repeats(rows, several, least, longest, passage):
    """rows: (doc_id or None, version, text). [(n_sentences, removed sentences, text that is left, ids that keep the passages)] in their order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    split = [sentences(t, longest) for _, _, t in rows]
    first, gone, keepers = {}, [set() for _ in rows], [set() for _ in rows]
    for i in order:
        sizes = [len(w) for w, _, _, _ in split[i]]

        def long_enough(s, e, i=i, sizes=sizes):
            n = sum(sizes[s:e])
            return n >= least and (n > passage or len({p[3] for p in split[i][s:e]}) >= several)

        runs = set()
        for s in range(len(sizes)):
            e = next((e for e in range(s + 1, len(sizes) + 1) if long_enough(s, e)), None)
            b = next((b for b in range(s, -1, -1) if long_enough(b, s + 1)), None)
            runs |= ({(s, e)} if e is not None else set()) | ({(b, s + 1)} if b is not None else set())
        for s, e in sorted(runs):
            span = tuple(w for part, _, _, _ in split[i][s:e] for w in part)
            place = (rows[i][:2], s)
            if first.setdefault(span, place) != place:
                gone[i].update(range(s, e))
                keepers[i].add(first[span][0][0])
    return [(len(split[i]), gone[i], "".join([t[: split[i][0][1]], *(t[a:b] for k, (_, a, b, _) in enumerate(split[i]) if k not in gone[i])]) if split[i] else t, keepers[i]) for i, (_, _, t) in enumerate(rows)]


def disclosing(texts, support, generalise):
    """{(entity, term)}: what the texts of a corpus give away, from their spans and plain counts."""
    import math

    term = re.compile(r"\w+(?:['\-]\w+)*")
    names = ("email", "ip", "card", "phone")
    n, with_term, with_entity, both = len(texts), defaultdict(int), defaultdict(list), defaultdict(list)
    for text in texts:
        spans = private_spans(text)
        blank = list(text or "")
        for a, _, b in spans:
            blank[a:b] = " " * (b - a)
        for t in {m[0].lower() for m in term.finditer(text or "")}:
            with_term[t] += 1
        inside = {m[0].lower() for m in term.finditer("".join(blank))}
        for e in {f"{names[k]}:{text[a:b].lower()}" for a, k, b in spans}:
            with_entity[e].append(text)
            for t in inside:
                both[e, t].append(text)
    return {
        (e, t) for (e, t), c in both.items()
        if len(set(c)) >= support and n > len(with_entity[e]) and math.log2(len(c) * n / (with_term[t] * len(with_entity[e]))) / math.log2(n / len(with_entity[e])) >= generalise
    }


def tree_matching(x, y):
    """One more than the largest number of nodes in an order-preserving matching of two lists of children with equal labels, over all matchings."""
    def most(x, y):
        if not x or not y:
            return 0
        (a, *rest), best = x, most(x[1:], y)
        for j, b in enumerate(y):
            if a[0] == b[0]:
                best = max(best, tree_matching(a[6], b[6]) + most(rest, y[j + 1 :]))
        return best

    return 1 + most(x, y)
