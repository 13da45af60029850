"""The registered queries of this folder, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copysift.llm import decontam, filter_audit, minhash_dedup, mixing, pii, pseudo_lm, quality, sharding, span_dedup, spelling, vector_dedup, warc, wrapper
from copysift.llm.frames import new_folder, remove_folder, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its rows are checkpointed and no gap was found when the archives are deleted; call warc.archived() to keep them."""
    folder = new_folder(spark, "archives")
    rows = warc.archived(table(spark, sf_dir, "pages"), folder)
    remove_folder(spark, folder)
    return rows


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = span_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("first_docs", F.array_join(F.transform("first_docs", lambda d: d.cast("string")), ","))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(table(spark, sf_dir, "pages"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihoods(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_spans(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f) and "_" in name and name[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of {links} (a, b): the smallest node that each of {nodes} (id) reaches.
_REACHED = """
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.id WHERE reach.root < sides.b),
found AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""


#: The four fixed kinds of personal data and a term, as DuckDB's patterns.
_KINDS = {"email": r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'", "ip": r"'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'", "card": r"'[0-9](?:[\x20-]?[0-9])+'", "phone": r"'\+[0-9][\x20().0-9-]+[0-9]'"}
_TERM = r"'[\p{L}\p{N}_]+(?:[''\-][\p{L}\p{N}_]+)*'"


def _matches(table: str, pattern: str, more: str = "") -> str:
    """doc_id, the number of each match, the match, and the gap before it."""
    return f"SELECT doc_id, {more} generate_subscripts(ms, 1) AS i, unnest(ms) AS match, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS gaps FROM {table})"


_PII = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
p AS (SELECT doc_id, k, kind, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(match) AS start, match, regexp_replace(match, '[^0-9]', '', 'g') AS digits FROM m),
base AS (SELECT doc_id, k, kind, start, start + length(match) AS til, kind || ':' || lower(match) AS entity FROM p WHERE k = 0
    OR k = 1 AND len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(ltrim(x, '0'), 3) AS INT), 0) > 255)) = 0
    OR k = 2 AND length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: (CASE WHEN j % 2 = 0 THEN (ascii(digits[-j]) - 48) * 2 - CASE WHEN digits[-j] >= '5' THEN 9 ELSE 0 END ELSE ascii(digits[-j]) - 48 END))) % 10 = 0
    OR k = 3 AND length(digits) BETWEEN 10 AND 15),
cut AS (SELECT doc_id, max(til) OVER (PARTITION BY doc_id ORDER BY start, til ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, start, til FROM base),
w AS (SELECT doc_id, i, match, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) - length(match) AS start FROM ({words})),
df AS (SELECT lower(match) AS term, count(DISTINCT doc_id) AS df_term FROM w GROUP BY 1),
blanked AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS t FROM (
    SELECT doc_id, start AS pos, repeat(' ', (til - greatest(start, coalesce(before, 0)))::BIGINT) AS piece FROM cut WHERE til > coalesce(before, 0)
    UNION ALL SELECT c.doc_id, coalesce(before, 0), substr(t, coalesce(before, 0)::BIGINT + 1, (start - coalesce(before, 0))::BIGINT) FROM cut c JOIN t USING (doc_id) WHERE start > coalesce(before, 0)
    UNION ALL SELECT doc_id, last, substr(t, last::BIGINT + 1) FROM (SELECT doc_id, max(til) AS last FROM base GROUP BY doc_id) JOIN t USING (doc_id)) GROUP BY doc_id),
bw AS (SELECT doc_id, lower(match) AS term, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) - length(match) AS start, length(match) AS size FROM ({blank_words})),
told AS (SELECT DISTINCT doc_id, t AS text, entity FROM base JOIN t USING (doc_id)),
entities AS (SELECT entity, count(*) AS df_entity FROM told GROUP BY 1 HAVING count(DISTINCT text) >= 2),
pairs AS (SELECT entity, df_entity, term, count(*) AS together FROM told JOIN entities USING (entity) JOIN (SELECT DISTINCT doc_id, term FROM bw) USING (doc_id) GROUP BY ALL HAVING count(DISTINCT text) >= 2),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
disclosing AS (SELECT entity, term FROM pairs JOIN df USING (term), n WHERE n > df_entity AND log2(together * n / (df_term * df_entity)) / log2(n / df_entity) >= 0.8),
added AS (SELECT DISTINCT doc_id, 4 AS k, 'term' AS kind, start, start + size AS til FROM bw JOIN told USING (doc_id) JOIN disclosing USING (entity, term)),
spans AS (SELECT doc_id, k, kind || ':' || start::BIGINT || ':' || til::BIGINT AS s, start FROM (SELECT doc_id, k, kind, start, til FROM base UNION ALL SELECT * FROM added))
SELECT t.doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    sha256(coalesce(string_agg(s, ',' ORDER BY start, k) FILTER (k < 4), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, k), '') AS spans, count(s) AS n_spans
FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id"""
_PII = _PII.replace("{matches}", " UNION ALL ".join(_matches("t", p, f"{k} AS k, '{kind}' AS kind,") for k, (kind, p) in enumerate(_KINDS.items()))).replace("{words}", _matches("t", _TERM)).replace("{blank_words}", _matches("blanked", _TERM))


def _level(n: int) -> str:
    """One level of the splitting tree: the draws of each node in order, which of them go to its first child, and the quotas of both."""
    return f"""
e{n} AS (SELECT node, key, j, row_number() OVER (PARTITION BY node ORDER BY key, j) - 1 AS g, count(*) OVER (PARTITION BY node) AS total,
    ('0x' || substr(md5('11|' || node || '|' || key || '|' || j), 1, 13))::BIGINT / pow(16, 13) AS u FROM (SELECT node, key, unnest(range(1, draws + 1)) AS j FROM n{n})),
r{n} AS (SELECT node, list(key ORDER BY g) AS keys, list_reduce(list({{'u': u, 'g': g, 'n': total}} ORDER BY g), lambda a, x: {{'taken': a.taken + (CASE WHEN x.u < (x.n // 2 - a.taken) / (x.n - x.g) THEN 1 ELSE 0 END),
    'hits': list_append(a.hits, CASE WHEN x.u < (x.n // 2 - a.taken) / (x.n - x.g) THEN 1 ELSE 0 END)}}, {{'taken': 0, 'hits': []::INT[]}}).hits AS hits FROM e{n} GROUP BY node),
h{n} AS (SELECT node, key, sum(hit) AS n FROM (SELECT node, unnest(keys) AS key, unnest(hits) AS hit FROM r{n}) GROUP BY ALL),
n{n + 1} AS (SELECT 2 * node AS node, key, n::BIGINT AS draws FROM h{n} UNION ALL SELECT 2 * node + 1, key, (draws - n)::BIGINT FROM h{n} JOIN n{n} USING (node, key))"""


_MIX = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('11|bucket|' || doc_id), 1, 3))::INT AS bucket FROM documents),
s AS (SELECT source, key, sum(size) AS source_size FROM d GROUP BY ALL),
weighed AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
risen AS (SELECT *, row_number() OVER w AS rank, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM weighed
    WINDOW w AS (ORDER BY most / weight, source NULLS LAST), before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT key, source_size::BIGINT AS source_size, coalesce(least(most, (SELECT arg_min(level, rank) FROM risen WHERE level * weight <= most) * weight), most) AS target,
    least(4096, greatest(64, pow(2, ceil(log2(greatest(source_size / 2e6, 1))))))::INT AS blocks FROM risen),
b AS (SELECT key, bucket % blocks AS block, source_size, target, sum(size)::BIGINT AS block_size, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM d JOIN goals USING (key) GROUP BY ALL),
p AS (SELECT *, round(target)::BIGINT - whole * source_size AS rest, unnest(range(0, whole + 1)) AS pass FROM b),
q AS (SELECT *, row_number() OVER w AS rank, sum(block_size) OVER w - block_size AS before FROM p WINDOW w AS (PARTITION BY key, pass ORDER BY md5('11|' || key || '|' || pass || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
draws AS (SELECT *, CASE WHEN pass < whole THEN block_size ELSE greatest(0, least(block_size, rest - before)) END AS words FROM q),
drawn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pass, rank) - 1 AS place FROM draws WHERE words > 0),
n0 AS (SELECT 0 AS node, key, count(*) AS draws FROM drawn GROUP BY key),{levels},
runs AS (SELECT node AS shard, key, sum(draws) OVER w - draws AS low, sum(draws) OVER w AS high FROM n3 WINDOW w AS (PARTITION BY key ORDER BY node)),
shards_of AS (SELECT key, block, list(shard ORDER BY pass) AS shards FROM drawn JOIN runs USING (key) WHERE place >= low AND place < high GROUP BY ALL),
told AS (SELECT key, block, source_size, target, count(*) FILTER (words > 0 AND words = block_size) AS passes, coalesce(max(words) FILTER (words > 0 AND words < block_size), 0) AS edge FROM draws GROUP BY ALL),
taken AS (SELECT doc_id, size, t.source_size, t.target, passes, coalesce(shards, []) AS shards,
    CASE WHEN edge > 0 THEN greatest(0, least(size, edge - coalesce(sum(size) OVER (PARTITION BY d.key, t.block ORDER BY md5('11|row|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS part
    FROM d JOIN goals g USING (key) JOIN told t ON t.key = d.key AND t.block = d.bucket % g.blocks LEFT JOIN shards_of o ON o.key = t.key AND o.block = t.block)
SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken, array_to_string(shards[1:CASE WHEN size > 0 THEN passes + (part > 0)::INT ELSE 0 END], ',') AS shards FROM taken""".replace("{levels}", ",".join(map(_level, range(3))))


_SPANS = r"""
WITH found AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split_regex(text, '[^\x20\x09-\x0D]+') AS gaps FROM documents),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, unnest(gaps[1:len(ws)]) AS gap, unnest(gaps[2:len(ws) + 1]) AS after, len(ws) AS n FROM found WHERE len(ws) > 0),
placed AS (SELECT *, sum(length(gap) + length(word)) OVER w - length(word) AS start, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
    FROM (SELECT *, right(word, 1) IN ('.', '!', '?') OR contains(after, chr(10)) OR i = n AS ends FROM words) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pieces AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1) // 30 AS piece FROM placed),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS s, min(i) - 1 AS c, min(start) AS start, run FROM pieces GROUP BY doc_id, run, piece),
bounds AS (SELECT doc_id, s AS k, c, run, lag(run) OVER (PARTITION BY doc_id ORDER BY s) AS ended FROM sentences UNION ALL SELECT doc_id, max(s) + 1, (SELECT max(n) FROM words w WHERE w.doc_id = o.doc_id), NULL, max(run) FROM sentences o GROUP BY doc_id),
runs AS (SELECT a.doc_id, a.k AS b, min(z.k) AS e FROM bounds a JOIN bounds z ON z.doc_id = a.doc_id AND z.k BETWEEN a.k + 2 AND a.k + 15 AND z.c >= a.c + 15 AND (z.ended > a.run OR z.c > a.c + 50) GROUP BY ALL
    UNION SELECT z.doc_id, max(a.k), z.k FROM bounds z JOIN bounds a ON a.doc_id = z.doc_id AND a.k BETWEEN z.k - 15 AND z.k - 2 AND z.c >= a.c + 15 AND (z.ended > a.run OR z.c > a.c + 50) GROUP BY z.doc_id, z.k),
lowered AS (SELECT doc_id, list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM found),
spans AS (SELECT r.doc_id, r.b, r.e, md5(array_to_string(ws[a.c + 1:z.c], ' ')) AS span FROM runs r JOIN bounds a ON a.doc_id = r.doc_id AND a.k = r.b JOIN bounds z ON z.doc_id = r.doc_id AND z.k = r.e JOIN lowered l ON l.doc_id = r.doc_id),
later AS (SELECT * FROM (SELECT *, first_value(doc_id) OVER w AS first_doc, row_number() OVER w AS nth FROM spans WINDOW w AS (PARTITION BY span ORDER BY doc_id, b)) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e)) AS s FROM later),
marked AS (SELECT s.doc_id, s.s, s.start, g.s IS NOT NULL AS gone, coalesce(lead(s.start) OVER w, length(text)) AS stop, s.s - sum((g.s IS NOT NULL)::INT) OVER w AS island, text FROM sentences s JOIN found USING (doc_id) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.s = s.s WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.s)),
islands AS (SELECT doc_id, min(start) AS a, max(stop) AS z FROM marked WHERE gone GROUP BY doc_id, island),
texts AS (SELECT doc_id, any_value(substr(text, 1, first::BIGINT)) || coalesce(string_agg(substr(text, start::BIGINT + 1, (stop - start)::BIGINT), '' ORDER BY s) FILTER (NOT gone), '') AS text, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed
    FROM (SELECT *, min(start) OVER (PARTITION BY doc_id) AS first FROM marked) GROUP BY doc_id),
told AS (SELECT doc_id, string_agg(first_doc, ',' ORDER BY first_doc) AS first_docs FROM (SELECT DISTINCT doc_id, first_doc FROM later) GROUP BY doc_id),
removed AS (SELECT doc_id, string_agg(a::BIGINT || '-' || z::BIGINT, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id)
SELECT f.doc_id, coalesce(t.text, f.text) AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, first_docs
FROM found f LEFT JOIN texts t USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN removed USING (doc_id)"""


_AUDIT = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
masks AS (SELECT part, quality, toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM t LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad FROM masks GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders(prefix, bit, before, applied) AS (SELECT '', 0, 0, 0 UNION ALL SELECT prefix || letter, l.bit, applied, applied | l.bit FROM orders JOIN letters l ON applied & l.bit = 0),
steps AS (SELECT part, prefix, coalesce(sum(n) FILTER (mask & applied = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
    FROM cells CROSS JOIN orders WHERE prefix <> '' GROUP BY ALL),
placed AS (SELECT part, o.prefix AS filter_order, length(s.prefix)::INT AS step, right(s.prefix, 1) AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM steps s JOIN orders o ON length(o.prefix) = 5 AND starts_with(o.prefix, s.prefix))
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM placed"""


#: CRC-32 by a table that follows from its polynomial: {crc_table}, and of a text {crc}.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crcs FROM (SELECT unnest(range(256)) AS n))"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
#: Words that differ by one replaced code point are equal but for one place; of two that differ by a deleted one, the shorter is the longer without it.
_SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
hashed AS (SELECT run, {_CRC.replace("{text}", "doc_id || ':' || run")} AS h FROM runs, crc_table),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM places),
masks AS (SELECT word, n, i, substr(word, 1, i - 1) || '|' || substr(word, i + 1) AS mask FROM places),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
    UNION ALL SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.short = w.word UNION ALL SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.short = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT word, min(other) AS form, any_value(near.m) AS form_n FROM near JOIN best USING (word, m) WHERE near.m >= 10 * near.n GROUP BY word),
ways(word, last) AS (SELECT word, word FROM words UNION ALL SELECT ways.word, form FROM ways JOIN forms ON last = forms.word),
roots AS (SELECT word, last AS root FROM ways WHERE last NOT IN (SELECT word FROM forms))
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN forms USING (word) JOIN roots USING (word) LEFT JOIN best USING (word)"""


def _before(block: str) -> str:
    """How many of n rows are before a block, of 8 shards of 4 blocks."""
    size = f"(n // 8 + ({block} // 4 < n % 8)::INT)"
    return f"({block} // 4 * (n // 8) + least({block} // 4, n % 8) + {block} % 4 * ({size} // 4) + least({block} % 4, {size} % 4))"


#: How many of the part p go left, given the rows and the places on the left that are still to deal (s): {a, b} is where values can be, cum their cumulative weights.
_DRAW = """list_transform([{'n': p.n::DOUBLE, 'm': s.marked::DOUBLE, 't': s.total::DOUBLE, 'low': greatest(0, p.n + s.marked - s.total), 'high': least(p.n, s.marked)}], lambda q:
    list_transform([{'mode': least(q.high, greatest(q.low, floor((q.n + 1) * (q.m + 1) / (q.t + 2))::BIGINT)), 'reach': ceil(9 * sqrt(q.n * (q.m / greatest(q.t, 1.0)) * ((q.t - q.m) / greatest(q.t, 1.0)) * ((q.t - q.n) / greatest(q.t - 1, 1.0))))::BIGINT + 16}], lambda r:
    list_transform([{'a': greatest(q.low, r.mode - r.reach), 'cum': list_reduce(range(greatest(q.low, r.mode - r.reach), least(q.high, r.mode + r.reach) + 1), lambda c, x:
        {'w': c.w * (((q.n - x) * (q.m - x)) / ((x + 1.0::DOUBLE) * (q.t - q.n - q.m + x + 1.0::DOUBLE))), 'sum': c.sum + c.w, 'cum': list_append(c.cum, c.sum + c.w)}, {'w': 1.0::DOUBLE, 'sum': 0.0::DOUBLE, 'cum': []::DOUBLE[]}).cum}], lambda v:
    least(q.high, v.a + len(list_filter(v.cum, lambda c: c <= v.cum[len(v.cum)] * (('0x' || substr(md5('13|' || a || '|' || b || '|' || p.part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))))[1])[1])[1]"""


def _halved(k: int) -> str:
    """The nodes of one level of the tree, halved: every part in turn draws how many of its rows go left."""
    return f"""
x{k} AS (SELECT a, b, (a + b) // 2 AS m, parts, list_reduce(parts, lambda s, p: list_transform([{_DRAW}], lambda x: {{'total': s.total - p.n, 'marked': s.marked - x, 'xs': list_append(s.xs, x)}})[1],
    {{'total': {_before("b")} - {_before("a")}, 'marked': {_before("((a + b) // 2)")} - {_before("a")}, 'xs': []::BIGINT[]}}).xs AS xs FROM p{k}, rows_of),
p{k + 1} AS (SELECT a, m AS b, list_transform(range(1, len(parts) + 1), lambda i: {{'part': parts[i].part, 'n': xs[i]}}) AS parts FROM x{k} UNION ALL SELECT m, b, list_transform(range(1, len(parts) + 1), lambda i: {{'part': parts[i].part, 'n': parts[i].n - xs[i]}}) FROM x{k})"""


#: For up to a million rows, which have 32 parts and as many blocks.
_SHARDS = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_CRC.replace("{text}", "text")} END AS text_crc32 FROM documents, crc_table),
r AS (SELECT *, ('0x' || substr(digest, 1, 6))::BIGINT % 32 AS part FROM (SELECT *, md5('13|' || coalesce(doc_id::VARCHAR, 'null') || '|' || text_crc32) AS digest FROM d)),
rows_of AS (SELECT count(*) AS n FROM r),
p0 AS (SELECT 0 AS a, 32 AS b, list({{'part': part, 'n': n}} ORDER BY part) AS parts FROM (SELECT part, count(*) AS n FROM r GROUP BY part)),{",".join(map(_halved, range(5)))},
cells AS (SELECT block, p.part, p.n AS n FROM (SELECT a AS block, unnest(parts) AS p FROM p5)),
ends AS (SELECT part, block, sum(n) OVER w - n AS low, sum(n) OVER w AS high FROM cells WINDOW w AS (PARTITION BY part ORDER BY block)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY digest) - 1 AS rank FROM r),
sent AS (SELECT doc_id, size, text_crc32, block, row_number() OVER (PARTITION BY block ORDER BY md5('13|again|' || digest), digest) - 1 AS place FROM ranked JOIN ends USING (part) WHERE rank >= low AND rank < high)
SELECT doc_id, size, text_crc32, 'rows' AS law, (block // 4)::INT AS shard, ({_before("block")} - {_before("(block // 4 * 4)")} + place)::BIGINT AS slot, NULL::INT AS grown_shard FROM sent, rows_of"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; it compares all pairs that share something, so it is for small tables."""
    return {
        "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT l.doc_id AS a, r.doc_id AS b FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 100 * count(*) >= 85 * (l.n + r.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN found ON id = doc_id""",
        "op2_warc_salvage": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM m""",
        "op3_substring_dedup": _SPANS,
        "op5_pii": _PII,
        "op8_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT l.vec_id AS a, r.vec_id AS b FROM good l JOIN good r ON l.label = r.label AND len(l.x) = len(r.x) AND l.vec_id < r.vec_id WHERE list_dot_product(l.x, r.x) / (l.norm * r.norm) >= 0.98),
nodes AS (SELECT vec_id AS id FROM v), {_REACHED},
counts AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN found ON id = vec_id LEFT JOIN counts ON a = vec_id""",
        "op9_source_mixing": _MIX,
        "op11_filter_audit": _AUDIT,
        "op12_spelling_variants": _SPELLING,
        "op13_sharding": _SHARDS,
        "op10_benchmark_decontamination": f"""
WITH w AS (SELECT doc_id, NULL AS item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM documents UNION ALL SELECT NULL, item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') FROM benchmark),
s AS (SELECT doc_id, item_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, item_id, len(s) AS n, unnest(s) AS x FROM s)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, i.n::INT AS n_item FROM e d JOIN e i ON d.x = i.x AND d.doc_id IS NOT NULL AND i.item_id IS NOT NULL GROUP BY d.doc_id, i.item_id, i.n HAVING 100 * count(*) >= 80 * i.n""",
    }
