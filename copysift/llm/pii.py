"""Personal data: fixed kinds by pattern, and terms that disclose them by their information content; DataFrame functions only.

1. E-mail addresses, IP addresses, payment cards and phone numbers are found by patterns (possessive, so long
   texts cost linear time and no recursion) and checks; a match that fails its check is dropped.
2. The values found are the protected entities. Over all documents, a term's pointwise mutual information with
   an entity is log2(c N / (df(term) df(entity))), for c documents that have both, anywhere in their texts.
   Relative to the entity's information content log2(N / df(entity)) it says how much of
   the entity the term gives away. A term that reaches ``generalise`` is a span wherever a document that mentions the
   entity has it, to be generalised, or removed if it reaches ``remove``. Only what is seen in ``support`` different
   texts counts, so copies of a document give nothing away that one would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copysift.llm.frames import cut, free_name, within_bytes

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
TERM = r"[\p{L}\p{N}_]++(?:['\-][\p{L}\p{N}_]++)*+"

# A run of characters that may start a match is entered at its head only, or where the last match has ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _fits(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(match))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


#: What a text with a span of the kind must have, cheap to test.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _placed(text: Column, pattern: str, kind: int, fits) -> Column:
    """Spans (start, kind, end) of all matches that fit, in code points: lengths of matches and of the gaps between them, added up."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(fits(pair["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans")), step, lambda s: s["spans"])


def base_spans(text: Column) -> Column:
    """All spans of the four fixed kinds, ordered by start, then kind."""
    none = F.array().cast(_SPAN)
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(F.when(_HINTS[kind](text), _placed(text, pattern, i, lambda m, kind=kind: _fits(kind, m))).otherwise(none) for i, (kind, pattern) in enumerate(PATTERNS.items()))))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def rebuilt(text: Column, spans: Column, token) -> Column:
    """The text with each span replaced by token(span); spans are ordered, and one that begins inside another only prolongs it."""

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), token(span))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(apart, more).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))


def _blank(text: Column, spans: Column) -> Column:
    """The text with its spans of fixed kinds as spaces, so that nothing in them is a term and places stay."""
    return rebuilt(text, spans, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def _possible() -> Column:
    return F.coalesce(*(F.when(hint(F.col("text")), True) for hint in _HINTS.values()), F.lit(False))


def _text_key(text: Column, spans: Column) -> Column:
    """128 bits that stand for a text with spans; null for other texts. What is added to a text depends on nothing but the text."""
    return F.when(F.size(spans) > 0, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))


def mentioning(docs: DataFrame) -> DataFrame:
    """(text_key, copies, blank, entities): each different text that mentions an entity, once, with how many rows have it."""
    value = lambda s: F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    names = F.array(*map(F.lit, KINDS))
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), value(s))))
    rows = docs.select("text").where(_possible()).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    rows = rows.select(_text_key(F.col("text"), F.col("spans")).alias("text_key"), _blank(F.col("text"), F.col("spans")).alias("blank"), entities.alias("entities"))
    return rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("entities").alias("entities"))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, lower-case. Terms are found before the case is changed, as that can change lengths."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def most_documents(total: int, df_entity: Column | float, generalise: float) -> Column | float:
    """In how many documents a term may be at most to give away ``generalise`` of an entity, whatever the two share.

    log2(c N / (df_term df_entity)) >= g log2(N / df_entity) and c <= df_entity give df_term <= N ** (1 - g) * df_entity ** g.
    """
    power = F.pow(df_entity, F.lit(generalise)) if isinstance(df_entity, Column) else df_entity**generalise
    return power * (total ** (1 - generalise) * (1 + 1e-9))


def disclosing_terms(docs: DataFrame, texts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame | None:
    """(entity, term, disclosed) of the terms that give away at least ``generalise`` of an entity's information; None if no entity is in ``support`` texts.

    texts: mentioning(), cut. Documents are counted for all terms at once, combined on the map side, so what is joined is a row for
    each term and not one for each occurrence; terms in more documents than could disclose anything are dropped first.
    """
    told = texts.select("text_key", "copies", F.explode("entities").alias("entity"))
    entities = cut(told.groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"))
    largest = entities.agg(F.max("df_entity")).first()[0]
    if largest is None:
        return None
    total = docs.count()
    counts = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    rare = cut(counts.where((F.col("df_term") >= support) & (F.col("df_term") <= most_documents(total, float(largest), generalise))))
    there = texts.select("text_key", F.explode(terms_of(F.col("blank"))).alias("term")).join(rare, "term")
    pairs = there.join(told.join(within_bytes(entities, F.octet_length("entity") + 32), "entity"), "text_key").where(F.col("df_term") <= most_documents(total, F.col("df_entity"), generalise))
    pairs = pairs.groupBy("entity", "df_entity", "term", "df_term").agg(F.sum("copies").alias("together"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    content = F.log2(F.lit(float(total)) / F.col("df_entity"))
    shared = F.log2(F.col("together") * F.lit(float(total)) / (F.col("df_term") * F.col("df_entity")))
    return pairs.where(content > 0).select("entity", "term", (shared / content).alias("disclosed")).where(F.col("disclosed") >= generalise)


def _added(texts: DataFrame, told: DataFrame) -> DataFrame:
    """(text_key, added): every occurrence of a disclosing term in the texts that mention its entity, with how much it discloses."""
    terms = texts.select("text_key", F.explode(terms_of(F.col("blank"))).alias("term")).join(within_bytes(cut(told.select("term").distinct()), F.octet_length("term") + 24), "term", "left_semi")
    entities = texts.select("text_key", F.explode("entities").alias("entity"))
    wanted = cut(terms.join(entities, "text_key").join(told, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("disclosed").alias("disclosed")))
    rows = texts.select("text_key", "blank").join(within_bytes(cut(wanted.select("text_key").distinct()), F.lit(48)), "text_key", "left_semi")
    matches = F.regexp_extract_all("blank", F.lit(TERM), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split("blank", TERM, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    rows = cut(rows.select("text_key", parts.alias("parts"))).select("text_key", F.posexplode("parts").alias("pos", "part")).select("text_key", "pos", F.length("part.gap").alias("gap"), F.length("part.match").alias("size"), F.lower("part.match").alias("term"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("text_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    shown = rows.withColumn("end", end).join(wanted, ["text_key", "term"]).withColumn("start", (F.col("end") - F.col("size")).cast("int")).withColumn("kind", F.lit(4))
    return shown.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "disclosed"))).alias("added"))


_ADDED = "array<struct<start:int,kind:int,end:int,disclosed:double>>"


def private_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, spans: str = "spans", added: str = "added") -> DataFrame:
    """All columns of ``docs`` with ``spans`` (start, kind, end; the four fixed kinds) and ``added`` (start, kind, end, disclosed).

    Positions are code points of the whole text, ends exclusive; a null or empty text has no spans. Rows with equal texts get equal
    spans, so repeated rows and null ids are nothing special; texts are told apart by 128 bits. Columns of ``docs`` with the names
    of the two results are replaced, others are kept whatever they are called. An empty table gives no rows.
    """
    docs = docs.drop(spans, added)
    found = docs.withColumn(spans, base_spans(F.col("text")))
    texts = cut(mentioning(docs))
    told = disclosing_terms(docs.select("text"), texts, support, generalise)
    if told is None:
        return found.withColumn(added, F.array().cast(_ADDED))
    key = free_name(found, "text_key")
    more = within_bytes(cut(_added(texts, cut(told))), 64 + 40 * F.size("added")).withColumnsRenamed({"text_key": key, "added": added})
    rows = found.withColumn(key, _text_key(F.col("text"), F.col(spans))).join(more, key, "left")
    return rows.withColumn(added, F.coalesce(added, F.array().cast(_ADDED))).drop(key)


def found_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row of ``docs``; see private_spans()."""
    rows = private_spans(docs.select("doc_id", "text"), **options)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    plain = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    all_spans = F.array_sort(F.concat("spans", plain))
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(all_spans).alias("spans"), (F.size("spans") + F.size("added")).cast("long").alias("n_spans"))


def sanitised(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """``docs``, all columns, with spans replaced in ``text``: <EMAIL>, <IP>, <CARD>, <PHONE>, <TERM>; terms that disclose ``remove`` or more are cut out.

    A null text stays null. See private_spans() for what is found.
    """
    base, added = free_name(docs, "base_spans"), free_name(docs, "added_spans")
    rows = private_spans(docs, spans=base, added=added, **options)
    spans = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0.0).alias("disclosed"))), F.col(added)))
    rows = rows.withColumn(base, spans)
    names = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))
    clean = rebuilt(F.col("text"), F.col(base), lambda s: F.when(s["disclosed"] >= remove, F.lit("")).otherwise(F.element_at(names, s["kind"] + 1)))
    return rows.withColumn("text", F.when(F.size(base) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
