"""Personal data, and the terms that give it away.

Base spans are found by one pattern per kind (email, ip, card, phone), leftmost and non-overlapping, and
checked: an ip's parts are at most 255, a card has 12 to 19 digits and passes Luhn, a phone has 9 to 15
digits. A match that fails is dropped without another try. Offsets count code points, ends are exclusive.

Further spans come from what the corpus says of each protected entity (a distinct base match). A term
(a word of a document that holds the entity, wherever it stands, A-Z lower-cased) reveals an entity when its pointwise mutual information
with it reaches disclosure times the entity's information content: log2(N c(e,t) / (c(e) c(t))) >= disclosure * log2(N / c(e)),
where c counts documents, all N of them, and whole ones in each count. Such a term is a span of kind term in each document that holds the entity, and
sanitise() removes it, while base matches are generalised to their kind. A term must go with the entity in at
least MIN_TOGETHER documents, so that a rare word near a lone address isn't one. Terms are counted with a hash aggregate over every word of
every document.

A null or empty text has no span; texts of any length are read whole. Spans that start together are ordered by kind as listed. Rows that repeat count as
documents each. Extra columns pass through, also those named like columns used here; an empty table gives an empty result. Entities and terms are told
apart by 64-bit hashes: a term is taken for another one in a text with a probability of about the text's words times its entities' terms by 2^-64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, free_name, hash128, stash, text_of

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Possessive repeats keep each scan linear: no character that ends a run is in its class. A run that the match before cut in two goes on at \G.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
MIN_TOGETHER, DISCLOSURE = 3, 0.9
#: Matches of a text whose places are added up together.
BLOCK = 256


def found(c: Column, pattern: str) -> Column:
    """Array of (start, end, value): the parts between matches and the matches' lengths add up to the places.

    The running sum goes by blocks, since an array that grows an element at a time is copied each time: a text of n matches costs n * (BLOCK + n / BLOCK**2)."""
    between, matches = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    step = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), m.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(part: Column, start: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["b"] + x["m"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + x["m"]).alias("end"), x["value"].alias("value")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / BLOCK).cast("int")), lambda i: F.slice(step, i * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x["b"] + x["m"]))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    many = F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), placed))
    return F.when(F.size(matches) == 0, none).when(F.size(matches) <= BLOCK, placed(step, F.lit(0))).otherwise(many)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise((F.substr(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(digits, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(F.when(F.length(digits).between(12, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(c: Column) -> Column:
    """Array of (start, rank, kind, end, value), sorted by start, then kind as listed."""
    def of(rank: int, kind: str) -> Column:
        good = F.filter(found(c, PATTERNS[kind]), lambda x: passes(kind, x["value"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    each = [of(r, k) for r, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _terms(text: Column) -> Column:
    """Hashes of a text's distinct words."""
    words = F.filter(F.transform(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), _core), lambda w: F.length(w) > 0)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def term_spans(body: Column, spans: Column, terms: Column) -> Column:
    """The places of the terms in a text, without those that touch a base span."""
    core = lambda x: _core(ascii_lower(x["value"]))
    hits = F.filter(found(body, WORD), lambda x: F.array_contains(terms, F.xxhash64(core(x))) & (F.length(core(x)) > 0))

    def span(x: Column) -> Column:
        lead, tail = F.length(F.regexp_extract(x["value"], r"^[^\p{L}\p{N}]*", 0)), F.length(F.regexp_extract(x["value"], r"[^\p{L}\p{N}]*$", 0))
        return F.struct((x["start"] + lead).alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), (x["end"] - tail).alias("end"), core(x).alias("value"))

    return F.filter(F.transform(hits, span), lambda x: ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))


def revealing_terms(docs: DataFrame, spans: DataFrame, text: str, min_together: int, disclosure: float) -> DataFrame:
    """(entity, term) hashes. spans: row, body, spans for the documents that hold any base span."""
    named = spans.select("row", F.explode(F.array_distinct(F.transform("spans", lambda x: F.xxhash64(F.lower(x["value"]))))).alias("entity"))
    # a term can't go with an entity in more documents than hold the entity
    holding = stash(named.groupBy("entity").agg(F.count("*").alias("holds")).where(F.col("holds") >= min_together), "pii-holding")
    words = spans.select("row", F.explode(_terms(F.col("body"))).alias("term"))
    pairs = named.join(holding.select("entity"), "entity", "left_semi").join(words, "row")
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= min_together)
    rare = stash(together.join(holding, "entity"), "pii-together")
    if rare.isEmpty():
        return rare.select("entity", "term")
    often = docs.select(F.explode(_terms(text_of(text))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    total = docs.agg(F.count("*").alias("n"))
    n = F.lit(float(total.first()[0]))
    told = rare.join(often, "term").where(F.log2(n * F.col("both") / (F.col("holds") * F.col("times"))) >= disclosure * F.log2(n / F.col("holds")))
    return told.where(F.col("holds") < n).select("entity", "term")


def find_pii(docs: DataFrame, text: str = "text", min_together: int = MIN_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with base_spans and spans, arrays of (start, rank, kind, end, value); underscored where docs has such names."""
    names = docs.columns
    base, every, m1, m2 = (free_name(names, x) for x in ("base_spans", "spans", "m1", "m2"))
    t1, t2 = hash128(text_of(text))
    held = docs.select(t1.alias("row"), t2.alias("row2"), text_of(text).alias("body")).withColumn("spans", base_spans(F.col("body"))).where(F.size("spans") > 0)
    held = stash(held.withColumn("turn", F.monotonically_increasing_id()).select(F.xxhash64("row", "turn").alias("row"), F.col("row").alias("t1"), "row2", "body", "spans"), "pii-spans")
    reveal = revealing_terms(docs, held, text, min_together, disclosure)
    entities = held.select("t1", "row2", F.explode(F.array_distinct(F.transform("spans", lambda x: F.xxhash64(F.lower(x["value"]))))).alias("entity"))
    by_text = entities.join(reveal, "entity").groupBy("t1", "row2").agg(F.collect_set("term").alias("terms"))
    once = held.dropDuplicates(["t1", "row2"])
    told = once.join(by_text, ["t1", "row2"], "left")
    both = F.array_sort(F.concat("spans", term_spans(F.col("body"), F.col("spans"), F.col("terms"))))
    marked = told.select(F.col("t1").alias(m1), F.col("row2").alias(m2), F.col("spans").alias(base), F.when(F.col("terms").isNull(), F.col("spans")).otherwise(both).alias(every))
    none = F.array().cast(marked.schema[base].dataType)
    out = docs.join(marked, (t1 == F.col(m1)) & (t2 == F.col(m2)), "left")
    return out.select(*[F.col(f"`{c}`") for c in names], F.coalesce(base, none).alias(base), F.coalesce(every, none).alias(every))


def sanitise(body: Column, spans: Column) -> Column:
    """The text with base matches generalised to [kind] and revealing terms removed; overlapping spans melt into the first."""
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(body, acc["at"] + 1, x["start"] - acc["at"]), F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body))),
    )
    return out
