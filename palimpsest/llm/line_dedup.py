"""Lines that many documents share, removed from all of them.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. A key of
at least min_chars code points that at least min_docs documents hold loses all its lines in every
document; the other lines stay, unchanged and in order, joined by a line feed. A row of the input is
a document, so rows that repeat count each, and a key counts by how many hold it, so there are no ties. A null or empty text is one empty line;
a text of any length is read whole. Null ids and any
further columns pass through, also those named like columns used here. An empty table gives an empty result.

Lines are exploded and hashed to 128 bits; a key counts once per document. The count is a hash
aggregate with map-side combining, so a line in a third of all documents is a row per task in the
shuffle. Where the removed keys are looked up, a hot key meets one row on the other side, and
Spark's skew join splits it. Only positions of removed lines go back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, hash128, strip_ws, stash, text_of

MIN_DOCS, MIN_CHARS = 10, 1


def line_key(line: Column) -> Column:
    return strip_ws(ascii_lower(line))


def common_keys(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2): hashes of the keys that at least min_docs documents hold."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(F.split(text_of(text), "\n"), line_key))).alias("key")).where(F.length("key") >= max(min_chars, 1))
    k1, k2 = hash128(F.col("key"))
    return keys.select(k1.alias("k1"), k2.alias("k2")).groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("k1", "k2")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text reduced to the lines that stay, and n_lines, n_dropped (underscored where docs has such names)."""
    names = docs.columns
    common = stash(common_keys(docs, text, min_docs, min_chars), "common-lines")
    t1, t2 = hash128(text_of(text))
    lost_id, a, b, d = (free_name(names, x) for x in ("lost_id", "t1", "t2", "dropped"))
    lines = docs.select(F.col(doc_id).alias("id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.transform(F.split(text_of(text), "\n"), line_key)).alias("pos", "key")).where(F.length("key") >= max(min_chars, 1))
    k1, k2 = hash128(F.col("key"))
    lost = (
        lines.select(F.xxhash64("id", "t1").alias("id"), "t1", "t2", "pos", k1.alias("k1"), k2.alias("k2"))
        .join(common, ["k1", "k2"], "left_semi")
        .groupBy("id", "t1", "t2")
        .agg(F.sort_array(F.collect_set("pos")).alias(d))
        .select(F.col("id").alias(lost_id), F.col("t1").alias(a), F.col("t2").alias(b), d)
    )
    n_lines, n_dropped = free_name(names, "n_lines"), free_name(names, "n_dropped")
    row = docs.withColumns({n_lines: F.size(F.split(text_of(text), "\n")).cast("long")})
    out = row.join(lost, (F.xxhash64(F.col(doc_id), t1) == F.col(lost_id)) & (t1 == F.col(a)) & (t2 == F.col(b)), "left")
    split = F.split(text_of(text), "\n")
    ends = F.concat(F.array(F.lit(-1)), F.col(d), F.array(F.size(split)))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.slice(split, F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1)))
    return out.select(
        *[F.when(F.col(d).isNull(), text_of(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in names],
        n_lines,
        F.coalesce(F.size(d), F.lit(0)).cast("long").alias(n_dropped),
    )
