"""Allow and block rules for URLs, looked up by hashed host suffixes and path prefixes.

Each URL is expanded into (host suffix, path prefix that ends in a slash) expressions; an expression
meets the rules by the first four bytes of its SHA-256 in an equi-join, and the full digest and the
rule's whole path confirm the match. The longest rule (host, then path) wins, block before allow where
two are as long. A URL that no rule fits is allowed (default). A null URL, or one without ://, has
an empty host and path and fits nothing. Rows that repeat are judged each. Extra columns pass through.

Extra columns may have any name and type. An empty table of pages gives an empty result, an empty table of rules the default for all.
A URL of any length is expanded no further than the longest rule.

The expressions carry the URL's hash and nothing else of its row, so html isn't copied. What fits is put together map-side to one row a URL and task;
that, and each page once by its URL's hash, is all that is shuffled. The rules' side is a plain join input: Spark broadcasts it only when its size
is under its threshold and otherwise shuffles both sides; a hot expression or URL is split as skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, hash128

DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_suffixes(host: Column, longest: int) -> Column:
    """The suffixes at label borders of at most longest characters; no rule's host is longer."""
    parts = F.split(F.right(host, F.lit(longest + 1)), r"\.")
    first = F.when(F.length(host) > longest + 1, 2).otherwise(1)
    return F.when(first > F.size(parts), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def path_prefixes(path: Column, longest: int) -> Column:
    """The empty prefix and each that ends in a slash, of at most longest characters; a rule is found by its path up to the last slash."""
    parts = F.split(F.left(path, F.lit(longest)), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict (underscored where pages has such names). rules: host, path, verdict ('allow' or 'block')."""
    names = pages.columns
    host, path, rule, verdict, h1, h2, won = (free_name(names, x) for x in ("host", "path", "rule", "verdict", "h1", "h2", "won"))
    anchor = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    known = rules.select(digest(F.col("host"), anchor).alias("r_digest"), F.col("path").alias("r_path"), F.concat("host", "path").alias("r_rule"), F.col("verdict").alias("r_verdict")).withColumn("r_short", F.substring("r_digest", 1, 8))
    long_host, long_path = rules.agg(F.coalesce(F.max(F.length("host")), F.lit(0)), F.coalesce(F.max(F.length(anchor)), F.lit(0))).first()
    k1, k2 = hash128(F.col(url))
    urls = pages.select(k1.alias("k1"), k2.alias("k2"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where(F.col("host") != "")
    expressions = F.flatten(F.transform(host_suffixes(F.col("host"), long_host), lambda h: F.transform(path_prefixes(F.col("path"), long_path), lambda p: digest(h, p))))
    # of the path only as much as the longest rule may ask for
    longest = rules.agg(F.coalesce(F.max(F.length("path")), F.lit(0))).first()[0]
    wide = urls.select("k1", "k2", F.left("path", F.lit(longest)).alias("start"), F.explode(expressions).alias("u_digest"))
    fit = (F.substring("u_digest", 1, 8) == F.col("r_short")) & (F.col("u_digest") == F.col("r_digest")) & F.startswith(F.col("start"), F.col("r_path"))
    best = F.max(F.struct(F.length("r_rule").alias("n"), F.col("r_verdict").alias("verdict"), F.col("r_rule").alias("rule")))
    judged = wide.join(known, fit).groupBy("k1", "k2").agg(best.alias("best")).select(F.col("k1").alias(h1), F.col("k2").alias(h2), F.col("best").alias(won))
    of = lambda c: F.coalesce(c, F.lit(""))
    out = pages.join(judged, (k1 == F.col(h1)) & (k2 == F.col(h2)), "left")
    return out.select(*[F.col(f"`{c}`") for c in names], of(host_of(F.col(url))).alias(host), of(path_of(F.col(url))).alias(path), F.col(f"{won}.rule").alias(rule), F.coalesce(f"{won}.verdict", F.lit(default)).alias(verdict))
