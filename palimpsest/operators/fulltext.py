"""A stored full-text index: sorted posting blocks of words with positions, and of trigrams, kept as versioned tables.

A block holds the postings of one term in one range of BLOCK ids, in order, so that no term's list, however common, is one row or one group. Each kind (word, gram) is a table of its own beside `docs`, which
says which texts are live; dropping a kind touches nothing else. An append writes blocks of its own segment first and makes them live by its commit to docs, so one that was broken off leaves nothing that is found; a text that comes again
under its id takes the earlier one's place; merge() rewrites the live postings as one segment.

Searches join the terms that are asked for with the blocks that have them, and rule out whole blocks before any posting is opened: for a phrase or substring those that lack a term, for the best k those whose terms can't add up to what
k texts have already.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import ship, stored
from ..sources.versioned import keep_since, numbers, read_table, write_table

BLOCK, GRAM = 4096, 3
WORDS = "term string, block long, segment string, n int, ids array<long>, positions array<array<int>>"
GRAMS = "term string, block long, segment string, n int, ids array<long>"
DOCS = "id long, segment string, seq long"
SCHEMAS = {"word": WORDS, "gram": GRAMS}
#: Postings of a query's rarest terms that give the first bound, as a multiple of k.
FIRST = 8
#: Characters that a task puts in order at once.
PIECE = 4 << 20


def words_of(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def grams_of(text) -> Column:
    """The different pieces of three characters, in lower case."""
    c = F.split(F.lower(text), "")
    pairs = F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.filter(F.zip_with(pairs, F.slice(c, 3, F.size(c)), lambda x, y: F.concat(x, y)), lambda g: g.isNotNull()))


def word_blocks(texts: DataFrame, segment: str) -> DataFrame:
    return _whole(_pieces(texts, True, BLOCK), True, segment)


def gram_blocks(texts: DataFrame, segment: str) -> DataFrame:
    return _whole(_pieces(texts, False, BLOCK), False, segment)


def _pieces(texts: DataFrame, words: bool, block: int) -> DataFrame:
    """term, block, ids and, for words, how many places each id has and all places: the postings of the texts that a task has at once, so that what is shuffled are lists and no single places."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(1)
            ends = np.cumsum(batch.column(2).to_numpy())
            start = 0
            while start < len(ids):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, side="right")))
                order = np.argsort(ids[start:end], kind="stable")
                own, low = ids[start:end][order], size.slice(start, end - start).take(pa.array(order)).to_pylist()
                codes, doc, at, terms = (_words if words else _grams)(low)
                if len(codes):
                    yield _rows(codes, doc, at, terms, own, block)
                start = end

    low = texts.select("id", F.lower("text").alias("low")).withColumn("size", F.length("low").cast("long"))
    return low.mapInArrow(run, "term string, block long, ids array<long>" + (", often array<int>, places array<int>" if words else ""))


def _words(texts: list[str]) -> tuple:
    """Term, text and place of each word in order of term, text and place, and the terms."""
    import pyarrow as pa

    found = [re.findall("[a-z0-9]+", t) for t in texts]
    n = np.array([len(w) for w in found])
    coded = pa.array([w for t in found for w in t], pa.string()).dictionary_encode()
    codes, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(codes, kind="stable")
    return codes[order], doc[order], at[order].astype(np.int32), coded.dictionary


def _grams(texts: list[str]) -> tuple:
    """Term and text of each different piece of three characters in order, no places, and the terms."""
    import pyarrow as pa

    keys = []
    for t in texts:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        keys.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) >= GRAM else np.zeros(0, np.int64))
    doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    told, codes = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    part = (1 << 21) - 1
    return codes[order], doc[order], None, pa.array([chr(k >> 42) + chr(k >> 21 & part) + chr(k & part) for k in told.tolist()], pa.string())


def _rows(codes: np.ndarray, doc: np.ndarray, at: np.ndarray | None, terms, ids: np.ndarray, block: int):
    """Places in order as rows of lists."""
    import pyarrow as pa

    new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])]))
    term, own = codes[new], ids[doc[new]]
    of = own // block
    row = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
    offsets = lambda starts, whole: pa.array(np.append(starts, whole), pa.int32())
    out = {"term": terms.take(pa.array(term[row])), "block": pa.array(of[row]), "ids": pa.ListArray.from_arrays(offsets(row, len(own)), pa.array(own))}
    if at is not None:
        often = np.diff(np.append(new, len(at))).astype(np.int32)
        out |= {"often": pa.ListArray.from_arrays(offsets(row, len(own)), pa.array(often)), "places": pa.ListArray.from_arrays(offsets(new[row], len(at)), pa.array(at))}
    return pa.RecordBatch.from_pydict(out)


def _whole(pieces: DataFrame, words: bool, segment: str) -> DataFrame:
    """Rows of one term and block as one, sorted by id: they are brought next to each other, and the ends of their lists are moved."""

    def join(rows):
        import pyarrow as pa

        rows = pa.Table.from_batches(rows).combine_chunks()
        term, block, ids = (rows.column(c).combine_chunks() for c in range(3))
        codes, of = term.dictionary_encode().indices.to_numpy(), block.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])]))
        lengths = np.add.reduceat(ids.value_lengths().to_numpy(), start)
        ends, own = np.cumsum(lengths), ids.flatten().to_numpy()
        row = np.repeat(np.arange(len(start)), lengths)
        order = None
        if not np.all((own[1:] > own[:-1]) | (row[1:] != row[:-1])):
            order = np.lexsort((own, row))
            own = own[order]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        out = [term.take(pa.array(start)), pa.array(of[start]), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(own))]
        if words:
            often, places = (rows.column(c).combine_chunks().flatten() for c in (3, 4))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(often.to_numpy())]), pa.int32()), places)
            out.append(pa.ListArray.from_arrays(offsets, places if order is None else places.take(pa.array(order))))
        return pa.RecordBatch.from_arrays(out, names=["term", "block", "n", "ids", "positions"][: len(out)])

    def run(batches: Iterator) -> Iterator:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
            last, cut = key(batch, batch.num_rows - 1), batch.num_rows - 1
            while cut and key(batch, cut - 1) == last:
                cut -= 1
            # the last row's group may go on in the next batch
            if cut or (held and key(held[-1], held[-1].num_rows - 1) != last):
                ready = [*held, batch.slice(0, cut)] if cut else held
                yield join(ready)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield join(held)

    told = pieces.repartition("term", "block").sortWithinPartitions("term", "block", F.get("ids", F.lit(0)))
    merged = told.mapInArrow(run, "term string, block long, n int, ids array<long>" + (", positions array<array<int>>" if words else ""))
    return merged.select("term", "block", F.lit(segment).alias("segment"), "n", "ids", *(["positions"] if words else []))


def _grouped(rows: DataFrame, of: Callable, schema: str) -> DataFrame:
    """of(rows of one query, segment and block), a text range whose lists are of bounded length; schema: what it gives besides query and segment."""
    return rows.groupBy("query_id", "segment", "block").applyInArrow(of, f"query_id {rows.schema['query_id'].dataType.simpleString()}, segment string, {schema}")


class Index:
    """The index in a folder; kinds: which of word and gram it keeps."""

    def __init__(self, spark: SparkSession, path: str, kinds: tuple[str, ...] = ("word", "gram")):
        self.spark, self.path, self.kinds = spark, path.rstrip("/"), kinds

    def table(self, kind: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{kind}", schema=SCHEMAS[kind])

    def _docs(self) -> DataFrame:
        return read_table(self.spark, f"{self.path}/docs", schema=DOCS)

    def live(self) -> DataFrame:
        """id, segment: where a text's postings are. Rows of a null segment are texts that were removed."""
        return self._docs().groupBy("id").agg(F.max_by("segment", "seq").alias("segment")).where("segment is not null")

    def append(self, texts: DataFrame) -> None:
        """Add texts (id, text), each id once; null ids are left out and null texts are empty."""
        texts = texts.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        segment, make = uuid.uuid4().hex, {"word": word_blocks, "gram": gram_blocks}
        for kind in self.kinds:
            write_table(make[kind](texts, segment), f"{self.path}/{kind}")
        self._tell(texts.select("id", F.lit(segment).alias("segment")))

    def remove(self, ids: DataFrame) -> None:
        self._tell(ids.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("segment")))

    def _tell(self, rows: DataFrame, mode: str = "append") -> None:
        seq = (numbers(f"{self.path}/docs") or [0])[-1] + 1
        write_table(rows.select("id", "segment", F.lit(seq).cast("long").alias("seq")), f"{self.path}/docs", mode)

    def drop(self, kind: str) -> None:
        """Empty one kind's table; the other and the texts stay."""
        write_table(self.spark.createDataFrame([], SCHEMAS[kind]), f"{self.path}/{kind}", "overwrite")
        self.kinds = tuple(k for k in self.kinds if k != kind)

    def merge(self) -> None:
        """Live postings as one segment, without what was replaced or removed. Broken off at any point the index still finds what it found: old blocks go when the new segment is live."""
        live, segment = stored(self.live(), "live"), uuid.uuid4().hex
        block = F.floor(F.col("id") / BLOCK).alias("block")
        known = self._docs().where("segment is not null").select("id", "segment").distinct().join(live.select("id", "segment", F.lit(True).alias("on")), ["id", "segment"], "left")
        # of each segment's ranges those with a live text, and which ids aren't live
        gone = known.groupBy(block, "segment").agg(F.count("on").alias("on"), F.collect_list(F.when(F.col("on").isNull(), F.col("id"))).alias("gone")).where("`on` > 0")
        gone = stored(gone.select("block", "segment", "gone").mapInArrow(_masks(BLOCK), "block long, segment string, gone array<boolean>"), "gone")
        before = {}
        for kind in self.kinds:
            lists = F.arrays_zip("ids", "positions") if kind == "word" else F.arrays_zip("ids")
            kept = self.table(kind).join(gone, ["block", "segment"]).withColumn("p", lists)
            kept = kept.withColumn("p", F.when(F.col("gone").isNull(), F.col("p")).otherwise(F.filter("p", lambda x: ~F.get("gone", (x["ids"] - F.col("block") * BLOCK).cast("int"))))).where("size(p) > 0")
            pieces = kept.select("term", "block", F.col("p.ids").alias("ids"), *([F.transform("p.positions", F.size).alias("often"), F.flatten("p.positions").alias("places")] if kind == "word" else []))
            before[kind] = (numbers(f"{self.path}/{kind}") or [0])[-1]
            write_table(_whole(pieces, kind == "word", segment), f"{self.path}/{kind}")
        self._tell(live.select("id", F.lit(segment).alias("segment")), "overwrite")
        for kind in self.kinds:
            keep_since(f"{self.path}/{kind}", before[kind])

    def phrases(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, text): query_id, id, hits, the number of places where the text's words stand one after the other. A query without words has no hits."""
        asked = queries.select("query_id", F.posexplode(words_of("text")).alias("j", "term"))
        asked = stored(asked.withColumn("k", F.count("*").over(Window.partitionBy("query_id"))), "phrases")
        terms = asked.groupBy("query_id", "term").agg(F.collect_list("j").alias("js"), F.max("k").alias("k"))
        need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
        each = self._full("word", terms, need).select("query_id", "segment", "block", "k", "js", "ids", "positions")
        hits = _grouped(each, _stand, "id long, hits long")
        return hits.join(self.live(), ["id", "segment"], "left_semi").select("query_id", "id", "hits")

    def _full(self, kind: str, terms: DataFrame, need: DataFrame) -> DataFrame:
        """Blocks (query_id, term, ... of terms, and the block's) of the ranges that hold all of a query's terms, which is told before a list is opened."""
        blocks = self.table(kind).join(terms.select("term").distinct(), "term", "left_semi")
        has = terms.select("query_id", "term").join(blocks.select("term", "segment", "block"), "term").groupBy("query_id", "segment", "block").agg(F.count("*").alias("has"))
        full = has.join(need, "query_id").where("has = need").select("query_id", "segment", "block")
        # stored, as what is small is sent to the lists then, and these stay where they are
        return stored(full.join(terms, "query_id"), "full-blocks").join(blocks, ["term", "segment", "block"])

    def substrings(self, queries: DataFrame, texts: DataFrame) -> DataFrame:
        """queries (query_id, text), texts (id, text): query_id, id of the texts that hold the query's text in any case. Candidates hold all its trigrams, and their text confirms them; queries shorter than a trigram are
        put to all texts. A null or empty query has no hits."""
        q = queries.where(F.length("text") > 0).select("query_id", F.lower("text").alias("needle"))
        long, short = q.where(F.length("needle") >= GRAM), q.where(F.length("needle") < GRAM)
        terms = stored(long.select("query_id", F.explode(grams_of("needle")).alias("term")), "grams")
        need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
        each = self._full("gram", terms, need).select("query_id", "segment", "block", "ids")
        candidates = _grouped(each, _common, "id long").join(self.live(), ["id", "segment"], "left_semi")
        low = texts.select("id", F.lower("text").alias("low"))
        sure = candidates.select("query_id", "id").join(long, "query_id").join(low, "id").where(F.contains("low", F.col("needle"))).select("query_id", "id")
        if short.isEmpty():
            return sure
        held = self.live().join(low, "id")
        return sure.union(short.join(held, F.contains("low", F.col("needle"))).select("query_id", "id"))

    def best(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """queries (query_id, tokens, each once): query_id, id, score (the share of the query's weight that a text holds, a word weighing ln(1 + texts / texts with it)) of all texts that are among the k best or equal to the k-th, and, a row a query,
        how many postings the query's words have, how many candidates were opened and how many were left to be looked up.

        A query's rarest words give k texts and so a bound. Words that together weigh less can't bring a text up to it alone: they open no candidates and are only looked up for texts that the others leave in reach; so are
        blocks whose words add up to less. Needs an index whose replaced texts were merged away, as words count all postings."""
        if not self._docs().groupBy("id").agg(F.count("*").alias("c"), F.max_by("segment", "seq").isNull().alias("gone")).where("c > 1 or gone").isEmpty():
            raise ValueError("merge the index first")
        n = self.live().count()
        asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
        asked = stored(asked, "asked")
        # each word's lists once, however many queries ask for it
        lists = stored(self.table("word").join(asked.select("term").distinct(), "term", "left_semi").select("term", "block", "n", "ids"), "asked-blocks")
        df = lists.groupBy("term").agg(F.sum("n").alias("df"))
        weigh = asked.join(df, "term", "left").withColumn("w", F.log1p(F.when(F.col("df").isNull(), F.lit(float(n))).otherwise(F.lit(float(n)) / F.col("df"))))
        terms = stored(weigh.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))), "asked-terms")
        rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        first = terms.where("df is not null").withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < FIRST * k).select("query_id", "term", "w")
        partial = lists.join(first, "term").select("query_id", "w", F.explode("ids").alias("id")).groupBy("query_id", "id").agg(F.sum("w").alias("s"))
        kth = partial.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).where(F.col("r") == k).select("query_id", (F.col("s") - 1e-9).alias("bound"))
        light = Window.partitionBy("query_id").orderBy("w", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        told = terms.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).withColumn("upto", F.sum("w").over(light)).withColumn("opens", ~(F.col("upto") < F.col("bound")))
        told = stored(told, "weighed")
        b = lists.select("term", "block").join(told.select("query_id", "term", "w", "bound", "opens"), "term")
        most = b.groupBy("query_id", "block", "bound").agg(F.sum("w").alias("most"), F.bool_or("opens").alias("any")).where("any and most >= bound").select("query_id", "block")
        b = stored(b.join(most, ["query_id", "block"], "left_semi"), "kept-blocks").join(lists.select("term", "block", "ids"), ["term", "block"])
        rest = told.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("opens"), F.col("w"))), F.lit(0.0)).alias("rest"))
        groups = b.join(rest, "query_id").select("query_id", "block", "w", "opens", "bound", "rest", "ids").groupBy("query_id", "block")
        reached = stored(groups.applyInArrow(_reach, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id long, score double, opened long, kept long"), "reached")
        out = reached.where("id is not null")
        ranked = out.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9))))).where(F.col("r") <= k)
        counts = told.groupBy("query_id").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).join(reached.groupBy("query_id").agg(F.sum("opened").alias("opened"), F.sum("kept").alias("kept")), "query_id", "left")
        return ranked.select("query_id", "id", "score"), counts.select("query_id", "postings", F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("kept", F.lit(0)).alias("kept"))


def _masks(block: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for of, gone in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                mask = np.zeros(block, bool)
                mask[gone.values.to_numpy() - of * block] = True
                out.append(mask if mask.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.bool_()))], names=["block", "segment", "gone"])

    return run


def _shared(lists: list[np.ndarray]) -> np.ndarray:
    """What all sorted lists without repeats hold, the shortest first."""
    lists = sorted(lists, key=len)
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True)
    return out


def _told(rows, **columns):
    """The group's query and segment beside these columns."""
    import pyarrow as pa

    first = pa.array(np.zeros(len(columns["id"]), np.int64))
    return pa.table({"query_id": rows["query_id"].take(first), "segment": rows["segment"].take(first), **columns})


def _common(rows):
    rows = rows.combine_chunks()
    ids = _shared([x.values.to_numpy() for x in rows["ids"]])
    return _told(rows, id=ids)


def _reach(rows):
    """Of a query's lists in one block: the texts that the opened ones leave in reach, with what the others add, and, in a row of its own, how many were opened and left."""
    import pyarrow as pa

    rows = rows.combine_chunks()
    opens, w = rows["opens"].to_numpy().astype(bool), rows["w"].to_numpy()
    bound, rest = rows["bound"][0].as_py(), rows["rest"][0].as_py()
    lists = [x.values.to_numpy() for x in rows["ids"]]
    heavy = np.flatnonzero(opens)
    ids, at = np.unique(np.concatenate([np.zeros(0, np.int64), *[lists[i] for i in heavy]]), return_inverse=True)
    s = np.bincount(at, np.repeat(w[heavy], [len(lists[i]) for i in heavy]), len(ids))
    opened, left = len(ids), s + rest >= bound
    ids, s = ids[left], s[left]
    for i in np.flatnonzero(~opens):
        s = s + w[i] * np.isin(ids, lists[i], assume_unique=True)
    # a k-th best text has the bound at least
    near = s >= bound
    found = [*ids[near].tolist(), None]
    count = lambda n: pa.array([None] * (len(found) - 1) + [n], pa.int64())
    return pa.table({"query_id": rows["query_id"].take(pa.array(np.zeros(len(found), np.int64))), "id": pa.array(found, pa.int64()), "score": pa.array([*s[near].tolist(), None], pa.float64()), "opened": count(opened), "kept": count(len(ids))})


def _stand(rows):
    """Where a query's words stand one after the other: the starts that all of its places agree on."""
    import pyarrow as pa

    rows = rows.combine_chunks()
    k = rows["k"][0].as_py()
    ids = _shared([x.values.to_numpy() for x in rows["ids"]])
    starts = []
    for own, places, js in zip(rows["ids"], rows["positions"], rows["js"], strict=True):
        own, places = own.values.to_numpy(), places.values
        keep = np.flatnonzero(np.isin(own, ids, assume_unique=True))
        held = places.take(pa.array(keep))
        at = np.repeat(np.arange(len(keep)), held.value_lengths().to_numpy()).astype(np.int64) << 32 | (held.flatten().to_numpy().astype(np.int64) + k)
        starts += [at - j for j in js.as_py()]
    met, hits = np.unique(_shared(starts) >> 32, return_counts=True)
    return _told(rows, id=ids[met], hits=hits)


ship(__name__)
