"""Exact Jaccard join of documents on word shingles, by a grouped prefix join.

All sets are ordered by one global order: shingles that few documents hold first, by hash, and common ones last, by how many
hold them. Two sets that are similar enough must share a shingle of their prefixes, and the prefix of n shingles is n - ceil(t n) + 1 long. Documents with an
identical prefix and size form a group; a group's prefix is posted once, whatever the number of its members.
Of the groups that share a posted shingle, pairs that fail the size or the position bound are left out, the others are
expanded to their members, and members are verified on their whole sets.

As a class needs only enough links to hold together, the pairs are taken in turns. First each posting list's
lead (the member with the fewest rare shingles, which is the one nearest to what the list's members are copies of) is paired with the others (as many pairs as postings). Lists whose members are then
all in one component are done. Where many members are outside their lists' largest components, LEADS members of that component are tried with those outside, each in one of its lists, as
long as that helps (a turn makes LEADS pairs for such a member at most). In what is left then,
members outside the list's largest component are paired with all members of other components, except where what is known of both against the list's lead rules a link out: the
triangle inequality of the Jaccard distance, and the shingles that one lacks of the lead, or has besides it, and the other doesn't, counted from below by maps of BITS bits. No link between components is
lost, and no list of n members that are alike makes more than a few times n pairs.

Common shingles: every shingle is counted. A task adds up what it has read before it sends (value, count) runs to be merged by hash range, so
a shingle of every document is a row for each RUN different ones. Those in more than HOT documents
are sent to all tasks, the most frequent FREQUENT of them if there are more (the order is then less sharp, the result the same).

A set holds the text's distinct shingles of WIDTH words (A-Z lower-cased, ASCII white space between); a text of fewer words is one shingle; without
words or text it is empty and links with nothing. Rows that repeat are in one component. Rows of a null id get their text's component where a row with an id
has the same text, or links; their component is null if no id is in it. An empty table gives an empty result. Extra columns are left alone.
Sets are told apart by 128 bits of sums of hashes (two that agree in the 64 bits used as a set's number are numbered anew) and shingles by 48 bits within a pair.
Prefix groups whose 40-bit number agrees are listed under the shingles of either, which makes candidates and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, ship, shared_dir, stash, text_of
from .components import components
from .shingles import add_up, mix, pack, pack_counts, release, steps, unpack, unpack_counts

WIDTH, NEAR = 5, 75
#: Members outside its largest component that a list may have when what is left is looked at pair by pair; leads of a turn; turns at most.
FEW, LEADS, TURNS = 4, 8, 3
#: Posted shingles before a shared one by which a pair is known to have been met.
LOOK_BACK = 8
#: Rows of text, and of pairs of whole sets, that go to a Python worker at once.
TEXTS, SETS = 1000, 250
HOT, FREQUENT, STEP, SENT = 24, 1 << 20, 2 << 20, 1 << 20
#: Bits of the maps of what a set has and another hasn't.
BITS = 256
#: Different shingles that a task holds before it sends their counts.
RUN = 1 << 19
_LOW, _A, _B = np.uint64(16), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _ranges(df: DataFrame) -> int:
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bounds(sorted_values: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal parts of the 48-bit space begins in sorted values."""
    edges = (np.arange(ranges + 1, dtype=np.float64) * ((1 << 48) / ranges)).astype(np.uint64)
    edges[-1] = np.uint64(1 << 48)
    return np.searchsorted(sorted_values, edges)


def frequent_shingles(texts: DataFrame, width: int, hot: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes, sorted, of shingles in more than `hot` rows, and their counts; at most `most` of them."""
    ranges = _ranges(texts)

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        values, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def told():
            at = _bounds(values, ranges)
            full = np.flatnonzero(np.diff(at))
            cut = [slice(at[r], at[r + 1]) for r in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([pack(values[c]) for c in cut], pa.binary()), pa.array([pack_counts(times[c]) for c in cut], pa.binary())], names=["range", "run", "times"])

        for batch in batches:
            for _, _, sets in steps(batch.column(0), STEP):
                new, k = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> _LOW, return_counts=True)
                values, times = add_up(np.concatenate([values, new]), np.concatenate([times, k]))
                if len(values) >= RUN:
                    yield told()
                    values, times = values[:0], times[:0]
        if len(values):
            yield told()
        release()

    def merge(part):
        import pyarrow as pa

        values, times = add_up(np.concatenate([unpack(x.as_py()) for x in part["run"]]), np.concatenate([unpack_counts(x.as_py()) for x in part["times"]]).astype(np.int64))
        keep = times > hot
        return pa.table({"hash": pa.array(values[keep].astype(np.int64)), "times": pa.array(times[keep])})

    counted = stash(texts.mapInArrow(runs, "range long, run binary, times binary").groupBy("range").applyInArrow(merge, "hash long, times long"), "hot-shingles", TEXTS)
    if counted.count() > most:
        counted = counted.orderBy(F.desc("times"), "hash").limit(most)
    found = counted.toArrow()
    hashes, times = np.asarray(found["hash"], dtype=np.uint64), np.asarray(found["times"], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def prefix_of(values: np.ndarray, near: int, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set under the global order, and how many of the set's shingles aren't frequent."""
    n = len(values)
    p = n - -(-near * n // 100) + 1
    if not len(hashes):
        return values[:p], n
    tokens = values >> _LOW
    at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
    hot = hashes[at] == tokens
    cold = values[~hot]
    if len(cold) >= p:
        return cold[:p], len(cold)
    warm = values[hot]
    return np.concatenate([cold, warm[np.lexsort((warm, times[at[hot]]))][: p - len(cold)]]), len(cold)


def _sums(values: np.ndarray) -> tuple[int, int]:
    one, two = mix(values * _A), mix(values * _B)
    return int(one.sum(dtype=np.uint64).astype(np.int64)), int(two.sum(dtype=np.uint64).astype(np.int64))


def post(docs: DataFrame, near: int, hashes: np.ndarray, times: np.ndarray) -> DataFrame:
    """docs (doc_id, text, key). Two kinds of row: per document doc_id, key, n, the two sums of its set, grp and cold (its shingles that aren't frequent); per run of documents and
    hash range the posted shingles with their groups and positions, a prefix posted once a task."""
    spark, ranges = docs.sparkSession, _ranges(docs)
    sent = spark.sparkContext.broadcast((hashes, times))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hot, often = sent.value
        seen = set()
        for batch in batches:
            for start, end, sets in steps(batch.column(1), STEP):
                n, ones, twos, group, colds, tokens, owner, place = [], [], [], [], [], [], [], []
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        ones.append(None)
                        twos.append(None)
                        group.append(None)
                        colds.append(None)
                        continue
                    one, two = _sums(s)
                    head, cold = prefix_of(s, near, hot, often)
                    first, last = _sums(head)
                    g = int(mix(np.array([last & ((1 << 64) - 1)], np.uint64) + np.uint64(len(s)))[0] >> np.uint64(24))
                    ones.append(one)
                    twos.append(two)
                    group.append(g)
                    colds.append(cold)
                    if (g, first) not in seen:
                        seen.add((g, first))
                        tokens.append(head >> _LOW)
                        owner.append(np.full(len(head), g, np.int64))
                        place.append(np.arange(len(head)))
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start).cast(pa.int64()), batch.column(2).slice(start, end - start), pa.array(n, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(group, pa.int64()), pa.array(colds, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())],
                    names=names,
                )
                if not tokens:
                    continue
                token, who, pos = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
                order = np.argsort(token, kind="stable")
                token, who, pos = token[order], who[order], np.minimum(pos[order], 65535).astype(np.uint16)
                who = np.ascontiguousarray(who.view(np.uint8).reshape(-1, 8)[:, :5])
                at = _bounds(token, ranges)
                full = np.flatnonzero(np.diff(at))
                k, cut = len(full), [slice(at[r], at[r + 1]) for r in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int64())] * 7 + [pa.array(full, pa.int64()), pa.array([pack(token[c]) for c in cut], pa.binary()), pa.array([who[c].tobytes() for c in cut], pa.binary()), pa.array([pos[c].tobytes() for c in cut], pa.binary())],
                    names=names,
                )
        release()

    names = ["doc_id", "key", "n", "one", "two", "grp", "cold", "range", "tokens", "owners", "places"]
    return stash(docs.mapInArrow(run, "doc_id long, key long, n long, one long, two long, grp long, cold long, range long, tokens binary, owners binary, places binary"), "posted", TEXTS)


def shared_postings(posted: DataFrame) -> DataFrame:
    """token, grp, pos for the shingles that at least two groups post."""

    def merge(part):
        import pyarrow as pa

        token = np.concatenate([unpack(x.as_py()) for x in part["tokens"]])
        raw = np.frombuffer(b"".join(x.as_py() for x in part["owners"]), np.uint8).reshape(-1, 5)
        who = np.zeros((len(raw), 8), np.uint8)
        who[:, :5] = raw
        who = who.view(np.int64).ravel()
        pos = np.frombuffer(b"".join(x.as_py() for x in part["places"]), np.uint16)
        order = np.argsort(token, kind="stable")
        t = token[order]
        again = np.zeros(len(t), dtype=bool)
        again[1:] = t[1:] == t[:-1]
        again[:-1] |= again[1:]
        order = order[again]
        token, who, pos = token[order], who[order], pos[order]
        order = np.lexsort((pos, who, token))
        token, who, pos = token[order], who[order], pos[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
        token, who, pos = token[new], who[new], pos[new]
        more = np.zeros(len(token), dtype=bool)
        more[1:] = token[1:] == token[:-1]
        more[:-1] |= more[1:]
        return pa.table({"token": pa.array(token[more].astype(np.int64)), "grp": pa.array(who[more]), "pos": pa.array(pos[more].astype(np.int32))})

    return posted.where(F.col("range").isNotNull()).select("range", "tokens", "owners", "places").groupBy("range").applyInArrow(merge, "token long, grp long, pos int")


def _likely(a: str, b: str, near: int):
    """Size and position bounds of two list members."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (100 * F.least(na, nb) >= near * F.greatest(na, nb)) & ((100 + near) * left >= near * (na + nb))


def verify(pairs: DataFrame, units: DataFrame, docs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) of set numbers with na, nb, both (the size of the intersection) and maps of lost (what a has and b hasn't) and new (the reverse); and all whole sets read so far, of
    which known are at hand."""
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    if known is not None:
        wanted = wanted.join(known.select("set"), "set", "left_anti")
    wanted = stash(wanted.join(units.select("set", "at", "one", "two"), "set").select("at", "set", "one", "two"), "wanted")
    if wanted.count() <= SENT:  # four longs a row
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end, found in steps(batch.column(3), STEP):
                code = zip(*[batch.column(i).slice(start, end - start).to_pylist() for i in range(3)], strict=True)
                mine = [(c[0], s) for c, s in zip(code, found, strict=True) if len(s) and _sums(s) == c[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in mine], pa.int64()), pa.array([len(s) for _, s in mine], pa.int64()), pa.array([pack(s >> _LOW) for _, s in mine], pa.binary())], names=["set", "n", "values"])
        release()

    whole = docs.withColumn("at", F.coalesce("doc_id", "key")).join(wanted, "at").select("set", "one", "two", "text").mapInArrow(sets, "set long, n long, values binary")
    whole = stash(whole.dropDuplicates(["set"]), "sets", TEXTS)
    whole = whole if known is None else known.unionByName(whole)

    def bits(values):
        out = np.zeros(BITS, dtype=bool)
        out[(values % np.uint64(BITS)).astype(np.int64)] = True
        return np.packbits(out).view(np.int64)

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held, x, both, lost, new = None, None, [], [], []
            a, va, vb = batch.column("a").to_pylist(), batch.column("va"), batch.column("vb")
            for i in range(batch.num_rows):
                if a[i] != held:
                    held, x = a[i], unpack(va[i].as_py())
                y = unpack(vb[i].as_py())
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                hit = x[at] == y
                alone = np.ones(len(x), dtype=bool)
                alone[at[hit]] = False
                both.append(int(hit.sum()))
                lost.append(bits(x[alone]))
                new.append(bits(y[~hit]))
            words = lambda rows: pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (BITS // 64), np.concatenate([*rows, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(both, pa.int64()), words(lost), words(new)], names=["a", "b", "na", "nb", "both", "lost", "new"])
        release()

    right = pairs.join(whole.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb")), "b")
    full = right.join(whole.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("values").alias("va")), "a")
    met = full.select("a", "b", "na", "nb", "va", "vb").mapInArrow(meet, "a long, b long, na long, nb long, both long, lost array<long>, new array<long>")
    return stash(met, "tried", SETS), whole


def _linked(near: int):
    return 100 * F.col("both") >= near * (F.col("na") + F.col("nb") - F.col("both"))


def _leads(sided: DataFrame, turn: int) -> DataFrame:
    """token, set, n, pos of LEADS members of the largest component of each list that has more than FEW outside, others each turn, those of the fewest rare shingles first."""
    least = F.struct("cold", F.xxhash64(F.lit(turn), "set").alias("h"), "set", "n", "pos")
    busy = sided.where("busy and not minor").groupBy("token", F.pmod(F.xxhash64(F.lit(turn), F.lit(5), "set"), F.lit(LEADS)).alias("j")).agg(F.min(least).alias("f"))
    return busy.select("token", "f.set", "f.n", "f.pos")


def _star(sided: DataFrame, leads: DataFrame, near: int) -> DataFrame:
    """Leads with the members of other components; a member is tried in the list in which most others are, as its other lists have much the same leads."""
    outside = sided.where("busy and minor").groupBy("set").agg(F.max_by(F.struct("token", "n", "pos"), F.struct("outside", "token")).alias("x")).select("set", "x.*")
    met = outside.alias("x").join(leads.alias("f"), "token").where(_likely("x", "f", near))
    return met.select(F.col("f.set").alias("a"), F.col("x.set").alias("b")).distinct()


def _merged(held: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after one step along new links; what it doesn't join yet is joined by the next full run."""
    of = lambda x: held.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
    step = ends.groupBy(F.greatest("x", "y").alias("component")).agg(F.min(F.least("x", "y")).alias("to"))
    alone = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(held, "node", "left_anti").withColumn("component", F.col("node"))
    return held.unionByName(alone).join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _apart(near: int):
    """Whether x and y, of one list, may link by what is known of them against the list's lead; true where one of them is unknown.

    Of the lead's shingles x has those that y lacks and x doesn't; of the others it has its own new ones. Bits that one map has and the other hasn't stand for different shingles."""
    only = lambda p, q: sum((F.bit_count(F.get(p, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(q, F.lit(i))))) for i in range(BITS // 64)), F.lit(0))
    x_alone = only(F.col("y.lost"), F.col("x.lost")) + only(F.col("x.new"), F.col("y.new"))
    y_alone = only(F.col("x.lost"), F.col("y.lost")) + only(F.col("y.new"), F.col("x.new"))
    most = F.least(F.col("x.n") - x_alone, F.col("y.n") - y_alone)
    close = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 1 - near / 100 + 1e-9, F.lit(True))
    return close & F.coalesce((100 + near) * most >= near * (F.col("x.n") + F.col("y.n")), F.lit(True))


def _rest(sided: DataFrame, first: DataFrame, tried: DataFrame, near: int) -> DataFrame:
    """Every pair of a list's members in different components that nothing rules out."""
    met = tried.select("a", F.col("b").alias("set"), (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("far"), "lost", "new")
    none, own = F.array(*[F.lit(0).cast("long")] * (BITS // 64)), F.col("a") == F.col("set")
    away = sided.join(first.select("token", F.col("set").alias("a")), "token").join(met, ["a", "set"], "left")
    away = away.withColumns({"far": F.when(own, 0.0).otherwise(F.col("far")), "lost": F.when(own, none).otherwise(F.col("lost")), "new": F.when(own, none).otherwise(F.col("new"))})
    # where two members also share one of the shingles just before, they were met there already: a pair that shares many comes out about once
    before = F.collect_list("token").over(Window.partitionBy("set").orderBy("pos", "token").rowsBetween(-LOOK_BACK, -1))
    away = stash(away.withColumn("before", before).select("before", "token", "set", "n", "pos", "component", "far", "lost", "new", "minor"), "away")
    x, y = away.where("minor").alias("x"), away.alias("y")
    once = (~F.col("y.minor") | (F.col("x.set") < F.col("y.set"))) & ~F.arrays_overlap("x.before", "y.before")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & _likely("x", "y", near) & once & _apart(near))
    return pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()


def text_key(text: str) -> Column:
    """By what rows of one id, or of none, are told apart."""
    return F.xxhash64(text_of(text))


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", near: int = NEAR, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id and links (of its text with other texts that were verified) for each row of docs."""
    out = classes(docs, text, doc_id, near, hot)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.col("component_id"), F.when(F.col("set").isNull(), F.col("doc_id"))).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", near: int = NEAR, hot: int = HOT) -> DataFrame:
    """doc_id, key, n, set, component (a set's number, null for an empty set), component_id and links for each row of docs."""
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), text_key(text).alias("key"))
    hashes, times = frequent_shingles(docs.select("text"), WIDTH, hot, FREQUENT)
    posted = post(docs, near, hashes, times)
    rows = posted.where(F.col("range").isNull()).select("doc_id", "key", "n", F.col("one").alias("set"), "one", "two", "grp", "cold")
    twins = stash(rows.groupBy("one").agg(F.min("two").alias("least"), F.max("two").alias("last")).where("least <> last").select("one", F.lit(True).alias("twin")), "twins")
    if not twins.isEmpty():
        rows = rows.join(twins, "one", "left").withColumn("set", F.when(F.col("twin"), F.xxhash64("one", "two")).otherwise(F.col("one"))).drop("twin")
    units = stash(rows.where(F.col("set").isNotNull()).groupBy("set", "one", "two", "grp", "n", "cold").agg(F.min("doc_id").alias("one_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("at")), "units")
    groups = units.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select(F.col("grp").alias("token"), "grp", F.lit(0).alias("pos"))
    lists = stash(shared_postings(posted).unionByName(groups).join(units.select("grp", "set", "n", "cold"), "grp").select("token", "set", "n", "cold", "pos"), "lists", TEXTS)
    first = lists.groupBy("token").agg(F.min(F.struct("cold", "set", "n", "pos")).alias("f")).select("token", "f.*")
    star = lists.alias("x").join(first.alias("f"), "token").where((F.col("x.set") != F.col("f.set")) & _likely("x", "f", near))
    tried, whole = verify(stash(star.select(F.col("f.set").alias("a"), F.col("x.set").alias("b")).distinct(), "pairs"), units, docs)
    before, turn = float("inf"), 0
    held = stash(components(tried.where(_linked(near)).select("a", "b")), "components")
    while True:
        # the lists that still hold more than one component
        part = lists.join(held.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        inside = part.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "component")).alias("major"), F.sum("k").alias("members"), F.count("*").alias("parts"))
        outside = F.col("members") - F.col("major.k")
        busy = (outside > FEW) & (F.col("major.k") > 1)
        mixed = inside.where("parts > 1").select("token", F.col("major.component").alias("major"), busy.alias("busy"), F.when(busy, outside).otherwise(0).alias("outside"))
        sided = stash(part.join(mixed, "token").select(*lists.columns, "component", "busy", "outside", (F.col("component") != F.col("major")).alias("minor")), "open-lists")
        lists = sided.select(*lists.columns)
        # outside stands at each member of a list: its sum is the pairs that the busy lists could make
        members, pending = sided.agg(F.count("*"), F.coalesce(F.sum("outside"), F.lit(0))).first()
        if not members:
            break
        last = turn == TURNS or pending <= FEW * members or pending > 0.5 * before
        pairs = _rest(sided, first, tried, near) if last else _star(sided, stash(_leads(sided, turn), "leads"), near)
        seen = tried.select("a", "b").union(tried.select("b", "a"))
        pairs = stash(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        more, whole = verify(pairs, units, docs, whole)
        tried = tried.unionByName(more)
        if last:
            break
        held = stash(_merged(held, more.where(_linked(near)).select("a", "b")), "components")
        before, turn = pending, turn + 1
    links = tried.where(_linked(near)).select("a", "b")
    held = stash(components(links), "components")
    least = units.groupBy("set").agg(F.min("one_id").alias("one_id"))
    label = least.join(held.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    final = label.groupBy("component").agg(F.min("one_id").alias("component_id"))
    degree = links.select(F.col("a").alias("s")).union(links.select(F.col("b").alias("s"))).groupBy("s").agg(F.count("*").alias("links"))
    told = label.join(final, "component").join(degree, F.col("set") == F.col("s"), "left").select("set", "component", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(told, "set", "left").select("doc_id", "key", "n", "set", "component", "component_id", "links")


ship(__name__)
