"""Golden cases of what decides about keeping, deleting, recording and rolling out."""

import datetime as dt
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import repair
from palimpsest.functions import text as X
from palimpsest.operators import health, policy, projection, retrieval, rewrite, searchmap, sessions, shadow, similarity, telemetry, temporal
from palimpsest.sources import files, versioned
from palimpsest.streaming import twins

SESSION = "id string, parent_session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, end_reason string, source string, last_activity timestamp_ntz"
NOW = dt.datetime(2026, 6, 1)
def now():
    return F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")


def ago(days, seconds=0):
    return NOW - dt.timedelta(days=days, seconds=seconds)


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x")).first()[0]


def session(i, parent=None, start=200, end=None, reason=None, source="cli", last=200):
    return (i, parent, None if start is None else ago(start), None if end is None else ago(end), reason, source, last if last is None or isinstance(last, dt.datetime) else ago(last))


def test_retention_is_strict_and_counts_seconds(spark):
    rows = [
        session("exact", end=150, last=100), session("older", end=150, last=ago(100, 1)), session("younger", end=150, last=ago(99, 86_399)), session("open", last=101), session("kept", source="telegram", last=300),
        session("nowhere", source=None, last=300), session("unknown", last=None),
    ]
    got = {r.id: r.reason for r in sessions.retention_targets(spark.createDataFrame(rows, SESSION), now(), 100, 2, ["telegram"]).collect()}
    assert got == {"older": "closed", "open": "unclosed", "nowhere": "unclosed"}
    # what is protected as recent is measured by last activity and wins over a short retention
    assert {r.id for r in sessions.retention_targets(spark.createDataFrame([session("a", last=3), session("b", last=2)], SESSION), now(), 1, 2, []).collect()} == {"a"}


def test_compression_takes_the_top_of_a_chain(spark):
    """a is the original of b, b of c: a goes, b waits for the next run."""
    rows = [session("a", reason="compression"), session("b", "a", reason="compression"), session("c", "b")]
    s = spark.createDataFrame(rows, SESSION)
    none = s.limit(0)
    assert {r.id: r.state for r in sessions.compression_states(s, none, now(), 2, []).collect()} == {"a": "delete", "b": "deferred"}
    left, _ = sessions.cleanup(s.drop("last_activity"), spark.createDataFrame([], "session_id string"), spark.createDataFrame([("a",)], "id string"))
    assert {(r.id, r.parent_session_id) for r in left.collect()} == {("b", None), ("c", "b")}


def test_compression_guards(spark):
    rows = [
        session("young", start=1, reason="compression"), session("y1", "young"), session("blank", start=None, reason="compression"), session("b1", "blank"), session("kept", reason="compression", source="telegram"), session("k1", "kept"),
        session("alone", reason="compression"), session("pruned", reason="compression"), session("p1", "pruned"), session("half", reason="compression"), session("h1", "half"), session("h2", "half"),
    ]
    s = spark.createDataFrame(rows, SESSION)
    gone = s.where(F.col("id").isin("p1", "h1")).select("id")
    assert {r.id: r.state for r in sessions.compression_states(s, gone, now(), 2, ["telegram"]).collect()} == {"pruned": "demoted", "half": "delete"}


TURN = dict(savings=60, tokens=100, full_tokens=200, selected=3, skipped=1, over_budget=False, active_block="full", raw_blocks=False, source="memories-index:x", path="daemon", latency=100, hits=3, requested=5, pool=9, skipped_pins=0, safety_drops=0, answered=True, missing=0, critical_missing=0)


def gate(spark, turns, errors=0, violations=0):
    kinds = "savings int, tokens int, full_tokens int, selected int, skipped int, over_budget boolean, active_block string, raw_blocks boolean, source string, path string, latency int, hits int, requested int, pool int, skipped_pins int, safety_drops int, answered boolean, missing int, critical_missing int"
    s = telemetry.summary(spark.createDataFrame([tuple((TURN | t).values()) for t in turns], kinds))
    r = telemetry.gate_status(s.withColumn("errors", F.lit(errors)).withColumn("violations", F.lit(violations))).first()
    assert r.decision == r.status
    return r.status, r.failures, r.warnings


def test_rollout_gate(spark):
    good = [{}] * 20
    assert gate(spark, good) == ("PASS", [], [])
    assert gate(spark, [{"savings": 39}] * 20) == ("WARN", [], ["savings"])  # low savings never fail
    assert gate(spark, [{"savings": 40}] * 20)[0] == "PASS"
    assert gate(spark, [{}] * 19 + [{"path": "direct"}])[0] == "PASS"  # 95 % is enough
    assert gate(spark, [{}] * 18 + [{"path": "direct"}] * 2)[:2] == ("FAIL", ["daemon"])
    assert gate(spark, [{}] * 99 + [{"path": "subprocess"}])[1] == ["subprocess"]
    assert gate(spark, [{}] * 40 + [{"path": None}])[1] == ["telemetry"]
    assert gate(spark, [{"latency": 500}] * 6)[0] == "PASS" and gate(spark, [{"latency": 501}] * 6)[1] == ["latency"]
    assert gate(spark, [{}] * 4) == ("WARN", [], ["few_answers"]) and gate(spark, [{"answered": False}] * 6)[2] == ["no_answers"]
    assert gate(spark, [{}] * 5 + [{"missing": 1}])[2] == ["missing"] and gate(spark, [{}] * 9 + [{"missing": 1}])[0] == "PASS"
    assert gate(spark, [{}] * 5 + [{"source": "disabled:semantic"}])[2] == ["semantic"]
    for turn, name in (({"over_budget": True}, "over_budget"), ({"raw_blocks": True}, "raw_blocks"), ({"active_block": "projected"}, "active_block"), ({"safety_drops": 1}, "safety_pins"), ({"missing": 0, "critical_missing": 1}, "critical_pins")):
        assert gate(spark, [*good, turn])[:2] == ("FAIL", [name])
    assert gate(spark, good, errors=1)[1] == ["input_errors"] and gate(spark, good, violations=2)[1] == ["determinism"]
    assert gate(spark, [])[1] == ["no_events"]
    assert gate(spark, [*good, {"skipped_pins": 2}])[2] == ["skipped_pins"]


EVENT = "fact_key string, event_id long, seq long, op string, store string, content string, recorded_at string, valid_from string, valid_to string"


def test_record_after_a_deletion_and_by_stripped_content(spark):
    rows = [("create", "x"), ("update", " x\n"), ("delete", "x"), ("create", "x"), ("update", "x"), ("update", "y")]
    e = spark.createDataFrame([("a", i, i, op, "m", c, f"2024-01-0{i + 1}", None, None) for i, (op, c) in enumerate(rows)], EVENT)
    assert [r.event_id for r in temporal.record_runs(e).orderBy("seq").collect()] == [0, 2, 3, 5]


def test_match_and_ingest_keep_to_their_store(spark):
    known = spark.createDataFrame([("m", "k1", "h1", ["a", "b", "c"], "one"), ("u", "k2", "h2", ["d", "e", "f"], "two"), ("m", "k3", "h3", ["g", "h", "i"], "three")], "store string, fact_key string, hash string, tokens array<string>, content string")
    rows = [("m", 1, "h1", "zz", False, ["q"], "t1"), ("u", 2, "h1", "zz", False, ["q"], "t2"), ("m", 3, "x", "k1", False, ["q"], "t3"), ("m", 4, "x4", "new", False, ["d", "e", "f"], "t4"), ("u", 5, "x5", "new", False, ["d", "e", "f"], "t5"), ("u", 6, "x6", "new", True, ["d", "e", "f"], "t6")]
    e = spark.createDataFrame(rows, "store string, ref long, hash string, key string, is_pointer boolean, tokens array<string>, text string")
    got = {r.ref: (r.decision, r.fact_key) for r in temporal.match(e, known, F.col("tokens"), 0.6).collect()}
    assert got == {1: ("DUPLICATE", "k1"), 2: ("NEW", "zz"), 3: ("UPDATE", "k1"), 4: ("NEW", "new"), 5: ("UPDATE", "k2"), 6: ("NEW", "new")}
    archived = spark.createDataFrame([("k3", "old three", "2024-01-02"), ("k3", "older", "2024-01-01")], "fact_key string, content string, archived_at string")
    out = {(r.store, r.fact_key): (r.op, r.content) for r in temporal.ingest(e, known, archived, 0.6).collect()}
    assert out["m", "k1"] == (None, "t1") and out["m", "k1-2"] == ("create", "t3") and out["u", "k2"] == ("update", "t5")
    assert out["m", "k3"] == ("archive", "old three") and ("u", "zz") in out


def test_differences(spark):
    e = spark.createDataFrame([("a", 1, 1, "create", "m", "one. two; three", "2024-01-01", None, None), ("a", 2, 2, "update", "m", "one. 2; three", "2024-01-05", None, None), ("b", 3, 3, "create", "m", " x\t", "2024-01-01", None, None), ("b", 4, 4, "update", "m", "x", "2024-01-05", None, None), ("c", 5, 5, "create", "m", "", "2024-01-05", None, None)], EVENT)
    v = temporal.versions(e)
    got = {r.fact_key: r for r in temporal.changed_between(v, F.lit("2024-01-02"), F.lit("2024-01-06"), unified=True).collect()}
    assert (got["a"].removed, got["a"].added, got["a"].changed, got["a"].from_version, got["a"].to_version) == (["two;"], ["2;"], True, 1, 2)
    assert "-two;" in got["a"].unified and "+2;" in got["a"].unified
    assert not got["b"].changed and not got["c"].changed and got["c"].from_version is None


def test_restore_and_guards(spark):
    e = spark.createDataFrame([("a", 1, 1, "create", "m", "one", "2024-01-01", None, None), ("a", 2, 2, "update", "m", "x\n§\ny", "2024-01-05", None, None)], EVENT)
    v = temporal.versions(e)
    assert [(r.version, r.refused) for r in temporal.restore(v).collect()] == [(2, "delimiter")]
    assert [(r.version, r.refused) for r in temporal.restore(v, version=1, limit=2).collect()] == [(1, "length")]
    assert [r.version for r in temporal.restore(v, at=F.lit("2024-01-02")).collect()] == [1]
    with pytest.raises(ValueError):
        temporal.rebuild_guard(e.limit(0), 3, 3, log_exists=False)
    temporal.rebuild_guard(e.limit(0), 3, 3, log_exists=False, force=True)


def test_dates(spark):
    read = lambda t: one(spark, temporal.parse_dt(F.col("t")), t=t)
    assert read("2024-05-06") == "2024-05-06T00:00:00+00:00" and read(" 1700000000 ") == "2023-11-14T22:13:20+00:00"
    assert read("2024-05-06T07:08:09.5Z") == "2024-05-06T07:08:09+00:00" and read("2024-05-06T07:08:09+02:00") == "2024-05-06T05:08:09+00:00"
    assert read("2024-05-06 07:08:09") == "2024-05-06T07:08:09+00:00" and read("soon") is None and read("") is None


def test_capacity(spark):
    rows = [("a", 100, 10, 1000), ("b", 100, 30, 1000), ("c", 100, 36, 1000), ("d", 850, 1, 1000), ("e", None, None, 1000)]
    got = {r.store: r.status for r in health.capacity(spark.createDataFrame(rows, "store string, chars int, entries int, char_limit int")).collect()}
    assert got == {"a": "ok", "b": "warning", "c": "critical", "d": "warning", "e": "unknown"}
    checks = lambda *s: health.rollup(spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(s)], "check string, status string")).first()
    assert checks("ok", "unknown", "warning").status == "unknown" and checks("ok", "warning", "unknown").status == "warning" and checks("warning", "critical").alerts == ["c0", "c1"]
    live = spark.createDataFrame([(s, i, t) for s in "wxyz" for i, t in ((0, "a b"), (1, "c"))], "store string, at int, text string")
    other = spark.createDataFrame([("w", 0, "a b"), ("w", 1, "c"), ("x", 0, "ab"), ("x", 1, "c"), ("y", 0, "c"), ("y", 1, "a b"), ("z", 0, "a b"), ("z", 1, "d")], "store string, at int, text string")
    assert {r.store: r.drift for r in health.store_drift(live, other).collect()} == {"w": "exact", "x": "whitespace", "y": "order", "z": "content"}


def test_lexical_order(spark):
    hits = spark.createDataFrame([(1, 5, 0.50004), (1, 6, 0.50001), (1, 7, 0.4), (1, 8, 1.7)], "query_id long, id long, score double")
    hashes = spark.createDataFrame([(5, "b"), (6, "a"), (7, "c"), (8, "d")], "id long, hash string")
    assert [(r.id, r.score) for r in retrieval.ranked_relevance(hits, hashes).orderBy("rank").collect()] == [(8, 1.0), (6, 0.5), (5, 0.5), (7, 0.4)]


@pytest.mark.parametrize("seed", range(3))
def test_pruned_knapsack_equals_the_plain_one(spark, seed):
    r = random.Random(seed)
    rows = [(g, i, g * 1000 + i, r.randint(1, 9), r.choice([0.0, 0.1, 0.2, 0.9, r.random()]), room) for g, room in ((1, 20), (2, 7), (3, 4000)) for i in range(60)]
    got = {(x.grp, x.ref) for x in projection.knapsack(spark.createDataFrame(rows, "grp long, ord long, ref long, tokens int, score double, room int")).collect()}
    want = set()
    for g, room in ((1, 20), (2, 7), (3, 4000)):
        own = [x for x in rows if x[0] == g]
        want |= {(g, own[i][2]) for i in projection.best_subset([x[3] for x in own], [max(0, round(x[4] * 100_000)) for x in own], room)}
    assert got == want


def test_top_k_by_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4 if i % 3 else 5)]) for i in range(60)] + [(90, [0.0] * 4)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    told = lambda **k: sorted((x.query_id, x.id, x["rank"]) for x in retrieval.vector_topk(v, q, 3, **k).collect())
    assert told() == told(sent=200) and len(told()) == q.count() * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_equals_brute_force(spark, seed):
    r = random.Random(seed)
    sets = lambda n: [(i, r.sample("abcdefghijkl", r.randint(0, 8))) for i in range(n)]
    left, right = sets(50), sets(30)
    sim = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) & set(y) else 0.0
    for t in (0.0, 0.4, 0.6):
        best = {i: min(((-sim(x, y), j) for j, y in right if sim(x, y) >= max(t, 1e-9)), default=None) for i, x in left}
        got = {x.id: x.best_id for x in similarity.nearest(spark.createDataFrame(left, "id long, tokens array<string>"), spark.createDataFrame(right, "id long, tokens array<string>"), t).collect()}
        assert got == {i: b[1] for i, b in best.items() if b}


def test_search_map(spark):
    q = spark.createDataFrame([(1, "what did we decide last time about tabs"), (2, "zzz")], "query_id long, question string")
    topics = spark.createDataFrame([("memory-entry", "t", "~/m", "user_memory", ["tabs", "spaces"])], "lane string, key string, where string, source string, terms array<string>")
    stores = spark.createDataFrame([("semantic_memories", "ok"), ("semantic_sessions", "ok"), ("temporal", "stale")], "store string, availability string")
    ranked = searchmap.rank(q, searchmap.topic_matches(q, topics), stores, spark.createDataFrame([("temporal", -0.1)], "lane string, adjustment double"))
    packets = {r.query_id: r for r in searchmap.route_packets(ranked).collect()}
    assert packets[1].recommended_lane == "session-semantic" and packets[1].matched and packets[1].query_terms == ["decide", "last", "tabs", "time"]
    assert packets[2].recommended_lane == "memory-entry" and not packets[2].matched and packets[2].confidence == 1.0
    bare = spark.createDataFrame([("hot_memory", False, None, None, None)], "store string, present boolean, status string, fresh boolean, daemon string")
    assert searchmap.doctor(bare).first().status == "FAIL"


def test_answer_usage(spark):
    answers = spark.createDataFrame([(1, "Use tabs as in MEMORY.md#7 and look into ~/notes/plan.md"), (2, ""), (3, None)], "answer_id long, answer string")
    entries = spark.createDataFrame([(7, "memory.md#7", "unrelated words entirely", True), (8, "memory.md#8", "plan lives at ~/notes/plan.md somewhere else", False), (9, "memory.md#9", "nothing alike", False)], "ref long, label string, text string, selected boolean")
    got = {r.ref: (r.reason, r.path_hits) for r in shadow.usage(answers, entries).collect()}
    assert got == {7: ("path/label", []), 8: ("path/label", ["/notes/plan.md"])}
    assert shadow.usage_counts(shadow.usage(answers, entries)).first().asDict() == {"answer_id": 1, "used": 2, "used_selected": 1, "used_missing": 1}


def test_policies(spark):
    flags = ", ".join(f"{c} boolean" for c in policy.FLAGS)
    rows = [("v1", 30, 2, True, False, False, False, True, False, False), ("v1", None, 0, False, True, None, False, False, False, False), ("v0", 3, -1, True, False, True, False, False, False, True), ("v1", None, None, *[False] * 7)]
    got = [(r.errors, r.warnings, r.noop) for r in policy.judged(spark.createDataFrame(rows, f"schema string, retention_days int, protect_recent_days int, {flags}"), "v1").collect()]
    assert got[0] == ([], [], False) and got[3] == ([], [], True)
    assert got[1] == (["retention_missing", "delete_compression_parents_not_boolean"], ["prunes_unclosed", "no_vacuum"], False)
    assert got[2] == (["schema", "protect_recent_negative"], ["aggressive_retention", "drops_originals", "targets_snapshots", "no_vacuum"], False)


def test_repair(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'so: {"a": "}"} then {"b": {"c": 2}} ok': '{"b": {"c": 2}}', "no {json": None, "": None, '{bad} {"x": []} {worse}': '{"x": []}', '[1, 2]': "[1, 2]"}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.x for r in rows.select("t", repair.json_in(F.col("t")).alias("x")).collect()} == cases | {None: None}
    assert one(spark, repair.facts_in(F.col("t")), t='{"facts": [" a ", "", {"p": "b", "q": "c"}, 7]}') == ["a", "b; c", "7"]
    assert one(spark, repair.facts_in(F.col("t")), t='["a"]') == ["a"] and one(spark, repair.facts_in(F.col("t")), t="nothing") == []


def test_merges_archives_and_keys(spark):
    rows = [(1, "m", "Old: one thing", "merge", "merge_absorb", None), (2, "m", "Old: one thing more", "keep", "keep", "Old: one thing more"), (3, "m", "gone " * 30, "remove_after_archive", "remove", None), (4, "m", "lost", "merge", "merge_absorb", None)]
    d = spark.createDataFrame(rows, "ref long, store string, text string, action string, rewrite string, new_text string")
    out = {r.ref: r for r in rewrite.with_merges(d, spark.createDataFrame([(1, 2), (4, 99)], "loser long, winner long")).collect()}
    assert out[2].absorbs == [1] and out[1].merge_into == 2 and (out[4].rewrite, out[4].new_text) == ("review", "lost")
    assert [(r.ref, r.kind, r.destination) for r in rewrite.archives(d, "2024-06-01", "~/a/").collect()] == [(3, "note", "~/a/2024-06-01-m-3-gone-gone-gone-gone-gone-gone.md")]
    m = rewrite.manifest(d).first()
    assert (m.entries, m.entries_after, m.grew) == (4, 1, False) and m.chars == sum(len(r[2]) for r in rows) + 9
    facts = spark.createDataFrame([("m", "k", "none", 1, 1)], "store string, fact_key string, hash string, version int, is_current int")
    assert {(r.ref, r.fact_key, r.op) for r in rewrite.resolve_facts(d, facts).collect()} >= {(1, "old", "archive")}


def test_lines_and_defaults(spark, tmp_path):
    lines = [json.dumps({"fact_key": "a", "content": "x y"}, ensure_ascii=False), "", "{torn", json.dumps({"fact_key": "b", "content": "z", "seq": 9, "valid_from": "2024-01-01T00:00:00+00:00"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines), encoding="utf-8")
    events, bad = files.read_event_log(spark, str(tmp_path / "log.jsonl"))
    got = {r.fact_key: r for r in events.collect()}
    assert got["a"].content == "x y" and got["a"].seq == 1 and got["a"].recorded_at and got["b"].seq == 9 and got["b"].recorded_at == "2024-01-01T00:00:00+00:00"
    assert [(r["at"], r.line) for r in bad.collect()] == [(2, "{torn")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        (tmp_path / "long.jsonl").write_text("\n".join(f"line {i}" for i in range(200)))
        assert [(r["at"], r.line) for r in files._lines(spark, str(tmp_path / "long.jsonl")).orderBy("at").collect()] == [(i, f"line {i}") for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stores_are_found_and_written(spark, tmp_path):
    (tmp_path / "profiles" / "p").mkdir(parents=True)
    (tmp_path / "backup").mkdir()
    sqlite3.connect(tmp_path / "profiles" / "p" / "state.db").execute("CREATE TABLE t (x)").connection.commit()
    (tmp_path / "backup" / "other.db").write_text("no")
    got = {r.path.rpartition("/")[2]: (r.role, r.is_sqlite) for r in files.discover_stores(spark, str(tmp_path)).collect()}
    assert got == {"state.db": ("profile", True), "other.db": ("backup", False)}
    archives = spark.createDataFrame([("a", "body a"), ("b", "body b")], "slug string, body string")
    told = files.archive_first(archives, str(tmp_path / "arch"), str(tmp_path / "man")).collect()
    assert {(r.slug, r.matches) for r in told} == {("a", True), ("b", True)}
    entries = spark.createDataFrame([("m", "fine"), ("m", "x\n§\ny"), ("m", " ")], "store string, text string")
    assert {r.text for r in files.append_hot(entries, str(tmp_path / "hot"), "me").collect()} == {"x\n§\ny", " "}
    assert [(r.text, r.actor) for r in versioned.read_table(spark, str(tmp_path / "hot")).collect()] == [("fine", "me")] and files.provenance(spark, str(tmp_path / "hot")).count() == 1
    two = files.concatenated(entries.limit(1), entries.limit(1))
    assert [r.store_at for r in two.orderBy("store_at").collect()] == [0, 1]


def test_small_text_functions(spark):
    assert [one(spark, X.human_bytes(F.col("n")), n=n) for n in (0, 1023, 1024, 2304, 5 << 20)] == ["0 B", "1023 B", "1.0 KB", "2.2 KB", "5.0 MB"]
    assert one(spark, X.shown_path(F.col("p"), "/home/me"), p="/home/me/x") == "~/x" and one(spark, X.shown_path(F.col("p"), "/home/me"), p="/home/men") == "/home/men"
    assert one(spark, X.audit_key(F.col("t")), t="↪ Update: new plan here") == "plan-here" or one(spark, X.audit_key(F.col("t")), t="↪ Update: new plan here").startswith("update")
    assert one(spark, X.bag_cosine(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == pytest.approx(2**-0.5)


def test_late_events_are_passed_over(spark, tmp_path):
    kind = "fact_key long, event_id long, content string, recorded_at timestamp"
    t = lambda h: dt.datetime(2024, 1, 1, h)
    for name, rows in (("a", [(1, 1, "x", t(1)), (1, 3, "z", t(5))]), ("b", [(1, 2, "late", t(3)), (1, 4, "w", t(7))])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        twins.closed_versions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.version, r.content, r.superseded_by) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "x", 3), (2, "z", 4)]
