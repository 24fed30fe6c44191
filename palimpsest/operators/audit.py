"""The entry audit: signals, kind, quality scores, and what to do with each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTRA_POLARITY, CONTRA_SUBJECT, DUMP_CHARS, MAX_ENTRY_CHARS, POINTER_IDEAL, STALE_DAYS, USER_IDEAL, USER_MAX
from ..functions import patterns as P
from ..functions.prefilter import let, seen
from ..functions.shared import stored
from ..functions.text import audit_tokens, clamp, declared_defaults, identifiers, is_file_path, is_header, is_pointer, latest_date, paths, rounded, says, subject_tokens
from .similarity import similar_between, similar_classes, similar_pairs


def signals(c: Column, seen_: Column | None = None) -> Column:
    """The boolean signals of a text; seen_: prefilter.seen of it, which is computed once for all patterns."""
    found = {
        "temporal": P.TEMPORAL, "completion": P.COMPLETION, "metric": P.METRIC, "leading_date": P.LEADING_DATE, "inline_date": P.INLINE_DATE, "pointer": P.POINTER, "preference": P.PREFERENCE,
        "reflection": P.REFLECTION, "todo": P.TODO, "debug": P.DEBUG, "progress": P.PROGRESS, "vague": P.VAGUE, "volatile": P.VOLATILE,
    }
    told = lambda w: F.struct(*[says(c, p, w).alias(k) for k, p in found.items()], (says(c, P.COMPLETION, w) | says(c, P.ACTIVITY, w)).alias("activity"), is_pointer(c).alias("sigil"))
    return let(seen(c), told) if seen_ is None else told(seen_)


def kind(text: Column, store: Column, s: Column, most: int = MAX_ENTRY_CHARS, seen_: Column | None = None) -> Column:
    """The first rule that decides. A lasting preference is never taken for a status note because of a number or date in it."""
    n = F.length(text)
    only_durable = says(text, P.DURABLE_VERB, seen_) & ~says(text, P.EVENT_VERB, seen_)
    event = (s["completion"] | s["activity"]) & ~(only_durable & ~s["temporal"])
    figure = s["metric"] & ~s["preference"]
    dated = ~s["preference"] & (s["leading_date"] | s["temporal"] | s["inline_date"]) & (event | figure)
    return (
        F.when(is_header(text), "header")
        .when(s["sigil"], "pointer")
        .when(s["reflection"], "status_update")
        .when(s["debug"] & ~s["preference"], "debugging_finding")
        .when(dated & s["progress"], "project_progress")
        .when(dated | (figure & ~s["pointer"]), "status_update")
        .when(s["todo"] & ~s["pointer"], "todo_temporary")
        .when(s["progress"] & (s["inline_date"] | s["metric"] | s["completion"]), "project_progress")
        .when((n < 80) & says(text, P.STRONG_VAGUE, seen_) & ~s["pointer"], "malformed")
        .when(s["preference"] & ~(s["leading_date"] | s["completion"]), "preference_fact")
        .when((n > F.when(store == "memory", most).otherwise(USER_MAX)) & ~s["pointer"], "content_dump")
        .when(s["pointer"], F.when((store == "memory") & (n > DUMP_CHARS), "content_dump").otherwise("pointer"))
        .when(s["vague"] | (n < 25), "malformed")
        .otherwise("preference_fact")
    )


def scores(text: Column, store: Column, s: Column, kind_: Column, missing: Column, today: Column, stale_days: int = STALE_DAYS) -> Column:
    """Six scores in [0, 1], unrounded."""
    n, memory = F.length(text), store == "memory"
    add = lambda test, x: F.when(test, F.lit(float(x))).otherwise(F.lit(0.0))
    log_kinds = kind_.isin("status_update", "debugging_finding", "project_progress", "todo_temporary")
    durability = F.lit(0.5) + add(s["preference"] & ~(s["temporal"] | s["leading_date"]), 0.3) + add(s["pointer"], 0.15) - add(s["completion"] & (s["temporal"] | s["leading_date"]), 0.4) - add(s["metric"] & ~s["preference"], 0.25) - add(s["leading_date"], 0.2) - add(log_kinds, 0.2)
    durability = clamp(F.when(kind_ == "header", 1.0).otherwise(durability))
    ideal = F.when(memory, float(POINTER_IDEAL)).otherwise(float(USER_IDEAL))
    fit = F.lit(1.0) - clamp((n - ideal) / ideal * 0.5, 0.0, 0.7) - add(kind_ == "content_dump", 0.3) - add(kind_.isin("status_update", "debugging_finding"), 0.2)
    fit = clamp(F.when(kind_.isin("header", "pointer"), F.greatest(fit, F.lit(0.85))).otherwise(fit))
    pointed = F.when(n <= F.when(memory, DUMP_CHARS).otherwise(USER_MAX), 1.0).otherwise(0.6)
    quality = F.when(kind_ == "header", 1.0).when(s["pointer"], F.when(missing, F.least(pointed, F.lit(0.4))).otherwise(pointed)).when(kind_ == "preference_fact", 0.8).otherwise(0.2)
    concrete = (F.size(paths(text)) > 0) | text.rlike(r"(?U)\b[A-Z][\w.\-]{2,}\b") | text.rlike(r"(?U)\d")
    specific = clamp(F.when(concrete, 0.7).otherwise(0.4) - add(s["vague"], 0.3) - add(n < 25, 0.2))
    age = F.datediff(today, latest_date(text))
    old = F.when(age > stale_days, clamp((age - stale_days) / 180.0 * 0.4 + 0.2, 0.0, 0.6)).when(age.isNotNull() & (s["leading_date"] | s["inline_date"]), 0.1).otherwise(0.0)
    stale = add(s["temporal"], 0.3) + add(s["completion"] & (s["temporal"] | s["leading_date"] | s["inline_date"]), 0.3) + add(s["metric"], 0.15) + old + add(s["volatile"], 0.2) - add((kind_ == "preference_fact") & ~s["temporal"] & ~(s["leading_date"] | s["inline_date"]), 0.2)
    stale = clamp(F.when(kind_ == "header", 0.0).otherwise(stale))
    overall = clamp(0.30 * durability + 0.30 * fit + 0.20 * quality + 0.20 * specific - 0.25 * stale)
    return F.struct(durability.alias("durability"), fit.alias("hot_memory_fit"), quality.alias("pointer_quality"), specific.alias("specificity"), stale.alias("staleness"), overall.alias("overall"))


def audit(entries: DataFrame, today: Column, known_paths: DataFrame | None = None) -> DataFrame:
    """entries (ref, store, text) with signals, kind, chars, missing, scores. known_paths (path) lists the files that exist; without it none counts as missing."""
    e = entries.withColumn("paths", paths(F.col("text")))
    if known_paths is None:
        e = e.withColumn("missing", F.lit(False))
    else:
        files = e.select("ref", F.explode(F.filter("paths", is_file_path)).alias("path")).join(known_paths.select("path", F.lit(True).alias("there")), "path", "left")
        e = e.join(files.groupBy("ref").agg(F.bool_and(F.col("there").isNull()).alias("missing")), "ref", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))
    e = e.withColumn("_seen", seen(F.col("text"))).withColumn("signals", signals(F.col("text"), F.col("_seen")))
    e = e.withColumn("kind", kind(F.col("text"), F.col("store"), F.col("signals"), seen_=F.col("_seen"))).withColumn("chars", F.length("text")).drop("_seen")
    return e.withColumn("scores", scores(F.col("text"), F.col("store"), F.col("signals"), F.col("kind"), F.col("missing"), today))


def without_text(audited: DataFrame) -> DataFrame:
    """audited with what losers, contradictions and recommend take from a text, in its place: bag, claim (null where an entry can't be at odds with another) and procedure. So a text is read once, and not stored or shuffled."""
    t = F.col("text")
    stance = F.struct(declared_defaults(t).alias("defaults"), says(t, P.POLARITY_POS).alias("pos"), says(t, P.POLARITY_NEG).alias("neg"))
    claim = let(stance, lambda x: F.when((F.size(x["defaults"]) > 0) | (x["pos"] != x["neg"]), F.struct(subject_tokens(t).alias("tokens"), x["defaults"].alias("defaults"), identifiers(t).alias("ids"), x["pos"].alias("pos"), x["neg"].alias("neg"))))
    return audited.withColumns({"bag": audit_tokens(t), "claim": claim, "procedure": F.when(F.col("kind") == "content_dump", says(t, P.PROCEDURE))}).drop("text")


def duplicates(audited: DataFrame, near: float) -> DataFrame:
    """Pairs of entries with bag Jaccard >= near, headers and pointer pairs aside, and the one to merge away: the worse, the earlier where equal. ref orders entries."""
    e = audited.where("kind <> 'header'")
    # tokens are made once, as the join reads them twice
    pairs = similar_pairs(stored(e.select(F.col("ref").alias("id"), audit_tokens(F.col("text")).alias("tokens")), "bags"), near)
    side = lambda x: e.select(F.col("ref").alias(x), F.col("kind").alias(f"{x}_kind"), F.col("scores.overall").alias(f"{x}_overall"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(~((F.col("a_kind") == "pointer") & (F.col("b_kind") == "pointer")))
    return met.select("a", "b", "common", "either", "na", "nb", F.when(rounded(F.col("a_overall"), 2) <= rounded(F.col("b_overall"), 2), F.col("a")).otherwise(F.col("b")).alias("loser"))


def losers(audited: DataFrame, near: float) -> DataFrame:
    """ref of the entries that duplicates() would merge away, each once, without making its pairs.

    Entries of one bag are a class. An entry loses if any entry that it pairs with, in its class or a class near it, is better: by score to two places, then by ref. So a class's best entry stands for all of
    them, and, as pointers don't pair with pointers, its best one that is none."""
    made = "bag" in audited.columns
    tokens = F.col("bag") if made else audit_tokens(F.col("text"))
    e = audited.where("kind <> 'header'").select("ref", (F.col("kind") == "pointer").alias("points"), F.struct(rounded(F.col("scores.overall"), 2).alias("s"), "ref").alias("rank"), tokens.alias("tokens"))
    e = e if made else stored(e, "bags")
    members, pairs = similar_classes(e.select(F.col("ref").alias("id"), "tokens"), near)
    own = stored(members.join(e.select(F.col("ref").alias("id"), "points", "rank"), "id"), "bag-members")
    best = own.groupBy("rep").agg(F.max("rank").alias("any"), F.max(F.when(~F.col("points"), F.col("rank"))).alias("plain"))
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(best.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    rivals = links.join(best, F.col("b") == F.col("rep")).groupBy("a").agg(F.max("any").alias("any"), F.max("plain").alias("plain"))
    return own.join(rivals, F.col("rep") == F.col("a")).where(F.col("rank") < F.when(F.col("points"), F.col("plain")).otherwise(F.col("any"))).select(F.col("id").alias("ref"))


def contradictions(audited: DataFrame) -> DataFrame:
    """Pairs on one subject that declare different defaults, or state opposite things of it where identifiers don't tell them apart."""
    t = F.col("text")
    e = audited.where("kind <> 'header'")
    e = e.where("claim is not null").select("ref", "claim.*") if "claim" in audited.columns else stored(e.select("ref", subject_tokens(t).alias("tokens"), declared_defaults(t).alias("defaults"), identifiers(t).alias("ids"), says(t, P.POLARITY_POS).alias("pos"), says(t, P.POLARITY_NEG).alias("neg")).where("size(defaults) > 0 or pos <> neg"), "claims")
    # only entries that declare a default, and only those of opposite polarity, can be at odds
    sets = lambda test: e.where(test).select(F.col("ref").alias("id"), "tokens")
    told = similar_pairs(sets("size(defaults) > 0"), CONTRA_SUBJECT).select("a", "b", "common", "either", F.lit("default").alias("reason"))
    against = similar_between(sets("pos and not neg"), sets("neg and not pos"), CONTRA_POLARITY)
    against = against.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "either", F.lit("state").alias("reason"))
    side = lambda x: e.select(F.col("ref").alias(x), F.struct("defaults", "ids").alias(f"_{x}"))
    met = told.unionByName(against).join(side("a"), "a").join(side("b"), "b")
    empty = lambda c: F.size(c) == 0
    apart = lambda c: ~empty(f"_a.{c}") & ~empty(f"_b.{c}") & ~F.arrays_overlap(f"_a.{c}", f"_b.{c}")
    kept = F.when(F.col("reason") == "default", apart("defaults")).otherwise(~apart("defaults") & ~apart("ids"))
    return met.where(kept).select("a", "b", "common", "either", "reason")


def recommend(audited: DataFrame, merged: DataFrame, disputed: DataFrame, most: int = MAX_ENTRY_CHARS) -> DataFrame:
    """audited with action. merged (ref): entries to merge away; disputed (ref): entries in a contradiction."""
    e = audited.join(merged.select("ref", F.lit(True).alias("_merge")).distinct(), "ref", "left").join(disputed.select("ref", F.lit(True).alias("_disputed")).distinct(), "ref", "left")
    s, k = F.col("signals"), F.col("kind")
    procedure = F.col("procedure") if "procedure" in audited.columns else says(F.col("text"), P.PROCEDURE)
    target = s["sigil"] | F.exists("paths", is_file_path)
    action = (
        F.when(F.col("_disputed"), "user_review")
        .when(F.col("missing"), "verify_current")
        .when(F.col("_merge"), "merge")
        .when(k.isin("header", "pointer"), "keep")
        .when(k == "debugging_finding", "move_to_note")
        .when(k == "status_update", F.when(s["preference"], "user_review").when(target | (F.size("paths") > 0), "archive_to_note").otherwise("remove_after_archive"))
        .when(k == "project_progress", "verify_current")
        .when(k == "todo_temporary", "user_review")
        .when(k == "content_dump", F.when(target, "rewrite_to_pointer").when(procedure, "move_to_skill").otherwise("move_to_note"))
        .when(k == "malformed", "user_review")
        .when((F.col("store") == "memory") & (F.col("chars") > most), F.when(s["preference"], F.when(target, "rewrite_to_pointer").otherwise("user_review")).otherwise("move_to_note"))
        .when(s["volatile"] & (s["inline_date"] | s["temporal"]), "verify_current")
        .otherwise("keep")
    )
    return e.withColumn("action", action).drop("_merge", "_disputed")


def worst(audited: DataFrame, n: int = 10) -> DataFrame:
    """The n entries of least quality, in file order where equal: a report's top list."""
    return audited.orderBy("scores.overall", "ref").limit(n)


def best_duplicate(pairs: DataFrame) -> DataFrame:
    """Each entry's most similar partner, the smaller ref where equal."""
    common = pairs.select(F.col("a").alias("ref"), F.col("b").alias("other"), "common", "either").union(pairs.select("b", "a", "common", "either"))
    w = Window.partitionBy("ref").orderBy(F.desc(F.col("common") / F.col("either")), "other")
    return common.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Characters that an entry keeps after its action; the others free nothing.
RESIDUAL = {"rewrite_to_pointer": 120, "merge": 120, "archive_to_note": 120, "remove_after_archive": 0, "move_to_skill": 80, "move_to_note": 80}


def saved(action: Column, chars: Column) -> Column:
    """Characters that an action frees; null where it frees none by itself."""
    rest = F.try_element_at(F.create_map(*[F.lit(x) for kv in RESIDUAL.items() for x in kv]), action)
    return F.when(rest.isNotNull(), F.greatest(F.lit(0), chars - rest))


def store_summary(recommended: DataFrame, limits: DataFrame) -> DataFrame:
    """recommended entries (store, kind, action, chars, missing) and limits (store, char_limit): per store the entries, actionable and broken ones, characters, fill, what could be freed and the fill after it."""
    own = recommended.groupBy("store").agg(
        F.count("*").alias("entries"), F.count_if(F.col("action") != "keep").alias("actionable"), F.count_if("missing").alias("broken"), F.sum("chars").alias("chars"), F.coalesce(F.sum(saved(F.col("action"), F.col("chars"))), F.lit(0)).alias("recoverable"),
    )
    left = F.greatest(F.lit(0), F.col("chars") - F.col("recoverable"))
    fill = lambda c: F.round(100 * c / F.col("char_limit"), 1)
    return own.join(limits, "store", "left").withColumn("percent", fill(F.col("chars"))).withColumn("percent_after", fill(left))


def top_shrink(recommended: DataFrame, n: int = 10) -> DataFrame:
    """The n entries whose action frees most, in file order where equal: a report's list."""
    freed = recommended.withColumn("saved", saved(F.col("action"), F.col("chars"))).where("saved > 0")
    return freed.select("ref", "kind", "action", "chars", "saved").orderBy(F.desc("saved"), "ref").limit(n)
