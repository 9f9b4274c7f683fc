"""Two snapshots side by side: differences, gains, dropped calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..vocabulary import UNKNOWN


def effect_changes(now: Facts, before: Facts) -> DataFrame:
    """fn, effect, change (introduced, inherited, lost), status (new, changed, removed): one row for each effect that moved.

    A gained effect is introduced where the unit performs it itself.  A new unit without effects has no row; a removed one
    has its old effects as lost.
    """
    key = ["fn", "effect"]
    here, there = now.units.select("fn").distinct(), before.units.select("fn").distinct()
    a, b = now.inferred.join(here, "fn", "left_semi"), before.inferred.join(there, "fn", "left_semi")
    gained = a.join(b, key, "left_anti").join(now.direct.withColumn("own", F.lit(True)), key, "left").join(there.withColumn("old", F.lit(True)), "fn", "left")
    gained = gained.select("fn", "effect", F.when(F.col("own"), "introduced").otherwise("inherited").alias("change"), F.when(F.col("old"), "changed").otherwise("new").alias("status"))
    lost = b.join(a, key, "left_anti").join(here.withColumn("still", F.lit(True)), "fn", "left")
    return gained.unionByName(lost.select("fn", "effect", F.lit("lost").alias("change"), F.when(F.col("still"), "changed").otherwise("removed").alias("status")))


def endpoints(now: Facts, before: Facts) -> DataFrame:
    """effect, fn: top-level gainers of an effect (no other gainer calls them) that introduce nothing themselves."""
    changes = effect_changes(now, before).where("change <> 'lost'")
    gainers = changes.select("effect", "fn").distinct()
    called = now.edges.join(gainers.withColumnRenamed("fn", "src"), "src").select("effect", F.col("dst").alias("fn")).distinct()
    sources = changes.where("change = 'introduced'").select("fn").distinct()
    return gainers.join(called, ["effect", "fn"], "left_anti").join(sources, "fn", "left_anti").select("effect", "fn")


def ranked(now: Facts, before: Facts) -> DataFrame:
    """fn, place: units that changed, in order: introducing, top-level gaining, gaining, only losing."""
    changes = effect_changes(now, before)
    gainers = changes.where("change <> 'lost'").select("effect", "fn").distinct()
    called = now.edges.join(gainers.withColumnRenamed("fn", "src"), "src").select("effect", F.col("dst").alias("fn")).distinct()
    top = gainers.join(called, ["effect", "fn"], "left_anti").select("fn").distinct().withColumn("top", F.lit(True))
    per = changes.groupBy("fn").agg(F.max(F.col("change") == "introduced").alias("own"), F.max(F.col("change") != "lost").alias("gains"))
    rank = F.when(F.col("own"), 0).when(F.col("top"), 1).when(F.col("gains"), 2).otherwise(3)
    return per.join(top, "fn", "left").select("fn", rank.alias("place")).orderBy("place", "fn")


def gains(now: Facts, before: Facts, graph_known: bool = True) -> DataFrame:
    """fn, effect, origin: effects that a unit did not have before.

    origin is existing where the unit or its name in the call graph was there before, new where neither was, and unknown
    where the earlier call graph is empty or partly unread.
    """
    key = ["fn", "effect"]
    named = before.names.withColumn("old", F.lit(True))
    rows = now.inferred.join(now.units.select("fn").distinct(), "fn", "left_semi").join(before.inferred, key, "left_anti").join(named, "fn", "left")
    return rows.select("fn", "effect", F.when(F.col("old"), "existing").otherwise("new" if graph_known else "unknown").alias("origin"))


def gained_effects(now: Facts, before: Facts) -> DataFrame:
    return gains(now, before).select("effect").distinct()


def dropped_calls(now: Facts, before: Facts) -> DataFrame:
    """src, dst: calls that are gone."""
    return before.edges.join(now.edges, ["src", "dst"], "left_anti").select("src", "dst")


def coverage_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """name, change: uncovered packages that came (added) or went (removed); both frames have name."""
    a, b = now.select("name").distinct(), before.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "name", "left_anti").withColumn("change", F.lit("removed")))


def guard(now: Facts, before: Facts, unknown_ratchet: bool = False) -> DataFrame:
    """rule, fn, effects, origin, advisory: units whose effects grew; a gain of Unknown alone is advice unless ratcheted."""
    rows = gains(now, before).groupBy("fn").agg(F.sort_array(F.collect_set("effect")).alias("e"), F.max("origin").alias("origin"))
    only = (F.size("e") == 1) & (F.get("e", F.lit(0)) == UNKNOWN)
    return rows.select(F.lit("AS-EFF-005").alias("rule"), "fn", F.array_join("e", ",").alias("effects"), "origin", (only & F.lit(not unknown_ratchet)).alias("advisory"))


def missing_units(expected: DataFrame, present: DataFrame) -> DataFrame:
    """fn: expected units that the snapshot lacks."""
    return expected.select("fn").distinct().join(present.select("fn"), "fn", "left_anti")


def receipt(f: Facts, coverage: DataFrame | None = None) -> DataFrame:
    """position, key, value: counts in the vocabulary's order, the unresolved, and what is not covered."""
    from .verbs import tally
    from ..vocabulary import ALL_EFFECTS

    order = F.array_position(F.array(*map(F.lit, ALL_EFFECTS)), F.col("effect")).cast("int")
    rows = tally(f).select(order.alias("position"), F.col("effect").alias("key"), F.col("units").cast("string").alias("value"))
    if coverage is not None:
        rows = rows.unionByName(coverage.agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("value")).select(F.lit(len(ALL_EFFECTS) + 1).alias("position"), F.lit("uncovered").alias("key"), "value"))
    return rows
