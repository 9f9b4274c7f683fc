"""Policies as joins: violations, what could not be judged, what was accepted, and remedies.

Rules are few and come from a text file, so each becomes a filter over units; facts are never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions import names, scalars
from ..plans import graph
from ..plans import policy as P
from ..plans.staging import Stage
from ..vocabulary import UNKNOWN
from . import verbs

SCHEMA = "rule string, raw string, fn string, effects string, detail string"


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames, empty) if frames else empty


def _in(scope: str | None, fn: Column) -> Column:
    return names.scope_matches(fn, scope) if scope else F.lit(True)


def _none(f: Facts, schema: str = SCHEMA) -> DataFrame:
    return f.units.sparkSession.createDataFrame([], schema)


def effect_hits(f: Facts, p: P.Policy, partners: Column | None = None) -> DataFrame:
    """raw, order, fn, effect, state: what each deny or pure rule says of each effect in its scope.

    state is hit, or withheld where a narrowed rule has no evidence of the unit's classes: neither a pass nor a violation.
    """
    rows = f.inferred.join(f.units.select("fn").distinct(), "fn", "left_semi").where(F.col("effect").isin(sorted({e for r in p.denies for e in r.effects})))
    if any(r.unknown_classes for r in p.denies):
        rows = rows.join(f.reason_classes.groupBy("fn").agg(F.collect_set("class").alias("why")), "fn", "left")
    if any(r.net_classes for r in p.denies):
        table = partners if partners is not None else F.create_map().cast("map<string,string>")
        rows = rows.join(verbs.net_classes(f, table).groupBy("fn").agg(F.collect_set("class").alias("to")), "fn", "left")
    cases = [F.when(F.col("effect").isin(r.effects) & _in(r.scope, F.col("fn")), F.struct(F.lit(r.raw).alias("raw"), F.lit(r.order).alias("order"), _state(r).alias("state"))) for r in p.denies]
    if not cases:
        return _none(f, "raw string, order int, fn string, effect string, state string")
    said = rows.select("fn", "effect", F.explode(F.array_compact(F.array(*cases))).alias("r"))  # all rules in one pass
    return said.select("r.raw", "r.order", "fn", "effect", "r.state").where("state is not null")


def _state(r: P.Deny) -> Column:
    """hit, withheld, or null where a narrowed rule means other classes; of columns effect, why and to."""
    state: Column = F.lit("hit")
    for effect, wanted, seen in ((UNKNOWN, r.unknown_classes, "why"), ("Net", r.net_classes, "to")):
        if wanted:
            bare = F.col(seen).isNull() | (F.size(seen) == 0)
            met = F.arrays_overlap(seen, F.array(*map(F.lit, wanted)))
            state = F.when((F.col("effect") == effect) & bare, "withheld").when((F.col("effect") == effect) & ~met, None).otherwise(state)
    return state


def denied(f: Facts, p: P.Policy, partners: Column | None = None) -> DataFrame:
    """AS-EFF-006: one row for each unit and rule, with the effects that the rule forbids and the unit has."""
    hits = effect_hits(f, p, partners).where("state = 'hit'").groupBy("raw", "fn").agg(F.array_join(F.sort_array(F.collect_set("effect")), ",").alias("effects"))
    return hits.select(F.lit("AS-EFF-006").alias("rule"), "raw", "fn", "effects", F.lit("").alias("detail"))


def withheld(f: Facts, p: P.Policy, partners: Column | None = None) -> DataFrame:
    """raw, fn, effect: what a narrowed rule could not judge."""
    return effect_hits(f, p, partners).where("state = 'withheld'").select("raw", "fn", "effect")


_KIND = {"Net": "hosts", "Llm": "hosts", "Exec": "cmds", "Fs": "paths", "Db": "tables"}


def allowed(f: Facts, p: P.Policy) -> DataFrame:
    """AS-EFF-008: units that perform an effect with no visible literal, an incomplete surface, or literals not allowed."""
    frames = []
    for r in p.allows:
        who = f.inferred.where(F.col("effect") == r.effect).where(_in(r.scope, F.col("fn"))).join(f.units.select("fn").distinct(), "fn", "left_semi").select("fn")
        lits = who.join(f.reached_literals.where(F.col("kind") == _KIND[r.effect]), "fn")
        blind = who.join(lits, "fn", "left_anti")
        if f.incomplete is not None:
            gap = f.reached_incomplete.where(F.col("effect") == ("Net" if r.effect == "Llm" else r.effect)).select("fn")
            blind = blind.union(who.join(gap, "fn", "left_semi")).distinct()
        fine = scalars.literal_allowed(F.lit(r.effect), F.col("value"), F.array(*map(F.lit, r.values)))
        bad = lits.join(blind, "fn", "left_anti").where(~fine).groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("detail"))
        rows = blind.select("fn", F.lit("no visible literal").alias("detail")).unionByName(bad)
        frames.append(rows.select(F.lit("AS-EFF-008").alias("rule"), F.lit(r.raw).alias("raw"), "fn", F.lit(r.effect).alias("effects"), "detail"))
    return _union(frames, _none(f))


def forbidden(f: Facts, p: P.Policy, beyond: DataFrame | None = None) -> DataFrame:
    """AS-EFF-009: units of one scope that reach another; detail is the least-named of the nearest units reached.

    ``beyond`` (fn, scope) are names in other packages and the scopes that they reach there, by those packages' own scans.
    """
    if not p.forbids:
        return _none(f)
    named = Stage(f.names, "names").df
    targets = {r.raw: named.where(_in(r.target, F.col("fn"))).select(F.lit(r.raw).alias("raw"), F.col("fn").alias("node")) for r in p.forbids}
    if beyond is not None:
        for r in p.forbids:
            there = beyond.where(F.col("scope") == r.target).select(F.lit(r.raw).alias("raw"), F.col("fn").alias("node"))
            targets[r.raw] = targets[r.raw].unionByName(there).distinct()
    near = verbs.nearest(f.callers, reduce(DataFrame.unionByName, targets.values()), "raw", staged=True).where("hops > 0")  # one walk for all rules
    frames = []
    for r in p.forbids:
        goals = targets[r.raw]
        hit = near.where(F.col("raw") == r.raw).select("fn", "source")
        both = goals.where(_in(r.source, F.col("node"))).select("node")  # in both scopes: they need a way back
        if not both.isEmpty():
            hit = hit.unionByName(_back_to_itself(f, goals.select("node"), both))
        frames.append(hit.where(_in(r.source, F.col("fn"))).join(f.units.select("fn").distinct(), "fn", "left_semi").select(F.lit("AS-EFF-009").alias("rule"), F.lit(r.raw).alias("raw"), "fn", F.lit("").alias("effects"), F.concat(F.lit("via "), F.col("source")).alias("detail")))
    return _union(frames, _none(f))


def _back_to_itself(f: Facts, goals: DataFrame, asked: DataFrame) -> DataFrame:
    """(fn, source): those of the goals ``asked`` that call a goal, directly or not; the least-named one called directly, if any."""
    inside = graph.closure(f.callers, goals, seeded=False, staged=True).select(F.col("node").alias("fn")).join(asked.withColumnRenamed("node", "fn"), "fn", "left_semi").distinct()
    steps = f.edges.join(asked, F.col("src") == F.col("node"), "left_semi")
    first = steps.join(goals, F.col("dst") == F.col("node"), "left_semi").groupBy(F.col("src").alias("fn")).agg(F.min("dst").alias("source"))
    return inside.join(first, "fn", "left").select("fn", F.coalesce("source", "fn").alias("source"))


def permitted_only(f: Facts, p: P.Policy) -> DataFrame:
    """AS-EFF-011: units of a scope that reach a unit neither in it nor permitted; permitted units are not walked through."""
    if not p.onlys:
        return _none(f)
    cases = []
    for r in p.onlys:
        permit = reduce(lambda a, b: a | b, [names.scope_matches(F.col("dst"), t, permitted=True) for t in r.targets])
        cases.append(F.when(~permit, F.struct(F.lit(r.raw).alias("raw"), _in(r.source, F.col("dst")).alias("inside"))))
    walk = f.calls.select("src", "dst", F.explode(F.array_compact(F.array(*cases))).alias("r")).select("src", "dst", "r.raw", "r.inside")  # all rules in one pass
    goals = walk.where("not inside").select("raw", F.col("dst").alias("node")).distinct()
    near = verbs.nearest(walk.select("raw", F.col("dst").alias("src"), F.col("src").alias("dst")), goals, "raw").where("hops > 0")  # and one walk
    own = reduce(lambda a, b: a | b, [(F.col("raw") == r.raw) & _in(r.source, F.col("fn")) for r in p.onlys])
    found = near.where(own).join(f.units.select("fn").distinct(), "fn", "left_semi")
    return found.select(F.lit("AS-EFF-011").alias("rule"), "raw", "fn", F.lit("").alias("effects"), F.concat(F.lit("reaches "), F.col("source")).alias("detail"))


def conformance(declared: DataFrame, f: Facts, strict_scope: str | None = None) -> DataFrame:
    """AS-EFF-001..003 from (fn, declared array): undeclared effects (entry points aside), unused declarations, Unknown in a strict scope."""
    own = f.inferred.groupBy("fn").agg(F.collect_set("effect").alias("has"))
    entry = f.units.groupBy("fn").agg(F.max("entry_point").alias("entry"))
    rows = declared.where("declared is not null").join(own, "fn", "left").join(entry, "fn", "left")
    has = F.array_except(F.coalesce("has", F.array().cast("array<string>")), F.array(F.lit(UNKNOWN)))
    cases = F.array(
        F.struct(F.lit("AS-EFF-001").alias("rule"), F.when(~F.coalesce("entry", F.lit(False)), F.array_except(has, "declared")).alias("e")),
        F.struct(F.lit("AS-EFF-002").alias("rule"), F.array_except("declared", has).alias("e")),
        F.struct(F.lit("AS-EFF-003").alias("rule"), F.when(F.array_contains("has", UNKNOWN) & _in(strict_scope, F.col("fn")), F.array(F.lit(UNKNOWN))).alias("e")),
    )
    return rows.select("fn", F.explode(cases).alias("c")).where("size(c.e) > 0").select("c.rule", F.lit("").alias("raw"), "fn", F.array_join(F.sort_array("c.e"), ",").alias("effects"), F.lit("").alias("detail"))


#: Effects that code should be handed rather than take from its surroundings; fixed value.
AUTHORITY = ["Net", "Fs", "Db", "Llm", "Exec", "Ipc", "Env", "Clock", "Rand", "Clipboard"]


def ambient_authority(f: Facts, scope: str | None = None) -> DataFrame:
    """AS-EFF-004: units that perform such effects themselves."""
    rows = f.direct.where(F.col("effect").isin(AUTHORITY) & _in(scope, F.col("fn"))).groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set("effect")), ",").alias("effects"))
    return rows.select(F.lit("AS-EFF-004").alias("rule"), F.lit("").alias("raw"), "fn", "effects", F.lit("").alias("detail"))


def tainted(facts: DataFrame) -> DataFrame:
    """AS-EFF-007, advice only, from (fn, effect, tainted): effects fed from a caller's argument."""
    return facts.where("tainted").groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set("effect")), ",").alias("effects")).select(F.lit("AS-EFF-007").alias("rule"), F.lit("").alias("raw"), "fn", "effects", F.lit("").alias("detail"))


def violations(f: Facts, p: P.Policy, partners: Column | None = None) -> DataFrame:
    return denied(f, p, partners).unionByName(allowed(f, p)).unionByName(forbidden(f, p)).unionByName(permitted_only(f, p))


def judged(f: Facts, p: P.Policy, partners: Column | None = None) -> DataFrame:
    """raw, violations, unevaluated, verdict of every rule of a policy: how many rows break it and how many units it could not judge.

    A violation outweighs what could not be judged, which outweighs a pass.  A policy without rules has no rows.
    """
    raws = sorted({r.raw for r in (*p.denies, *p.allows, *p.forbids, *p.onlys)})
    rules = f.units.sparkSession.createDataFrame([(r,) for r in raws], "raw string")
    broken = violations(f, p, partners).groupBy("raw").agg(F.count("*").alias("v"))
    blind = withheld(f, p, partners).select("raw", "fn").distinct().groupBy("raw").agg(F.count("*").alias("w"))
    rows = rules.join(broken, "raw", "left").join(blind, "raw", "left")
    verdict = F.when(F.col("v") > 0, "violations").when(F.col("w") > 0, "unevaluated").otherwise("clear")
    return rows.select("raw", F.coalesce("v", F.lit(0)).alias("violations"), F.coalesce("w", F.lit(0)).alias("unevaluated"), verdict.alias("verdict"))


def scope_binding(f: Facts, p: P.Policy) -> DataFrame:
    """raw, scope, names: how many names each rule's scopes bind; zero means that the rule can't bite."""
    scopes = [(r.raw, r.scope, False) for r in (*p.denies, *p.allows) if r.scope]
    scopes += [(r.raw, s, False) for r in p.forbids for s in (r.source, r.target)]
    scopes += [(r.raw, r.source, False) for r in p.onlys] + [(r.raw, t, True) for r in p.onlys for t in r.targets]
    if not scopes:
        return _none(f, "raw string, scope string, names long")
    counts = f.names.agg(*[F.count_if(names.scope_matches(F.col("fn"), scope, permitted=exact)).alias(f"n{i}") for i, (_, scope, exact) in enumerate(scopes)])  # all scopes in one pass
    rows = F.array(*[F.struct(F.lit(raw).alias("raw"), F.lit(scope).alias("scope"), F.col(f"n{i}").alias("names")) for i, (raw, scope, _) in enumerate(scopes)])
    return counts.select(F.inline(rows))


def zero_match(f: Facts, p: P.Policy) -> DataFrame:
    return scope_binding(f, p).where("names = 0")


def multi_match(f: Facts, p: P.Policy) -> DataFrame:
    """Bare scopes (without ::) that bind two names or more."""
    return scope_binding(f, p).where("names > 1 and not contains(scope, '::')")


def twin_names(units: DataFrame) -> DataFrame:
    """fn of names that two or more units (by hash) have."""
    return units.groupBy("fn").agg(F.countDistinct(scalars.entry_key(F.col("hash"), F.col("fn"))).alias("units")).where("units > 1")


def unverified(f: Facts, p: P.Policy, partners: Column | None = None) -> DataFrame:
    """fn, rule, upgrade: units with Unknown in the scope of a rule that does not fire on them; the first such rule."""
    hits = effect_hits(f, p, partners).where("state = 'hit'").select("raw", "fn").distinct()
    blind = f.inferred.where(F.col("effect") == UNKNOWN).join(f.units.select("fn").distinct(), "fn", "left_semi").select("fn")
    if not p.denies:
        return _none(f, "fn string, rule string, upgrade string")
    cases = [F.when(_in(r.scope, F.col("fn")), F.struct(F.lit(r.raw).alias("raw"), F.lit(r.order).alias("order"), F.lit(P.upgrade(r)).alias("upgrade"))) for r in p.denies]
    rows = blind.select("fn", F.explode(F.array_compact(F.array(*cases))).alias("r")).select("fn", "r.*").join(hits, ["raw", "fn"], "left_anti")
    first = rows.groupBy("fn").agg(F.min(F.struct("order", "raw", "upgrade")).alias("r"))
    return first.select("fn", F.col("r.raw").alias("rule"), F.col("r.upgrade").alias("upgrade"))


def settle(found: DataFrame, p: P.Policy, f: Facts, partners: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(violations that stand, entries with their status): accepted units are taken out.

    An entry settles a violation of its rule by its unit, or by a closure inside it (up to eight levels), if it lists all of
    the violation's effects, and for Unknown all of the unit's classes.  An entry's status is accepted, exceeded, ambiguous
    (the name has two units), unjudged (its rule has no evidence of the unit) or stale (AS-EFF-012: nothing to settle).
    """
    spark = f.units.sparkSession
    entries = spark.createDataFrame([(i, a.fn, a.rule, a.effects, a.classes) for i, a in enumerate(p.accepts)], "entry int, unit string, raw string, accepted array<string>, accepted_classes array<string>")
    twins = f.units.groupBy("fn").count().where("count > 1").select(F.col("fn").alias("unit"), F.lit(True).alias("twin"))
    why = f.reason_classes.groupBy("fn").agg(F.collect_set("class").alias("why"))
    # a closure's name and those of the units around it, innermost first
    parts = F.split(F.col("fn"), "::", -1)
    depth = F.least(F.size(parts) - 1, F.lit(8))
    inner = F.filter(F.sequence(F.lit(0), depth), lambda k: (k == 0) | F.forall(F.slice(parts, F.size(parts) - k + 1, k), scalars.is_positional))
    around = F.transform(inner, lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "::"))
    rows = found.withColumn("raw", scalars.rule_key(F.col("raw"))).join(why, "fn", "left").withColumn("unit", F.explode(around))
    pairs = rows.join(F.broadcast(entries), ["unit", "raw"]).join(twins, "unit", "left")
    covered = (F.size(F.array_except(F.split("effects", ","), "accepted")) == 0) & (~F.array_contains(F.split("effects", ","), UNKNOWN) | (F.size(F.array_except(F.coalesce("why", F.array(F.lit("unresolved"))), "accepted_classes")) == 0))
    judged = pairs.withColumn("status", F.when(F.col("twin"), "ambiguous").when(covered, "accepted").otherwise("exceeded"))
    settled = judged.where("status = 'accepted'").select("rule", "raw", "fn").distinct()
    stands = found.withColumn("key", scalars.rule_key(F.col("raw"))).join(settled.withColumnRenamed("raw", "key"), ["rule", "key", "fn"], "left_anti").select(found.columns)
    rank = F.when(F.col("status") == "ambiguous", 0).when(F.col("status") == "exceeded", 1).otherwise(2)
    status = judged.groupBy("entry").agg(F.min(F.struct(rank.alias("r"), "status")).alias("s")).select("entry", "s.status")
    listed = entries.join(status, "entry", "left").select("entry", F.col("unit").alias("fn"), "raw", "status")
    if any(r.unknown_classes or r.net_classes for r in p.denies):
        blind = withheld(f, p, partners).select("fn", scalars.rule_key(F.col("raw")).alias("raw"), F.lit("unjudged").alias("open")).distinct()
        listed = listed.join(blind, ["fn", "raw"], "left").select("entry", "fn", "raw", F.coalesce("status", "open").alias("status"))
    listed = listed.withColumn("status", F.coalesce("status", F.lit("stale")))
    return stands, listed


def proposals(found: DataFrame, because: str) -> DataFrame:
    """line: the accept entries that would settle the violations; entries for Unknown need classes and are left to a person."""
    plain = found.where(~F.array_contains(F.split("effects", ","), UNKNOWN) & (F.col("effects") != ""))
    return plain.select(F.concat(F.lit("accept "), "fn", F.lit(" "), F.translate("effects", ",", " "), F.lit(" for "), scalars.rule_key(F.col("raw")), F.lit(f" because {because}")).alias("line"))


def accept_plan(found: DataFrame, p: P.Policy, f: Facts, because: str) -> DataFrame:
    """kind, fn, raw, effects, line: how a policy's accept entries would have to change for the violations to be settled.

    removed: nothing is left for the entry to settle; narrowed: the entry lists effects that the unit no longer has, and
    ``line`` is what would do; proposed: the unit has more than the entry lists, and ``line`` would cover it; created: no
    entry yet; unnamed: the name has two units, so no entry can mean one; by_hand: Unknown needs classes from a person.
    """
    spark = f.units.sparkSession
    stands, entries = settle(found, p, f)
    key = ["fn", "raw"]
    listed = spark.createDataFrame([(a.fn, a.rule, a.effects, a.because) for a in p.accepts], "fn string, raw string, accepted array<string>, because string").join(entries.select(*key, "status"), key)
    now = found.select("fn", scalars.rule_key(F.col("raw")).alias("raw"), F.split("effects", ",").alias("has"))
    twins = f.units.groupBy("fn").count().where("count > 1").select("fn", F.lit(True).alias("twin"))

    def line(effects: Column, reason: Column) -> Column:
        return F.concat(F.lit("accept "), "fn", F.lit(" "), F.array_join(effects, " "), F.lit(" for "), "raw", F.lit(" because "), reason)

    both = listed.join(now, key)
    gone, more = F.sort_array(F.array_except("accepted", "has")), F.sort_array(F.array_except("has", "accepted"))
    joined = F.sort_array(F.array_union("has", "accepted"))
    removed = listed.where("status = 'stale'").select(F.lit("removed").alias("kind"), *key, F.array_join("accepted", ",").alias("effects"), F.lit("").alias("line"))
    narrowed = both.where((F.col("status") == "accepted") & (F.size(gone) > 0)).select(F.lit("narrowed").alias("kind"), *key, F.array_join(gone, ",").alias("effects"), line(F.sort_array(F.array_intersect("accepted", "has")), F.col("because")).alias("line"))
    wider = both.where((F.col("status") == "exceeded") & (F.size(more) > 0)).select(F.when(F.array_contains("has", UNKNOWN), "by_hand").otherwise("proposed").alias("kind"), *key, F.array_join(more, ",").alias("effects"), F.when(~F.array_contains("has", UNKNOWN), line(joined, F.col("because"))).otherwise("").alias("line"))
    open_ = stands.select("fn", scalars.rule_key(F.col("raw")).alias("raw"), "effects").distinct().join(F.broadcast(listed.select(*key)), key, "left_anti").join(twins, "fn", "left")
    fresh = open_.withColumn("has", F.split("effects", ",")).where("effects <> ''").withColumn("kind", F.when(F.col("twin"), "unnamed").when(F.array_contains("has", UNKNOWN), "by_hand").otherwise("created"))
    created = fresh.select("kind", *key, "effects", F.when(F.col("kind") == "created", line(F.sort_array("has"), F.lit(because))).otherwise("").alias("line"))
    return removed.unionByName(narrowed).unionByName(wider).unionByName(created)


def denied_layer(p: P.Policy, effect: str, fn: Column) -> Column:
    """The scope of the first deny or pure rule that forbids an effect to a name; null if none does."""
    out: Column = F.lit(None).cast("string")
    for r in sorted(p.denies, key=lambda r: -r.order):
        if effect in r.effects:
            out = F.when(_in(r.scope, fn), F.lit(r.scope or "")).otherwise(out)
    return out


def whatif(f: Facts, query: str, effect: str, p: P.Policy | None = None) -> DataFrame:
    """fn, rule, conditional: who would have an effect if the best matches performed it, themselves included, and the first
    rule that would then be broken; a narrowed rule is conditional."""
    of = verbs.best_matches(f.names, query).select(F.col("fn").alias("node"))
    affected = graph.closure(f.callers, of, staged=True).select(F.col("node").alias("fn")).distinct()
    rule, narrowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(p.denies if p else [], key=lambda r: -r.order):
        if effect in r.effects:
            here = _in(r.scope, F.col("fn"))
            classes = r.unknown_classes if effect == UNKNOWN else r.net_classes if effect == "Net" else None
            rule, narrowed = F.when(here, F.lit(r.raw)).otherwise(rule), F.when(here, F.lit(bool(classes))).otherwise(narrowed)
    return affected.select("fn", rule.alias("rule"), narrowed.alias("conditional"))


def fix(f: Facts, query: str, effect: str, p: P.Policy) -> DataFrame:
    """role, fn: how to bring an effect out of a layer that may not have it.

    site: where it is performed; span: denied units above; hoist: allowed callers where it could start instead; higher:
    allowed callers above those; sandwiched: denied units above a hoist, with which hoisting there would not be clean.
    No rows if no match has the effect.
    """
    matches = verbs.best_matches(f.units.select("fn"), query).join(f.inferred.where(F.col("effect") == effect), "fn", "left_semi")
    if matches.isEmpty():  # nothing crosses
        return _none(f, "role string, fn string")
    start = verbs.select_one(matches, query)
    carriers = f.inferred.where(F.col("effect") == effect).select("fn")
    down = f.edges.join(carriers, F.col("dst") == F.col("fn"), "left_semi")
    seeds = carriers.where(F.col("fn") == start).select(F.col("fn").alias("node")).distinct()
    reached = graph.closure(down, seeds).select(F.col("node").alias("fn")).distinct()
    sites = reached.join(f.direct.where(F.col("effect") == effect).select("fn").distinct(), "fn", "left_semi")
    anchors = sites if not sites.isEmpty() else seeds.withColumnRenamed("node", "fn")
    denied_ = denied_layer(p, effect, F.col("dst"))
    up = f.callers.join(carriers, F.col("dst") == F.col("fn"), "left_semi").withColumn("layer", denied_)
    bad, good = up.where("layer is not null").select("src", "dst"), up.where("layer is null").select("src", "dst")
    climb = graph.closure(bad, anchors.select(F.col("fn").alias("node"))).select(F.col("node").alias("fn")).distinct()
    span = climb.where(denied_layer(p, effect, F.col("fn")).isNotNull())
    hoist = good.join(climb, F.col("src") == F.col("fn")).select(F.col("dst").alias("fn")).distinct()
    above = graph.closure(good, hoist.select(F.col("fn").alias("node"))).select(F.col("node").alias("fn")).distinct()
    higher = above.join(hoist, "fn", "left_anti")
    caught = bad.join(above, F.col("src") == F.col("fn")).select(F.col("dst").alias("fn")).distinct()
    out = [(sites, "site"), (span, "span"), (hoist, "hoist"), (higher, "higher"), (caught, "sandwiched")]
    return reduce(DataFrame.unionByName, [x.select(F.lit(role).alias("role"), "fn") for x, role in out])


def fix_gate(f: Facts, p: P.Policy) -> DataFrame:
    """effect, layer, sites, fn: one remedy for each effect, layer and set of sites; fn is the least unit it was found from.

    The sites of all crossings are found in one walk.
    """
    hits = effect_hits(f, p).where("state = 'hit' and effect <> 'Unknown'").select("fn", "effect").distinct()
    layer = F.lit(None).cast("string")
    for e in sorted({e for r in p.denies for e in r.effects}):
        layer = F.when(F.col("effect") == e, denied_layer(p, e, F.col("fn"))).otherwise(layer)
    crossing = hits.withColumn("layer", layer)
    carriers = f.inferred.select(F.col("effect").alias("e"), F.col("fn").alias("c"))
    up = f.callers.join(carriers, F.col("dst") == F.col("c")).select(F.col("e").alias("effect"), "src", "dst")
    seeds = f.direct.where(F.col("effect").isin(sorted({e for r in p.denies for e in r.effects}))).select("effect", F.col("fn").alias("site"), F.col("fn").alias("node"))
    reach = graph.closure(up, seeds, ["effect", "site"]).select("effect", "site", F.col("node").alias("fn"))
    per = crossing.join(reach, ["effect", "fn"]).groupBy("effect", "layer", "fn").agg(F.array_join(F.sort_array(F.collect_set("site")), ",").alias("sites"))
    return per.groupBy("effect", "layer", "sites").agg(F.min("fn").alias("fn"))


def first_rule(found: DataFrame) -> DataFrame:
    """The first rule, in the file's order, that each unit breaks: (fn, raw) of (fn, raw, order)."""
    w = Window.partitionBy("fn").orderBy("order")
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("fn", "raw")
