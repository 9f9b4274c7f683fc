"""Read-only questions about one snapshot; each takes Facts and gives a DataFrame."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions import names, scalars
from ..plans import graph
from ..vocabulary import ALL_EFFECTS, AMBIENT, CONTAINED, EFFECTS, REASON_CLASSES, UNKNOWN


class Refused(Exception):
    """A question that can't be answered; ``status`` is 2."""

    status = 2


def best_matches(candidates: DataFrame, query: str) -> DataFrame:
    """The rows of ``candidates`` (fn) at the best tier that any of them reaches; tier 0 never counts."""
    tiered = candidates.withColumn("tier", names.match_tier(F.col("fn"), query)).where("tier > 0")
    top = tiered.agg(F.max("tier").alias("top"))
    return tiered.join(F.broadcast(top), F.col("tier") == F.col("top")).drop("tier", "top")


def select_one(candidates: DataFrame, query: str) -> str:
    """The one distinct name at the best tier; none or several are refused, up to twelve of several being named."""
    found = sorted(r["fn"] for r in best_matches(candidates.select("fn"), query).distinct().limit(13).collect())
    if len(found) != 1:
        raise Refused(f"{query!r} matches " + (f"several: {', '.join(found[:12])}" if found else "nothing"))
    return found[0]


def known_effect(f: Facts, effect: str) -> str:
    """The effect, if the vocabulary or the facts have it; a name that neither has is refused, so a typo is no empty answer."""
    if effect not in (*EFFECTS, UNKNOWN) and f.inferred.where(F.col("effect") == effect).isEmpty():
        raise Refused(f"unknown effect {effect!r} (known: {', '.join([*EFFECTS, UNKNOWN])})")
    return effect


def show(f: Facts, query: str) -> DataFrame:
    """fn, effect, how (direct or inherited) of the units that match best; a unit without effects has null ones."""
    units = best_matches(f.units.select("fn"), query)
    own = f.direct.withColumn("own", F.lit(True))
    return units.join(f.inferred, "fn", "left").join(own, ["fn", "effect"], "left").select("fn", "effect", F.when(F.col("effect").isNotNull(), F.when(F.col("own"), "direct").otherwise("inherited")).alias("how"))


def show_unit(f: Facts, query: str) -> DataFrame:
    """fn, inferred, direct, fs, hosts, tables (sorted, joined by commas), unresolved, loc of the units that match best.

    Literals are those of the unit and of all that it reaches; where none is visible the list is empty.
    """
    units = best_matches(f.units, query)

    def listed(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set(column)), ",").alias(name))

    out = units.groupBy("fn").agg(F.max("unresolved").alias("flag") if "unresolved" in units.columns else F.lit(False).alias("flag"), F.min("loc").alias("loc") if "loc" in units.columns else F.lit("").alias("loc"))
    shown = out.select("fn")
    out = out.join(listed(f.inferred.join(shown, "fn", "left_semi"), "effect", "inferred"), "fn", "left").join(listed(f.direct.join(shown, "fn", "left_semi"), "effect", "direct"), "fn", "left")
    for kind in ("fs", "hosts", "tables"):
        out = out.join(listed(f.reached_literals.where(F.col("kind") == kind).join(shown, "fn", "left_semi"), "value", kind), "fn", "left")
    lists = [F.coalesce(c, F.lit("")).alias(c) for c in ("inferred", "direct", "fs", "hosts", "tables")]
    unresolved = F.col("flag") | F.array_contains(F.split(F.coalesce("inferred", F.lit("")), ","), UNKNOWN)
    return out.select("fn", *lists, unresolved.alias("unresolved"), "loc")


def where(f: Facts, effect: str | None = None) -> DataFrame:
    """effect, how, fn: who performs an effect itself and who through callees (not both)."""
    rows = f.inferred if effect is None else f.inferred.where(F.col("effect") == known_effect(f, effect))
    return rows.join(f.direct.withColumn("own", F.lit(True)), ["fn", "effect"], "left").select("effect", F.when(F.col("own"), "directly").otherwise("inherited").alias("how"), "fn")


def tally(f: Facts) -> DataFrame:
    """effect, units: zero where nobody performs it; Unknown counts the unresolved."""
    spark = f.units.sparkSession
    vocabulary = spark.createDataFrame([(e,) for e in [*EFFECTS, UNKNOWN]], "effect string")
    counts = f.inferred.groupBy("effect").agg(F.count("*").alias("n"))
    return vocabulary.join(counts, "effect", "left").select("effect", F.coalesce("n", F.lit(0)).alias("units"))


def module_map(f: Facts) -> DataFrame:
    """module, effects (sorted, joined by commas, without Unknown), functions."""
    module = names.module_of(F.col("fn")).alias("module")
    size = f.units.select(module).groupBy("module").agg(F.count("*").alias("functions"))
    effects = f.inferred.where(F.col("effect") != UNKNOWN).select(module, "effect").groupBy("module").agg(F.array_join(F.sort_array(F.collect_set("effect")), ",").alias("effects"))
    return size.join(effects, "module", "left").select("module", F.coalesce("effects", F.lit("")).alias("effects"), "functions")


def broadest(f: Facts, n: int = 8) -> DataFrame:
    """fn, width: the n units with most effects, Unknown aside."""
    return f.inferred.where(F.col("effect") != UNKNOWN).groupBy("fn").agg(F.count("*").alias("width")).orderBy(F.desc("width"), "fn").limit(n)


def reachable(f: Facts) -> DataFrame:
    """effect, entry_points: how many entry points perform each effect; nothing is walked."""
    return f.inferred.join(f.units.where("entry_point").select("fn").distinct(), "fn", "left_semi").groupBy("effect").agg(F.count("*").alias("entry_points"))


def prefix_length(units: DataFrame) -> DataFrame:
    """One row, shared: how many leading segments all names share, which the least and the greatest name share too."""
    ends = units.select(names.segments(names.norm_name(F.col("fn"))).alias("s")).agg(F.min("s").alias("a"), F.max("s").alias("b"))
    differ = F.filter(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1), lambda i: F.get("a", i) != F.get("b", i))
    return ends.select(F.coalesce(F.when(F.col("a").isNull(), 0), F.array_min(differ), F.least(F.size("a"), F.size("b"))).cast("int").alias("shared"))


def placements(f: Facts) -> DataFrame:
    """effect, layer, n: units of each layer that perform an effect themselves."""
    own = f.direct.join(f.units.select("fn").distinct(), "fn", "left_semi").join(F.broadcast(prefix_length(f.units)))
    return own.select("effect", names.layer_of(F.col("fn"), F.col("shared")).alias("layer")).groupBy("effect", "layer").agg(F.count("*").alias("n"))


def containment(f: Facts) -> DataFrame:
    """effect, layers, owner, percent of the effects that belong in one layer; percent is an integer."""
    out = placements(f).where(F.col("effect").isin(CONTAINED)).groupBy("effect").agg(F.count("*").alias("layers"), F.max(F.struct("n", "layer")).alias("top"), F.sum("n").alias("total"))
    return out.select("effect", "layers", F.col("top.layer").alias("owner"), F.expr("100 * top.n div total").alias("percent"))


def ambient(f: Facts) -> DataFrame:
    return placements(f).where(F.col("effect").isin(AMBIENT)).groupBy("effect").agg(F.count("*").alias("layers"))


def containment_changes(now: Facts, before: Facts) -> DataFrame:
    """effect, layer, change (leak or cleanup) of the effects that belong in one layer."""
    a, b = (placements(x).where(F.col("effect").isin(CONTAINED)).select("effect", "layer") for x in (now, before))
    key = ["effect", "layer"]
    return a.join(b, key, "left_anti").withColumn("change", F.lit("leak")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("cleanup")))


def callers(f: Facts, query: str) -> DataFrame:
    """fn, direct, hops: who calls the best matches of a name; a match itself only if it is on a cycle."""
    of = best_matches(f.names, query).select(F.col("fn").alias("node"))
    out = graph.closure(f.callers, of, seeded=False, staged=True)
    return out.groupBy(F.col("node").alias("fn")).agg(F.min("hops").alias("hops")).select("fn", (F.col("hops") == 1).alias("direct"), "hops")


def possible_callers(f: Facts, query: str, supers: DataFrame | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """fn, why: units outside the confirmed ones whose unresolved dispatch may lead to one of them.

    A reason dispatch:Owner.member may lead to any confirmed unit named member whose type is Owner or below it; a type that
    the hierarchy does not index may be.  Without a hierarchy the name alone decides; reasons without a dot always count.
    """
    sure = callers(f, query).select("fn").unionByName(best_matches(f.names, query).select("fn")).distinct()
    asks = f.reasons.where(F.col("why").startswith("dispatch:")).join(sure, "fn", "left_anti").withColumn("key", F.substring_index(F.col("why"), "dispatch:", -1))
    plain = asks.where(~F.col("key").contains(".")).select("fn", "why")
    dotted = asks.where(F.col("key").contains(".")).select("fn", "why", names.declaring_type(F.col("key")).alias("owner"), names.simple_method(F.col("key")).alias("member"))
    targets = sure.select(names.declaring_type(F.col("fn")).alias("type"), names.simple_method(F.col("fn")).alias("member")).distinct()
    hits = dotted.join(targets, "member")
    if supers is not None:
        yes = subtype_pairs(supers)
        known = (indexed if indexed is not None else supers.select("type").distinct()).select(F.col("type").alias("k")).distinct()
        hits = hits.join(yes.withColumn("below", F.lit(True)), ["type", "owner"], "left").join(known, F.col("type") == F.col("k"), "left")
        hits = hits.where(F.col("below") | (F.col("type") == F.col("owner")) | F.col("k").isNull())
    return plain.unionByName(hits.select("fn", "why")).distinct()


def subtype_pairs(supers: DataFrame) -> DataFrame:
    """(type, owner): every type with each type above it, from (type, super)."""
    up = supers.select(F.col("type").alias("src"), F.col("super").alias("dst"))
    out = graph.closure(up, supers.select(F.col("type").alias("of"), F.col("type").alias("node")), ["of"], seeded=False)
    return out.select(F.col("of").alias("type"), F.col("node").alias("owner")).distinct()


def subtype_answers(pairs: DataFrame, supers: DataFrame, indexed: DataFrame) -> DataFrame:
    """type, owner, answer (yes, no or unanswerable) of (type, owner): whether a type is an owner or below it.

    A way up decides, whatever else is missing; without one the answer is open where the type or one above it is not indexed.
    """
    up = subtype_pairs(supers)
    same = pairs.select("type", "owner").distinct()
    known = indexed.select(F.col("type").alias("known")).distinct()
    seen = up.unionByName(same.select("type", F.col("type").alias("owner"))).join(known, F.col("owner") == F.col("known"), "left_anti")
    gaps = seen.select("type").distinct().withColumn("gap", F.lit(True))
    rows = same.join(up.withColumn("below", F.lit(True)), ["type", "owner"], "left").join(gaps, "type", "left")
    return rows.select("type", "owner", F.when(F.coalesce("below", F.lit(False)) | (F.col("type") == F.col("owner")), "yes").when(F.col("gap"), "unanswerable").otherwise("no").alias("answer"))


def impact(f: Facts, query: str) -> DataFrame:
    """fn, hops, entry_point: all that call one unit, directly or not; the unit itself is left out, cycle or not."""
    target = select_one(f.units, query)
    seeds = f.units.where(F.col("fn") == target).select(F.col("fn").alias("node")).distinct()
    out = graph.closure(f.callers, seeds, staged=True).where("hops > 0")
    entries = f.units.groupBy("fn").agg(F.max("entry_point").alias("entry_point"))
    return out.withColumnRenamed("node", "fn").join(entries, "fn", "left").select("fn", "hops", F.coalesce("entry_point", F.lit(False)).alias("entry_point"))


def blindspots(f: Facts, classes: list[str] | None = None) -> DataFrame:
    """fn, why (sorted, joined by commas), reaches: units with reasons of their own, and how many others inherit from each.

    The widest reach stands first, of ties the least name.
    """
    rows = f.reasons if not classes else f.reasons.where(scalars.reason_class(F.col("why")).isin(classes))
    sources = rows.groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set("why")), ",").alias("why"))
    pairs = graph.closure(f.callers, sources.select(F.col("fn").alias("source"), F.col("fn").alias("node")), ["source"], staged=True).where("hops > 0")
    reach = pairs.groupBy(F.col("source").alias("fn")).agg(F.count("*").alias("reaches"))
    return sources.join(reach, "fn", "left").select("fn", "why", F.coalesce("reaches", F.lit(0)).alias("reaches")).orderBy(F.desc("reaches"), "fn")


def blindspot_reach(f: Facts, classes: list[str] | None = None) -> DataFrame:
    """fn, affected: each unit with reasons of its own, and each other unit that inherits from it; a row a pair, not a list."""
    rows = f.reasons if not classes else f.reasons.where(scalars.reason_class(F.col("why")).isin(classes))
    pairs = graph.closure(f.callers, rows.select(F.col("fn").alias("source"), F.col("fn").alias("node")).distinct(), ["source"], staged=True)
    return pairs.where("hops > 0").select(F.col("source").alias("fn"), F.col("node").alias("affected"))


def blindspot_stats(f: Facts) -> DataFrame:
    """class, sources: each source counts once for each of its classes; every class has a row."""
    spark = f.units.sparkSession
    counts = f.reasons.select("fn", scalars.reason_class(F.col("why")).alias("class")).distinct().groupBy("class").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(c,) for c in REASON_CLASSES], "class string").join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("sources"))


def path(f: Facts, query: str, effect: str) -> DataFrame:
    """step, fn, source: the shortest chain from one unit to one that performs an effect itself, over units that have it.

    Of equally short chains the first in the order of calls is taken, or where the facts have no order, the one whose names
    come first.  No chain: no rows.
    """
    start = select_one(f.units, query)
    effect = known_effect(f, effect)
    carriers = f.inferred.where(F.col("effect") == effect).select(F.col("fn").alias("dst"))
    calls = f.edges if f.order is None else f.order
    steps = calls.join(carriers, "dst").withColumn("key", F.lit(effect))
    starts = f.units.where(F.col("fn") == start).select(F.lit(effect).alias("key"), F.col("fn").alias("node")).distinct()
    goals = f.direct.where(F.col("effect") == effect).select(F.lit(effect).alias("key"), F.col("fn").alias("node"))
    out = graph.witness(steps, starts, goals)
    return out.select(F.posexplode("path").alias("step", "fn"), F.size("path").alias("n")).select("step", "fn", (F.col("step") == F.col("n") - 1).alias("source"))


def explain(f: Facts, query: str) -> DataFrame:
    """effect, path: for each effect of one unit the shortest chain to a unit that performs it, over all callees."""
    start = select_one(f.units, query)
    if f.given is None:  # what the unit reaches performs what the unit has: no fixpoint is needed
        rows = f.direct.where(F.col("effect").isin(*ALL_EFFECTS)).select("effect").distinct()
    else:
        rows = f.given.where(F.col("fn") == start).select("effect").distinct()
    keys = sorted(r["effect"] for r in rows.collect())  # one an effect of the vocabulary
    goals = f.direct.select(F.col("effect").alias("key"), F.col("fn").alias("node"))
    found = graph.witnesses(f.calls if f.order is None else f.order, start, goals, keys)
    return found.select(F.col("key").alias("effect"), F.array_join("path", " > ").alias("path"))


def nearest_sources(f: Facts) -> DataFrame:
    """fn, effect, hops, source: the nearest unit that performs an effect which fn only inherits.

    All effects are walked at once, from the sources up.  Of equally near sources the one with the least name is given.
    """
    through = f.inferred.select("effect", "fn") if f.given is not None else None  # a fixpoint of one's own holds for all that is walked
    near = nearest(f.callers, f.direct.select("effect", F.col("fn").alias("node")), "effect", staged=True, through=through)
    return near.join(f.direct, ["effect", "fn"], "left_anti").select("fn", "effect", "hops", "source")


def nearest(up: DataFrame, sources: DataFrame, key: str, staged: bool = False, through: DataFrame | None = None) -> DataFrame:
    """(key, fn, hops, source): for each node the least-named of the nearest sources, by levels.

    ``up`` is (src, dst), the same for all keys, or has the key as a column; ``staged`` edges are read as they are each round.
    With ``through`` (key, fn) only its rows are reached.
    """
    from ..plans.staging import Stage

    own = [key] if key in up.columns else []
    steps = up if staged else Stage(up.select(*own, "src", "dst").distinct(), "up").df
    delta = Stage(sources.select(key, F.col("node").alias("fn"), F.col("node").alias("source")).distinct(), "near").df
    levels = [delta.withColumn("hops", F.lit(0))]
    for hop in range(1, graph.ROUNDS):
        found = delta.join(steps, [delta["fn"] == steps["src"], *(delta[k] == steps[k] for k in own)]).select(delta[key], F.col("dst").alias("fn"), "source").groupBy(key, "fn").agg(F.min("source").alias("source"))
        if through is not None:
            found = found.join(through, [key, "fn"], "left_semi")
        known = functools.reduce(DataFrame.unionByName, levels)
        delta = Stage(found.join(known.select(key, "fn"), [key, "fn"], "left_anti"), "near").df
        if delta.isEmpty():
            return known.select(key, "fn", "hops", "source")
        levels.append(delta.withColumn("hops", F.lit(hop)))
        if len(levels) > 8:  # one table of the levels so far, so that a round joins few
            levels = [Stage(functools.reduce(DataFrame.unionByName, levels), "near").df]
    raise RuntimeError("the walk did not settle")


def surprise(hops: Column, effect: Column, fn: Column, source: Column) -> Column:
    benign = F.when(names.lexicon_token(names.leaf(fn), names.BENIGN).isNotNull(), 3).otherwise(1)
    crossing = F.when(names.module_path(source) != names.module_path(fn), 2).otherwise(1)
    return names.salience(effect) * benign * names.hops_factor(hops) * crossing


def located(f: Facts, rows: DataFrame) -> DataFrame:
    """Rows (fn, ...) of a path or a tour with loc, where each unit stands; of repeated names the least place."""
    if "loc" not in f.units.columns:
        return rows.withColumn("loc", F.lit(""))
    places = f.units.groupBy("fn").agg(F.min("loc").alias("loc"))
    return rows.join(places, "fn", "left").withColumn("loc", F.coalesce("loc", F.lit("")))


def tour(f: Facts, n: int = 10) -> DataFrame:
    """fn, effect, hops, source, score: the n most surprising reaches, one a unit.

    Test code and units whose name or module suggests an effect are left out, as are Unknown and effects of no salience.
    """
    if not isinstance(n, int) or n < 1:
        raise Refused("a tour has at least one stop")
    fn = F.col("fn")
    plain = ~names.is_test(fn) & names.lexicon_token(names.leaf(fn), names.EFFECTY).isNull() & names.lexicon_token(names.module_path(fn), names.EFFECTY).isNull()
    scored = nearest_sources(f).where((F.col("effect") != UNKNOWN) & plain).withColumn("score", surprise(F.col("hops"), F.col("effect"), fn, F.col("source"))).where("score > 0")
    order = Window.partitionBy("fn").orderBy(F.desc("score"), "hops", "effect")
    return scored.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").orderBy(F.desc("score"), "hops", "fn").limit(n).select("fn", "effect", "hops", "source", "score")


def audit(f: Facts, suspect: str) -> DataFrame:
    """metric, name, value: units, unresolved, each effect's units, units whose name fits a pattern, the widest units."""
    count = f.units.agg(F.count("*").alias("value")).select(F.lit("units").alias("metric"), F.lit("").alias("name"), "value")
    odd = f.units.where(F.col("fn").rlike(suspect)).agg(F.count("*").alias("value")).select(F.lit("suspect"), F.lit(""), "value")
    per = tally(f).select(F.lit("effect"), "effect", "units")
    wide = broadest(f).select(F.lit("broadest"), "fn", "width")
    return count.union(odd).union(per).union(wide)


def unresolved(f: Facts) -> DataFrame:
    """fn: units that are marked unresolved or have Unknown; read these first."""
    marked = f.units.where("unresolved").select("fn") if "unresolved" in f.units.columns else f.units.select("fn").limit(0)
    return marked.union(f.inferred.where(F.col("effect") == UNKNOWN).join(f.units.select("fn"), "fn", "left_semi").select("fn")).distinct()


def audit_packages(f: Facts, package: Column) -> DataFrame:
    """package, units, unresolved, effects: of each package how many units have an effect, how many of them are unresolved,
    and its effects with their units, the most frequent first (of ties the greatest name)."""
    named = f.units.select("fn").distinct().withColumn("package", package)
    per = f.inferred.join(named, "fn").groupBy("package", "effect").agg(F.count("*").alias("n"))
    ranked = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "effect")))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["effect"]))
    effects = per.where(F.col("effect") != UNKNOWN).groupBy("package").agg(F.array_join(ranked, ",").alias("effects"))
    size = f.inferred.select("fn").distinct().join(named, "fn").join(unresolved(f).withColumn("open", F.lit(True)), "fn", "left").groupBy("package").agg(F.count("*").alias("units"), F.count("open").alias("unresolved"))
    return size.join(effects, "package", "left").select("package", "units", "unresolved", F.coalesce("effects", F.lit("")).alias("effects"))


def partner_table(hosts: list[str]) -> Column:
    """The classes of hosts for ``net_classes`` that a configuration names as partners."""
    return F.create_map(*[x for h in sorted(set(hosts)) for x in (F.lit(h), F.lit("known-partner"))]).cast("map<string,string>")


def net_classes(f: Facts, table: Column) -> DataFrame:
    """fn, class of the units that perform Net: by their visible hosts; unknown-host too where hosts are missing or none is seen."""
    net = f.inferred.where(F.col("effect") == "Net").select("fn")
    hosts = f.reached_literals.where("kind = 'hosts'").select("fn", scalars.net_dest_class(F.col("value"), table).alias("class"))
    seen = net.join(hosts, "fn")
    open_ = net.join(hosts, "fn", "left_anti")
    if f.incomplete is not None:
        open_ = open_.union(net.join(f.reached_incomplete.where("effect = 'Net'"), "fn", "left_semi"))
    return seen.unionByName(open_.withColumn("class", F.lit("unknown-host"))).distinct()
