"""The registered queries over the bridge facts; ``oracles`` has their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .facts import Facts
from .functions import names, scalars
from .operators import completeness, extensions, gate, snapshots, verbs
from .plans import policy as P
from .plans.staging import shared_dir
from .sources import bridge, reports

#: Cached facts of a session, so that queries that ask about the same tables share one fixpoint.
_facts: dict[tuple, object] = {}


def _written(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables of a folder were written, so that changed tables get new facts."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files)


def _with(f: Facts, **changes) -> Facts:
    """The facts with some tables replaced; the fixpoint stays where what it is made from does."""
    out = replace(f, **changes)
    if "edges" not in changes:
        out.calls = f.calls
    if not {"edges", "direct", "reasons"} & set(changes):
        out.__dict__["masks"] = f.masks
    return out


def facts(spark: SparkSession, sf_dir: str, baseline: bool = False):
    key = (spark.sparkContext.applicationId, sf_dir, _written(spark, sf_dir), baseline)
    if key not in _facts:
        if len(_facts) > 8:
            _facts.clear()
        _facts[key] = bridge.facts(spark, sf_dir, baseline)
    return _facts[key]


POLICY = """
# the rules that the gate queries judge
deny Net app::nation
deny Db Fs order
pure region
deny Unknown[dispatch,native] app::customer
deny Exec nowhere
allow Net in supplier blog.therst.example.net m.tionsh.example.net
allow Fs in app::part /data/economy /data/promo
forbid customer -> supplier
forbid app::part -> app::order
only app::order -> app::part
"""
TARGET = "supplier::s1"
UNIT = "app::nation::n1"

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def effect_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit with every effect it performs or inherits."""
    return facts(spark, sf).inferred


@query
def effect_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).inferred.groupBy("effect").agg(F.count("*").alias("units"))


@query
def reason_class_closure(spark, sf):
    return facts(spark, sf).reason_classes


@query
def literal_surfaces(spark, sf):
    return facts(spark, sf).reached_literals.where("kind = 'hosts'")


@query
def show(spark, sf):
    return verbs.show(facts(spark, sf), "nation::n1")


@query
def where_effect(spark, sf):
    return verbs.where(facts(spark, sf))


@query
def tally(spark, sf):
    return verbs.tally(facts(spark, sf))


@query
def module_map(spark, sf):
    return verbs.module_map(facts(spark, sf))


@query
def broadest_units(spark, sf):
    return verbs.broadest(facts(spark, sf))


@query
def reachable(spark, sf):
    return verbs.reachable(facts(spark, sf))


@query
def containment(spark, sf):
    return verbs.containment(facts(spark, sf))


@query
def ambient_layers(spark, sf):
    return verbs.ambient(facts(spark, sf))


@query
def containment_ratchet(spark, sf):
    """Fs moved from suppliers to parts since a snapshot."""
    now = facts(spark, sf)
    moved = now.direct.where("effect <> 'Fs'").union(now.units.where("fn like 'app::supplier%'").select("fn", F.lit("Fs")))
    return verbs.containment_changes(now, _with(now, direct=moved))


@query
def callers(spark, sf):
    return verbs.callers(facts(spark, sf), TARGET)


@query
def possible_callers(spark, sf):
    """Dispatches to the member s1 or s2 of a supplier, of which the target is one."""
    f = facts(spark, sf)
    key = F.regexp_extract("fn", "([0-9]+)$", 1).cast("long")
    why = F.when(F.col("why").startswith("dispatch"), F.concat(F.lit("dispatch:app::supplier.s"), F.when(F.floor(key / 4) % 5 == 0, "2").otherwise("1"))).otherwise(F.col("why"))
    return verbs.possible_callers(_with(f, reasons=f.reasons.select("fn", why.alias("why"))), TARGET)


@query
def impact(spark, sf):
    return verbs.impact(facts(spark, sf), "app::supplier::s1")


@query
def path(spark, sf):
    return verbs.path(facts(spark, sf), UNIT, "Db")


@query
def blindspots(spark, sf):
    return verbs.blindspots(facts(spark, sf))


@query
def blindspot_stats(spark, sf):
    return verbs.blindspot_stats(facts(spark, sf))


@query
def nearest_sources(spark, sf):
    return verbs.nearest_sources(facts(spark, sf))


@query
def tour(spark, sf):
    return verbs.tour(facts(spark, sf))


@query
def audit(spark, sf):
    return verbs.audit(facts(spark, sf), "nation|n2")


@query
def whatif(spark, sf):
    return gate.whatif(facts(spark, sf), TARGET, "Net", P.parse(POLICY))


@query
def diff(spark, sf):
    return snapshots.effect_changes(facts(spark, sf), facts(spark, sf, True))


@query
def diff_endpoints(spark, sf):
    return snapshots.endpoints(facts(spark, sf), facts(spark, sf, True))


@query
def diff_ranking(spark, sf):
    return snapshots.ranked(facts(spark, sf), facts(spark, sf, True))


@query
def gains(spark, sf):
    return snapshots.gains(facts(spark, sf), facts(spark, sf, True))


@query
def gained_effects(spark, sf):
    return snapshots.gained_effects(facts(spark, sf), facts(spark, sf, True))


@query
def dropped_calls(spark, sf):
    """Turned round, so that calls are missing: what was and is no more."""
    return snapshots.dropped_calls(facts(spark, sf, True), facts(spark, sf))


@query
def missing_units(spark, sf):
    return snapshots.missing_units(facts(spark, sf).units, facts(spark, sf, True).units)


@query
def baseline_guard(spark, sf):
    return snapshots.guard(facts(spark, sf), facts(spark, sf, True))


@query
def receipt(spark, sf):
    return snapshots.receipt(facts(spark, sf))


@query
def gate_deny(spark, sf):
    return gate.denied(facts(spark, sf), P.parse(POLICY))


@query
def gate_withheld(spark, sf):
    """All customers are reported Unknown, some without any reason."""
    f = facts(spark, sf)
    given = f.inferred.union(f.units.where("fn like 'app::customer%'").select("fn", F.lit("Unknown"))).distinct()
    return gate.withheld(_with(f, given=given), P.parse(POLICY))


@query
def gate_allow(spark, sf):
    return gate.allowed(facts(spark, sf), P.parse(POLICY)).select("raw", "fn", "detail")


@query
def gate_forbid(spark, sf):
    return gate.forbidden(facts(spark, sf), P.parse(POLICY)).select("raw", "fn", "detail")


@query
def gate_only(spark, sf):
    return gate.permitted_only(facts(spark, sf), P.parse(POLICY)).select("raw", "fn")


@query
def gate_judged(spark, sf):
    """I16: the whole policy, a row a rule."""
    return gate.judged(facts(spark, sf), P.parse(POLICY))


@query
def gate_scope_binding(spark, sf):
    return gate.scope_binding(facts(spark, sf), P.parse(POLICY))


@query
def gate_zero_match(spark, sf):
    return gate.zero_match(facts(spark, sf), P.parse(POLICY))


@query
def gate_multi_match(spark, sf):
    return gate.multi_match(facts(spark, sf), P.parse(POLICY))


@query
def unverified_holes(spark, sf):
    return gate.unverified(facts(spark, sf), P.parse(POLICY))


@query
def ambient_authority(spark, sf):
    return gate.ambient_authority(facts(spark, sf)).select("fn", "effects")


@query
def fix_remedy(spark, sf):
    return gate.fix(facts(spark, sf), UNIT, "Net", P.parse("deny Net customer\ndeny Net supplier"))


@query
def accept_settlement(spark, sf):
    f = facts(spark, sf)
    p = P.parse("deny Net app::nation\naccept app::nation::n1 Net for deny Net app::nation because known\naccept app::nation::n2 Fs for deny Net app::nation because no\naccept app::nation::n999 Net for deny Net app::nation because gone")
    stands, entries = gate.settle(gate.denied(f, p), p, f)
    return stands.select("fn", F.lit("violation").alias("status")).unionByName(entries.select("fn", "status"))


@query
def subtype_closure(spark, sf):
    """Regions, nations and customers as a hierarchy of types."""
    edges = facts(spark, sf).edges.where("src like 'app::region%' or src like 'app::nation%'")
    return verbs.subtype_pairs(edges.select(F.col("dst").alias("type"), F.col("src").alias("super")))


@query
def scalar_hosts(spark, sf):
    url = F.col("url")
    host = scalars.net_host_literal(url)
    return bridge.table(spark, sf, "pages").select("page_id", host.alias("host"), scalars.host_part(F.concat(host, F.lit(":8080"))).alias("bare"))


@query
def scalar_commands(spark, sf):
    cmd = F.concat(F.lit("/usr/bin/"), F.translate("p_name", " ", "-"))
    return bridge.table(spark, sf, "part").select("p_partkey", scalars.cmd_base(cmd).alias("base"))


@query
def scalar_path_cover(spark, sf):
    path_ = F.concat(F.lit("/data//./"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
    return bridge.table(spark, sf, "part").select("p_partkey", scalars.fs_path_covered(F.lit("/data/promo/"), path_).alias("promo"), scalars.fs_path_covered(F.lit("/dat"), path_).alias("sibling"))


@query
def scalar_table_cover(spark, sf):
    t = F.concat(F.col("p_type"), F.lit("."), F.translate("p_name", " ", "_"))
    return bridge.table(spark, sf, "part").select("p_partkey", scalars.db_table_covered(F.lit("promo.*"), t).alias("whole"), scalars.db_table_covered(F.lit("Economy.cold_widget"), t).alias("one"))


@query
def scalar_names(spark, sf):
    fn = F.col("fn")
    return facts(spark, sf).units.select(
        "fn", names.match_tier(fn, "order::o1").alias("tier"), names.scope_matches(fn, "order::o1").alias("prefix"), names.scope_matches(fn, "order::o1::").alias("exact"),
        names.simple_method(fn).alias("method"), names.declaring_type(fn).alias("type"), names.module_of(fn).alias("module"), F.array_join(names.tokens(fn), " ").alias("tokens"), names.is_test(fn).alias("test"),
    )


@query
def scalar_reasons(spark, sf):
    return facts(spark, sf).reasons.select("fn", scalars.reason_class(F.col("why")).alias("class"))


@query
def scalar_tokens(spark, sf):
    """Tokens of part names, and which of them a lexicon has."""
    name = F.translate("p_name", " ", "_")
    return bridge.table(spark, sf, "part").select("p_partkey", F.array_join(names.tokens(name), " ").alias("tokens"), names.lexicon_token(name, ["widget", "bolt"]).alias("hit"))


@query
def manifest_digest(spark, sf):
    """FNV-1a of each module's sorted names."""
    names_ = facts(spark, sf).units.select(F.substring_index("fn", "::", 2).alias("module"), "fn")
    return scalars.fnv1a_by(names_, "module", "fn").select("module", "digest")


@query
def net_destinations(spark, sf):
    """Where units that perform Net go, by a table of two domains."""
    table = F.create_map(F.lit("example.org"), F.lit("known-partner"), F.lit("example.net"), F.lit("known-telemetry"))
    return verbs.net_classes(facts(spark, sf), table)


@query
def capability_conformance(spark, sf):
    """Nations and regions declare Net and Db."""
    f = facts(spark, sf)
    declared = f.units.where("fn like 'app::nation%' or fn like 'app::region%'").select("fn", F.array(F.lit("Net"), F.lit("Db")).alias("declared"))
    return gate.conformance(declared, f, strict_scope="nation").select("rule", "fn", "effects")


@query
def coverage_delta(spark, sf):
    """Pairs of part and supplier in two snapshots of the orders."""
    pairs = bridge.table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("@", "l_partkey", "l_suppkey").alias("name"))
    return snapshots.coverage_delta(pairs.where("l_orderkey % 5 <> 0"), pairs.where("l_orderkey % 7 <> 0"))


@query
def twin_names(spark, sf):
    """Part names as units, their keys as hashes."""
    units = bridge.table(spark, sf, "part").select(F.col("p_name").alias("fn"), F.col("p_partkey").cast("string").alias("hash"))
    return gate.twin_names(units)


@query
def accept_proposals(spark, sf):
    f = facts(spark, sf)
    return gate.proposals(gate.denied(f, P.parse("deny Net Db app::nation")), "agreed")


@query
def first_broken_rule(spark, sf):
    hits = gate.effect_hits(facts(spark, sf), P.parse("deny Db app::nation\ndeny Net\npure app")).where("state = 'hit'")
    return gate.first_rule(hits.select("fn", "raw", "order").distinct())


@query
def explain_unit(spark, sf):
    """For each effect of a region the shortest chain to a unit that performs it."""
    return verbs.explain(facts(spark, sf), "app::region::r1")


@query
def uncovered_packages(spark, sf):
    """Kinds of parts as packages, some calibrated by name, by name and underscore, or by prefix, some analyzed."""
    part = bridge.table(spark, sf, "part")
    kind, what = F.lower("p_type"), F.translate("p_name", " ", "_")
    seen = part.select(F.concat_ws("_", kind, what).alias("name")).union(part.select(kind)).union(part.select(what))
    return extensions.uncovered(seen, part.where("p_size = 1").select(what.alias("name")), ["promo", "red_bolt"], ["eco", "small_r"], ["medium"])


RULES = """
# classes of calls that this project adds
Net crate promo
Fs path economy::small
Db   path standard::
Nothing crate large
Exec crate
"""


@query
def user_rules(spark, sf):
    """M1: orders call parts by path; a user's rules say what that does."""
    path_ = F.concat_ws("::", F.lower("p_type"), F.translate("p_name", " ", "_"))
    part = bridge.table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("package"), path_.alias("path"))
    calls = bridge.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("app::order::o"), "l_orderkey").alias("fn"), "package", "path")
    return extensions.classify(calls, extensions.parse_rules(RULES))


def _dispatch(spark, sf):
    segment = F.element_at(F.array(*map(F.lit, ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "nothing"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    impls = bridge.table(spark, sf, "nation").select(segment.alias("trait"), F.lit("run").alias("method"), F.concat(F.lit("app::nation::n"), "n_nationkey").alias("target"))
    calls = bridge.table(spark, sf, "customer").select(F.concat(F.lit("app::customer::c"), "c_custkey").alias("fn"), F.col("c_mktsegment").alias("trait"), F.lit("run").alias("method"))
    return extensions.dispatch_targets(calls, impls)


@query
def dispatch_targets(spark, sf):
    """Market segments as traits that nations implement."""
    return _dispatch(spark, sf)[0]


@query
def dispatch_unknown(spark, sf):
    """Segments without an implementation."""
    return _dispatch(spark, sf)[1]


@query
def late_unknown(spark, sf):
    """E5: customers become Unknown after the fixpoint, nations above them don't."""
    f = facts(spark, sf)
    return extensions.with_late_unknown(f, f.units.where("fn like 'app::customer%'").select("fn"))


@query
def tour_caveat(spark, sf):
    return extensions.unknown_caveat(facts(spark, sf))


@query
def enforcement_scope(spark, sf):
    fn = F.col("fn")
    return facts(spark, sf).units.select("fn", *(extensions.in_scope(s, fn).alias(n) for s, n in ((None, "unset"), ("1", "whole"), ("", "blank"), ("app::part", "prefix"))))


@query
def scalar_reason_match(spark, sf):
    """Classes of a unit's own reasons against wanted ones; none count as unresolved."""
    f = facts(spark, sf)
    own = f.reasons.groupBy("fn").agg(F.collect_set(scalars.reason_class(F.col("why"))).alias("classes"))
    rows = f.units.join(own, "fn", "left")
    return rows.select("fn", *(scalars.reason_class_matches(F.col("classes"), w).alias("_or_".join(w)) for w in (["dispatch"], ["unresolved"], ["native", "unresolved"])))


@query
def scalar_fs_kind(spark, sf):
    """What the last name of a file operation does."""
    ops = ["std::fs::read_to_string", "std::fs::write", "std::fs::copy", "std::fs::OpenOptions::open", "std::fs::metadata", "app::tidy", "std::fs::create_dir_all::<P>"]
    op = F.element_at(F.array(*map(F.lit, ops)), (F.col("p_partkey") % len(ops) + 1).cast("int"))
    return bridge.table(spark, sf, "part").select("p_partkey", F.array_join(F.sort_array(scalars.fs_kind(op)), ",").alias("kind"))


@query
def scalar_spec(spark, sf):
    """Versions as numbers, not as text."""
    spec = F.when(F.col("p_partkey") % 10 == 0, "draft").otherwise(F.concat_ws(".", "p_size", F.col("p_partkey") % 60))
    return bridge.table(spark, sf, "part").select("p_partkey", scalars.spec_predates(spec, 9, 30).alias("older"))


@query
def scalar_keys(spark, sf):
    """Rule texts, positional names, keys of entries."""
    part = bridge.table(spark, sf, "part")
    closure = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_brand"), F.lit("::{closure#"), "p_size", F.lit("}"))).otherwise(F.concat(F.col("p_brand"), F.lit("::{closure}")))
    hash_ = F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_partkey").cast("string"))
    return part.select("p_partkey", scalars.rule_key(F.concat(F.lit("  deny\t"), "p_type", F.lit("  \n "), "p_name", F.lit(" "))).alias("rule"), scalars.is_positional(closure).alias("positional"), scalars.entry_key(hash_, F.col("p_name")).alias("key"))


@query
def scalar_segments(spark, sf):
    """Names cut on :: where they have it, else on dots."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("::", "p_type", F.translate("p_name", " ", "."))).otherwise(F.concat_ws(".", "p_type", F.translate("p_name", " ", ".")))
    return bridge.table(spark, sf, "part").select("p_partkey", F.array_join(names.segments(name), "/").alias("segments"), F.size(names.segments(name)).alias("n"))


@query
def key_states(spark, sf):
    """A key of an envelope is absent, present or corrupt."""
    text = F.element_at(F.array(*map(F.lit, ('{"switches":["a","b"]}', "{}", '{"switches":5}', '{"switches":[]}', '{"switches":{"a":1}}'))), (F.col("p_partkey") % 5 + 1).cast("int"))
    state, value = reports.key_state(text, "switches")
    return bridge.table(spark, sf, "part").select("p_partkey", state.alias("state"), F.coalesce(F.size(value), F.lit(-1)).alias("n"))


def _repeats(spark, sf):
    part = bridge.table(spark, sf, "part")
    return part.select(F.col("p_name").alias("fn"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos"), F.array("p_type").alias("inferred"), F.array(F.col("p_size").cast("string")).alias("direct"), F.array("p_brand").alias("calls"))


@query
def merged_repeats(spark, sf):
    """A5: the sets of repeated names united."""
    return reports.merged(_repeats(spark, sf)).select("fn", *(F.array_join(c, ",").alias(c) for c in ("inferred", "direct", "calls")))


@query
def last_of_repeats(spark, sf):
    """D3: of repeated names the last by file and place."""
    return reports.last_of_name(_repeats(spark, sf)).select("fn", "path", "pos")


@query
def resolved_calls(spark, sf):
    """Part names called from brands: in the brand, the only one anywhere, or ambiguous."""
    part = bridge.table(spark, sf, "part")
    rows = part.select(F.concat_ws("#", "p_brand", "p_partkey").alias("key"), F.col("p_brand").alias("package"), F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" "), "p_partkey")).otherwise(F.col("p_name")).alias("fn"), F.array(F.lit("red bolt"), F.lit("red bolt 4"), F.col("p_type"), F.concat(F.col("p_name"), F.lit(" 8"))).alias("calls"))
    return reports.resolve_calls(rows)


@query
def dependency_effects(spark, sf):
    """Effects from packages scanned before; another version's say only Unknown."""
    part = bridge.table(spark, sf, "part")
    rows = part.select(F.concat(F.lit("p"), "p_partkey").alias("fn"), F.array("p_name", "p_type").alias("calls"))
    deps = part.groupBy(F.col("p_name").alias("fn")).agg(F.sort_array(F.collect_set(F.lower("p_type"))).alias("effects"), F.when(F.min("p_partkey") % 2 == 0, "2").otherwise("1").alias("version"))
    return reports.chained(rows, deps, "2")


@query
def tainted_effects(spark, sf):
    """Effects of events that a caller's value feeds."""
    events = bridge.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("fn"), F.col("event_type").alias("effect"), (F.col("value") > 50).alias("tainted"))
    return gate.tainted(events).select("rule", "fn", "effects")


@query
def zero_match_parts(spark, sf):
    """Counts of matches a rule over several parts of a verdict; the rules that matched nothing in any."""
    parts = bridge.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("rule"), "l_returnflag").agg(F.count_if(F.col("l_quantity") > 40).alias("count"))
    return completeness.assemble(parts.select(F.col("rule").cast("string"), "count"))


@query
def violation_order(spark, sf):
    """The first violations in the order of rule, detail and unit."""
    f, p = facts(spark, sf), P.parse(POLICY)
    rows = gate.denied(f, p).unionByName(gate.ambient_authority(f))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("detail", "fn", "raw"))
    return rows.withColumn("place", place).where("place <= 20").select("rule", "place", "fn", "raw", "effects")


@query
def show_unit(spark, sf):
    """All that a report tells of one unit."""
    return verbs.show_unit(facts(spark, sf), "nation::n1")


@query
def blindspot_reach(spark, sf):
    """Who inherits from which blind spot."""
    return verbs.blindspot_reach(facts(spark, sf))


@query
def unresolved_units(spark, sf):
    """units to be read first."""
    return verbs.unresolved(facts(spark, sf))


@query
def audit_packages(spark, sf):
    """the kinds of units as packages."""
    return verbs.audit_packages(facts(spark, sf), F.split_part("fn", F.lit("::"), F.lit(2)))


@query
def subtype_answers(spark, sf):
    """Whether a customer is below a region, by way of nations of which some are not indexed."""
    nation, customer = bridge.table(spark, sf, "nation"), bridge.table(spark, sf, "customer")
    n, c = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey")
    supers = nation.select(n.alias("type"), F.concat(F.lit("r"), "n_regionkey").alias("super")).union(customer.select(c, F.concat(F.lit("n"), "c_nationkey")))
    indexed = nation.where("n_nationkey % 5 <> 3").select(n.alias("type")).union(customer.select(c)).union(bridge.table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey")))
    return verbs.subtype_answers(customer.select(c.alias("type"), F.concat(F.lit("r"), F.col("c_custkey") % 5).alias("owner")), supers, indexed)


@query
def fix_gate(spark, sf):
    """Remedies for all crossings of two layers."""
    return gate.fix_gate(facts(spark, sf), P.parse("deny Db app::customer\ndeny Exec app::nation"))


@query
def accept_plan(spark, sf):
    """What would settle the violations of a policy with three entries."""
    f = facts(spark, sf)
    p = P.parse("deny Db Exec app::nation\naccept app::nation::n1 Db Exec Fs for deny Db Exec app::nation because known\naccept app::nation::n2 Db for deny Db Exec app::nation because some\naccept app::nation::n999 Db for deny Db Exec app::nation because gone")
    return gate.accept_plan(gate.denied(f, p), p, f, "agreed")


@query
def gate_forbid_beyond(spark, sf):
    """Nations that reach a scope only through other packages' units, here every tenth customer."""
    f = facts(spark, sf)
    far = bridge.table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("app::customer::c"), "c_custkey").alias("fn"), F.lit("elsewhere").alias("scope"))
    return gate.forbidden(f, P.parse("forbid app::nation -> elsewhere"), far).select("raw", "fn", "detail")


@query
def gate_verdict(spark, sf):
    """The verdict over a policy: how many violations and open questions, rules that bind nothing, and the exit."""
    f, p = facts(spark, sf), P.parse(POLICY)
    counts = gate.judged(f, p).agg(F.sum("violations").alias("violations"), F.sum("unevaluated").alias("unevaluated"))
    zero = gate.zero_match(f, p).agg(F.count("*").alias("zero_match"))
    n = counts.join(zero).first()
    status, why = completeness.verdict(n["violations"], n["unevaluated"], completeness.Completeness())
    return spark.createDataFrame([(*n, status, why)], "violations long, unevaluated long, zero_match long, status int, verdict string")


@query
def verdict_parts(spark, sf):
    """Violations written as JSON lines by one run and read by another."""
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    gate.denied(facts(spark, sf), P.parse(POLICY)).write.json(path)
    return completeness.parts(spark, path).select("raw", "fn", "effects")


def _reports(spark, sf) -> str:
    """Reports of regions and nations, and of customers with even and with odd keys, the last by an older version."""
    f = facts(spark, sf)
    prefix = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}/snapshot"
    sets = [f.inferred.groupBy("fn").agg(F.sort_array(F.collect_set("effect")).alias("inferred")), f.direct.groupBy("fn").agg(F.sort_array(F.collect_set("effect")).alias("direct"))]
    rows = f.units.select("fn", F.col("entry_point").alias("entryPoint"), F.sha2("fn", 256).alias("hash"))
    for one in sets:
        rows = rows.join(one, "fn", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("inferred", "direct")})
    key = F.regexp_extract("fn", "([0-9]+)$", 1)
    odd = F.col("fn").startswith("app::customer") & key.endswith("1") | F.col("fn").startswith("app::customer") & key.endswith("7")
    even = F.col("fn").startswith("app::customer") & ~odd
    for package, which, version in (("top", F.col("fn").rlike("^app::(region|nation)"), "2"), ("even", even, "2"), ("odd", odd, "1")):
        reports.write_report(rows.where(which), f"{prefix}.{package}.scan.json", package, version)
    return prefix


@query
def reports_scan(spark, sf):
    """A1 to A4, B1: units of three reports, written and read again."""
    return reports.units(spark, _reports(spark, sf)).select("fn", F.array_join("inferred", ",").alias("inferred"), F.array_join("direct", ",").alias("direct"), F.col("entryPoint").alias("entry_point"))


@query
def report_envelopes(spark, sf):
    """Who wrote the reports and how many units they hold."""
    return reports.envelopes(spark, _reports(spark, sf)).select("package", "version", F.col("analyzed.count").alias("units"), "switches_state")


@query
def sibling_effects(spark, sf):
    """What nations get from customers by the other packages' reports, one of them by an older version."""
    effects, _ = reports.siblings(spark, _reports(spark, sf), "top", "scan", "2")
    calls = facts(spark, sf).edges.where("src like 'app::nation%'").select(F.col("src").alias("fn"), F.sha2("dst", 256).alias("hash"))
    return calls.join(effects, "hash").select("fn", "effect").distinct()


@query
def baseline_effects(spark, sf):
    """An earlier report of one package that this version wrote."""
    return reports.baseline(spark, _reports(spark, sf), "even", "2", declared=True)
