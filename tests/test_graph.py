"""The fixpoint and walks on small and random graphs, cycles among them."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.facts import Facts
from weirflow.operators import gate, snapshots, verbs
from weirflow.plans import graph
from weirflow.plans import policy as P


def facts(spark, edges, direct, reasons=(), literals=(), entries=()):
    names = sorted({x for e in edges for x in e} | {d[0] for d in direct} | {r[0] for r in reasons})
    return Facts(
        spark.createDataFrame([(n, n in entries) for n in names], "fn string, entry_point boolean"),
        spark.createDataFrame(list(edges), "src string, dst string"),
        spark.createDataFrame(list(direct), "fn string, effect string"),
        spark.createDataFrame(list(reasons), "fn string, why string"),
        spark.createDataFrame(list(literals), "fn string, kind string, value string"),
    )


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fixpoint_is_what_is_reachable(spark, seed):
    rng = random.Random(seed)
    n = 30
    edges = {(f"m::f{rng.randrange(n)}", f"m::f{rng.randrange(n)}") for _ in range(45)} | {("m::f0", "m::f0"), ("m::f1", "m::f2"), ("m::f2", "m::f1")}
    direct = {(f"m::f{rng.randrange(n)}", rng.choice(["Net", "Fs", "Unknown"])) for _ in range(6)}
    reach = {f"m::f{i}": {f"m::f{i}"} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    truth = {(f, e) for f in reach for g, e in direct if g in reach[f]}
    assert pairs(facts(spark, edges, direct).inferred, "fn", "effect") == truth and truth


def test_empty_tables(spark):
    f = facts(spark, [], [])
    assert not f.inferred.collect()
    assert not verbs.blindspots(f).collect()
    assert not verbs.tour(f).collect()
    assert {r["units"] for r in verbs.tally(f).collect()} == {0}


def test_closure_seeds_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("c",)], "node string")
    assert pairs(graph.closure(e, seeds.where("node = 'a'"), seeded=False), "node", "hops") == {("b", 1), ("a", 2), ("c", 2)}
    assert pairs(graph.closure(e, seeds), "node", "hops") == {("a", 0), ("c", 0), ("b", 1)}


CHAIN = [("app::api::get", "app::domain::plan"), ("app::domain::plan", "app::domain::price"), ("app::domain::price", "app::infra::call")]


def test_who_is_included(spark):
    f = facts(spark, CHAIN, [("app::infra::call", "Net")], entries={"app::api::get"})
    assert pairs(verbs.callers(f, "price"), "fn", "direct") == {("app::domain::plan", True), ("app::api::get", False)}
    assert pairs(verbs.impact(f, "app::domain::price"), "fn") == {("app::domain::plan",), ("app::api::get",)}
    assert pairs(gate.whatif(f, "price", "Db"), "fn") == {("app::domain::price",), ("app::domain::plan",), ("app::api::get",)}
    assert [r["fn"] for r in verbs.path(f, "get", "Net").orderBy("step").collect()] == ["app::api::get", "app::domain::plan", "app::domain::price", "app::infra::call"]
    assert pairs(verbs.where(f, "Net").where("how = 'directly'"), "fn") == {("app::infra::call",)}
    with pytest.raises(verbs.Refused):
        verbs.impact(f, "app")
    with pytest.raises(verbs.Refused):
        verbs.impact(f, "nobody")


def test_path_takes_the_first_names(spark):
    f = facts(spark, [("s", "b"), ("s", "a"), ("a", "y"), ("b", "x")], [("x", "Fs"), ("y", "Fs")])
    assert [r["fn"] for r in verbs.path(f, "s", "Fs").orderBy("step").collect()] == ["s", "a", "y"]
    assert not verbs.path(f, "s", "Net").collect()


def test_tour_prefers_plain_names(spark):
    f = facts(spark, [("app::model::settings", "app::infra::go"), ("app::http::settings", "app::infra::go"), ("app::tests::settings", "app::infra::go"), ("app::model::thing", "app::infra::go")], [("app::infra::go", "Net")])
    got = verbs.tour(f).collect()
    assert [(r["fn"], r["hops"], r["score"]) for r in got] == [("app::model::settings", 1, 60), ("app::model::thing", 1, 20)]
    with pytest.raises(verbs.Refused):
        verbs.tour(f, 0)


def test_fix(spark):
    f = facts(spark, CHAIN, [("app::infra::call", "Net")])
    got = pairs(gate.fix(f, "plan", "Net", P.parse("deny Net domain")), "role", "fn")
    assert got == {("site", "app::infra::call"), ("hoist", "app::domain::price")} or got >= {("site", "app::infra::call"), ("span", "app::domain::price"), ("span", "app::domain::plan"), ("hoist", "app::api::get")}


def test_forbid_only_and_ways_back(spark):
    f = facts(spark, CHAIN + [("app::infra::call", "app::util::x"), ("app::api::a", "app::api::b")], [])
    assert pairs(gate.forbidden(f, P.parse("forbid api -> infra")), "fn") == {("app::api::get",)}
    assert pairs(gate.forbidden(f, P.parse("forbid api -> api")), "fn") == {("app::api::a",)}
    # permitted units are not walked through, and a permitted scope is exact
    assert not gate.permitted_only(f, P.parse("only api -> domain")).collect()
    assert pairs(gate.permitted_only(f, P.parse("only api -> dom")), "fn") == {("app::api::get",)}
    assert pairs(gate.permitted_only(f, P.parse("only domain -> util")), "fn") == {("app::domain::plan",), ("app::domain::price",)}


def test_narrowed_rules_need_evidence(spark):
    f = facts(spark, [("a::f", "b::g")], [("b::g", "Unknown"), ("c::h", "Unknown")], [("b::g", "callback:x")])
    p = P.parse("deny Unknown[indirect]")
    assert pairs(gate.denied(f, p), "fn") == {("a::f",), ("b::g",)}
    assert not gate.denied(f, P.parse("deny Unknown[native]")).collect()
    assert not gate.denied(f, P.parse("pure")).collect()
    assert pairs(gate.unverified(f, P.parse("pure")), "fn", "upgrade") == {(x, "deny Unknown") for x in ("a::f", "b::g", "c::h")}


def test_accepts(spark):
    f = facts(spark, [], [("dao.a", "Fs"), ("dao.b", "Fs"), ("dao.k", "Clock")])
    p = P.parse("deny Fs dao\naccept dao.a Fs for deny  Fs dao because it reads a file\naccept dao.z Fs for deny Fs dao because gone")
    stands, entries = gate.settle(gate.denied(f, p), p, f)
    assert pairs(stands, "fn") == {("dao.b",)}
    assert pairs(entries, "fn", "status") == {("dao.a", "accepted"), ("dao.z", "stale")}


def test_snapshots(spark):
    before, now = facts(spark, [("m::a", "m::b")], [("m::b", "Fs")]), facts(spark, [("m::a", "m::b")], [("m::b", "Fs"), ("m::b", "Net"), ("m::c", "Db")])
    assert pairs(snapshots.effect_changes(now, before), "fn", "effect", "change", "status") == {("m::a", "Net", "inherited", "changed"), ("m::b", "Net", "introduced", "changed"), ("m::c", "Db", "introduced", "new")}
    assert pairs(snapshots.endpoints(now, before), "fn") == {("m::a",)}
    assert pairs(snapshots.gains(now, before), "fn", "origin") == {("m::a", "existing"), ("m::b", "existing"), ("m::c", "new")}
    assert pairs(snapshots.dropped_calls(facts(spark, [], [("m::a", "Fs")]), before), "src", "dst") == {("m::a", "m::b")}


def test_containment_owner_ties_go_to_the_greatest_name(spark):
    f = facts(spark, [("app::data::x", "app::web::y")], [("app::data::x", "Db"), ("app::web::y", "Db")])
    r = verbs.containment(f).first()
    assert (r["effect"], r["layers"], r["owner"], r["percent"]) == ("Db", 2, "web", 50)


def test_dispatch_frontier(spark):
    f = facts(spark, [("x::Child.run", "y::leaf")], [("y::leaf", "Net")], [("u::one", "dispatch:Base.run"), ("u::two", "dispatch:Other.run"), ("u::three", "dispatch:run"), ("u::four", "callback:z")])
    supers = spark.createDataFrame([("x::Child", "Base")], "type string, super string")
    assert pairs(verbs.possible_callers(f, "leaf", supers), "fn") == {("u::one",), ("u::three",)}
    assert pairs(verbs.possible_callers(f, "leaf"), "fn") == {("u::one",), ("u::two",), ("u::three",)}


def test_blindspot_reach_leaves_the_source_out(spark):
    f = facts(spark, [("a", "s"), ("s", "a"), ("b", "a")], [("s", "Unknown")], [("s", "native:z"), ("s", "reflect:y")])
    assert pairs(verbs.blindspots(f), "fn", "why", "reaches") == {("s", "native:z,reflect:y", 2)}
    assert {r["class"]: r["sources"] for r in verbs.blindspot_stats(f).collect()}["reflect"] == 1


def test_conformance(spark):
    f = facts(spark, [], [("a", "Fs"), ("b", "Unknown")], entries={"b"})
    d = spark.createDataFrame([("a", ["Net"]), ("b", []), ("c", None)], "fn string, declared array<string>")
    assert pairs(gate.conformance(d, f), "rule", "fn", "effects") == {("AS-EFF-001", "a", "Fs"), ("AS-EFF-002", "a", "Net"), ("AS-EFF-003", "b", "Unknown")}


def test_allow(spark):
    f = facts(spark, [("a::f", "b::g")], [("b::g", "Net"), ("c::h", "Net")], literals=[("b::g", "hosts", "api.example.com:443")])
    assert pairs(gate.allowed(f, P.parse("allow Net api.example.com")), "fn", "detail") == {("c::h", "no visible literal")}
    assert pairs(gate.allowed(f, P.parse("allow Net in a other.org")), "fn", "detail") == {("a::f", "api.example.com:443")}
    assert f.reached_literals.where(F.col("fn") == "a::f").count() == 1


@pytest.mark.parametrize("ordered", [False, True])
def test_explain_walks_once_for_all_effects(spark, monkeypatch, ordered):
    """The least of the shortest chains of each effect; neither the edges times the effects nor a fixpoint is staged."""
    rng = random.Random(3)
    edges = sorted({(f"m::f{rng.randrange(25)}", f"m::f{rng.randrange(25)}") for _ in range(50)} | {("m::f0", "m::f1"), ("m::f1", "m::f0")})
    direct = {(f"m::f{rng.randrange(25)}", e) for e in ("Net", "Fs", "Db") for _ in range(2)} | {("m::f99", "Log")}
    place = {e: rng.randrange(100) if ordered else 0 for e in edges}
    near, level = {}, {"m::f0": ([], ["m::f0"])}
    while level:
        near |= level
        after = {}
        for (a, b), n in place.items():
            if a in level and b not in near:
                after[b] = min(after.get(b, ([1000], [])), ([*level[a][0], n], [*level[a][1], b]))
        level = after
    want = {}
    for fn, effect in direct:
        if fn in near:
            want[effect] = min(want.get(effect, (99,)), (len(near[fn][1]), *near[fn]))
    f = facts(spark, edges, direct)
    if ordered:
        f.order = spark.createDataFrame([(*e, n) for e, n in place.items()], "src string, dst string, ord int")
    monkeypatch.setattr(graph, "witness", None)
    monkeypatch.setattr(graph, "propagate", None)
    assert pairs(verbs.explain(f, "m::f0"), "effect", "path") == {(e, " > ".join(w[2])) for e, w in want.items()} and len(want) == 3
