"""Scalar functions, the policy grammar, reports at rest and verdicts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions import names, scalars
from weirflow.operators import completeness, gate, verbs
from weirflow.plans import policy as P
from weirflow.sources import reports
from weirflow.streaming import watch


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f,value,expected",
    [
        (scalars.host_part, "api.example.com:80", "api.example.com"), (scalars.host_part, "[::1]:80", "::1"), (scalars.host_part, "fe80::1", "fe80::1"), (scalars.host_part, "a", "a"),
        (scalars.net_host_literal, "https://u:p@api.example.com/v1", "api.example.com"), (scalars.net_host_literal, "localhost:8080", None), (scalars.net_host_literal, "localhost:11434", "localhost:11434"), (scalars.net_host_literal, "GET x.y", None),
        (scalars.cmd_base, "/usr/bin/git", "git"), (scalars.cmd_base, "C:\\x\\y.exe", "y.exe"), (scalars.cmd_base, "git", "git"),
        (scalars.reason_class, " Dispatch:A.b", "dispatch"), (scalars.reason_class, "ambiguous:x", "dispatch"), (scalars.reason_class, "callback", "indirect"), (scalars.reason_class, "dynamicMemberLookup:R.p", "reflect"), (scalars.reason_class, "no-tsconfig", "setup"), (scalars.reason_class, "odd", "unresolved"),
        (scalars.fs_kind, "std::fs::read_to_string", ["read"]), (scalars.fs_kind, "std::fs::copy", ["read", "write"]), (scalars.fs_kind, "std::fs::OpenOptions::open", []), (scalars.fs_kind, "x::write<T>", ["write"]),
        (names.module_of, "a::b::c", "a"), (names.module_of, "src.db.save", "src.db"), (names.module_of, "<T as Trait>::m", "T"), (names.module_of, "main", "(root)"),
        (names.simple_method, "a.b::c", "c"), (names.simple_method, "a::b.c", "c"), (names.simple_method, "x", "x"), (names.declaring_type, "a::b.c", "a::b"), (names.declaring_type, "x", "x"),
        (names.tokens, "getHTTPUrl_v2::Do", ["get", "httpurl", "v2", "do"]), (names.is_test, "foo::tests::x", True), (names.is_test, "Foo::test_connection", False), (names.is_test, "LoginTests::x", True),
        (scalars.is_positional, "f::{closure#2}", True), (scalars.rule_key, " deny\t Net  x ", "deny Net x"),
    ],
)
def test_scalar(spark, f, value, expected):
    assert one(spark, value, f) == expected


@pytest.mark.parametrize(
    "name,scope,loose,exact",
    [("app::domain::h", "domain", True, True), ("domain_logic", "domain", True, False), ("subdomain", "domain", False, False), ("a.b.c", "a::b", True, True), ("a::x::b", "a::b", False, False), ("application_name", "app::", False, False), ("x", "", False, False), ("a::bc", "a::b", True, False)],
)
def test_scopes(spark, name, scope, loose, exact):
    assert one(spark, name, lambda c: names.scope_matches(c, scope)) is loose
    assert one(spark, name, lambda c: names.scope_matches(c, scope, permitted=True)) is exact


def test_cover(spark):
    def path(a, r):
        return one(spark, r, lambda c: scalars.fs_path_covered(F.lit(a), c))

    assert path("/etc/app", "/etc/app/x") and path("/etc/app/", "/etc//./app") and not path("/etc/app", "/etc/apppwned")
    assert not path("/etc", "/etc/../x") and not path("etc", "/etc/x")
    assert one(spark, "Ledger.Entries", lambda c: scalars.db_table_covered(F.lit("ledger.*"), c))
    assert not one(spark, "ledger.entries", lambda c: scalars.db_table_covered(F.lit("entries"), c))
    table = F.create_map(F.lit("example.com"), F.lit("known-partner"))
    assert one(spark, "api.example.com:80", lambda c: scalars.net_dest_class(c, table)) == "known-partner"
    assert one(spark, "example.org", lambda c: scalars.net_dest_class(c, table)) == "unknown-host"
    assert one(spark, "0.9", lambda c: scalars.spec_predates(c, 0, 43)) and not one(spark, "1.0", lambda c: scalars.spec_predates(c, 0, 43)) and one(spark, "?", lambda c: scalars.spec_predates(c, 0, 43))


def test_tiers(spark):
    units = spark.createDataFrame([("a::run",), ("b::rerun",), ("run",), ("b.run",)], "fn string")
    assert {r["fn"] for r in verbs.best_matches(units, "run").collect()} == {"run"}
    assert {r["fn"] for r in verbs.best_matches(units.where("fn <> 'run'"), "run").collect()} == {"a::run", "b.run"}
    assert not verbs.best_matches(units, "").collect()


def test_policy():
    p = P.parse("﻿# note\r\ndeny Net Unknown[dispatch, callbacks] app::x\rpure y\nallow Exec in z git\nforbid a -> b\nonly a -> b, c\nbogus x\n", {"callbacks": ["indirect"]})
    assert p.denies[0].unknown_classes == ["dispatch", "indirect"] and p.denies[0].scope == "app::x" and p.denies[1].pure
    assert (p.allows[0].scope, p.allows[0].values) == ("z", ["git"]) and p.onlys[0].targets == ["b", "c"]
    assert [i[1] for i in p.ignored] == ["bogus x"] and not p.fatal
    assert P.canonical(p) == ["deny Net Unknown[dispatch,indirect] app::x", "pure y"]


@given(st.text(alphabet="abcdefgh", min_size=1, max_size=9).filter(lambda t: t not in P.REASON_CLASSES))
@settings(max_examples=30, deadline=None)
def test_a_wrong_class_is_fatal(word):
    p = P.parse(f"deny Unknown[{word}]")
    assert p.fatal and not p.denies


@given(st.lists(st.sampled_from(["deny Net a", "pure b", "nonsense", "forbid a -> b", "deny Nte", "# x", ""]), max_size=6), st.sampled_from(["\n", "\r\n", "\r"]))
@settings(max_examples=40, deadline=None)
def test_every_line_is_honoured_or_disclosed(lines, end):
    p = P.parse(end.join(lines))
    said = len(p.denies) + len(p.forbids) + len(p.ignored) + len(p.fatal)
    assert said == sum(1 for x in lines if x and not x.startswith("#"))


def test_config():
    c = P.config("policy p.txt\nunknown-alias x = dispatch, native\nunknown-alias bad = nope\nnet-partner a.com b.com\ndeps one:two,three")
    assert c["aliases"] == {"x": ["dispatch", "native"]} and len(c["refused"]) == 1 and c["partners"] == ["a.com", "b.com"] and c["deps"] == ["one", "two", "three"]


def write(tmp_path, name, body):
    (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))


def test_reports(spark, tmp_path):
    unit = {"fn": "a::f", "inferred": ["Fs"], "direct": ["Fs"], "calls": ["a::g"], "declared": [], "entryPoint": True}
    write(tmp_path, "r.one.lib.json", {"package": "one", "analyzed": {"count": 2, "digest": "x"}, "functions": [unit, {"fn": "a::g", "inferred": ["Fs"], "unknownWhy": ["native:z"]}, {"fn": "I::*", "interfaceUnion": True}, {"nofn": 1}, 3], "unanalyzed": "corrupt", "future": 1})
    write(tmp_path, "r.two.bin.json", [unit])
    write(tmp_path, "r.one.lib.callgraph.json", {"a::f": ["a::g", "a::pure"]})
    write(tmp_path, "r.one.hierarchy.json", {"@note": ["x"], "T": ["S"]})
    prefix = str(tmp_path / "r")
    assert [(f.package, f.kind) for f in reports.report_files(prefix)] == [("one", "lib"), ("two", "bin")]
    rows = reports.units(spark, prefix)
    assert sorted(r["fn"] for r in rows.collect()) == ["a::f", "a::f", "a::g"]
    assert {r["fn"]: r["declared"] for r in rows.collect()} == {"a::f": [], "a::g": None}
    assert sorted(r["dropped"] for r in reports.dropped(spark, prefix).collect()) == [0, 2]
    e = {r["package"]: r for r in reports.envelopes(spark, prefix).collect()}
    assert (e["one"]["unanalyzed_state"], e["one"]["analyzed_state"], e["one"]["coverage_state"]) == ("corrupt", "present", "absent")
    f = reports.facts(spark, prefix)
    assert {r["fn"] for r in verbs.callers(f, "a::pure").collect()} == {"a::f"}
    assert {(r["fn"], r["effect"]) for r in f.inferred.collect()} == {("a::f", "Fs"), ("a::g", "Fs")}
    assert reports.merged(rows).count() == 2 and reports.last_of_name(rows).count() == 2
    supers, indexed, partial = reports.hierarchy(spark, prefix)
    assert [tuple(r) for r in supers.collect()] == [("T", "S")] and not partial
    with pytest.raises(verbs.Refused):
        reports.units(spark, str(tmp_path / "none"))
    write(tmp_path, "bad.x.y.json", "{")
    with pytest.raises(verbs.Refused):
        reports.units(spark, str(tmp_path / "bad"))
    reports.write_report(rows.where("path like '%one%'"), str(tmp_path / "w.one.lib.json"), "one", "1")
    assert {r["fn"] for r in reports.units(spark, str(tmp_path / "w")).collect()} == {"a::f", "a::g"}
    h = 0xCBF29CE484222325
    for name in sorted(str(q.relative_to(tmp_path)) for q in tmp_path.rglob("*json")):
        for b in name.encode() + b"\0" + (tmp_path / name).read_bytes() + b"\0":
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert reports.tree_hash(spark, str(tmp_path), "json") == f"{h:016x}"


def test_resolution_and_chaining(spark):
    rows = spark.createDataFrame([("p#f", "p", "f", ["g", "h"]), ("p#g", "p", "g", []), ("q#g", "q", "g", ["h"]), ("q#h", "q", "h", []), ("r#x", "r", "x", ["g"])], "key string, package string, fn string, calls array<string>")
    got = {(r["caller"], r["call"]): (r["target"], r["ambiguous"]) for r in reports.resolve_calls(rows).collect()}
    assert got == {("p#f", "g"): ("p#g", False), ("p#f", "h"): ("q#h", False), ("q#g", "h"): ("q#h", False), ("r#x", "g"): (None, True)}
    deps = spark.createDataFrame([("g", ["Net"], "1"), ("h", ["Fs"], "0")], "fn string, effects array<string>, version string")
    assert {(r["fn"], r["effect"]) for r in reports.chained(rows, deps, "1").collect()} == {("f", "Net"), ("f", "Unknown"), ("g", "Unknown"), ("x", "Net")}


def test_verdicts(spark):
    c = completeness.Completeness
    assert completeness.verdict(0, 0, c()) == (0, "clear") and completeness.verdict(1, 1, c(unreadable=1)) == (1, "violations")
    assert completeness.verdict(0, 1, c()) == (2, "refused") and completeness.verdict(0, 0, c(unpeeked=["x"])) == (2, "unpeeked")
    none, open_ = spark.createDataFrame([], gate.SCHEMA), spark.createDataFrame([], "raw string, fn string, effect string")
    assert json.loads(completeness.verdict_document(none, open_, c(), 3))["ok"] is True
    assert "ok" not in json.loads(completeness.verdict_document(none, open_, c(judged_nothing=["x"]), 0))
    assert completeness.refusals(P.parse("forbid a -> b"), True, c(switches=["X"])) == ["the scan ran with X", "forbid and only need a call graph with pure callees"]


def test_incremental_is_the_same_as_full(spark):
    def compute(rows):
        return rows.select("key", "content_hash", F.upper("text").alias("text"))

    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("gone", 3, "z")], "key string, content_hash int, text string")
    now = spark.createDataFrame([("a", 1, "x"), ("b", 5, "w"), ("c", 6, "v")], "key string, content_hash int, text string")
    assert sorted(map(tuple, watch.refreshed(now, compute(old), compute).collect())) == sorted(map(tuple, compute(now).collect()))


def test_watch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.json", "{}")
    seen = []
    q = watch.watch(spark, str(folder), lambda s: seen.append(1), checkpoint=str(tmp_path / "cp"), every="1 second")
    q.processAllAvailable()
    q.stop()
    assert seen == [1]
