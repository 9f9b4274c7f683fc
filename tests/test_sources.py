"""Reports of other packages, baselines, side files, folders, pins and the documents of refusals."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weirflow.operators import completeness, gate, verbs
from weirflow.plans import policy as P
from weirflow.sources import files, reports


def write(folder, name, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body))
    return str(path)


def report(version, units):
    return {"weirflow": {"version": version} if version else {}, "package": "x", "functions": units}


def test_walk_leaves_build_outputs_out(spark, tmp_path):
    for name in ("Cargo.toml", "target/out.rs", "src/target/mod.rs", "src/a.rs", "cache/CACHEDIR.TAG", "cache/b.rs", "own/c.rs"):
        write(tmp_path, name, "x")
    seen = {os.path.relpath(e.path.removeprefix("file:"), tmp_path) for e in files.walk(spark, str(tmp_path), [str(tmp_path / "own")])}
    assert seen == {"Cargo.toml", "src/target/mod.rs", "src/a.rs"}
    assert files.children(spark, str(tmp_path / "none")) == []


def test_newest_file(spark, tmp_path):
    paths = [write(tmp_path, f"{d}/{n}.json", "x") for d, n in (("one", "a"), ("one", "b"), ("two", "a"))]
    for path, at in zip(paths, (5, 9, 9), strict=True):
        os.utime(path, (at, at))
    folders = [str(tmp_path / d) for d in ("one", "two", "none")]
    assert files.newest(spark, folders, lambda n: n.endswith(".json")).endswith("two/a.json")  # of one time the greatest path
    assert files.newest(spark, folders, lambda n: n == "z") is None


@pytest.mark.parametrize(
    "text, state",
    [
        ("", "absent"), ("engine 1.2", "match"), ("engine v1.2.0 # why", "match"), ("engine 1.3", "mismatch"), ("engine latest", "malformed"), ("engine", "malformed"), ("engine 1.2 now", "malformed"),
        ("engine java", "absent"), ("engine rust 1.2\nengine 9.9", "match"), ("engine rust", "malformed"), ("engine 1.2\nengine 1.3", "malformed"), ("engine rust 1.2\nengine latest", "malformed"), ("ENGINE 1.2", "match"),
    ],
)
def test_pins(text, state):
    assert P.pin_state(text, "rust", "1.2.0") == state
    assert P.pin_state("engine 1.2", "rust", "unknown") == "undetermined"


def test_baseline(spark, tmp_path):
    unit = {"fn": "a::f", "inferred": ["Fs"]}
    prefix = str(tmp_path / "base")
    assert reports.baseline(spark, prefix, "a", "1") is None
    for value, declared in ((" ", False), (prefix, True)):
        with pytest.raises(verbs.Refused):
            reports.baseline(spark, value, "a", "1", declared)
    own = write(tmp_path, "base.a.scan.json", report("1", [unit, unit]))
    assert [tuple(r) for r in reports.baseline(spark, prefix, "a", "1").collect()] == [("a::f", "Fs")]
    assert reports.baseline(spark, own, "z", "1").count() == 1
    assert reports.baseline(spark, prefix, "b", "1").count() == 0  # present, without this package
    for body in (report("0", [unit]), report(None, [unit]), [unit], report("1", [unit, {"nofn": 1}]), "{"):
        write(tmp_path, "bad.a.scan.json", body)
        with pytest.raises(verbs.Refused):
            reports.baseline(spark, str(tmp_path / "bad"), "a", "1")


def test_siblings(spark, tmp_path):
    def unit(h, **more):
        return {"fn": "x", "hash": h, "inferred": ["Net", "Made-up"], "hosts": ["h.org"], **more}

    for name, body in (("me.lib", report("2", [unit("me")])), ("new.lib", report("2", [unit("new"), {"fn": "bare", "inferred": ["Fs"]}])), ("old.lib", report("1", [unit("old")])), ("none.lib", report(None, [unit("none")])), ("list.lib", [unit("list")]), ("bad.lib", "{")):
        write(tmp_path, f"s.{name}.json", body)
    effects, literals = reports.siblings(spark, str(tmp_path / "s"), "me", "lib", "2")
    assert {tuple(r) for r in effects.collect()} == {("new", "Net"), ("old", "Unknown"), ("none", "Unknown"), ("list", "Net")}
    assert {tuple(r) for r in literals.collect()} == {("new", "hosts", "h.org"), ("list", "hosts", "h.org")}
    assert ("old", "Net") in {tuple(r) for r in reports.siblings(spark, str(tmp_path / "s"), "me", "lib", "2", trusted=True)[0].collect()}


def test_side_files(spark, tmp_path):
    prefix = str(tmp_path / "r")
    write(tmp_path, "r.calibrated.json", {"crates": ["b", "a"], "prefixes": ["p_"], "other": 1})
    write(tmp_path, "r.encountered-x", ["serde", "tokio"])
    write(tmp_path, "r.encountered-y", ["tokio"])
    write(tmp_path, "r.a.hierarchy.json", {"@note": "text", "T": ["S"], "Odd": 5})
    assert reports.calibrated(spark, prefix) == {"crates": ["a", "b"], "prefixes": ["p_"], "path_crates": []}
    assert {r["name"] for r in reports.encountered(spark, prefix).collect()} == {"serde", "tokio"}
    supers, indexed, partial = reports.hierarchy(spark, prefix)
    assert [tuple(r) for r in supers.collect()] == [("T", "S")] and indexed.count() == 1 and not partial
    assert reports.unusable_types(spark, prefix) == 1
    rows = spark.createDataFrame([('h"1', "z"), ('h"1', "a"), ("h2", "z"), ("h2", "z")], "hash string, scope string")
    reports.write_map(rows, "hash", "scope", f"{prefix}.a.layerreach.json")
    assert json.loads((tmp_path / "r.a.layerreach.json").read_text()) == {'h"1': ["a", "z"], "h2": ["z"]}
    assert {tuple(r) for r in reports.layer_reach(spark, prefix).collect()} == {tuple(r) for r in rows.collect()}
    assert reports.layer_reach(spark, str(tmp_path / "none")).count() == 0
    reports.write_map(rows.limit(0), "hash", "scope", f"{prefix}.b.layerreach.json")
    assert json.loads((tmp_path / "r.b.layerreach.json").read_text()) == {}


def test_paths_follow_the_order_of_calls(spark, tmp_path):
    units = [{"fn": n, "inferred": ["Fs"], "calls": calls, "direct": direct} for n, calls, direct in (("a", ["z", "b"], []), ("b", ["s"], []), ("z", ["s"], []), ("s", [], ["Fs"]))]
    write(tmp_path, "r.x.lib.json", report("1", units))
    f = reports.facts(spark, str(tmp_path / "r"))
    assert [r["fn"] for r in verbs.path(f, "a", "Fs").orderBy("step").collect()] == ["a", "z", "s"]
    f.order = None
    assert [r["fn"] for r in verbs.path(f, "a", "Fs").orderBy("step").collect()] == ["a", "b", "s"]


def test_parts_and_refusals(spark, tmp_path):
    assert completeness.parts(spark, str(tmp_path / "none")).count() == 0
    good = write(tmp_path, "good.json", '{"rule": "R", "raw": "deny Net", "fn": "f", "effects": "Net", "detail": ""}\n\n')
    assert [r["fn"] for r in completeness.parts(spark, good).collect()] == ["f"]
    for line in ("{", "5", '{"fn": "f"}'):
        with pytest.raises(verbs.Refused):
            completeness.parts(spark, write(tmp_path, "bad.json", '{"rule": "R", "fn": "f"}\n' + line))
    plain = json.loads(completeness.refusal_document("why", [{"rule": "x"}]))
    assert plain == {"spec": "1", "ok": False, "refused": True, "reason": "why", "unevaluated": [{"rule": "x"}]}
    assert json.loads(completeness.refusal_document("why", [{"rule": "x"}], ["B", "A", "B"])) == {"spec": "1", "ok": False, "refused": True, "reason": "why", "switches": ["A", "B"]}


def test_verdict_discloses(spark):
    none, open_ = spark.createDataFrame([], gate.SCHEMA), spark.createDataFrame([], "raw string, fn string, effect string")
    taken = spark.createDataFrame([("deny Net", "f")], "raw string, fn string")
    doc = json.loads(completeness.verdict_document(none, open_, completeness.Completeness(), 3, accepted=taken, netPartners=["p"], coverage=None))
    assert (doc["violations"], doc["accepted"], doc["netPartners"], doc["ok"]) == ([], [{"raw": "deny Net", "fn": "f"}], ["p"], True) and "coverage" not in doc
    doc = json.loads(completeness.verdict_document(none, open_, completeness.Completeness(unpeeked=["tests"]), 3, accepted=taken))
    assert not {"violations", "accepted", "ok"} & set(doc)
    names = spark.createDataFrame([("a::f",)], "fn string")
    assert completeness.vocabulary(names, ["a", "zz"]) == {"bound": ["a"], "unbound": ["zz"]} and completeness.vocabulary(names, []) == {"bound": [], "unbound": []}


def test_partners_and_incomplete_surfaces(spark):
    from weirflow.facts import Facts

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    f = Facts(frame([("a", False), ("b", False)], "fn string, entry_point boolean"), frame([("a", "b")], "src string, dst string"), frame([("b", "Net")], "fn string, effect string"), frame([], "fn string, why string"), frame([("b", "hosts", "p.org")], "fn string, kind string, value string"), frame([("b", "Net")], "fn string, effect string"))
    assert {tuple(r) for r in verbs.net_classes(f, verbs.partner_table(["p.org"])).collect()} == {("a", "known-partner"), ("b", "known-partner"), ("a", "unknown-host"), ("b", "unknown-host")}
    assert {tuple(r) for r in gate.allowed(f, P.parse("allow Net p.org")).select("fn", F.col("detail")).collect()} == {("a", "no visible literal"), ("b", "no visible literal")}


def test_fresh_reports_are_read_and_stale_ones_scanned_again(spark, tmp_path):
    root, prefix = tmp_path / "src", str(tmp_path / "r")
    write(root, "a.rs", "x")
    rows = spark.createDataFrame([("a::f", "a.rs:1", ["Fs"], ["Fs"])], "fn string, loc string, inferred array<string>, direct array<string>")
    assert reports.state(spark, prefix, str(root)) == "absent"
    reports.write_report(rows, f"{prefix}.a.lib.json", "a", "1")
    assert reports.state(spark, prefix, str(root)) == "undated"
    reports.write_report(rows, f"{prefix}.a.lib.json", "a", "1", reports.tree_hash(spark, str(root)))
    assert reports.state(spark, prefix, str(root)) == "fresh"
    f = reports.snapshot(spark, prefix, str(root), lambda: pytest.fail("scanned"))
    assert [tuple(r) for r in verbs.located(f, f.inferred).collect()] == [("a::f", "Fs", "a.rs:1")]
    write(root, "a.rs", "y")
    assert reports.state(spark, prefix, str(root)) == "stale"
    assert reports.snapshot(spark, prefix, str(root), lambda: "scan") == "scan"
    write(tmp_path, "r.refused.json", "{}")
    assert reports.state(spark, prefix, str(root)) == "refused"


def test_policy_document():
    got = json.loads(P.document(P.parse("only a -> b\ndeny Net Unknown[dispatch] x\nmake tea\nallow Tea x")))
    assert [(r["kind"], r["raw"]) for r in got["rules"]] == [("only", "only a -> b"), ("deny", "deny Net Unknown[dispatch] x")]
    assert got["rules"][1]["unknown_classes"] == ["dispatch"] and len(got["ignored"]) == 1 and len(got["refused"]) == 1


def test_entries_of_rules_without_evidence_are_unjudged(spark):
    from weirflow.facts import Facts

    units = spark.createDataFrame([("a::f", False)], "fn string, entry_point boolean")
    f = Facts(units, spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "fn string, effect string"), spark.createDataFrame([], "fn string, why string"), spark.createDataFrame([], "fn string, kind string, value string"), given=spark.createDataFrame([("a::f", "Unknown")], "fn string, effect string"))
    p = P.parse("deny Unknown[dispatch] a\naccept a::f Unknown[dispatch] for deny Unknown[dispatch] a because x\naccept a::g Unknown[dispatch] for deny Unknown[dispatch] a because x")
    stands, entries = gate.settle(gate.denied(f, p), p, f)
    assert stands.count() == 0 and {(r["fn"], r["status"]) for r in entries.collect()} == {("a::f", "unjudged"), ("a::g", "stale")}
