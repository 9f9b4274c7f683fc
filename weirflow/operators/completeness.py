"""What an answer could not see, and the verdict that follows: clean, violation, or not evaluated."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import policy as P
from ..sources import files
from .verbs import Refused


@dataclass
class Completeness:
    """Causes for which an answer over a set of reports is partial."""

    unanalyzed: list[tuple[str, str]] = field(default_factory=list)
    unreadable: int = 0
    judged_nothing: list[str] = field(default_factory=list)
    no_manifest: list[str] = field(default_factory=list)
    out_of_scope: list[str] = field(default_factory=list)
    unpeeked: list[str] = field(default_factory=list)
    unasked: list[str] = field(default_factory=list)
    switches: list[str] = field(default_factory=list)
    refused: bool = False

    def incomplete(self) -> bool:
        return bool(self.unanalyzed or self.unreadable or self.out_of_scope or self.unpeeked or self.unasked or self.refused)

    def must_hedge(self) -> bool:
        return self.incomplete() or bool(self.judged_nothing or self.no_manifest)


def of_reports(envelopes: DataFrame, dropped: int = 0, policy: P.Policy | None = None, refused: bool = False) -> Completeness:
    """From the envelopes (one row a report); a corrupt key counts against the answer as its worst reading would."""
    out = Completeness(refused=refused, unreadable=dropped)
    asked = P.canonical(policy) if policy else []
    keys = ("unanalyzed", "outOfScope", "excluded", "scannedUnder", "switches", "analyzed")
    for r in envelopes.select("path", *keys, *(f"{k}_state" for k in keys)).toLocalIterator():
        state = {k: r[f"{k}_state"] for k in keys}
        out.unanalyzed += [(u["path"], u["reason"]) for u in r["unanalyzed"] or []]
        out.out_of_scope += [o["fn"] for o in r["outOfScope"] or []]
        out.unpeeked += [e["class"] for e in r["excluded"] or [] if not e["peeked"] and not e["judgedElsewhere"] and e["count"]]
        out.unreadable += sum(s == "corrupt" for s in state.values())
        out.switches += r["switches"] or []
        if state["analyzed"] != "present":
            out.no_manifest.append(r["path"])
        elif (r["analyzed"]["count"] or 0) <= 0:
            out.judged_nothing.append(r["path"])
        if any(e["peeked"] for e in r["excluded"] or []):
            under = r["scannedUnder"]["deny"] if r["scannedUnder"] else []
            out.unasked += [a for a in asked if a not in (under or [])]
    out.unasked = sorted(set(out.unasked))
    return out


def verdict(violations: int, refusals: int, c: Completeness) -> tuple[int, str]:
    """(exit status, reason): a violation outweighs what could not be seen; what could not be seen outweighs a pass."""
    if not violations and refusals:
        return 2, "refused"
    if violations:
        return 1, "violations"
    for found, why in ((c.unanalyzed or c.unreadable, "unanalyzed"), (c.out_of_scope, "out of scope"), (c.unpeeked, "unpeeked"), (c.unasked, "unasked")):
        if found:
            return 2, why
    return 0, "clear"


SPEC = "1"


def verdict_document(violations: DataFrame, withheld: DataFrame, c: Completeness, analyzed: int, zero: DataFrame | None = None, ignored: list | None = None, accepted: DataFrame | None = None, **disclosed: object) -> str:
    """The verdict as JSON, violations in order of rule, detail and unit.  ok is left out where the answer must hedge.

    ``accepted`` are the rows that accept lines took out; with it an incomplete verdict without violations has neither list.
    ``disclosed`` are keys that are told and not judged: coverage, policyVocabulary, netPartners, switchedDependencies.
    """
    rows = [r.asDict() for r in violations.orderBy("rule", "detail", "fn", "raw").toLocalIterator()]
    open_ = [r.asDict() for r in withheld.orderBy("raw", "fn").toLocalIterator()]
    status, why = verdict(len(rows), len(open_), c)
    out: dict = {"spec": SPEC, "analyzed": {"count": analyzed}, "verdict": why, "status": status}
    if not c.must_hedge() and not open_:
        out["ok"] = not rows
    elif rows:
        out["ok"] = False
    if accepted is not None and (rows or not c.incomplete()):
        out["violations"] = rows
        out["accepted"] = [r.asDict() for r in accepted.orderBy("raw", "fn").toLocalIterator()]
    for key, value in (("violations", rows), ("unevaluated", open_), ("unanalyzed", c.unanalyzed), ("outOfScope", sorted(c.out_of_scope)), ("zeroMatch", [r["raw"] for r in zero.collect()] if zero is not None else []), ("ignored", ignored or []), *sorted(disclosed.items())):
        if value:
            out[key] = value
    if c.must_hedge():
        out["incomplete"] = True
    return json.dumps(out, indent=2, ensure_ascii=False, default=str)


def refusal_document(reason: str, unevaluated: list | None = None, switches: list[str] | None = None) -> str:
    """What stands in a verdict's place where nothing was judged: no violations key, so nobody reads it as a pass.

    With ``switches`` (sorted, each once) nothing that the altered run found is carried.
    """
    out: dict = {"spec": SPEC, "ok": False, "refused": True, "reason": reason}
    if switches:
        out["switches"] = sorted(set(switches))
    elif unevaluated:
        out["unevaluated"] = unevaluated
    return json.dumps(out, indent=2, ensure_ascii=False)


def vocabulary(names: DataFrame, scopes: list[str]) -> dict:
    """policyVocabulary of a verdict: which scopes bind a name, and which bind none."""
    from ..functions import names as N

    if not scopes:
        return {"bound": [], "unbound": []}
    counts = names.agg(*[F.count_if(N.scope_matches(F.col("fn"), s)).alias(f"n{i}") for i, s in enumerate(scopes)]).first()
    return {"bound": sorted({s for s, n in zip(scopes, counts, strict=True) if n}), "unbound": sorted({s for s, n in zip(scopes, counts, strict=True) if not n})}


def refusals(p: P.Policy, from_report: bool, c: Completeness) -> list[str]:
    """Why a whole policy can't be judged: unusable or no rules, results moved by switches, rules that need the full graph."""
    out = [f"line {i}: {why}" for i, _, why in p.fatal]
    if p.empty:
        out.append("no rules")
    if c.switches:
        out.append("the scan ran with " + ", ".join(sorted(set(c.switches))))
    if c.refused:
        out.append("the last scan refused")
    if from_report and (p.forbids or p.onlys):
        out.append("forbid and only need a call graph with pure callees")
    if from_report and p.allows:
        out.append("allow needs the literals of pure callees")
    return out


def assemble(parts: DataFrame) -> DataFrame:
    """(rule, count) of rules whose zero-match counts add up to zero over parts (rule, count)."""
    return parts.groupBy("rule").agg(F.sum("count").alias("count")).where("count = 0")


PART = "rule string, raw string, fn string, effects string, detail string, _corrupt_record string"


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The violations of a file or folder of JSON lines, one a run of the gate; none where there is no such file.

    A line that is no violation makes the whole refused (2): a verdict over the rest would pass in silence.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], PART).drop("_corrupt_record")
    texts = spark.read.text(path).where("trim(value) <> ''")  # the line stays beside what is read from it
    rows = texts.select(F.from_json("value", PART, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = rows.where("r is null or r._corrupt_record is not null or r.rule is null").count()
    if bad:
        raise Refused(f"{bad} lines of {path} can't be read")
    return rows.select("r.*").drop("_corrupt_record")
