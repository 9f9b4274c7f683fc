"""What a user adds to the facts and what the facts don't cover: rules of their own, dispatch, uncovered packages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..vocabulary import EFFECTS, UNKNOWN


@dataclass(frozen=True)
class ClassRule:
    """Calls into a package, or to a path, that begins with ``prefix`` perform ``effect``."""

    effect: str
    package: bool
    prefix: str


def parse_rules(text: str) -> list[ClassRule]:
    """A rule a line: effect, crate or path, prefix.  Blank lines, comments (#), short lines and unknown effects are left out."""
    out = []
    for line in text.splitlines():
        words = line.split()
        if len(words) >= 3 and not words[0].startswith("#") and words[0] in EFFECTS:
            out.append(ClassRule(words[0], words[1] == "crate", words[2]))
    return out


def classify(calls: DataFrame, rules: list[ClassRule]) -> DataFrame:
    """(fn, effect) of calls (fn, package, path) by the user's rules; a package is the whole name, a path a prefix.

    Null names fit no rule; calls that several rules fit have each one's effect; repeated calls count once.
    """
    fits = [F.when(F.col("package") == r.prefix if r.package else F.col("path").startswith(r.prefix), F.lit(r.effect)) for r in rules]
    effects = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    return calls.select("fn", F.explode(effects).alias("effect")).distinct()


def dispatch_targets(calls: DataFrame, impls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst), (fn, why)) of calls (fn, trait, method) through a trait, by impls (trait, method, target).

    A call leads to every known implementation; one whose trait has none here stays Unknown, with the dispatch as reason.
    """
    known = calls.join(impls, ["trait", "method"]).select(F.col("fn").alias("src"), F.col("target").alias("dst")).distinct()
    blind = calls.join(impls.select("trait").distinct(), "trait", "left_anti")
    return known, blind.select("fn", F.concat(F.lit("dispatch:"), "trait", F.lit("."), "method").alias("why")).distinct()


def with_late_unknown(f: Facts, units: DataFrame) -> DataFrame:
    """(fn, effect): inferred effects, and Unknown for ``units`` (fn) themselves; their callers do not inherit it."""
    return f.inferred.select("fn", "effect").union(units.select("fn", F.lit(UNKNOWN))).distinct()


def uncovered(encountered: DataFrame, analyzed: DataFrame, names: list[str], prefixes: list[str] = [], paths: list[str] = []) -> DataFrame:  # noqa: B006
    """(name): encountered packages (name) that no classifier covers and no report describes (analyzed, name).

    A package is covered by its name, by a covered name and an underscore before more, by a prefix, or as a path's package.
    """
    name = F.col("name")
    covers = [name.isin([*names, *paths]) if names or paths else F.lit(False), *(name.startswith(f"{n}_") for n in names), *(name.startswith(p) for p in prefixes)]
    covered = covers[0]
    for c in covers[1:]:
        covered = covered | c
    return encountered.select("name").where("name is not null").distinct().where(~covered).join(analyzed.select("name"), "name", "left_anti")


def unknown_caveat(f: Facts) -> DataFrame:
    """One row: unknown, total (units with effects), caveat: whether a third of them or more are Unknown."""
    per = f.inferred.groupBy("fn").agg(F.max(F.col("effect") == UNKNOWN).alias("u"))
    counts = per.agg(F.count_if("u").alias("unknown"), F.count("*").alias("total"))
    return counts.select("unknown", "total", ((F.col("total") > 0) & (F.col("unknown") * 3 >= F.col("total"))).alias("caveat"))


def in_scope(setting: str | None, name: Column) -> Column:
    """Whether an enforcement setting covers a name: unset none, "1" or empty all, else those that begin with it."""
    if setting is None:
        return F.lit(False)
    return F.lit(True) if setting in ("", "1") else name.startswith(setting)
