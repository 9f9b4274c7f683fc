"""Reports at rest: one JSON document a package and kind, with call graphs, hierarchies and other files beside it.

A report holds an envelope and an array of units.  Units that can't be read are dropped and counted, never guessed; a key
that is absent, present or corrupt is told apart, since absence is not emptiness.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..facts import Facts
from ..operators.verbs import Refused
from ..vocabulary import ALL_EFFECTS, UNKNOWN
from . import files

# fixed values: kinds of files that lie beside reports
SIDECARS = ["callgraph", "hierarchy", "calibrated", "layerreach", "locs", "gate", "refused"]

_SETS = ["inferred", "direct", "fs", "hosts", "cmds", "paths", "tables", "calls", "unknownWhy", "invisible", "incomplete", "netClass", "dispatchesOn"]
_MAYBE = ["declared", "undeclared", "overdeclared"]
_FLAGS = ["unresolved", "entryPoint", "interfaceUnion", "declaration"]
UNIT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("fn", "loc", "hash")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in (*_SETS, *_MAYBE)]
    + [T.StructField(n, T.BooleanType()) for n in _FLAGS]
    + [T.StructField("_corrupt_record", T.StringType())]
)
#: Keys of the envelope that are read with their state, and the type of each.
KEYS = {
    "switches": "array<string>",
    "unanalyzed": "array<struct<path:string,reason:string>>",
    "outOfScope": "array<struct<fn:string,path:string,effects:array<string>,class:string,reason:string>>",
    "scannedUnder": "struct<deny:array<string>>",
    "excluded": "array<struct<class:string,count:bigint,peeked:boolean,judgedElsewhere:boolean,reason:string>>",
    "netPartners": "struct<config:string,hosts:array<string>>",
    "coverage": "struct<uncovered:array<struct<name:string,calls:bigint>>>",
    "analyzed": "struct<count:bigint,digest:string>",
}


@dataclass(frozen=True)
class ReportFile:
    path: str
    package: str
    kind: str


def report_files(prefix: str) -> list[ReportFile]:
    """<base>.<package>.<kind>.json beside a prefix, sorted; a prefix that is a .json file is that report alone."""
    spark = SparkSession.active()
    folder, base = os.path.split(prefix)
    if prefix.endswith(".json") and files.exists(spark, prefix):
        parts = base.removesuffix(".json").split(".")
        return [ReportFile(prefix, parts[-2] if len(parts) > 1 else parts[0], parts[-1] if len(parts) > 1 else "")]
    out = []
    for entry in files.children(spark, folder) if base else []:
        m = re.fullmatch(re.escape(base) + r"\.([^.]+)\.([^.]+)\.json", entry.name)
        if m and m[2] not in SIDECARS:
            out.append(ReportFile(entry.path, m[1], m[2]))
    return out


def sidecar_files(prefix: str, kind: str) -> list[str]:
    """<base>.<...>.<kind>.json beside a prefix; beside a report given as a file, those of its own stem."""
    folder, base = os.path.split(prefix.removesuffix(".json"))
    return [e.path for e in files.children(SparkSession.active(), folder) if e.name.startswith(base + ".") and e.name.endswith(f".{kind}.json")]


def locate(start: str, env: str | None = None) -> str | None:
    """The prefix of the reports for a folder: an override, or .weirflow/report in it or a folder above."""
    if env:
        return env
    here = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(here, ".weirflow")):
            return os.path.join(here, ".weirflow", "report")
        above = os.path.dirname(here)
        if above == here:
            return None
        here = above


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "value string, path string")
    return spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def documents(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, value, elements, readable): each report's text and the texts of its units; a bare array is a report too."""
    return _elements(_texts(spark, [f.path for f in report_files(prefix)]))


def _elements(texts: DataFrame) -> DataFrame:
    bare = F.trim("value").startswith("[")
    inner = F.when(bare, F.col("value")).otherwise(F.get_json_object("value", "$.functions"))
    elements = F.from_json(inner, "array<string>")
    readable = elements.isNotNull() & (bare | F.get_json_object("value", "$").isNotNull())
    return texts.select("path", "value", elements.alias("elements"), F.coalesce(readable, F.lit(False)).alias("readable"))


def units(spark: SparkSession, prefix: str) -> DataFrame:
    """The units of all reports, rows that stand for a whole interface left out; set fields default to empty, others to null.

    Refused (2) where there is no report, or where one could not be read and nothing else was.
    """
    docs = documents(spark, prefix)
    state = docs.agg(F.count("*").alias("n"), F.count_if(~F.col("readable")).alias("bad"), F.sum(F.coalesce(F.size("elements"), F.lit(0))).alias("rows")).first()
    if not state["n"]:
        raise Refused(f"no report at {prefix}")
    if state["bad"] and not state["rows"]:
        raise Refused(f"{state['bad']} reports at {prefix} can't be read")
    rows = parsed(docs).where("ok").select("path", "pos", "u.*").drop("_corrupt_record")
    filled = {c: F.coalesce(c, F.array().cast("array<string>")) for c in _SETS} | {c: F.coalesce(c, F.lit(False)) for c in _FLAGS} | {c: F.coalesce(c, F.lit("")) for c in ("loc", "hash")}
    return rows.withColumns(filled).where(~F.col("interfaceUnion"))


def parsed(docs: DataFrame) -> DataFrame:
    """(path, pos, u, ok): every element, and whether it is a unit with a name."""
    rows = docs.select("path", F.posexplode("elements").alias("pos", "text"))
    u = F.from_json("text", UNIT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.withColumn("u", u).withColumn("ok", F.col("u.fn").isNotNull() & F.col("u._corrupt_record").isNull())


def dropped(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, dropped): how many elements of each report are no units."""
    return parsed(documents(spark, prefix)).groupBy("path").agg(F.count_if(~F.col("ok")).alias("dropped"))


def key_state(text: Column, key: str) -> tuple[Column, Column]:
    """(state, value) of an envelope's key: absent, present or corrupt; a value is given only where it is present."""
    raw = F.get_json_object(text, f"$.{key}")
    value = F.from_json(raw, KEYS[key], {"mode": "PERMISSIVE"})
    fits = raw.startswith("[") if KEYS[key].startswith("array") else raw.startswith("{")
    state = F.when(raw.isNull(), "absent").when(fits & value.isNotNull(), "present").otherwise("corrupt")
    return state, F.when(state == "present", value)


def envelopes(spark: SparkSession, prefix: str) -> DataFrame:
    """One row a report: path, package, version, spec, and for each key <key>_state and <key>."""
    texts = _texts(spark, [f.path for f in report_files(prefix)])
    cols = [F.get_json_object("value", f"$.{p}").alias(n) for p, n in (("package", "package"), ("weirflow.version", "version"), ("weirflow.spec", "spec"))]
    for k in KEYS:
        state, value = key_state(F.col("value"), k)
        cols += [state.alias(f"{k}_state"), value.alias(k)]
    return texts.select("path", *cols)


def merged(rows: DataFrame) -> DataFrame:
    """One row a name, the sets of repeated names united (differences and gains; questions about one unit keep repeats)."""
    def union(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)

    return rows.groupBy("fn").agg(*[union(c) for c in ("inferred", "direct", "calls")])


def last_of_name(rows: DataFrame) -> DataFrame:
    """One row a name, the last by file and place."""
    from pyspark.sql import Window

    w = Window.partitionBy("fn").orderBy(F.desc("path"), F.desc("pos"))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def _maps(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, bool]:
    """((k, v array, or null where a value is no list of names), whether a file could not be read) of JSON objects."""
    texts = _texts(spark, paths).withColumn("m", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}))
    partial = bool(texts.where("m is null").limit(1).collect())
    return texts.where("m is not null").select(F.explode("m").alias("k", "raw")).select("k", F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).alias("v")), partial


def call_graph(spark: SparkSession, prefix: str) -> tuple[DataFrame, bool]:
    """((src, dst, ord), whether a file could not be read): the call graphs beside the reports, pure callees included."""
    rows, partial = _maps(spark, sidecar_files(prefix, "callgraph"))
    return rows.select(F.col("k").alias("src"), F.posexplode("v").alias("ord", "dst")).groupBy("src", "dst").agg(F.min("ord").alias("ord")), partial


def hierarchy(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, bool]:
    """((type, super), (type) of all that are indexed, whether a file could not be read); keys that begin with @ are notes."""
    rows, partial = _maps(spark, sidecar_files(prefix, "hierarchy"))
    rows = rows.where(~F.col("k").startswith("@") & F.col("v").isNotNull())
    return rows.select(F.col("k").alias("type"), F.explode("v").alias("super")), rows.select(F.col("k").alias("type")).distinct(), partial


def unusable_types(spark: SparkSession, prefix: str) -> int:
    """How many entries of the hierarchies are no lists; such types are not indexed."""
    rows, _ = _maps(spark, sidecar_files(prefix, "hierarchy"))
    return rows.where(~F.col("k").startswith("@") & F.col("v").isNull()).count()


def calibrated(spark: SparkSession, prefix: str) -> dict[str, list[str]]:
    """crates, prefixes and path_crates of the one file that lists what classifiers cover; empty lists where it is absent."""
    rows, _ = _maps(spark, [path for path in [f"{prefix}.calibrated.json"] if files.exists(spark, path)])
    found = {r["k"]: r["v"] or [] for r in rows.collect()}
    return {k: sorted(set(found.get(k, []))) for k in ("crates", "prefixes", "path_crates")}


def encountered(spark: SparkSession, prefix: str) -> DataFrame:
    """(name): packages that calls led to, from the lists (one JSON array a file) beside the reports."""
    folder, base = os.path.split(prefix)
    paths = [e.path for e in files.children(spark, folder) if e.name.startswith(f"{base}.encountered-")]
    return _texts(spark, paths).select(F.explode(F.from_json("value", "array<string>")).alias("name")).distinct()


def layer_reach(spark: SparkSession, prefix: str) -> DataFrame:
    """(hash, scope): which scopes of forbid rules the units of packages scanned before reach."""
    rows, _ = _maps(spark, sidecar_files(prefix, "layerreach"))
    return rows.select(F.col("k").alias("hash"), F.explode("v").alias("scope")).distinct()


def write_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object, each key with the sorted list of its values: call graphs, hierarchies, reached scopes."""
    lists = rows.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set(value)).alias("v")).orderBy("k")
    texts = lists.select(F.concat(F.expr("to_json(named_struct('k', k))").substr(F.lit(6), F.length(F.expr("to_json(named_struct('k', k))")) - 6), F.lit(": "), F.to_json("v")).alias("j"))
    files.write_whole(rows.sparkSession, path, _json_lines("{", (r["j"] for r in texts.toLocalIterator()), "}\n"))


def _json_lines(head, items, tail):
    yield head
    for i, item in enumerate(items):
        yield (",\n" if i else "\n") + item
    yield "\n" + tail


def siblings(spark: SparkSession, prefix: str, package: str, kind: str, version: str, trusted: bool = False) -> tuple[DataFrame, DataFrame]:
    """((hash, effect), (hash, kind, value)): what the other packages' reports say of their units, for joins on the hash.

    A report that another version wrote, or whose envelope names none, says only Unknown and none of its literals count,
    unless ``trusted``; a bare array is older than versions and stands.  Effects that the vocabulary lacks are left out,
    units without a hash too; so are reports that can't be read (``documents`` tells which).
    """
    others = [f.path for f in report_files(prefix) if (f.package, f.kind) != (package, kind)]
    texts = _texts(spark, others)
    docs = _elements(texts).where("readable").withColumn("stale", F.lit(not trusted) & ~F.trim("value").startswith("[") & ~F.coalesce(F.get_json_object("value", "$.weirflow.version") == version, F.lit(False)))
    rows = docs.select("stale", F.explode("elements").alias("text")).select("stale", F.from_json("text", UNIT).alias("u")).where("u.fn is not null and coalesce(u.hash, '') <> ''")
    said = F.when(F.col("stale"), F.array(F.lit(UNKNOWN))).otherwise(F.filter("u.inferred", lambda e: e.isin(ALL_EFFECTS)))
    effects = rows.select(F.col("u.hash").alias("hash"), F.explode(said).alias("effect")).distinct()
    literals = [rows.where(~F.col("stale")).select(F.col("u.hash").alias("hash"), F.lit(k).alias("kind"), F.explode(f"u.{k}").alias("value")) for k in ("hosts", "cmds", "paths", "tables")]
    return effects, literals[0].union(literals[1]).union(literals[2]).union(literals[3]).distinct()


def baseline(spark: SparkSession, value: str, package: str, version: str, declared: bool = False) -> DataFrame | None:
    """(fn, effect) of an earlier report to compare with; None where none has been recorded yet.

    ``value`` is a report or a prefix.  A prefix with reports of other packages alone is a baseline without this package:
    all its units are absent from it, so there are no rows.  Refused (2): an empty value, a configuration that ``declared``
    a baseline which is not there, one that can't be read whole, and one that another version, or an unknown one, wrote.
    """
    if not value.strip():
        raise Refused("the baseline is configured with an empty value")
    of_package = f"{value}.{package}.scan.json"
    own = value if value.endswith(".json") and files.exists(spark, value) else of_package if files.exists(spark, of_package) else None
    path = own or next((f.path for f in report_files(value)), None)
    if path is None:
        if declared:
            raise Refused(f"the configuration declares the baseline {value}, which is not there")
        return None
    docs = _elements(_texts(spark, [path]))
    head = docs.select("readable", F.get_json_object("value", "$.weirflow.version").alias("version")).first()
    rows = parsed(docs)
    if head is None or not head["readable"] or not rows.where(~F.col("ok")).isEmpty():
        raise Refused(f"the baseline {path} can't be read whole")
    if head["version"] != version:
        raise Refused(f"the baseline {path} was written by {head['version'] or 'an unknown version'}, this is {version}")
    found = rows.select("u.fn", F.explode("u.inferred").alias("effect")).distinct()
    return found if own else found.limit(0)


def uncovered(spark: SparkSession, prefix: str) -> DataFrame:
    """(name, calls): packages called but not covered, added up over reports."""
    rows = envelopes(spark, prefix).where("coverage_state = 'present'").select(F.explode("coverage.uncovered").alias("c"))
    return rows.groupBy("c.name").agg(F.sum("c.calls").alias("calls"))


def refused_before(prefix: str) -> bool:
    """Whether the last scan left a mark that it refused."""
    return files.exists(SparkSession.active(), f"{prefix}.refused.json")


def facts(spark: SparkSession, prefix: str) -> Facts:
    """Facts of a snapshot at rest: its units and its call graph, or the units' own calls where there is no graph.

    Repeated names have the union of their sets.  The order of calls is the graph's or that of the units' lists.
    """
    rows = units(spark, prefix)
    own = rows.select(F.col("fn").alias("src"), F.posexplode("calls").alias("ord", "dst")).groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    order = call_graph(spark, prefix)[0] if sidecar_files(prefix, "callgraph") else own
    literals = [rows.select("fn", F.lit(k).alias("kind"), F.explode(k).alias("value")) for k in ("hosts", "cmds", "paths", "tables", "fs", "invisible")]
    every = literals[0]
    for more in literals[1:]:
        every = every.union(more)
    return Facts(
        rows.select("fn", F.col("entryPoint").alias("entry_point"), "unresolved", "loc", "hash"),
        order.select("src", "dst"),
        rows.select("fn", F.explode("direct").alias("effect")).distinct(),
        rows.select("fn", F.explode("unknownWhy").alias("why")).distinct(),
        every.distinct(),
        rows.select("fn", F.explode("incomplete").alias("effect")).distinct(),
        rows.select("fn", F.explode("inferred").alias("effect")).distinct(),
        order,
    )


def chained(rows: DataFrame, dependencies: DataFrame, version: str) -> DataFrame:
    """(fn, effect) that units get from calls into packages scanned before: dependencies (fn, effects, version).

    A dependency that another version scanned says only Unknown.
    """
    effects = F.when(F.col("version") == version, F.col("effects")).otherwise(F.array(F.lit(UNKNOWN)))
    facts_ = dependencies.select(F.col("fn").alias("dst"), F.explode(effects).alias("effect"))
    return rows.select("fn", F.explode("calls").alias("dst")).join(facts_, "dst").select("fn", "effect").distinct()


def resolve_calls(rows: DataFrame) -> DataFrame:
    """(caller, call, target, ambiguous) of rows (key, package, fn, calls): a unit of the same package, else the only one.

    A name that several packages have, none of them the caller's, is ambiguous: its caller gains Unknown, class dispatch.
    """
    calls = rows.select(F.col("key").alias("caller"), "package", F.explode("calls").alias("call"))
    here = rows.groupBy("package", F.col("fn").alias("call")).agg(F.min("key").alias("same"))
    anywhere = rows.groupBy(F.col("fn").alias("call")).agg(F.countDistinct("key").alias("n"), F.min("key").alias("only"))
    found = calls.join(here, ["package", "call"], "left").join(anywhere, "call", "left")
    target = F.coalesce("same", F.when(F.col("n") == 1, F.col("only")))
    return found.select("caller", "call", target.alias("target"), (target.isNull() & (F.coalesce("n", F.lit(0)) > 1)).alias("ambiguous"))


def write_report(rows: DataFrame, path: str, package: str, version: str, digest: str | None = None) -> None:
    """One report: the envelope and the units, fields with defaults left out.  Units are sorted; the file appears whole.

    A report is one document, so its units pass through the driver, a partition at a time, and are never held together.
    ``digest`` is that of the source it was made from (``tree_hash``), by which ``state`` tells whether it still holds.
    """
    import json

    kept = [c for c in rows.columns if c in UNIT.names]
    blank = {c: F.when(F.size(c) > 0, F.col(c)) for c in kept if c in _SETS} | {c: F.when(F.col(c), F.lit(True)) for c in kept if c in _FLAGS} | {c: F.nullif(F.col(c), F.lit("")) for c in kept if c in ("loc", "hash")}
    texts = rows.select(kept).withColumns(blank).orderBy("fn").select(F.to_json(F.struct(*kept), {"ignoreNullFields": "true"}).alias("j"))
    head = {"weirflow": {"version": version, "spec": "1"}, "package": package, "analyzed": {"count": rows.count(), **({"digest": digest} if digest else {})}}
    files.write_whole(rows.sparkSession, path, _json_lines(json.dumps(head, ensure_ascii=False)[:-1] + ', "functions": [', (r["j"] for r in texts.toLocalIterator()), "]}\n"))


def tree_hash(spark: SparkSession, root: str, suffix: str = "") -> str:
    """FNV-1a of a folder's files in order of their paths: path, zero byte, content, zero byte; outputs of builds left out.

    The digest depends on the order of all bytes, so the driver folds them, a partition of files at a time.
    """
    h = 0xCBF29CE484222325
    paths = [e.path for e in files.walk(spark, root) if e.name.endswith(suffix)]
    if not paths:
        return f"{h:016x}"
    base = files.client(spark, root)[1].makeQualified(files.client(spark, root)[0]).toString()
    rows = spark.read.format("binaryFile").load(paths).select("path", "content").orderBy("path")
    for r in rows.toLocalIterator():
        for part in (os.path.relpath(r["path"].split(":", 1)[-1].replace("///", "/"), base.split(":", 1)[-1]).encode(), b"\0", r["content"], b"\0"):
            for b in part:
                h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"


def state(spark: SparkSession, prefix: str, root: str, suffix: str = "") -> str:
    """What the reports at a prefix say of a source folder now: fresh, stale, undated (no digest), refused or absent."""
    if refused_before(prefix):
        return "refused"
    digests = [r["digest"] for r in envelopes(spark, prefix).select("analyzed.digest").collect()]  # one a report
    if not digests:
        return "absent"
    if None in digests:
        return "undated"
    now = tree_hash(spark, root, suffix)
    return "fresh" if all(d == now for d in digests) else "stale"


def snapshot(spark: SparkSession, prefix: str, root: str, scan: Callable[[], Facts], suffix: str = "") -> Facts:
    """The facts of a source folder: those at rest while they are fresh, else what ``scan`` finds."""
    return facts(spark, prefix) if state(spark, prefix, root, suffix) == "fresh" else scan()
