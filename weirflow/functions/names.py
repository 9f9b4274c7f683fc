"""Names of units as columns: matching, segments, modules, layers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import chain

# fixed values: tokens that read as local or pure, and tokens that suggest an effect
BENIGN = ["settings", "config", "conf", "options", "opts", "util", "utils", "helper", "helpers", "model", "models", "dto", "entity", "format", "fmt", "parse", "get", "load", "new", "default", "validate", "valid", "render", "view", "build", "builder", "item", "entry", "record", "state", "context", "ctx", "info", "meta", "data", "value", "node", "field", "name", "key", "id", "path", "kind", "type", "status", "check", "init", "setup"]
EFFECTY = ["fetch", "http", "https", "client", "api", "sync", "request", "req", "download", "upload", "query", "sql", "store", "save", "persist", "connect", "conn", "socket", "send", "recv", "read", "write", "open", "file", "fs", "io", "net", "tcp", "udp", "dns", "url", "host", "port", "cmd", "command", "shell", "process", "proc", "exec", "spawn", "env", "clock", "time", "now", "rand", "random", "log", "logger", "trace", "db"]


def match_tier(name: Column, query: str) -> Column:
    """3 the same, 2 a suffix after :: or '.', 1 contained, 0 not; an empty query matches nothing."""
    q = F.lit(query)
    if not query:
        return F.lit(0)
    return chain([(name == q, F.lit(3)), (name.endswith("::" + query) | name.endswith("." + query), F.lit(2)), (name.contains(query), F.lit(1))], F.lit(0))


def scope_segments(name: Column) -> Column:
    return F.filter(F.split(name, "[.:]", -1), lambda s: s != "")


def _scope(scope: str) -> list[str]:
    return [s for s in scope.replace(":", ".").split(".") if s]


def scope_matches(name: Column, scope: str, permitted: bool = False) -> Column:
    """Whether a scope's segments stand in a row in a name; the last is a prefix, unless the scope ends in a separator.

    With ``permitted`` (targets of an only-rule) every segment is exact.  An empty scope matches nothing.
    """
    parts = _scope(scope)
    if not parts:
        return F.lit(False)
    segs = scope_segments(name)
    k, last = len(parts), parts[-1]
    exact = permitted or scope.rstrip().endswith(("::", "."))
    starts = F.when(F.size(segs) >= k, F.sequence(F.lit(1), F.size(segs) - k + 1)).otherwise(F.array().cast("array<int>"))

    def fits(i: Column) -> Column:
        tail = F.get(segs, i + (k - 2))
        end = tail == last if exact else tail.startswith(last)
        return end if k == 1 else end & (F.slice(segs, i, F.lit(k - 1)) == F.array(*map(F.lit, parts[:-1])))

    return F.exists(starts, fits)


def segments(name: Column) -> Column:
    """On :: where the name has it, else on '.'."""
    return F.when(name.contains("::"), F.split(name, "::", -1)).otherwise(F.split(name, r"\.", -1))


def simple_method(name: Column) -> Column:
    """What follows the last '.' or ::."""
    return F.regexp_extract(name, r"^(?:.*(?:::|\.))?(.*)$", 1)


def declaring_type(name: Column) -> Column:
    """What stands before the last '.' or ::; the whole name if there is neither."""
    return F.when(name.contains("::") | name.contains("."), F.regexp_extract(name, r"^(.*)(?:::|\.)[^:.]*$", 1)).otherwise(name)


def norm_name(name: Column) -> Column:
    """The type of a name that begins with <T as ...>; other names as they are."""
    return F.when(name.startswith("<"), F.substring_index(F.substring(name, 2, 1 << 30), " as ", 1)).otherwise(name)


def module_of(name: Column) -> Column:
    """Before the first ' as ', '>' or :: where the name has ::, else before the last '.'; (root) if nothing is left."""
    bare = F.regexp_replace(name, "^<", "")
    marks = [F.nullif(F.instr(bare, m), F.lit(0)) for m in (" as ", ">", "::")]
    before = F.when(bare.contains("::"), F.substring(bare, F.lit(1), F.least(*marks) - 1)).when(bare.contains("."), F.regexp_extract(bare, r"^(?s:(.*))\.", 1)).otherwise("")
    return F.coalesce(F.nullif(F.trim(before), F.lit("")), F.lit("(root)"))


def layer_of(name: Column, shared: Column) -> Column:
    """The segment after the ``shared`` leading ones, if another follows; else (root)."""
    segs = segments(norm_name(name))
    return F.when(F.size(segs) > shared + 1, F.get(segs, shared)).otherwise("(root)")


def tokens(name: Column) -> Column:
    """Lower-case tokens on '_', ':' and where a capital follows a small letter or digit."""
    parts = F.split(F.regexp_replace(name, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2"), "[_:]+", -1)
    return F.filter(F.transform(parts, F.lower), lambda t: t != "")


def lexicon_token(name: Column, lexicon: list[str]) -> Column:
    """The first token in a lexicon, else null."""
    return F.get(F.filter(tokens(name), lambda t: t.isin(lexicon)), F.lit(0))


def leaf(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def module_path(name: Column) -> Column:
    """All before the last ::; empty without one."""
    return F.regexp_extract(name, r"^(.*)::", 1)


def is_test(name: Column) -> Column:
    """Whether a segment before the last marks test code."""
    segs = F.split(name, "::", -1)
    return F.exists(F.slice(segs, F.lit(1), F.size(segs) - 1), lambda s: F.lower(s).isin("test", "tests") | s.endswith("Test") | s.endswith("Tests"))


def salience(effect: Column) -> Column:
    return chain([(effect.isin("Net", "Exec", "Db", "Llm", "Ipc"), F.lit(5)), (effect.isin("Fs", "Env"), F.lit(3))], F.lit(0))


def hops_factor(hops: Column) -> Column:
    return chain([(hops == 1, F.lit(2)), (hops.between(2, 4), F.lit(3)), (hops.between(5, 6), F.lit(2))], F.lit(1))
