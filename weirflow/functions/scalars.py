"""Scalar functions as columns: hosts, commands, paths, tables, reasons, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: verbs of file operations
FS_WRITE = ["write", "write_all", "write_at", "write_vectored", "write_fmt", "create", "create_new", "create_dir", "create_dir_all", "remove_file", "remove_dir", "remove_dir_all", "rename", "set_permissions", "set_len", "set_modified", "set_times", "hard_link", "soft_link", "symlink", "symlink_file", "symlink_dir", "truncate", "append", "sync_all", "sync_data"]
FS_READ = ["read", "read_to_string", "read_to_end", "read_at", "read_dir", "read_link", "read_exact", "read_vectored", "metadata", "symlink_metadata", "open", "canonicalize", "try_exists", "exists", "file_type", "read_to"]
# fixed values: prefixes of reasons and the class of each, tried in this order
REASON_PREFIXES = [("reflect", "reflect"), ("native", "native"), ("dispatch", "dispatch"), ("callback", "indirect"), ("ambiguous", "dispatch"), ("dynamicmemberlookup", "reflect"), ("closure", "indirect"), ("task-handoff", "indirect"), ("indy", "dispatch"), ("missing-config", "setup"), ("no-tsconfig", "setup"), ("no-node_modules", "setup")]


def chain(cases: list[tuple[Column, Column]], other: Column) -> Column:
    """The first case that holds."""
    out = other
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def host_part(h: Column) -> Column:
    """A host without port or brackets; an address with more than one colon stays."""
    return chain([(h.startswith("["), F.substring_index(F.substring(h, 2, 1 << 30), "]", 1)), (F.size(F.split(h, ":", -1)) > 2, h)], F.substring_index(h, ":", 1))


def net_host_literal(s: Column) -> Column:
    """host[:port] of a literal that names a network endpoint, else null."""
    text = F.regexp_replace(s, r"^\s+|\s+$", "")
    after = F.regexp_replace(text, r"^(?s:.*?)://", "")
    authority = F.element_at(F.split(F.substring_index(after, "/", 1), "@", -1), -1)
    fine = (authority != "") & ~authority.rlike(r"\s")
    return F.when(fine & (authority.contains(".") | authority.endswith(":11434")), authority)


def cmd_base(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/\\]*$", 0)


def fs_path_covered(allowed: Column, reached: Column) -> Column:
    """Whether an allowed path holds a reached one: by whole components, never through '..', never across absoluteness."""
    def parts(p: Column) -> Column:
        return F.filter(F.split(p, r"[/\\]", -1), lambda c: (c != "") & (c != "."))

    def rooted(p: Column) -> Column:
        return p.startswith("/") | p.startswith("\\")

    climbs = F.exists(F.split(reached, r"[/\\]", -1), lambda c: c == "..")
    a, r = parts(allowed), parts(reached)
    return ~climbs & (rooted(allowed) == rooted(reached)) & (F.slice(r, F.lit(1), F.size(a)) == a)


def db_table_covered(allowed: Column, reached: Column) -> Column:
    a, r = F.lower(allowed), F.lower(reached)
    return F.when(a.endswith(".*"), F.startswith(r, F.substring(a, F.lit(1), F.length(a) - 1))).otherwise(a == r)


def literal_allowed(effect: Column, reached: Column, allowed: Column) -> Column:
    """Whether one of an array of allowed literals covers a reached one, by the effect's way of comparing."""
    return chain(
        [
            (effect.isin("Net", "Llm"), F.exists(allowed, lambda a: host_part(a) == host_part(reached))),
            (effect == "Exec", F.exists(allowed, lambda a: cmd_base(a) == cmd_base(reached))),
            (effect == "Fs", F.exists(allowed, lambda a: fs_path_covered(a, reached))),
            (effect == "Db", F.exists(allowed, lambda a: db_table_covered(a, reached))),
        ],
        F.array_contains(allowed, reached),
    )


def reason_class(why: Column) -> Column:
    w = F.lower(F.trim(why))
    return chain([(w.startswith(p), F.lit(c)) for p, c in REASON_PREFIXES], F.lit("unresolved"))


def reason_class_matches(classes: Column, wanted: list[str]) -> Column:
    """Whether an array of classes meets the wanted ones; no classes count as unresolved."""
    bare = classes.isNull() | (F.size(classes) == 0)
    return F.when(bare, F.lit("unresolved" in wanted)).otherwise(F.arrays_overlap(classes, F.array(*map(F.lit, wanted))))


def net_dest_class(host: Column, table: Column) -> Column:
    """The class of a host by a map from domain to class: its own entry or the longest domain above it; else unknown-host.

    The table is the user's; none is built in.
    """
    labels = F.split(F.lower(host_part(host)), r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    classes = F.filter(F.transform(domains, lambda d: F.try_element_at(table, d)), lambda c: c.isNotNull())
    return F.coalesce(F.get(classes, F.lit(0)), F.lit("unknown-host"))


def fs_kind(path: Column) -> Column:
    """Array of read and write: what the last name of a path of a file operation does."""
    leaf = F.regexp_replace(F.substring_index(F.substring_index(path, "::", -1), "<", 1), r"^[()]+|[()]+$", "")
    none = F.array().cast("array<string>")
    return chain([(path.contains("OpenOptions"), none), (leaf == "copy", F.array(F.lit("read"), F.lit("write"))), (leaf.isin(FS_WRITE), F.array(F.lit("write"))), (leaf.isin(FS_READ), F.array(F.lit("read")))], none)


def fnv1a(names: Column) -> Column:
    """FNV-1a over each name's UTF-8 bytes and a line end, 64 bits as decimal(38,0); names in the order given."""
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    text = F.concat(F.array_join(names, "\n"), F.when(F.size(names) > 0, F.lit("\n")).otherwise(F.lit("")))
    digits = F.hex(text.cast("binary"))
    pairs = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")
        low = (h % 256).cast("long")
        mixed = (h - low.cast("decimal(38,0)") + low.bitwiseXOR(byte).cast("decimal(38,0)")).cast("decimal(38,0)")
        # the prime is 2^40 + 435; the product is taken in two parts that fit
        high = (mixed % F.lit(1 << 24).cast("decimal(38,0)")) * F.lit(1 << 40).cast("decimal(38,0)")
        return ((high.cast("decimal(38,0)") + (mixed * F.lit(435).cast("decimal(10,0)")).cast("decimal(38,0)")) % two64).cast("decimal(38,0)")

    return F.aggregate(pairs, F.lit("14695981039346656037").cast("decimal(38,0)"), step)


def fnv1a_by(rows: DataFrame, group: str, name: str) -> DataFrame:
    """(group, digest): ``fnv1a`` of each group's distinct names in byte order, as a string of decimal digits.

    A group's names pass through one task in their order and are never held: its state is 64 bits.  Null names are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, begun = None, 0, False
        for b in batches:
            done: list[tuple] = []
            for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not begun or g != now:
                    if begun:
                        done.append((now, str(h)))
                    now, h, begun = g, 0xCBF29CE484222325, True
                for byte in n.encode() + b"\n":
                    h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], [group, "digest"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([str(h)])], [group, "digest"])

    named = rows.where(F.col(name).isNotNull()).select(F.col(group).cast("string"), name).distinct()
    return named.repartition(group).sortWithinPartitions(group, name).mapInArrow(run, f"`{group}` string, digest string")


def spec_predates(spec: Column, major: int, minor: int) -> Column:
    """Whether a version is older than major.minor; what can't be read counts as older."""
    a, b = F.try_element_at(F.split(spec, r"\."), F.lit(1)), F.try_element_at(F.split(spec, r"\."), F.lit(2))
    x, y = a.try_cast("int"), b.try_cast("int")
    return F.coalesce((x < major) | ((x == major) & (y < minor)), F.lit(True))


def rule_key(rule: Column) -> Column:
    return F.trim(F.regexp_replace(rule, r"[ \t\n\r\f]+", " "))


def is_positional(key: Column) -> Column:
    return key.rlike(r"\{[A-Za-z0-9_]+#\d+\}")


def entry_key(hash_: Column, fn: Column) -> Column:
    return F.coalesce(F.nullif(hash_, F.lit("")), fn)
