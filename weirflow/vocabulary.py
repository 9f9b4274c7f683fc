"""Effects, reason classes and other closed vocabularies; fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EFFECTS = ["Net", "Db", "Llm", "Fs", "Exec", "Ipc", "Env", "Clock", "Rand", "Clipboard", "Log"]
UNKNOWN = "Unknown"
ALL_EFFECTS = [*EFFECTS, UNKNOWN]
#: Effects that belong in a layer of their own, and those that any layer may have.
CONTAINED = ["Db", "Net", "Llm", "Exec", "Fs", "Ipc", "Clipboard"]
AMBIENT = ["Log", "Clock", "Rand", "Env"]
REASON_CLASSES = ["reflect", "dispatch", "indirect", "native", "unresolved", "setup"]
NET_CLASSES = ["known-telemetry", "known-partner", "unknown-host"]
#: Each bit of a mask: an effect, or (from bit 12 on) a reason class.
BITS = {name: 1 << i for i, name in enumerate([*ALL_EFFECTS, *REASON_CLASSES])}


def bit(name: Column) -> Column:
    out = F.lit(0).cast("long")
    for k, v in BITS.items():
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return out


def members(mask: Column, names: list[str]) -> Column:
    """The names whose bits are set, sorted."""
    return F.sort_array(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(BITS[n]).cast("long")) != 0, F.lit(n)) for n in names])))
