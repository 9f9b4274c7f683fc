"""The tables that all operators read, and what is derived from them once."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars
from .plans import graph
from .plans.staging import Stage
from .vocabulary import ALL_EFFECTS, REASON_CLASSES, UNKNOWN, bit, members


@dataclass
class Facts:
    """units (fn, entry_point, unresolved, loc), edges (src, dst), direct (fn, effect), reasons (fn, why),
    literals (fn, kind, value): one row a fact, none repeated."""

    units: DataFrame
    edges: DataFrame
    direct: DataFrame
    reasons: DataFrame
    literals: DataFrame
    #: Units whose literals for an effect are known to be incomplete: (fn, effect).
    incomplete: DataFrame | None = None
    given: DataFrame | None = field(default=None)  # (fn, effect) of a report that already has the fixpoint
    order: DataFrame | None = None  # (src, dst, ord): the place of each call in its caller

    @functools.cached_property
    def calls(self) -> DataFrame:
        """The edges, each once, staged: every walk over these facts reads the same table."""
        return Stage(self.edges.select("src", "dst").distinct(), "calls").df

    @functools.cached_property
    def masks(self) -> DataFrame:
        """(fn, mask): effects and reason classes of each unit and all it reaches, in one fixpoint.

        A unit that performs Unknown directly without a recorded reason counts as unresolved.
        """
        known = self.reasons.select("fn", scalars.reason_class(F.col("why")).alias("name"))
        bare = self.direct.where(F.col("effect") == UNKNOWN).join(self.reasons.select("fn").distinct(), "fn", "left_anti").select("fn", F.lit("unresolved").alias("name"))
        names = self.direct.select("fn", F.col("effect").alias("name")).unionByName(known).unionByName(bare)
        return graph.propagate(self.calls, names.select("fn", bit(F.col("name")).alias("mask")), staged=True)

    @functools.cached_property
    def inferred(self) -> DataFrame:
        """(fn, effect): what each unit performs, itself or through callees."""
        if self.given is not None:
            return self.given
        return self.masks.select("fn", F.explode(members(F.col("mask"), ALL_EFFECTS)).alias("effect"))

    @functools.cached_property
    def reason_classes(self) -> DataFrame:
        """(fn, class) of each unit's Unknown, its own and inherited."""
        return self.masks.select("fn", F.explode(members(F.col("mask"), REASON_CLASSES)).alias("class"))

    @functools.cached_property
    def reached_literals(self) -> DataFrame:
        """(fn, kind, value): literals of each unit and of all it reaches."""
        out = graph.closure(self.callers, self.literals.select("kind", "value", F.col("fn").alias("node")), ["kind", "value"], staged=True)
        return Stage(out.select(F.col("node").alias("fn"), "kind", "value"), "literals").df

    @functools.cached_property
    def reached_incomplete(self) -> DataFrame | None:
        """(fn, effect): whose literals are incomplete, its own or those of what it reaches; a report's are propagated already."""
        if self.incomplete is None or self.given is not None:
            return self.incomplete
        masks = graph.propagate(self.calls, self.incomplete.select("fn", bit(F.col("effect")).alias("mask")), staged=True)
        return masks.select("fn", F.explode(members(F.col("mask"), ALL_EFFECTS)).alias("effect"))

    @property
    def callers(self) -> DataFrame:
        """The edges turned round, for walks from callee to caller."""
        return self.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    @property
    def names(self) -> DataFrame:
        """(fn): every unit and every end of an edge."""
        return self.units.select("fn").unionByName(self.edges.select(F.col("src").alias("fn"))).unionByName(self.edges.select(F.col("dst").alias("fn"))).distinct()

