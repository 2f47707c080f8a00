"""Options of a run, from words such as a command line has."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .catalog import MeshError


@dataclass(frozen=True)
class Options:
    """``profile``: run each loop when it is planned, and time it; ``cut_every``: loops between cuts of
    lineage; ``partitions``: of shuffles (0: as the session has it); ``diagnostics``: 0 none, 1 the fields
    at the end, 2 the loops too; ``interval``: least seconds between checkpoints."""

    profile: bool = False
    cut_every: int = 4
    partitions: int = 0
    diagnostics: int = 1
    interval: float = 4.0

    @classmethod
    def parse(cls, words: Iterable[str]) -> Options:
        """``name=value`` or ``name`` for a flag, with or without dashes before; other words are left to the
        program. A later word overrides an earlier one."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for word in words:
            name, _, value = word.lstrip("-").partition("=")
            name = name.replace("-", "_").lower()
            if name not in kinds:
                continue
            try:
                found[name] = value.lower() in ("", "1", "true", "yes", "on") if kinds[name] is bool else kinds[name](value)
            except ValueError as e:
                raise MeshError(f"option {name}: {value!r} is no {kinds[name].__name__}") from e
        out = cls(**found)
        if out.cut_every < 1 or out.partitions < 0 or out.interval <= 0:
            raise MeshError(f"options out of range: {out}")
        return out

    def mesh(self, spark: SparkSession):
        """A mesh with these options."""
        from ..operators.loop import Mesh

        if self.partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(self.partitions))
        return Mesh(spark, cut_every=self.cut_every, profile=self.profile)
