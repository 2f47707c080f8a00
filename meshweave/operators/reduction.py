"""Global reductions: handles that loops add to, read out and reset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.catalog import INC, MAX, MIN, TYPES, WRITE, MeshError

#: What MIN and MAX start from.
LIMITS = {"double": 1.7976931348623157e308, "float": 3.4028234663852886e38, "int": 2147483647, "smallint": 32767, "tinyint": 127, "bigint": 9223372036854775807}


def identity(access: str, dtype: str) -> float | int:
    kind = TYPES[dtype]
    if access in (INC, WRITE):
        return 0
    if kind not in LIMITS:
        raise MeshError(f"{access} of {dtype} has no meaning")
    return LIMITS[kind] if access == MIN else -LIMITS[kind]


def folded(value: Column, access: str) -> Column:
    """The aggregate of an access. MIN and MAX leave NaN out."""
    if access == INC:
        return F.sum(value)
    number = F.when(~F.isnan(value.cast("double")), value)
    return F.min(number) if access == MIN else F.max(number)


@dataclass
class Folds:
    """One row with what a loop folds into all its handles; it is computed once, however many of them
    are read out."""

    frame: DataFrame
    found: Row | None = None

    def row(self) -> Row:
        if self.found is None:
            self.found = self.frame.first()
        return self.found


@dataclass
class Reduction:
    """A handle of ``dim`` values. The first use fixes the access until the result is read."""

    name: str
    dim: int = 1
    dtype: str = "double"
    access: str | None = None
    pending: list[tuple[Folds, list[str]]] = field(default_factory=list)

    def check(self, access: str) -> None:
        """Raises if the handle cannot be used with an access now."""
        if self.access not in (None, access):
            raise MeshError(f"reduction {self.name} is in use with {self.access}; {access} needs the result to be read first")
        if access not in (INC, MIN, MAX, WRITE) or access == WRITE and TYPES[self.dtype].startswith("struct"):
            raise MeshError(f"reduction {self.name}: {access} is no reduction")
        identity(access, self.dtype)

    def add(self, folds: Folds, names: list[str], access: str) -> None:
        self.check(access)
        self.access = access
        self.pending.append((folds, names))

    def frame(self) -> DataFrame:
        """One row ``r0, r1, ...`` of all that was added, not read out."""
        if not self.pending:
            raise MeshError(f"reduction {self.name} was not used")
        parts = [f.frame.select(F.lit(k).alias("n"), *(F.col(x).alias(f"r{d}") for d, x in enumerate(names))) for k, (f, names) in enumerate(self.pending)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        start = F.lit(identity(self.access, self.dtype))
        kind = TYPES[self.dtype]
        if kind.startswith("struct"):
            part = kind.split(":")[1].split(",")[0]
            return every.agg(*(F.struct(*(F.coalesce(F.sum(f"r{d}.{x}"), F.lit(0)).cast(part).alias(x) for x in ("re", "im"))).alias(f"r{d}") for d in range(self.dim)))
        both = lambda r: F.max_by(r, F.when(r.isNotNull(), F.col("n"))) if self.access == WRITE else folded(r, self.access)
        return every.agg(*(F.coalesce(both(F.col(f"r{d}")), start).cast("double" if kind == "float" and self.access == INC else kind).alias(f"r{d}") for d in range(self.dim)))

    def result(self):
        """The value, or a list of ``dim`` values; resets the handle. The folds of a loop are computed once
        for all its handles; those of several loops are put together here."""
        if not self.pending:
            raise MeshError(f"reduction {self.name} was not used")
        rows = [[f.row()[x] for x in names] for f, names in self.pending]
        values = [self._together([r[d] for r in rows]) for d in range(self.dim)]
        self.access, self.pending = None, []
        return values[0] if self.dim == 1 else values

    def _together(self, found: list):
        start, kind = identity(self.access, self.dtype), TYPES[self.dtype]
        if kind.startswith("struct"):
            return Row(re=sum(x["re"] or 0.0 for x in found), im=sum(x["im"] or 0.0 for x in found))
        found = [x for x in found if x is not None]
        if self.access == INC:
            total = sum(found, start)
            return float(total) if kind in ("double", "float") else total
        if self.access == WRITE:
            return found[-1] if found else float(start) if kind in ("double", "float") else start
        return (min if self.access == MIN else max)(found, default=start)
