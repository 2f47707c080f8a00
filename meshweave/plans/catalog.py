"""What a mesh program declares: blocks, fields, stencils, halos. Plain metadata, checked once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

AXES = ("i", "j", "k", "l", "m")
READ, WRITE, RW, INC, MIN, MAX = "read", "write", "rw", "inc", "min", "max"

#: Spellings of types that programs use, and Spark's types for them. Half precision is kept as float
#: and rounded after each write; unsigned types are widened.
TYPES = {
    "double": "double", "real(8)": "double", "real(kind=8)": "double", "double precision": "double",
    "float": "float", "real": "float", "real(4)": "float", "real(kind=4)": "float", "half": "float",
    "int": "int", "int(4)": "int", "integer": "int", "integer(4)": "int", "integer(kind=4)": "int",
    "short": "smallint", "char": "tinyint", "long": "bigint", "long long": "bigint", "ll": "bigint",
    "unsigned int": "bigint", "uint": "bigint", "unsigned long": "decimal(20,0)", "ul": "decimal(20,0)", "unsigned long long": "decimal(20,0)", "ull": "decimal(20,0)",
    "complexf": "struct<re:float,im:float>", "complexd": "struct<re:double,im:double>", "bool": "boolean",
}


class MeshError(ValueError):
    """A declaration or a loop that has no meaning."""


@dataclass(frozen=True)
class Block:
    """A group of fields over the same axes. It has no size of its own."""

    name: str
    dims: int

    def __post_init__(self) -> None:
        if not 1 <= self.dims <= len(AXES):
            raise MeshError(f"block {self.name}: {self.dims} dimensions; 1 to {len(AXES)} are possible")

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: self.dims]


Box = tuple[tuple[int, int], ...]  # half-open (low, high) for each axis


@dataclass(frozen=True)
class Field:
    """A field ("dat"): values on a box of coordinates with halos below and above it.

    An axis of size 1 is collapsed: the field has no coordinate there and is the same all along it.
    """

    block: Block
    name: str
    size: tuple[int, ...]
    base: tuple[int, ...] = ()
    below: tuple[int, ...] = ()
    above: tuple[int, ...] = ()
    dim: int = 1
    dtype: str = "double"
    stride: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        n = self.block.dims
        for name, default in (("base", 0), ("below", 0), ("above", 0), ("stride", 1)):
            if not getattr(self, name):
                object.__setattr__(self, name, (default,) * n)
        if any(len(getattr(self, x)) != n for x in ("size", "base", "below", "above", "stride")):
            raise MeshError(f"field {self.name}: one entry for each of {n} axes is needed")
        if any(d > 0 for d in self.below) or any(d < 0 for d in self.above):
            raise MeshError(f"field {self.name}: halo depths are at most 0 below and at least 0 above")
        if any(s < 1 for s in self.size) or self.dim < 1:
            raise MeshError(f"field {self.name}: sizes and dim are at least 1")
        if self.dtype not in TYPES:
            raise MeshError(f"field {self.name}: unknown type {self.dtype}")

    @property
    def kept(self) -> tuple[int, ...]:
        """Numbers of the axes that are not collapsed."""
        return tuple(a for a in range(self.block.dims) if self.size[a] > 1)

    @property
    def axes(self) -> tuple[str, ...]:
        return tuple(AXES[a] for a in self.kept)

    @property
    def degenerate(self) -> bool:
        return len(self.kept) < self.block.dims

    @property
    def interior(self) -> Box:
        return tuple((b, b + s) for b, s in zip(self.base, self.size, strict=True))

    @property
    def allocation(self) -> Box:
        return tuple((b + d, b + s + a) for b, s, d, a in zip(self.base, self.size, self.below, self.above, strict=True))

    @property
    def spark_type(self) -> str:
        kind = TYPES[self.dtype]
        return kind if self.dim == 1 else f"array<{kind}>"

    @property
    def floating(self) -> bool:
        return TYPES[self.dtype] in ("double", "float")

    def like(self, name: str) -> Field:
        """The same metadata under another name."""
        return replace(self, name=name)


@dataclass(frozen=True)
class Stencil:
    """Offsets that a loop may read. ``kind``: regular, restrict (coarse reads fine at
    ``ratio * index + offset``) or prolong (fine reads coarse at ``index div ratio + offset``).
    ``stride`` 0 leaves an axis out."""

    name: str
    points: tuple[tuple[int, ...], ...]
    kind: str = "regular"
    ratio: tuple[int, ...] = ()
    stride: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "points", tuple(map(tuple, self.points)))
        if not self.points or len({len(p) for p in self.points}) != 1:
            raise MeshError(f"stencil {self.name}: points need one offset for each axis")
        if self.kind not in ("regular", "restrict", "prolong"):
            raise MeshError(f"stencil {self.name}: unknown kind {self.kind}")
        if self.kind != "regular" and (len(self.ratio) != len(self.points[0]) or any(r < 1 for r in self.ratio)):
            raise MeshError(f"stencil {self.name}: a ratio of at least 1 for each axis is needed")

    @classmethod
    def star(cls, dims: int, reach: int = 1) -> Stencil:
        """The centre and ``reach`` points both ways along each axis."""
        zero = (0,) * dims
        arms = [tuple(s * d if b == a else 0 for b in range(dims)) for a in range(dims) for d in range(1, reach + 1) for s in (1, -1)]
        return cls(f"star{dims}d{reach}", (zero, *arms))

    @classmethod
    def point(cls, dims: int) -> Stencil:
        return cls(f"point{dims}d", ((0,) * dims,))


@dataclass(frozen=True)
class Halo:
    """A copy of a box between fields. Directions are 1-based and signed; a negative one flips, so a mirror is
    a halo of a field with itself. Values are multiplied by ``sign``."""

    source: Field
    target: Field
    shape: tuple[int, ...]
    from_base: tuple[int, ...]
    to_base: tuple[int, ...]
    from_dir: tuple[int, ...]
    to_dir: tuple[int, ...]
    sign: float = 1

    def __post_init__(self) -> None:
        n = len(self.shape)
        for d in (self.from_dir, self.to_dir):
            if sorted(map(abs, d)) != list(range(1, n + 1)):
                raise MeshError(f"halo {self.source.name} to {self.target.name}: directions {d} are no permutation of 1..{n}")
        if self.source.dim != self.target.dim:
            raise MeshError(f"halo {self.source.name} to {self.target.name}: they differ in dim")
        if self.sign != 1 and TYPES[self.target.dtype] in ("boolean", *(x for x in TYPES.values() if x.startswith("struct"))):
            raise MeshError(f"halo {self.source.name} to {self.target.name}: {self.target.dtype} takes no sign")


def box_of(bounds: list[int] | tuple[int, ...] | Box) -> Box:
    """``[lo0, hi0, lo1, hi1, ...]`` or pairs, as pairs."""
    if bounds and not isinstance(bounds[0], (tuple, list)):
        bounds = tuple(zip(bounds[::2], bounds[1::2], strict=True))
    return tuple((int(a), int(b)) for a, b in bounds)


def box_size(box: Box) -> int:
    n = 1
    for low, high in box:
        n *= max(0, high - low)
    return n


@dataclass
class LoopRecord:
    """What a loop did, for the diagnostics."""

    name: str
    box: Box
    planned: float = 0.0
    seconds: float = 0.0  # of running, where loops are profiled
    calls: int = 0
    bytes: int = 0
    fields: list[str] = field(default_factory=list)
