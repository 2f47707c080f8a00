"""A PySpark-native engine for data on multi-block structured grids."""

from .operators.loop import Dat, Gbl, Idx, Mesh, Opt, Reduce, inc, read, rw, write
from .operators.reduction import Reduction
from .plans.catalog import INC, MAX, MIN, READ, RW, WRITE, Block, Field, Halo, MeshError, Stencil

__all__ = ["INC", "MAX", "MIN", "READ", "RW", "WRITE", "Block", "Dat", "Field", "Gbl", "Halo", "Idx", "Mesh", "MeshError", "Opt", "Reduce", "Reduction", "Stencil", "inc", "read", "rw", "write"]
