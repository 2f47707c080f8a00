"""Scalar helpers of kernels, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def sign(a: Column, b: Column) -> Column:
    """``a``, negated where ``b`` is negative (not the absolute value of ``a``)."""
    return F.when(b < 0, -a).otherwise(a)


def min3(a: Column, b: Column, c: Column) -> Column:
    return F.least(a, b, c)


def max3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(a, b, c)


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def to_half(value: Column) -> Column:
    """The nearest IEEE binary16 number, as a float. No built-in function rounds so."""

    def half(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.astype(np.float16).astype(np.float32)

    return F.pandas_udf(half, FloatType())(value.cast("float"))


def to_half_each(values: Column) -> Column:
    """The same for each entry of an array."""

    def half(x: pa.Array) -> pa.Array:
        rounded = x.values.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
        return pa.ListArray.from_arrays(x.offsets, pa.array(rounded), mask=x.is_null() if x.null_count else None)

    half.__annotations__ = {"x": pa.Array, "return": pa.Array}  # names alone would not tell an Arrow function
    return F.arrow_udf(half, "array<float>")(values.cast("array<float>"))
