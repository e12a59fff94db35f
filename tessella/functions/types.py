"""Element types and the Spark types that stand for them."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK: dict[str, T.DataType] = {
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Int": T.LongType(),
    # unsigned words stand in the next wider type, masked after every operation; 64-bit ones are bit patterns
    "Word8": T.ShortType(), "Word16": T.IntegerType(), "Word32": T.LongType(), "Word64": T.LongType(), "Word": T.LongType(),
    "Half": T.FloatType(), "Float": T.FloatType(), "Double": T.DoubleType(), "Bool": T.BooleanType(), "Char": T.IntegerType(),
}

WORD_BITS = {"Word8": 8, "Word16": 16, "Word32": 32}

COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
RATIO = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])

#: Absolute and relative tolerance for comparing results.
TOLERANCE = {"Half": (0.05, 0.5), "Float": (5e-5, 5e-3), "Double": (5e-5, 5e-3)}


def vec_type(n: int, element: str) -> T.ArrayType:
    """A fixed-length vector; n is kept by its users."""
    return T.ArrayType(SPARK[element], containsNull=False)


def either_type(left: T.DataType, right: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("tag", T.ByteType()), T.StructField("l", left), T.StructField("r", right)])


def similar(a: float, b: float, kind: str = "Double") -> bool:
    """Equality up to the type's tolerance; NaN is like NaN, an infinity like itself."""
    if a != a or b != b:
        return a != a and b != b
    tol, rel = TOLERANCE[kind]
    return a == b or abs(a - b) <= max(tol, rel * max(abs(a), abs(b)))
