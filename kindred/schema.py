"""Column layouts shared by every operator.

A *layer* is a named representation of the same stimuli.  Its second-moment
matrix (called the gram throughout: it is not mean-centred) is kept either as
one row per cell or, for the dense linear algebra, as one row per layer.
"""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


#: one row per unordered layer pair, a < b
DIST = _struct(
    ("measure", T.StringType()), ("a", T.StringType()), ("b", T.StringType()), ("value", T.DoubleType())
)
