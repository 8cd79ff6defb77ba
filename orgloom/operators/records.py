"""The catalogue record: one shape for every row, and conforming whatever comes to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B, _A = T.StringType(), T.IntegerType(), T.BooleanType(), T.ArrayType(T.StringType())
RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("organisation", _S), ("sector", _S), ("category", _S), ("type", _S), ("base", _S), ("languages", _S), ("size", _I), ("description", _S), ("why_fits", _S), ("target_roles", _S), ("priority", _I),
    ("eu_nationality", _S), ("homepage", _S), ("careers_url", _S), ("careers_confidence", _S), ("last_updated", _S), ("last_updated_source", _S), ("last_updated_trust", _S), ("sources", _A),
    ("phd_relevant", _B), ("latam_relevant", _B), ("remote_friendly", _B), ("careers_score", _I), ("careers_reasons", _A),
)])
#: Fields that stay null when they are missing.
_NULL = frozenset(("size", "priority"))


def default(field: T.StructField) -> Column:
    """What a missing field holds."""
    if field.name in _NULL:
        return F.lit(None).cast(field.dataType)
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    return F.lit({"string": "", "int": 0, "boolean": False, "bigint": 0, "double": 0.0}.get(field.dataType.simpleString())).cast(field.dataType)


def conform(df: DataFrame, schema: T.StructType = RECORD, **given: Column) -> DataFrame:
    """The rows in a schema: given columns first, then columns of the same name, else defaults; nulls get defaults."""
    out = []
    for f in schema.fields:
        source = given.get(f.name, F.col(f.name) if f.name in df.columns else None)
        value = default(f) if source is None else F.coalesce(source.cast(f.dataType), default(f))
        out.append(value.alias(f.name))
    return df.select(*out)


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows with every column of the schema; those they lack hold defaults, those they have stay."""
    return df.withColumns({f.name: default(f) for f in schema.fields if f.name not in df.columns})


def as_int(c: Column) -> Column:
    """A number from anything; what can't be read is 0."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))
