"""Output boundary: flat rows, CSV cells, leak audit, sinks, lane clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import csv_cell
from ..functions import text
from ..functions.text import first_leak


def csv_row(df: DataFrame) -> DataFrame:
    """Every column as CSV text."""
    return df.select(*[csv_cell(F.col(f"`{n}`"), t).alias(n) for n, t in df.dtypes])


def scrub(df: DataFrame) -> DataFrame:
    """Redacts every string of every column, nested ones included."""
    return df.select(*[_scrub(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _scrub(c, kind):
    if isinstance(kind, T.StringType):
        return text.scrub(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _scrub(x, kind.elementType))
    if isinstance(kind, T.MapType):
        out = F.transform_values(c, lambda _, v: _scrub(v, kind.valueType))
        return F.transform_keys(out, lambda k, _: _scrub(k, kind.keyType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_scrub(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows without the fields of these names at any depth: in columns, structs, arrays of structs and values of maps.

    The projection is made from the schema; nulls stay null, map keys and the order of
    what is left stay. A struct that loses all its fields goes too, and so does an array or map of such.
    """
    out = [(f.name, _without(F.col(f"`{f.name}`"), f.dataType, frozenset(names))) for f in df.schema.fields if f.name not in names]
    return df.select(*[c.alias(n) for n, c in out if c is not None])


def _without(c: Column, kind: T.DataType, names: frozenset[str]) -> Column | None:
    """The column without the named fields; None where nothing is left of its type."""
    if not _holds(kind, names):
        return c
    if isinstance(kind, T.StructType):
        kept = [(f.name, _without(c.getField(f.name), f.dataType, names)) for f in kind.fields if f.name not in names]
        kept = [(n, x) for n, x in kept if x is not None]
        return F.when(c.isNotNull(), F.struct(*[x.alias(n) for n, x in kept])) if kept else None
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    if _without(F.lit(None), inner, names) is None:
        return None
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _without(x, inner, names))
    return F.transform_values(c, lambda _, v: _without(v, inner, names))


def _holds(kind: T.DataType, names: frozenset[str]) -> bool:
    """Whether a type has one of the fields anywhere."""
    if isinstance(kind, T.StructType):
        return any(f.name in names or _holds(f.dataType, names) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, names)
    return isinstance(kind, T.MapType) and _holds(kind.valueType, names)


def leak_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, label, n): strings that still leak, by field and first rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), first_leak(F.col(c)).alias("label")) for c in columns]))
    return df.select(pairs.alias("p")).where("p.label is not null").groupBy("p.field", "p.label").agg(F.count("*").alias("n"))


def refuse_leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; a row that leaks fails the job when it is read."""
    out = df
    for c in columns:
        leak = first_leak(F.col(c))
        out = out.withColumn(c, F.when(leak.isNotNull(), F.raise_error(F.concat(F.lit(f"{c} leaks: "), leak)).cast("string")).otherwise(F.col(c)))
    return out


def lane_clock(spans: DataFrame, key: str, now: str) -> DataFrame:
    """Seconds of each lane; open spans end now."""
    end = F.coalesce("finished", F.lit(now).cast("timestamp"))
    return spans.groupBy(key).agg(F.sum((F.unix_micros(end) - F.unix_micros("started")) / 1e6).alias("seconds"), F.max(end).alias("last_end"))


def write_documents(df: DataFrame, path: str, sink: str = "json") -> None:
    """JSON or CSV files; the database sink isn't offered."""
    if sink not in ("json", "csv"):
        raise NotImplementedError(f"sink {sink}")
    if sink == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        csv_row(df).write.mode("overwrite").option("header", True).csv(path)
