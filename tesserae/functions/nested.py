"""Nested values: leaves under one name each, and fields dropped at any depth."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _leaves(kind: T.StructType, at: Column | None, prefix: str, sep: str) -> Iterator[Column]:
    for f in kind.fields:
        own = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, own, f"{prefix}{f.name}{sep}", sep)
        else:
            yield own.alias(f"{prefix}{f.name}")


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Structs as columns, one for each leaf, named by its path."""
    return df.select(*_leaves(df.schema, None, "", sep))


def _without(value: Column, kind: T.DataType, names: frozenset[str]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        if not kept:
            return F.lit(None).cast("struct<_:string>")
        inner = F.struct(*[_without(value.getField(f.name), f.dataType, names).alias(f.name) for f in kept])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _without(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda k, _: ~k.isin(*names)) if isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(kept, lambda _, v: _without(v, kind.valueType, names))
    return value


def without(df: DataFrame, column: str, *names: str) -> Column:
    """A column of structs, arrays or maps without fields and keys of these names, at any depth."""
    return _without(F.col(f"`{column}`"), df.schema[column].dataType, frozenset(names)).alias(column)


def json_without(text: Column, schema: str, *names: str) -> Column:
    """JSON text without keys of these names at any depth; schema: the text's type as DDL."""
    kind = T._parse_datatype_string(schema)
    return F.to_json(_without(F.from_json(text, schema), kind, frozenset(names)))


def table_text(df: DataFrame, rows: int = 20, digits: int = 3) -> str:
    """The first rows as a table of text, for small reports: numbers with so many digits, columns aligned."""
    held = df.limit(rows).collect()
    shown = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in held]
    width = [max(map(len, c)) for c in zip(df.columns, *shown, strict=True)]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(df.columns), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, shown)])
