"""Identifiers and content hashes."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed value: the namespace of point ids.
NAMESPACE = "ef2da47c-f559-5809-904b-79a5d848d4b7"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 over namespace and name, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def point_id(metadata_type: Column, id_: Column, name: Column, content: Column) -> Column:
    """By id, else by name, else by content hash."""
    return uuid5(F.concat(metadata_type, F.lit("_"), F.coalesce(id_.cast("string"), name, content)))


def content_hash(raw: Column) -> Column:
    """SHA-256 of a JSON text, whatever the order of its keys and the notation of its numbers."""
    return F.sha2(F.to_json(F.parse_json(raw)), 256)


def _plain(kind: T.DataType) -> bool:
    """Whether to_json() writes values of a type in one way only."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    return not isinstance(kind, (T.MapType, T.TimestampType))


def canonical(value: Column, kind: T.DataType) -> Column:
    """A typed value as to_json() shall see it: map entries without a value are absent, as fields without one are, and
    timestamps are microseconds, whatever the session's time zone."""
    if _plain(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda _, v: v.isNotNull()), lambda _, v: canonical(v, kind.valueType))
    return F.unix_micros(value)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The content hash of df's rows (of some columns, if they are named): that of the same item's JSON text without nulls.

    Neither the order of columns and fields nor that of map entries matters, at any depth; a null is absent, in an array it stays.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    return content_hash(F.to_json(F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])))


def with_row_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with content_hash, of all its other columns or of those named."""
    rest = df.drop("content_hash")
    return rest.withColumn("content_hash", row_hash(rest, columns))
