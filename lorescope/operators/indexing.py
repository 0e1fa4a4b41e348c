"""From a snapshot's items to stored points, all types in one call."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import identity, render
from ..sources import points, snapshots
from . import shape
from .search import stage_of


def _text(df: DataFrame, path: str) -> Column:
    """A column or a field of one as text; null where df has none."""
    kind = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[part].dataType
    return F.col(path).cast("string")


def items(entities: dict[str, DataFrame], include_deleted: bool = False) -> dict[str, DataFrame]:
    """The items that are indexed, by type: without deleted ones, details' columns as items of their own, and transformations'
    blocks beside them."""
    out = {k: snapshots.active_only(df, include_deleted) if "isDeleted" in df.columns else df for k, df in entities.items() if k != "table_details"}
    if "table_details" in entities:
        columns = shape.explode_columns(entities["table_details"]).drop("position")
        out["columns"] = out["columns"].unionByName(columns, allowMissingColumns=True) if "columns" in out else columns
    if "transformations" in out and "blocks" in out["transformations"].columns:
        blocks = shape.explode_blocks(out["transformations"]).filter("position > 0")
        out["transformation_blocks"] = blocks.select(F.concat_ws("#", "transformation_id", "position").alias("id"), "transformation_id", "block.*")
    return out


def points_of(entities: dict[str, DataFrame], include_deleted: bool = False) -> DataFrame:
    """(id, metadata_type, text, item_id, name, table_id, stage) of all items. A point's id comes from the item's id, else from its name and, of
    columns, its table's, else from its content."""
    parts = []
    for kind, df in items(entities, include_deleted).items():
        rendered = render.render(df, kind)
        own, table = _text(df, "id"), _text(df, "table_id")
        name = F.concat_ws("/", table, _text(df, "name")) if "name" in df.columns and "table_id" in df.columns else _text(df, "name")
        stage = stage_of(_text(df, "stage"), _text(df, "bucket.stage"), F.coalesce(own, table))
        parts.append(rendered.select(identity.point_id(F.lit(kind), own, F.when(_text(df, "name").isNotNull(), name), identity.row_hash(df)).alias("id"), F.lit(kind).alias("metadata_type"), "text", own.alias("item_id"), _text(df, "name").alias("name"), table.alias("table_id"), stage.alias("stage")))
    return reduce(DataFrame.unionByName, parts)


def index(base: str, entities: dict[str, DataFrame], embed: Callable[[DataFrame], DataFrame], dim: int, include_deleted: bool = False) -> tuple[int, DataFrame]:
    """Render, embed and upsert a snapshot's items; gives the collection's version and the rejected points.

    embed gives points with their `vector`. Items that are listed twice are stored once.
    """
    return points.upsert_points(base, embed(points_of(entities, include_deleted)), ["text"], dim)
