"""Catalog shaping: explode, group and join entities."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.render import dependencies
from ..sources.schemas import COLUMN
from .joins import settled, small_or_not, split_join, with_totals


def explode_columns(details: DataFrame) -> DataFrame:
    """One row for each column of table_details(id, bucket_id, columns of JSON text or bare names)."""
    kind = T.StructType.fromDDL(COLUMN)
    item = F.when(F.ltrim("c").startswith("{"), F.from_json("c", kind)).otherwise(F.struct(*[(F.regexp_replace("c", '^"|"$', "") if f.name == "name" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind]))
    rows = details.select(F.col("id").alias("__table"), F.col("bucket_id").alias("__bucket"), F.posexplode("columns").alias("position", "c"))
    rows = rows.select("__table", "__bucket", "position", item.alias("i"))
    return rows.select("position", F.col("i").withField("table_id", F.col("__table")).withField("bucket_id", F.coalesce("__bucket", F.col("i.bucket_id"))).alias("i")).select("position", "i.*")


def tables_by_bucket(tables: DataFrame, bucket: Column, items: list[str]) -> DataFrame:
    """(bucket_id, n_tables, items): the tables of each bucket, in long form, with their number. A bucket that holds a
    third of all tables is no list and no task of its own."""
    rows = tables.select(bucket.alias("bucket_id"), *items)
    counts = settled(rows.groupBy("bucket_id").agg(F.count("*").alias("n"), F.count("*").alias("n_tables")))
    return with_totals(rows, counts, "bucket_id").select("bucket_id", "n_tables", *items)


def tables_of_bucket(tables: DataFrame, bucket: Column, bucket_id: str) -> DataFrame:
    return tables.filter(bucket == bucket_id)


def resolve_linked_tables(details: DataFrame) -> DataFrame:
    """Linked tables (with source_id) get their source's details, by one hop, and columns_of, the id of the table whose columns
    they show: an accessible source, else themselves.

    details(id, name, description, source_id, source_name and, if known, bucket_id, source_project, source_bucket). What is known of a source
    that can't be read, its project and bucket too, stands in a stub. A source of most links is no task's work alone.
    """
    text = F.lit(None).cast("string")
    known = lambda c: F.col(c) if c in details.columns else text
    of = lambda c: F.struct(c.alias("id"))
    source = details.select(F.col("id").alias("source_id"), F.struct("id", "name", "description", known("bucket_id").alias("bucket_id")).alias("__found"))
    linked = details.filter(F.col("source_id").isNotNull())
    totals = settled(linked.groupBy("source_id").agg(F.count("*").alias("n")).join(source, "source_id", "left"))
    found = F.col("__found").isNotNull()
    stub = F.struct(F.col("source_id").alias("id"), text.alias("description"), F.col("source_name").alias("displayName"), of(known("source_project")).alias("project"), of(known("source_bucket")).alias("bucket"), F.lit(False).alias("isAccessible"))
    full = F.struct(F.col("__found.id").alias("id"), F.col("__found.description").alias("description"), F.col("__found.name").alias("displayName"), of(known("source_project")).alias("project"), of(F.col("__found.bucket_id")).alias("bucket"), F.lit(True).alias("isAccessible"))
    out = with_totals(linked, totals, "source_id")
    out = out.withColumns({"isLinked": F.lit(True), "sourceTableDetails": F.when(found, full).otherwise(stub), "columns_of": F.when(found, F.col("source_id")).otherwise(F.col("id"))})
    own = details.filter(F.col("source_id").isNull()).withColumns({"isLinked": F.lit(False), "sourceTableDetails": F.lit(None).cast(out.schema["sourceTableDetails"].dataType), "columns_of": F.col("id")})
    return out.drop("__found").unionByName(own).select(*details.columns, "isLinked", "sourceTableDetails", "columns_of")


def linked_columns(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """columns(table_id, ...) of every table of resolve_linked_tables(), a linked table's taken from its source; table_id is
    the table that shows them. A table with most of the columns, most of the links, or both, is dealt into many tasks."""
    shown = resolved.select(F.col("id").alias("__shown"), F.col("columns_of").alias("table_id"))
    fields = [c for c in columns.columns if c != "table_id"]
    return split_join(columns, shown, "table_id").select(F.col("__shown").alias("table_id"), *fields)


def enrich_configurations(components: DataFrame, configs: DataFrame, rows: DataFrame | None = None, versions: DataFrame | None = None, component_id: str | None = None) -> DataFrame:
    """Configurations of components with an id, each with its component and the numbers of its rows and versions.

    components(id, type), configs(component_id, id, ...), rows and versions(component_id, config_id, ...). Children are counted
    before they meet their configurations; configuration_children() gives them themselves.
    """
    keys = ["component_id", "config_id"]
    known = components.filter(F.col("id").isNotNull()).select(F.col("id").alias("component_id"), F.struct("id", "type").alias("component"))
    out = configs.withColumnRenamed("id", "config_id").join(small_or_not(known), "component_id")
    if component_id is not None:
        out = out.filter(F.col("component_id") == component_id)
    for name, children in (("rows", rows), ("versions", versions)):
        if children is not None:
            out = out.join(children.groupBy(*keys).agg(F.count("*").alias(f"n_{name}")), keys, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return out


def configuration_children(configs: DataFrame, children: DataFrame) -> DataFrame:
    """The rows or versions of the configurations that enrich_configurations() gives, one to a row."""
    keys = ["component_id", "config_id"]
    counts = settled(children.groupBy(*keys).agg(F.count("*").alias("n")).join(configs.select(*keys), keys, "left_semi"))
    key = F.struct(*keys)
    return with_totals(children.withColumn("__key", key), counts.select(key.alias("__key"), "n"), "__key").drop("__key")


def assemble_transformations(listed: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed transformations with a detail, and the ids of those without."""
    return listed.select("id").join(details, "id"), listed.select("id").join(details, "id", "left_anti")


def normal_file(x: Column) -> Column:
    """A bare string stands for a file named by its last part; source and destination are the string."""
    return F.struct(F.substring_index(x, ".", -1).alias("file"), x.alias("source"), x.alias("destination"))


def explode_blocks(transformations: DataFrame) -> DataFrame:
    """Position 0 is the transformation itself, 1 and on its blocks in order."""
    block = transformations.schema["blocks"].dataType.elementType
    whole = transformations.select(F.col("id").alias("transformation_id"), F.lit(0).alias("position"), F.lit(None).cast(block).alias("block"))
    parts = transformations.select(F.col("id").alias("transformation_id"), F.posexplode("blocks").alias("position", "block")).withColumn("position", F.col("position") + 1)
    return whole.unionByName(parts)


def numbered_blocks(transformations: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same from blocks in long form: transformations(id), blocks(transformation_id, position from 1 on, and a block's fields). No list is
    made, and nothing is shuffled."""
    fields = [c for c in blocks.columns if c not in ("transformation_id", "position")]
    parts = blocks.select("transformation_id", "position", F.struct(*fields).alias("block"))
    whole = transformations.select(F.col("id").alias("transformation_id"), F.lit(0).alias("position"), F.lit(None).cast(parts.schema["block"].dataType).alias("block"))
    return whole.unionByName(parts)


def transformation_dependencies(transformations: DataFrame) -> DataFrame:
    """Edges (transformation_id, direction, table_id)."""
    requires, produces = dependencies(F.struct(*transformations.columns))
    lists = F.array(*[F.struct(F.lit(name).alias("direction"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids")) for name, ids in (("requires", requires), ("produces", produces))])
    edges = transformations.select(F.col("id").alias("transformation_id"), F.explode(lists).alias("d"))
    return edges.select("transformation_id", F.col("d.direction").alias("direction"), F.explode("d.ids").alias("table_id"))


def block_dependencies(transformations: DataFrame, blocks: DataFrame, table_id: str | None = None) -> DataFrame:
    """The same edges, from blocks in long form: transformations(id, dependencies), blocks(transformation_id, inputs, outputs).

    What a transformation declares counts instead of what its blocks name. With a table_id only its edges, and the
    blocks are filtered before anything else is done with them.
    """
    declared = transformations.filter(F.col("dependencies.requires").isNotNull() | F.col("dependencies.produces").isNotNull())
    files = F.array(*[F.struct(F.lit(name).alias("direction"), ids.alias("ids")) for name, ids in (("requires", F.col("inputs.source")), ("produces", F.col("outputs.destination")))])
    told = F.array(*[F.struct(F.lit(name).alias("direction"), F.col(f"dependencies.{name}").alias("ids")) for name in ("requires", "produces")])

    def edges(df: DataFrame, id_: str, lists: Column) -> DataFrame:
        found = df.select(F.col(id_).alias("transformation_id"), F.explode(lists).alias("d"))
        found = found.select("transformation_id", F.col("d.direction").alias("direction"), F.explode("d.ids").alias("table_id")).filter(F.coalesce(F.col("table_id"), F.lit("")) != "")
        return found if table_id is None else found.filter(F.col("table_id") == table_id)

    named = edges(blocks, "transformation_id", files).join(declared.select(F.col("id").alias("transformation_id")), "transformation_id", "left_anti")
    return named.unionByName(edges(declared, "id", told)).distinct()


def transformations_of_table(edges: DataFrame, transformations: DataFrame, table_id: str, direction: str | None = None) -> DataFrame:
    """The transformations that read or write a table."""
    found = edges.filter(F.col("table_id") == table_id)
    if direction:
        found = found.filter(F.col("direction") == direction)
    ids = found.select(F.col("transformation_id").alias("id")).distinct()
    return transformations.join(ids, "id", "left_semi")


KNOWN_TYPES = ("buckets", "tables", "columns", "configurations", "transformations")


def items_union(entities: dict[str, DataFrame]) -> DataFrame:
    """All items of known types as (metadata_type, ...); other types are left out."""
    parts = [df.withColumn("metadata_type", F.lit(kind)) for kind, df in entities.items() if kind in KNOWN_TYPES]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
