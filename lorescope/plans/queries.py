"""One query for each operator, bound to the driver's tables, with SQL that gives the same rows."""

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import identity, render, vectors
from ..operators import cells, changes, embed, indexing, profile, search, shape, sketches
from ..operators.joins import settled
from ..sources import manifest, points, snapshots
from .bindings import sql, view

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sources and sinks


def _exported(spark: SparkSession, sf_dir: str, run: str | None = None) -> str:
    """Customers written as JSON lines of buckets; every 50th line is cut short. Of the runs "old" and "new" each lacks some, and
    the new one has its keys in another order and some other types."""
    kind = F.when(F.lit(run == "new") & (F.col("c_custkey") % 7 == 0), "CHANGED").otherwise(F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % (17 if run == "old" else 13) != 0 if run else F.lit(True))
    c = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), kind.alias("type"), F.array("c_mktsegment", "c_name").alias("tags"), (F.col("c_custkey") % 11 == 0).alias("isDeleted"))
    line = F.to_json(F.struct(*(("tags", "isDeleted", "type", "name", "id") if run == "new" else ("id", "name", "type", "tags", "isDeleted"))))
    path = snapshots.new_path(spark, "export")
    c.select(F.when(F.col("id").cast("long") % 50 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    return path


@query("o01_read_entities", "select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as type, c_custkey % 11 = 0 as is_deleted from customer where c_custkey % 50 <> 0")
def o01(spark, sf_dir):
    good, _ = snapshots.read_entities(spark, _exported(spark, sf_dir), "buckets")
    return good.select("id", "name", "type", F.col("isDeleted").alias("is_deleted"))


@query("o02_rejected_items", "select 'buckets' as entity, count(*) as n from customer where c_custkey % 50 = 0")
def o02(spark, sf_dir):
    _, bad = snapshots.read_entities(spark, _exported(spark, sf_dir), "buckets")
    return bad.groupBy("entity").agg(F.count("*").alias("n"))


@query("o02_parents_kept", "with f as (select o_custkey, o_orderkey from orders where o_orderstatus = 'F'), n as (select o_custkey, count(*) as n from f group by 1) select c_custkey as id, o_orderkey, coalesce(n, 0) as n from (select c_custkey from customer) c left join f on f.o_custkey = c_custkey left join n on n.o_custkey = c_custkey")
def o02b(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return snapshots.with_children(parents, rows, "id").withColumnRenamed("n_children", "n")


@query("o03_active_only", "select id, name from tables where not is_deleted")
def o03(spark, sf_dir):
    return snapshots.active_only(view(spark, sf_dir, "tables"), flag="is_deleted").select("id", "name")


_UPSERT = """
with ranked as (select *, row_number() over (partition by id order by ts desc, seq desc) as r from changes)
select id, seq, event_type, value from ranked where r = 1"""


@query("o04_upsert", _UPSERT)
def o04(spark, sf_dir):
    feed = view(spark, sf_dir, "changes")
    cut = F.lit(feed.agg(F.percentile_approx("ts", 0.5)).first()[0])
    first = points.upsert(feed.limit(0), feed.filter(F.col("ts") <= cut), "id", ["ts", "seq"])
    return points.upsert(first, feed.filter(F.col("ts") > cut), "id", ["ts", "seq"]).select("id", "seq", "event_type", "value")


@query("o04_upsert_points", "select cast(id as varchar) as id, case when metadata_type = 'columns' and id % 4 = 0 then 'tables' else metadata_type end as metadata_type, case when metadata_type = 'columns' and id % 2 = 0 then 'new' else 'old' end as text, round(list_sum(vector), 4) as total from points")
def o04b(spark, sf_dir):
    """Two upserts: all points, then half of the columns' points, some of them as tables now; only those are written."""
    first = view(spark, sf_dir, "points").withColumns({"id": F.col("id").cast("string"), "text": F.lit("old"), "seq": F.lit(0)})
    new = first.filter("metadata_type = 'columns' and cast(id as bigint) % 2 = 0").withColumns({"text": F.lit("new"), "seq": F.lit(1)})
    new = new.withColumn("metadata_type", F.when(F.col("id").cast("long") % 4 == 0, "tables").otherwise(F.col("metadata_type")))
    base = snapshots.new_path(spark, "points")
    for part in (first, new):
        points.upsert_points(base, part, ["seq"], 64)
    return points.load_points(spark, base).select("id", "metadata_type", "text", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("o04_delete_removed", "select cast(o.entity_id as varchar) as id, o.content as text from snap_old o join snap_new n on o.entity_id = n.entity_id")
def o04c(spark, sf_dir):
    """Points of the last snapshot, without those of items that the new one has no more."""
    old, new = _hashed(spark, sf_dir, "snap_old"), _hashed(spark, sf_dir, "snap_new")
    base = snapshots.new_path(spark, "points")
    first = old.select(F.col("entity_id").cast("string").alias("id"), F.lit("tables").alias("metadata_type"), F.col("content").alias("text"), F.array(F.lit(1.0), F.col("entity_id").cast("double")).alias("vector"))
    points.upsert_points(base, first, ["text"], 2)
    points.delete_points(base, changes.snapshot_diff(old, new, ["entity_id"]).filter(F.col("status") == changes.REMOVED).select(F.col("entity_id").alias("id")))
    return points.load_points(spark, base).select("id", "text")


@query("o05_dimension_check", "select cast(id as varchar) as id, id % 10 <> 0 as stored, case when id % 10 = 0 then 'dimension 63, not 64' end as reason from points")
def o05(spark, sf_dir):
    """The collection is made with its dimension, and points of another are told apart when they are written."""
    given = view(spark, sf_dir, "points").withColumns({"vector": F.when(F.col("id") % 10 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector")), "id": F.col("id").cast("string")})
    base = snapshots.new_path(spark, "points")
    points.ensure_collection(spark, base, 64)
    _, bad = points.upsert_points(base, given, ["id"], 64)
    good = points.load_points(spark, base).select("id", F.lit(True).alias("stored"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select("id", F.lit(False).alias("stored"), "reason"))


@query("o06_scan_points", "select id, metadata_type, table_id from points where metadata_type = 'columns' and table_id = '3' order by id limit 20")
def o06(spark, sf_dir):
    return points.scan_points(view(spark, sf_dir, "points"), {"metadata_type": "columns", "table_id": "3"}, 20).select("id", "metadata_type", "table_id")


@query("o07_state", "select 'customer' as entity_type, cast(entity_id as varchar) as entity_id, sha256(content) as content_hash from snap_new")
def o07(spark, sf_dir):
    base = snapshots.new_path(spark, "state")
    for name in ("snap_old", "snap_new"):
        snapshots.save_state(_hashed(spark, sf_dir, name).select(F.lit("customer").alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), "content_hash"), base)
    return snapshots.load_state(spark, base)


@query("o08_snapshot_summary", "select 'buckets' as entity, count(*) as n from buckets union all select 'tables', count(*) from tables union all select 'columns', count(*) from columns union all select 'transformations', count(*) from transformations")
def o08(spark, sf_dir):
    return snapshots.snapshot_summary({n: view(spark, sf_dir, n) for n in ("buckets", "tables", "columns", "transformations")})


# ---- shaping


@query("o09_explode_columns", "select concat('t', cast(p_partkey % 25 as varchar)) as table_id, concat('b', cast(p_partkey % 5 as varchar)) as bucket_id, p_name as name, case when p_partkey % 4 <> 0 then p_type end as type, count(*) as n from part group by 1, 2, 3, 4")
def o09(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    item = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"))))
    details = p.select(F.concat(F.lit("t"), (F.col("p_partkey") % 25).cast("string")).alias("id"), F.concat(F.lit("b"), (F.col("p_partkey") % 5).cast("string")).alias("bucket_id"), F.array(item).alias("columns"))
    return shape.explode_columns(details).groupBy("table_id", "bucket_id", "name", "type").agg(F.count("*").alias("n"))


@query("o10_tables_by_bucket", "select bucket_id, count(*) over (partition by bucket_id) as n_tables, id, name from tables")
def o10(spark, sf_dir):
    return shape.tables_by_bucket(view(spark, sf_dir, "tables"), F.col("bucket_id"), ["id", "name"])


@query("o11_tables_of_bucket", "select id, name from tables where bucket_id = 'in.c-0'")
def o11(spark, sf_dir):
    return shape.tables_of_bucket(view(spark, sf_dir, "tables"), F.col("bucket_id"), "in.c-0").select("id", "name")


@query(
    "o12_resolve_linked_tables",
    """
with resolved as (select a.name as id, a.source_name is not null as is_linked, case when a.source_name is not null then b.name is not null end as accessible, coalesce(b.name, a.name) as columns_of,
    case when a.source_name is not null then coalesce(b.bucket_id, 'away') end as source_bucket, case when a.source_name is not null then 'project ' || a.c_custkey % 3 end as source_project
  from tables a left join tables b on a.source_name = b.name)
select id, is_linked, accessible, source_bucket, source_project, c.name as column_name from resolved left join columns c on c.table_name = columns_of""",
)
def o12(spark, sf_dir):
    t, linked = view(spark, sf_dir, "tables"), F.col("source_name").isNotNull()
    details = t.select(
        F.col("name").alias("id"), "name", F.lit(None).cast("string").alias("description"), "bucket_id", F.col("source_name").alias("source_id"), "source_name",
        F.when(linked, F.lit("away")).alias("source_bucket"), F.when(linked, F.concat(F.lit("project "), (F.col("c_custkey") % 3).cast("string"))).alias("source_project"),
    )
    tables = shape.resolve_linked_tables(details)
    columns = shape.linked_columns(tables, view(spark, sf_dir, "columns").select(F.col("table_name").alias("table_id"), F.col("name").alias("column_name")))
    source = F.col("sourceTableDetails")
    out = tables.select("id", F.col("isLinked").alias("is_linked"), source["isAccessible"].alias("accessible"), source["bucket"]["id"].alias("source_bucket"), source["project"]["id"].alias("source_project"))
    return out.join(columns.withColumnRenamed("table_id", "id"), "id", "left")


def _configurations(spark, sf_dir):
    """Market segments as components, customers as configurations, orders as their rows, priorities as versions."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    configs = c.select(F.col("c_mktsegment").alias("component_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    components = c.select(F.col("c_mktsegment").alias("id")).distinct().withColumn("type", F.lit("segment"))
    mine = o.join(configs.select("component_id", F.col("id").alias("o_custkey")), "o_custkey").select("component_id", F.col("o_custkey").alias("config_id"), "o_orderkey", "o_orderpriority")
    return components, configs, mine.drop("o_orderpriority"), mine.drop("o_orderkey").distinct()


@query(
    "o13_enrich_configurations",
    """
select c_mktsegment as component_id, c_custkey as config_id, c_name as name, c_mktsegment as component, coalesce(n, 0) as n_rows, coalesce(v, 0) as n_versions
from customer left join (select o_custkey, count(*) as n, count(distinct o_orderpriority) as v from orders group by 1) o on o_custkey = c_custkey""",
)
def o13(spark, sf_dir):
    out = shape.enrich_configurations(*_configurations(spark, sf_dir))
    return out.select("component_id", "config_id", "name", F.col("component.id").alias("component"), "n_rows", "n_versions")


@query("o13_configuration_rows", "select c_mktsegment as component_id, c_custkey as config_id, o_orderkey from (select c_custkey, c_mktsegment from customer) c join orders on o_custkey = c_custkey where c_mktsegment = (select min(c_mktsegment) from customer)")
def o13b(spark, sf_dir):
    components, configs, rows, _ = _configurations(spark, sf_dir)
    first = components.agg(F.min("id")).first()[0]
    return shape.configuration_children(shape.enrich_configurations(components, configs, component_id=first), rows)


@query("o14_assemble_transformations", "select id, cast(count(*) as int) as n_blocks from transformations join blocks on id = transformation_id group by 1")
def o14(spark, sf_dir):
    details = view(spark, sf_dir, "blocks").groupBy(F.col("transformation_id").alias("id")).agg(F.count("*").cast("int").alias("n_blocks"))
    return shape.assemble_transformations(view(spark, sf_dir, "transformations"), details)[0].select("id", "n_blocks")


@query("o14_rejected_transformations", "select id from transformations where id not in (select transformation_id from blocks)")
def o14b(spark, sf_dir):
    details = view(spark, sf_dir, "blocks").select(F.col("transformation_id").alias("id")).distinct()
    return shape.assemble_transformations(view(spark, sf_dir, "transformations"), details)[1]


def _transformations(spark, sf_dir) -> DataFrame:
    """Orders as transformations with their lines as blocks; every seventh order declares what it requires."""
    file = "array<struct<file: string, source: string, destination: string>>"
    b = view(spark, sf_dir, "blocks")
    block = F.struct("block_no", F.concat(F.lit("block "), F.col("block_no").cast("string")).alias("name"), F.lit(None).cast("string").alias("code"), F.array(shape.normal_file(F.col("input_source"))).cast(file).alias("inputs"), F.array(shape.normal_file(F.col("output_destination"))).cast(file).alias("outputs"))
    held = b.groupBy("transformation_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    t = view(spark, sf_dir, "transformations").join(held, F.col("id") == F.col("transformation_id"), "left")
    declared = F.when(F.col("id") % 7 == 0, F.struct(F.array(F.lit("declared.table")).alias("requires"), F.lit(None).cast("array<string>").alias("produces")))
    blocks = F.transform("blocks", lambda x: F.struct(x["name"].alias("name"), x["code"].alias("code"), x["inputs"].alias("inputs"), x["outputs"].alias("outputs")))
    none = F.lit(None).cast("string")
    return t.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("order "), F.col("id").cast("string")).alias("name"), "type", "description", blocks.alias("blocks"), declared.alias("dependencies"), F.lit(None).cast("struct<type: string, memory: string>").alias("runtime"), F.when(F.col("id") % 3 == 0, F.lit("4g")).otherwise(none).alias("memory"))


def _numbered_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same transformations, and their blocks one to a row, with their numbers."""
    file = "array<struct<file: string, source: string, destination: string>>"
    b = view(spark, sf_dir, "blocks")
    block = [F.concat(F.lit("block "), F.col("block_no").cast("string")).alias("name"), F.lit(None).cast("string").alias("code"), F.array(shape.normal_file(F.col("input_source"))).cast(file).alias("inputs"), F.array(shape.normal_file(F.col("output_destination"))).cast(file).alias("outputs")]
    return view(spark, sf_dir, "transformations").select(F.col("id").cast("string").alias("id")), b.select(F.col("transformation_id").cast("string").alias("transformation_id"), F.col("block_no").cast("int").alias("position"), *block)


@query(
    "o15_explode_blocks",
    """
select cast(id as varchar) as transformation_id, cast(0 as int) as position, cast(null as varchar) as file, cast(null as varchar) as source from transformations
union all select cast(transformation_id as varchar), cast(block_no as int), split_part(input_source, '.', 2), input_source from blocks""",
)
def o15(spark, sf_dir):
    t, blocks = _numbered_blocks(spark, sf_dir)
    out = shape.numbered_blocks(t, blocks)
    return out.select("transformation_id", "position", F.get("block.inputs", F.lit(0))["file"].alias("file"), F.get("block.inputs", F.lit(0))["source"].alias("source"))


@query(
    "o15_explode_lists_of_blocks",
    """
select cast(id as varchar) as transformation_id, cast(0 as int) as position, cast(null as varchar) as source from transformations
union all select cast(transformation_id as varchar), cast(block_no as int), input_source from blocks""",
)
def o15b(spark, sf_dir):
    out = shape.explode_blocks(_transformations(spark, sf_dir))
    return out.select("transformation_id", "position", F.get("block.inputs", F.lit(0))["source"].alias("source"))


_EDGES = """
with edges as (
  select distinct cast(transformation_id as varchar) as transformation_id, 'requires' as direction, input_source as table_id from blocks where transformation_id % 7 <> 0
  union all select distinct cast(transformation_id as varchar), 'produces', output_destination from blocks where transformation_id % 7 <> 0
  union all select cast(id as varchar), 'requires', 'declared.table' from transformations where id % 7 = 0)
"""


def _blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same transformations without their blocks, and the blocks in long form."""
    declared = F.when(F.col("id") % 7 == 0, F.struct(F.array(F.lit("declared.table")).alias("requires"), F.lit(None).cast("array<string>").alias("produces")))
    t = view(spark, sf_dir, "transformations").select(F.col("id").cast("string").alias("id"), "type", declared.alias("dependencies"))
    li = table(spark, sf_dir, "lineitem")
    files = [F.array(shape.normal_file(F.concat(F.lit(head), F.col(key).cast("string")))).alias(name) for head, key, name in (("part.", "l_partkey", "inputs"), ("supp.", "l_suppkey", "outputs"))]
    return t, li.select(F.col("l_orderkey").cast("string").alias("transformation_id"), *files)


@query("o16_dependencies", _EDGES + "select * from edges")
def o16(spark, sf_dir):
    return shape.block_dependencies(*_blocks(spark, sf_dir))


@query("o16_dependencies_of_lists", _EDGES + "select * from edges")
def o16b(spark, sf_dir):
    return shape.transformation_dependencies(_transformations(spark, sf_dir))


@query("o17_items_union", "select 'buckets' as metadata_type, id, name from buckets union all select 'tables', id, name from tables union all select 'columns', cast(column_key as varchar), name from columns")
def o17(spark, sf_dir):
    parts = {"buckets": view(spark, sf_dir, "buckets"), "tables": view(spark, sf_dir, "tables"), "columns": view(spark, sf_dir, "columns").withColumn("id", F.col("column_key").cast("string")), "other": view(spark, sf_dir, "buckets")}
    return shape.items_union(parts).select("metadata_type", "id", "name")


@query("o18_transformations_of_table", _EDGES + "select id, type from (select cast(id as varchar) as id, type from transformations) t where id in (select transformation_id from edges where table_id = 'part.7')")
def o18(spark, sf_dir):
    t, blocks = _blocks(spark, sf_dir)
    return shape.transformations_of_table(shape.block_dependencies(t, blocks, "part.7"), t, "part.7").select("id", "type")


# ---- rendering


@query("o19_render_default", "select doc_id, concat_ws(' | ', 'Name: ' || source, 'Description: ' || lang, case when doc_id % 3 = 0 then 'Type: text' end, case when doc_id % 2 = 0 then 'Tags: ' || lang || ', ' || source end) as text from documents")
def o19(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.col("lang").alias("description"), F.when(F.col("doc_id") % 3 == 0, F.lit("text")).alias("type"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("tags"))
    return render.render(d, "buckets").select("doc_id", "text")


@query(
    "o20_render_table",
    """
select a.id, concat_ws(' | ', 'Name: ' || a.name, case when a.source_name is not null then 'Type: Linked Table' end,
  'Source Table: ' || a.source_name, case when a.source_name is not null then 'Source Project: unknown' end,
  case when a.source_name is not null and b.name is null then 'Source Table Status: Inaccessible' end,
  case when a.source_name is not null and b.name is null then 'Source Display Name: ' || a.source_name end,
  'Rows: ' || cast(a.c_custkey * 10 as varchar), 'Bucket: ' || a.bucket_id) as text
from tables a left join tables b on a.source_name = b.name""",
)
def o20(spark, sf_dir):
    t = view(spark, sf_dir, "tables")
    details = t.select("id", "name", "bucket_id", "c_custkey", F.lit(None).cast("string").alias("description"), F.col("source_name").alias("source_id"), "source_name")
    by_name = shape.resolve_linked_tables(details.withColumns({"key": F.col("id"), "id": F.col("name")}))
    none = F.lit(None).cast("string")
    row = by_name.select(
        F.col("key").alias("id"), "name", "description", "isLinked", F.when(F.col("source_id").isNotNull(), F.struct(F.col("source_id").alias("id"), F.struct(none.alias("id")).alias("project"))).alias("sourceTable"), "sourceTableDetails",
        (F.col("c_custkey") * 10).cast("long").alias("rowsCount"), F.lit(None).cast("long").alias("dataSizeBytes"), F.struct(F.col("bucket_id").alias("id")).alias("bucket"), F.lit(None).cast("array<string>").alias("primaryKey"), none.alias("created"), none.alias("lastImportDate"), none.alias("lastChangeDate"),
    )
    return render.render(row, "tables").select("id", "text")


_GOOD = f"regexp_matches(email, '{profile.EMAIL}')"
_RULES = {"email": profile.Rule(pattern=profile.EMAIL, standard="RFC 5322"), "acctbal": profile.Rule(cast="double", low=0, high=5000)}


@query(
    "o21_render_column",
    f"""
with e as (select count(*) as n, count(email) as filled, count(case when {_GOOD} then 1 end) as good, min(email) as lo, max(email) as hi, count(distinct email) as u from emails),
best as (select string_agg(email, ',' order by n desc, email) as top from (select email, count(*) as n from emails where email is not null group by 1 order by 2 desc, 1 limit 3))
select 'email' as name, 'Name: email | Type: string | Statistics: min=' || lo || ', max=' || hi || ', unique=' || u || ', most_common=' || top || ' | Quality: '
  || cast(trunc(filled * 100.0 / n) as int) || '% complete, ' || cast(trunc(good * 100.0 / filled) as int) || '% valid, Standard: RFC 5322, Issues: invalid_format, missing_values' as text
from e, best""",
)
def o21(spark, sf_dir):
    out = profile.profile_table(view(spark, sf_dir, "emails"), {"email": _RULES["email"]})
    return render.render(out, "columns").select("name", "text")


@query("o22_render_quality", "select p_partkey, 'Quality: ' || cast(trunc(p_size / 64.0 * 100) as int) || '% complete, Valid range: 1-' || p_size || case when p_size > 25 then ', Issues: out_of_range' else '' end as text from part")
def o22(spark, sf_dir):
    none = F.lit(None)
    q = F.struct((F.col("p_size") / 64.0).alias("completeness"), none.cast("double").alias("validity"), F.struct(F.lit(1).alias("min_valid"), F.col("p_size").alias("max_valid")).alias("range_check"), F.struct(none.cast("string").alias("standard")).alias("standardization"), F.when(F.col("p_size") > 25, F.array(F.lit("out_of_range"))).otherwise(F.array().cast("array<string>")).alias("common_issues"))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q")).select("p_partkey", render.render_quality(F.col("q")).alias("text"))


@query(
    "o23_render_transformation",
    _EDGES.rstrip()
    + """, lists as (
  select transformation_id, string_agg(table_id, ', ' order by table_id) filter (direction = 'requires') as req, string_agg(table_id, ', ' order by table_id) filter (direction = 'produces') as prod from edges group by 1)
select cast(id as varchar) as id, 'Name: order ' || id || ' | Type: ' || type || ' | Description: ' || description || ' | Dependencies: '
  || concat_ws('; ', 'Requires ' || req, 'Produces ' || prod) || ' | Runtime: ' || case when id % 3 = 0 then 'docker, 4g memory' else '' end as text
from transformations left join lists on transformation_id = cast(id as varchar)""",
)
def o23(spark, sf_dir):
    return render.render(_transformations(spark, sf_dir), "transformations").select("id", "text")


@query("o24_render_block", "select cast(transformation_id as varchar) as transformation_id, cast(block_no as int) as position, 'Block: block ' || block_no || ' | Inputs: ' || split_part(input_source, '.', 2) || ' from ' || input_source || ' | Outputs: ' || split_part(output_destination, '.', 2) || ' to ' || output_destination as text from blocks")
def o24(spark, sf_dir):
    blocks = shape.numbered_blocks(*_numbered_blocks(spark, sf_dir)).filter("position > 0")
    return blocks.select("transformation_id", "position", render.render_block(F.col("block")).alias("text"))


@query(
    "o25_code_operations",
    """
select transformation_id, block_no, name || ' step ' || block_no as description, concat_ws(', ', case when contains(lower(code), 'read_csv') then 'read_csv' end, case when contains(lower(code), 'merge') then 'merge' end,
  case when contains(lower(code), 'groupby') then 'groupby' end, case when contains(lower(code), 'agg') then 'aggregate' end, case when contains(lower(code), 'aggregate') then 'aggregate' end, case when contains(lower(code), 'to_csv') then 'to_csv' end) as operations
from code_blocks""",
)
def o25(spark, sf_dir):
    return view(spark, sf_dir, "code_blocks").select("transformation_id", "block_no", render.code_description(F.col("code")).alias("description"), F.array_join(render.code_operations(F.col("code")), ", ").alias("operations"))


@query("o26_code_preview", "select transformation_id, block_no, array_to_string(string_split(regexp_replace(code, '^\\s+|\\s+$', '', 'g'), chr(10))[1:3], chr(10)) as preview from code_blocks")
def o26(spark, sf_dir):
    return view(spark, sf_dir, "code_blocks").select("transformation_id", "block_no", render.code_preview(F.col("code")).alias("preview"))


@query("o27_render_by_type", "select 'buckets' as metadata_type, id, 'Name: ' || name as text from buckets union all select 'columns', cast(column_key as varchar), 'Name: ' || name || ' | Type: ' || type || ' | Description: ' || description from columns")
def o27(spark, sf_dir):
    from ..sources.schemas import COLUMN

    kinds = {f.name: f.dataType for f in spark.createDataFrame([], COLUMN).schema}
    c = view(spark, sf_dir, "columns")
    c = c.select(F.col("column_key").cast("string").alias("id"), *[(F.col(n) if n in ("name", "type", "description") else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()])
    a = render.render(view(spark, sf_dir, "buckets").select("id", "name"), "buckets").select(F.lit("buckets").alias("metadata_type"), "id", "text")
    return a.unionByName(render.render(c, "columns").select(F.lit("columns").alias("metadata_type"), "id", "text"))


# ---- identity and change


@query(
    "o28_point_id",
    """
with h as (select c_custkey, sha1(unhex('ef2da47cf5595809904b79a5d848d4b7') || encode('buckets_' || c_name)) as d from customer)
select c_custkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (('0x' || substr(d, 17, 1))::int % 4 + 1)::int, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) as point_id from h""",
)
def o28(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", identity.point_id(F.lit("buckets"), F.lit(None).cast("string"), F.col("c_name"), F.lit("")).alias("point_id"))


@query("o29_content_hash", """select c_custkey, sha256('{"a":"' || c_name || '","b":' || c_custkey || '}') as content_hash from customer""")
def o29(spark, sf_dir):
    raw = F.concat(F.lit('{"b": '), F.col("c_custkey").cast("string"), F.lit(', "a": "'), F.col("c_name"), F.lit('"}'))
    return table(spark, sf_dir, "customer").select("c_custkey", identity.content_hash(raw).alias("content_hash"))


def _nested(spark, sf_dir) -> DataFrame:
    """Lines with a struct, an array of structs and a map in them, whose parts are in no order and partly null."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    entries = [F.lit("ship"), F.col("l_linestatus"), F.lit("flag"), flag, F.lit("line"), F.col("l_linenumber").cast("string")]
    part = F.struct(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("even"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.create_map(*entries).alias("marks"), F.array(part, F.lit(None).cast("struct<supplier: bigint, part: bigint, even: string>")).alias("parts"), F.struct(flag.alias("flag"), F.col("l_linenumber").cast("double").alias("at")).alias("inner"))


@query(
    "o29_row_hash",
    """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256('{"inner":{"at":' || l_linenumber || case when l_returnflag <> 'N' then ',"flag":"' || l_returnflag || '"' else '' end || '},"marks":{'
  || case when l_returnflag <> 'N' then '"flag":"' || l_returnflag || '",' else '' end || '"line":"' || l_linenumber || '","ship":"' || l_linestatus || '"},"parts":[{'
  || case when l_partkey % 2 = 0 then '"even":"' || l_returnflag || '",' else '' end || '"part":' || l_partkey || ',"supplier":' || l_suppkey || '},null]}') as content_hash from lineitem""",
)
def o29b(spark, sf_dir):
    rows = _nested(spark, sf_dir)
    return identity.with_row_hash(rows, ["marks", "parts", "inner"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "content_hash")


def _hashed(spark, sf_dir, name):
    return view(spark, sf_dir, name).select("entity_id", F.sha2("content", 256).alias("content_hash"), "content")


def _typed(df):
    return df.select(F.lit("customer").alias("entity_type"), "entity_id", "content_hash")


@query("o30_has_changed", "select n.entity_id, o.entity_id is null or o.content <> n.content as changed from snap_new n left join snap_old o using (entity_id)")
def o30(spark, sf_dir):
    return changes.has_changed(_typed(_hashed(spark, sf_dir, "snap_new")), _typed(_hashed(spark, sf_dir, "snap_old"))).select("entity_id", "changed")


_DIFF = """
with diff as (
  select coalesce(o.entity_id, n.entity_id) as entity_id, n.content, o.content as before, case when o.entity_id is null then 'new' when n.entity_id is null then 'removed' when o.content = n.content then 'unchanged' else 'changed' end as status
  from snap_old o full join snap_new n on o.entity_id = n.entity_id) """


@query("o31_snapshot_diff", _DIFF + "select entity_id, status from diff")
def o31(spark, sf_dir):
    return changes.snapshot_diff(_hashed(spark, sf_dir, "snap_old"), _hashed(spark, sf_dir, "snap_new"), ["entity_id"])


@query(
    "o31_typed_diff",
    """
with o as (select c_custkey as id from customer where c_custkey % 17 <> 0 and c_custkey % 50 <> 0), n as (select c_custkey as id from customer where c_custkey % 13 <> 0 and c_custkey % 50 <> 0)
select cast(coalesce(o.id, n.id) as varchar) as id, case when o.id is null then 'new' when n.id is null then 'removed' when n.id % 7 = 0 then 'changed' else 'unchanged' end as status from o full join n on o.id = n.id""",
)
def o31b(spark, sf_dir):
    """Two exports with their keys in another order, read as typed rows, hashed and compared."""
    old, new = (snapshots.read_entities(spark, _exported(spark, sf_dir, run), "buckets")[0] for run in ("old", "new"))
    return changes.snapshot_diff(identity.with_row_hash(old), identity.with_row_hash(new), ["id"])


@query("o32_incremental", _DIFF + "select entity_id, case when status = 'unchanged' then 'old' else 'fresh' end as taken, content from diff where status <> 'removed'")
def o32(spark, sf_dir):
    old, new = _hashed(spark, sf_dir, "snap_old"), _hashed(spark, sf_dir, "snap_new")
    found, _ = changes.incremental(old.withColumn("taken", F.lit("old")), new, new.withColumn("taken", F.lit("fresh")), "entity_id", old.select("entity_id", "content_hash"))
    return found.select("entity_id", "taken", "content")


def _levels(spark, sf_dir):
    """Three levels in the last run and in this: segments and nations as buckets, customers as tables, orders as details. A
    bucket's hash follows the sum of its balances, in which every 50th customer's has changed since."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    bucket = F.concat_ws(".", "c_mktsegment", F.col("c_nationkey").cast("string"))
    runs = []
    for now in (False, True):
        balance = F.col("c_acctbal") + F.when(F.col("c_custkey") % 50 == 0, 1 if now else 0).otherwise(0)
        tables = c.select(bucket.alias("bucket"), F.col("c_custkey").alias("table_id"), F.round(balance, 2).cast("decimal(20,2)").cast("string").alias("content")).filter(F.lit(now) | (F.col("table_id") % 13 != 0))
        buckets = tables.groupBy("bucket").agg(F.sum(F.col("content").cast("decimal(20,2)")).cast("string").alias("content"))
        details = o.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("detail_id"), F.concat_ws("/", "o_orderstatus", F.when(F.lit(now) & (F.col("o_orderkey") % 3 == 0), "again")).alias("content"))
        runs.append([(df, df.withColumn("content_hash", F.sha2("content", 256)).drop("content"), df.withColumn("run", F.lit("fresh" if now else "last"))) for df in (buckets, tables, details.join(tables.select("table_id"), "table_id", "left_semi"))])
    names = (("buckets", "bucket", None, None), ("tables", "table_id", "buckets", "bucket"), ("details", "detail_id", "tables", "table_id"))
    levels = [changes.Level(name, key, last[2], this[1], this[2], parent, parent_key) for (name, key, parent, parent_key), last, this in zip(names, *runs, strict=True)]
    state = [last[1].select(F.lit(name).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), "content_hash") for (name, key, *_), last in zip(names, runs[0], strict=True)]
    return levels, state[0].unionByName(state[1]).unionByName(state[2])


_LEVELS = """
with t as (select concat_ws('.', c_mktsegment, cast(c_nationkey as varchar)) as bucket, c_custkey as table_id, cast(round(c_acctbal, 2) as decimal(20, 2)) as before,
    cast(round(c_acctbal + case when c_custkey % 50 = 0 then 1 else 0 end, 2) as decimal(20, 2)) as after, c_custkey % 13 <> 0 as had from customer),
b as (select bucket, sum(after) as after, sum(before) filter (had) as before from t group by 1),
bs as (select bucket, coalesce(after = before, false) as same from b),
ts as (select t.table_id, bucket, had and (before = after or bs.same) as same from t join bs using (bucket)),
ds as (select o_orderkey as detail_id, o_custkey as table_id, had and (o_orderkey % 3 <> 0 or ts.same) as same, o_orderkey % 3 = 0 as again, o_orderstatus from orders join ts on o_custkey = ts.table_id join t on t.table_id = ts.table_id) """


@query(
    "o32_incremental_levels",
    _LEVELS
    + """select 'buckets' as level, bucket as id, case when same then 'last' else 'fresh' end as run, cast(case when same then before else after end as varchar) as content from bs join b using (bucket)
union all select 'tables', cast(table_id as varchar), case when ts.same then 'last' else 'fresh' end, cast(case when ts.same then before else after end as varchar) from ts join t using (table_id)
union all select 'details', cast(detail_id as varchar), case when same then 'last' else 'fresh' end, o_orderstatus || case when again and not same then '/again' else '' end from ds""",
)
def o32b(spark, sf_dir):
    levels, state = _levels(spark, sf_dir)
    found, _ = changes.incremental_levels(levels, state)
    parts = [found[level.name].select(F.lit(level.name).alias("level"), F.col(level.key).cast("string").alias("id"), "run", "content") for level in levels]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "o32_incremental_state",
    _LEVELS
    + """select 'buckets' as entity_type, bucket as entity_id, sha256(cast(case when same then before else after end as varchar)) as content_hash from bs join b using (bucket)
union all select 'tables', cast(table_id as varchar), sha256(cast(case when ts.same then before else after end as varchar)) from ts join t using (table_id)
union all select 'details', cast(detail_id as varchar), sha256(o_orderstatus || case when again and not same then '/again' else '' end) from ds""",
)
def o32c(spark, sf_dir):
    """The state after the second run has the hashes of what was kept."""
    return changes.incremental_levels(*_levels(spark, sf_dir))[1]


@query("o32_third_run", "select o_orderkey as detail_id, case when o_orderkey % 3 = 0 then o_orderstatus || '/again' else o_orderstatus end as content from orders where o_custkey in (select c_custkey from customer)")
def o32d(spark, sf_dir):
    """After a run that kept details under unchanged tables, all tables change: every detail that had changed meanwhile is fresh."""
    levels, state = _levels(spark, sf_dir)
    found, after = changes.incremental_levels(levels, state)
    moved = lambda df: df.withColumn("content_hash", F.concat("content_hash", F.lit("+")))
    after = settled(after)  # a run's results are kept before the next one
    again = [changes.Level(x.name, x.key, settled(found[x.name]), x.listing if x.name == "details" else moved(x.listing), x.fresh, x.parent, x.parent_key) for x in levels]
    return changes.incremental_levels(again, after)[0]["details"].select("detail_id", "content")


@query("o33_rollover_state", "select 'customer' as entity_type, entity_id, sha256(content) as content_hash from snap_new")
def o33(spark, sf_dir):
    return changes.rolled_over(_typed(_hashed(spark, sf_dir, "snap_new")))


# ---- embedding


def _length_provider():
    """Stands for a model: a vector of lengths, the same for the same text."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


@query("o34_embed", "select doc_id, length(text)::double as a, (length(text) - length(replace(text, ' ', '')))::double as b from documents")
def o34(spark, sf_dir):
    out = embed.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _length_provider, batch_size=64)
    return out.select("doc_id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"))


@query("o34_embed_stored", "select doc_id, length(text)::double as a, (length(text) - length(replace(text, ' ', '')))::double as b from documents")
def o34b(spark, sf_dir):
    """The same through a store of vectors, which has those of a half already."""
    base, docs = snapshots.new_path(spark, "vectors"), table(spark, sf_dir, "documents").select("doc_id", "text")
    embed.embed_stored(docs.filter("doc_id % 2 = 0"), "text", _length_provider, base, 3, batch_size=64)
    out = embed.embed_stored(docs, "text", _length_provider, base, 3, batch_size=64)
    return out.select("doc_id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"))


def _flaky_provider():
    """The same, but the first call in each task fails."""
    calls, inner = [], _length_provider()

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("not yet")
        return inner(texts)

    return call


@query("o36_batched_apply", "select doc_id, length(text)::double as a from documents")
def o36(spark, sf_dir):
    out = embed.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _flaky_provider, batch_size=10, retries=3, delay=0.01)
    return out.select("doc_id", F.col("vector")[0].cast("double").alias("a"))


_HASHED = r"""
with toks as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as t from documents),
slots as (select doc_id, (('0x' || substr(md5(t), 1, 8))::bigint % 64)::int as slot, count(*) as n from toks group by 1, 2),
norms as (select doc_id, sqrt(sum(n * n)) as len from slots group by 1) """


@query("o35_l2_normalize", "select id, cast(slot - 1 as int) as slot, round(vector[slot] / sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))), 5) + 0.0 as x from points, (select unnest(range(1, 65)) as slot)")
def o35(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    return p.select("id", F.posexplode(vectors.l2_normalize(F.transform("vector", lambda x: x.cast("double") * 3))).alias("slot", "x")).select("id", "slot", (F.round("x", 5) + 0.0).alias("x"))


@query("o37_hash_embed", _HASHED + "select doc_id, slot, round(n / len, 6) as x from slots join norms using (doc_id)")
def o37(spark, sf_dir):
    out = vectors.hash_embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.posexplode("vector").alias("slot", "x")).filter("x > 0").select("doc_id", "slot", F.round("x", 6).alias("x"))


@query(
    "o27_index_snapshot",
    """
select 'buckets' as metadata_type, name, null as table_id, 'Name: ' || name as text, split_part(id, '.', 1) as stage from buckets where not is_deleted
union all select 'columns', name, table_name, 'Name: ' || name || ' | Type: ' || max(type), split_part(table_name, '.', 1) from columns group by name, table_name
union all select 'transformations', 'order ' || id, null, 'Name: order ' || id || ' | Type: ' || type || ' | Description: ' || description || ' | Dependencies:  | Runtime: ', cast(id as varchar) from transformations""",
)
def o27b(spark, sf_dir):
    """One call from a snapshot of three types, one of them from details, to points, and back."""
    none = F.lit(None).cast("string")
    buckets = view(spark, sf_dir, "buckets").select("id", "name", F.col("is_deleted").alias("isDeleted"))
    c = view(spark, sf_dir, "columns")
    # a detail for each column, so that no table's columns are gathered
    details = c.select(F.col("table_name").alias("id"), none.alias("bucket_id"), F.array(F.to_json(F.struct("name", "type"))).alias("columns"))
    t = view(spark, sf_dir, "transformations").select(F.col("id").cast("string").alias("id"), F.concat(F.lit("order "), F.col("id").cast("string")).alias("name"), "type", "description", F.lit(None).cast("struct<requires: array<string>, produces: array<string>>").alias("dependencies"), F.lit(None).cast("struct<type: string, memory: string>").alias("runtime"), none.alias("memory"))
    t = t.withColumn("blocks", F.array().cast("array<struct<name: string, code: string, inputs: array<struct<file: string, source: string, destination: string>>, outputs: array<struct<file: string, source: string, destination: string>>>>"))
    base = snapshots.new_path(spark, "index")
    indexing.index(base, {"buckets": buckets, "table_details": details, "transformations": t}, lambda df: vectors.hash_embed(df, "text"), 64)
    return points.load_points(spark, base).select("metadata_type", "name", "table_id", "text", "stage")


# ---- search

#: The text asked for.
QUESTION = "the and with this"


def question(spark: SparkSession, text: str = QUESTION) -> list[float]:
    return vectors.hash_embed(spark.createDataFrame([(text,)], "text string"), "text").first()["vector"]


def _ask(text: str, where: str, limit: int) -> str:
    return rf"""
with toks as (select id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as t from collection),
slots as (select id, (('0x' || substr(md5(t), 1, 8))::bigint % 64)::int as slot, count(*) as n from toks group by 1, 2),
norms as (select id, sqrt(sum(n * n)) as len from slots group by 1),
qtoks as (select unnest(string_split('{text}', ' ')) as t),
q as (select (('0x' || substr(md5(t), 1, 8))::bigint % 64)::int as slot, count(*) as m from qtoks group by 1),
qlen as (select sqrt(sum(m * m)) as ql from q),
scores as (select c.id, c.metadata_type, c.table_id, c.lang, coalesce(sum(n * m) / any_value(len) / any_value(ql), 0) as s from collection c cross join qlen left join norms using (id) left join (select id, n, m from slots join q using (slot)) h using (id) group by 1, 2, 3, 4)
select id, metadata_type, table_id, lang, round(s, 6) as score from scores where {where} order by round(s, 9) desc, id limit {limit}"""


#: Texts that one task embeds, so that a task's work does not grow with the table.
TEXTS_A_TASK = 8192


def parts_of(n: int, least: int) -> int:
    return max(least, -(-n // TEXTS_A_TASK))


def stored(spark: SparkSession, sf_dir: str) -> str:
    """Where the points of the collection view are; they are embedded and upserted once for each session and folder."""
    base = f"{snapshots.shared_dir(spark)}/collection-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    if points.is_empty(spark, base):
        texts = view(spark, sf_dir, "collection")
        embedded = vectors.hash_embed(texts.repartition(parts_of(texts.count(), spark.sparkContext.defaultParallelism)), "text")
        points.upsert_points(base, embedded.withColumn("seq", F.lit(1)), ["seq"], 64)
    return base


def _hits(found: DataFrame) -> DataFrame:
    return found.select("id", "metadata_type", "table_id", "lang", F.round("score", 6).alias("score"))


@query("o38_semantic_search", _ask(QUESTION, "lang = 'en'", 10))
def o38(spark, sf_dir):
    held = points.load_points(spark, stored(spark, sf_dir))
    return _hits(search.semantic_search(held, question(spark), stage="en", stage_column="lang"))


@query("o39_metadata_filter", "select id from points where metadata_type = 'columns' and table_id = '2'")
def o39(spark, sf_dir):
    return view(spark, sf_dir, "points").filter(search.metadata_filter(metadata_type="columns", table_id="2")).select("id")


@query("o39_component_filter", "select c_custkey as id, o_orderkey from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def o39c(spark, sf_dir):
    """Rows of configurations whose component is of one type."""
    components, configs, rows, _ = _configurations(spark, sf_dir)
    enriched = shape.enrich_configurations(components.withColumn("type", F.col("id")), configs).withColumn("component_type", F.col("component.type"))
    found = enriched.filter(search.metadata_filter(component_type="BUILDING"))
    return shape.configuration_children(found, rows).select(F.col("config_id").alias("id"), "o_orderkey")


@query("o39_stage_filter", "select id from tables where split_part(bucket_id, '.', 1) = 'in'")
def o39b(spark, sf_dir):
    t = view(spark, sf_dir, "tables").withColumn("stage", search.stage_of(F.lit(None).cast("string"), F.col("bucket_stage"), F.col("id")))
    return t.filter(search.metadata_filter(stage="in")).select("id")


def _near(where: str, limit: int) -> str:
    return f"""
with base as (select vector as bv from points where id = 0),
scored as (select id, metadata_type, list_cosine_similarity(vector::double[], bv::double[]) as s from points, base where {where})
select id, metadata_type, round(s, 6) as score from scored order by s desc, id limit {limit}"""


@query("o40_related_by_table", _ask("table src3", "metadata_type = 'transformations'", 5))
def o40(spark, sf_dir):
    held = points.load_points(spark, stored(spark, sf_dir), ["transformations"])
    return _hits(search.related_transformations(held, "src3", lambda text: question(spark, text)))


@query("o41_related_by_transformation", _near("id <> 0", 10))
def o41(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    return search.similar_to(p, p.filter("id = 0"), 10).select("id", "metadata_type", F.round("score", 6).alias("score"))


@query("o42_similar_columns", _near("id <> 0 and metadata_type = 'columns'", 10))
def o42(spark, sf_dir):
    p = view(spark, sf_dir, "points").withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))
    own = p.filter("id = 0").first()["table_id"]
    return search.similar_columns(p, "c0", own).select("id", "metadata_type", F.round("score", 6).alias("score"))


@query("o43_table_columns", "select id from points where metadata_type = 'columns' and table_id = '1' order by id limit 100")
def o43(spark, sf_dir):
    return search.table_columns(view(spark, sf_dir, "points"), "1").select("id")


@query("o43_table_columns_query", _ask(QUESTION, "metadata_type = 'columns' and table_id = 'src3'", 10))
def o43b(spark, sf_dir):
    held = points.load_points(spark, stored(spark, sf_dir), ["columns"])
    return _hits(search.table_columns(held, "src3", question(spark), 10))


@query("o44_search_all", _ask(QUESTION, "true", 10))
def o44(spark, sf_dir):
    return _hits(search.top_k(points.load_points(spark, stored(spark, sf_dir)), question(spark), 10))


def _indexed(spark: SparkSession, sf_dir: str) -> cells.Index:
    """The points of stored(), by cell, once for each session and folder."""
    base = f"{stored(spark, sf_dir)}-cells"
    if manifest.newest(spark, base) is None:
        cells.build(points.load_points(spark, stored(spark, sf_dir)).select("id", "metadata_type", "table_id", "lang", "vector"), base, n_cells=16)
    return cells.opened(spark, base)


@query("o44_search_all_in_cells", _ask(QUESTION, "true", 10))
def o44b(spark, sf_dir):
    return _hits(cells.nearest(spark, _indexed(spark, sf_dir), question(spark), 10))


@query("o38_semantic_search_in_cells", _ask(QUESTION, "lang = 'en'", 10))
def o38b(spark, sf_dir):
    return _hits(cells.nearest(spark, _indexed(spark, sf_dir), question(spark), 10, search.metadata_filter(stage="en", stage_column="lang")))


@query("o45_exclude_self", _near("id <> 7 and metadata_type = 'tables'", 5).replace("where id = 0", "where id = 7"))
def o45(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    q = p.filter("id = 7").first()["vector"]
    return search.top_k(p.filter("metadata_type = 'tables'"), q, 5, F.col("id") == 7).select("id", "metadata_type", F.round("score", 6).alias("score"))


def _many(queries: str, limit: int) -> str:
    return f"""
with q as (select id as query_id, vector as qv from points where {queries}),
scored as (select query_id, id, list_cosine_similarity(vector::double[], qv::double[]) as s from points, q where id <> query_id),
ranked as (select *, row_number() over (partition by query_id order by round(s, 12) desc, id) as rank from scored)
select query_id, id, round(s, 6) as score, cast(rank as int) as rank from ranked where rank <= {limit}"""


def stored_blocks(spark: SparkSession, sf_dir: str) -> str:
    """Where the points of the embeddings are kept as matrices, written once for each session and folder."""
    base = f"{snapshots.shared_dir(spark)}/blocks-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    found = manifest.newest(spark, base)
    if found is None:
        path = search.store_blocks(view(spark, sf_dir, "points"), f"{base}/data/{uuid.uuid4().hex}")
        return manifest.read(spark, base, manifest.commit(spark, base, lambda body: body or {"path": path}))["path"]
    return found[1]["path"]


@query("o46_batch_search", _many("id % 50 = 0", 10))
def o46(spark, sf_dir):
    asked = view(spark, sf_dir, "points").filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    found = search.batch_search_blocks(spark, stored_blocks(spark, sf_dir), asked, 10, exclude_self=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("o46_batch_search_of_points", _many("id % 50 = 0", 10))
def o46b(spark, sf_dir):
    """The same without stored blocks, of any number of queries."""
    p = view(spark, sf_dir, "points")
    asked = p.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.batch_search(p, asked, 10, exclude_self=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("o47_all_similar", _many("true", 5))
def o47(spark, sf_dir):
    return search.all_similar(view(spark, sf_dir, "points"), 5, block=1024).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("o47_all_similar_in_cells", _many("true", 5))
def o47b(spark, sf_dir):
    """The same through an index, whose cells leave out what can't be among the nearest."""
    index = cells.build(view(spark, sf_dir, "points").select("id", "vector"), snapshots.new_path(spark, "cells"), n_cells=8)
    return cells.all_nearest(spark, index, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("o48_format_hits", _near("id <> 0", 10).replace("select id, metadata_type, round(s, 6) as score from scored order by s desc, id limit 10", "select cast(row_number() over (order by s desc, id) as int) as rank, format('{:.3f}', s) as score_text, id, metadata_type from scored order by s desc, id limit 10"))
def o48(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    return search.format_hits(search.similar_to(p, p.filter("id = 0"), 10), ["id", "metadata_type", "name"])


@query("o49_quality_search", "select c_nationkey as table_id, avg(case when c_custkey % 10 = 0 then 0.0 else 1.0 end) as completeness from customer group by 1 having avg(case when c_custkey % 10 = 0 then 0.0 else 1.0 end) < 0.95 and count(*) filter (c_acctbal not between 0 and 9000) > 0")
def o49(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    complete = profile.completeness(F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")))
    issues = profile.common_issues(complete, None, profile.out_of_range(F.col("c_acctbal"), 0, 9000))
    q = c.groupBy(F.col("c_nationkey").alias("table_id")).agg(complete.alias("c"), issues.alias("i")).select("table_id", F.struct(F.col("c").alias("completeness"), F.col("i").alias("common_issues")).alias("quality_metrics"))
    return search.quality_search(q, 0.95, "out_of_range").select("table_id", "quality_metrics.completeness")


# ---- profiles


def _most(column: str, source: str) -> str:
    return f"(select string_agg(v, ',' order by n desc, v) from (select cast({column} as varchar) as v, count(*) as n from {source} where {column} is not null group by 1 order by 2 desc, 1 limit 3))"


@query(
    "o50_column_statistics",
    f"""
select 'p_brand' as column_name, min(p_brand) as min, max(p_brand) as max, cast(null as double) as avg, count(distinct p_brand) as unique_count, {_most('p_brand', 'part')} as most_common from part
union all select 'p_size', cast(min(p_size) as varchar), cast(max(p_size) as varchar), round(avg(p_size), 4), count(distinct p_size), {_most('p_size', 'part')} from part""",
)
def o50(spark, sf_dir):
    out = profile.column_statistics(table(spark, sf_dir, "part"), ["p_brand", "p_size"])
    return out.select("column_name", "min", "max", F.col("avg").cast("double").alias("avg"), "unique_count", F.array_join("most_common", ",").alias("most_common"))


_PROFILED = ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")


@query(
    "o50_merged_profiles",
    " union all ".join(f"select '{c}' as column_name, count(*) as rows, cast(min({c}) as double) as low, cast(max({c}) as double) as high, round(avg({c}), 6) as mean, true as distinct_near, true as median_near from lineitem" for c in _PROFILED[:3])
    + " union all select 'l_returnflag', count(*), null, null, null, true, true from lineitem",
)
def o50b(spark, sf_dir):
    """Three snapshots' profiles kept and merged; the numbers of different values and the medians are near those of the rows."""
    li, base = table(spark, sf_dir, "lineitem").select(*_PROFILED), snapshots.new_path(spark, "profiles")
    for k in range(3):
        sketches.save(sketches.sketched(li.filter(F.col("l_orderkey") % 3 == k)), base, f"run {k}")
    out = sketches.held_against(sketches.estimated(sketches.merged(sketches.load(spark, base)), (0.48, 0.52)), li)
    near = ((F.col("unique_count") == F.col("distinct")) | (F.abs(F.col("unique_count") - F.col("distinct")) < 0.08 * F.col("distinct"))).alias("distinct_near")
    # the median is the first value that half of the values are up to
    half = F.ceil(F.col("filled") / 2)
    median = (F.col("quantiles").isNull() | ((F.col("under") < half) & (F.col("upto") >= half))).alias("median_near")
    number = lambda c: F.col(c).try_cast("double")
    return out.select("column_name", "rows", number("min").alias("low"), number("max").alias("high"), F.round("avg", 6).alias("mean"), near, median)


@query("o51_completeness", "select round(count(email) * 1.0 / count(*), 9)::double as email, round(count(acctbal) * 1.0 / count(*), 9)::double as acctbal from emails")
def o51(spark, sf_dir):
    e = view(spark, sf_dir, "emails")
    return e.agg(*[F.round(profile.completeness(F.col(c)), 9).alias(c) for c in ("email", "acctbal")])


@query("o52_validity", f"select round(avg(case when {_GOOD} then 1.0 else 0.0 end), 9)::double as validity from emails where email is not null")
def o52(spark, sf_dir):
    return view(spark, sf_dir, "emails").agg(F.round(profile.validity(F.col("email"), profile.EMAIL), 9).alias("validity"))


@query("o53_range_check", "select p_brand, count(*) filter (p_size not between 5 and 40) as out_of_range_count from part group by 1")
def o53(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(profile.out_of_range(F.col("p_size"), 5, 40).alias("out_of_range_count"))


@query("o54_standardization", f"select count(*) filter ({_GOOD}) as standardized_count, count(email) as total_count from emails")
def o54(spark, sf_dir):
    return view(spark, sf_dir, "emails").agg(profile.standardized(F.col("email"), profile.EMAIL).alias("standardized_count"), F.count("email").alias("total_count"))


@query("o55_common_issues", "select l_shipmode as returnflag, concat_ws(',', case when lo then 'missing_values' end, case when hi > 0 then 'out_of_range' end) as issues from (select l_returnflag as l_shipmode, count(case when l_quantity > 1 then 1 end) < count(*) as lo, count(*) filter (l_discount > 0.08) as hi from lineitem group by 1)")
def o55(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("returnflag"))
    out = li.agg(profile.completeness(F.when(F.col("l_quantity") > 1, F.col("l_quantity"))).alias("c"), profile.out_of_range(F.col("l_discount"), -1.0, 0.08).alias("o"))
    return out.select("returnflag", F.array_join(profile.common_issues(F.col("c"), None, F.col("o")), ",").alias("issues"))


@query(
    "o56_profile_table",
    f"""
select 'email' as name, round(count(email) * 1.0 / count(*), 9)::double as completeness, round(count(*) filter ({_GOOD}) * 1.0 / count(email), 9)::double as validity, cast(null as bigint) as out_of_range_count, count(distinct email) as unique_count, 'invalid_format,missing_values' as issues from emails
union all select 'acctbal', round(count(acctbal) * 1.0 / count(*), 9)::double, 1.0, count(*) filter (acctbal not between 0 and 5000), count(distinct acctbal), 'missing_values,out_of_range' from emails""",
)
def o56(spark, sf_dir):
    out = profile.profile_table(view(spark, sf_dir, "emails"), _RULES)
    q = F.col("quality_metrics")
    return out.select("name", F.round(q["completeness"], 9).alias("completeness"), F.round(q["validity"], 9).alias("validity"), q["range_check"]["out_of_range_count"].alias("out_of_range_count"), F.col("statistics.unique_count").alias("unique_count"), F.array_join(q["common_issues"], ",").alias("issues"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("o57_latency_summary", "select operation, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(stddev(value), 6) as std, count(*) as sample_size from measurements group by 1")
def o57(spark, sf_dir):
    return _rounded(profile.latency_summary(view(spark, sf_dir, "measurements"), "operation", "value"))


@query("o58_throughput_summary", "select operation, round(sum(value), 6) as total_time, count(*) as total_records, round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(value), 6) as max, round(count(*) / sum(value), 6) as records_per_second from measurements group by 1")
def o58(spark, sf_dir):
    return _rounded(profile.throughput_summary(view(spark, sf_dir, "measurements"), "operation", "value"))


@query("o59_memory_summary", "select operation, round(arg_min(value, (ts, event_id)), 6) as initial, round(max(value), 6) as peak, round(avg(value), 6) as mean, round(stddev(value), 6) as std, count(*) as total_samples from measurements group by 1")
def o59(spark, sf_dir):
    return _rounded(profile.memory_summary(view(spark, sf_dir, "measurements"), "operation", "value", ["ts", "event_id"]))
