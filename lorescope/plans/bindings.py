"""The driver's tables seen as catalog entities. Each text is SQL that Spark and DuckDB both run."""

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # suppliers are buckets and customers tables, a third of them in one bucket; every fifth links to another, if that exists
    "buckets": """
select concat(case when s_suppkey % 2 = 0 then 'in' else 'out' end, '.c-', cast(s_suppkey as varchar(10))) as id, s_name as name,
  case when s_suppkey % 2 = 0 then 'in' else 'out' end as stage, s_suppkey % 10 = 4 as is_deleted, s_suppkey from supplier""",
    "tables": """
select concat(b.id, '.', cast(c_custkey as varchar(10))) as id, c_name as name, b.id as bucket_id, b.stage as bucket_stage, c_custkey % 11 = 10 as is_deleted,
  case when c_custkey % 5 = 0 then concat('Customer#', lpad(cast(c_custkey + 7 as varchar(10)), 9, '0')) end as source_name, c_custkey
from (select * from customer cross join (select count(*) as suppliers from supplier) one_row) c join (
  select concat(case when s_suppkey % 2 = 0 then 'in' else 'out' end, '.c-', cast(s_suppkey as varchar(10))) as id,
    case when s_suppkey % 2 = 0 then 'in' else 'out' end as stage, s_suppkey from supplier) b
  on b.s_suppkey = case when c_custkey % 3 = 0 then 0 else c_custkey % suppliers end""",
    "columns": """
select p_partkey as column_key, p_name as name, p_type as type, p_brand as description,
  concat('Customer#', lpad(cast(case when p_partkey % 3 = 0 then 0 else p_partkey % customers end as varchar(10)), 9, '0')) as table_name, p_size, p_retailprice
from part cross join (select count(*) as customers from customer) one_row""",
    "transformations": "select o_orderkey as id, o_orderpriority as type, o_orderstatus as description from orders",
    "blocks": """
select l_orderkey as transformation_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) as block_no,
  concat('part.', cast(l_partkey as varchar(20))) as input_source, concat('supp.', cast(l_suppkey as varchar(20))) as output_destination from lineitem""",
    "code_blocks": """
select conv_id as transformation_id, turn as block_no, role as name,
  concat('# ', role, ' step ', cast(turn as varchar(10)), chr(10),
    case turn % 4 when 0 then 'df = pd.read_csv(f)' when 1 then 'df = df.merge(o)' when 2 then 'df = df.groupby(k).agg(m)' else 'df.to_csv(f)' end, chr(10), text) as code
from conversations""",
    "snap_old": "select c_custkey as entity_id, concat(c_name, '|', c_mktsegment) as content from customer where c_custkey % 17 <> 0",
    "snap_new": """
select c_custkey as entity_id, concat(c_name, '|', case when c_custkey % 7 = 0 then 'CHANGED' else c_mktsegment end) as content
from customer where c_custkey % 13 <> 0""",
    "changes": "select user_id as id, event_id as seq, ts, event_type, value from events",
    "points": """
select vec_id as id, case vec_id % 3 when 0 then 'columns' when 1 then 'tables' else 'transformations' end as metadata_type,
  cast(label as varchar(10)) as table_id, embedding as vector from embeddings""",
    "collection": """
select cast(doc_id as varchar(20)) as id, case doc_id % 3 when 0 then 'tables' when 1 then 'columns' else 'transformations' end as metadata_type, source as table_id, lang,
  case when doc_id % 3 = 2 then concat('table ', source, ' ', text) else text end as text from documents""",
    "emails": """
select c_custkey, case when c_custkey % 10 = 0 then null when c_custkey % 7 = 0 then concat(c_name, '.example.org')
    else concat(lower(replace(c_name, '#', '.')), '@example.org') end as email,
  case when c_custkey % 20 <> 0 then c_acctbal end as acctbal from customer""",
    "measurements": "select event_type as operation, ts, event_id, value from events",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the tables in sf_dir."""
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", VIEWS[name])]
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql(body: str) -> str:
    """DuckDB SQL with the views that a body names put before it."""
    used = [n for n in VIEWS if re.search(rf"\b(from|join) {n}\b", body)]
    heads = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in used)
    body = body.strip()
    if not heads:
        return body
    return f"with {heads}, {body[5:]}" if body.lower().startswith("with ") else f"with {heads} {body}"
