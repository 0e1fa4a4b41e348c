"""Declared schemas of catalog entities. A missing field is null, and null means absent."""

COLUMN = (
    "name STRING, type STRING, basetype STRING, description STRING, table_id STRING, bucket_id STRING, "
    "statistics STRUCT<min: STRING, max: STRING, avg: STRING, unique_count: BIGINT, most_common: ARRAY<STRING>>, "
    "quality_metrics STRUCT<completeness: DOUBLE, validity: DOUBLE, format_pattern: STRING, "
    "range_check: STRUCT<min_valid: BIGINT, max_valid: BIGINT, out_of_range_count: BIGINT>, "
    "standardization: STRUCT<standardized_count: BIGINT, total_count: BIGINT, standard: STRING>, "
    "common_issues: ARRAY<STRING>, last_validated: STRING>"
)
FILE = "STRUCT<file: STRING, source: STRING, destination: STRING>"

ENTITIES = {
    "buckets": "id STRING, name STRING, description STRING, stage STRING, type STRING, tags ARRAY<STRING>, isDeleted BOOLEAN",
    "tables": (
        "id STRING, name STRING, description STRING, isDeleted BOOLEAN, bucket STRUCT<id: STRING, stage: STRING>, isLinked BOOLEAN, "
        "sourceTable STRUCT<id: STRING, project: STRUCT<id: STRING>, bucket: STRUCT<id: STRING>, displayName: STRING>, "
        "sourceTableDetails STRUCT<id: STRING, description: STRING, displayName: STRING, isAccessible: BOOLEAN>, "
        "rowsCount BIGINT, dataSizeBytes BIGINT, primaryKey ARRAY<STRING>, created STRING, lastImportDate STRING, lastChangeDate STRING"
    ),
    # a column is an object or a bare string, so each is kept as JSON text until explode_columns()
    "table_details": "id STRING, name STRING, bucket_id STRING, metadata MAP<STRING, STRING>, columns ARRAY<STRING>",
    "columns": COLUMN,
    "components": "id STRING, type STRING",
    "configurations": "id STRING, name STRING, description STRING, componentId STRING",
    "config_rows": "component_id STRING, config_id STRING, id STRING, name STRING",
    "config_versions": "component_id STRING, config_id STRING, version BIGINT",
    "transformations": (
        "id STRING, name STRING, type STRING, description STRING, "
        f"blocks ARRAY<STRUCT<name: STRING, code: STRING, inputs: ARRAY<{FILE}>, outputs: ARRAY<{FILE}>>>, "
        "dependencies STRUCT<requires: ARRAY<STRING>, produces: ARRAY<STRING>>, "
        "runtime STRUCT<type: STRING, backend: STRING, image: STRING, memory: STRING, cpu_units: BIGINT>, memory STRING"
    ),
    "state": "entity_type STRING, entity_id STRING, content_hash STRING",
}

POINT = "id STRING, vector ARRAY<FLOAT>, metadata_type STRING, text STRING, table_id STRING, transformation_id STRING"
