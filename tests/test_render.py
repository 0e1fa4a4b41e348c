"""Exact lines for known entities."""

import pytest
from pyspark.sql import types as T

from lorescope.functions import render
from lorescope.sources.schemas import COLUMN, ENTITIES

QUALITY = [
    (dict(name="iban", type="STRING", description="Account of a supplier", quality_metrics=dict(completeness=0.97, validity=0.5, standardization=dict(standard="ISO 13616"), common_issues=["wrong_check_digits"])), "Name: iban | Type: STRING | Description: Account of a supplier | Quality: 97% complete, 50% valid, Standard: ISO 13616, Issues: wrong_check_digits"),
    (dict(name="floor", type="SMALLINT", description="Storey of a shelf", quality_metrics=dict(completeness=0.6, validity=1.0, range_check=dict(min_valid=-2, max_valid=40), common_issues=["out_of_range", "missing_values"])), "Name: floor | Type: SMALLINT | Description: Storey of a shelf | Quality: 60% complete, 100% valid, Valid range: -2-40, Issues: out_of_range, missing_values"),
    (dict(name="sku", type="INTEGER", description="Number of an article"), "Name: sku | Type: INTEGER | Description: Number of an article"),
    (dict(statistics=dict(unique_count=100)), "Statistics: unique=100"),
    (dict(statistics=dict(min="1", max="9", avg="5.0", unique_count=9, most_common=["3", "4"])), "Statistics: min=1, max=9, avg=5.0, unique=9, most_common=3,4"),
    (dict(), "{}"),
    (dict(basetype="STRING"), ""),
    (dict(description=""), "Description: "),
]


def one(spark, schema, row, kind):
    return render.render(spark.createDataFrame([row], schema), kind).first()["text"]


@pytest.mark.parametrize("row,line", QUALITY)
def test_column(spark, row, line):
    assert one(spark, T.StructType.fromDDL(COLUMN), row, "columns") == line


def test_table(spark):
    kind = T.StructType.fromDDL(ENTITIES["tables"])
    assert one(spark, kind, dict(name="scales", description="Weights of crates"), "tables") == "Name: scales | Description: Weights of crates"
    linked = dict(name="harvest", description="Crates a day", isLinked=True, sourceTable=dict(id="orchard.picks", project=dict(id="farm-9")), sourceTableDetails=dict(description="Every crate weighed"))
    assert one(spark, kind, linked, "tables") == "Name: harvest | Description: Crates a day | Type: Linked Table | Source Table: orchard.picks | Source Project: farm-9 | Source Description: Every crate weighed"
    away = dict(name="t", isLinked=True, sourceTable=dict(id="s"), sourceTableDetails=dict(isAccessible=False, displayName="S"), rowsCount=5, dataSizeBytes=7, bucket=dict(stage="in"), primaryKey=["a", "b"], created="2024")
    assert one(spark, kind, away, "tables") == "Name: t | Type: Linked Table | Source Table: s | Source Project: unknown | Source Table Status: Inaccessible | Source Display Name: S | Rows: 5 | Size: 7 bytes | Bucket: unknown | Primary Key: a, b | Created: 2024"
    assert one(spark, kind, dict(), "tables") == "{}"


def test_default(spark):
    kind = T.StructType.fromDDL(ENTITIES["buckets"])
    assert one(spark, kind, dict(name="n", description="d", type="t", tags=["a", "b"]), "buckets") == "Name: n | Description: d | Type: t | Tags: a, b"
    assert one(spark, kind, dict(tags=[]), "buckets") == "{}"


def test_transformation(spark):
    kind = T.StructType.fromDDL(ENTITIES["transformations"])
    declared = dict(name="T", dependencies=dict(requires=["orchard.picks", "orchard.trees"], produces=["mill.juice"]), runtime=dict(type="shell", memory="512m"))
    assert one(spark, kind, declared, "transformations") == "Name: T | Type: unknown | Description:  | Dependencies: Requires orchard.picks, orchard.trees; Produces mill.juice | Runtime: shell, 512m memory"
    derived = dict(blocks=[dict(inputs=[dict(source="b"), dict(source="a"), dict(source="")], outputs=[dict(destination="o"), dict(destination="o")])], memory="2g")
    assert one(spark, kind, derived, "transformations") == "Name: Unnamed | Type: unknown | Description:  | Dependencies: Requires a, b; Produces o | Runtime: docker, 2g memory"
    empty = dict(dependencies=dict(requires=[]))
    assert "Dependencies: Requires  |" in one(spark, kind, empty, "transformations")


def test_block(spark):
    kind = T.StructType.fromDDL(ENTITIES["transformations"])["blocks"].dataType.elementType
    block = dict(name="Press", code="# Weigh crates, sum by tree\nw = read_csv(f)\ns = w.groupby(t).aggregate(sum)", inputs=[dict(file="picks.csv", source="orchard.picks"), dict(source="lost")], outputs=[dict(file="juice.csv", destination="mill.juice")])
    assert one(spark, kind, block, "transformation_blocks") == "Block: Press | Inputs: picks.csv from orchard.picks | Outputs: juice.csv to mill.juice | Code: Weigh crates, sum by tree Operations: read_csv, groupby, aggregate, aggregate"
    assert one(spark, kind, dict(), "transformation_blocks") == "Block: Unnamed Block"


def test_code(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("\n \tx = 1\n  ## a note ##  \n# b\nz\n",), ("select 1",), ("#  #\nmerge",)], "c string")
    rows = df.select(render.code_description(F.col("c")), render.code_operations(F.col("c")), render.code_preview(F.col("c"), 2)).collect()
    assert [tuple(r) for r in rows] == [("a note", [], "x = 1\n  ## a note ##  "), (None, [], "select 1"), (None, ["merge"], "#  #\nmerge")]
