"""A collection of points (id, metadata_type, text, vector, ...), merged when it is read.

A version names layers. An upsert writes its own points as a layer on top and nothing else; a deletion writes ids. A point counts
in the topmost layer that has its id, whatever its type there, so an id that changes its type is replaced. Reading
joins the ids of the upper layers, which are narrow and whose number is known, with the rows of the lower ones, which
stay where they are. compact() makes one layer of all, in order of id, so that Parquet's ranges tell where an id lies.

Each layer is a folder with one part for each metadata type; reading some types opens theirs only.
"""

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import BROADCAST_ROWS
from . import manifest

POINTS = "id STRING, metadata_type STRING, text STRING, vector ARRAY<DOUBLE>"
#: An upsert that finds so many layers makes one of them.
COMPACT_AT = 16


def last_of(new: DataFrame, key: str, order: list[str], names: list[str]) -> DataFrame:
    """Of the rows of a key the last by `order`."""
    return new.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row")).select("row.*")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert or replace by key, null keys being equal; of several new rows for a key the last by `order` wins."""
    names = existing.columns
    last = last_of(new, key, order, names)
    keys = last.select(F.col(key).alias("__key"))
    return existing.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti").select(names).unionByName(last)


def reason(dim: int) -> Column:
    """Why a point can't be stored; null if it can."""
    fits = F.coalesce(F.size("vector") == dim, F.lit(False)) & F.col("vector").isNotNull()
    wrong = F.format_string("dimension %d, not %d", F.coalesce(F.size("vector"), F.lit(-1)), F.lit(dim))
    return F.when(F.col("id").isNull(), "no id").when(F.col("metadata_type").isNull(), "no metadata_type").when(~fits, wrong)


def checked_points(points: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Points with an id, a type and a vector of the collection's dimension, and the others with a reason."""
    judged = points.withColumn("reason", reason(dim))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def ensure_collection(spark: SparkSession, base: str, dim: int) -> int:
    """The newest version of the points at base, which is made, empty, if there is none. ValueError if the collection
    that is there has another dimension. An upsert needs no such call: its first version has its points."""
    found = manifest.newest(spark, base)
    if found is None:
        try:
            return manifest.put(spark, base, 1, {"dim": dim, "schema": POINTS, "layers": []})
        except manifest.Conflict:  # somebody else has made it meanwhile
            return ensure_collection(spark, base, dim)
    _same_dim(base, found[1], dim)
    return found[0]


def _same_dim(base: str, body: dict | None, dim: int) -> None:
    if body is not None and body["dim"] != dim:
        raise ValueError(f"the points at {base} have dimension {body['dim']}, not {dim}")


def is_empty(spark: SparkSession, base: str) -> bool:
    """Whether there is no collection, or one without points yet."""
    found = manifest.newest(spark, base)
    return found is None or not found[1]["layers"]


def _folder(kind: str) -> str:
    return hashlib.md5(kind.encode()).hexdigest()


def _write(points: DataFrame, path: str) -> None:
    points.write.partitionBy("__kind").parquet(path)


def _counts(spark: SparkSession, path: str, schema: T.StructType) -> tuple[dict[str, int], bool]:
    """Rows by type of a written layer, from its ids alone, and whether an id is in it twice."""
    rows = spark.read.schema(schema).parquet(path).filter("__kind <> 'rejected'").groupBy("id").agg(F.count("*").alias("n"), F.max("metadata_type").alias("type"))
    found = rows.groupBy("type").agg(F.sum("n").alias("rows"), F.count("*").alias("ids")).collect()  # a handful of types
    return {r["type"]: r["ids"] for r in found}, any(r["rows"] != r["ids"] for r in found)


def _merged_schema(old: str | None, new: T.StructType) -> str:
    """Fields of both, as DDL; of a field's two types the newer."""
    fields = {f.name: f for f in T.StructType.fromDDL(old)} if old else {}
    fields |= {f.name: f for f in new}
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.values())


def upsert_points(base: str, new: DataFrame, order: list[str], dim: int, compact_at: int = COMPACT_AT) -> tuple[int, DataFrame]:
    """Write points as a new layer and commit it; gives the version and the rejected points with a reason.

    Of several new points of an id the last by `order` counts, whatever its type. Only the new points are worked out, once, and written; what is
    stored already is neither read nor written, until the layers become too many. Writers that run at once all get their
    points in; of one id the later commit wins. A write that fails leaves no trace in the collection.
    """
    spark = new.sparkSession
    found = manifest.newest(spark, base)
    _same_dim(base, found and found[1], dim)
    why = F.col("__reason")
    judged = new.withColumn("__reason", reason(dim)).withColumn("__kind", F.when(why.isNotNull(), "rejected").otherwise(F.md5("metadata_type")))
    path, stored = f"{base}/data/{uuid.uuid4().hex}", judged.schema
    _write(judged, path)
    rejected = spark.read.schema(stored).parquet(path).filter("__kind = 'rejected'").select(*[c for c in new.columns if c != "reason"], why.alias("reason"))
    counts, twice = _counts(spark, path, stored)
    if twice:
        good = spark.read.schema(stored).parquet(path).filter("__kind <> 'rejected'").select(*new.columns, "__kind")
        path = f"{base}/data/{uuid.uuid4().hex}"
        _write(last_of(good, "id", order, good.columns), path)
        counts, _ = _counts(spark, path, good.schema)

    def change(body: dict | None) -> dict:
        _same_dim(base, body, dim)
        layers = body["layers"] if body else []
        number = max((x["layer"] for x in layers), default=0) + 1
        return {"dim": dim, "schema": _merged_schema(body and body["layers"] and body["schema"], new.schema), "layers": [*layers, {"layer": number, "path": path, "rows": counts}] if counts else layers}

    version = manifest.commit(spark, base, change)
    return (compact(spark, base) if len(manifest.read(spark, base, version)["layers"]) >= compact_at else version), rejected


def delete_points(base: str, ids: DataFrame) -> int:
    """Points of these ids are gone from the next version on. ids(id); unknown ones do no harm."""
    spark, path = ids.sparkSession, f"{base}/data/{uuid.uuid4().hex}"
    found = manifest.newest(spark, base)
    if found is None:
        raise ValueError(f"no points at {base}")
    kind = T.StructType.fromDDL(found[1]["schema"])["id"].dataType
    ids.select(F.col("id").cast(kind).alias("id")).filter("id is not null").distinct().write.parquet(path)
    n = spark.read.parquet(path).count()

    def change(body: dict) -> dict:
        number = max((x["layer"] for x in body["layers"]), default=0) + 1
        return body | {"layers": [*body["layers"], {"layer": number, "path": path, "gone": n}]}

    return manifest.commit(spark, base, change)


def _merged(spark: SparkSession, body: dict, kinds: list[str] | None = None) -> DataFrame:
    """The points of a version, with `kinds` of those types only."""
    schema = T.StructType.fromDDL(body["schema"])
    layers = sorted(body["layers"], key=lambda x: x["layer"])
    parts, upper, n_upper = [], [], 0
    for depth, x in enumerate(layers):
        held = x.get("rows", {})
        paths = [f"{x['path']}/__kind={_folder(k)}" for k in held if kinds is None or k in kinds]
        if paths:
            parts.append(spark.read.schema(schema).parquet(*paths).withColumn("__layer", F.lit(x["layer"])))
        if depth:
            # all types: an id may have had another one below
            every = [x["path"]] if "gone" in x else [f"{x['path']}/__kind={_folder(k)}" for k in held]
            upper.append(spark.read.schema(T.StructType([schema["id"]])).parquet(*every).withColumn("__top", F.lit(x["layer"])))
            n_upper += x.get("gone", 0) + sum(held.values())
    if not parts:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, parts)
    if not upper:
        return rows.drop("__layer")
    tops = reduce(DataFrame.unionByName, upper).groupBy("id").agg(F.max("__top").alias("__top"))
    tops = F.broadcast(tops) if n_upper <= BROADCAST_ROWS else tops  # narrow, and known from the manifest
    there = F.col("__top").isNull() | (F.col("__layer") >= F.col("__top"))
    return rows.join(tops, "id", "left").filter(there).select(schema.names)


def load_points(spark: SparkSession, base: str, kinds: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The points of the newest version, or of an older one, and of some types only if they are named: other types' files are
    not opened, but for the ids of upper layers."""
    found = manifest.newest(spark, base) if version is None else (version, manifest.read(spark, base, version))
    if found is None:
        raise ValueError(f"no points at {base}")
    return _merged(spark, found[1], kinds)


def compact(spark: SparkSession, base: str) -> int:
    """One layer of all, in order of id. Layers that come meanwhile stay on top; Conflict if somebody else compacts meanwhile."""
    _, body = manifest.newest(spark, base)
    path = f"{base}/data/{uuid.uuid4().hex}"
    rows = _merged(spark, body).withColumn("__kind", F.md5("metadata_type"))
    _write(rows.repartitionByRange("__kind", "id").sortWithinPartitions("__kind", "id"), path)
    counts, _ = _counts(spark, path, rows.schema)
    own = {x["layer"] for x in body["layers"]}

    def change(now: dict | None) -> dict:
        there = {x["layer"] for x in now["layers"]} if now else set()
        if not own <= there:
            raise RuntimeError("the collection was compacted meanwhile")
        return now | {"layers": [{"layer": max(own, default=0), "path": path, "rows": counts}, *(x for x in now["layers"] if x["layer"] not in own)]}

    return manifest.commit(spark, base, change)


def scan_points(points: DataFrame, conditions: dict[str, object], limit: int | None = None) -> DataFrame:
    """Points that meet all equalities; with a limit the first by id."""
    found = points.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in conditions.items()], F.lit(True)))
    return found if limit is None else found.orderBy("id").limit(limit)
