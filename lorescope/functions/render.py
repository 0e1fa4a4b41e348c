"""One line of text for each entity. Null fields leave no trace; parts are joined by ` | `."""

from pyspark.sql import Column, DataFrame, functions as F

SEP = " | "


def _part(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, _part(label, F.array_join(values, ", ")))


def _or_braces(line: Column) -> Column:
    return F.when(line == "", F.lit("{}")).otherwise(line)


def render_default(name: Column, description: Column, kind: Column, tags: Column) -> Column:
    return _or_braces(F.concat_ws(SEP, _part("Name", name), _part("Description", description), _part("Type", kind), _listed("Tags", tags)))


def render_table(t: Column) -> Column:
    """Of a struct with the fields of a table."""
    linked = F.coalesce(t["isLinked"], F.lit(False))
    source, detail = t["sourceTable"], t["sourceTableDetails"]
    open_ = F.coalesce(detail["isAccessible"], F.lit(True))
    known = linked & detail.isNotNull()

    def or_unknown(c: Column) -> Column:
        return F.coalesce(c, F.lit("unknown"))

    return _or_braces(
        F.concat_ws(
            SEP,
            _part("Name", t["name"]),
            _part("Description", t["description"]),
            F.when(linked, F.lit("Type: Linked Table")),
            F.when(linked & source.isNotNull(), _part("Source Table", or_unknown(source["id"]))),
            F.when(linked & source.isNotNull(), _part("Source Project", or_unknown(source["project"]["id"]))),
            F.when(known & open_, _part("Source Description", detail["description"])),
            F.when(known & ~open_, F.lit("Source Table Status: Inaccessible")),
            F.when(known & ~open_, _part("Source Display Name", detail["displayName"])),
            _part("Rows", t["rowsCount"]),
            _part("Size", F.concat(t["dataSizeBytes"].cast("string"), F.lit(" bytes"))),
            F.when(t["bucket"].isNotNull(), _part("Bucket", or_unknown(t["bucket"]["id"]))),
            _listed("Primary Key", t["primaryKey"]),
            _part("Created", t["created"]),
            _part("Last Import", t["lastImportDate"]),
            _part("Last Change", t["lastChangeDate"]),
        )
    )


def render_statistics(s: Column) -> Column:
    most = F.when(F.size(s["most_common"]) > 0, F.concat(F.lit("most_common="), F.array_join(s["most_common"], ",")))
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), s[f].cast("string")) for k, f in (("min", "min"), ("max", "max"), ("avg", "avg"), ("unique", "unique_count"))], most)
    return F.when(line != "", _part("Statistics", line))


def render_quality(q: Column) -> Column:
    def share(c: Column, word: str) -> Column:
        return F.concat((c * 100).cast("int").cast("string"), F.lit(f"% {word}"))  # cut off, not rounded

    limits = F.concat(F.lit("Valid range: "), q["range_check"]["min_valid"].cast("string"), F.lit("-"), q["range_check"]["max_valid"].cast("string"))
    line = F.concat_ws(", ", share(q["completeness"], "complete"), share(q["validity"], "valid"), limits, _part("Standard", q["standardization"]["standard"]), _listed("Issues", q["common_issues"]))
    return F.when(line != "", _part("Quality", line))


def render_column(c: Column, any_field: Column | None = None) -> Column:
    """any_field: whether the item has any field at all; by default, whether one of name to bucket_id is there."""
    line = F.concat_ws(SEP, _part("Name", c["name"]), _part("Type", c["type"]), _part("Description", c["description"]), render_statistics(c["statistics"]), render_quality(c["quality_metrics"]))
    held = F.coalesce(c["name"], c["type"], c["description"], c["table_id"], c["bucket_id"], c["basetype"]).isNotNull() if any_field is None else any_field
    return F.when((line == "") & ~held, F.lit("{}")).otherwise(line)


def dependencies(t: Column) -> tuple[Column, Column]:
    """(requires, produces): the declared lists if either is declared, else what blocks read and write."""
    declared = t["dependencies"]["requires"].isNotNull() | t["dependencies"]["produces"].isNotNull()

    def derived(side: str, field: str) -> Column:
        found = F.flatten(F.filter(F.transform(F.coalesce(t["blocks"], F.array()), lambda b: F.transform(b[side], lambda x: x[field])), lambda x: x.isNotNull()))
        return F.array_sort(F.array_distinct(F.filter(found, lambda s: s.isNotNull() & (s != ""))))

    return tuple(F.when(declared, t["dependencies"][name]).otherwise(derived(side, field)) for name, side, field in (("requires", "inputs", "source"), ("produces", "outputs", "destination")))


def render_transformation(t: Column) -> Column:
    requires, produces = dependencies(t)
    needs = F.concat_ws("; ", F.when(requires.isNotNull() & (t["dependencies"]["requires"].isNotNull() | (F.size(requires) > 0)), F.concat(F.lit("Requires "), F.array_join(requires, ", "))), F.when(produces.isNotNull() & (t["dependencies"]["produces"].isNotNull() | (F.size(produces) > 0)), F.concat(F.lit("Produces "), F.array_join(produces, ", "))))
    memory = F.concat(F.when(t["runtime"].isNotNull(), t["runtime"]["memory"]).otherwise(t["memory"]), F.lit(" memory"))
    kind = F.when(t["runtime"].isNotNull(), t["runtime"]["type"]).otherwise(F.when(t["memory"].isNotNull(), F.lit("docker")))
    return F.concat_ws(
        SEP,
        _part("Name", F.coalesce(t["name"], F.lit("Unnamed"))),
        _part("Type", F.coalesce(t["type"], F.lit("unknown"))),
        _part("Description", F.coalesce(t["description"], F.lit(""))),
        _part("Dependencies", needs),
        _part("Runtime", F.concat_ws(", ", kind, memory)),
    )


_EDGES = r"^\s+|\s+$"


def code_description(code: Column) -> Column:
    """The first comment line without its marks; null if there is none or nothing is left of it."""
    line = F.get(F.filter(F.split(code, "\n"), lambda x: x.rlike(r"^\s*#")), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, _EDGES, ""), "^[# ]+|[# ]+$", ""), _EDGES, "")
    return F.nullif(bare, F.lit(""))


def code_operations(code: Column) -> Column:
    """Names of the data operations that the code mentions, in a fixed order."""
    low = F.lower(code)
    tests = (("read_csv", "read_csv"), ("merge", "merge"), ("groupby", "groupby"), ("agg", "aggregate"), ("aggregate", "aggregate"), ("to_csv", "to_csv"))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in tests]))


def code_text(code: Column) -> Column:
    return F.concat_ws(" ", code_description(code), F.when(F.size(code_operations(code)) > 0, F.concat(F.lit("Operations: "), F.array_join(code_operations(code), ", "))))


def code_preview(code: Column, lines: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.regexp_replace(code, _EDGES, ""), "\n"), 1, lines), "\n")


def render_block(b: Column) -> Column:
    def ends(label: str, side: Column, word: str, other: str) -> Column:
        whole = F.filter(side, lambda x: x["file"].isNotNull() & x[other].isNotNull())
        line = F.array_join(F.transform(whole, lambda x: F.concat(x["file"], F.lit(f" {word} "), x[other])), ", ")
        return F.when(F.size(side) > 0, _part(label, line))

    code = code_text(b["code"])
    return F.concat_ws(
        SEP,
        _part("Block", F.coalesce(b["name"], F.lit("Unnamed Block"))),
        ends("Inputs", b["inputs"], "from", "source"),
        ends("Outputs", b["outputs"], "to", "destination"),
        F.when(b["code"].isNotNull() & (code != ""), _part("Code", code)),
    )


def render(df: DataFrame, metadata_type: str) -> DataFrame:
    """df with `text`, by the rule of its type; an unknown type is rendered as buckets are."""
    row = F.struct(*df.columns)
    rules = {"tables": render_table, "table_details": render_table, "columns": render_column, "transformations": render_transformation, "transformation_blocks": render_block}
    if metadata_type in rules:
        return df.withColumn("text", rules[metadata_type](row))
    none = F.lit(None).cast("string")
    have = {c: F.col(c) if c in df.columns else none for c in ("name", "description", "type")}
    tags = F.col("tags") if "tags" in df.columns else F.lit(None).cast("array<string>")
    return df.withColumn("text", render_default(have["name"], have["description"], have["type"], tags))
