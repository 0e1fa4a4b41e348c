"""Each operator and each stage over awkward rows, over none, and beside columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, awkward, rows
from lorescope.llm import license_scan, media, mixing, packing, quality_classifier, quality_rules, secrets, simhash, toxicity, urls
from lorescope.llm.queries import QUERIES


def labels(spark, some=True):
    return spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1), (6, 0, 0), (6, 0, 0)] if some else [], "doc_id long, quality int, toxic int")


OPERATORS = {
    "licenses": lambda d: license_scan.matches(d),
    "packing": lambda d: packing.pack(packing.tokenize(d)),
    "mixing": lambda d: mixing.mix(d),
    "secrets": lambda d: secrets.scan(d, secrets.train(d)),
    "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, labels(d.sparkSession))),
    "quality": lambda d: quality_classifier.scored(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "media": lambda d: media.decoded(media.encoded(d)),
    "rules": lambda d: quality_rules.judged(d),
}
ONE_PER_ROW = ("mixing", "secrets", "toxicity", "quality", "simhash", "media", "rules")


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    plain, empty = awkward(spark), spark.createDataFrame([], SCHEMA)
    found = rows(OPERATORS[name](plain))
    assert found == rows(OPERATORS[name](awkward(spark, True))) == rows(OPERATORS[name](plain.repartition(3, "doc_id") if name != "packing" else plain))
    if name in ONE_PER_ROW:
        assert len(found) == plain.count()
    assert OPERATORS[name](empty).count() == 0


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, tmp_path, k):
    name, stage = stages()[k]
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward(spark), awkward(spark, True), spark.createDataFrame([], SCHEMA)):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            assert dict(out.dtypes) == dict(docs.dtypes)
        out.collect()
    assert len(stages()) == 5


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "https://A.example.com/x?y"), (2, None), (3, "no scheme"), (4, "http://www.example.com/en/1"), (5, "http://x.example.com/en/1"), (6, "http://x.net/fr/"), (7, "http://x.net/FR/"), (8, "http://spam.org/a.html"), (9, "https://www.spam.org/a/?q#f"), (10, "http://com"), (11, "http://acom/en/"), (11, "http://acom/en/"), (12, "http://a.com?/"), (13, "x://y://z.com/")],
        "page_id long, url string",
    )
    listed = spark.createDataFrame([("spam.org/a",), ("other.org/",)], "canonical string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages.withColumn("host", F.lit(1)).withColumn("block", F.lit(1)), listed).collect()}
    assert out[1] == ("a.example.com", "/x", "com/", "allow")
    assert out[2] == ("", "", None, "allow") == out[3]
    assert out[4] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert out[5][2:] == ("example.com/en/", "block") and out[6][2:] == ("net/fr/", "block") and out[7][2:] == (None, "allow")
    assert out[8][2:] == (None, "block") == out[9][2:] and out[10][2:] == (None, "allow") and out[11][2:] == (None, "allow")
    assert out[12] == ("a.com", "", None, "allow") and out[13] == ("y:", "//z.com/", None, "allow")
    assert urls.judged(pages.limit(0), listed).count() == 0 and urls.judged(pages, listed.limit(0)).filter("rule is null and verdict = 'block'").count() == 0


def test_the_list_of_the_query_blocks_pages(spark):
    """What the list blocks is no matter of hosts: they have other pages that are let through."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = [r for r in QUERIES["op8_urls"](spark, "/root/testdata/sf0.1").collect() if r["rule"] is None]
    listed = {r["canonical"] for r in urls.listed_urls(pages).collect()}
    of = {r["page_id"]: r["canonical"] for r in urls.parts(pages).collect()}
    assert all((r["verdict"] == "block") == (of[r["page_id"]] in listed) for r in out)
    blocked = sum(r["verdict"] == "block" for r in out)
    assert len(out) // 32 < blocked < len(out) // 8
    ends = {v: {r["host"].rpartition(".")[2] for r in out if r["verdict"] == v} for v in ("allow", "block")}
    assert ends["block"] <= ends["allow"]


def test_a_url_that_most_pages_share(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, F.lit("http://hot.org/x")).otherwise(F.concat(F.lit("http://h.org/"), F.col("id").cast("string"))).alias("url"))
    listed = spark.createDataFrame([("hot.org/x",), ("h.org/3",)], "canonical string")
    out = {r["page_id"]: r["verdict"] for r in urls.judged(pages, listed).collect()}
    assert len(out) == 4000 and all((v == "block") == (i % 3 > 0 or i == 3) for i, v in out.items())


def test_bloom_has_no_false_negative_and_few_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("canonical"))
    asked = spark.range(2000, 12000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("canonical"), "id")
    out = urls.flagged(asked, listed)
    assert out.filter("id < 3000 and not maybe").count() == 0
    wrong = out.filter("id >= 3000 and maybe").count()
    assert 0 < wrong < 100  # of 9,000; the exact join takes them out
    pages = asked.select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), "canonical").alias("url"))
    assert urls.judged(pages, listed).filter("(verdict = 'block') <> (page_id < 3000)").count() == 0
