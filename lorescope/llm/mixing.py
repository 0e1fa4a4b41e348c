"""Mixing sources to target weights, in DataFrame functions alone.

Each source gets a target of words by its weight, at most `most` times its own size; what it can't
give is shared by the others in proportion to their weights. A source gives whole epochs first. The
rest is an Efraimidis-Spirakis sample: documents are ordered by -ln(u) / quality weight with u a
hash of doc_id, and taken until the budget is filled; the last one is cut to fit.

The prefix sum never brings a source together: sums by (source, bucket of the key) find the bucket
in which the budget ends, only that bucket is put in order, and its cut point (one row for each
source) decides about every document. A weight is 1/4 to 1, so that of n buckets, equally wide in 1 - exp(-key / 4),
none holds over 4/n of a source's documents but by chance. Sources themselves, however many, are put in order and
summed up by ranges (common.prefix_sums).

Defined results. A null text has size 0 and is taken 0 times. Null is a source of its own, last in
order. A row without a doc_id is known by its text instead. Rows that share both source and key (repeats) are one
entry of the order: where the cut falls on them, each is cut alike, to its share of the words. A very long text is one
document like others. An empty table gives an empty mix. Only doc_id, text and source are read; other columns pass
through.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, count_of, n_words, prefix_sums, settled, small_or_not

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
SYMBOLS = "#*$%&|<>"
#: The least weight that a document's quality gives it.
LEAST_WEIGHT = 0.25
#: Buckets of a key's range at least, and documents for each further one.
BUCKETS, PER_BUCKET = 4096, 25_000


def source_key(source: Column) -> Column:
    """Sorts as the source does by code point, null last, and is never null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def quality_weight(text: Column) -> Column:
    """1 for plain text, less for text full of symbols, never under LEAST_WEIGHT."""
    share = count_of(text, SYMBOLS) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1.0 / (1.0 + 20.0 * share)), F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1], by 48 bits of a hash."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.md5(text)), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(2**48)


def exponential(doc_id: Column, text: Column) -> Column:
    """The Efraimidis-Spirakis key: the smaller, the earlier."""
    return -F.log(uniform(doc_id, text)) / quality_weight(text)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey, size (words) and ekey, the exponential key."""
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), exponential(F.col("doc_id"), F.col("text")).alias("ekey"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (skey, source_size) to the same with weight, target and the whole words of the target.

    Sources in order of cap / weight: while the share of what is left exceeds a source's cap, it
    gets its cap; from the first that can take its share on, all get theirs. That is where capping
    and sharing again, round by round, ends.
    """
    one = F.lit(1).cast("long")
    place = (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    ranked = prefix_sums(sizes, ["skey"], {"place": one}).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place)).drop("place")
    ranked = settled(ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight")))
    words, shares = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    ranked = prefix_sums(ranked, ["ratio", "skey"], {"caps": F.col("cap"), "shares": F.col("weight")})
    # what the caps before this source leave, by the weights from it on
    level = (F.lit(words or 0) - (F.col("caps") - F.col("cap"))) / (F.lit(shares or 0) - (F.col("shares") - F.col("weight")))
    ranked = settled(ranked.withColumn("level", level))
    first = ranked.filter("level <= ratio").agg(F.min(F.struct("ratio", "skey", "level")).alias("m")).select("m.level").first()[0]
    cap = F.col("cap").cast("double")
    target = cap if first is None else F.least(cap, F.lit(first) * F.col("weight"))
    return ranked.select("skey", "source_size", "weight", target.alias("target"), F.round(target).cast("long").alias("budget"))


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source: source_size, target, whole epochs, and the cut (ekey, doc_id, words) of the sample."""
    buckets = max(BUCKETS, rows.count() // PER_BUCKET)
    # a bucket's number rises with the key
    bucket = F.least(F.floor((1 - F.exp(-F.col("ekey") * LEAST_WEIGHT)) * buckets), F.lit(buckets - 1)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sums = settled(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    goals = settled(goals.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    few = goals.count()
    before = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")
    edges = sums.withColumn("before", before).join(small_or_not(goals, few), "skey")
    edges = edges.filter((F.col("rest") > 0) & (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
    edges = edges.select("skey", "bucket", "before", "rest")
    # only the bucket where the budget ends is put in order, repeats as one
    inside = rows.join(small_or_not(edges, few), ["skey", "bucket"]).groupBy("skey", "ekey", "doc_id", "before", "rest").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    order = Window.partitionBy("skey").orderBy("ekey", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("before", F.col("before") + F.sum("size").over(order) - F.col("size"))
    inside = inside.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
    each = F.floor((F.col("rest") - F.col("before")) / F.col("rows")).cast("long")
    cuts = inside.groupBy("skey").agg(F.min(F.struct("ekey", "doc_id", each.alias("words"))).alias("cut"))
    return settled(goals.join(cuts, "skey", "left").select("skey", "source_size", "target", "epochs", F.col("cut.ekey").alias("cut_ekey"), F.col("cut.doc_id").alias("cut_doc"), F.col("cut.words").alias("cut_words")))


def extra_words(size: Column, ekey: Column, doc_id: Column) -> Column:
    """Words beyond whole epochs: all before the cut, some at it, none after."""
    before = (ekey < F.col("cut_ekey")) | ((ekey == F.col("cut_ekey")) & F.coalesce(doc_id < F.col("cut_doc"), F.col("cut_doc").isNotNull() & doc_id.isNull()))
    at = (ekey == F.col("cut_ekey")) & doc_id.eqNullSafe(F.col("cut_doc"))
    return F.when(before, size).when(at, F.least(size, F.col("cut_words"))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each document."""
    rows = settled(sized(docs))
    plans = plan(rows, weights, most)
    out = rows.join(small_or_not(plans), "skey")
    taken = F.col("epochs") * F.col("size") + extra_words(F.col("size"), F.col("ekey"), F.col("doc_id"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: documents as often as it takes them, the one at a source's cut shortened to the
    words that fit. The columns are those of docs; n_chars, if there, follows a cut."""
    names = docs.columns
    plans = plan(settled(sized(docs)), weights, most)
    held, row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), F.col("row")
    held = held.select("row", source_key(row["source"]).alias("skey"), n_words(row["text"]).alias("size"), exponential(row["doc_id"], row["text"]).alias("ekey"))
    held = held.join(small_or_not(plans), "skey")
    held = held.withColumn("extra", extra_words(F.col("size"), F.col("ekey"), row["doc_id"]))
    whole = F.col("epochs") + F.when((F.col("extra") > 0) & (F.col("extra") == F.col("size")), 1).otherwise(0)
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.col("extra"))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<long>")))
    held = held.select("row", F.explode(copies).alias("cut"))
    text = row["text"]
    # what stands after the first `cut` words is the last field of a split into cut + 1
    tail = F.element_at(F.split(text, SPACE, F.col("cut").cast("int") + 1 + text.rlike("^" + SPACE).cast("int")), -1)
    short = F.when(F.col("cut") > 0, F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), SPACE + "$", "")).otherwise(text)
    return held.select(*[(short if c == "text" else F.when(F.col("cut") > 0, F.length(short)).otherwise(row[c]).cast(docs.schema[c].dataType) if c == "n_chars" else row[c]).alias(c) for c in names])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with sized as (
  select doc_id, source, case when source is null then '1' else '0' || source end as skey,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         -ln((('0x' || substr(md5('mix-1' || coalesce(cast(doc_id as varchar), '-' || md5(text), '')), 1, 12))::bigint::double + 1.0) / 281474976710656.0)
           / coalesce(greatest(0.25, 1.0::double / (1.0::double + 20.0::double * ((length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)))), 1.0) as ekey
  from documents),
sources as (select skey, cast(sum(size) as bigint) as source_size from sized group by skey),
weighed as (select *, [5, 2, 1][((row_number() over (order by skey) - 1) % 3 + 1)::int] as weight, source_size * 3 as cap from sources),
levels as (
  select *, cap / weight as ratio,
    (sum(source_size) over () - (sum(cap) over (order by cap / weight, skey rows between unbounded preceding and current row) - cap))::double
      / (sum(weight) over (order by cap / weight, skey rows between current row and unbounded following))::double as level
  from weighed),
level as (select arg_min(level, (ratio, skey)) as level from levels where level <= ratio),
goals as (
  select skey, source_size, least(cap::double, level.level * weight) as target from levels, level),
budgets as (
  select *, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as epochs, cast(round(target) as bigint) as budget from goals),
summed as (
  select s.doc_id, s.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size as rest,
    cast(sum(s.size) over (partition by s.skey order by s.ekey, s.doc_id rows between unbounded preceding and current row) as bigint) - s.size as before
  from sized s join budgets b using (skey))
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken
from summed
"""
