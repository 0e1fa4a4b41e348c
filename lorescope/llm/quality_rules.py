"""Quality rules in DataFrame functions alone: counts of a text, and how far its histograms lie from its language's.

Each document has a histogram of character classes and one of its language's common words (and all
others). Common words are the eight that most documents of the language have. The Jensen-Shannon distances (base 2, 0
to 1) to the language's reference are held to limits, if the document is long enough for its histogram to mean
something, and the reference too. A reference is the sum over the corpus's plain documents in that language: those
that pass the base rules, repeat no line and have few symbols.

Nothing is shuffled but partial counts: languages are counted, and up to BROADCAST_ROWS of them meet the documents by
broadcast.

Defined results. A null or blank text has no words and fails the base rules. A null lang is a language of its own,
as is every other value. Repeated rows are judged alike, a very long text whole (windows of three words are compared
by 64-bit hash), an empty table gives no row, and only doc_id, text and lang are read.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, settled, small_or_not, text_or_empty

#: Base rules: fewest words, largest percentage of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Common words of a language, and words that a reference has at least.
COMMON, LEAST_REFERENCE = 8, 10_000
#: The divergences count from this number of words on, and these are the largest that pass.
JUDGED_WORDS, MOST_CHARS, MOST_COMMON = 80, 0.18, 0.24
#: A plain document has at least so many words for each symbol.
PLAIN_SYMBOLS = 50


def repeated_words(words: Column, n_words: Column) -> Column:
    """The three-word windows in order, as (t, p): a hash of the words, and the place.

    Equal neighbours give the places of repeated windows, and their union is measured. n log n in a text's length.
    """
    m = F.greatest(n_words - (WINDOW - 1), F.lit(0))
    places = F.slice(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), 1, m)
    return F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("t"), i.alias("p"))))


def _places(ordered: Column) -> Column:
    rest = F.slice(ordered, 2, 2**30)
    same = F.zip_with(ordered, rest, lambda a, b: F.coalesce(a["t"] == b["t"], F.lit(False)))
    return F.transform(F.filter(F.arrays_zip(ordered["p"].alias("p"), same.alias("next"), F.array_prepend(same, F.lit(False)).alias("last")), lambda x: (x["next"] | x["last"]) & x["p"].isNotNull()), lambda x: x["p"])


def _covered(places: Column) -> Column:
    steps = F.zip_with(places, F.slice(places, 2, 2**30), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def worded(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null: empty), text (null: empty) and w, its words."""
    df = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty().alias("text"))
    return df.withColumn("w", F.array_remove(F.split("text", SPACE), ""))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common): the words that most documents have, ties by code point. Only the first of each task go on."""
    # explode() would have the words split twice, once for a filter on their number
    seen = worded(docs).select("lang", F.explode_outer(F.array_distinct("w")).alias("word")).filter("word is not null").groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    first = seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= COMMON)
    return first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("common"))


def counts(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms as arrays of counts. common: (lang, common)."""
    text = F.col("text")
    df = worded(docs).join(small_or_not(common), "lang", "left").withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "found": F.filter("w", lambda x: F.array_contains(F.col("common"), x)),
            "n_chars": F.length(text).cast("long"),
            "lower": F.length(F.regexp_replace(text, "[^a-z]+", "")).cast("long"),
            "upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
            "digits": F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("long"),
            "extra_bytes": (F.octet_length(text) - F.length(text)).cast("long"),
        }
    )
    df = df.withColumn("ordered", repeated_words(F.col("w"), F.size("w"))).drop("text", "lines", "w")
    df = df.withColumn("places", F.sort_array(_places(F.col("ordered")))).drop("ordered")
    df = df.withColumn("n_repeat_words", _covered(F.col("places")).cast("long"))
    mine = [F.coalesce(F.size("found") - F.size(F.array_remove(F.col("found"), F.get("common", F.lit(k)))), F.lit(0)).cast("long").alias(f"c{k}") for k in range(COMMON)]
    df = df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "lower", "upper", "digits", "extra_bytes", *mine)
    marks = F.greatest(F.col("word_chars") - F.col("lower") - F.col("upper") - F.col("digits") - F.col("extra_bytes") - F.col("n_symbols"), F.lit(0).cast("long"))
    chars = F.array("lower", "upper", "digits", "extra_bytes", "n_symbols", F.col("n_chars") - F.col("word_chars"), marks)
    some = [F.col(f"c{k}") for k in range(COMMON)]
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), F.array(*some, F.col("n_words") - sum(some[1:], some[0])).alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(counted: DataFrame) -> DataFrame:
    """For each language both histograms summed over its plain documents, if they have LEAST_REFERENCE words."""
    sums = [F.sum(F.col("chars")[k]) for k in range(7)], [F.sum(F.col("common")[k]) for k in range(COMMON + 1)]
    plain = counted.filter(~base_failed() & (F.col("n_dup_lines") == 0) & (PLAIN_SYMBOLS * F.col("n_symbols") <= F.col("n_words")))
    summed = plain.groupBy("lang").agg(F.array(*sums[0]).alias("ref_chars"), F.array(*sums[1]).alias("ref_common"), F.sum("n_words").alias("words"))
    return summed.filter(F.col("words") >= LEAST_REFERENCE).drop("words")


def divergence(counts: Column, ref: Column, n: int) -> Column:
    """Jensen-Shannon distance of two histograms of n counts; null if one is empty."""
    parts = [[c[k].cast("double") for k in range(n)] for c in (counts, ref)]
    sums = [sum(p[1:], p[0]) for p in parts]
    total = F.lit(0.0)
    for a, b in zip(*parts, strict=True):
        p, q = a / F.nullif(sums[0], F.lit(0.0)), b / F.nullif(sums[1], F.lit(0.0))
        mid = (p + q) / 2
        for x in (p, q):
            total = total + F.when(x > 0, x * F.log2(x / mid)).otherwise(F.when(x == 0, F.lit(0.0))) / 2
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judged(docs: DataFrame) -> DataFrame:
    counted = settled(counts(docs, settled(common_words(docs))))
    out = counted.join(small_or_not(settled(references(counted))), "lang", "left")
    far = (F.coalesce(divergence(F.col("chars"), F.col("ref_chars"), 7), F.lit(0.0)).alias("char_distance"), F.coalesce(divergence(F.col("common"), F.col("ref_common"), COMMON + 1), F.lit(0.0)).alias("word_distance"))
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), *far)
    strange = (F.col("n_words") >= JUDGED_WORDS) & ((F.col("char_distance") > MOST_CHARS) | (F.col("word_distance") > MOST_COMMON))
    return out.withColumn("kept", ~F.col("base_failed") & ~strange)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def js(c, r, n):
        p = [f"({c}[{k}]::double / nullif(list_sum({c})::double, 0))" for k in range(1, n + 1)]
        q = [f"({r}[{k}]::double / nullif(list_sum({r})::double, 0))" for k in range(1, n + 1)]
        one = lambda x, a, b: f"(case when {x} > 0 then {x} * log2({x} / (({a} + {b}) / 2)) when {x} = 0 then 0 end) / 2"
        return f"coalesce(sqrt(greatest({' + '.join(f'{one(a, a, b)} + {one(b, a, b)}' for a, b in zip(p, q, strict=True))}, 0)), 0)"

    return rf"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
split as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from docs),
seen as (
  select lang, word, row_number() over (partition by lang order by count(*) desc, word) as place
  from (select lang, unnest(list_distinct(w)) as word from split) group by lang, word),
commons as (select lang, list(word order by place) as own from seen where place <= {COMMON} group by lang),
placed as (
  select rid, unnest(range(1, len(w) - 1)) as p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t
  from split where len(w) >= 3),
again as (select rid, p from (select *, count(*) over (partition by rid, t) as n from placed) where n > 1),
repeated as (select rid, count(distinct p + k) as n_repeat_words from again, (select unnest([0, 1, 2]) as k) group by rid),
counted as (
  select s.*, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^a-z]+', '', 'g')) as lo, length(regexp_replace(text, '[^A-Z]+', '', 'g')) as up,
    length(regexp_replace(text, '[^0-9]+', '', 'g')) as dig, strlen(text) - length(text) as extra, length(text) as n_chars,
    list_transform(range(1, {COMMON + 1}), lambda k: len(list_filter(w, lambda x: x = own[k]))) as c
  from split s left join repeated using (rid) left join commons using (lang)),
hist as (
  select *, [lo, up, dig, extra, n_symbols, n_chars - word_chars, greatest(word_chars - lo - up - dig - extra - n_symbols, 0)] as chars,
    list_append(c, n_words - list_sum(c)) as common, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from counted),
refs as (
  select lang, [{', '.join(f'sum(chars[{k}])' for k in range(1, 8))}] as rc, [{', '.join(f'sum(common[{k}])' for k in range(1, COMMON + 2))}] as rw
  from hist where not base_failed and n_dup_lines = 0 and {PLAIN_SYMBOLS} * n_symbols <= n_words group by lang having sum(n_words) >= {LEAST_REFERENCE}),
far as (
  select hist.*, {js('chars', 'rc', 7)} as dc, {js('common', 'rw', COMMON + 1)} as dw from hist left join refs using (lang))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_words >= {JUDGED_WORDS} and (dc > {MOST_CHARS} or dw > {MOST_COMMON})) as kept
from far
"""


OP10_SQL = _sql()
