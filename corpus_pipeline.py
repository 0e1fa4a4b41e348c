"""A corpus from documents to packed token sequences, in five stages.

toxicity drops what scores 0.5 or more; near_dedup keeps one document, with the smallest id, of each
group tied by five-word shingle sets of similarity 0.8 or more; secrets replaces secrets by their kind; mixing repeats, samples and cuts
documents so that sources meet their target weights; packing cuts the tokens into sequences and
returns each piece with its ids (little-endian unsigned 32-bit), the place of its document in the stream of
tokens, by which repeats of a document are told apart, and its place in a sequence.
"""

import uuid

from lorescope.llm import mixing, near_copies, packing, secrets, toxicity
from lorescope.llm.common import shared_dir


def drop_toxic(spark, docs, sf_dir):
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark, docs, sf_dir):
    return near_copies.deduplicated(docs)


def redact_secrets(spark, docs, sf_dir):
    return secrets.redacted(docs, secrets.train(docs))


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(packing.tokenize(docs), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, hashes and tokens have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages on documents; each result is written to the shared folder and read again."""
    df, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, df, sf_dir).write.parquet(f"{at}/{name}")
        df = spark.read.parquet(f"{at}/{name}")
    return df
