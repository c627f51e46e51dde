"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm import jaccard, langid, mix, packing, refine
from twinlake.llm.common import located, without
from twinlake.llm.workers import TEXT_BATCH, batches_of
from twinlake.sources.scratch import materialize, scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the language models accept. They learn from the labelled rows of ``docs`` outside the held-out fifth.

    NULL and empty texts, and those without a letter, go, as does what is unlike every language; in a language with too
    few texts to set a limit nothing else goes, and without any label every text with a letter stays. Very long texts
    are scored whole, repeated rows alike. An empty table stays empty.
    """
    rows = located(docs)
    with scope(spark) as own, batches_of(spark, TEXT_BATCH):
        model = langid.fit(rows.where(langid.remainder(F.col("doc_id"), 5) != 0), required=False)
        rejected = langid.predictor(model)(F.col("text"))["rejected"]
        gone = own.keep(rows.where(rejected).select("__row"))
    return without(rows, gone, "__row").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) keep the row with the largest id, of rows with that id one.

    A NULL text is the empty text, a NULL id smaller than any other. An empty table stays empty.
    """
    rows = located(docs)
    with scope(spark) as own:
        groups = refine.exact_groups(rows, carry=("__row",))
        gone = own.keep(groups.where("NOT kept").select("__row"))
    return without(rows, gone, "__row").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word Jaccard similarities of 0.8 or more keep the row with the smallest id.

    NULL, empty and blank texts are one group. Of rows that share the smallest id one stays; a NULL id is larger than
    any other. An empty table stays empty.
    """
    rows = located(docs)
    with scope(spark) as own:
        groups = jaccard.near_texts(rows, carry=("__row",))
        gone = own.keep(groups.where("NOT kept").select("__row"))
    return without(rows, gone, "__row").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the documents of a source are alike.

    A document without words is never taken; a NULL source is a source of its own, the last. Repeated rows are
    documents of their own. An empty table stays empty.
    """
    sized = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", mix.word_count("text").alias("size"))
    mixed = mix.pareto_mix(sized, "doc_id", "source", "size").where("copies > 0")
    copies = mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select("doc.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; NULL and empty texts are their end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_tokens),
]

#: Character models and a tokenizer are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope(spark) as own:
            docs = own.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
