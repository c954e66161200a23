"""A training-data pipeline over ``documents``: quality, near duplicates, repeated strings, source mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import jaccard, mixing, pieces, quality, suffix
from tallybrook.llm.common import bit_filter, remainder, shielded, staged, table
from tallybrook.llm.queries import MIX_WEIGHTS, PASSAGE_BYTES, PIECE_SAMPLES, PIECE_SEED, with_domain

#: Share of the tokens that the mixture may take, each document once.
MIX_SHARE = 0.9

#: Repeated passages of more words than this are removed.
PASSAGE_WORDS = 50


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that nearest-neighbour voting rejects; an empty text is scored like any other.

    The vote learns from the labelled rows of the ``documents`` table that aren't held out. A null text is scored as an empty one, null ids and
    other null columns stay as they are; rows that repeat are scored alike and stay or go together; a score of exactly one half
    is kept. An empty table stays empty.
    """
    known = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder("doc_id", 3) != 1)
    model = quality.fit(known, labels)
    docs, back = shielded(docs)
    return docs.withColumn("__score", quality.score(docs, model)).filter(F.col("__score") >= 0.5).drop("__score").withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of similar documents the one with the least id; rows without id are kept.

    Rows that repeat a kept id stay; null and empty texts are alike nothing. An empty table stays empty.
    """
    docs, back = shielded(docs)
    found = jaccard.join(docs)
    drop = staged(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    told = docs.withColumn("__may", F.coalesce(bit_filter(drop, "doc_id"), F.lit(False)))
    rest = told.filter("__may").join(drop, "doc_id", "left_anti").select(*docs.columns)
    return told.filter("not __may").select(*docs.columns).unionByName(rest).withColumnsRenamed(back)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str, passage_words: int | None = None) -> DataFrame:
    """Removes strings of 400 bytes or more that occur twice; characters cut in two go, and all rows stay.

    With ``passage_words``, runs of strings of PASSAGE_BYTES that occur twice go as well, if they hold over so many whole words.
    Null texts stay null, empty ones empty; texts that repeat (of 400 bytes or more) lose all of them, ties don't arise. An empty table stays empty.
    """
    some, none = suffix.repeated(docs, shorter=None if passage_words is None else PASSAGE_BYTES)
    if passage_words is not None:
        some = some.withColumn("repeat_spans", suffix.with_passages("text", "repeat_spans", "passage_spans", passage_words))
    cut = some.withColumn("text", F.when(F.size("repeat_spans") > 0, suffix.kept_text("text", "repeat_spans")).otherwise(F.col("text")))
    cut = cut.withColumn("n_chars", F.when(F.size("repeat_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns).unionByName(none.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``repeated_strings``, and passages of over PASSAGE_WORDS words that occur twice, which are often under 400 bytes.

    Both are judged on the texts as they come in. Passages of over so many words in under PASSAGE_BYTES stay.
    """
    return repeated_strings(spark, docs, sf_dir, PASSAGE_WORDS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes of each domain, language and source the token prefix that the weights allow; the document at the cut is kept whole.

    Each document is taken once at most, so domains with fewer tokens than their share come whole, and their shortage goes to
    the others. Null and empty texts have no tokens and stay if they come before the cut; repeated rows are rows of their own;
    ties in the seeded order go by id. An empty table stays empty.
    """
    return mixing.mix(with_domain(docs), ("domain", "lang", "source"), MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=1, seed=4).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text: doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids.

    A null or empty text has one sample without pieces; repeated rows get the same samples each; a null id comes as null. An
    empty table gives no rows. Columns other than id and text are ignored.
    """
    out = pieces.encode(docs, pieces.Vocabulary.load(), PIECE_SAMPLES, PIECE_SEED)
    return out.withColumn("doc_id", F.expr("try_cast(key as bigint)")).select("doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_passages),
    ("source_mixture", source_mixture),
    ("piece_encoding", piece_encoding),
]

#: Sampling and numeric models have no form in SQL. Tests compare near_duplicates and repeated_strings with brute force on the stage's own
#: input, and check what the other stages keep; their operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
