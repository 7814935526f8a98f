"""A training-corpus pipeline: quality rules, near duplicates, secrets, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
``run`` writes every stage's result to the shared folder and reads it again for the next. SQL can express
neither the Markov model of the third stage nor the encoding of the last, so there is no oracle; tests hold the stages
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import bpe_codec, jaccard_join, line_quality, mixing, secrets
from tallystone.llm.common import MADE, drop_staged, staged
from tallystone.llm.queries import read_file, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without frequent lines; ``n_chars`` follows the text.

    Null, empty and short texts fail; texts of any length are judged whole. A null source is a host of its own. Repeated rows pass
    or fail alike and each stay. A frequent line stays in the document of smallest id that holds it. Empty tables stay
    empty; extra columns of any name pass through.
    """
    return line_quality.passing(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id (null last).

    Five-word shingles and a similarity of 0.8. Wordless texts are no copies of each other and stay. Rows alike in id and text
    become one. Empty tables stay empty; extra columns of any name pass through.
    """
    return jaccard_join.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text.

    Null and empty texts stay as they are, overlapping secrets get one mark, repeated rows each stay. Empty tables stay
    empty; extra columns of any name pass through.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, at most three times.

    A null source is a source. Documents without words are never taken. Rows alike in all columns are exchangeable, all
    others keep their own columns; ties of the random order go by size. Empty tables stay empty; extra columns pass through.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text.

    A null or empty text has no tokens; texts of any length are encoded whole; repeated rows each get a result. An empty
    table gives an empty result; other columns are not read.
    """
    return bpe_codec.bpe_encode(docs, read_file("word_bpe_49k.json"), memo=80_000).drop("decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixture", mixture), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``. What a stage staged for itself goes when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
