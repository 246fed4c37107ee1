"""A training-data pipeline over ``documents``: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared
folder and reads it back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import byte_bpe, language_id, line_dedup, near_texts, source_mix
from lamina.llm.common import materialize, named, unused


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those of none, such as null texts and those without a letter, go.

    The model learns from the rows that have a language. Repeated rows are judged each; an empty table gives no rows.
    """
    model = language_id.fit(docs, vocabularies.path("piece_bpe_32k.model"), where=~language_id.held_out(F.col("doc_id")))
    return language_id.accepted(docs, model)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; n_chars follows a text that has lost lines.

    No document goes. Null texts become empty ones; rows that repeat an id are one document, as are those of null id.
    """
    found = line_dedup.dedup_lines(docs)
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("row").getField("n_chars"))
    new = {"text": lambda: F.col("kept_text"), "n_chars": lambda: chars}
    return found.select(*[new.get(c, lambda c=c: F.col("row").getField(c))().alias(c) for c in docs.columns])


def texts_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of 5-word shingles of similarity 0.8 or more, found by SimHash.

    Of a group the smallest id stays, of rows that repeat it and its text one. Null and wordless texts are a group; rows
    of null id stay.
    """
    return near_texts.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled.

    Rows of a source without a target, or of none, are drawn with a mean of one. Rows that repeat an id are drawn alike.
    """
    names = tuple(unused(docs, n) for n in ("rate", "copy", "shuffle_key"))
    return source_mix.mix_sources(docs, names=names).select(*map(named, docs.columns))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to, instead of the text.

    Columns of docs pass, but for those of the names n_tokens, ids and decoded_sha256, which the results take.
    """
    made = ("n_tokens", "ids", "decoded_sha256")
    coded = byte_bpe.encode_documents(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, outputs=made)
    kept = [c for c in docs.columns if c != "text" and c.lower() not in made]
    return coded.select(*[F.col("row").getField(c).alias(c) for c in kept], *made)


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_once),
    ("simhash", texts_once),
    ("source_mixing", mixed),
    ("byte_bpe", tokenized),
]

#: Language identification, SimHash components and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
