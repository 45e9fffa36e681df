"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of ``documents`` (the last one adds its results). ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again as the next one's input.

Null texts and texts without a letter have no language and go in the first stage, so no later
one meets them; rows of null doc_id are never duplicates of one another; an empty table gives an
empty table with the result columns. Very long texts are taken whole. Repeated rows that share a
doc_id are one document to the near-duplicate stage: they stay or go together. Columns besides
doc_id, text, lang and n_chars pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, encoding, langid, line_dedup, minhash
from pagewright.llm._common import Shelf, documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The columns that operators read; all others pass through them under names of our own.
READ = ("doc_id", "text", "lang")


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every unread column renamed, so that none meets an operator's own columns, and
    where each column of ``docs`` is to be found."""
    places = {c: c if c in READ else f"_c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(at) for c, at in places.items()]), places


def _named(rows: DataFrame, places: dict[str, str], *more) -> DataFrame:
    return rows.select(*[F.col(at).alias(c) for c, at in places.items()], *more)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (``und``, or no language over one half) go."""
    plain, places = _plain(docs)
    model = langid.train(langid.training_rows(docs.select("doc_id", "text", "lang")))
    told = langid.predict(plain, model, id_columns=tuple(plain.columns))
    return _named(told.where("lang_pred != 'und' and score >= 0.5"), places)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; ``n_chars`` follows the text."""
    plain, places = _plain(docs)
    left = line_dedup.dedup_lines(plain, keep=tuple(c for c in plain.columns if c != "text"))
    if "n_chars" in places:
        left = left.withColumn(places["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return _named(left, places)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id."""
    lowered = docs.select("doc_id", F.translate("text", UPPER, LOWER).alias("text"))
    kept = minhash.near_duplicates(lowered).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    plain, places = _plain(docs)
    return _named(plain.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi"), places)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows over one word in twenty or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, places = _plain(docs)
    hits = decontaminate.find_hits(plain, benchmark, id_columns=tuple(plain.columns))
    return _named(hits.where(~decontaminate.contaminated()), places)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids, their count, and whether they decode to the text.

    A result whose name a column of ``docs`` has gets underscores in front until it is free."""
    plain, places = _plain(docs)
    coded = encoding.encode(plain, id_columns=tuple(plain.columns))
    taken, more = {c.lower() for c in places}, []
    for c in coded.columns[len(plain.columns) :]:
        name = c
        while name in taken:
            name = f"_{name}"
        more.append(F.col(c).alias(name))
    return _named(coded, places, *more)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", near_deduplicate),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Language ID and the pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
    return docs
