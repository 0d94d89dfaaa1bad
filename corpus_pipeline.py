"""The corpus pipeline: language ID, quality, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of `documents`.

Defined cases, for every stage: other columns than those of `documents` are left out; rows without an id go through
like any other, keep their lines and are no one's near-duplicate; repeated rows are judged alike, and of those the
near-duplicate stage keeps all, as they share the smallest id of their group; a very long text is read whole; an empty
table gives an empty one. Null and empty texts go in the first stage; where a later one is given them, they have a
quality score like any other, are one empty line, are near-duplicates of each other, and are packed as the end
token. Nulls in the other columns change nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import langid, linededup, packing, quality, simhash
from tesserae.llm.common import crc_mod
from tesserae.llm.queries import word_tokenizer_path
from tesserae.session import materialise
from tesserae.sources import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Language ID rejects what has no letters (`und`) or a fit to its language under this.
LEAST_FIT = 1.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that are unlike every language learned; lang becomes the predicted one.

    Learns from the rows of `documents` that op1 learns from.
    """
    model = langid.train(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) != 2)
    found = langid.identify(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_fit") >= LEAST_FIT))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under the quality cut; learns from the rows that op4 learns from."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality.grade(docs.select(*COLUMNS), model).where(F.col("quality_score") >= quality.CUT).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier document has; n_chars follows the text."""
    kept = linededup.drop_repeated_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near-duplicates, of words in fives.

    A link is a similarity of 0.8 or more; rows without an id stay, as they have no group.
    The ids that stay grow with the input, so they are merged in, never broadcast, at every size.
    """
    found = simhash.similar_documents(docs)
    stay = materialise(found.where("doc_id = component_id").select("doc_id").distinct(), "stay")
    return docs.join(stay.hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 tokens."""
    pieces = packing.pack(docs, word_tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("quality", good_quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", sequences)]

#: Trained models and token ids are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
