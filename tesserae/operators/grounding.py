"""Containment joins: quotes in the texts that they claim to come from."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import normalize, occurs, span
from tesserae.operators.grams import Hasher, kind_of, per_text
from tesserae.session import materialise, ship


def admit(candidates: DataFrame, texts: DataFrame, on: str, quote: str, text: str) -> DataFrame:
    """candidates with admitted, source_start and source_end: a quote is admitted if it occurs, normalised, in
    its own text, and has a span if it occurs literally. Quotes without a text are not admitted.

    A text is made normal once, not for each of its quotes; texts are merged in, never broadcast, at every size.
    """
    joined = candidates.join(texts.select(on, F.col(text).alias("_text"), normalize(F.col(text)).alias("_normal")).hint("merge"), on, "left")
    found = span(F.col("_text"), F.col(quote))
    return joined.withColumn("admitted", F.coalesce(occurs(F.col("_normal"), F.col(quote)), F.lit(False))).withColumn("source_start", found["start"]).withColumn("source_end", found["end"]).drop("_text", "_normal")


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of the filter that goes to every worker: 128 KB to 32 MB
PART = 1 << 19  # characters of texts whose grams are made at once


def containing(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str) -> DataFrame:
    """(quote_id, text_id) for every normalised, non-empty quote that a normalised text contains, as often as the rows meet.

    A text that contains a quote has all of its grams: the runs of up to three whole words inside it, or of up to six
    characters where it has under three words. The scan of the texts keeps the grams that a filter of the quotes' grams lets
    through: bits by hash, 16 for each gram and 32 MB at the most, so it is no larger with more quotes, it only lets through
    more. The grams that are left say in how many texts each is. A quote is looked up by its rarest alone, and one with a
    gram that no text has is not looked up. What is found is compared in full where the texts are read.

    Texts are read twice, however many quotes there are; no quote comes to the driver. Spark picks the joins by size.
    """
    q = materialise(quotes.select(F.col(quote_id).alias("_qid"), normalize(F.col(quote)).alias("_quote")).where("_quote <> ''"), "quotes")
    t = texts.select(F.col(text_id).alias("_tid"), normalize(F.col(text)).alias("_text"))
    grams = materialise(_quote_grams(q.select("_quote").distinct()), "grams")
    size = grams.agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds")).first()  # a kind is a number from -6 to 3
    bits = min(max(LEAST_BITS, 1 << (16 * size["n"]).bit_length()), MOST_BITS)
    met = materialise(_text_grams(t, sorted(size["kinds"]), _bits(grams, bits), bits), "met")
    rarity = met.groupBy("gram").agg(F.count("*").alias("_texts"))
    keyed = grams.join(rarity, "gram", "left").groupBy("_quote").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("_texts"), "gram")).alias("_k"))
    keyed = keyed.where("_k._texts > 0").select("_quote", "_k.gram")
    asked = met.join(keyed, "gram").select(F.col("_tid").alias("_asked"), "_quote").distinct()
    whole = texts.select(F.col(text_id).alias("_tid"), F.col(text).alias("_body"))  # made normal only where a quote is looked up
    found = whole.join(asked, whole["_tid"].eqNullSafe(asked["_asked"])).where(F.contains(normalize(F.col("_body")), F.col("_quote"))).select("_tid", "_quote")
    return found.join(q, "_quote").select(F.col("_qid").alias(quote_id), F.col("_tid").alias(text_id))


def _quote_grams(quotes: DataFrame) -> DataFrame:
    """(_quote, kind, gram) of distinct quotes: the grams that a text with the quote must have."""
    ship(quotes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch["_quote"].to_pylist()
            kinds = np.array([kind_of(x) for x in texts], np.int64)
            for kind in np.unique(kinds).tolist():
                rows = np.flatnonzero(kinds == kind)
                of, hashes = per_text(*hasher.grams([texts[i] for i in rows.tolist()], [kind], inside=True))
                yield pa.RecordBatch.from_arrays([batch["_quote"].take(pa.array(rows[of])), pa.array(np.full(len(of), kind)), pa.array(hashes.view(np.int64))], names=["_quote", "kind", "gram"])

    return quotes.mapInArrow(run, "_quote string, kind long, gram long")


def _bits(grams: DataFrame, bits: int) -> np.ndarray:
    """The filter: a bit for each gram. Spark sets the bits in pieces of a fixed size, of which the driver gets `bits` / 32768 at the most."""
    place = F.pmod("gram", F.lit(bits)) + 1
    pieces = grams.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        piece = np.frombuffer(r["m"], np.uint8)
        out[(r["b"] - 1) * len(piece) :][: len(piece)] = piece
    return out


def _text_grams(texts: DataFrame, kinds: list[int], held: np.ndarray, bits: int) -> DataFrame:
    """(_tid, gram): the grams of each text, once each, that the filter lets through."""
    spark = texts.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(held)
    types = T.StructType([texts.schema["_tid"], T.StructField("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(), sent.value
        for batch in batches:
            bodies = batch["_text"].to_pylist()
            at = 0
            while at < len(bodies):
                upto, chars = at, 0
                while upto < len(bodies) and (upto == at or chars + len(bodies[upto] or "") <= PART):
                    chars += len(bodies[upto] or "")
                    upto += 1
                of, hashes = hasher.grams([b or "" for b in bodies[at:upto]], kinds)
                bit = hashes & np.uint64(bits - 1)
                through = (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                of, hashes = per_text(of[through], hashes[through])
                yield pa.RecordBatch.from_arrays([batch["_tid"].take(pa.array(of + at)), pa.array(hashes.view(np.int64))], names=["_tid", "gram"])
                at = upto

    return texts.mapInArrow(run, types)
