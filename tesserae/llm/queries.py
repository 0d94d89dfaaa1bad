"""The registered queries of this subpackage, one for each operator, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import alignment, katz, langid, lexsearch, linededup, mergedropout, packing, quality, sharding, simhash, syncmers, tokencounts, vectorjoin
from tesserae.llm.common import crc_mod
from tesserae.sources import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_family")


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz scores of every document; a tenth of the ids is held out of the counts."""
    return katz.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every embedding at a cosine of 0.9 or more, and its component."""
    found = vectorjoin.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; a fifth of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    graded = quality.grade(docs.select("doc_id", "text"), model)
    return graded.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.CUT).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document has."""
    docs = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def word_tokenizer_path() -> str:
    """The vocabulary file that the packing queries use, where the package that holds it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash fingerprint of every document and the smallest document it is linked with."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout, and the digest of its text decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = mergedropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    decoded = mergedropout.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The syncmer fingerprint of every document and of its edited text."""
    return syncmers.compare_edits(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, in the Hilbert order of source, language and size."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + sharding.OVERHEAD
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", size.alias("size"), crc.alias("text_crc32"))
    out = sharding.shard(docs, 40, ["source", "lang", "size"], ["doc_id", "text_crc32"], "size", "rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document by two vocabularies, aligned, and how common their links are in all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they are more than 1024."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).drop("text")


QUERIES = {f.__name__: f for f in (op1_language, op2_perplexity, op3_vectors, op4_quality, op5_line_dedup, op6_packing, op7_simhash, op8_merge_dropout, op9_fingerprint, op10_sharding, op11_search, op12_alignment, op13_token_counts)}
#: The others learn, hash or tokenise in ways that SQL has no form for; tests hold them against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op3_vectors": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r (node, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT node, p.b FROM r JOIN p ON p.a = reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY 1)
SELECT node AS vec_id, coalesce(n_links, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON node = a""",
    "op11_search": r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, len(terms) AS n FROM t WHERE len(terms) > 0), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op5_line_dedup": """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, h.first IS NULL OR h.first = doc_id AS kept FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '')) AS kept_sha256 FROM f GROUP BY 1""",
}
