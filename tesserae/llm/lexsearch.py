"""Ranked lexical search: the k best documents of each query by summed term scores, by the three phases of TPUT.

Postings are a table partitioned by term: ranges of (term, score), the highest first, so a list is read from its head and a
term of most documents is spread over many files. What a document gets for a term depends on the two alone, so one table
serves all queries. For a query of m terms:

1. The first k postings of each of its lists are summed by document. The k-th highest sum is a lower bound of the k-th score.
2. The bound divided by m is the threshold of all its lists: postings that reach it are fetched, and summed by document. A
   document of which nothing was fetched stays under m times the threshold, so it is not among the k best. The k-th highest sum
   is a better bound; a document is a candidate if its sum, and the threshold for each term that was not fetched, reach it.
3. The candidates' scores for all terms are looked up, summed and ranked.

The fetched postings go by document, each once for all queries, and are written in blocks of whole documents. A task sums a
block for every query in arrays of bounded size: once for the better bounds, of which each block gives its k best sums, and
once more for the candidates under them. Queries are taken in blocks of some BLOCK_TERMS terms, so that what a
task holds of them is bounded. No number of candidates or postings is capped.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lowered. A document without terms is not
counted. Scores are whole numbers: w is floor(1000 ln((2N+2)/(2df+1))), m is 10 + (90 n N) div L, and a term adds
w ((1000000000 tf) div (1000 tf + 8 m)).

Defined cases: null and empty texts and queries match nothing; every row is a document, or a query, of its own, so rows that
repeat are all ranked, and repeated queries each get their answer; equal scores go by ascending id, those without an id last;
texts of any length are read whole; an empty table gives an empty result; other columns are left out.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.pick import top_by
from tesserae.session import materialise, ship

BLOCK_TERMS = 1 << 16  # terms of the queries that are answered together
CELLS = 1 << 21  # (query, document) sums that a task holds at once
SUMMED = 1 << 20  # postings times queries that are added at once
ROWS = 1 << 16  # rows of a batch

#: Bytes of a term as they are, A-Z lowered; all others separate.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ROWS = "row long, id long, n long, term binary, tf long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def term_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, n, term, tf): each row's terms. `row` numbers the rows of one reading, to be written before it is used twice.
    For each batch there is a row without a term: in tf how many of its texts have terms, in n how many terms these have."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [])
            docs = total = 0
            for i, body in zip(batch["_id"].to_pylist(), batch["_text"], strict=True):
                counts = Counter(terms_of(body.as_py()))
                if counts:
                    n = counts.total()
                    docs, total = docs + 1, total + n
                    for c, x in zip(held, ([row] * len(counts), [i] * len(counts), [n] * len(counts), counts.keys(), counts.values()), strict=True):
                        c.extend(x)
                row += 1
                if len(held[0]) >= ROWS:
                    yield rows(held)
                    held = ([], [], [], [], [])
            held[0].append(-1), held[1].append(None), held[2].append(total), held[3].append(None), held[4].append(docs)
            yield rows(held)

    def rows(held: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=["row", "id", "n", "term", "tf"])

    return texts.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, _ROWS)


def kth(sums: DataFrame, key: str, value: str, row: str, k: int) -> DataFrame:
    """(key, kth): the k-th highest value of each key that has so many."""
    best = top_by(sums.select(key, row, value), [key], [F.col(value).desc(), F.col(row)], k)
    return best.groupBy(key).agg(F.min(value).alias("kth"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")


def posting_lists(docs: DataFrame, terms: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lists). postings: row, id, term_no of the documents' terms that `terms` (term, term_no) has; lists: term_no,
    score, row for those that add to a score, partitioned by ranges of term and falling score."""
    found = term_rows(docs, key, text)
    none = docs.sparkSession.range(1).select(F.lit(b"").alias("term"), F.lit(-1).cast("long").alias("term_no"))
    named = terms.unionByName(none)  # of known size, so that Spark broadcasts it where it is small
    postings = materialise(found.withColumn("term", F.coalesce("term", F.lit(b""))).join(named, "term").select("row", "id", "n", "term_no", "tf"), "postings")
    whole = postings.where("term_no = -1").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = whole["docs"], max(whole["terms"], 1)
    postings = postings.where("term_no >= 0")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = postings.groupBy("term_no").agg(F.count("*").alias("df")).select("term_no", weight.alias("w")).where("w > 0")
    score = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {n_docs}L) div {n_terms}L)))")
    scored = postings.join(weights, "term_no").select("term_no", score.alias("score"), "row").where("score > 0")
    order = ["term_no", F.col("score").desc(), "row"]
    return postings, materialise(scored.repartitionByRange(*order).sortWithinPartitions(*order), "lists")


class Asked:
    """The terms of a block of queries. rows: (term_no, query, m, bound)."""

    def __init__(self, rows: list):
        terms, queries = np.array([a[0] for a in rows], np.int64), np.array([a[1] for a in rows], np.int64)
        self.queries, of = np.unique(queries, return_inverse=True)
        self.size, self.bound = np.zeros(len(self.queries), np.int64), np.zeros(len(self.queries), np.int64)
        self.size[of], self.bound[of] = [a[2] for a in rows], [a[3] for a in rows]
        order = np.argsort(terms, kind="stable")
        self.of = of[order]
        self.terms, self.first, self.wide = np.unique(terms[order], return_index=True, return_counts=True)

    def sums(self, doc: np.ndarray, docs: int, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query and document: the sum of the scores that reach the query's threshold, and how many do. at: places in terms."""
        cells = len(self.queries) * docs
        total, met = np.zeros(cells), np.zeros(cells, np.int64)
        ends = np.cumsum(self.wide[at])
        since = 0
        while since < len(at):
            upto = max(since + 1, int(np.searchsorted(ends, (ends[since - 1] if since else 0) + SUMMED, "right")))
            w = self.wide[at[since:upto]]
            p = np.repeat(np.arange(since, upto), w)
            q = self.of[np.arange(len(p)) - np.repeat(np.cumsum(w) - w, w) + self.first[at[p]]]
            over = score[p] * self.size[q] >= self.bound[q]
            cell = q[over] * docs + doc[p[over]]
            total += np.bincount(cell, score[p[over]], cells)  # whole numbers far below 2**53
            met += np.bincount(cell, minlength=cells)
            since = upto
        return total.astype(np.int64).reshape(-1, docs), met.reshape(-1, docs)


def fetched_blocks(fetched: DataFrame, asked: Asked) -> DataFrame:
    """(rows, terms, scores): the fetched postings by document, whole documents of some ROWS postings in a row; terms are places in asked.terms.
    fetched: row, term_no, score, those that reach the least threshold of their term."""
    ship(fetched.sparkSession)
    listed = asked.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch[c].to_numpy() for c in ("row", "term_no", "score")])
            n += batch.num_rows
            if n >= ROWS:
                row, term, score = map(np.concatenate, zip(*held, strict=True))
                done = int(np.searchsorted(row, row[-1]))  # the last document may go on
                if done:
                    yield packed(row[:done], term[:done], score[:done])
                held, n = [[row[done:], term[done:], score[done:]]], n - done
        if n:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    def packed(row: np.ndarray, term: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        parts = (row.astype("<i8"), np.searchsorted(listed, term).astype("<i4"), score.astype("<i8"))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["rows", "terms", "scores"])

    return fetched.repartition("row").sortWithinPartitions("row").select("row", "term_no", "score").mapInArrow(run, "rows binary, terms binary, scores binary")


def block_sums(blocks: DataFrame, asked: Asked, k: int, bounds: dict[int, int] | None) -> DataFrame:
    """(query, row, sum) of the k best documents of each block for each query; with bounds, of all that may still reach the query's."""
    ship(blocks.sparkSession)
    reach = None if bounds is None else np.array([bounds.get(q, 0) for q in asked.queries.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, CELLS // len(asked.queries))
        for batch in batches:
            for a, b, c in zip(batch["rows"], batch["terms"], batch["scores"], strict=True):
                row, term, score = np.frombuffer(a.as_buffer(), "<i8"), np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<i8")
                starts = np.flatnonzero(np.diff(row, prepend=-1))[::at_once].tolist()
                for since, upto in zip(starts, [*starts[1:], len(row)], strict=True):
                    docs, doc = np.unique(row[since:upto], return_inverse=True)
                    total, met = asked.sums(doc, len(docs), term[since:upto], score[since:upto])
                    if reach is None:
                        least = np.partition(total, -k, axis=1)[:, -k, None] if len(docs) > k else 0
                        q, d = np.nonzero((met > 0) & (total >= least))
                    else:
                        q, d = np.nonzero((met > 0) & (total * asked.size[:, None] + (asked.size[:, None] - met) * asked.bound[:, None] >= (reach * asked.size)[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked.queries[q], docs[d], total[q, d])], names=["query", "row", "sum"])

    return blocks.mapInArrow(run, "query long, row long, sum long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query_key, rank, key, score): each query's k highest-scoring documents, rank from 1."""
    spark = docs.sparkSession
    asked = materialise(term_rows(queries, query_key, query_text).where("term IS NOT NULL").select(F.col("row").alias("query"), F.col("id").alias("query_id"), "term"), "queries")
    terms = materialise(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_no")), "terms")
    postings, lists = posting_lists(docs, terms, key, text)
    live = materialise(asked.join(terms, "term").join(lists.select("term_no").distinct(), "term_no", "left_semi").select("query", "term_no"), "live")

    heads = top_by(lists, ["term_no"], [F.col("score").desc(), F.col("row")], k)
    sums = heads.join(live, "term_no").groupBy("query", "row").agg(F.sum("score").alias("sum"))
    bounds = live.groupBy("query").agg(F.count("*").alias("m")).join(kth(sums, "query", "sum", "row", k), "query", "left")
    bounds = bounds.select("query", "m", F.coalesce("kth", F.lit(0)).alias("bound"))
    blocks = max(1, -(-live.count() // block_terms))
    dealt = materialise(live.join(bounds, "query").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "bounds")

    candidates = spark.createDataFrame([], "query long, row long")
    for block in range(blocks):
        mine = dealt.where(F.col("block") == block)
        thresholds = mine.groupBy("term_no").agg(F.min(F.ceil(F.expr("bound / m"))).alias("least"))
        fetched = lists.join(thresholds, "term_no").where("score >= least")
        if held := mine.select("term_no", "query", "m", "bound").collect():
            asked_here = Asked(held)
            packed = materialise(fetched_blocks(fetched, asked_here), "fetched")
            better = {q: int(b) for q, b in zip(asked_here.queries.tolist(), asked_here.bound.tolist(), strict=True)}
            for r in kth(block_sums(packed, asked_here, k, None), "query", "sum", "row", k).collect():  # a number for each query of the block
                better[r["query"]] = max(better[r["query"]], r["kth"])
            candidates = candidates.unionByName(block_sums(packed, asked_here, k, better).select("query", "row"))
    candidates = materialise(candidates, "candidates")

    exact = candidates.join(live, "query").join(lists, ["term_no", "row"]).groupBy("query", "row").agg(F.sum("score").alias("score"))
    exact = materialise(exact, "scores")
    ids = postings.join(exact.select("row").distinct(), "row", "left_semi").select("row", "id").distinct()
    named = exact.join(ids, "row").join(asked.select("query", "query_id").distinct(), "query")
    ranked = top_by(named, ["query"], [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")], k, "rank")
    return ranked.select(F.col("query_id").alias(query_key), F.col("rank").cast("int"), F.col("id").alias(key), "score")
