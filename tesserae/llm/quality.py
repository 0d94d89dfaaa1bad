"""Quality scores by Bradley-Terry pairwise ranking.

Every document has a strength, a linear function of bounded text statistics. For a preference pair
(better, worse) the probability that the better one wins is the logistic function of the difference of
their strengths; the weights minimise that logistic loss over sampled pairs. A quantile of the training
strengths is the threshold between good and bad; scores are logistic in the distance from it, so that
a strength at the threshold scores `cut` (0.3).

Defined cases: null texts count as empty ones; an empty text has a defined score like any other; without
training pairs every score is `cut`; a document with labels of both kinds counts as the lower one; repeated rows score alike; further input columns are kept as they are.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import WORD, code_points, unit_hash
from tesserae.session import ship

BINS = 12
CUT = 0.3
CHUNK = 1 << 18  # code points measured at once
WINDOW, REPEATS = 256, 40  # code points and words of the worst windows
_WHITE, _NEWLINE = re.compile(r"[\x20\x09-\x0D]"), re.compile("\n")

STATS = (
    "log_chars", "log_words", "log_lines", "upper", "lower", "digit", "space", "newline", "accented", "stops", "commas",
    "signs", "pipes", "quotes_brackets", "other_marks", "mark_runs", "word_length", "long_words", "short_words", "title_words",
    "words_then_sign", "words_then_stop", "distinct_words", "repeats_next", "commonest_word", "entropy", "line_repeats", "deflate",
    "worst_repeats_next", "worst_marks", "worst_upper", "worst_pipes",
)

_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """A class number for each code point below 256: 0 none, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 stop, 7 comma, 8 #*@$%&!, 9 |, 10 quotes and brackets, 11 other marks."""
    if not _CLASS:
        c = np.zeros(256, np.uint8)
        for i in range(256):
            ch = chr(i)
            c[i] = 1 if ch.isupper() else 2 if ch.isalpha() else 3 if ch.isdigit() else 5 if ch == "\n" else 4 if ch.isspace() else 6 if ch == "." else 7 if ch == "," else 8 if ch in "#*@$%&!?" else 9 if ch == "|" else 10 if ch in "\"'()[]{}<>" else 11
        _CLASS.append(c)
    return _CLASS[0]


def pieces(text: str, end: re.Pattern) -> Iterator[str]:
    """The text in pieces of CHUNK code points or more, each up to and with the next match of `end`."""
    at = 0
    while at < len(text):
        found = end.search(text, at + CHUNK - 1)
        stop = found.end() if found else len(text)
        yield text[at:stop]
        at = stop


def _by_character(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Counts of the classes, of the code points below 256 (255: and all above), of (non-ASCII, pairs of marks, words after white
    space with an upper letter, with a mark before it, with a stop), and the worst windows of marks, upper letters and pipes."""
    classes, letters, met, most = np.zeros(12, np.int64), np.zeros(256, np.int64), np.zeros(5, np.int64), [0.0, 0.0, 0.0]
    for at in range(0, len(text), CHUNK):
        back = min(at, WINDOW - 1)  # so that every window lies within a piece
        points = code_points(text[at - back : at + CHUNK])
        kind = np.where(points < 256, _classes()[np.minimum(points, 255)], np.uint8(2))
        most = [max(m, worst(hits, WINDOW)) for m, hits in zip(most, (kind >= 8, kind == 1, kind == 9), strict=True)]
        classes += np.bincount(kind[back:], minlength=12)
        letters += np.bincount(np.minimum(points[back:], 255), minlength=256)
        kind = kind[max(back - 1, 0) :]
        mark, blank = kind >= 8, (kind == 4) | (kind == 5)
        ends, begins = blank[1:] & ~blank[:-1], blank[:-1] & ~blank[1:]
        met += [x.sum() for x in (points[back:] > 127, mark[1:] & mark[:-1], begins & (kind[1:] == 1), ends & (kind[:-1] >= 8), ends & (kind[:-1] == 6))]
    return classes, letters, met, most


def _by_word(text: str) -> tuple[int, int, int, int, int, np.ndarray, float]:
    """The number of words, their code points, of long and of short ones, of those like the one before; their sorted hashes; the worst window of the like ones."""
    n = size = long = short = repeats = 0
    hashes, last, near, most = [], np.zeros(0, np.int64), np.zeros(0, bool), 0.0
    for piece in pieces(text, _WHITE):
        words = WORD.findall(piece)
        if not words:
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        own = np.fromiter(map(hash, words), np.int64, len(words))
        after = np.concatenate([last, own])
        same = after[1:] == after[:-1]
        near = np.concatenate([near[1 - REPEATS :], same])
        most = max(most, worst(near, REPEATS))
        n, size, long, short, repeats = n + len(words), size + int(sizes.sum()), long + int((sizes > 14).sum()), short + int((sizes < 3).sum()), repeats + int(same.sum())
        last = own[-1:]
        hashes.append(own)
    ids = np.concatenate([*hashes, np.zeros(0, np.int64)])
    ids.sort()
    return n, size, long, short, repeats, ids, most


def _filled_lines(text: str) -> tuple[int, int]:
    """The number of lines that are not blank, and of distinct ones, by hash."""
    found = [np.zeros(0, np.int64)]
    for piece in pieces(text, _NEWLINE):
        found.append(np.array([hash(x) for x in piece.split("\n") if x.strip()], np.int64))
    ids = np.concatenate(found)
    ids.sort()
    return len(ids), int((ids[1:] != ids[:-1]).sum()) + min(len(ids), 1)


def statistics(text: str | None) -> np.ndarray:
    """STATS of the whole text, a piece at a time. Words and lines are compared by hash; only their equality within the text counts."""
    text = text or ""
    n = max(len(text), 1)
    deflated = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1))
    classes, letters, (accented, runs, titles, signs, stops), most = _by_character(text)
    lines, distinct_lines = _filled_lines(text)
    words, size, long, short, repeats, ids, worst_repeats = _by_word(text)
    w = max(words, 1)
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if words else np.zeros(0, np.int64)
    top = float(np.diff(np.append(starts, words)).max() / w) if words else 0.0
    share, letters = classes / n, letters / n
    letters = letters[letters > 0]
    values = [
        np.log1p(len(text)), np.log1p(words), np.log1p(text.count("\n") + 1), share[1], share[2], share[3], share[4], share[5], accented / n, share[6], share[7],
        share[8], share[9], share[10], share[11], runs / n, size / w, long / w, short / w, titles / w,
        signs / w, stops / w, len(starts) / w, repeats / max(words - 1, 1), top, float(-(letters * np.log(letters)).sum()), 1 - distinct_lines / max(lines, 1), deflated / n,
        worst_repeats, *most,
    ]
    return np.array(values, np.float32)


def worst(hits: np.ndarray, span: int) -> float:
    """The largest count of hits in any `span` neighbours, as a share: junk may be a part of a text only."""
    if not len(hits):
        return 0.0
    total = np.concatenate([[0], np.cumsum(hits)])
    wide = min(span, len(hits))
    return float((total[wide:] - total[:-wide]).max() / span)


@dataclass
class QualityModel:
    """edges: bin edges of each statistic; weights: of the steps; threshold, slope: from strength to score."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    quantile: float

    def expand(self, raw: np.ndarray) -> np.ndarray:
        return expand(raw, self.edges)

    def strength(self, raw: np.ndarray) -> np.ndarray:
        return self.expand(raw) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(raw) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column for each edge of each statistic: 1 above it."""
    return (raw[:, :, None] > edges[None]).reshape(len(raw), -1).astype(np.float32)


def fit(raw: np.ndarray, good: np.ndarray, pairs: int = 40_000, rounds: int = 300, ridge: float = 2e-4, seed: int = 7) -> QualityModel:
    """Learns from preference pairs of every good row over sampled bad ones, and the reverse."""
    width = len(STATS) * (BINS - 1)
    if not len(raw) or good.all() or not good.any():
        return QualityModel(np.zeros((len(STATS), BINS - 1), np.float32), np.zeros(width, np.float32), 0.0, 1.0, 0.0)
    balanced = np.concatenate([raw[good], np.repeat(raw[~good], max(1, int(good.sum() // max((~good).sum(), 1))), axis=0)])
    edges = np.quantile(balanced, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    x = expand(raw, edges)
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    a, b = up[rng.integers(0, len(up), pairs)], down[rng.integers(0, len(down), pairs)]
    w = z = np.zeros(x.shape[1], np.float32)
    step = 4.0 / (np.square(x).sum(1).mean() * 2)
    for k in range(rounds):
        s = x @ z  # the difference of features enters through the difference of strengths
        pull = 1 / (1 + np.exp(np.clip(s[a] - s[b], -40, 40)))
        by_row = np.bincount(a, pull, len(x)) - np.bincount(b, pull, len(x))
        new = z + step * ((x.T @ by_row.astype(np.float32)) / pairs - ridge * z)
        z, w = new + (k / (k + 3)) * (new - w), new
    s = x @ w
    ordered = np.sort(s)
    # the score quantile that best divides the two labels, each label weighing the same
    candidates = np.linspace(0.005, 0.9, 180)
    values = np.quantile(ordered, candidates)
    balance = [((s[good] >= v).mean() + (s[~good] < v).mean()) for v in values]
    q = int(np.argmax(balance))
    return QualityModel(edges, w, float(values[q]), 1.0, float(candidates[q]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 6000, seed: int = 3) -> QualityModel:
    """Fits on a bounded sample of labelled rows: about `sample` of them, half for each label if there are
    enough, chosen by a hash of the key. Their ids, whose number that bound proves, are broadcast; each
    row sends its statistics (128 bytes) to the driver."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, F.col(label).alias("_good")).groupBy(key).agg(F.min("_good").alias("_good"))
    counts = {r["_good"]: r["n"] for r in known.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return fit(np.zeros((0, len(STATS)), np.float32), np.zeros(0, bool))
    share = F.when(F.col("_good") == 1, F.lit(min(1.0, sample / 2 / counts[1]))).otherwise(F.lit(min(1.0, sample / 2 / counts[0])))
    picked = known.where(unit_hash(F.col(key), seed) < share)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked.withColumnRenamed(key, "_id")), "_id").select("_good", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_good"].cast(pa.int32()), pa.array([statistics(t.as_py()).astype(np.float32).tobytes() for t in batch["text"]], pa.binary())], names=["good", "x"])

    got = rows.mapInArrow(measured, "good int, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["good"], r["x"]))
    raw = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(len(got), len(STATS))
    return fit(raw, np.array([r["good"] == 1 for r in got], bool))


def grade(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds quality_score (0 to 1) and quality_strength to every row; one pass, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    fields = [f for f in docs.schema.fields if f.name not in ("quality_score", "quality_strength")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(at, 256)
                raw = np.array([statistics(t.as_py()) for t in part[text]], np.float32).reshape(part.num_rows, len(STATS))
                score, strength = shared.value.score(raw), shared.value.strength(raw)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score.astype(np.float64)), pa.array(strength.astype(np.float64))], names=[*batch.schema.names, "quality_score", "quality_strength"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_strength", T.DoubleType())]))
