"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines tells language families apart (one machine for each
family against the rest, or a single one for two). Within the family it chose, one-versus-one linear
machines separate the related languages and vote. All machines read the same hashed character n-gram
frequencies (2- to 4-grams) of the whole text.

The machines always name one of the languages that they know. `lang_fit` says how far to believe it: the likeness of the
text to the mean of that language, over the least that training texts of such a length have (a low quantile, lowered
once more); under 1, the text is unlike everything that was learned.

Defined cases: a null or letterless text is `und` with score 0; repeated rows and ties of any column
are scored row by row, and votes that tie go to the larger sum of margins, then to the first language in
alphabetical order; no usable training row makes every answer `und`; further input columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import alpha_table, code_points, unit_hash
from tesserae.session import ship

UNKNOWN = "und"
LENGTHS = (12, 40, 150, 600)  # characters that divide the classes of length
LOW, LOWERED = 0.01, 0.6  # the quantile of training likenesses, and its share, that a known language has at least
MOST_ROWS = 50_000  # feature rows on the driver, whatever the number of languages
DIMS = 4096
CHUNK = 1 << 18  # code points turned into n-grams at once

# ISO 639-1 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def features(text: str | None) -> np.ndarray | None:
    """Unit-length square-root frequencies of hashed 2- to 4-grams; None if there is no letter.

    Letters are lowered, everything else counts as one space between words. Long texts are counted in
    chunks that overlap by three code points, so the counts cover the whole text.
    """
    if not text:
        return None
    points = code_points(text.lower())
    letters = alpha_table()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letters[1:] | letters[:-1]
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    counts = np.zeros(DIMS)
    for at in range(0, len(points), CHUNK):
        own = min(CHUNK, len(points) - at)
        piece = points[at : at + CHUNK + 3]
        mixed = piece * np.uint32(0x9E3779B1)
        rolled = mixed
        for n in range(1, 5):
            if n > 1:
                rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + mixed[n - 1 :]
            if n != 1:
                counts += np.bincount(((rolled[:own] ^ (rolled[:own] >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> np.uint32(20), minlength=DIMS)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 120) -> np.ndarray:
    """Weights, bias last, that minimise |w|^2 / 2 + c * mean weighted squared hinge loss; y is -1 or 1.

    Both classes weigh the same whatever their sizes. Accelerated gradient steps, deterministic.
    """
    x = np.hstack([x, np.full((len(x), 1), 0.3, x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (1 + 2 * c * 1.1)
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * c * (x.T @ (share * y * slack)))
        z, w = new + (k / (k + 3)) * (new - w), new
    w = w.copy()
    w[-1] *= 0.3
    return w


@dataclass
class LanguageModel:
    """families: names; family_w: a row for each machine of the first layer; members: languages by
    family; pairs: for each family (first, second) language positions and their weights; means: the mean features of
    each language; floors: the least likeness to it, by class of length."""

    families: list[str]
    family_w: np.ndarray
    members: list[list[str]]
    pairs: list[tuple[list[tuple[int, int]], np.ndarray]]
    means: dict[str, np.ndarray]
    floors: np.ndarray
    slope: float = 5.0

    def _odds(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -50, 50)))

    def predict(self, text: str | None) -> tuple[str, float, str, float]:
        """The language, how sure it is (0 to 1), its family, and the fit."""
        x = features(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0, UNKNOWN, 0.0
        lang, sure, family = self.classify(x)
        return lang, sure, family, float(x @ self.means[lang] / self.floors[np.searchsorted(LENGTHS, len(text), "right")])

    def classify(self, x: np.ndarray) -> tuple[str, float, str]:
        if len(self.families) == 1:
            f, sure = 0, 1.0
        else:
            margins = self.family_w[:, :-1] @ x + self.family_w[:, -1]
            if len(self.families) == 2:
                f, sure = (0, self._odds(margins[0])) if margins[0] >= 0 else (1, self._odds(-margins[0]))
            else:
                odds = self._odds(margins)
                f = int(np.argmax(odds))
                sure = odds[f] / max(odds.sum(), 1e-12)
        names, (pairs, w) = self.members[f], self.pairs[f]
        if len(names) == 1:
            return names[0], float(sure), self.families[f]
        margins = w[:, :-1] @ x + w[:, -1]
        votes, total, odds = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for (a, b), m in zip(pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            odds[a] += self._odds(m)
            odds[b] += self._odds(-m)
        best = max(range(len(names)), key=lambda i: (votes[i], total[i], -i))
        return names[best], float(sure * odds[best] / (len(names) - 1)), self.families[f]


def least_likeness(likeness: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each class of length what a text of a known language has at least; it grows with the length."""
    of = np.searchsorted(LENGTHS, lengths, "right")
    out, least = [], 1e-6
    for c in range(len(LENGTHS) + 1):
        own = likeness[of == c]
        least = max(least, LOWERED * float(np.quantile(own, LOW))) if len(own) >= 20 else least
        out.append(least)
    return np.array(out)


def fit(x: np.ndarray, langs: list[str], lengths: np.ndarray | None = None) -> LanguageModel:
    """Trains both layers on feature rows, their languages and the texts' lengths."""
    langs_ = np.array(langs, dtype=object)
    known = sorted(set(langs))
    families = sorted({family_of(v) for v in known})
    of = np.array([families.index(family_of(v)) for v in langs], dtype=int)
    one = 2 if len(families) == 2 else len(families)
    layer = [linear_svm(x, np.where(of == f, 1, -1).astype(np.float32)) for f in range(one if one != 2 else 1)] if len(families) > 1 else []
    members, pairs = [], []
    for f in range(len(families)):
        names = [v for v in known if family_of(v) == families[f]]
        combos = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
        weights = []
        for a, b in combos:
            rows = (langs_ == names[a]) | (langs_ == names[b])
            weights.append(linear_svm(x[rows], np.where(langs_[rows] == names[a], 1, -1).astype(np.float32)))
        members.append(names)
        pairs.append((combos, np.array(weights, np.float32).reshape(len(combos), DIMS + 1)))
    means = {v: x[langs_ == v].mean(axis=0) for v in known}
    means = {v: m / max(np.linalg.norm(m), 1e-12) for v, m in means.items()}
    likeness = np.array([x[i] @ means[v] for i, v in enumerate(langs)])
    floors = least_likeness(likeness, np.zeros(len(langs)) if lengths is None else lengths)
    return LanguageModel(families, np.array(layer, np.float32).reshape(len(layer), DIMS + 1), members, pairs, means, floors)


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 700, seed: int = 1) -> LanguageModel:
    """Fits on a bounded sample: about `per_lang` rows of each language, chosen by a hash of the key.

    usable: the rows that may be learned from. The counts of the languages come from all of them; the
    sample's feature rows (8 kB each, MOST_ROWS of them at most about) come to the driver.
    """
    ship(docs.sparkSession)
    rows = docs.where(usable & F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, DIMS), np.float32), [])
    per_lang = min(per_lang, MOST_ROWS // len(counts))
    share = F.coalesce(*[F.when(F.col(lang) == F.lit(v), F.lit(min(1.0, per_lang / n))) for v, n in counts.items()])
    picked = rows.where(unit_hash(F.col(key), seed) < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(v, f.astype(np.float16).tobytes(), len(t)) for v, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) if (f := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64())))], names=["lang", "x", "length"])

    got = picked.mapInArrow(featured, "lang string, x binary, length long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["x"], r["length"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), DIMS)
    return fit(x, [r["lang"] for r in got], np.array([r["length"] for r in got]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1), lang_family and lang_fit to every row; one pass, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    added_names = ("lang_pred", "lang_score", "lang_family", "lang_fit")
    fields = [f for f in docs.schema.fields if f.name not in added_names]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                got = [shared.value.predict(t.as_py()) for t in batch[text]]
                added = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *added_names])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType() if n in ("lang_score", "lang_fit") else T.StringType()) for n in added_names)])
    return docs.mapInArrow(run, schema)
