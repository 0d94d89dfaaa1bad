"""The pipeline's stages against plain Python."""

import re

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_linededup import brute
from tests.llm.util import DOC, SF, closure, documents


def shingle_set(text, n=5):
    """Five words each, A-Z lowered; fewer words are one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    k = min(n, len(words))
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def print5(text):
    """The SimHash of the text's shingles."""
    h = [xxhash.xxh64(p.encode(), 42).intdigest() for p in shingle_set(text)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def alike(texts):
    """All pairs whose sets of shingles have a similarity of 0.8 or more, by comparing all that share a shingle."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders, pairs = {}, []
    for d, s in sets.items():
        for p in s or {""}:
            holders.setdefault(p, []).append(d)
    met = {(a, b) for held in holders.values() for i, a in enumerate(held) for b in held[:i]}
    for a, b in met:
        common = len(sets[a] & sets[b])
        if not sets[a] and not sets[b] or common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            pairs.append((a, b))
    return pairs


ODD = [
    (1, "The people of the town went to the river and they sat there for a long while in the sun of the morning.", "en", "s", 1), (1, "The people of the town went to the river and they sat there for a long while in the sun of the morning.", "en", "s", 1),
    (2, None, None, None, None), (3, "", "en", "s", 0), (4, "word and other words of the house " * 30_000, None, "s", 5), (None, "A row without an id is kept as it is, with what it says of the people and the house.", "en", None, 9), (5, " \n ", "de", "s", 3), (6, "1234 ### 5678", "xx", "s", 9),
]


def test_every_stage_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC).selectExpr("*", "1 as lang_pred", "2 as quality_score", "3 as n_lines", "4 as component_id", "5 as start")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert sorted(ids, key=str) == [1, 1, 4, None] and {r.lang for r in rows} <= {"de", "en", "es", "fr"}
        if name == "quality":
            assert ids.count(1) in (0, 2)
        if name == "lines":
            assert sorted(ids, key=str) == sorted([r[0] for r in ODD], key=str) and {r.doc_id: r.text for r in rows}[4] == ODD[4][1]
        if name == "near_duplicates":
            assert sorted(ids, key=str) == [1, 1, 2, 4, 6, None]  # null, empty and blank texts are one group
        if name == "packing":
            assert set(ids) == {r[0] for r in ODD} and max(r.length for r in rows) <= 2048
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_are_caught(spark):
    """Copies with up to 1.8 % of their words changed, of texts of 60 to 600 words, and unrelated texts between them."""
    rng = np.random.default_rng(11)
    rows, groups = [], {}
    for g in range(120):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, int(rng.integers(60, 600)))]
        for c in range(4):
            new = list(words)
            for at in rng.choice(len(words), int(len(words) * 0.018 * c / 3), replace=False):
                new[at] = f"e{int(rng.integers(0, 10**6))}"
            rows.append((len(rows), " ".join(new)))
            groups[len(rows) - 1] = g
    texts = dict(rows)
    want = closure(sorted(texts), alike(texts))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOC)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert got == {d for d in texts if want[d] == d}
    caught = sum(d not in got for d in texts if d % 4) / (len(texts) * 3 / 4)
    assert caught >= 0.9 and all(d in got for d in texts if d % 4 == 0)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [documents()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        seen.append(docs.toPandas())
        assert name == "packing" or docs.columns == columns
    start, after_lang, after_quality, after_lines, after_near, packed = seen
    assert len(start) * 0.95 <= len(after_lang) <= len(start) and set(after_lang.doc_id) <= set(start.doc_id)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean, junk = set(labels[labels.quality == 1].doc_id) & set(after_lang.doc_id), set(labels[labels.quality == 0].doc_id)
    kept = set(after_quality.doc_id)
    assert len(clean & kept) >= 0.97 * len(clean) and len(junk & kept) <= 0.2 * max(len(junk), 1)
    want = brute([(int(r.doc_id), r.text) for r in after_quality.itertuples()])
    assert sorted((int(r.doc_id), r.text) for r in after_lines.itertuples()) == sorted((d, t) for d, _, _, t in want)
    assert (after_lines.n_chars == after_lines.text.str.len()).all()
    kept_lines = {int(r.doc_id): r.text for r in after_lines.itertuples()}
    ids = sorted(kept_lines)
    groups = closure(ids, alike(kept_lines))
    assert set(after_near.doc_id) == {i for i in ids if groups[i] == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in after_near.itertuples():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        own = packed[packed.doc_id == r.doc_id]
        assert own.length.sum() == n and set(own.doc_tokens) == {n}
    assert set(packed.doc_id) == set(after_near.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert np.all(out.toPandas().length > 0)
