import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import packing, queries
from tests.llm.util import DOC, SF, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def reassembled(rows, window):
    """Ids by (doc, total) after checking that pieces tile documents and sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return by_doc, by_sequence


ODD = ["", None, "It's 12½ O'REILLY'S naïve_café -- ²x", "İstanbul ΣΑΣ", "é combined", "a\x1cb\x85c\xa0d", "\U0001f600 ok", "ǅ ǆ ŉ ß ſ", "x" * 500 + " é" * 90 + "ß" * 60, " ", "\n"]
SPECIAL = ["a <|endoftext|> b", "a<|endoftext|>", "<|ENDOFTEXT|> x", "é<|startoftext|>\u0301", "<|endoftext"]


def as_library(tokenizer, texts):
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_encode_like_the_library(tokenizer):
    fast = packing.WordTokenizer(PATH)
    texts = [*ODD, *SPECIAL, *documents().text.tolist()]
    assert [i.tolist() for i in fast.ids(texts)] == as_library(tokenizer, texts)
    assert fast.ids(["a <|endoftext|> b"])[0].tolist() == [320, 49407, 321]
    assert fast.ids([]) == [] and [len(i) for i in fast.ids([None, "", " "])] == [0, 0, 0]


@pytest.mark.parametrize("chunk", [1, 40, 3000])
def test_parts_of_any_size_give_the_same_ids(monkeypatch, tokenizer, chunk):
    monkeypatch.setattr(packing, "CHUNK", max(chunk, 8))
    texts = [*ODD, *documents().text.tolist()[:30]]
    assert [i.tolist() for i in packing.tokenizer_of(PATH).ids(texts)] == as_library(tokenizer, texts)


def plainly_packed(sizes, window, most, slack):
    """The sequences as lists of (doc, start, length), by the rule in plain words; the last may be short."""
    opened, out = [], []
    for doc, size in enumerate(sizes):
        start = 0
        while size - start >= window:
            out.append([(doc, start, window)])
            start += window
        while start < size:
            rest = size - start
            filled = [sum(p[2] for p in w) for w in opened]
            fitting = [i for i, f in enumerate(filled) if f + rest <= window]
            if fitting:
                i = max(fitting, key=lambda k: (filled[k], -k))
                take = rest
            elif len(opened) < most:
                opened.append([])
                i, take = len(opened) - 1, rest
            else:
                i = max(range(len(opened)), key=lambda k: (filled[k], -k))
                take = window - filled[i]
                if take <= slack:
                    out.append(opened.pop(i))
                    continue
            opened[i].append((doc, start, take))
            start += take
            if sum(p[2] for p in opened[i]) == window:
                out.append(opened.pop(i))
    rest = sorted(opened, key=lambda w: -sum(p[2] for p in w))
    tokens = [(d, s + k) for w in rest for d, s, n in w for k in range(n)]
    for at in range(0, len(tokens), window):
        piece = []
        for d, s in tokens[at : at + window]:
            if piece and piece[-1][0] == d and piece[-1][1] + piece[-1][2] == s:
                piece[-1] = (d, piece[-1][1], piece[-1][2] + 1)
            else:
                piece.append((d, s, 1))
        out.append(piece)
    return out


def test_packer_against_a_plain_one():
    rng = np.random.default_rng(3)
    for most, slack in ((1, 0), (4, 3), (16, 8)):
        sizes = [*rng.integers(1, 90, 300).tolist(), 64, 64, 32, 32, 700]
        packer, got = packing.Packer(64, most, slack), []
        for doc, size in enumerate(sizes):
            got += packer.add(doc, 0, np.arange(size, dtype="<u4"), size)
        got += packer.merge()
        shown = [[(d, s, len(i)) for d, s, i, _ in pieces] for pieces in got]
        assert all(i[0] == s for pieces in got for _, s, i, _ in pieces)
        assert shown == plainly_packed(sizes, 64, most, slack)


def test_one_tokenizer_for_each_worker():
    assert packing.tokenizer_of(PATH) is packing.tokenizer_of(PATH)


def test_query_packs_everything(spark, tokenizer):
    got = queries.op6_packing(spark, SF).toPandas()
    total = 0
    for r in documents().itertuples():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        pieces = got[got.doc_id == r.doc_id].sort_values("start")
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and total / (2048 * len(sizes)) > 0.99


def test_windows_and_leftovers(spark, tokenizer):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 90)))) for i in range(700)] + [(None, "null id"), (9000, None), (9001, ""), (9002, "long " * 5000), (9003, "twice"), (9003, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as offset", "2 as ids").repartition(6)
    got = packing.pack(df, PATH, window=64, open_windows=5, slack=2, merge=2).collect()
    by_doc, by_sequence = reassembled(got, 64)
    want = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault((d, len(ids)), []).extend(ids)
    assert {k: sorted(sum((i for _, i in v), [])) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    tokens = sum(map(len, want.values()))
    short = [s for s in (sum(x[1] for x in v) for v in by_sequence.values()) if s < 62]
    assert len(short) <= 3 and tokens / (64 * len(by_sequence)) > 0.97
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_a_very_long_text_and_repeated_rows_through_the_query(spark, tmp_path):
    rows = [(1, "word " * 300_000, "en", "a", 0), (2, None, None, None, None), (3, "again", "en", "a", 5), (3, "again", "en", "a", 5), (None, "no id", None, "b", 5)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_packing(spark, str(tmp_path)).toPandas()
    assert got.length.sum() == 300_001 + 1 + 2 * 2 + 3 and got.groupby("sequence_id").length.sum().max() == 2048
    assert sorted(got[got.doc_id == 1].sort_values("start").length.cumsum())[-1] == 300_001
