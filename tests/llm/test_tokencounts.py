import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import queries, tokencounts
from tests.llm.util import DOC, SF, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def odd_texts():
    rng = np.random.default_rng(5)
    parts = ["a", "aaaaaaa", " ", "  ", "\n", "\n\n \n", "'", "''", "'s", "'ll", "don't", "<|endoftext|>", "<|endof", "text|>", "|>!!", "12345", "é", "日本語", "\U0001f600", "word", " word", "...", "!!", "\t", "x" * 30, " " * 21, "̈", "__init__", "İ"]
    yield from ("".join(rng.choice(parts, 400).tolist()) for _ in range(120))
    yield from ("".join(rng.choice(parts[:8], 600).tolist()) for _ in range(40))
    yield from (p * (3000 // len(p)) for p in parts)
    yield "a" * 2001 + "b" + "日" * 999 + "'" * 777 + "s" + " " * 555 + "x"
    yield "".join(chr(int(c)) for c in rng.integers(97, 123, 3000))  # one word
    yield "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FFF, 1500))


@pytest.mark.parametrize(("chunk", "overlap"), [(44, 44), (64, 48), (257, 50), (512, 128)])
def test_pieces_equal_the_library(library, chunk, overlap):
    counter = tokencounts.ByteCounter(PATH, chunk, overlap)
    for text in odd_texts():
        assert counter.count_long(text) == library(text), repr(text[:80])


def test_ids_are_spliced_and_not_only_counted():
    counter = tokencounts.ByteCounter(PATH, 64, 48)
    for text in odd_texts():
        left, right = tokencounts.Piece(counter, text, 0, 300), tokencounts.Piece(counter, text, 150, 500)
        found = left.splice(right)
        if found is not None:
            whole = counter.ends(text[:500])[0].tolist()
            assert [*left.ids[: found[0]], *right.ids[found[1] :]] == whole
            assert right.after(found[1]).ids.tolist() == counter.ends(text[right.after(found[1]).since : 500])[0].tolist()


def test_overlaps_widen_where_nothing_aligns(library):
    counter = tokencounts.ByteCounter(PATH, 101, 48)
    reads = []
    ends = counter.ends
    counter.ends = lambda t: (reads.append(len(t)), ends(t))[1]
    text = "a" * 5000  # tokens of several letters, whose phase depends on where a piece begins
    assert counter.count_long(text) == library(text)
    assert 149 < max(reads) < 1500  # widened, and yet never the whole text


def test_long_texts_are_read_in_pieces(library):
    counter = tokencounts.ByteCounter(PATH)
    sizes = []
    ends = counter.ends
    counter.ends = lambda t: (sizes.append(len(t)), ends(t))[1]
    text = " ".join(documents().text.dropna().tolist())[:400_000]
    assert counter.counts([text]) == [library(text)]
    assert max(sizes) <= tokencounts.CHUNK + tokencounts.OVERLAP and len(sizes) == 13


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencounts.ByteCounter(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="splice"):
        tokencounts.ByteCounter(PATH, 100, 10)


def test_query(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, SF).collect()}
    want = {r.doc_id: (len((r.text or "").encode()), n := library(r.text), n > 1024) for r in documents().itertuples()}
    assert got == want and any(v[2] for v in want.values())


def test_defined_cases(spark, library, tmp_path):
    rows = [(1, "word " * 60_000, "en", "a", 0), (2, None, None, None, None), (3, "again", "en", "a", 5), (3, "again", "en", "a", 5), (None, "no <|endoftext|> id", None, "b", 5), (4, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, str(tmp_path)).collect()))
    assert got == sorted((d or 0, len((t or "").encode()), library(t), library(t) > 1024) for d, t, *_ in rows)
    odd = df.selectExpr("*", "7 as n_tokens", "'x' as over_limit", "8 as ids")
    out = tokencounts.count_tokens(odd, PATH, 0)
    assert out.columns == [*df.columns, "ids", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: r.over_limit for r in out.collect()}[2] is False and out.count() == 6
    assert tokencounts.count_tokens(df.limit(0), PATH, 5).count() == 0
