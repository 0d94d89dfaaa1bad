import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tesserae.llm import alignment, bytebpe, queries
from tests.llm.util import DOC, SF, documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plainly():
    """Both encodings of a text by the libraries, as (id, bytes), or none."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = bytebpe.byte_letters()

    def encode(text):
        if not text:
            return [], []
        a = [(e, bytes(letters[c] for c in first.id_to_token(e))) for e in first.encode(f" {text}", add_special_tokens=False).ids]
        b = []
        for e in second.encode(text):
            p = second.id_to_piece(e)
            b.append((e, bytes([int(p[3:5], 16)]) if second.is_byte(e) else p.replace("▁", " ").encode()))
        whole = f" {text}".encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return encode


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(rows, plainly):
    """Each row's numbers by comparing all tokens with all."""
    links, out = [], []
    for _, text in rows:
        a, b = map(spans, plainly(text))
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        groups, ends = [], sorted({x[2] for x in a} & {y[2] for y in b})
        for since, upto in zip([0, *ends], ends, strict=False):
            groups.append(([x[0] for x in a if since < x[2] <= upto], [y[0] for y in b if since < y[2] <= upto]))
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append([len(a), len(b), len(groups), len(links[-1]), sum(len(g) * len(h) for g, h in groups), hashlib.sha256(line.encode()).hexdigest() if a else ""])
    count = Counter(p for x in links for p in set(x))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [(*o, sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x)) for o, x in zip(out, links, strict=True)]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_products", "groups_sha256", "n_best", "count_sum")
ODD = ["", None, " ", "  two", "▁marks", "<|endoftext|> and </s> <s>", "日本語 été", "\U0001f600\U0001f600x", "a\nb\r\n\tc", "’’s don't", "aaaaaaaaaaaaaaaaaaaaaa", "�", "x\u0000y", "ﬁ Å"]


def test_equals_comparing_all_tokens(spark, plainly):
    rng = np.random.default_rng(4)
    texts = [*ODD, *(t[:400] for t in documents().text.dropna().tolist()[:20])]
    texts += ["".join(rng.choice([c for c in "ab é日\n'0.\U0001f601"], 60).tolist()) for _ in range(30)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts, *texts[:9]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (alignment.BLOCK_CHARS, 900):
        got = alignment.align(df, A, B, block_chars=block).collect()
        want = [(d, *w) for (d, _), w in zip(rows, brute(rows, plainly), strict=True)]
        assert sorted(map(str, [(r.doc_id, *(r[n] for n in NAMES)) for r in got])) == sorted(map(str, want))
    assert sum(w[1] == 0 for w in want) >= 4


def test_intervals_groups_and_products():
    found = alignment.Alignment(np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([2, 3, 1]), np.array([3, 2, 1]))
    assert found.ends.tolist() == [2, 3, 5, 6] and found.of_a.tolist() == [0, 1, 1, 2] and found.of_b.tolist() == [0, 0, 1, 2]
    assert found.closes.tolist() == [False, False, True, True] and found.products().tolist() == [4, 1]
    left, right = found.expanded()
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]


def test_query(spark, plainly):
    rows = [(r.doc_id, r.text) for r in documents().itertuples()]
    got = {r.doc_id: r for r in queries.op12_alignment(spark, SF).collect()}
    assert len(got) == len(rows)
    links = {}
    for d, t in rows:  # the numbers that come from one text
        a, b = map(spans, plainly(t))
        ends = {x[2] for x in a} & {y[2] for y in b}
        pairs, j = [], 0
        for i, since, upto in a:
            while j and b[j][1] > since:
                j -= 1
            while b[j][2] <= since:
                j += 1
            k = j
            while k < len(b) and b[k][1] < upto:
                pairs.append((i, b[k][0]))
                k += 1
        links[d] = pairs
        assert (got[d].n_a, got[d].n_b, got[d].n_groups, got[d].n_links) == (len(a), len(b), len(ends), len(pairs))
    count = Counter(p for x in links.values() for p in set(x))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    for d, x in links.items():
        assert (got[d].n_best, got[d].count_sum) == (sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x))


def test_defined_cases(spark, tmp_path):
    rows = [(1, "word " * 60_000, "en", "a", 0), (2, None, None, None, None), (3, "again", "en", "a", 5), (3, "again", "en", "a", 5), (None, "no id", None, "b", 5)]
    df = spark.createDataFrame(rows, DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_a, r.n_b, r.count_sum) for r in queries.op12_alignment(spark, str(tmp_path)).collect())
    assert len(got) == 5 and (2, 0, 0, 0) in got and sum(g[0] == 3 for g in got) == 2 and max(g[1] for g in got) >= 60_000
    odd = df.selectExpr("*", "7 as n_a", "'x' as pairs", "8 as block", "9 as count", "1 as best")
    out = alignment.align(odd, A, B)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "pairs", "block", "count", "best", *NAMES]
    assert {r.doc_id: r.pairs for r in out.collect()}[2] == "x"
    assert alignment.align(df.limit(0), A, B).count() == 0 and alignment.align(df.where("text is null"), A, B).collect()[0].n_links == 0
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)


def test_both_libraries_read_the_vocabulary_alike():
    """Words of every code point, and the rank order of merges against the list of merges on random words."""
    own, other = bytebpe.ByteVocabulary(A), Tokenizer.from_file(A)
    rng = np.random.default_rng(8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    pieces = [t.decode() for t in own.tokens if t.isascii()]
    texts += ["".join(rng.choice(pieces, 60).tolist()) + "<|endoftext|>x" for _ in range(3000)]
    encode = own.encoder(special=True)
    for text, want in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == want.ids
