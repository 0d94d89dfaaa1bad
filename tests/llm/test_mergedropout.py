import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from tesserae.llm import mergedropout, queries
from tests.llm.util import SF, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "tabs\tand\n\nbreaks\n", "naïve ﬁ \U0001f600 \x00 end", "▁ literal ▁▁ space", "<s> </s> <0x0A> <unk>", "x" * 3000, "the " * 4000, "ab\r\ncd", "trailing   "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


def test_without_dropout_it_is_the_library(library):
    encoder = mergedropout.DropoutEncoder(PATH, 0)
    for t in [*documents().text.tolist(), *(o for o in ODD if "▁" not in o and "\0" not in o)]:
        assert ids(encoder.encode(t, 1)) == library.encode(t), t[:60]


def test_dropout_is_lossless_varied_and_repeatable(library):
    one, two = mergedropout.DropoutEncoder(PATH, 0.2, 1), mergedropout.DropoutEncoder(PATH, 0.2, 2)
    plain = mergedropout.DropoutEncoder(PATH, 0)
    longer = differ = 0
    for k, t in enumerate([*documents().text.tolist(), *ODD]):
        a, b = one.encode(t, k), two.encode(t, k)
        assert one.decode(a) == two.decode(b) == t
        assert a == mergedropout.DropoutEncoder.encode(one, t, k)
        longer += len(a) - len(plain.encode(t, k))
        differ += a != b
    assert longer > 0 and differ > 150


def draw(number, turn):
    """The keyed hash of a candidate's turn as a number from 0 to 1, in plain integers."""
    m = (1 << 64) - 1
    x = (number + (turn + 1) * 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return ((x ^ (x >> 31)) >> 11) / 2**53


def plainly_encoded(encoder, text, key):
    """The ids by scanning all pairs for every turn, over the library's pieces as strings."""
    stretches, ids = re.findall(r"\n| *[^ \n]+| +", " " + text if text else ""), []
    base = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), encoder.seed)
    for nth, stretch in enumerate(stretches):
        number = int(mergedropout._mix(np.array([(base + nth * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
        parts = [("\0" if c == "▁" else "▁" if c == " " else c, False) for c in stretch]  # (symbol, whether it was passed over with the next)
        turn = 0
        while True:
            open_ = [(encoder.scores[a + b][0], i) for i, ((a, out), (b, _)) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in encoder.scores and not out]
            if not open_:
                break
            i = min(open_)[1]
            turn += 1
            if draw(number, turn - 1) < encoder.dropout:
                parts[i] = (parts[i][0], True)
                continue
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], False)]
            if i:
                parts[i - 1] = (parts[i - 1][0], False)
        for s, _ in parts:
            ids += [encoder.scores[s][1]] if s in encoder.scores else [int(encoder.bytes[b]) for b in ("▁" if s == "\0" and "\0" not in stretch else s).encode()]
    return ids


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_against_a_plain_agenda(dropout):
    encoder = mergedropout.DropoutEncoder(PATH, dropout, 7)
    texts = [*documents().text.tolist()[:25], *(o[:200] for o in ODD if "\0" not in o), "ab " * 30, "internationalisation" * 4]
    for k, t in enumerate(texts):
        assert ids(encoder.encode(t[:1500], k)) == plainly_encoded(encoder, t[:1500], k), t[:60]


def test_heap_and_arrays_agree(monkeypatch):
    encoder = mergedropout.DropoutEncoder(PATH, 0.3, 5)
    texts = [*documents().text.tolist()[:60], *ODD]
    whole = encoder.encode_all(texts, list(range(len(texts))))
    for long, chunk in ((1, 1 << 17), (6, 50), (10_000, 1 << 17)):
        monkeypatch.setattr(mergedropout, "LONG", long)
        monkeypatch.setattr(mergedropout, "CHUNK", chunk)
        some = texts if long < 10_000 else [t for t in texts if len(t) < 2500]
        got = encoder.encode_all(some, [texts.index(t) for t in some])
        if len(some) == len(texts):
            assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()
        else:
            parts = np.split(whole[0], np.cumsum(whole[1])[:-1])
            assert got[0].tolist() == np.concatenate([parts[texts.index(t)] for t in some]).tolist()


def test_rate_and_total_dropout():
    encoder = mergedropout.DropoutEncoder(PATH, 1.0)
    assert [encoder.out[i] for i in ids(encoder.encode("abc d", 1))] == [b" ", b"a", b"b", b"c", b" ", b"d"]
    for rate in (0.1, 0.5):
        half = mergedropout.DropoutEncoder(PATH, rate)
        numbers = np.arange(200_000, dtype=np.uint64) * np.uint64(12_345_678_901)
        for turn in (0, 1, 7):
            assert abs(half.skipped(numbers, turn).mean() - rate) < 0.005


def test_query(spark):
    got = {r.doc_id: r for r in queries.op8_merge_dropout(spark, SF).collect()}
    for r in documents().itertuples():
        g = got[r.doc_id]
        assert g.lossless and g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_defined_cases(spark):
    rows = [(1, None), (None, "no key here"), (2, ""), (3, "repeated rows"), (3, "repeated rows"), *[(10 + i, t) for i, t in enumerate(ODD)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as decoded", "2 as _key")
    got = mergedropout.decode(mergedropout.encode(df, PATH), PATH)
    assert set(got.columns) == {"doc_id", "text", "_key", "ids", "n_tokens", "decoded"}
    out = got.collect()
    assert len(out) == len(rows) and all(r.decoded == r.text for r in out)
    assert len({bytes(r.ids) for r in out if r.doc_id == 3}) == 1
    assert mergedropout.encode(df.limit(0), PATH).count() == 0


def test_every_occurrence_has_draws_of_its_own():
    encoder = mergedropout.DropoutEncoder(PATH, 0.1)
    plain = mergedropout.DropoutEncoder(PATH, 0)
    ways = {encoder.encode("international", k) for k in range(3000)}
    assert len(ways) > 20 and plain.encode("international", 0) in ways
    assert len({encoder.encode("a text of some words for the copies", k) for k in range(300)}) > 50
    undropped = sum(encoder.encode("international", k) == plain.encode("international", 0) for k in range(3000)) / 3000
    assert 0.9**13 - 0.03 < undropped < 0.9  # a passed-over pair may still come to the same pieces
