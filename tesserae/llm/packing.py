"""Packing of token sequences by bounded-space online best fit.

Each scan partition streams its documents past a fixed number of open windows of `window` tokens. A
document's full windows leave at once; its rest goes to the open window that it fits best. When none
fits, the fullest window is emitted and the rest opens a new one; a gap of over `slack` tokens in that
window is first filled with the rest's head. At the end the windows still open are merged, cut freely,
into full ones, and one window at most is left over. The leftovers of `merge` neighbouring partitions
are merged in the same way in a second, small step, so a padded window is left for each such group.

The result has a row for each piece with its ids (little-endian unsigned 32-bit). Sequence ids carry the
partition and a running number; the offset of a piece is its place in its sequence, gapless from 0.

Defined cases: null and empty texts are the end token alone; rows are packed one by one, so repeated
rows and null document ids are packed as they stand; a text of any length is cut into windows; an empty
table gives an empty result; other columns are ignored.
"""

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.bpe import PairTable, merge_by_turns
from tesserae.session import materialise, ship

WINDOW = 2048
OPEN = 64
SLACK = 8
MERGE = 64
END = 1
CHUNK = 1 << 20  # characters whose words are encoded at once
LONG = 48  # bytes beyond which a word goes to the library
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, partition long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.binary() if " binary" in x else pa.int64() for x in PIECES.split(", ")]

#: Words as the vocabulary's own pattern splits them, for text below U+0300 only.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_PLAIN = re.compile(r"[^\x1c-\x1fİ̀-\U0010ffff]*")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(prints)))}


class WordTokenizer:
    """The tokenizer of a vocabulary file for many texts at once: their words go through one agenda in arrays.

    Words of over LONG bytes go to the library's model one by one; texts with letters beyond U+0300, or with a special
    token's literal text, go through the library whole. Nothing is kept from text to text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))})
        self.letters = byte_letters()
        self.none = max(vocab.values()) + 1
        self.inner, self.last = (np.array([vocab[chr(c) + tail] for _, c in sorted(self.letters.items())], np.int32) for tail in ("", end))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's ids end; equal words go through the agenda once."""
        number: dict[str, int] = {}
        code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        ids, ends = self._distinct(list(number))
        sizes = np.diff(ends, prepend=0)
        size = sizes[code]
        stops = np.cumsum(size)
        return ids[np.arange(stops[-1] if len(stops) else 0) + np.repeat((ends - sizes)[code] - (stops - size), size)], stops

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = f" {' '.join(words)} ".encode()
        raw = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(raw == 32)
        symbol = self.inner[raw]
        symbol[spaces[1:] - 1] = self.last[raw[spaces[1:] - 1]]
        symbol[spaces] = self.none
        first, sizes = spaces[:-1] + 1, np.diff(spaces) - 1
        short = sizes <= LONG
        alive = merge_by_turns(self.pairs, symbol, first[short], sizes[short])
        for at, n in zip(first[~short].tolist(), sizes[~short].tolist(), strict=True):
            ids = [t.id for t in self.tokenizer.model.tokenize(data[at : at + n].decode("latin-1").translate(self.letters))]
            alive[at : at + n] = np.arange(n) < len(ids)
            symbol[at : at + len(ids)] = ids
        alive[spaces] = False
        return symbol[alive].astype("<u4"), np.cumsum(np.add.reduceat(alive, spaces[:-1], dtype=np.int64)) if len(words) else np.zeros(0, np.int64)

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(text, words) for parts of texts, and at once (text, None) where the library has to encode it whole."""
        for i, text in enumerate(texts):
            lowered = text.lower() if text and _PLAIN.fullmatch(text) else None
            if lowered is None or any(s in lowered for s in self.special):
                yield i, None
            elif len(lowered) <= CHUNK:
                yield i, _SPLIT.findall(lowered)
            else:
                words = (m.group() for m in _SPLIT.finditer(lowered))
                while part := list(islice(words, CHUNK // 8)):
                    yield i, part

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int]] = []  # (text, words so far)
        words: list[str] = []

        def flush() -> None:
            ids, ends = self._words(words)
            stops = np.append(0, ends)[[n for _, n in held]].tolist()
            for (i, _), start, stop in zip(held, [0, *stops[:-1]], stops, strict=True):
                out[i].append(ids[start:stop])
            held.clear()
            words.clear()

        bulk = 0
        for i, part in self._parts(texts):
            if part is None:
                out[i].append(np.array(self.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, "<u4"))
                continue
            words += part
            held.append((i, len(words)))
            bulk += sum(map(len, part))
            if bulk >= CHUNK:
                flush()
                bulk = 0
        if held:
            flush()
        return [parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts]) for parts in out]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker process's tokenizer, kept with its cache from task to task; one at a time."""
    if path not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN, slack: int = SLACK):
        self.window, self.most, self.slack = window, open_windows, slack
        self.windows: list[list] = []  # [tokens, pieces]

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Yields the pieces of each sequence that this piece completes."""
        at = 0
        while len(ids) - at >= self.window:
            yield [(doc, start + at, ids[at : at + self.window], total)]
            at += self.window
        while at < len(ids):
            size = len(ids) - at
            fitting = [w for w in self.windows if w[0] + size <= self.window]
            if fitting:
                best = max(fitting, key=lambda w: w[0])
            elif len(self.windows) < self.most:
                self.windows.append(best := [0, []])
            else:
                best = max(self.windows, key=lambda w: w[0])
                gap = self.window - best[0]
                if gap <= self.slack:
                    self.windows.remove(best)
                    yield best[1]
                    continue
                size = gap
            best[1].append((doc, start + at, ids[at : at + size], total))
            best[0] += size
            at += size
            if best[0] == self.window:
                self.windows.remove(best)
                yield best[1]

    def merge(self) -> Iterator[list]:
        """Merges the open windows, the fullest first, into full sequences; the last may be shorter."""
        pieces = [p for w in sorted(self.windows, key=lambda w: -w[0]) for p in w[1]]
        self.windows, held, room = [], [], self.window
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[:room]
                held.append((doc, start, part, total))
                room -= len(part)
                start, ids = start + len(part), ids[len(part) :]
                if not room:
                    yield held
                    held, room = [], self.window
        if held:
            yield held


def _rows(pieces: list, sequence: int, partition: int | None) -> list[tuple]:
    offset, out = 0, []
    for doc, start, ids, total in pieces:
        out.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset, partition))
        offset += len(ids)
    return out


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_TYPES), _TYPES, strict=True)]


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, open_windows: int = OPEN, slack: int = SLACK, merge: int = MERGE) -> DataFrame:
    """PIECES without `partition`: every token of every document, each document ended by token 1, in one piece."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        tokenizer, packer, made, held, bulk = tokenizer_of(tokenizer_path), Packer(window, open_windows, slack), 0, [], 0
        for batch in batches:
            parts = (batch.slice(at, 256) for at in range(0, batch.num_rows, 256))
            for doc, ids in ((d, i) for p in parts for d, i in zip(p["doc_id"].to_pylist(), tokenizer.ids(p["text"].to_pylist()), strict=True)):
                ids = np.append(ids, np.array([END], "<u4"))
                for pieces in packer.add(doc, 0, ids, len(ids)):
                    held += _rows(pieces, (me << 32) + made, None)
                    made, bulk = made + 1, bulk + window
                    if bulk >= 1 << 20:
                        yield pa.RecordBatch.from_arrays(_columns(held), names=_NAMES)
                        held, bulk = [], 0
        for pieces in packer.merge():
            full = sum(len(p[2]) for p in pieces) == window
            held += _rows(pieces, (me << 32) + made, None if full else me)
            made += 1
        yield pa.RecordBatch.from_arrays(_columns(held), names=_NAMES)

    def leftovers(table: pa.Table) -> pa.Table:
        packer, rows = Packer(window, open_windows, slack), []
        group = (1 << 62) + (table["partition"][0].as_py() // merge << 32)
        table = table.sort_by([("partition", "ascending"), ("offset", "ascending")])
        for row in table.to_pylist():
            packer.windows.append([row["length"], [(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])]])
        packer.windows = [[window, [p for w in packer.windows for p in w[1]]]]
        for i, pieces in enumerate(packer.merge()):
            rows += _rows(pieces, group + i, None)
        return pa.Table.from_arrays(_columns(rows), names=_NAMES)

    first = materialise(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES), "pieces")
    last = first.where("partition IS NOT NULL").groupBy(F.floor(F.col("partition") / merge)).applyInArrow(leftovers, PIECES)
    return first.where("partition IS NULL").unionByName(last).drop("partition")
