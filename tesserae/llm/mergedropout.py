"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is symbols of single characters. An agenda holds every pair of neighbours whose concatenation is a
piece, the best score first and the leftmost of equals. Each candidate taken from it is skipped with
probability `dropout`, decided by a hash of the seed, the document's key, the stretch's place in the document
and the candidate's turn; otherwise the pair merges and its new neighbours become candidates. A skipped pair
comes back when one of its parts changes. With dropout 0 the result is the library's own. Characters without a
piece become byte pieces, and so does U+2581, which the vocabulary uses for spaces, so every text decodes to
itself.

No piece spans from other characters into a space or over a line break, so stretches between those are
encoded on their own, all stretches of some 100,000 characters at once: arrays hold their symbols as linked
lists and the key of each candidate, its rank and place in one number, so that the least key of a stretch is
its next turn. Nothing is kept from one stretch to the next: every occurrence has draws of its own, memory does
not grow with the vocabulary of the texts, and a rerun of a lost task gives the same ids. Stretches of over LONG
characters, where scanning for the least key would be quadratic, have their agenda in a heap.

Defined cases: a null text gives null ids and decodes to null; an empty one has no ids; rows without a key
are keyed by their text; repeated rows are segmented alike; texts of any length are encoded whole; an
empty table gives an empty result; other columns are passed through.
"""

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.bpe import FREE, PairTable, merge_by_turns
from tesserae.session import ship

SPACE = "▁"
DROPOUT = 0.1
LONG = 48  # characters beyond which a stretch has a heap
CHUNK = 1 << 17  # characters that are encoded at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of one model file, and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}  # (cost, id)
        self.bytes = np.zeros(256, np.int32)
        self.out: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.out.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or ("\n" in piece and piece != "\n"):
                    raise ValueError(f"piece {i} spans a space or a line break")
                self.scores[piece] = (-model.get_score(i), i)
                self.out.append(piece.replace(SPACE, " ").encode())

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; the space put before the text goes again."""
        data = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class DropoutEncoder(Pieces):
    """The agenda over the pieces of one model file under one seed."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = 1):
        super().__init__(path)
        self.dropout, self.seed = dropout, seed
        self.known = len(self.out)
        symbols = {p: i for p, (_, i) in self.scores.items()}
        for piece in self.scores:  # letters that occur in pieces only
            for c in piece:
                symbols.setdefault(c, len(self.out) + len(symbols))
        self.none = max([self.known, *symbols.values()]) + 1
        ranks = {cost: r for r, cost in enumerate(sorted({cost for cost, _ in self.scores.values()}))}
        self.pairs = PairTable({
            (symbols[p[:k]], symbols[p[k:]]): (ranks[cost], i)
            for p, (cost, i) in self.scores.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        })
        self.letter = np.full(0x110000, self.none, np.int32)
        for c, i in symbols.items():
            if len(c) == 1 and c != SPACE:
                self.letter[ord(c)] = i
        self.letter[ord(" ")] = symbols.get(SPACE, self.none)

    def skipped(self, numbers: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
        """Whether the candidates of this turn (from 0) are skipped, by the numbers of the occurrences."""
        with np.errstate(over="ignore"):
            draws = _mix(numbers + (np.asarray(turn, np.uint64) + np.uint64(1)) * _STEP)
        return (draws >> np.uint64(11)) * 2.0**-53 < self.dropout

    def by_heap(self, points: np.ndarray, number: int) -> np.ndarray:
        """The symbols that are left of one stretch, at the places where they begin; `none` elsewhere is a dead place."""
        symbols = self.letter[points].tolist()
        n, turn, block = len(symbols), 0, []
        before, after, age = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
        agenda: list[tuple[int, int, int, int]] = []
        ranks, merged = self.pairs.find(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        for i in np.flatnonzero(ranks < FREE).tolist():
            agenda.append((int(ranks[i]), i, 0, int(merged[i])))
        agenda.sort()
        least = {}  # pairs seen, so that numpy is asked once for each

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                pair = symbols[left], symbols[after[left]]
                if pair not in least:
                    r, m = self.pairs.find(np.array(pair[:1], np.int64), np.array(pair[1:], np.int64))
                    least[pair] = (int(r[0]), int(m[0]))
                rank, both = least[pair]
                if rank < FREE:
                    heappush(agenda, (rank, left, age[left], both))

        alive = np.ones(n, bool)
        own = np.array([number], np.uint64)
        while agenda:
            _, left, seen, both = heappop(agenda)
            if age[left] != seen:
                continue  # one of the two has merged with another since
            if turn % 256 == 0:
                block = self.skipped(own, np.arange(turn, turn + 256)).tolist()
            turn += 1
            if block[(turn - 1) % 256]:
                continue
            right = after[left]
            symbols[left], alive[right] = both, False
            age[right] += 1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            age[left] += 1
            if before[left] >= 0:
                age[before[left]] += 1
                offer(before[left])
            offer(left)
        return np.where(alive, symbols, -1)

    def by_turns(self, points: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The same for many stretches at once: their characters one after the other, and the size of each."""
        n = len(sizes)
        ends = np.cumsum(sizes)
        first = ends - sizes + np.arange(1, n + 1)  # a place without a symbol lies before each stretch and at the end
        place = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), sizes)
        symbol = np.full(len(points) + n + 1, self.none, np.int32)
        symbol[place] = self.letter[points]
        skip = (lambda rows, turn: self.skipped(numbers[rows], turn)) if self.dropout else None
        alive = merge_by_turns(self.pairs, symbol, first, sizes, skip)
        return np.where(alive, symbol, -1)[place]

    def encode_all(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        given = [" " + t if t else "" for t in texts]
        lengths = np.fromiter(map(len, given), np.int64, len(given))
        points = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return np.zeros(0, "<i4"), np.zeros(len(texts), np.int64)
        doc_starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        space, line = points == 32, points == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begins[doc_starts] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(points))
        base = np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), self.seed) for k, t in zip(keys, texts, strict=True) if t], np.uint64)
        opener = np.searchsorted(starts, doc_starts)
        per_doc = np.diff(opener, append=len(starts))
        with np.errstate(over="ignore"):
            numbers = _mix(np.repeat(base, per_doc) + (np.arange(len(starts)) - np.repeat(opener, per_doc)).astype(np.uint64) * _STEP)
        symbols = np.empty(len(points), np.int32)
        long = np.flatnonzero(sizes > LONG)
        for i in long.tolist():
            symbols[starts[i] : starts[i] + sizes[i]] = self.by_heap(points[starts[i] : starts[i] + sizes[i]], int(numbers[i]))
        short = np.flatnonzero(sizes <= LONG)
        part = np.cumsum(sizes[short]) // CHUNK
        for own in np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else ():
            size = sizes[own]
            where = np.arange(int(size.sum())) + np.repeat(starts[own] - (np.cumsum(size) - size), size)
            symbols[where] = self.by_turns(points[where], size, numbers[own])
        left = np.flatnonzero(symbols >= 0)
        ids, counts = symbols[left], np.ones(len(left), np.int64)
        strange = np.flatnonzero(ids >= self.known)
        if len(strange):
            odd = points[left[strange]]
            counts[strange] = 1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF)
            ids = np.repeat(ids, counts)
            ids[ids >= self.known] = self.bytes[np.frombuffer(odd.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
        per_text = np.zeros(len(texts), np.int64)
        per_text[lengths > 0] = np.add.reduceat(np.bincount(left, counts, len(points)).astype(np.int64), doc_starts)
        return ids.astype("<i4"), per_text

    def encode(self, text: str, key: int) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        return self.encode_all([text], [key])[0].tobytes()


_LOADED: dict[tuple, Pieces] = {}


def loaded(kind: type, *args) -> Pieces:
    """The worker process's encoder or decoder, kept from task to task; one at a time."""
    key = (kind.__name__, *args)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(*args)
    return _LOADED[key]


def encode(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with `ids` (little-endian 32-bit) and n_tokens (long) added."""
    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens")]
    names = [f.name for f in fields]
    docs = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("__t_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(DropoutEncoder, model_path, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part[text].to_pylist()
                ids, counts = encoder.encode_all([t or "" for t in texts], part["__t_key"].to_pylist())
                null = np.array([t is None for t in texts])
                offsets = pa.array(np.concatenate([[0], 4 * np.cumsum(counts)]), pa.int32())
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [pa.array(~null).buffers()[1], offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], packed, pa.array(counts, pa.int64(), mask=null)], names=[*names, "ids", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The frame with `decoded` (string) added."""
    ship(encoded.sparkSession)
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(Pieces, model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if i is None else pieces.decode(i) for i in part[ids].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.StringType())]))
