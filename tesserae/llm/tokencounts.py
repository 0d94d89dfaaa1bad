"""Token counts of whole texts under a byte-level BPE vocabulary, huge texts in overlapping chunks.

A text of up to CHUNK + OVERLAP characters is encoded whole. A longer one is cut every CHUNK characters, and each piece is
encoded together with the first OVERLAP characters of the next, so that two neighbours see the overlap both. Their tokens
have byte offsets (sums of the sizes of their ids), and they are spliced at the end of a token that both have, with the
same start, end and id. That the splice gives what the library gives for the whole text is proven, not assumed:

- Words are found by a pattern that looks at most a few characters ahead and never back, so from a character at which
  both pieces are inside a run of the same kind, or at its end, both find the same ends of words. What the left piece says
  within GUARD characters of its own end is not used: there the pattern or a special string may have been cut off.
- Within a word, merges run by rank, the leftmost of equals first. A sequence of tokens is the encoding of its word if
  each two neighbours are the encoding of their own two: the first merge over a boundary would happen in those two alone
  as well. With a token that both pieces have, each two neighbours of the spliced sequence are neighbours in one piece.

A splice is only made between whole characters and not before an apostrophe, where the pattern's contractions would read
what follows differently if the text began there; so the rest of the text can also be encoded anew from a splice on.
This is what happens where no common token is found: the left piece is read again from its last splice, with twice the
overlap, and the right one begins at one of its tokens' ends. A piece that comes to the end of the text ends the search.

A text is one row, so it is counted by the task that reads it, some CHUNK characters at a time; nothing is shuffled.

Defined cases: null and empty texts have 0 tokens and 0 bytes; special strings count as the library counts them by
default, one token each; rows without an id, repeated rows and texts of any length are counted like all others; an empty
table gives an empty one; other columns are passed through, except those that have the names of the new ones.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.bytebpe import vocabulary_of
from tesserae.session import ship

CHUNK = 1 << 15  # characters between the beginnings of two pieces
OVERLAP = 256  # characters that two neighbours both see, at first
LOOK_AHEAD = 8  # characters, more than the pattern of words looks at behind the end of a word


class ByteCounter:
    """Counts tokens by one vocabulary file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        vocabulary = vocabulary_of(path)
        self.encode, self.sizes, self.chunk, self.overlap = vocabulary.encoder(special=True), vocabulary.sizes, chunk, overlap
        self.guard = LOOK_AHEAD + max(map(len, vocabulary.special), default=0)
        if overlap <= 2 * self.guard or chunk < overlap:
            raise ValueError(f"pieces of {chunk} characters with overlaps of {overlap} leave nothing to splice at")

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text and the byte offsets at which they end."""
        ids = np.array(self.encode(text), np.int64)
        return ids, np.cumsum(self.sizes[ids])

    def counts(self, texts: list[str]) -> list[int]:
        """The numbers of tokens."""
        return [self.count_long(t) if len(t) > self.chunk + self.overlap else len(self.encode(t)) for t in texts]

    def count_long(self, text: str) -> int:
        """The number of tokens of a long text, from its pieces."""
        left = Piece(self, text, 0, self.chunk + self.overlap)
        total, overlap, following = 0, self.overlap, self.chunk
        while left.until < len(text):
            right = Piece(self, text, following, following + self.chunk + self.overlap)
            splice = left.splice(right)
            if splice is not None:
                at_left, at_right = splice
                total += at_left
                left, overlap, following = right.after(at_right), self.overlap, following + self.chunk
            else:
                overlap *= 2
                left = Piece(self, text, left.since, left.until + overlap)
                following = left.boundary(left.until - overlap)
        return total + len(left.ids)  # it ends with the text


class Piece:
    """The tokens of text[since:until]; `since` is the text's beginning, a splice, or where a piece was cut."""

    def __init__(self, counter: ByteCounter, text: str, since: int, until: int):
        self.counter, self.text, self.since, self.until = counter, text, since, min(until, len(text))
        self.first = 0  # bytes between `origin` and `since`
        self.ids, self.bytes = counter.ends(text[since : self.until])

    def after(self, tokens: int) -> "Piece":
        """What is left of the piece behind so many tokens, whose end is between two characters."""
        out = object.__new__(Piece)
        out.counter, out.text, out.until = self.counter, self.text, self.until
        out.since = self.since + self.chars(int(self.bytes[tokens - 1]))
        out.ids, out.bytes = self.ids[tokens:], self.bytes[tokens:] - self.bytes[tokens - 1]
        return out

    def chars(self, size: int) -> int:
        """How many characters the first `size` bytes hold."""
        return len(self.text[self.since : self.since + size].encode()[:size].decode())

    def splice(self, right: "Piece") -> tuple[int, int] | None:
        """How many tokens of this piece, and of the right one, come before the first boundary that is proven; None without one."""
        usable = len(self.text[self.since : self.until - self.counter.guard].encode()) if self.until - self.counter.guard > right.since else 0
        base = len(self.text[self.since : right.since].encode())
        ends, others = self.bytes, right.bytes + base
        common, mine, theirs = np.intersect1d(ends[ends <= usable], others, assume_unique=True, return_indices=True)
        same = self.ids[mine] == right.ids[theirs]
        for at, i, j in zip(common[same].tolist(), mine[same].tolist(), theirs[same].tolist(), strict=True):
            if right.between_characters(at - base):
                return i + 1, j + 1
        return None

    def between_characters(self, size: int) -> bool:
        """Whether a byte offset is between two characters, the second of them no apostrophe."""
        try:
            at = self.since + self.chars(size)
        except UnicodeDecodeError:
            return False
        return at < len(self.text) and self.text[at] != "'"

    def boundary(self, near: int) -> int:
        """A character at which one of the tokens ends, at or before `near` where there is one."""
        size = len(self.text[self.since : max(near, self.since)].encode())
        for end in self.bytes[: np.searchsorted(self.bytes, size, "right")][::-1].tolist():
            if self.between_characters(end):
                return self.since + self.chars(end)
        return max(near, self.since + 1)


_COUNTERS: dict[tuple, ByteCounter] = {}


def counter_of(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> ByteCounter:
    """The worker process's counter, kept from task to task; one at a time."""
    if (path, chunk, overlap) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path, chunk, overlap] = ByteCounter(path, chunk, overlap)
    return _COUNTERS[path, chunk, overlap]


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (boolean: more than `limit` tokens) added."""
    ship(docs.sparkSession)
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    fields = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in fields]
    docs = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__t_bytes"), F.coalesce(text, F.lit("")).alias("__t_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, chunk, overlap)
        for batch in batches:
            found = np.array(counter.counts(batch["__t_text"].to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], batch["__t_bytes"], pa.array(found), pa.array(found > limit)], names=[*names, *added])

    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in added.items())]))
