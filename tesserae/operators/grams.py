"""Hashes of the word and character grams of texts, for containment joins.

A hash of any stretch of a text comes from two prefix sums: with c the code points and P odd, the sum of c[i] P^i over the
stretch, times P^-a for its beginning a, is the same wherever the stretch occurs. So the grams of a whole batch of texts
are a few array operations, whatever their sizes.
"""

from collections.abc import Iterable

import numpy as np

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

#: Words, or characters, of the longest grams.
WORDS, CHARS = 3, 6


def kind_of(text: str) -> int:
    """Which grams a text is looked up by: n whole words from inside it (n), or n characters (-n) where it has under three words."""
    inside = text.count(" ") - 1
    return min(inside, WORDS) if inside >= 1 else -min(len(text), CHARS)


class Hasher:
    """The grams of texts whose words are parted by single spaces."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            self.powers, self.inverses = (np.full(size, p, np.uint64) for p in (_P, _P_INVERSE))
            for powers in (self.powers, self.inverses):
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)  # modulo 2**64

    def grams(self, texts: list[str], kinds: Iterable[int], inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(which text, hash) of all grams of these kinds; `inside`: not those that begin or end with the text's first or last word."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        firsts = np.cumsum(lengths + 1) - (lengths + 1)
        self._grow(len(points) + 2)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.powers[: len(points)], dtype=np.uint64)])
        spaces = np.flatnonzero(points == 32)
        begins = np.concatenate([[0], spaces + 1])
        ends = np.concatenate([spaces, [len(points)]])
        filled = begins < ends
        begins, ends = begins[filled], ends[filled]
        word_of = np.searchsorted(firsts, begins, "right") - 1
        of, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for kind in kinds:
            if kind > 0:
                last = np.arange(kind - 1, len(begins))
                first = last - (kind - 1)
                ok = word_of[first] == word_of[last]
                if inside:
                    ok &= (np.concatenate([[-1], word_of[:-1]])[first] == word_of[first]) & (np.concatenate([word_of[1:], [-1]])[last] == word_of[last])
                a, b, text = begins[first[ok]], ends[last[ok]], word_of[first[ok]]
            else:
                counts = np.maximum(lengths + kind + 1, 0)
                text = np.repeat(np.arange(len(texts)), counts)
                a = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[text]
                b = a - kind
            with np.errstate(over="ignore"):
                h = ((sums[b] - sums[a]) * self.inverses[a] + np.uint64(kind % 64)) * _MIX
                h ^= h >> np.uint64(31)
            of.append(text)
            hashes.append(h)
        return np.concatenate(of), np.concatenate(hashes)


def per_text(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, each hash of a text once."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]
