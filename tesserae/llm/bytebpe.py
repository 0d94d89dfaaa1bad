"""The byte-level BPE of a vocabulary file, run by the faster of the two libraries that read it.

A file whose ids are the ranks of its merges says the same to `tokenizers`, which merges pairs in the order of a list, and to
`tiktoken`, which merges what makes the token of the lowest rank. Such a file is checked for that form and then read by the
second; others are refused. The two find the same words: the tests compare them on every code point there is.
"""

import json
import os

import numpy as np

#: The pattern of words of byte-level vocabularies of this form.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary stands for: its own code where it prints, else the next from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(prints)))}


class ByteVocabulary:
    """tokens: the bytes of each id; sizes: how many they are; special: the ids of special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        before, model, added = given.get("pre_tokenizer") or {}, given["model"], given.get("added_tokens") or []
        plain = model["type"] == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        by_bytes = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        as_they_are = given.get("normalizer") is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        if not (plain and by_bytes and as_they_are):
            raise ValueError(f"no byte-level BPE without normalisation: {path}")
        letters, vocab = byte_letters(), model["vocab"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [vocab[m] for m in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
            raise ValueError(f"the ids are not the ranks of the merges: {path}")
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.tokens[i] = bytes(map(letters.__getitem__, token))
        self._ranks = {self.tokens[i]: i for i in vocab.values()}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def encoder(self, special: bool):
        """A function from a text to its ids; `special`: whether special strings in it become their own ids."""
        import tiktoken

        own = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=self._ranks, special_tokens=self.special)
        if special:
            allowed = set(self.special)
            return lambda text: own.encode(text, allowed_special=allowed, disallowed_special=())
        return own.encode_ordinary


_LOADED: dict[str, ByteVocabulary] = {}


def vocabulary_of(path: str) -> ByteVocabulary:
    """The worker process's vocabulary, kept from task to task; one at a time."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _LOADED.clear()
        _LOADED[path] = ByteVocabulary(path)
    return _LOADED[path]
