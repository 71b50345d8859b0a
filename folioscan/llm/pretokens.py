"""Pre-tokens of texts and the tokens of each, cached in the worker.

A byte-pair tokenizer works on each pre-token by itself, so a text's tokens are those of its pre-tokens, one after the
other. Texts with characters beyond the Latin ranges, where versions of Unicode may disagree on classes, and texts with
the strings of special tokens go to the tokenizer whole; that is slower and gives the same."""

from __future__ import annotations

import os
import re

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"
SPACE = "\\t-\\r "
#: Not in the ranges for which the patterns below are known to agree with the tokenizers.
UNSAFE = re.compile("[^\\t-\\r -~¡-įı-ſ‐-‧‰-⁞€]")
BYTE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PATTERN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: Entries of a worker's cache; when it is full it starts anew.
CACHED = 600_000

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def special(path: str) -> re.Pattern:
    """Finds the strings of a tokenizer's added tokens."""
    added = tokenizer(path).get_added_tokens_decoder().values()
    return re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")


def encoded(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


class Pretokens:
    """Splits texts, and keeps make(ids) for each pre-token. many: makes it of a list of pre-tokens at once."""

    def __init__(self, path: str, pattern: re.Pattern, lower: bool, make, known: dict | None = None, many=None):
        self.path, self.find, self.lower, self.make = path, pattern.findall, lower, make
        self.many = many or (lambda parts: map(make, encoded(path, parts)))
        self.special = special(path)
        self.known = known or {}
        self.cache: dict = dict(self.known)

    def split(self, text: str) -> list[str] | None:
        """None: only the tokenizer can tell."""
        if self.special.search(text) or UNSAFE.search(text):
            return None
        return self.find(text.lower() if self.lower else text)

    def batch(self, texts: list[str]) -> list[list]:
        """For each text what make gave for its pre-tokens (or for the text, whole)."""
        parts = [self.split(t) for t in texts]
        new: set[str] = set()
        for p in parts:
            if p:
                new.update(p)
        fresh = list(new.difference(self.cache))
        if len(self.cache) + len(fresh) > CACHED:
            self.cache = dict(self.known)
            fresh = list(new.difference(self.cache))
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            self.cache.update(zip(some, self.many(some)))
        get = self.cache.__getitem__
        return [list(map(get, p)) if p is not None else [self.make(x) for x in encoded(self.path, [t])] for p, t in zip(parts, texts)]


def by_size(texts: list[str], size: int = 4_000_000):
    """Runs of texts of about so many characters."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
