"""Byte pair encoding by forced-boundary splitting, and decoding.

A byte pair that stands inside no vocabulary entry can never be bridged by a
merge, so a word may be cut there for certain. The fragments are encoded on
their own and their ids concatenated, which gives the ids of the whole word.

Texts are first cut at spaces, then into words as the tokenizer file prescribes.
Chunks, words and fragments recur, so each worker keeps what it has encoded in
tables of a bounded size (``CACHE`` entries of at most ``CACHED_CHARS``
characters; a full table is emptied). Results do not depend on what they hold.

Defined results: a null text counts as empty and has no ids; a text of white
space alone has no ids if the tokenizer drops white space. A special token's
string in a text gets that token's id, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add

from tokenizers import Tokenizer, models

CACHE = 500_000
CACHED_CHARS = 64

# Latin-1 letters and numbers (Unicode classes L and N), lower case where it exists, and
# the white space of the class \s; words of the two patterns in public use over that alphabet.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
SPACE = "\t-\r \x85\xa0"
CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = (f"{CONTRACTION}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
          f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNSPACED = f"{CONTRACTION}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
# In a text without these, single spaces and line feeds are the only white space, so that what stands
# between two of them is cut into words the same way wherever it stands.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others, in order, for the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level tokenizer file.

    Its pre-tokenizer must be one of the two public patterns: words with a leading
    space, or lower-case words with white space dropped. Without ``forced`` words
    are encoded whole, with the same ids.
    """

    def __init__(self, path: str, forced: bool = True):
        self.forced = forced
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lowers = spec["normalizer"] is not None
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.words = re.compile(UNSPACED if self.lowers else SPACED)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Inside a word no fragment ends the word: the same merges without the suffix.
        self.inner = models.BPE(self.vocab, merges)
        self.last = models.BPE(self.vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.joined = self._joined()
        self.entries = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.bytes_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.of_word: dict[str, bytes] = {}
        # By what stands between two spaces; where words take a leading space, the chunk's is left out.
        self.of_chunk: dict[str, bytes] = self.of_word if self.lowers else {}
        self.of_fragment: dict[tuple[str, bool], list[int]] = {}

    def _joined(self) -> set[str]:
        """All pairs of letters that stand side by side in some vocabulary entry."""
        tokens = [t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab]
        return {a + b for t in tokens for a, b in zip(t, t[1:])}

    def fragments(self, word: str) -> list[str]:
        """A word in byte letters, cut at every forced boundary."""
        joined = self.joined
        if joined.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [n for n, (a, b) in enumerate(zip(word, word[1:]), 1) if a + b not in joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word (of the text, not yet in byte letters)."""
        letters = byte_letters()
        shown = "".join([letters[b] for b in word.encode()])
        parts = self.fragments(shown) if self.forced else [shown]
        if len(parts) == 1:
            return [t.id for t in self.last.tokenize(parts[0])]
        ids: list[int] = []
        for n, part in enumerate(parts, 1):
            key = (part, n == len(parts))
            if (got := self.of_fragment.get(key)) is None:
                got = [t.id for t in (self.last if key[1] else self.inner).tokenize(part)]
                if len(part) <= CACHED_CHARS:
                    self.of_fragment[key] = got
            ids += got
        return ids

    def _join(self, keys: list[str], table: dict[str, bytes], make) -> bytes:
        """The bytes of each key, of the table or newly made, in one string."""
        try:
            return b"".join(map(table.__getitem__, keys))
        except KeyError:
            fresh = {k: make(k) for k in set(keys).difference(table)}
            table |= fresh
            made = b"".join(map(table.__getitem__, keys))
            for k in fresh:
                if len(k) > CACHED_CHARS:
                    del table[k]
            return made

    def _word(self, word: str) -> bytes:
        return array("I", self.word_ids(word)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.lowers:
            words = self.words.findall(chunk)
            return self._word(chunk) if words == [chunk] else self._words(words)
        words = self.words.findall(chunk if chunk[0] == "\n" else " " + chunk)
        if len(words) == 1:
            return self._word(words[0])
        # The first word is a chunk as well, kept once for both.
        head = words[0][1:] if words[0][0] == " " else ""
        if not head:
            return self._words(words)
        if (got := self.of_chunk.get(head)) is None:
            got = self._word(words[0])
            if len(head) <= CACHED_CHARS:
                self.of_chunk[head] = got
        return got + self._words(words[1:])

    def _words(self, words: list[str]) -> bytes:
        return self._join(words, self.of_word, self._word)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        for table in (self.of_word, self.of_chunk, self.of_fragment):
            if len(table) >= CACHE:
                table.clear()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._words(self.split(text))
        if self.lowers:
            return self._join(text.lower().replace("\n", " ").split(" "), self.of_chunk, self._chunk)
        if not text or any(map(text.__contains__, UNEVEN)) or text[0].isspace() or text[-1].isspace():
            return self._words(self.split(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._words(self.words.findall(first)) + self._join(rest, self.of_chunk, self._chunk)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # beyond Latin-1 the library says what a letter is
            if self.lowers:
                text = self.whole.normalizer.normalize_str(text)
            back = self.bytes_of
            return [bytes([back[c] for c in word]).decode()
                    for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text.lower() if self.lowers else text)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text, each as four bytes, the lowest first."""
        text = text or ""
        if "<|" in text and (parts := self.special.split(text))[1:]:
            return b"".join([self.specials[p].to_bytes(4, "little") if n % 2 else self.encode_bytes(p)
                             for n, p in enumerate(parts)])
        return self._plain(text)

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens kept. A file without a decoder joins entries by a space."""
        if self.whole.decoder is None:
            entries = self.entries
            return " ".join([entries[i] for i in ids if i in entries])
        return self.whole.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=4)
def encoder(path: str, forced: bool = True) -> ForcedBoundaryBPE:
    """One encoder per worker and file."""
    return ForcedBoundaryBPE(path, forced)


def texts_of(batches: Iterator, column: str = "text") -> Iterator[tuple]:
    """(batch, list of its texts) of Arrow batches."""
    for batch in batches:
        yield batch, batch.column(column).to_pylist()
