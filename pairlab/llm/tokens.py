"""Byte-level BPE ids by the tokenizers library, with the work for a repeated word done once."""

from __future__ import annotations

import os
import re

import numpy as np

from pairlab.llm.common import in_worker

_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*%$#&|]*)")
#: Words and their characters kept by an encoder; a bound of its memory (about 80 MB), not of what it encodes.
KEPT_WORDS, KEPT_CHARS = 400_000, 12_000_000


def vocabulary_path(name: str) -> str:
    """A file of the public tokenizers by name; an existing path stays as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def regular(text: str) -> bool:
    """Whether all white space of text is single spaces or line ends between visible characters.

    Every space or line end in such a text begins a pre-token of its own.
    """
    return (
        text.replace("\n", "").isprintable()
        and text[0] not in " \n"
        and text[-1] not in " \n"
        and "  " not in text
        and " \n" not in text
        and "\n " not in text
        and "\n\n" not in text
    )


class Numbered(dict):
    """Numbers of words in the order of their first lookup; those that are new are collected."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def take_new(self) -> list[str]:
        """The words met since the last call."""
        new, self.new = self.new, []
        return new


class WordEncoder:
    """Encodes texts to the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Byte-level BPE merges nothing across pre-tokens, and a single space or line end between two
    visible characters always begins a pre-token. Texts that have no other white space are cut
    there, each distinct piece is encoded once by the library, and texts are put together from
    the pieces' ids. Any other text goes through the library whole, and so does one that holds the
    string of an added token, which the library makes one id.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kept_words = kept_words
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.table = _byte_chars()
        self.space = self.table[ord(" ")]
        self.line_end = [t.id for t in self.model.tokenize(self.table[ord("\n")])]
        self.marks: dict[str, list[int]] = {}
        self.dtype = _id_type(self.whole)
        self._reset()

    def _reset(self) -> None:
        self.known = Numbered()
        self.chars = 0
        self.flat = np.zeros(1 << 16, self.dtype)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.settled = 0

    def _piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        text = text.replace(" ", self.space) if text.isascii() else text.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(text)]

    def _ids(self, key: str) -> list[int]:
        first = key[0]
        if first == "\n":
            return self.line_end + self._ids("\x01" + key[1:])
        text = key[1:] if first == "\x01" else " " + key
        if not (m := _WORD.fullmatch(text)):
            return self.whole.encode(text, add_special_tokens=False).ids
        core, marks = m.groups()
        if not marks:
            return self._piece(core)
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._piece(marks)
        at = self.known.get(core[1:], self.settled) if core[0] == " " else self.settled
        if at < self.settled:
            return self.flat[self.ends[at] : self.ends[at + 1]].tolist() + self.marks[marks]
        return self._piece(core) + self.marks[marks]

    def _learn(self) -> None:
        """Ids of the words that were met for the first time."""
        used, ends, found = self.used, [], []
        for key in self.known.take_new():
            ids = self._ids(key)
            found.extend(ids)
            used += len(ids)
            ends.append(used)
            self.chars += len(key)
        n = len(self.known)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : used] = found
        self.ends[n - len(ends) + 1 : n + 1] = ends
        self.used = used
        self.settled = n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in order."""
        out: list[np.ndarray | None] = [None] * len(texts)
        keys, at, counts = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, self.dtype)
            elif not regular(text) or any(t in text for t in self.added):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
            else:
                own = ("\x01" + text).replace("\n", " \n").split(" ")
                keys += own
                at.append(i)
                counts.append(len(own))
        if not keys:
            return out
        if len(self.known) > self.kept_words or self.chars > KEPT_CHARS:
            self._reset()
        index = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        if self.known.new:
            self._learn()
        starts = self.ends[index]
        lengths = self.ends[index + 1] - starts
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
        last = np.cumsum(lengths)[np.cumsum(counts) - 1]
        for i, own in zip(at, np.split(ids, last[:-1])):
            out[i] = own
        return out


def _id_type(tokenizer) -> type:
    return np.uint16 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


def id_type(name: str) -> type:
    """The unsigned type that holds a vocabulary's ids."""
    from tokenizers import Tokenizer

    return _id_type(Tokenizer.from_file(vocabulary_path(name)))


def encoder(name: str, kept_words: int = KEPT_WORDS) -> WordEncoder:
    """The encoder of a vocabulary file, kept by the Python worker between tasks."""
    return in_worker(("encoder", name, kept_words), lambda: WordEncoder(vocabulary_path(name), kept_words))
