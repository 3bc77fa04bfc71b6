"""Token ids from public vocabularies, with one encoding per distinct unit of text.

A vocabulary's pre-tokeniser never joins text across certain boundaries, so a
text is cut there and each distinct unit is encoded once; the ids are exactly
those of encoding the whole text.  Strings of special tokens in a text are
ordinary text.  A cache that exceeds its limit of units, some 200 bytes each, keeps the most
used half, so a worker's memory is bounded; several encoders in one worker share
``LIMIT``.
"""

from __future__ import annotations

import ctypes
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

LIMIT = 800_000
_WHITE = re.compile(r"\s")
# In units that zero bytes part: an empty one, or white space other than a line break before something else.
_ODD = re.compile(r"[^\S\n]|[^\0]\n|\n[\s\0]|\n\Z|\0\0|\0\Z")


class _Index(dict):
    """Unit to number; a new unit gets the next number."""

    def __init__(self, units: Iterable = ()):
        super().__init__((u, n) for n, u in enumerate(units))
        self.new: list = []

    def __missing__(self, unit):
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class UnitCache:
    """Ids of units, kept as one flat array with offsets.

    ``encode`` maps new units to their ids end to end and the number of each.  A
    unit may be marked; marks are the caller's.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self.index = _Index()
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.uses, self.marks = np.zeros(0, np.int64), np.zeros(0, bool)

    def number(self, units: list) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def learn(self, mark: Callable[[list], list[bool]] | None = None) -> None:
        """Encode the units that are new."""
        new, self.index.new = self.index.new, []
        if not new:
            return
        flat, counts = self.encode(new)
        self.flat = np.concatenate([self.flat, flat])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.marks = np.concatenate([self.marks, np.array(mark(new) if mark else [False] * len(new), bool)])

    def gather(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered units end to end, and how many each has."""
        begin = self.offsets[units]
        counts = self.offsets[units + 1] - begin
        upto = np.cumsum(counts)
        at = np.repeat(begin - (upto - counts), counts)
        at += np.arange(len(at))
        return self.flat[at], counts

    def used(self, units: np.ndarray) -> None:
        self.uses += np.bincount(units, minlength=len(self.uses))

    def trim(self) -> None:
        """Beyond the limit, forget all but the most used half.  Numbers given before become void."""
        n = len(self.uses)
        if n <= self.limit:
            return
        least = max(2, int(np.partition(self.uses, n - self.limit // 2)[n - self.limit // 2]) + 1)
        keep = np.flatnonzero(self.uses >= least)
        units = list(self.index)
        self.flat, counts = self.gather(keep)
        self.offsets = np.append(0, np.cumsum(counts))
        self.marks, self.uses = self.marks[keep], np.zeros(len(keep), np.int64)
        self.index = _Index(units[k] for k in keep)


def _fast_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts


class _Fast:
    """Units are encoded many at once, as one text, and the ids dealt back by ``ends``."""

    PER_TEXT = 1000

    def __init__(self, path: str):
        self.tokenizer = _fast_tokenizer(path)

    def ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, units: list[str], joint: str, ends: Callable[[np.ndarray, list[str]], np.ndarray | None], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for a in range(0, len(units), self.PER_TEXT):
            own = units[a : a + self.PER_TEXT]
            ids = np.array(self.ids([joint.join(own)], tokenizer)[0], np.uint32)
            upto = ends(ids, own)
            out.append(_joined(self.ids(own, tokenizer)) if upto is None else (ids, np.diff(np.append(0, upto))))
        return tuple(np.concatenate([np.zeros(0, kind), *(o[k] for o in out)]) for k, kind in ((0, np.uint32), (1, np.int64)))


# Beyond these letters Unicode versions differ in what is one.
_NOT_LATIN = re.compile(r"[^\0-\u017f]")
# What byte-level vocabularies write for a byte; letters and signs of Latin-1 stand for themselves, and spaces part units here.
_SHOWN = np.arange(256, dtype="<u2")
_SHOWN[[*range(32), *range(127, 161), 173]] = [*range(256, 288), *range(289, 324)]


class WordVocabulary(_Fast):
    """A vocabulary that drops white space and lower-cases: the words of a text are its units.

    A new word is normalised and cut as the vocabulary does it, and each distinct
    cut piece is encoded once.  Latin ones go straight to the vocabulary's model;
    the others are normalised and cut once more, by the library.  A piece's last id
    is one that ends a word, which tells where a piece's ids end.
    """

    PER_TEXT = 100
    # Fixed value: the pre-tokeniser's pattern.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    # The same for visible characters of lower-cased ASCII.
    ASCII_CUT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str, limit: int = LIMIT):
        import regex

        super().__init__(path)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.cut = regex.compile(self.CUT)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.words, self.pieces = UnitCache(self._encode_words, limit), UnitCache(self._encode_pieces, limit // 2)

    def _ends(self, ids: np.ndarray, units: list[str]) -> np.ndarray | None:
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return ends if len(ends) == len(units) and (not len(ids) or ends[-1] == len(ids)) else None

    def _encode_pieces(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        latin = np.array([u.isascii() or not _NOT_LATIN.search(u) for u in units], bool)
        joined = " ".join(u for u, own in zip(units, latin, strict=True) if own)
        shown = _SHOWN[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        found = self.many(shown.split(" ") if latin.any() else [], " ", self._ends, self.bare)
        others = self.many([u for u, own in zip(units, latin, strict=True) if not own], " ", self._ends)
        counts = np.zeros(len(units), np.int64)
        counts[latin], counts[~latin] = found[1], others[1]
        of_latin = np.repeat(latin, counts)
        ids = np.zeros(len(of_latin), np.uint32)
        ids[of_latin], ids[~of_latin] = found[0], others[0]
        return ids, counts

    def _pieces_of(self, word: bytes) -> list[str]:
        text = word.decode()
        if text.isascii():
            return (self.ASCII_CUT if text.isprintable() else self.cut).findall(text)
        text = unicodedata.normalize("NFC", text)
        # The library lower-cases character by character, so a final sigma is like any other.
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
        return self.cut.findall(text)

    def _encode_words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.pieces.trim()
        # Bare letters without accents are a piece as they are.
        cut = [[u.decode()] if u.isalpha() else self._pieces_of(u) for u in units]
        numbers = self.pieces.number([p for c in cut for p in c])
        self.pieces.learn()
        self.pieces.used(numbers)
        ids, counts = self.pieces.gather(numbers)
        upto = np.append(0, np.cumsum(counts))
        ends = np.cumsum([len(c) for c in cut])
        return ids, np.diff(np.append(0, upto[ends]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each."""
        self.words.trim()
        numbers = [self.words.number(text.encode().lower().split()) for text in texts]
        self.words.learn()
        every = np.concatenate([np.zeros(0, np.int64), *numbers])
        self.words.used(every)
        ids, counts = self.words.gather(every)
        upto = np.append(0, np.cumsum(counts))
        ends = np.cumsum([len(n) for n in numbers]) if numbers else np.zeros(0, np.int64)
        return ids, np.diff(np.append(0, upto[ends]))


class ByteVocabulary(_Fast):
    """A byte-level vocabulary.

    Its pre-tokeniser always cuts before a white-space character that follows
    another character, so those places part the units.  The bytes that each id
    stands for tell where a unit's ids end.  A text in which white space follows
    white space is encoded whole.
    """

    def __init__(self, path: str, limit: int = LIMIT):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.units = UnitCache(self._encode_units, limit)

    def _ends(self, ids: np.ndarray, units: list[str]) -> np.ndarray | None:
        upto, ends = np.cumsum(self.n_bytes[ids]), np.cumsum([len(u.encode()) for u in units])
        at = np.searchsorted(upto, ends)
        return at + 1 if len(upto) and at[-1] == len(upto) - 1 and (upto[at] == ends).all() else None

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = self._whole(units)
        plain = [u if u[0] == "\n" else " " + u for u, w in zip(units, whole, strict=True) if not w]
        ids, plain_counts = self.many(plain, "", self._ends)
        counts = np.zeros(len(units), np.int64)
        counts[~np.array(whole, bool)] = plain_counts
        return ids, counts

    @staticmethod
    def _whole(units: list[str]) -> list[bool]:
        """Units that show white space after white space; texts with them are encoded whole."""
        joined = "\0" + "\0".join(units)
        if joined.count("\0") == len(units) and not _ODD.search(joined):
            return [False] * len(units)
        return [u in ("", "\n") or bool(_WHITE.search(u, u[0] == "\n")) for u in units]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each."""
        self.units.trim()
        firsts, numbers = [], []
        for text in texts:
            first, *units = text.replace("\n", " \n").split(" ")
            firsts.append(first)
            numbers.append(self.units.number(units))
        self.units.learn(self._whole)
        if texts:
            self.units.used(np.concatenate(numbers))
        heads = self.ids(firsts)
        out, counts = [], []
        for text, first, head, units in zip(texts, firsts, heads, numbers, strict=True):
            if self.units.marks[units].any() or _WHITE.search(first):
                ids = [np.array(self.ids([text])[0], np.uint32)]
            else:
                ids = [np.array(head, np.uint32), self.units.gather(units)[0]]
            out += ids
            counts.append(sum(map(len, ids)))
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array(counts, np.int64)


class PieceVocabulary:
    """A vocabulary of pieces with byte fallback, applied to words; words start with its space mark."""

    def __init__(self, path: str, limit: int = LIMIT):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.processor.is_byte(i) for i in range(self.processor.get_piece_size())])
        self.words = UnitCache(self._encode_words, limit)

    def _encode_words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _joined(self.processor.encode([u.decode() for u in units], num_threads=1))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of all texts end to end, and the number of each text."""
        self.words.trim()
        numbers = [self.words.number(text.encode().split()) for text in texts]
        self.words.learn()
        every = np.concatenate([np.zeros(0, np.int64), *numbers])
        self.words.used(every)
        ids, counts = self.words.gather(every)
        upto = np.append(0, np.cumsum(counts))
        ends = np.cumsum([len(n) for n in numbers]) if numbers else np.zeros(0, np.int64)
        return ids, np.diff(np.append(0, upto[ends]))


_LOADED: dict[tuple, object] = {}


def loaded(*wanted: tuple[type, str], limit: int = LIMIT) -> list:
    """The encoders of this worker process for (kind, vocabulary file), which share ``limit``; those no longer wanted are dropped."""
    if set(_LOADED) != set(wanted):
        for key in set(_LOADED) - set(wanted):
            del _LOADED[key]
        for kind, path in wanted:
            if (kind, path) not in _LOADED:
                _LOADED[kind, path] = kind(path, limit // (3 * len(wanted) - 2))
    return [_LOADED[key] for key in wanted]


def release() -> None:
    """Free this worker's encoders; workers are reused, and other operators need the memory."""
    if _LOADED:
        _LOADED.clear()
        tidy()


def tidy() -> None:
    """Give freed memory, Arrow's too, back to the system; a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
