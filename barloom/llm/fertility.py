"""Quality rules from tokeniser fertility.

Two public vocabularies are run over each whole text: a byte-level one for the
code points per token, and one with byte fallback, applied word by word, for the
share of fallback tokens and the entropy of the token distribution (bits).  A
document is rejected if a measure leaves the band of its language, or, where the
language has none, of the script that most of its letters belong to.

The bands of languages were fitted to labelled documents of 50 words or more that
the base rules keep: a sample of 10,000 labelled rows at most, in
which each language has 790 good ones or more.  The lower bounds of code points per
token and of entropy are the values that half a percent of the good documents stay
under, rounded down to hundredths, so that about one percent of good documents is
rejected.  The bands of scripts have no labelled documents; they lie between ordinary sentences and texts that a
vocabulary breaks into single bytes.  Where ordinary text lies there too (Indic
scripts, and those without a name here), the least code points per token is 0.

Base counts come along: words, code points in words, symbols, repeated lines and
words in repeated three-word windows.

Narrow: no shuffle; every text is handled whole, in runs of about 1 MB.

Cases: a null text counts as empty, has no words and fails; a null or unknown
language falls to the script; repeated rows each give a row; words and lines of
any length; empty tables give empty results; other columns are only passed through
by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches
from .text import Texts, covered, mix, parts, runs, span_hashes, split_words, texts_of, window_hashes, window_starts
from .vocab import ByteVocabulary, PieceVocabulary, loaded, tidy

# Least and most code points per token, largest share of byte fallback, least token entropy.
BANDS = {
    "en": (2.38, 9.0, 0.10, 5.79),
    "de": (2.23, 9.0, 0.10, 5.79),
    "fr": (2.07, 9.0, 0.10, 5.76),
    "es": (1.96, 9.0, 0.10, 5.78),
    "Latin": (1.00, 9.0, 0.20, 4.5),
    "Greek": (0.65, 9.0, 0.30, 3.5),
    "Cyrillic": (0.65, 9.0, 0.30, 4.0),
    "Semitic": (0.65, 9.0, 0.30, 3.5),
    "Indic": (0.00, 9.0, 0.40, 3.5),
    "East Asian": (0.40, 6.0, 0.50, 4.0),
    "other": (0.00, 12.0, 0.60, 3.0),
}
# First and last code points of the scripts' letters.
_RANGES = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Semitic": ((0x5D0, 0x5F2), (0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x710, 0x77F), (0x8A0, 0x8C9), (0xFB1D, 0xFDFB), (0xFE70, 0xFEFC)),
    "Indic": ((0x900, 0xDFF),),
    "East Asian": ((0x1100, 0x11FF), (0x3041, 0x318F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x20000, 0x323AF)),
    "other": ((0x250, 0x2AF), (0x530, 0x58F), (0x780, 0x7FF), (0xE00, 0x10FF), (0x1200, 0x1C7F), (0x2D00, 0x2DDF), (0xA4D0, 0xA63F), (0x10000, 0x1CFFF), (0x1E000, 0x1EFFF)),
}
_SCRIPTS = (*_RANGES,)
_STARTS = np.array(sorted((a, b, k) for k, name in enumerate(_SCRIPTS) for a, b in _RANGES[name]))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(mask))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    data, offsets = texts
    words = split_words(texts)
    n_texts = len(texts)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    leads = (data & 0xC0) != 0x80

    breaks = np.flatnonzero(data == 0x0A)
    start, end = np.sort(np.append(offsets[:-1], breaks + 1)), np.sort(np.append(offsets[1:], breaks))
    line_text = np.repeat(np.arange(n_texts), 1 + _per_text(data == 0x0A, offsets))
    filled = np.append(0, np.cumsum(inside))
    has_word = filled[end] > filled[start]
    line_text = line_text[has_word]
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    lines = span_hashes(texts, start[has_word], end[has_word]) ^ salt[line_text]
    _, first = np.unique(lines, return_index=True)
    n_lines, n_distinct = np.bincount(line_text, minlength=n_texts), np.bincount(line_text[first], minlength=n_texts)

    hashes = span_hashes(texts, words.start, words.end)
    at, text = window_starts(words.offsets, WINDOW)
    hashed = window_hashes(hashes, WINDOW)[at] ^ salt[text] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(hashed)
    run, first = runs(hashed[order])
    often = np.diff(np.append(first, len(order))) > 1
    repeated = covered(len(hashes), at[order[often[run]]] if len(order) else at, WINDOW)
    return {
        "n_words": np.diff(words.offsets),
        "word_chars": _per_text(inside & leads, offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": _per_text(repeated, words.offsets),
    }


def main_script(strings: list[str]) -> list[str]:
    """The script of most letters of each text; of scripts with equally many the first named."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    at = np.maximum(np.searchsorted(_STARTS[:, 0], points, "right") - 1, 0)
    letter = (points >= _STARTS[at, 0]) & (points <= _STARTS[at, 1])
    counts = np.bincount(text[letter] * len(_SCRIPTS) + _STARTS[at[letter], 2], minlength=len(strings) * len(_SCRIPTS)).reshape(-1, len(_SCRIPTS))
    return [_SCRIPTS[k] if c[k] else "other" for c, k in zip(counts, counts.argmax(axis=1), strict=True)]


def entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of each text's own token distribution."""
    n = len(counts)
    key = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), counts) | ids
    key.sort()
    _, first = runs(key)
    times = np.diff(np.append(first, len(key)))
    text = (key[first] >> np.uint64(32)).astype(np.int64)
    share = times / counts[text]
    return np.bincount(text, -share * np.log2(share), minlength=n)


def measure(texts: Texts, strings: list[str], byte_path: str, piece_path: str) -> dict[str, np.ndarray]:
    whole, pieces = loaded((ByteVocabulary, byte_path), (PieceVocabulary, piece_path))
    _, n_tokens = whole.encode(strings)
    ids, counts = pieces.encode(strings)
    ends = np.append(0, np.cumsum(counts))
    chars = _per_text((texts.data & 0xC0) != 0x80, texts.offsets)
    return {
        "chars_per_token": chars / np.maximum(n_tokens, 1),
        "byte_share": _per_text(pieces.is_byte[ids], ends) / np.maximum(counts, 1),
        "token_entropy": entropy(ids, counts),
    }


def judged(texts: Texts, strings: list[str], langs: list[str | None], byte_path: str, piece_path: str) -> dict[str, np.ndarray]:
    """All counts and measures, ``base_failed`` and ``kept``."""
    out = base_counts(texts) | measure(texts, strings, byte_path, piece_path)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    unknown = [k for k, lang in enumerate(langs) if lang not in BANDS or lang in _RANGES]
    named = dict(enumerate(langs)) | dict(zip(unknown, main_script([strings[k] for k in unknown]), strict=True))
    bands = np.array([BANDS[named[k]] for k in range(len(langs))]).reshape(-1, 4)
    fits = (out["chars_per_token"] >= bands[:, 0]) & (out["chars_per_token"] <= bands[:, 1])
    fits &= (out["byte_share"] <= bands[:, 2]) & (out["token_entropy"] >= bands[:, 3])
    out["kept"] = fits & ~out["base_failed"]
    return out


def _runs_of(texts: pa.Array, langs: pa.Array, byte_path: str, piece_path: str):
    for a, b, part in parts(texts_of(texts), 1 << 20):
        strings = ["" if t is None else t for t in texts.slice(a, b - a).to_pylist()]
        yield a, b, judged(part, strings, langs.slice(a, b - a).to_pylist(), byte_path, piece_path)


def quality_rules(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, base counts, measures, base_failed, kept."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    names = [*BASE, *MEASURES, "base_failed", "kept"]
    kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(MEASURES) + [pa.bool_()] * 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _runs_of(batch.column(1), batch.column(2), byte_path, piece_path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[n], k) for n, k in zip(names, kinds, strict=True))], names=["doc_id", *names])
        tidy()

    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{n} bigint" for n in BASE), *(f"{n} double" for n in MEASURES), "base_failed boolean", "kept boolean"])
    return source.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that the rules reject; all columns stay, nothing is shuffled."""
    small_batches(docs.sparkSession)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _runs_of(batch.column(text_at), batch.column(lang_at), byte_path, piece_path):
                yield batch.slice(a, b - a).filter(pa.array(found["kept"], pa.bool_()))
        tidy()

    return docs.mapInArrow(keep, docs.schema)
