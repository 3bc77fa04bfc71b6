"""Words, hashes and vocabularies against plain restatements."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from barloom.llm import text, vocab
from barloom.llm.queries import vocabulary

texts = st.lists(st.text(st.sampled_from(" \n\tabé中,.'SEΣ́<|>endoftext1　\x1c\x85"), max_size=40), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words(many):
    t = text.texts_of(pa.array(many, pa.string()))
    w = text.split_words(t)
    got = [bytes(t.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in many]
    assert got == [x for ws in want for x in ws] and np.diff(w.offsets).tolist() == [len(ws) for ws in want]
    hashes = text.span_hashes(t, w.start, w.end)
    assert len(set(zip(got, hashes.tolist()))) == len(set(got)) == len(set(hashes.tolist()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 5))
def test_window_hashes(values, size):
    items = text.mix(np.array(values, np.uint64))
    hashes = text.window_hashes(items, size).tolist()
    windows = [tuple(values[k : k + size]) for k in range(len(values) - size + 1)]
    assert len(hashes) == len(windows) and len(set(zip(windows, hashes))) == len(set(windows)) == len(set(hashes))


def test_null_and_sliced_columns():
    t = text.texts_of(pa.array(["zz", None, "ab", ""]).slice(1))
    assert bytes(t.data) == b"ab" and t.offsets.tolist() == [0, 0, 2, 2]


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    out = []
    for kind, name in ((vocab.WordVocabulary, "word_bpe_49k.json"), (vocab.ByteVocabulary, "byte_bpe_50k.json")):
        plain = Tokenizer.from_file(vocabulary(name))
        plain.encode_special_tokens = True
        out.append((kind(vocabulary(name), 50), plain))  # a tiny cache is trimmed often
    return out


@settings(max_examples=150, deadline=None)
@given(many=texts)
def test_unit_encoding_is_whole_encoding(encoders, many):
    for ours, plain in encoders:
        ids, counts = ours.encode(many)
        want = [e.ids for e in plain.encode_batch(many, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing_forgets_rare_words():
    """A worker that packs remembers few words, whatever it has seen, and encodes as before."""
    from tokenizers import Tokenizer

    from barloom.llm import packing

    path, step = vocabulary("word_bpe_49k.json"), 50_000
    encoder = vocab.loaded((vocab.WordVocabulary, path), limit=packing.WORDS)[0]
    for k in range(6):
        texts = [" ".join(f"the w{j}" for j in range(k * step, (k + 1) * step))]
        ids, counts = encoder.encode(texts)
        assert len(encoder.words.index) <= 200_000 + step + 1
    plain = Tokenizer.from_file(path)
    assert ids.tolist() == plain.encode(texts[0], add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    vocab.release()


def test_new_words_skip_what_cutting_has_done():
    """Latin words are normalised and cut once, not again by the library, and odd ones keep their ids."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encoder, plain = vocab.WordVocabulary(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert encoder.bare.normalizer is None
    odd = ["it's", "'S'LL'x", "a\x00b\x7f\x1c\x1fc'", "\xa0\xad\xff\xe9", "é́ ́", "İİ", "ΟΣ σΣΣ", " 　x\u0085y", "ĠĀ", "<|endoftext|>", "12٢½", "\U0001f600ẞ한가", "ﬁÅǅ"]
    texts = [*odd, " ".join(odd), "".join(odd), *(f"a{chr(c)}b{chr(c)}" for c in range(0x600)), *(chr(c) for c in range(0x1e00, 0x2200))]
    ids, counts = encoder.encode(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
