"""Spelling variants by finite-state composition.

The pairs of words one edit apart are what the composition of the vocabulary's
acceptor, a transducer of exactly one edit, and the acceptor again accepts.  It is
enumerated by initial states: before its edit a pair reads the same letters, so the
states after the first ``HEAD`` letters part the work, each with a minimal acceptor of what
its words go on with.  Edits within the first ``HEAD`` letters are found on reversed
words, whose first letters are the same then.  A partition with more than ``MOST`` words
goes ``STEP`` letters deeper, and its pairs that edit one of those letters meet in tiny
partitions, one for a place and all the letters around it, of 91 words at most.  Words of over
``LONG`` letters are cut into blocks, and a block is a partition of the words that
agree in all letters before and after it.  Every pair has one place, that after its longest common
beginning, so it is found once.

A word's form is its near word with the largest count, if ten times the word's at
least; roots follow forms to the last by doubling steps, which end within log2 of
the longest chain, itself at most the digits of the largest count.

Scale: words are counted with map-side sums; all further steps move words, not
texts.  Partitions are streams of sorted rows, a partition in memory at a time.

Cases: a null text has no words; a null identifier counts as an empty one in the
hash; a repeated row counts again; words may be of any length, and are compared by
code point; ties go to the smallest word; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import join_counted, small_batches, written

LETTERS = r"[A-Za-zÀ-ÿ]"
HEAD, STEP, MOST, LONG, BLOCK = 3, 2, 1000, 64, 32
_DEEPEST = 9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# What a row's word may be in a pair: the shorter one, the longer one, one of two as long.
SHORTER, LONGER, EQUAL = 1, 2, 4
ANY = SHORTER | LONGER | EQUAL
_ROWS = "key string, middle string, role int, id binary"


class Composition:
    """Minimal acceptor of sorted words, and the pairs that it, one edit and it again accept."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        self.lengths: list[int] = []  # a bit for each length of what a state accepts
        self._states: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], tuple[str, ...]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}
        self.root = self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        final = len(words[lo]) == depth
        lo += final
        edges, lengths = [], int(final)
        while lo < hi:
            letter, end = words[lo][depth], lo + 1
            while end < hi and words[end][depth] == letter:
                end += 1
            state = self._state(words, lo, end, depth + 1)
            edges.append((letter, state))
            lengths |= self.lengths[state] << 1
            lo = end
        state = self._states.setdefault((final, tuple(edges)), len(self.final))
        if state == len(self.final):
            self.final.append(final)
            self.edges.append(dict(edges))
            self.lengths.append(lengths)
        return state

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """What both states accept."""
        if not self.lengths[p] & self.lengths[q]:
            return ()
        key = (p, q) if p < q else (q, p)
        found = self._common.get(key)
        if found is None:
            few, many = sorted((self.edges[p], self.edges[q]), key=len)
            ends = [""] if self.final[p] and self.final[q] else []
            found = self._common[key] = (*ends, *(c + s for c, t in few.items() if c in many for s in self.common(t, many[c])))
        return found

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs of what ``q`` accepts that differ by an edit at once: a letter replaced, or one more in the second."""
        found = self._edits.get(q)
        if found is None:
            found = self._edits[q] = []
            out = list(self.edges[q].items())
            for n, (a, s) in enumerate(out):
                for b, t in out[n + 1 :]:
                    found.extend((a + x, b + x) for x in self.common(s, t))
                # One more of the same letter is an edit after it.
                found.extend((x, a + x) for x in self.common(q, s) if x[:1] != a)
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs with one edit, each once, the shorter first."""
        at = [(self.root, "")]
        while at:
            q, read = at.pop()
            for a, b in self.edits(q):
                yield read + a, read + b
            at.extend((s, read + c) for c, s in self.edges[q].items())


def near_pairs(key: str, rows: list[tuple[str, int, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of identifiers in a partition of (middle, role, id), sorted by middle."""
    known = {m: (role, i) for m, role, i in rows}
    kind, head = key[0], key[1:]
    for a, b in Composition([m for m, _, _ in rows]).pairs():
        (role_a, id_a), (role_b, id_b) = known[a], known[b]
        fits = role_a & role_b & EQUAL if len(a) == len(b) else role_a & SHORTER and role_b & LONGER
        if kind == "S":  # only what changes the word's first letters
            fits = fits and (head + a)[-HEAD:] != (head + b)[-HEAD:]
        elif kind == "L":  # what changes a later block is found there
            fits = fits and not (len(a) == BLOCK and b.startswith(a))
        if fits:
            yield id_a, id_b


def blocks(word: str, id_: bytes) -> Iterator[tuple[str, str, int, bytes]]:
    """A long word's rows: for each block what is in it, keyed by all before and after.

    In a longer partner, what comes after the block begins one letter further on.
    """
    after, h, last = {}, hashlib.blake2b(digest_size=16), len(word)
    ends = {min(len(word), e + more) for e in range(BLOCK, len(word) + BLOCK + 1, BLOCK) for more in (0, 1)}
    for e in sorted(ends, reverse=True):
        h.update(word[e:last][::-1].encode())
        after[e], last = h.hexdigest(), e
    h = hashlib.blake2b(digest_size=16)
    for a in range(0, len(word) + 1, BLOCK):
        e = min(len(word), a + BLOCK)
        longer = min(len(word), e + 1)
        key = f"L{a // BLOCK}|{h.hexdigest()}|"
        roles = ANY if e == len(word) else SHORTER | EQUAL
        yield key + after[e], word[a:e], SHORTER if len(word) == LONG else roles, id_
        if longer > e:
            yield key + after[longer], word[a:longer], LONGER, id_
        h.update(word[a:e].encode())


def places(key: str, middle: str, role: int, id_: bytes, most: int) -> Iterator[tuple[str, str, int, bytes]]:
    """Rows for each place among the first ``most`` of ``middle`` where a pair may differ.

    A pair with one letter more meets where its longest common beginning ends: the
    shorter word as it is, the longer one without that letter.
    """
    kind, head = key[0], key[1:]
    for i in range(min(most, BLOCK if kind == "L" else most, len(middle) + 1)):
        before, after = middle[:i], middle[i:]
        if role & SHORTER:
            yield f"T{key}|{before}|{after}", "", SHORTER, id_
        if not after:
            continue
        rest = after[1:]
        found = role & (LONGER | EQUAL)
        if rest[:1] == after[0]:
            found &= ~LONGER
        if kind == "S":
            if (head + middle)[-HEAD:] == (head + before + rest)[-HEAD:]:
                found &= ~LONGER
            if i < len(middle) - HEAD:
                found &= ~EQUAL
        if found:
            yield f"T{key}|{before}|{rest}", after[0], found, id_


def _rows(found: Iterator[tuple[str, str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    kept = []
    schema = pa.schema([("key", pa.string()), ("middle", pa.string()), ("role", pa.int32()), ("id", pa.binary())])
    for row in found:
        kept.append(row)
        if len(kept) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def partitions(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (key, middle, role, id) of the partitions, none with more than ``most`` rows, or 91."""
    short = vocabulary.filter(F.length("word") <= LONG)
    turned = F.reverse("word")
    part = lambda kind, w: F.struct(F.concat(F.lit(kind), F.substring(w, 1, HEAD)).alias("key"), F.substring(w, HEAD + 1, LONG).alias("middle"))
    rows = short.select("id", F.explode(F.array(part("P", F.col("word")), part("S", turned))).alias("p")).select("p.key", "p.middle", F.lit(ANY).alias("role"), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(row for word, id_ in _tuples(batches) for row in blocks(word, id_))

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for key, middle, role, id_ in _tuples(batches):
                yield from places(key, middle, role, id_, STEP)
                if len(middle) >= STEP:
                    yield key + middle[:STEP], middle[STEP:], role, id_

        return _rows(found())

    def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(row for key, middle, role, id_ in _tuples(batches) for row in places(key, middle, role, id_, LONG + 1))

    rows = rows.unionByName(vocabulary.filter(F.length("word") >= LONG).select("word", "id").mapInArrow(cut, _ROWS))
    done, depth = None, HEAD
    while True:
        rows = written(rows, "spelling-rows")
        sizes = rows.filter("key not like 'T%'").groupBy("key").agg(F.count("*").alias("n"))
        hot = written(sizes.filter(F.col("n") > most), "spelling-hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cold, many = _parted(rows, hot)
        done = cold if done is None else done.unionByName(cold)
        last = depth >= _DEEPEST
        blocks_too = F.col("key").startswith("L")
        rows = many.mapInArrow(everywhere, _ROWS) if last else many.filter(~blocks_too).mapInArrow(deeper, _ROWS).unionByName(many.filter(blocks_too).mapInArrow(everywhere, _ROWS))
        depth += STEP


def _parted(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose partition is not in ``hot`` (key, n), and those whose is; no task gets a hot key's rows whole."""
    columns = ["key", "middle", "role", "id"]
    return rows.join(hot.select("key"), "key", "left_anti").select(columns), join_counted(rows, hot, "key", "n").select(columns)


def compose(rows: DataFrame) -> DataFrame:
    """(a, b): identifiers of words one edit apart, in both directions."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, current, a, b = [], None, [], []

        def close():
            if len(kept) > 1:
                for x, y in near_pairs(current, kept):
                    a.extend((x, y))
                    b.extend((y, x))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a.clear()
            b.clear()
            return batch

        for key, middle, role, id_ in _tuples(batches):
            if key != current:
                close()
                kept, current = [], key
                if len(a) > 10_000:
                    yield out()
            kept.append((middle, role, id_))
        close()
        yield out()

    return rows.repartition("key").sortWithinPartitions("key", "middle").mapInArrow(find, "a binary, b binary")


def noisy_words(docs: DataFrame, shortest: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word): runs of letters, lower-cased in A-Z; of those that ``every`` divides the hash of, less a letter."""
    run = F.col("word")
    at = F.pmod(F.col("h"), F.length(run)).cast("int")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS}{{{shortest},}})"))).alias("run"),
    ).select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    word = F.when(F.col("h") % every == 0, less).otherwise(run)
    return hashed.select(word.alias("word")).filter(F.length("word") >= shortest)


def spelling_forms(
    docs: DataFrame,
    shortest: int = 7,
    least: int = 2,
    ratio: int = 10,
    every: int = 31,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    small_batches(docs.sparkSession)
    counts = noisy_words(docs, shortest, every, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    vocabulary = written(counts.withColumn("id", _id(F.col("word"))), "vocabulary")
    pairs = written(compose(partitions(vocabulary.select("word", "id"), most)), "spelling-pairs")
    of_b = vocabulary.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("near"))
    best = pairs.join(of_b, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min("near").alias("near")).withColumnRenamed("a", "id")
    often = -F.col("near.less") >= ratio * F.col("n")
    forms = written(
        vocabulary.join(best, "id", "left").select(
            "word",
            F.when(often, F.col("near.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, -F.col("near.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    links = written(_followed(forms.filter("form is not null").select("word", F.col("form").alias("root"))), "spelling-roots")
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _id(word: Column) -> Column:
    return F.unhex(F.md5(word.cast("binary")))


def _followed(links: DataFrame) -> DataFrame:
    """(word, root) with every root followed to one that has no link itself; each round doubles the steps."""
    while True:
        links = written(links, "spelling-links")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(on, "root", "left_semi").isEmpty():
            return links
        links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
