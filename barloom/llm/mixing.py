"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled, laid end to end and cut into blocks of
``block_words`` words.  The schedule is the van der Corput sequence: point i,
its bits reversed, falls into one source's share of [0, 1).  Slots are ranked
within their source, and rank r takes block ``r mod n_blocks`` of pass
``r div n_blocks``, so a source is repeated evenly and every prefix of the
schedule is mixed close to the targets.  :func:`mixed_order` gives that mix,
:func:`mix_sources` per document the words taken and the slots that take them.  A source that has fewer points than
slots gets the rest at the end; points beyond its slots are left out; the last
slot is trimmed so that a source gives its target to the word.

Targets: source k by code point (null last) weighs ``weights[k mod len]``, all
targets sum to the words there are, none exceeds ``max_repeat`` times its source.

Scale: prefix sums and ranks are taken in two levels (chunks, then the few chunk
totals), so a source with a third of all rows is spread over many tasks.  The
only single-task step handles one row per source.

Cases: null or blank texts have size 0 and are taken 0 times; a null source is a
source of its own; a null or repeated ``doc_id`` is a row of its own; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import join_counted, written

WORD = r"[^\x20\x09-\x0D]+"
_CHUNK, _COPIES = 1 << 16, 4096
_KEPT = ("doc_id", "copy", "source", "size", "source_size", "target")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeat: float) -> DataFrame:
    """Per source: ``source_id`` (rank by code point, null last), ``source_size``, ``target``.

    Water filling: with sources ordered by cap / weight, the level is that of the
    first source which the level leaves below its cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("source_id", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_id")
    everything = W.partitionBy()
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.coalesce(F.max(fits).over(everything), F.max("level").over(everything))
    return levels.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("cap"), level * F.col("weight")))).select(
        "source_id", "source", "source_size", "target"
    )


def schedule(plan: DataFrame) -> DataFrame:
    """Slots (source_id, slot, rank) of a plan with ``source_id`` and ``slots`` per source."""
    spark = plan.sparkSession
    total, n_sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    bits = max(1, math.ceil(math.log2(max(2, total))))
    cells = max(1, 4 * n_sources)
    ends = plan.filter("slots > 0").withColumn("hi", F.sum("slots").over(W.orderBy("source_id"))).withColumn("lo", F.col("hi") - F.col("slots"))
    cell = lambda x: F.floor(x / F.lit(float(max(1, total))) * cells).cast("long")
    shares = ends.select("source_id", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    turned = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("at", turned * F.lit(float(total))).withColumn("cell", cell(F.col("at")))
    hits = points.join(shares, "cell").filter("at >= lo and at < hi").select("source_id", "slot", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    chunks = hits.groupBy("source_id", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        hits.withColumn("r", F.row_number().over(W.partitionBy("source_id", "chunk").orderBy("slot")) - 1)
        .join(chunks.select("source_id", "chunk", before.alias("before")), ["source_id", "chunk"])
        .select("source_id", "slot", (F.col("r") + F.col("before")).alias("rank"))
        .join(plan.select("source_id", "slots"), "source_id")
        .filter("rank < slots")
        .drop("slots")
    )
    had = chunks.groupBy("source_id").agg(F.sum("n").alias("had"))
    rest = (
        plan.join(had, "source_id", "left")
        .withColumn("had", F.coalesce("had", F.lit(0)))
        .filter("had < slots")
        .select("source_id", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank"))
        .select("source_id", (F.lit(total) + F.col("rank")).alias("slot"), "rank")
    )
    return ranked.unionByName(rest)


def _numbered(raw: DataFrame) -> DataFrame:
    """Rows with a number, ``copy``, that tells like rows apart; many like rows are counted first and spread again."""
    counted = raw.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    several = counted.filter("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_COPIES}"))))
    spread = several.repartition("doc_id", "part")
    copies = F.explode(F.sequence(F.col("part") * _COPIES, F.least(F.col("n"), (F.col("part") + 1) * _COPIES) - 1))
    return counted.filter("n = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copy")).unionByName(spread.select("doc_id", "source", "size", copies.alias("copy")))


def _slots_and_pieces(
    docs: DataFrame, weights: tuple[float, ...], max_repeat: int, block_words: int, seed: int, id_col: str, text_col: str, source_col: str
) -> tuple[DataFrame, DataFrame]:
    """The slots, each with its block and the words it takes of it, and the pieces of documents in each block."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = written(_numbered(raw), "mix-sizes")
    n_rows = sizes.count()
    buckets = max(1, n_rows // max(256, math.isqrt(n_rows)))

    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    give = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * max_repeat)
    plan = written(
        source_targets(sizes, weights, max_repeat)
        .withColumn("n_blocks", blocks)
        .withColumn("give", give)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("give div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("give") - F.col("passes") * F.col("source_size"))
        .withColumn("slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / F.lit(block_words)).cast("long")),
        "mix-plan",
    )

    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    left = F.col("rest") - F.col("block") * block_words
    slots = (
        schedule(plan)
        .join(plan.select("source_id", "n_blocks", "passes", "rest", "source_size"), "source_id")
        .withColumn("block", F.expr("rank % n_blocks"))
        .withColumn("words", F.when(F.expr("rank div n_blocks") < F.col("passes"), length).otherwise(F.least(length, left)))
    )

    h = F.xxhash64(F.col("doc_id"), F.col("size"), F.col("copy"), F.lit(seed))
    keyed = (
        sizes.join(plan.select("source_id", F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("h", h)
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    )
    sums = keyed.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    order = W.partitionBy("source_id", "bucket").orderBy("h", "doc_id", "size", "copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        keyed.withColumn("upto", F.sum("size").over(order))
        .join(sums.select("source_id", "bucket", base.alias("base")), ["source_id", "bucket"])
        .withColumn("end", F.col("base") + F.col("upto"))
        .withColumn("begin", F.col("end") - F.col("size"))
    )
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}")))
    pieces = (
        placed.select("source_id", "begin", "end", *_KEPT, F.explode_outer(spans).alias("block"))
        .withColumn("a", F.greatest(F.col("begin") - F.col("block") * block_words, F.lit(0)))
        .withColumn("b", F.least(F.col("end") - F.col("block") * block_words, F.lit(block_words).cast("long")))
    )
    return slots, pieces


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeat: int = 3,
    block_words: int = 4096,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, n_slots, slots.

    ``taken`` counts the words that the mix takes of the document, repeats
    included, ``n_slots`` the slots of the schedule that take some of it, and ``slots``
    lists, in order, those that take of its beginning: a slot for each time that the
    document comes up (none if it isn't taken).  The texts are read once; all later
    steps move a few numbers per document.  The result depends on ids, sources and
    sizes alone, so reruns agree.
    """
    slots, pieces = _slots_and_pieces(docs, weights, max_repeat, block_words, seed, id_col, text_col, source_col)
    # A block has a slot for each pass, max_repeat + 1 at most.
    taken_blocks = slots.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("at"))
    hits = F.filter("at", lambda s: s["words"] > F.col("a"))
    words = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + F.least(F.col("b"), s["words"]) - F.col("a"))
    own = F.coalesce(F.col("hits"), F.array().cast("array<struct<slot:bigint,words:bigint>>"))
    return (
        pieces.join(taken_blocks, ["source_id", "block"], "left")
        .withColumn("hits", F.when(F.col("b") > F.col("a"), hits))
        .groupBy(*_KEPT)
        .agg(
            F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"),
            F.sum(F.size(own)).alias("n_slots"),
            F.min_by(F.transform(own, lambda s: s["slot"]), F.coalesce("block", F.lit(0))).alias("slots"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "taken", "n_slots", "slots")
    )


def mixed_order(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeat: int = 3,
    block_words: int = 4096,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself, a row per piece: slot, source, block, part, doc_id, copy, start, words.

    In the order of (slot, part) the pieces are the interleaved mix; ``start`` and
    ``words`` count words of the document.  Slots may leave gaps.  Summed per
    document, ``words`` are what :func:`mix_sources` calls ``taken``.
    """
    slots, pieces = _slots_and_pieces(docs, weights, max_repeat, block_words, seed, id_col, text_col, source_col)
    first = F.col("block") * block_words
    return (
        pieces.join(slots.select("source_id", "slot", "block", F.col("words").alias("most")), ["source_id", "block"])
        .filter("a < most")
        .select("slot", "source", "block", F.col("a").alias("part"), "doc_id", "copy", (first + F.col("a") - F.col("begin")).alias("start"), (F.least("b", "most") - F.col("a")).alias("words"))
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each document as often as it comes up in the mix, in the order of the mix; untaken ones go.

    A document comes up where a slot takes its beginning; one that a last, trimmed slot takes in
    part comes up whole, which adds less than a document a source.  The rows are sorted by
    slot over all partitions, so what is written is the interleaved mix.  Rows alike in
    identifier, source and size come up equally often, rounded up.
    """
    key = lambda i, s, n: F.to_json(F.struct(i.cast("string").alias("i"), s.alias("s"), n.alias("n")))
    own = mixed.groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("__barloom_key")).agg(
        F.max_by("slots", F.size("slots")).alias("__barloom_slots"), F.sum(F.size("slots")).alias("__barloom_all"), F.count("*").alias("__barloom_rows")
    )
    share = F.slice("__barloom_slots", 1, F.ceil(F.col("__barloom_all") / F.col("__barloom_rows")).cast("int"))
    own = written(own.filter("__barloom_all > 0").select("__barloom_key", "__barloom_rows", share.alias("__barloom_slots")), "mix-slots")
    keyed = docs.withColumn("__barloom_key", key(F.col(id_col), F.col(source_col), word_count(F.col(text_col))))
    joined = join_counted(keyed, own, "__barloom_key", "__barloom_rows")
    copies = joined.withColumn("__barloom_slot", F.explode("__barloom_slots"))
    return copies.repartitionByRange("__barloom_slot", "__barloom_key").sortWithinPartitions("__barloom_slot", "__barloom_key").select(*docs.columns)
