"""The pipeline's stages on a small corpus, and the queries with SQL twins."""

import random

import duckdb
import pytest

import corpus_pipeline
from barloom.llm import queries
from barloom.llm.store import written

from .test_operators import check_pieces, near_rows

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, docs, odd_rows):
    rng = random.Random(8)
    common = "the of and house river walked under seventeen morning light because people with small windows near every other village where children played".split()
    words = {}
    plain = lambda t: " ".join(words.setdefault(w, rng.choice(common) + rng.choice(common)) for w in t.split())
    near = [(i + 100, plain(t)) for i, t in near_rows(4, 5) if t]
    rows = [*odd_rows, *near, *((i + 100, t) for i, t in near[:3])]
    d, columns = docs(rows), None
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = d.columns
        d = written(stage(spark, d, ""), name)
        assert d.columns
        sizes[name] = d.count()
        if name != "pack":
            assert d.columns == columns
        if name == "mix":
            mixed = [(r.doc_id, r.text) for r in d.collect()]
    assert len(rows) > sizes["quality"] > sizes["exact"] > sizes["near"] > 0
    ids = {i for i, _ in mixed}
    assert {r.doc_id for r in d.collect()} == ids


def test_stages_on_nothing(spark, docs):
    d = docs([(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        d = written(stage(spark, d, ""), f"none-{name}")
    assert d.count() == 0


def test_packed_repeats(spark, docs):
    from barloom.llm.packing import pack_documents
    from barloom.llm.queries import vocabulary

    rows = [(1, "a b c"), (1, "a b c"), (2, "w " * 9000)]
    check_pieces(rows, pack_documents(docs(rows), vocabulary("word_bpe_49k.json"), slack=0.0).collect())


def test_run_leaves_little_behind(spark):
    """Tables of the stages go as soon as nothing reads them."""
    from pathlib import Path

    from barloom.llm.store import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / "barloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    d = corpus_pipeline.run(spark, SMALL)
    assert {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before} <= {"pipeline-near", "pipeline-mix"}
    assert d.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert rows(queries.queries()[name](spark, SMALL).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())
