"""Every bound query against its SQL on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

from tessera.plans import bindings
from tessera.plans import views as V

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(bindings.SQL))
def test_query(spark, sf_dir, con, name):
    df = bindings.QUERIES[name](spark, sf_dir)
    want = con.sql(bindings.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_beats_reach_the_last_note(spark, sf_dir, con):
    """The notes' beats, by brute force: each beat in which a note sounds is there."""
    want = {(p, b) for p, t0, t1 in con.sql(f"WITH {V.NOTES} SELECT piece_id, t0, t1 FROM notes").fetchall() for b in range(math.floor(t0 / 0.5), math.ceil(t1 / 0.5)) if t1 > t0}
    assert max(b for _, b in want) > 23
    assert {(r.piece_id, r.beat) for r in bindings.QUERIES["beat_chords"](spark, sf_dir).collect()} == want


def test_pages_that_hold_benchmark_texts(spark, tmp_path):
    """Against plain loops over a small fixture with pages that hold one text, several, one within another, and none."""
    items = [(1, "alpha beta"), (2, "beta"), (3, "gamma delta epsilon"), (4, "x" * 1500), (5, None)]
    pages = [(1, "u", "<p>alpha beta</p>"), (2, "u", "nothing"), (3, "u", "gamma delta epsilon beta"), (4, "u", "y" + "x" * 1600), (5, "u", None), (1, "u", "<p>alpha beta</p>")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = sorted((k, min((hashlib.md5(t.encode()).hexdigest() for t in [min((t for _, t in items if t and t in (h or "")), default="")] if t), default="")) for k, _, h in pages)
    got = bindings.QUERIES["ranked_match_pages"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.candidate_md5 or "") for r in got) == want


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(e.oracle_sql()) <= set(e.queries())
