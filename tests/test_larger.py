"""Queries against their SQL on small tables that have what the test tables lack: long numbers, many pages of one host."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from harrow.functions import scoring
from harrow.operators import similarity
from harrow.plans import catalog


@pytest.fixture
def differing(spark, tmp_path):
    """Rows that a query and its SQL do not have in common, over tables given as SQL for DuckDB."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, text in tables.items():
            con.execute(f"COPY ({text}) TO '{tmp_path}/{table}.parquet'")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
        want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
        assert want
        return [x for x, y in zip(got, want) if x != y][:3], len(got) - len(want)

    return run


def test_base64_of_long_numbers(differing):
    docs = "SELECT unnest([1, 9999, 10000, 123456, 9876543210123])::BIGINT AS doc_id, 'x' AS text"
    assert differing("deobf_base64", documents=docs) == ([], 0)


@pytest.mark.parametrize("name", ["sitemap_locs", "sitemap_priority"])
def test_a_sitemap_of_more_than_ten_thousand_pages(differing, name):
    pages = "SELECT i AS page_id, 'https://' || CASE WHEN i % 9 = 0 THEN 'b' ELSE 'a' END || '.de/' || CASE WHEN i > 12000 THEN 'en/' ELSE '' END || i AS url FROM range(12100) t(i)"
    assert differing(name, pages=pages) == ([], 0)


def test_join_of_thousands_of_names_with_common_letters(spark):
    """All bigrams are common here, so that an index of them lets nearly all pairs through."""
    import time

    rnd = random.Random(3)
    names = ["".join(rnd.choice("0123456789abcdef") for _ in range(14)) for _ in range(3000)]
    a, b = spark.createDataFrame([(x,) for x in names], "a string"), spark.createDataFrame([(x[:5] + x[6:],) for x in names], "b string")
    began = time.perf_counter()
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(a, b, 70).collect()}
    assert time.perf_counter() - began < 60
    assert all((x, x[:5] + x[6:]) in got for x in names)
    assert all(v == scoring.partial_similarity(*k) for k, v in rnd.sample(sorted(got.items()), 500))


def test_scores_of_long_strings_equal_the_loop(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdé😀") for _ in range(n))
    sizes = [0, 1, 20, 63, 64, 65, 130, 511, 512, 513, 600]
    rows = [(word(m), word(n), word(rnd.choice(sizes))) for m in sizes for n in sizes]
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    for r in frame.select("*", scoring.best_similarity()("a", "b", "c").alias("v")).collect():
        assert r.v == max(scoring.partial_similarity(r.a, r.b), scoring.partial_similarity(r.a, r.c))


def test_hits_of_names_are_the_work_of_many_tasks(spark, sf_dir):
    assert catalog._hits(spark, sf_dir).rdd.getNumPartitions() == 4
