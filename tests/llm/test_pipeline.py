import importlib

import corpus_pipeline

from harrow.llm import graph, queries
from harrow.llm.common import table


def test_stages_in_order_and_their_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
            docs = docs.persist()
            counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_neardup", "suffix_dedup", "secret_scan", "bestfit_packing"]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).collect()


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(500, 500), (7, 7)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.root for r in graph.components(frame).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 180), 100)}
    assert graph.components(frame.where("false")).count() == 0


def test_every_operator_has_a_query():
    own = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in own) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(own)
    importlib.import_module("__spark_entry__")


def test_no_column_name_clashes(spark, sf_dir):
    """Columns called like those the stages make for themselves stay as they are and change nothing."""
    from pyspark.sql import functions as F

    from harrow.llm import neardup, secretscan, suffix
    from harrow.llm.common import table

    docs = table(spark, sf_dir, "documents")
    names = """keep_doc_id keep_text_key keep_id keep_key harrow_text_key harrow_rank rank row key root sid text_key bands shingles node src dst harrow_spans
        harrow_spans_ spans harrow_key new harrow_text harrow_assign harrow_access harrow_hex harrow_markov harrow_stretch harrow_table c0 c1""".split()
    more = docs.withColumns({n: F.concat(F.lit("z"), F.col("doc_id").cast("string")) for n in names})
    ratios = secretscan.train(docs, table(spark, sf_dir, "labels"))
    stages = [neardup.keep_one, lambda d: suffix.strip_documents(d, window=250), lambda d: secretscan.redact(secretscan.scan(d, ratios), d.columns)]
    for stage in stages:
        plain, wide = stage(docs), stage(more)
        assert plain.columns == docs.columns and wide.columns == more.columns
        want = {r.doc_id: tuple(r) for r in plain.collect()}
        got = wide.collect()
        assert {r.doc_id: tuple(r)[: len(docs.columns)] for r in got} == want
        assert all(set(tuple(r)[len(docs.columns) :]) == {f"z{r.doc_id}"} for r in got)
    texts = docs.withColumn("n_chars", F.concat(F.lit("n"), F.col("n_chars").cast("string")))
    for stage in stages[1:]:
        assert stage(texts).count() == stage(docs).count()
        assert stage(docs.withColumn("n_chars", F.current_date())).select("n_chars").distinct().count() == 1
