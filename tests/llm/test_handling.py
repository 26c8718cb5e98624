"""Empty tables, repeated rows, very long texts and clashing names where other tests do not go."""

import corpus_pipeline

from veriflume.llm import style_tree, url_filter


def test_url_rules_of_repeated_rows_and_nothing(spark):
    rows = [(1, "http://a.net/x")] * 3 + [(None, "http://a.net/x"), (2, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS verdict")
    got = [tuple(r[c] for c in ("page_id", "host", "rule", "verdict")) for r in url_filter.judge(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "a.net", "net/", "block")] * 3 + [(None, "a.net", "net/", "block"), (2, "", None, "allow")], key=str)
    assert url_filter.judge(pages.where("false")).count() == 0


def test_style_tree_of_long_pages_by_joins(spark):
    rows = [(i, f"http://one.example/{i}", f"<body><nav>Menu</nav><article><p>{f'word{i} ' * 200_000}</p></article></body>") for i in range(3)] + [(7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    near, far = (sorted(map(tuple, style_tree.extract(pages, broadcast_rows=n).collect())) for n in (1000, 0))
    assert near == far and [len(r[2]) for r in far] == [1_199_999] * 3 + [0]


def tables(spark, tmp_path, documents):
    d = "/root/testdata/sf0.001"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_of_no_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, docs.where("false")))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id"} <= set(out.columns)


def test_pipeline_with_clashing_names(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    extra = docs.selectExpr("*", "1 AS piece", "2 AS component_id", "'x' AS label", "3 AS n", "4 AS kept", "true AS contaminated", "5 AS toxic", "6 AS key", "7 AS a", "8 AS row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (stage(spark, x, "/root/testdata/sf0.001") for x in (docs, extra))
        assert wide.columns == extra.columns and plain.columns == docs.columns, name
        assert sorted(map(tuple, wide.select(docs.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str), name
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, extra)).count() > 0
