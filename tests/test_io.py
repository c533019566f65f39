"""Ingest matrix, export round trip, tiers, positions and the stream."""

import os

import pytest
from pyspark.sql import functions as F

from tonemill.operators.labeling import label_rules
from tonemill.operators.schema import MissingTextColumn, ensure_text, with_label_slots
from tonemill.operators.views import filter_labeled, navigate, preview_page, row_at, with_row_index
from tonemill.sinks import csv as sinks
from tonemill.sources.reviews import EmptyInputError, read_reviews, sample_reviews
from tonemill.streaming.labels import label_files_once, running_label_counts

# A small review file: CRLF line ends, one record with an unquoted comma.
REVIEW_CSV = (
    "id,text\r\n1,A wonderful lamp\r\n2,The hinge is terrible\r\n3,Fine, but loud\r\n"
    "4,It arrived on Monday\r\n5,awful smell\r\n6,excelent\r\n"
)


def _write(tmp, name, data: bytes):
    d = os.path.join(tmp, name.replace(".", "_"))
    os.makedirs(d)
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)
    return d


def test_review_csv(spark, tmp_out):
    df = read_reviews(spark, _write(tmp_out, "sample.csv", REVIEW_CSV.encode()))
    got = {r.id: (r.label, r.confidence) for r in label_rules(df).collect()}
    assert got == {"1": ("Positive", 76.25), "2": ("Negative", 76.25), "4": ("Neutral", 50.0), "5": ("Negative", 76.25), "6": ("Neutral", 50.0)}


def test_every_file_has_its_own_header_and_separator(spark, tmp_out):
    d = os.path.join(tmp_out, "folder")
    os.makedirs(d)
    files = {"a.csv": "id,text\n1,one\n".encode(), "b.tsv": "id\ttext\n2\ttwo, too\n".encode(), "c.csv": "text,id\nthree,3\n".encode(),
             "d.csv": "id,text,extra\n4,four,x\n".encode(), "e.csv": b"\n  \nid,text\n5,caf\xe9\n", "skip.dat": b"zzz\n"}
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    out = read_reviews(spark, d)
    got = sorted((r.id, r.text, r.extra) for r in out.select("id", "text", "extra").collect())
    assert got == [("1", "one", None), ("2", "two, too", None), ("3", "three", None), ("4", "four", "x"), ("5", "café", None)]
    assert sorted((r.extra or "") for r in out.select("extra").collect()) == ["", "", "", "", "x"]


def test_quotes_open_fields_only_and_blank_lines_go(spark, tmp_out):
    data = b'id,text\n2,say "hi, there" now\n3,say "hi" now\n   \n4,"a ""b, c"" d",x\n5,"a ""b, c"" d"\n6,"",\n7,\n\t\n'
    rows = {r.id: r.text for r in read_reviews(spark, _write(tmp_out, "q.csv", data)).collect()}
    assert rows == {"3": 'say "hi" now', "5": 'a "b, c" d', "7": None}
    one = read_reviews(spark, _write(tmp_out, "one.csv", b"text\nx\n   \ny\n"))
    assert sorted(r.text for r in one.collect()) == ["x", "y"]


def test_ingest_matrix(spark, tmp_out):
    data = b'id,text\n2,a,b\n6,x,\n7,"a, b",c\n3\n\n4,"quo""ted, ok"\n8,"m\nl"\n9,NA\n'
    rows = {r.id: r.text for r in read_reviews(spark, _write(tmp_out, "edge.csv", data)).collect()}
    assert rows == {"3": None, "4": 'quo"ted, ok', "8": "m\nl", "9": None}
    latin = read_reviews(spark, _write(tmp_out, "latin.csv", b"id,text\n1,caf\xe9\n")).first()
    assert latin.text == "café"
    tab = read_reviews(spark, _write(tmp_out, "t.tsv", b"id\ttext\n1\thello, world\n")).first()
    assert tab.text == "hello, world"
    bom = read_reviews(spark, _write(tmp_out, "bom.csv", b"\xef\xbb\xbf id , text \n1,a\n"))
    assert bom.columns == ["id", "text"]
    dup = read_reviews(spark, _write(tmp_out, "dup.csv", b"text,text\n1,a\n"))
    assert dup.columns == ["text", "text.1"]
    with pytest.raises(EmptyInputError):
        read_reviews(spark, _write(tmp_out, "hdr.csv", b"id,text\n"))
    with pytest.raises(EmptyInputError):
        read_reviews(spark, _write(tmp_out, "empty.csv", b""))


def test_ensure_text_and_slots(spark):
    df = spark.createDataFrame([("good",)], "review string")
    with pytest.raises(MissingTextColumn, match="columns are: review"):
        ensure_text(df)
    out = with_label_slots(ensure_text(df, "review"))
    assert out.columns == ["text", "label", "confidence"] and tuple(out.first()) == ("good", "", 0.0)


def test_export_round_trip_and_tiers(spark, tmp_out):
    labeled = label_rules(sample_reviews(spark).withColumn("text", F.concat(F.lit(' "q", '), "text", F.lit("\n "))))
    path = sinks.export_csv(labeled, os.path.join(tmp_out, sinks.export_name("Enhanced Rules (Fast)")))
    back = read_reviews(spark, path)
    got = sorted((r.text, r.label, float(r.confidence)) for r in back.collect())
    assert got == sorted((r.text, r.label, r.confidence) for r in labeled.collect())
    assert sinks.export_high(labeled, os.path.join(tmp_out, sinks.HIGH_NAME)) is True
    assert sinks.export_very_high(labeled, os.path.join(tmp_out, sinks.VERY_HIGH_NAME)) is False
    assert sinks.export_filtered(labeled, os.path.join(tmp_out, "all"), min_confidence=0) is False
    assert sinks.export_filtered(labeled, os.path.join(tmp_out, sinks.FILTERED_NAME), ["Positive"]) is True
    tiers = sinks.export_tiers(labeled, os.path.join(tmp_out, "tiers"))
    high = sinks.read_tiers(spark, tiers, ["high", "very_high"])
    assert high.count() == 1 and high.first().confidence == "85.0"


def test_positions(spark):
    df = spark.range(0, 57).withColumnRenamed("id", "k").repartition(5)
    ix = with_row_index(df, "k", num_partitions=4)
    assert sorted((r.k, r.row_idx) for r in ix.collect()) == [(i, i) for i in range(57)]
    assert row_at(ix, 56).first().position == 57
    assert [r.k for r in preview_page(ix, 50, 10).orderBy("k").collect()] == list(range(50, 57))
    assert navigate(0, "prev", 57) == 0 and navigate(56, "next", 57) == 56 and navigate(3, "last", 57) == 56
    assert navigate(3, "jump", 57, 99) == 56


def test_filter_identity_and_empty(spark):
    df = label_rules(sample_reviews(spark))
    assert filter_labeled(df).count() == 10
    assert filter_labeled(df, [], 0).count() == 0


def test_stream_equals_batch(spark, tmp_out):
    src = os.path.join(tmp_out, "in")
    sample_reviews(spark).write.parquet(src)
    schema = spark.read.parquet(src).schema
    streamed = label_files_once(spark, src, schema, out_path=os.path.join(tmp_out, "out"))
    batch = label_rules(sample_reviews(spark))
    assert sorted(tuple(r) for r in streamed.collect()) == sorted(tuple(r) for r in batch.collect())


def test_running_label_counts(spark, tmp_out):
    src = os.path.join(tmp_out, "in2")
    sample_reviews(spark).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = (running_label_counts(label_rules(stream)).writeStream.format("memory").queryName("tm_counts")
         .outputMode("complete").option("checkpointLocation", os.path.join(tmp_out, "ck")).start())
    q.processAllAvailable()
    q.stop()
    assert {r.label: r.n for r in spark.table("tm_counts").collect()} == {"Positive": 4, "Negative": 2, "Neutral": 4}


def test_keep_table_and_sample_export(spark, tmp_out):
    labeled = label_rules(sample_reviews(spark))
    kept = sinks.keep_table(labeled, os.path.join(tmp_out, "kept"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in labeled.collect())
    # The ten demo reviews export and read back as they are.
    path = sinks.export_csv(sample_reviews(spark), sinks.export_path(tmp_out, name="sample_data.csv"))
    assert sorted(r.text for r in read_reviews(spark, path).collect()) == sorted(
        r.text for r in sample_reviews(spark).collect())
    assert sinks.export_path("/x", "OpenAI GPT-3.5") == "/x/labeled_openai_gpt-3.5.csv"


def test_row_index_with_one_hot_key(spark):
    # Every row shares one key value: positions stay dense and unique, and
    # the rows are spread over several ranges instead of one task.
    df = spark.range(0, 300).select(F.lit(7).alias("k"), F.col("id").alias("v")).repartition(6)
    ix = with_row_index(df, "k", num_partitions=4)
    assert sorted(r.row_idx for r in ix.collect()) == list(range(300))
    per_part = [r[0] for r in ix.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per_part) > 1 and max(per_part) < 300


def test_mixed_encodings_decoded_per_file(spark, tmp_out):
    d = os.path.join(tmp_out, "mixed dir")
    os.makedirs(d)
    with open(os.path.join(d, "utf 8.csv"), "wb") as f:
        f.write("id,text\n1,café good\n".encode())
    with open(os.path.join(d, "latin.csv"), "wb") as f:
        f.write(b"id,text\n2,caf\xe9 bad\n")
    got = sorted(tuple(r) for r in read_reviews(spark, d).collect())
    assert got == [("1", "café good"), ("2", "café bad")]


def _counting(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(texts):
        calls.add(len(texts))
        return [("POSITIVE", 0.93)] * len(texts)

    return calls, scorer


def test_positions_and_exports_label_once(spark, tmp_out):
    from tonemill.operators.scoring import label_with_scorer
    from tonemill.operators.views import page_at

    base = spark.range(0, 40).select("id", F.concat(F.lit("text "), "id").alias("text"))
    for use in (
        lambda df: with_row_index(df, "id").collect(),
        lambda df: page_at(df, "id", 10, 5).collect(),
        lambda df: sinks.export_high(df, os.path.join(tmp_out, "high")),
        lambda df: sinks.export_filtered(df, os.path.join(tmp_out, "filtered"), ["Negative"], 50),
    ):
        calls, scorer = _counting(spark)
        use(label_with_scorer(base, scorer, distinct=False))
        assert calls.value == 40
    page = page_at(base, "id", 10, 5)
    assert sorted((r.row_idx, r.text) for r in page.collect()) == [(i, f"text {i}") for i in range(10, 15)]


def test_checkpoint_folder_is_required_off_local_mode():
    from tonemill import session

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session._local_checkpoint_root(master)


def test_scratch_is_cleared(spark, tmp_out):
    from tonemill import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = list(session._SCRATCH)
    session._SCRATCH[:] = [path]
    assert os.path.exists(path.removeprefix("file:")) and session.clear_scratch(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))
    session._SCRATCH[:] = kept[:-1]


def test_label_rules_has_no_exchange_and_no_lambda_rounding(spark):
    plan = label_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "transform(" not in plan
