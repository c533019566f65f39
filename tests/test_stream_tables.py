"""The stream query over a table that is one file and one that is a folder."""

import os

from tonemill.plans.q_io import q_label_rules_stream


def test_table_as_file_and_as_folder(spark, tmp_out):
    docs = spark.createDataFrame([(1, "great", "en", "a", 5), (2, "worst worst", None, "b", 11), (3, None, "en", None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    folder, file = os.path.join(tmp_out, "folder"), os.path.join(tmp_out, "file")
    docs.repartition(3).write.parquet(os.path.join(folder, "documents.parquet"))
    os.makedirs(file)
    docs.toPandas().to_parquet(os.path.join(file, "documents.parquet"))
    for at in (folder, file):  # other tables stand beside it
        docs.limit(1).write.parquet(os.path.join(at, "pages.parquet"))
    got = [sorted((r.doc_id, r.label) for r in q_label_rules_stream(spark, at).collect()) for at in (folder, file)]
    assert [k for k, _ in got[0]] == [1, 2, 3] and got[0] == got[1]
