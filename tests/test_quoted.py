"""Files with quoted newlines, read by many tasks: the rows of the one-task parse."""

import csv
import io
import os
import random

import pytest

from tonemill.sources.quoted import _flagged, read_records
from tonemill.sources.reviews import read_reviews


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def random_file(seed, sep=",", end="\n"):
    rng = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow(["id", "text", "more"])
    bits = ["a", "b c", '"', '""', "\n", "\n\n", sep, "é", "x" * 40, '\n"', f'"{sep}"']
    for i in range(60):
        w.writerow([i, "t" + "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 9, 40]))), "".join(rng.choice(bits) for _ in range(rng.randint(0, 3))) + "m"])
        if rng.random() < 0.1:
            out.write(end)
        if rng.random() < 0.1:
            out.write(f'{100 + i}{sep}say "hi" now 5"{sep}z{end}')
    return out.getvalue()


def put(folder, name, data: bytes):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_rows_as_one_task(spark, tmp_out, small_splits):
    for seed in range(2):
        d = os.path.join(tmp_out, f"f{seed}")
        put(d, "a.csv", random_file(seed).encode())
        put(d, "b.tsv", random_file(seed + 50, "\t").encode())
        put(d, "c.csv", ("\n" + random_file(seed + 90)).encode("latin-1"))
        split = read_reviews(spark, d, multi_line="split")
        want = read_reviews(spark, d)
        assert rows(split) == rows(want) and split.count() >= 180
        assert rows(split.select("text")) == rows(want.select("text"))


def test_many_tasks_share_a_file(spark, tmp_out, small_splits):
    put(tmp_out, "a.csv", random_file(7).encode())
    lines = _flagged(spark, tmp_out, ",", "UTF-8", "*.csv")
    assert lines.rdd.getNumPartitions() > 5
    assert read_records(spark, tmp_out, ",", "UTF-8", "*.csv").count() >= 60


def test_one_record_over_many_splits(spark, tmp_out, small_splits):
    long = "\n".join(f"line {i}, with \"\"quotes\"\"" for i in range(200))
    put(tmp_out, "a.csv", f'id,text\n1,"{long}"\n2,two\n3,"a\r\nb"\r\n'.encode())
    got = {r.id: r.text for r in read_reviews(spark, tmp_out, multi_line="split").collect()}
    assert got == {"1": long.replace('""', '"'), "2": "two", "3": "a\nb"}


def test_short_long_blank_and_unclosed(spark, tmp_out, small_splits):
    data = b'\xef\xbb\xbfid,text\n2,a,b\n6,x,\n7,"a, b",c\n3\n\n   \n4,"quo""ted, ok"\n8,"m\nl"\n9,NA\n5,6" disk\n1,"open\nto the, end\n'
    put(tmp_out, "a.csv", data)
    got, want = rows(read_reviews(spark, tmp_out, multi_line="split")), rows(read_reviews(spark, tmp_out))
    assert got[1:] == want[1:] and got[0] == ("1", "open\nto the, end")
    assert want[0] == ("1", "open\nto the, end\n")  # never closed: only the file's last line end differs


def test_lines_are_walked_twice_however_often_records_are_read(spark, tmp_out):
    folder = os.path.join(tmp_out, "walked")
    put(folder, "a.csv", random_file(3).encode())
    records = read_records(spark, folder, ",", "UTF-8", "*")
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "Python" not in plan and "Exchange" not in plan
    assert records.count() == records.count() > 0
