"""A kept position index: lookups against the plain order, and their plans."""

import pytest

from tonemill.operators import row_index


@pytest.mark.parametrize("rows_of_block, blocks", [(100_000, 10_000), (7, 10_000), (1, 4)])
def test_rows_and_pages(spark, tmp_out, monkeypatch, rows_of_block, blocks):
    monkeypatch.setattr(row_index, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(row_index, "MAX_BLOCKS", blocks)
    values = [(i * 37 % 101, f"v{i}", None if i % 9 else "x") for i in range(60)]
    df = spark.createDataFrame(values, "k int, `odd.name` string, row_idx string").repartition(5)
    row_index.build(df, "k", f"{tmp_out}/index")
    index = row_index.RowIndex(spark, f"{tmp_out}/index")
    want = sorted(values)
    assert index.n == 60 and index.columns == ["k", "odd.name", "row_idx"]
    for i in (-5, 0, 1, 6, 7, 33, 59, 500):
        row, = index.row_at(i).collect()
        at = min(max(i, 0), 59)
        assert (row.k, row["odd.name"], row.row_idx, row.position) == (*want[at][:2], at, at + 1)
    for offset, size in ((0, 5), (5, 20), (58, 10), (70, 3), (3, 0)):
        assert [r.k for r in sorted(index.page(offset, size).collect(), key=lambda r: r.row_idx)] == [w[0] for w in want[offset:offset + size]]
    with pytest.raises(ValueError):
        index.page(-1, 2)


def test_a_lookup_prunes_and_neither_sorts_nor_exchanges(spark, tmp_out, monkeypatch):
    monkeypatch.setattr(row_index, "BLOCK_ROWS", 10)
    index = row_index.build(spark.range(100).withColumnRenamed("id", "k"), "k", f"{tmp_out}/index")
    look = index.row_at(57)
    plan = look._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull(__tm_block" in plan and "ExistingRDD" not in plan
    assert look.first().k == 57 and {name.split("__tm_block=")[1].split("/")[0] for name in look.inputFiles()} >= {"5"}


def test_empty_table_and_ties(spark, tmp_out):
    empty = row_index.build(spark.createDataFrame([], "k int, v string"), "k", f"{tmp_out}/empty")
    assert empty.n == 0 and empty.row_at(3).count() == 0 and empty.page(0, 5).count() == 0
    ties = row_index.build(spark.createDataFrame([(1, c) for c in "abcde"], "k int, v string").coalesce(1), ["k"], f"{tmp_out}/ties")
    assert "".join(r.v for r in sorted(ties.page(0, 9).collect(), key=lambda r: r.row_idx)) == "abcde"
