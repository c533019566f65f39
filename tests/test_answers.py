"""Stored answers, provenance of labels, votes with gaps, cursors, mixed folders."""

import os
import subprocess
import sys
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from tonemill.functions.vote import ensemble_vote
from tonemill.operators import ensemble, scoring, views
from tonemill.operators.answers import AnswerTable, FallbackError, check_fallback, paced
from tonemill.sources import reviews


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string").repartition(4)


def counting(spark, fail=()):
    asked = spark.sparkContext.accumulator(0)

    def scorer(inputs: pd.Series) -> pd.DataFrame:
        if any(x in fail for x in inputs):
            raise RuntimeError("down")
        asked.add(len(inputs))
        return pd.DataFrame({"label": ["positive"] * len(inputs), "score": [0.5] * len(inputs)})

    return asked, scorer


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_every_input_is_asked_once_over_all_runs(spark, tmp_out, monkeypatch, broadcast):
    monkeypatch.setattr("tonemill.operators.answers.BROADCAST_ANSWERS", broadcast)
    path, (asked, scorer) = f"{tmp_out}/answers", counting(spark)
    first = texts(spark, [f"text {i % 10}" for i in range(200)] + [None, ""])
    out = scoring.label_with_scorer(first, scorer, answers=path, batches=3, source_col="by")
    assert out.count() == 202 and {(r.label, r.confidence, r.by) for r in out.collect()} == {("Positive", 52.0, "model")}
    assert asked.value == 12  # ten texts, the empty one and the null's text
    more = texts(spark, [f"text {i}" for i in range(15)])
    assert scoring.label_with_scorer(more, scorer, answers=path).count() == 15
    assert asked.value == 17


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_out):
    path, df = f"{tmp_out}/answers", texts(spark, [f"text {i}" for i in range(40)])
    asked, scorer = counting(spark)
    table = AnswerTable(spark, path, "label string, score double")
    seen = []

    def udf_of(model):
        if len(seen) == 2:
            raise KeyboardInterrupt
        seen.append(1)
        return scoring._classifier(model, False)

    with pytest.raises(KeyboardInterrupt):
        table.fill(df, F.col("text"), udf_of, scorer, batches=4)
    done = asked.value
    assert 0 < done < 40 and table.stored().count() == done
    table.fill(df, F.col("text"), lambda m: scoring._classifier(m, False), scorer, batches=4)
    assert asked.value == 40 and table.unseen(df, F.col("text")).count() == 0


def test_inputs_without_a_result_are_asked_again(spark, tmp_out):
    path, df = f"{tmp_out}/answers", texts(spark, ["good", "bad", "worse"])
    _, failing = counting(spark, fail=("bad",))
    out = scoring.label_with_scorer(df, failing, answers=path, source_col="by").collect()
    assert {r.text: r.by for r in out} == {"good": "model", "bad": "rules", "worse": "model"}
    asked, scorer = counting(spark)
    assert {r.by for r in scoring.label_with_scorer(df, scorer, answers=path, source_col="by").collect()} == {"model"}
    assert asked.value == 1


def test_two_answers_for_one_key_and_clashing_columns(spark, tmp_out):
    path = f"{tmp_out}/answers"
    df = texts(spark, ["a", "b"]).withColumns({"label": F.lit("own"), "score": F.lit(7), "response": F.lit("own")})
    asked, scorer = counting(spark)
    scoring.score_texts(df, scorer, answers=path)
    spark.read.parquet(path).withColumn("label", F.lit("a smaller label")).write.mode("append").parquet(path)
    out = scoring.score_texts(df, scorer, answers=path)
    assert sorted((r.id, r.label, r.score, r.model_label) for r in out.collect()) == [(0, "own", 7, "a smaller label"), (1, "own", 7, "a smaller label")]
    said = scoring.respond(df, lambda p: [f"{len(x)}" for x in p], "plain", answers=f"{path}-2")
    assert said.count() == 2 and said.columns.count("response") == 1
    answers = spark.createDataFrame([(0, "Positive 90"), (0, "Negative 80"), (1, None), (7, "x")], "id long, response string")
    assert sorted((r.id, r.label) for r in scoring.label_with_responses(df.select("id", "text"), "id", answers).collect()) == [(0, "Negative"), (1, "Neutral")]


def test_requests_keep_to_a_rate():
    calls = []
    model = paced(lambda x: calls.append(len(x)) or [str(v) for v in x], per_minute=600)
    began = time.monotonic()
    assert model(pd.Series(range(20))) == [str(i) for i in range(20)]
    assert time.monotonic() - began >= 1.9 and max(calls) <= 10


def test_an_outage_is_an_error(spark):
    def down(inputs):
        raise RuntimeError("down")

    out = scoring.label_with_scorer(texts(spark, ["good", "bad"]), down, source_col="source_of_label")
    assert {r.source_of_label for r in out.collect()} == {"rules"}
    with pytest.raises(FallbackError, match="2 of 2"):
        check_fallback(out)
    assert check_fallback(out, most=1.0) is out and check_fallback(out.limit(0)).count() == 0


@pytest.mark.parametrize("votes", [
    [("P", 0.5), ("P", 0.7), None], [None, ("N", 0.6), ("P", 0.9)], [None, None, ("P", 0.3)], [None, None, None],
    [("P", 0.5), ("N", 0.5), None], [("P", 0.5), (None, 0.9), ("N", 0.4)], [None], [("P", 0.9)],
])
def test_both_forms_of_the_vote_leave_nulls_out(spark, votes):
    kind = "struct<label:string,confidence:double>"
    df = spark.createDataFrame([(1, *votes)], "id long, " + ", ".join(f"m{i} {kind}" for i in range(len(votes))))
    names = [f"m{i}" for i in range(len(votes))]
    wide = df.select(ensemble_vote(*map(F.col, names)).alias("e")).select("e.*").first()
    long = ensemble.ensemble_vote_long(ensemble.votes_from_results(df, "id", [(n, n) for n in names]), "id").select("label", "confidence").first()
    given = [v for v in votes if v and v[0]]
    best = max({v[0] for v in given}, key=lambda lab: (sum(v[0] == lab for v in given), -[v[0] for v in given].index(lab)), default=None)
    mean = [v[1] for v in given if v[0] == best]
    want = sum(mean) / len(mean) if mean else None
    if mean and len(mean) == len(given):
        want = min(want + 0.1, 0.98)
    assert (wide.label, long.label) == (best, best)
    assert (wide.confidence, long.confidence) == ((pytest.approx(want),) * 2 if mean else (None, None))


KEYED = [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f"), (3, "g"), (3, None), (3, None), (4, "h")]


@pytest.mark.parametrize("keys", [["k"], ["k", "v"], ["v"]])
@pytest.mark.parametrize("size", [1, 2, 3, 20])
def test_pages_by_cursor_show_each_row_once(spark, keys, size):
    df = spark.createDataFrame(KEYED, "k int, v string").coalesce(2).cache()
    order = lambda r: tuple((r[k] is not None, r[k]) for k in keys)
    for way, end in (("next", -1), ("previous", 0)):
        seen, cursor = [], None
        while rows := views.page_by_cursor(df, keys, cursor, size, way).collect():
            assert [order(r) for r in rows] == sorted(order(r) for r in rows)
            seen = seen + rows if way == "next" else rows + seen
            cursor = tuple(rows[end][k] for k in keys)
        assert sorted(map(tuple, seen), key=repr) == sorted(KEYED, key=repr) and [order(r) for r in seen] == sorted(order(r) for r in seen)
    df.unpersist()


def test_first_last_and_wrong_cursors(spark):
    df = spark.createDataFrame(KEYED, "k int, v string")
    assert [r.k for r in views.page_by_cursor(df, "k", size=2, direction="first").collect()] == [None, None]
    assert [r.k for r in views.page_by_cursor(df, "k", size=1, direction="last").collect()] == [4]
    assert views.page_after(df, "k", 4, 5).count() == 0 and views.page_after(df.limit(0), "k", None, 5).count() == 0
    assert [r.k for r in views.page_after(df, "k", (None,), 2).collect()] == [1, 1, 1]
    for wrong in ({"cursor": (1, 2)}, {"direction": "up"}, {"size": -1}):
        with pytest.raises(ValueError):
            views.page_by_cursor(df, "k", **wrong)


def test_each_kind_scans_its_own_files_only(spark, tmp_out, monkeypatch):
    scanned, parsed = [], reviews._parsed

    def recorded(spark, path, *rest):
        scanned.append(path)
        return parsed(spark, path, *rest)

    monkeypatch.setattr(reviews, "_parsed", recorded)
    os.makedirs(f"{tmp_out}/in")
    for i in range(60):  # thirty kinds of two files
        with open(f"{tmp_out}/in/odd [name] {{{i}}} a*b%20c?.csv", "w") as f:
            f.write(f"id,extra{i % 30}\n{i},x{i}\n")
    out = reviews.read_reviews(spark, f"{tmp_out}/in")
    want = sorted((str(i), f"x{i}") for i in range(60))
    assert sorted((r.id, next(v for k, v in r.asDict().items() if k != "id" and v)) for r in out.collect()) == want
    assert len(scanned) == 30 and all(len(p) == 2 for p in scanned) and len({x for p in scanned for x in p}) == 60
    monkeypatch.setattr(reviews, "LISTED_FILES", 5)
    again = reviews.read_reviews(spark, f"{tmp_out}/in")
    assert sorted((r.id, next(v for k, v in r.asDict().items() if k != "id" and v)) for r in again.collect()) == want


def test_entry_without_the_optional_part(tmp_out):
    """The library imports with the optional subpackage hidden, the pipeline's file there or not."""
    code = ("import sys, importlib.abc\n"
            "class Hidden(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in HIDDEN: raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Hidden())\n"
            "import __spark_entry__ as e\n"
            "assert 'label_rules' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n")
    for hidden in ("{'tonemill.llm'}", "{'tonemill.llm', 'corpus_pipeline'}"):
        subprocess.run([sys.executable, "-c", f"HIDDEN = {hidden}\n{code}"], cwd=ROOT, check=True)


def test_a_live_report_reads_new_files_only(spark, tmp_out, monkeypatch):
    from tonemill.operators import live_report
    from tonemill.operators.labeling import label_rules
    from tonemill.operators.report import report_metrics

    folder, asked = f"{tmp_out}/odd [in] a%20b", []
    pattern = folder.replace("[", "\\[").replace("]", "\\]")

    def read(paths):
        asked.append(len(paths))
        return spark.read.parquet(*paths)

    kept = live_report.LiveReport(spark, f"{tmp_out}/store", read)
    add = lambda words, mode="append": texts(spark, words).coalesce(1).write.mode(mode).parquet(folder)

    def same():
        got = kept.report(pattern).collect()
        return got == report_metrics(label_rules(spark.read.parquet(pattern))).select(*got[0].asDict()).collect()

    add(["good day", "bad day", "day", None])
    assert same() and asked == [1]
    add(["great great", "excellent amazing wonderful fantastic"])
    assert same() and asked == [1, 1]
    assert same() and asked == [1, 1]  # nothing new, nothing read
    spark.createDataFrame([], "id long, text string").coalesce(1).write.mode("append").parquet(folder)
    assert same()
    read_so_far = len(asked)
    add(["terrible"], "overwrite")  # the other files are gone
    assert same() and len(asked) == read_so_far + 1
    monkeypatch.setattr(live_report, "FILES_AT_ONCE", 2)
    for k in range(5):
        add([f"good {k}"])
    assert same() and asked[read_so_far + 1:] == [2, 2, 1]
    spark.read.parquet(kept.store).write.mode("append").parquet(f"{kept.store}-copy")
    spark.read.parquet(f"{kept.store}-copy").write.mode("append").parquet(kept.store)  # stored twice counts once
    assert same()
