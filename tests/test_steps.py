import pytest

from textloom.cli import answer
from textloom.operators import ingest
from textloom.plans.steps import SomeFailed, StepFailed, bootstrap_steps, exit_code, run_all, run_steps
from textloom.sources.config import Bootstrap


def test_steps():
    assert run_steps([("a", lambda: 1), ("b", lambda: 2)], {"b": False}) == {"a": 1}
    with pytest.raises(StepFailed) as e:
        run_steps([("bad", lambda: 1 / 0)])
    assert e.value.name == "bad"
    assert [exit_code(f) for f in (lambda: 0, lambda: run_steps([("x", lambda: 1 / 0)]), lambda: 1 / 0)] == [0, 2, 3]


def test_all_steps_run_and_say_how_they_ended():
    ran = []
    with pytest.raises(SomeFailed, match="1 of 3 failed: page: no file") as e:
        run_all([("page", lambda: (_ for _ in ()).throw(OSError("no file"))), ("links", lambda: ran.append(1)), ("targets", lambda: ran.append(2))])
    assert ran == [1, 2] and e.value.statuses == {"page": "failed: no file", "links": "imported", "targets": "imported"}
    assert run_all([("page", lambda: 1)]) == {"page": "imported"}
    assert exit_code(lambda: run_all([("x", lambda: 1 / 0)])) == 2


def test_toggles():
    out = bootstrap_steps(Bootstrap(download_dumps=False, export_seeds=False), lambda: 1, lambda: 2, lambda: 3)
    assert out == {"import": 2}


def test_pace(spark, monkeypatch):
    monkeypatch.setattr(ingest, "ROWS_PER_SHARE", 10)
    rows = spark.createDataFrame([("big", f"u{i}") for i in range(100)] + [("small", "v")], "host string, url_norm string")
    got = ingest.paced(rows, 1.0, 2).collect()
    starts = sorted(r.start_after for r in got if r.host == "big")
    assert len(got) == 101 and all(starts.count(s) <= 2 for s in starts)
    assert [r.start_after for r in got if r.host == "small"] == [0.0]


def test_watermark(spark):
    rows = spark.createDataFrame([(0, True), (1, False), (2, True)], "idx long, done boolean")
    assert ingest.low_watermark(rows).first().next_idx == 1
    assert ingest.low_watermark(rows.where("done")).first().next_idx == 3
    assert ingest.low_watermark(rows.limit(0)).first().next_idx == 0


def test_answers(spark):
    docs = spark.createDataFrame([(1, "the cat", "s"), (2, "the dog", "s")], "doc_id long, clean_text string, source_name string")
    postings = spark.createDataFrame([("the", 1), ("the", 2), ("cat", 1), ("dog", 2)], "term string, doc_id long")
    assert answer(postings, docs, "the AND cat") == ["1 found", "1 (s): the cat"]
    assert answer(postings, docs, "cat dog")[0].startswith("error: operator expected")
