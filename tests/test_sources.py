import csv
import os

import pytest
from pyspark.sql import functions as F

from askgrid.sources import documents, questionnaire, responses
from askgrid.streaming import upserts


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("uno\ndue".encode())
    (tmp_path / "b.md").write_bytes(b"uno\r\ndue\rtre")
    (tmp_path / "bad.md").write_bytes(b"ab\xffcd")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("no")
    good, rejected = documents.read_text_files(spark, str(tmp_path))
    assert {os.path.basename(r.path): r.text for r in good.collect()} == {"a.md": "uno\ndue", "b.md": "uno\ndue\ntre"}
    assert [os.path.basename(r.path) for r in rejected.collect()] == ["bad.md"]


def test_pages(spark):
    pages = spark.createDataFrame([("d", 2, "c"), ("d", 0, "a"), ("e", 0, "x"), ("d", 1, "b")], "doc_id string, page_no int, text string")
    assert {r.doc_id: r.text for r in documents.assemble_pages(pages).collect()} == {"d": "a\n\nb\n\nc", "e": "x"}


def sheet_rows(n, questions, header=True):
    names = ["ID", "Area", questionnaire.QUESTION_COLUMN] + [f"N{i}" for i in range(3, n)]
    rows = [names] if header else []
    return rows + [[str(i), "a", q] + [f"v{j}" for j in range(3, n)] for i, q in enumerate(questions)]


@pytest.fixture
def workbook(tmp_path):
    def write(name, rows, n):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow([f"Unnamed {i}" for i in range(n)])
            out.writerows([["" if c is None else c for c in r] for r in rows])

    s = questionnaire.SHEETS
    write(s[0], sheet_rows(8, ["q1", None, "q1"]), 8)
    write(s[1], sheet_rows(9, ['multi\nline "quoted", q']), 9)
    write(s[2], sheet_rows(10, ["q2"]), 10)
    write(s[3], [], 8)
    write(s[4], [[f"H{i}" for i in range(8)], [str(i) for i in range(8)]], 8)
    write(s[5], sheet_rows(7, ["lost"]), 7)
    return str(tmp_path)


def test_questionnaire(spark, workbook):
    sheets, rejected = questionnaire.load_questionnaire(spark, workbook)
    s = questionnaire.SHEETS
    assert list(rejected) == [s[5]] and list(sheets) == list(s[:5])
    assert questionnaire.cells(sheets[s[0]]) == ["ID", "Area", questionnaire.QUESTION_COLUMN, "N3"]
    assert questionnaire.cells(sheets[s[1]]) == ["ID", "Area", questionnaire.QUESTION_COLUMN, "N3"]
    usable, skipped = questionnaire.with_questions(sheets)
    assert skipped == [s[3], s[4]]
    got = questionnaire.extract_questions(sheets).orderBy("sheet_no", "row_no").collect()
    assert [(r.sheet_no, r.question) for r in got] == [(0, "q1"), (0, "q1"), (1, 'multi\nline "quoted", q'), (2, "q2")]
    head = questionnaire.sheet_head(questionnaire.extract_questions(sheets), 1).collect()
    assert len(head) == 3


def test_dropped_positions():
    assert [list(questionnaire.columns_to_drop(n)) for n in (8, 9, 10, 14)] == [
        [4, 5, 6, 7], [4, 5, 6, 7, 8], [4, 5, 6, 7, 8, 9], [4, 5, 6, 7, 8, 9]]
    with pytest.raises(ValueError):
        questionnaire.columns_to_drop(7)


def test_responses_append_and_update(spark, tmp_path):
    path = str(tmp_path / "responses")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    full = spark.createDataFrame(
        [("r1", 0, "q", "Si", "c", "j"), ("r2", 0, "q", "No", None, "j"), ("r1", 1, "p", "No", "c", "j")],
        "run_id string, question_id long, question string, answer string, context string, justification string")
    responses.append_responses(full, path, at)
    responses.append_responses(spark.createDataFrame([(7, "old", "a")], "question_id long, question string, answer string"), path, at)
    stored = responses.read_responses(spark, path)
    assert stored.count() == 4 and stored.columns == responses.COLUMNS
    legacy = stored.filter("question_id = 7").first()
    assert legacy.context is None and legacy.ts == "2024-01-02 03:04:05"
    updates = spark.createDataFrame(
        [(0, "Si, ma", None, "nc", "T"), (99, "x", "x", "x", "T")],
        "question_id long, answer string, justification string, context string, ts string")
    got = responses.update_responses(stored, updates).collect()
    changed = [r for r in got if r.question_id == 0]
    assert len(got) == 4 and len(changed) == 2
    assert all((r.answer, r.justification, r.context, r.ts) == ("Si, ma", None, "nc", "T") for r in changed)
    assert next(r for r in got if r.question_id == 1).answer == "No"


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "q int, answer string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, None, 2), (3, "d", 1)], stored.schema)
    got = responses.upsert_responses(stored, new, ["q"], "version").collect()
    assert {(r.q, r.answer) for r in got} == {(1, "a"), (2, None), (3, "d")}


def test_stream_of_repeated_answers(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "q int, answer string, version int"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        upserts.stream_upserts(stream, ["q"], "version", out, state).awaitTermination()
        return {(r.q, r.answer) for r in upserts.read_latest(spark, out, ["q"], "version").collect()}

    assert arrive((1, "a", 1), (1, "b", 2), (2, "x", 1)) == {(1, "b"), (2, "x")}
    assert arrive((1, "c", 3), (2, "late", 0)) == {(1, "c"), (2, "x")}
