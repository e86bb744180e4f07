"""Numbered lines and strict question sets."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import lines as L

GOOD = {"id": "q1", "question": "What?", "query_type": "conceptual", "topic": "t", "expected_url_keywords": ["a.html"], "answerable": True, "expected_answer": "x", "required_facts": ["f"]}


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, n in (("a.txt", 700), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / "d" / name).write_text("".join(f"{name} line {k}\n" if k % 5 else "\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        rows = L.numbered(spark, str(tmp_path / "d")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 703
    for r in rows:
        name = r["file"].rsplit("/", 1)[1]
        assert r["value"] == (f"{name} line {r['line']}" if r["line"] % 5 else "")


def problems(spark, kind, *changes, raw=()):
    rows = []
    for n, change in enumerate(changes):
        row = {**GOOD, "id": f"q{n}", **change}
        rows.append(json.dumps({k: v for k, v in row.items() if v != "absent"}))
    values = [*rows, *raw]
    df = spark.createDataFrame([("f", n, v) for n, v in enumerate(values, 1)], "file string, line bigint, value string")
    return [r["problem"] for r in L.questions(df, kind).orderBy("line").collect()]


NO = {"answerable": False, "expected_answer": "absent", "expected_url_keywords": [], "required_facts": [], "reason": "none", "expected_behavior": "abstain"}


def test_every_kind_tells_its_first_problem(spark):
    wrong = "expected_url_keywords must be a non-empty string list"
    assert problems(spark, "retrieval", {}, {"question": " "}, {"question": 5}, {"expected_url_keywords": []}, {"expected_url_keywords": ["a", 1]}, {"expected_url_keywords": ["a", " "]}, {"id": "absent", "query_type": None, "topic": "absent"}, {"topic": None}, {"query_type": "odd"}, raw=("{", "[1]", " ", '"x"')) == [
        None, "question must not be empty", "question must not be empty", wrong, wrong, wrong, None, "id, query_type, topic must all be non-empty strings", "unsupported query_type", "invalid JSON", "expected a JSON object", "expected a JSON object",
    ]
    assert problems(spark, "holdout", {}, {"id": "absent", "query_type": None, "topic": "absent"}) == [None, "id, query_type, topic must all be non-empty strings"]
    assert problems(spark, "rag", {}, {"answerable": False}, {"answerable": "true"}, {"expected_answer": ""}, {"required_facts": "f"}, {"topic": " "}) == [None, "answerable must be true", "answerable must be true", "expected_answer must not be empty", "required_facts must be a non-empty string list", "topic must not be empty"]
    assert problems(spark, "answerability", {}, NO, {"answerable": 1}, {"expected_url_keywords": []}, {**NO, "expected_url_keywords": ["u"]}, {**NO, "reason": "absent"}, {**NO, "expected_behavior": "answer"}, {"query_type": "odd"}, {"query_type": "absent", "topic": "absent"}) == [
        None, None, "answerable must be a boolean", "answerable cases require expected_url_keywords", "unanswerable cases require empty expected_url_keywords", "reason must not be empty", "expected_behavior must be abstain", "unsupported query_type", None,
    ]
    assert problems(spark, "portability", {}, NO, {"reason": "r"}, {**NO, "expected_answer": "x"}, {"required_facts": [1]}, {"required_facts": "absent"}, {"question": ""}) == [
        None, None, "answerable cases require keywords and facts and no reason", "unanswerable cases have no answer, keywords or facts", "required_facts must be a string list", "answerable cases require keywords and facts and no reason", "question must not be empty",
    ]
    with pytest.raises(ValueError, match="unknown kind"):
        problems(spark, "other", {})


def test_ids_repeat_or_overlap_and_strict_names_the_line(spark):
    values = [json.dumps(GOOD), json.dumps({**GOOD, "question": " again "}), json.dumps({**GOOD, "id": " q2 "})]
    df = spark.createDataFrame([("f", n, v) for n, v in enumerate(values, 1)], "file string, line bigint, value string")
    known = spark.createDataFrame([("q2",), (None,)], "id string")
    got = L.questions(df, "holdout", known).orderBy("line").collect()
    assert [r["problem"] for r in got] == [None, "duplicate id", "id is a development question's"] and got[1]["question"] == "again"
    assert L.strict(L.questions(df.where("line <> 2"), "retrieval")).count() == 2
    with pytest.raises(Exception, match="line 2: duplicate id"):
        L.strict(L.questions(df, "retrieval")).agg(F.max("line")).collect()


def test_the_registered_sets_match_their_sql(spark):
    import duckdb

    from corvane.plans import documents as D

    path, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{path}/benchmark.parquet'")
    run, sql = D.QUERIES["question_lines"]
    df, result = run(spark, path), con.sql(sql)
    places = [result.columns.index(c) for c in df.columns]
    got, want = sorted(map(tuple, df.collect()), key=str), sorted((tuple(r[p] for p in places) for r in result.fetchall()), key=str)
    assert got == want and len({r[2] for r in got}) > 2
