import json

import pytest

from lodestack.sources import files, sinks


def test_jsonl_round_trip(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "v": 2, "x": [1]}\n\n{"id": "é", "v": null}\n', encoding="utf-8")
    df = files.jsonl(spark, str(p), "id string, v int", file_column="file")
    assert df.count() == 2 and df.where("file is not null").count() == 2
    assert files.jsonl(spark, str(p), "id string, v int", required=("v",)).count() == 1
    assert files.jsonl(spark, [str(p), str(tmp_path / "none")], "id string", optional=True).count() == 2
    assert files.jsonl(spark, str(tmp_path / "none"), "id string", optional=True).count() == 0
    with pytest.raises(files.BadInput):
        files.jsonl(spark, str(p), "id string", required=("prompt",))
    sinks.jsonl(df.drop("file"), str(tmp_path / "out"), by=["id"], order=["v"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_bad_line_is_named(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"id": 1}\n\n{"id": \n{"id": 3}\n')
    assert files.first_bad_line(spark, str(p)) == "bad.jsonl:3"
    with pytest.raises(Exception):
        files.jsonl(spark, str(p), "id int").collect()
    p.write_text('{"id": 1}\n')
    assert files.first_bad_line(spark, str(p)) is None


def test_documents_digests_and_reports(spark, tmp_path):
    sinks.document({"a": [1, "é"]}, str(tmp_path / "d.json"))
    assert files.document(spark, str(tmp_path / "d.json")) == {"a": [1, "é"]}
    assert files.digests(spark, str(tmp_path / "d.json")).first().bytes == (tmp_path / "d.json").stat().st_size
    one = spark.createDataFrame([("x|y", 1)], "k string, n int")
    assert sinks.row_document(one, str(tmp_path / "row.json")) == {"k": "x|y", "n": 1} == json.loads((tmp_path / "row.json").read_text())
    assert sinks.markdown(one).endswith("| x\\|y | 1 |\n")
    with pytest.raises(ValueError):
        sinks.row_document(one.unionAll(one), str(tmp_path / "row.json"))


def test_replay_needs_every_row(spark, tmp_path):
    p = tmp_path / "raw.jsonl"
    p.write_text('{"response_id": "1", "raw_output": "x"}\n')
    rows = spark.createDataFrame([("1",), ("2",)], "response_id string")
    with pytest.raises(files.BadInput):
        files.replay(spark, rows, str(p), "response_id string, raw_output string", "response_id")


def test_annotations_of_a_folder(spark, tmp_path):
    (tmp_path / "review_items.jsonl").write_text('{"item_id": "1", "code": "x"}\n{"item_id": "2", "code": "y"}\n')
    (tmp_path / "annotations.jsonl").write_text('{"item_id": "1", "label": "a"}\n{"item_id": "1", "label": "b"}\n{"item_id": "9", "label": "c"}\n')
    got = {r.item_id: r.label for r in files.annotations(spark, str(tmp_path), "item_id string, code string", "item_id string, label string").collect()}
    assert got == {"1": "b", "2": None}


def test_checked_reads_and_order_in_files(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text("".join(f'{{"k": "x{i % 3}", "raw_output": "v{i}"}}\n' for i in range(50)))
    bad.write_text('{"k": "x"}\n\nnot json\n')
    schema = "k string, raw_output string"
    with pytest.raises(files.BadInput, match="b.jsonl:3"):
        files.jsonl(spark, [str(good), str(bad)], schema, checked=True)
    assert files.jsonl(spark, str(good), schema, checked=True).count() == 50
    rows = spark.createDataFrame([("x0",), ("x1",), ("x2",)], "k string")
    assert {r.k: r.raw_output for r in files.replay(spark, rows, str(good), schema, "k").collect()} == {"x0": "v48", "x1": "v49", "x2": "v47"}
    assert files.jsonl(spark, str(tmp_path / "none"), schema, optional=True, order_column="_at").count() == 0


def test_documents_say_what_they_leave_out(spark):
    from lodestack.operators import documents

    df = spark.createDataFrame([(f"i{i}", "<b>" if i else None) for i in range(5)], "item string, text string")
    assert "3 more rows" in sinks.markdown(df, 2) and "more rows" not in sinks.markdown(df, 5)
    assert "4 more items" in documents.packet(df, "item", ["text"], ["a"], 1)
    page = documents.html_index(df, "item", ["text"], 2)
    assert "&lt;b&gt;" in page and "<b>" not in page and "3 more items" in page
    assert documents.annotation_schema(["a", "b"])["properties"]["label"]["enum"] == ["a", "b", None]
