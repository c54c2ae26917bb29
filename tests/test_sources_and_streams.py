"""Readers on written files, and streams against the batch form."""

import json
import zipfile

from pyspark.sql import functions as F

from quern.operators import dialogue
from quern.sources import documents
from quern.streaming import context


def workbook(path, sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        shared = []
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for n, cells in enumerate(rows, 1):
                body += f'<row r="{n}">'
                for c, value in enumerate(cells):
                    if value is not None:
                        shared.append(value)
                        body += f'<c r="{chr(65 + c)}{n}" t="s"><v>{len(shared) - 1}</v></c>'
                body += "</row>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    workbook(tmp_path / "deep" / "a.xlsx", {"Thẻ": [["Danh mục"], ["STT", "Câu hỏi", "Trả lời"], [None, "I. Khoá thẻ", None], ["1", "Khoá thế nào?", "Bấm Khoá."], ["2", "Không đáp", None]], "Khác": [["x", "y"]]})
    workbook(tmp_path / "~tmp.xlsx", {"A": [["Question", "Answer"], ["q", "a"]]})
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    rows = documents.from_workbooks(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["source"], r["sheet_name"], r["row_id"], r["section"], r["question"], r["error"] is None) for r in rows] == [("a.xlsx", "Thẻ", 4, "I. Khoá thẻ", "Khoá thế nào?", True), ("bad.xlsx", None, None, None, None, False)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps([{"page_content": "a", "metadata": {"source": "s"}}, {"page_content": "", "metadata": {}}, {"page_content": "b"}]))
    (tmp_path / "bad.json").write_text("{not json")
    rows = documents.from_json(spark, str(tmp_path)).orderBy("page_content").collect()
    assert [(r["page_content"], r["metadata"]) for r in rows] == [("a", {"source": "s"}), ("b", None)]


def test_built_documents(spark):
    df = spark.createDataFrame([(1, "q ", "a", "x/y.xlsx", 3, "z"), (2, None, "a", "y", 4, "z"), (3, "q", "NaN", "y", 5, "z"), (4, "q", "  ", "y", None, "z")], "id long, question string, answer string, source string, row_id long, page_content string")
    assert [tuple(r) for r in documents.built(df, "id").collect()] == [(1, "Question: q\n\nAnswer: a\nKeywords: q", "y.xlsx", 5)]


def test_stream_context_equals_batch(spark, tmp_path):
    data = [(c, n, t, f, s) for c in range(3) for n, (t, f, s) in enumerate([("thẻ", 1, None), (None, None, 2), ("tiền", 3, None), (None, 4, 5)])]
    schema = "conv_id long, turn_no int, topic string, faq_id long, step int"
    turns = spark.createDataFrame(data + data[:2], schema)
    folder = str(tmp_path / "turns")
    turns.where("turn_no < 2").coalesce(1).write.mode("append").parquet(folder)
    turns.where("turn_no >= 2").coalesce(1).write.mode("append").parquet(folder)
    stream = context.running_context(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName("contexts").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("contexts").groupBy("conv_id").agg(F.max_by(F.struct("topic", "faq_id", "step", "turns"), "turns").alias("x")).select("conv_id", "x.*")
    batch = dialogue.folded_context(turns.distinct(), "conv_id")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect())) == [(c, "tiền", 4, 5, 4) for c in range(3)]


def test_stream_windows_and_redeliveries(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "a"), (1, "2024-01-01 00:00:01", "a"), (2, "2024-01-01 00:00:59", "a"), (3, "2024-01-01 00:05:00", "b")]
    df = spark.createDataFrame(rows, "id long, at string, kind string").withColumn("at", F.to_timestamp("at"))
    folder = str(tmp_path / "events")
    df.coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(df.schema).parquet(folder)
    for name, stream, expected in (
        ("firsts", context.first_deliveries(source, "at", "10 minutes", ["id"]).select("id"), [(1,), (2,), (3,)]),
        ("counts", context.windowed_counts(source, "at", "10 minutes", "1 minute", ["kind"]).select("kind", "n"), [("a", 3), ("b", 1)]),
        ("sessions", context.activity_sessions(source, "at", "10 minutes", "2 minutes", "kind").select("kind", "n"), [("a", 3), ("b", 1)]),
    ):
        mode = "append" if name == "firsts" else "complete"
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == expected


def test_sql_arguments_are_bound_and_tables_cleared(spark):
    from quern.sources import tables

    df = spark.createDataFrame([(1, "a'; DROP TABLE x"), (2, "b")], "id long, t string")
    assert [r["id"] for r in tables.run(spark, "SELECT id FROM {df} WHERE t = :t", {"df": df}, t="a'; DROP TABLE x").collect()] == [1]
    assert tables.cleared(df).count() == 0 and tables.cleared(df).columns == df.columns


def test_json_arrays_round_trip(spark, tmp_path):
    from quern.sources import tables

    df = spark.createDataFrame([(f"x\n{i} \"ệ\"", {"k": str(i)}) for i in range(20)], "page_content string, metadata map<string,string>").repartition(3)
    tables.write_json_arrays(df, str(tmp_path / "arrays"))
    tables.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    assert sorted((r["page_content"], r["metadata"]["k"]) for r in documents.from_json(spark, str(tmp_path / "arrays")).collect()) == sorted((r["page_content"], r["metadata"]["k"]) for r in df.collect())
    assert documents.from_json(spark, str(tmp_path / "none")).count() == 0


def test_staged_tables_are_removed_with_their_scope(spark):
    import os

    from quern.session import staged, staging

    with staging(spark):
        table = staged(spark.range(3), "numbers")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
