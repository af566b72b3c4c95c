import pytest

from paperloom.functions.text import clean_lines
from paperloom.sources.tables import (
    load_documents,
    load_table,
    load_urls,
    missing_to_null,
    output_names,
    write_by_class,
    write_chunks,
    write_csv,
    write_json,
    write_keywords,
    write_vectors,
)
from paperloom.streaming import process_new_files


def test_csv_types_and_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,n,x,b,s,all\n1,5,1.5,True,"a, ""q""\nb",NA\n2,,nan,False,N/A,\n3,7,-2e3,True,none,null\n')
    df = load_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 5.0, 1.5, True, 'a, "q"\nb', None), (2, None, None, False, None, None), (3, 7.0, -2000.0, True, "none", None),
    ]


def test_csv_with_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n007,x\nNA,NaN\n")
    assert [tuple(r) for r in load_table(spark, str(path), "a string, b string").collect()] == [("007", "x"), (None, None)]


def test_json_formats_and_dispatch(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    (tmp_path / "t.jsonl").write_text('{"a": 3}\n{"a": 4}\n')
    assert sorted(r.a for r in load_table(spark, str(tmp_path / "t.json")).collect()) == [1, 2]
    assert sorted(r.a for r in load_table(spark, str(tmp_path / "t.jsonl")).collect()) == [3, 4]
    for name in ("t.xml", "t.CSV", "t"):
        with pytest.raises(ValueError):
            load_table(spark, str(tmp_path / name))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "NULL"), (1.0, "x")], "d double, s string")
    assert [tuple(r) for r in missing_to_null(df).collect()] == [(None, None), (1.0, "x")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.md").write_text("no")
    (row,) = load_documents(spark, str(tmp_path)).collect()
    assert (row.source, row.text) == ("a.txt", "one\n\ntwo") and row.path.endswith("/a.txt")
    with pytest.raises(FileNotFoundError):
        load_documents(spark, str(tmp_path), "*.none")


def test_seed_lines(spark, tmp_path):
    path = tmp_path / "seeds.csv"
    path.write_text("http://h/a, 2\nhttp://h/b,\nhttp://h/c,deep,rest\n")
    assert [tuple(r) for r in load_urls(spark, str(path)).collect()] == [("http://h/a", 2), ("http://h/b", None), ("http://h/c", None)]
    path.write_text("http://h/a\n")
    with pytest.raises(Exception, match="invalid line"):
        load_urls(spark, str(path)).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q "x", y', None), (2, "", 2.5)], "i long, s string, d double")
    write_json(df, str(tmp_path / "o.jsonl"))
    assert load_table(spark, str(tmp_path / "o.jsonl"), df.schema).where("i = 1").first().s == 'q "x", y'
    write_csv(df, str(tmp_path / "o.csv"))
    assert sorted(tuple(r) for r in load_table(spark, str(tmp_path / "o.csv")).collect()) == [(1, 'q "x", y', None), (2, None, 2.5)]


def test_stored_chunks_and_vectors_are_replaced(spark, tmp_path):
    for write, name in ((write_chunks, "c"), (write_vectors, "v")):
        path = str(tmp_path / name)
        write(spark.range(5), path)
        write(spark.range(2), path)
        assert spark.read.parquet(path).count() == 2


def test_keyword_outputs(spark, tmp_path):
    records = spark.createDataFrame([("d", ["a"], 1)], "source string, keywords array<string>, keyword_count int")
    reports = spark.createDataFrame([("d", "r")], "source string, report string")
    write_keywords(records, reports, str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k/records")).first().keywords == ["a"]
    assert spark.read.parquet(str(tmp_path / "k/reports")).first().report == "r"


def test_output_names(spark):
    df = spark.createDataFrame([("dir/a.b.pdf", "S1"), ("noext", "S2")], "source string, sheet string")
    names = lambda kind: [r.out_name for r in output_names(df, "source", kind, "sheet").collect()]
    assert names("text") == ["a.b_cleaned.txt", "noext_cleaned.txt"]
    assert names("pdf") == ["a.b_parsed.txt", "noext_parsed.txt"]
    assert names("excel") == ["a.b_S1.txt", "noext_S2.txt"]
    assert names("other") == ["a.b.txt", "noext.txt"]


def test_class_folders_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("u", "pdf"), ("v", "csv")], "url string, file_class string")
    write_by_class(df, str(tmp_path / "by"))
    read = spark.read.parquet(str(tmp_path / "by")).where("file_class = 'pdf'")
    assert [r.url for r in read.collect()] == ["u"]
    assert "PartitionFilters: [isnotnull(file_class" in read._jdf.queryExecution().executedPlan().toString()


def test_new_files_are_processed_once(spark, tmp_path):
    source, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))
    step = lambda df: df.select("id", clean_lines("text").alias("text"))
    for i in range(2):
        spark.createDataFrame([(i, f" a  {i}\n\n")], "id int, text string").write.mode("append").parquet(source)
        process_new_files(spark, source, "id int, text string", step, target, done)
    process_new_files(spark, source, "id int, text string", step, target, done)
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(0, "a 0"), (1, "a 1")]


def test_long_integers_keep_all_digits(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("a,b\n1234567890123456789,99999999999999999999\n1234567890123456790,1\n")
    df = load_table(spark, str(tmp_path / "ids.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double"}
    assert sorted(r.a for r in df.collect()) == [1234567890123456789, 1234567890123456790]
