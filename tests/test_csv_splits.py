"""CSV files with quoted line breaks, read by many tasks, against one task."""

import csv
import io
import random

import pytest

from paperloom.sources.csv_splits import csv_records, read_csv_splits, still_quoted
from paperloom.sources.tables import load_table


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def made(rng, n):
    pieces = ["a", "é", '"', ",", "\n", "\r\n", " ", "xyz", '""', ',"', '",']
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) + "."
    return [(str(i), text(), "k" + text() if rng.random() < 0.9 else "\n" * 900 + "long", rng.choice(["", "1.5"])) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    (tmp_path / "t").mkdir()
    rows = [made(rng, 700), made(rng, 40), []]
    for i, part in enumerate(rows):
        written(tmp_path / "t" / f"{i}.csv", [("id", "te xt", "b,c", "d"), *part], end)
    path = str(tmp_path / "t")
    df = read_csv_splits(spark, path)
    assert csv_records(spark, path).rdd.getNumPartitions() > 20
    assert df.columns == ["id", "te xt", "b,c", "d"]
    got = sorted(tuple(r) for r in df.collect())
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    # one task writes the line breaks inside quotes as the file ends its lines; here they stay as they are
    plain = lambda rows: sorted(tuple(x and x.replace("\r\n", "\n") for x in r) for r in rows)
    assert plain(got) == plain(one.collect())
    assert got == sorted((i, t, k, d or None) for part in rows for i, t, k, d in part)


def test_inches_blank_lines_and_ragged_rows(spark, tmp_path, small_splits):
    lines = ["a,b", '5" pipe,x', "", '"q ""in"" q",y', "only", "1,2,3", 'z,6" "tail"']
    (tmp_path / "t.csv").write_text("\n".join(lines * 60))
    df = read_csv_splits(spark, str(tmp_path / "t.csv"))
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "t.csv"))
    assert sorted(map(str, df.collect())) == sorted(map(str, one.collect()))
    typed = load_table(spark, str(tmp_path / "t.csv"), "a string, b int")
    assert typed.where("b = 2").count() == 60 and typed.dtypes == [("a", "string"), ("b", "int")]


def test_no_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read_csv_splits(spark, str(tmp_path / "h.csv")).columns == ["a", "b"]
    assert load_table(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert load_table(spark, str(tmp_path / "e.csv")).count() == 0


def test_quotes_by_line():
    rng = random.Random(5)
    for row in made(rng, 3000):
        held = io.StringIO()
        csv.writer(held, lineterminator="").writerow(row)
        quoted = False
        lines = held.getvalue().split("\n")
        for i, line in enumerate(lines):
            quoted = still_quoted(line, quoted)
            # a record is whole exactly when its last line ends outside quotes
            assert quoted == (i < len(lines) - 1)
