"""Pages are walked in pieces of bounded size."""

import pyarrow as pa

from paperloom.operators import pages as P


def test_pieces_hold_every_row_once_and_stay_small(monkeypatch):
    monkeypatch.setattr(P, "PIECE_BYTES", 100)
    texts = ["x" * 30, None, "y" * 500, "", "z" * 60, "w" * 60, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["_html", "id"])
    pieces = list(P._in_pieces(batch, 0))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts
    assert [i for p in pieces for i in p.column(1).to_pylist()] == list(range(7))
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 100 for p in pieces)


def test_a_task_walks_one_piece_at_a_time(spark):
    page = "<html><title>t</title><body>" + "<div>" * 20 + "word " * 2_000 + "</div>" * 20 + "</body></html>"
    df = spark.range(120, numPartitions=1).selectExpr("if(id = 7, null, id) as id").crossJoin(spark.createDataFrame([(page,)], "html string"))
    parsed = P.parse_pages(df.coalesce(1), keep=["id"])
    # elements of one Arrow batch of 10,000 rows were built at once
    rows = parsed.selectExpr("id", "title", "size(elements) as n").collect()
    assert len(rows) == 120 and {(r.title, r.n) for r in rows} == {("t", 23)} and sum(r.id is None for r in rows) == 1
    assert len(list(P._in_pieces(pa.RecordBatch.from_arrays([pa.array([page] * 120)], names=["_html"]), 0))) > 3
