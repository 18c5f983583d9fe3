"""Folds over many small tables that share batches."""

from conftest import rows

from docgrid.operators import tables


def test_tables_share_batches(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 3)
    cells = spark.range(400).selectExpr("if(id div 40 = 3, null, id div 40) as doc", "id div 4 % 10 as part", "int(id div 2 % 2) as y", "int(id % 2) as x", "1 as rowspan", "1 as colspan", "id div 2 % 2 = 0 as head", "string(id) as text")
    found = tables.appended_below(cells, ["doc"], "part")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = [(d if d != 3 else None, 0, 0 if h == 0 else p + 1, x, str(d * 40 + p * 4 + h * 2 + x)) for d in range(10) for p in range(10) for h in (0, 1) for x in (0, 1) if h or p == 0]
    assert rows(found.select("doc", "table", "y", "x", "text")) == sorted(wanted, key=repr)
