"""The queries on seeded values see values that don't follow from seed and row alone."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.operators import reshape, select
from tallyloom.plans.catalog import scalars
from tallyloom.sources import generate, readers, writers

FOLDER = "/root/testdata/sf0.001"


def test_generated_rows(spark, listed):
    kinds = [*generate.SPANS, "real", "text", "decimal"]
    schema = [generate.Field(k.replace("/", "_").replace(" ", "_"), k) for k in kinds]
    rows = generate.generate_rows(spark, schema, 500, 3)
    spread = generate.synthetic_like(spark.range(0, 500, 1, 13), "id", schema, 3)
    assert listed(rows) == listed(spread) != listed(generate.generate_rows(spark, schema, 500, 4))
    for f in rows.schema:
        assert rows.select(f.name).distinct().count() > 450, f
    few = generate.generate_rows(spark, [generate.Field("d", "decimal", 4, 2), generate.Field("s", "string", 5)], 200)
    assert few.schema["d"].dataType.simpleString() == "decimal(4,2)" and few.filter("d < 0 or d >= 100 or length(s) > 5").count() == 0


def test_functions_that_no_query_runs(spark, listed, tmp_path):
    (tmp_path / "run.properties").write_text("a=1\nb=two words\n")
    assert readers.load_context(spark, str(tmp_path / "run.properties")) == {"a": "1", "b": "two words"}
    with pytest.raises(ValueError):
        readers.load_context(spark, str(tmp_path / "run.properties"), most=1)
    assert [tuple(r) for r in select.static_pick_list(spark, ["z", "a", "m"]).orderBy("pos").collect()] == [(0, "z"), (1, "a"), (2, "m")]
    text = spark.createDataFrame([("1", "x", "2024-01-01"), ("22", None, "soon"), (None, "y", None)], "a string, b string, c string")
    assert reshape.effective_types(text, {"a": "int", "b": "string", "c": "date"}) == {"a": "int", "b": "string", "c": "string"}
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("v"))
    for name in ("bucketed_left", "bucketed_right"):
        writers.write_bucketed(rows, name, "id", 4)
    joined = spark.table("bucketed_left").join(spark.table("bucketed_right").hint("merge"), "id")
    assert joined.count() == 200 and "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning" not in joined.select("id")._jdf.queryExecution().executedPlan().toString()


def test_random_functions_are_compared(spark, monkeypatch):
    good = scalars.random_functions(spark, FOLDER).first()
    assert good.repeatable and set(list(good)[:6]) == {good.rows}
    monkeypatch.setattr(numbers, "random_unit", lambda seed, *ids: F.rand())
    bad = scalars.random_functions(spark, FOLDER).first()
    assert bad.units < bad.rows // 10 and bad.rows == good.rows
