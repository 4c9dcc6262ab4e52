import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, slices
from lectern.plans.catalogue import QUERIES
from tests.conftest import SMALL


def test_rows_come_in_slices_and_keep_their_kinds(spark):
    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "n": len(rows), "t": rows["t"], "x": [[a, None] for a in rows["t"]]})

    made = spark.range(0, 3000, 1, 2).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"))
    got = slices.in_slices(made, run, "id long, n int, t string, x array<string>").collect()
    assert max(r.n for r in got) == slices.ROWS and len(got) == 3000
    assert all(r.t == (str(r.id) if r.id % 7 else None) and r.x == [r.t, None] for r in got)
    upper = made.select("id", slices.of_strings(lambda t: None if t is None else t + "!", F.col("t")).alias("t")).collect()
    assert all(r.t == (f"{r.id}!" if r.id % 7 else None) for r in upper) and len(upper) == 3000
    assert chunking.chunked(made.where("false"), text="t").collect() == []


@pytest.mark.parametrize("name", ["txt05_txt06_run_on_chunks", "txt08_retrieval_units", "txt09_document_chunks", "src28_src44_src45_archives"])
def test_texts_are_worked_on_in_slices(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" in plan
