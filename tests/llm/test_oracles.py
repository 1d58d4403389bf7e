import duckdb
import pandas as pd
import pytest

from soilcast.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, tmp_path, name):
    from .helpers import awkward, docs, prose

    rows = [(100 + k, prose(k % 7, 20 + 3 * k) + ".\n" + ["Home | a | b | c |", "we use cookies.", "", "x y z!!!"][k % 4], ["p", "q", None][k % 3]) for k in range(60)]
    awkward(spark).unionByName(docs(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, pattern in (("/root/testdata/sf0.001", ""), (str(tmp_path), "/*.parquet")):
        got = queries.queries()[name](spark, folder).toPandas()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{pattern}')")
        expected = con.execute(oracle.oracle_sql()[name]).df()[list(got.columns)]
        by = list(got.columns)
        a, b = (x.sort_values(by).reset_index(drop=True) for x in (got, expected))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
