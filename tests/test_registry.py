import os

import pytest


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in entry.queries()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb
    import numpy as np
    import pandas as pd

    from marlstone.plans import queries as q

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(str([None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float, np.number)) else str(v) for v in r]) for r in frame.itertuples(index=False))

    for name in ("dedupe_latest_success", "main_table", "judge_metrics", "vote_curve", "stratified_sample", "normalize_step", "jaccard_pairs", "most_visited_path", "backup", "puct_select", "rate_limit_schedule"):
        assert rows(q.queries()[name](spark, SF).toPandas()) == rows(con.sql(q.oracle_sql()[name]).df()), name
