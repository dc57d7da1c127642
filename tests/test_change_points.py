"""Change points whose variance ends on a 5 where it is rounded."""

import datetime

import duckdb

from driftloom import queries

# First rows of series: their exact variances end on a 5 in the fifth digit.
ENDS = {
    73: [3.84, 60.39, 197.08, 117.16, 64.41, 45.32, 3.63, 26.57, 158.52],
    70: [14.01, 212.6, 9.46, 156.02, 24.59, 16.4, 52.29, 16.52, 152.83],
    78: [5.63, 9.24, 112.43, 9.38, 46.4, 37.93, 10.29, 45.92, 206.38],
    65: [3.82, 161.98, 21.18, 40.47, 51.51, 11.17, 93.11, 1.61, 117.14],
}


def test_variances_between_two_digits_round_as_in_sql(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(n, start + datetime.timedelta(hours=i), z) for n, first in ENDS.items() for i, z in enumerate([*first, *(60.0 + i % 3 for i in range(n - len(first)))])]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")
    df.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute(queries.SQL["wn06_change_points"]).fetchall()
    got = [tuple(r) for r in queries.change_points(spark, str(tmp_path)).collect()]
    assert len(expected) >= len(ENDS) and sorted(got) == sorted(expected)
