"""Queries on values and times that the test tables lack, against their SQL."""

from __future__ import annotations

import datetime

import duckdb
from driftline.plans import registry


def said(spark, folder, name, rows):
    """What a query and its SQL return for events (event_id, second, user_id, value) in this order."""
    start = datetime.datetime(2024, 1, 1)
    events = [(k, start + datetime.timedelta(seconds=s), u, "click", float(v), "") for k, s, u, v in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    want = con.sql(registry.oracle_sql()[name])
    return sorted(map(tuple, df.select(*want.columns).collect())), sorted(want.fetchall())


def test_half_turns_are_unwrapped_as_the_sql_says(spark, tmp_path):
    """A step of 180 units is three and a half turns; last bits differ from value to value."""
    values = [x for v in range(60) for x in (v * 1.37, v * 1.37 + 180, v * 1.37)]
    ours, want = said(spark, tmp_path, "win3_phase_unwrap", [(k, k, 1, v) for k, v in enumerate(values)])
    assert ours == want


def test_guidance_takes_equal_times_by_id(spark, tmp_path):
    """Rows of one time are stored last id first; a fix that lies far ahead must not be taken before its turn."""
    rows = [(k, k // 4, 1, (k * 53) % 100) for k in range(40)]
    ours, _ = said(spark, tmp_path / "a", "sta18_guidance", rows[::-1])
    apart, _ = said(spark, tmp_path / "b", "sta18_guidance", [(k, k, 1, v) for k, _, _, v in rows])
    assert ours == apart
