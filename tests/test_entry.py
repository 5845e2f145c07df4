"""The driver contract: names, SQL for known queries only, and everything but the text queries without the llm subpackage."""

import sys

import duckdb

import __spark_entry__ as entry
from tidewright.functions.prng import draw, draw_sql

FOUND = {
    "p1_found": ["panel_id", "asset", "activity_day", "window_days"],
    "p2_found": ["panel_id", "tick_ms"],
    "p3_found": ["panel_id", "split", "period_end_ms", "next_start_ms"],
    "p5_found": ["table_name", "row_id"],
    "p6_found": ["panel_id", "open_time_ms", "measure"],
}
SMALL = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_text_queries(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidewright.llm", None)
    names = set(entry.queries())
    assert set(FOUND) <= names and not any(n.startswith(("p4", "p7", "p8", "p9")) for n in names) and set(entry.oracle_sql()) <= names


def test_columns_and_types_of_the_found_queries(spark):
    for name, columns in FOUND.items():
        df = entry.queries()[name](spark, SMALL)
        assert df.columns == columns
        assert all(t == ("int" if c == "window_days" else "string" if c in ("asset", "activity_day", "split", "table_name", "measure") else "bigint") for c, t in df.dtypes)


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


def test_portable_random_numbers(spark):
    from pyspark.sql import functions as F

    ours = [r.n for r in spark.range(50).orderBy("id").select(draw(42, F.col("id"), F.lit("x")).alias("n")).collect()]
    theirs = [r[0] for r in duckdb.connect().execute(f"select {draw_sql('42', 'i', chr(39) + 'x' + chr(39))} from range(50) t(i) order by i").fetchall()]
    assert ours == theirs and len(set(ours)) == 50 and all(0 <= n < 2**32 for n in ours)
