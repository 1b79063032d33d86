"""The driver's contract, and queries against their SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 7):
        assert f"p{n}_found" in entry.queries()


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns


def key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


CHECKED = ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "op_last", "op_mode", "op_slope", "sys_log_summary", "sys_late_revise", "sys_scores", "program_expert"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a = sorted(tuple(key(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = sorted(tuple(key(r[i]) for i in at) for r in want.fetchall())
    assert a == b
