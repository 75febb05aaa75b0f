"""The entry module imports without a session, and names what it has."""

from __future__ import annotations

import subprocess
import sys

import __spark_entry__ as entry


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'entry' in dir(e) and set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["endpoint_id", "day", "movement", "packets"] and rows.count() > 0
