import subprocess
import sys

import __spark_entry__ as entry


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mean_perpendicularity" in df.columns


def test_entry_without_what_the_text_operators_need():
    """A module that they import is hidden: the other queries are still there."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 70 and out[1:] == ["False", "False"]
