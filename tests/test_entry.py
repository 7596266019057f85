"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__


def test_entry_has_rows(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["ip", "ip2", "port", "direction", "payloadprotocol", "l7", "value", "value2"]
    assert frame.count() > 0


def test_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['netlens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__spark_entry__.HERE, timeout=60)
    n, any_op = out.stdout.split()
    assert int(n) > 150 and any_op == "False", out.stderr


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
