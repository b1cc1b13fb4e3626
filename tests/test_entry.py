"""The driver's entry in a process that has no session yet."""

import os
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert q and set(s) <= set(q)
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""


def test_entry_needs_no_session_to_be_read():
    subprocess.run([sys.executable, "-c", CODE], cwd=HOME, check=True, timeout=120)


def test_entry_goes_on_without_a_library_of_the_optional_part():
    hide = "import sys; sys.modules['public_tokenizers'] = None\n"
    subprocess.run([sys.executable, "-W", "ignore", "-c", hide + CODE + "assert 'hs' in q and 'pipeline' not in q"], cwd=HOME, check=True, timeout=120)
