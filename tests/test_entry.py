"""The driver's contract: names, columns, and the guard around the optional part."""

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_imports_without_the_optional_part():
    code = "import sys\nsys.modules['skarn.llm'] = None\nimport __spark_entry__ as e\nassert 'knn_cosine' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-W", "error", "-c", code], check=True, timeout=120)


def test_says_what_the_optional_part_lacks():
    code = "import sys, warnings\nsys.modules['zstandard'] = None\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always')\n    import __spark_entry__ as e\nassert 'knn_cosine' in e.queries()\nimport importlib.util\nassert importlib.util.find_spec('skarn.llm') is None or any('zstandard' in str(x.message) for x in w)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
