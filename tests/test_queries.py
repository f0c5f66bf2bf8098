import subprocess
import sys
from pathlib import Path

import pytest
from common import same_rows

from strandloom import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, small, name):
    assert same_rows(queries.queries()[name](spark, small), duck.execute(SQL[name]))


def test_every_query_has_sql():
    assert set(SQL) == set(queries.queries())


def test_entry_works_without_the_text_operators():
    code = "import sys; sys.modules['strandloom.llm'] = None; import __spark_entry__ as e; assert 'dup_blocks' in e.queries() and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
