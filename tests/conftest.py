import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from compare import session
    yield session()


@pytest.fixture(scope="session")
def rows(spark):
    """Evaluate a column expression over literal rows."""
    def run(values, schema, *columns):
        return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]
    return run
