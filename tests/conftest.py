import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillroll.session import local_session  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    catalog = str(tmp_path_factory.mktemp("catalog"))
    session = local_session(8, app="tests", **{"spark.sql.warehouse.dir": catalog})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALLEST).exists():
        pytest.skip("test tables not present")
    return SMALLEST


@pytest.fixture
def column(spark):
    """Evaluate a column expression over literal values of one column ``c``."""
    def run(build, values, kind="string"):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
        return [r.out for r in rows.select("i", build(F.col("c")).alias("out")).orderBy("i").collect()]

    return run
