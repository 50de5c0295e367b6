import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from webloom.session import build_session

    session = build_session("local[4]", 4, **{
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from webloom.sources.views import Tables

    return Tables(spark, "/root/testdata/sf0.001")
