import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanmill.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores=4, shuffle_partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    for key in ("spark.sql.codegen.wholeStage", "spark.sql.adaptive.enabled"):  # small tables: plan and compile less
        s.conf.set(key, "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield s


DATA = "/root/testdata/sf0.001"
