import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for p in (os.path.dirname(HERE), HERE):
    if p not in sys.path:
        sys.path.insert(0, p)

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import local_session

    session = local_session(cores=8, memory="6g", partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    # On these tiny tables compiling code takes longer than running it; queries run compiled in the bench and on the larger tables.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    yield session


@pytest.fixture
def shipped(spark):
    """The session with generated code and adaptive plans, as it is outside of tests."""
    changed = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="session")
def duck():
    import oracle

    return oracle.connect(SMALL)
