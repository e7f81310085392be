import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from ledgerlark.session import build_session

    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Lets every key with more than 20 rows count as hot, so slicing is exercised on small frames."""
    spark.conf.set("spark.ledgerlark.hotRows", "20")
    spark.conf.set("spark.ledgerlark.slices", "7")
    yield
    spark.conf.unset("spark.ledgerlark.hotRows")
    spark.conf.unset("spark.ledgerlark.slices")
