import pytest

from spindlewatch.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "spindlewatch-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false",
           "spark.python.sql.dataFrameDebugging.enabled": "false",
           "spark.sql.execution.arrow.pyspark.enabled": "true",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    from spindlewatch.sources.feed import read_feed

    return read_feed(spark, DATA)


@pytest.fixture(scope="session")
def curated(spark, raw):
    from spindlewatch.functions.features import derive_features
    from spindlewatch.session import stage

    return stage(derive_features(raw), "curated")


@pytest.fixture(scope="session")
def events(curated):
    from spindlewatch.operators.detect import detect_combined
    from spindlewatch.session import stage

    return stage(detect_combined(curated), "events")
