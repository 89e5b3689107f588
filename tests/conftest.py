import pytest

from inkstone.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[4]", "inkstone-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
