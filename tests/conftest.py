import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arrears.session import session  # noqa: E402
from arrears.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session("local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def tree(spark):
    """Build a source tree from {path: text}."""
    def build(files, repo="r"):
        return spark.createDataFrame([(repo, p, t) for p, t in files.items()], schemas.SOURCE_FILES)
    return build


@pytest.fixture(scope="session")
def commits(spark):
    """Build history rows from (seq, author, path[, added, date])."""
    import datetime

    def build(rows, repo="r"):
        out = []
        for seq, author, path, *rest in rows:
            added = rest[0] if rest else 1
            day = rest[1] if len(rest) > 1 else datetime.datetime(2025, 1, 1) + datetime.timedelta(seq)
            out.append((repo, seq, f"c{seq}", author, day, path, None, added))
        return spark.createDataFrame(out, schemas.COMMIT_FILES)
    return build
