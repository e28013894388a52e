import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from arborlake.runtime import build_session  # noqa: E402
from arborlake.schema import CATALOG_SCHEMA  # noqa: E402

AS_OF = datetime(2024, 3, 15, 10, 30)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


def record(frs, parent, name, size=0, is_dir=False, drive="C", alloc=None, modified=None, flags=None,
           links=1):
    return (drive, frs, parent, name, is_dir, size, alloc if alloc is not None else -(-size // 4096) * 4096,
            modified, modified, modified, links, flags if flags is not None else (16 if is_dir else 32))


def frame(spark, records):
    return spark.createDataFrame(records, CATALOG_SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """root(5) -> folder_a(11){file_x, sub_folder(14){file_y}}, folder_b(12){file_z}."""
    return frame(spark, [
        record(5, 5, ".", is_dir=True),
        record(11, 5, "folder_a", is_dir=True),
        record(12, 5, "folder_b", is_dir=True),
        record(13, 11, "file_x.txt", 100, modified=datetime(2024, 3, 15, 1)),
        record(14, 11, "sub_folder", is_dir=True),
        record(15, 14, "file_y.PDF", 5000, modified=datetime(2024, 3, 1)),
        record(16, 12, "file_z", 70_000, modified=datetime(2023, 1, 1), flags=34),
        record(17, 12, "file_x.txt", 100, modified=datetime(2020, 1, 1)),
    ]).cache()


def walk(records):
    """Paths of records by following parents one by one."""
    by_key = {(r[0], r[1]): r for r in records}

    def path(r):
        parts, current, seen = [], r, set()
        while current[1] not in (0, 5):
            if current[1] in seen:
                return None
            seen.add(current[1])
            parts.append(current[3])
            if current[2] in (0, 5):
                break
            above = by_key.get((current[0], current[2]))
            if above is None:
                return f"<unknown:{current[2]}>\\" + "\\".join(reversed(parts))
            current = above
        return f"{r[0]}:\\" + "\\".join(reversed(parts))

    return {(r[0], r[1]): path(r) for r in records}
