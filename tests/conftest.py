import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from folioframe.session import SETTINGS
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        # Keep small shuffles in several partitions, so that borders between them are tested.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_values(spark, rows):
    """Long values from ``(key, attr, kind, payload)``; positions follow the order given."""
    from folioframe import model as m
    from pyspark.sql import functions as F

    seen = {}
    flat = []
    for key, attr, kind, payload in rows:
        pos = seen[key, attr] = seen.get((key, attr), -1) + 1
        person = payload if kind == "person" else None
        date = payload if kind == "date" else None
        txo = payload if kind == "txo" else None
        text = payload if kind in ("text", "url", "id") else None
        flat.append((key, attr, pos, kind, text, person, date, txo))
    ddl = f"key bigint, attr string, pos int, type string, text string, person {m.PERSON}, date {m.DATE}, txo {m.TXO}"
    return spark.createDataFrame(flat, ddl).withColumn("quals", F.array().cast(f"array<{m.QUAL}>"))


def keys(df):
    return sorted(r.key for r in df.collect())


def items(spark, rows):
    """Taxonomy items from ``(grp, id, parent, name)``."""
    data = [(g, i, p, {"C": n}) for g, i, p, n in rows]
    return spark.createDataFrame(data, "grp string, id int, parent int, names map<string,string>")
