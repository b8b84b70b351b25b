from __future__ import annotations

import os
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# Functions of test modules run in Python workers too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

SENTENCES = ["春天的雨下得很久。", "他问：“你去哪里？”", "费用是320元，周期为15天；", "「好的！」她笑了。", "没有人知道为什么……", "列车经过山口，然后停下。"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def random_text():
    """A seeded text of Chinese sentences, Latin runs and breaks, at least ``size`` characters long."""

    def make(seed: int, size: int = 2500) -> str:
        rng, out, held = random.Random(seed), [], 0
        while held < size:
            x = rng.random()
            if x < 0.15:
                part = "\n\n"
            elif x < 0.25:
                part = "\n"
            elif x < 0.32:
                part = "".join(rng.choice("abcxyz019 ") for _ in range(rng.randint(3, 30)))
            else:
                part = rng.choice(SENTENCES)
            out.append(part)
            held += len(part)
        return "".join(out)

    return make
