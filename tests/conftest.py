import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from fluxfold.session import local_session, ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(os.environ.get("TEST_CPUS", "8"), partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark, tmp_path_factory):
    """A series table whose target 1 holds more than a third of all rows, and its events."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for target, n in [(1, 400)] + [(t, 40) for t in range(2, 17)]:
        time = np.sort(rng.uniform(0, 30, n))
        time[n // 2 :] += 2.0
        frames.append(
            pd.DataFrame(
                {
                    "target_id": target,
                    "quarter": (time // 16).astype("int32") + 1,
                    "time": time,
                    "flux": rng.normal(100, 5, n) + 10 * np.sin(time / 2),
                    "centroid_x": rng.normal(3, 0.1, n),
                    "centroid_y": rng.normal(4, 0.1, n),
                }
            )
        )
    obs = pd.concat(frames, ignore_index=True)
    obs.insert(2, "seq", np.arange(len(obs)))
    obs["centroid_shift"] = np.hypot(obs.centroid_x, obs.centroid_y)
    events = pd.DataFrame(
        [
            (t, k, 2.0 + 0.3 * (t % 5) + k, 0.2 + 0.1 * k, 0.3, 0.9, f"E{t}-{k}" if k == 1 else None)
            for t in range(1, 17)
            for k in (1, 2)
        ],
        columns=["target_id", "tce_id", "period", "epoch", "duration", "secondary_phase", "name"],
    )
    folder = str(tmp_path_factory.mktemp("skewed"))
    spark.createDataFrame(obs).write.mode("overwrite").parquet(f"{folder}/obs")
    spark.createDataFrame(events).write.mode("overwrite").parquet(f"{folder}/events")
    return spark.read.parquet(f"{folder}/obs"), spark.read.parquet(f"{folder}/events"), obs, events
