import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rainloom import schemas  # noqa: E402
from rainloom.session import build_session  # noqa: E402

N_BINS = 176


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_swath(spark):
    """Swath factory: defaults of a small synthetic orbit, overridden per pixel.

    ``pixels``: {(scan, ray): {column: value}}; ``bins`` in a pixel is {bin: dBZ}.
    """

    def build(n_scan=8, n_ray=49, pixels=None, mission="GPM", orbit=12345, per_scan=None, every=None):
        start = dt.datetime(2020, 6, 1)
        rows = []
        for scan in range(n_scan):
            for ray in range(n_ray):
                row = {
                    "mission": mission,
                    "orbit": orbit,
                    "scan": scan,
                    "ray": ray,
                    "lat": 10 + scan * 4.4 / 111.195,
                    "lon": 100 + ray * 4.4 / 111.195,
                    "time": start + dt.timedelta(seconds=scan),
                    "pixel_area": 20.0,
                    "near_sfc_rain": 1.0,
                    "rain_type": 0,
                    "surface_type": 0,
                    "bin_mirror_image": -9999,
                }
                row.update(every or {})
                row.update((per_scan or {}).get(scan, {}))
                mine = dict((pixels or {}).get((scan, ray), {}))
                dbz = mine.pop("bins", {})
                rate = mine.pop("rates", {})
                row.update(mine)
                row["dbz_bins"] = [dbz.get(b) for b in range(N_BINS)]
                row["rate_bins"] = [rate.get(b) for b in range(N_BINS)]
                row["height_bins"] = [(N_BINS - 1 - b) * 125.0 for b in range(N_BINS)]
                rows.append(tuple(row.get(f.name) for f in schemas.SWATH.fields))
        return spark.createDataFrame(rows, schemas.SWATH)

    return build


@pytest.fixture(scope="session")
def data_dir():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("driver tables not present")
    return str(path)
