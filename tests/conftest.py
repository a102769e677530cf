import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from skyfence.session import drop_scratch, get_session

    session = get_session("skyfence-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


FRAME = (
    "event_id bigint, t_us bigint, sensor_id string, frame_type string, bssid string, vendor_oui string, ssid string, src_addr string, "
    "dst_addr string, channel int, frequency_mhz int, rssi_dbm bigint, security string, privacy boolean, wps boolean, pmf boolean, "
    "seq_num bigint, retry boolean, eapol_message bigint, wep_iv string, frame_len bigint, beacon_interval bigint"
)
NAMES = [part.strip().split(" ")[0] for part in FRAME.split(",")]


@pytest.fixture(scope="session")
def make(spark):
    """Frames from short dictionaries; ``t`` is in seconds."""

    def build(rows):
        out = []
        for i, r in enumerate(rows):
            r = {"event_id": i, "sensor_id": "s1", **r}
            if "t" in r:
                r["t_us"] = int(r.pop("t") * 1_000_000)
            out.append(tuple(r.get(n) for n in NAMES))
        return spark.createDataFrame(out, FRAME)

    return build
