"""The (bssid, ssid) table kept in buckets of access points, with small manifests that name each bucket's newest version.

``data/v=N/bucket=K`` holds bucket K as batch N left it, ``manifest/N.json`` says which version of every bucket is current after
batch N. A batch rewrites the buckets it touches and then puts its manifest in place by one rename, so readers see all of a
batch or nothing of it. A batch that is tried again before its manifest stood writes the same folders anew; afterwards it does nothing.
The last two manifests and the folders they name stay; older ones go.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfence.sources.sinks import upsert_networks

BUCKETS = 64
#: Manifests that stay.
VERSIONS = 2


class Files:
    """The few file system calls needed, through Spark's own connectors, so any address that Spark writes to works."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file under another name, then rename it: it is there whole or not at all."""
        draft = f"{name}.draft"
        stream = self.fs.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self._path(draft), self._path(name)):
            raise RuntimeError(f"could not put {name} in place")

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _numbers(files: Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names("manifest") if n.endswith(".json"))


def _manifest(files: Files, number: int) -> dict:
    return json.loads(files.read(f"manifest/{number}.json"))


def _folders(files: Files, manifest: dict, only: set[int] | None = None) -> list[str]:
    return [f"{files.root}/data/v={v}/bucket={b}" for b, v in sorted(manifest["current"].items()) if only is None or int(b) in only]


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("bssid"), F.lit(buckets)).cast("int").alias("bucket")


def merge_batch(batch: DataFrame, number: int, path: str, buckets: int = BUCKETS) -> list[int]:
    """Merge sightings into the table as batch ``number``; the buckets rewritten. A batch already committed changes nothing."""
    spark = batch.sparkSession
    files = Files(spark, path)
    numbers = _numbers(files)
    if number in numbers or numbers and numbers[-1] > number:
        return []
    before = _manifest(files, numbers[-1]) if numbers else {"buckets": buckets, "current": {}}
    buckets = before["buckets"]
    touched = sorted(r["bucket"] for r in batch.select(bucket_of(buckets)).distinct().collect())  # at most ``buckets`` numbers
    if touched:
        fresh = upsert_networks(None, batch)
        old = _folders(files, before, set(touched))
        current = spark.read.schema(fresh.schema).parquet(*old) if old else None
        merged = upsert_networks(current, batch).withColumn("bucket", bucket_of(buckets)).repartition(len(touched), "bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{files.root}/data/v={number}")
    files.put(f"manifest/{number}.json", json.dumps({"buckets": buckets, "current": {**before["current"], **{str(b): number for b in touched}}}))
    _retire(files)
    return touched


def _retire(files: Files) -> None:
    """Drop manifests before the last ``VERSIONS`` and the folders that only they name."""
    numbers = _numbers(files)
    kept = {(b, v) for n in numbers[-VERSIONS:] for b, v in _manifest(files, n)["current"].items()}
    for n in numbers[:-VERSIONS]:
        for b, v in _manifest(files, n)["current"].items():
            if (b, v) not in kept:
                files.drop(f"data/v={v}/bucket={b}")
        if not any(name.startswith("bucket=") for name in files.names(f"data/v={n}")):
            files.drop(f"data/v={n}")
        files.drop(f"manifest/{n}.json")


def read_networks(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The table after the newest batch, or ``back`` batches earlier (as far as versions are kept)."""
    files = Files(spark, path)
    numbers = _numbers(files)
    if back >= min(VERSIONS, len(numbers)):
        raise ValueError(f"{path} keeps {min(VERSIONS, len(numbers))} versions")
    return spark.read.schema(NETWORKS_DDL).parquet(*_folders(files, _manifest(files, numbers[-1 - back])))


NETWORKS_DDL = (
    "bssid string, ssid string, first_seen bigint, channel int, encryption string, vendor string, last_seen bigint, rssi bigint, "
    "risk_score bigint, wps int, handshake_captured int, beacon_count bigint"
)
