"""Archives round trip, look-alikes inside payloads, and chains against a plain walk."""

import hashlib
import os
import random
import tempfile

import duckdb
import numpy as np
import pytest

from skyfence.llm import warc
from skyfence.session import shared_dir

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BIG = "é日" * 700


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        again = len(data) >= 1000 and bool(same) and (page_id is None or page_id < max(same))
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


def there_and_back(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts).selectExpr("*", "'x' as digest", "1 as bytes", "2 as off", "3 as kept")
    path = shared_dir(spark, "test-warc")
    warc.write_archives(df, path)
    return path, sorted(map(tuple, warc.page_records(warc.read_archives(spark, path), df.schema["page_id"].dataType).collect()), key=str)


ROWS = [(1, "http://a/", BIG), (2, None, BIG), (7, "http://b/\r\nWARC-Type: x", BIG), (7, "http://c/", BIG), (None, "u", BIG), (3, "u", None), (4, "u", ""), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (8, "u", "WARC/1.1\r\n"),
        (9, "u", "a" + FAKE + FAKE + "b"), (10, "u", FAKE * 40 + "WARC/1.1\r\n" * 300), (11, "u", FAKE * 40 + "WARC/1.1\r\n" * 300), (12, "u", "\r\n\r\n" * 600), (13, "u", "HTTP/1.1 200 OK\r\n\r\nx"), (14, "u", "z" * 3_000_000), (None, None, None)]


@pytest.mark.parametrize("parts", [1, 3])
def test_pages(spark, parts):
    assert there_and_back(spark, ROWS, parts)[1] == expected(ROWS)


def test_small_byte_ranges(spark):
    rows = [(i, f"http://h/{i}", random.Random(i).choice([FAKE * 3, "text " * 50, "WARC/1.1\r\n" + "y" * 400, BIG])) for i in range(120)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("997b", "4001b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            path, got = there_and_back(spark, rows)
            assert warc._scan(spark, path).select("block").distinct().count() > 20
            assert got == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_payloads(spark):
    path, _ = there_and_back(spark, ROWS, 2)
    got = {(r["page"], bytes(r["payload"])) for r in warc.read_archives(spark, path, payloads=True).where("record_type = 'response'").collect()}
    want = {(None if i is None else str(i), (h or "").encode()) for i, _, h in ROWS if (h != BIG or i == 7) and i != 10}
    assert got == want


def test_broken_archives(spark):
    """What follows a cut record stays unread; other files are read whole."""
    folder = tempfile.mkdtemp()
    good = FAKE.replace("<urn:x>", "<urn:a>")
    with open(os.path.join(folder, "a.warc"), "wb") as f:
        f.write((good + FAKE.replace("Content-Length: 5", "Content-Length: 6") + good).encode())
    with open(os.path.join(folder, "b.warc"), "wb") as f:
        f.write((good * 3 + good[:-9]).encode())
    with open(os.path.join(folder, "c.warc"), "wb") as f:
        f.write(("junk" + good).encode())
    rows = warc.read_archives(spark, folder).collect()
    names = [os.path.basename(r["file"]) for r in rows]
    assert names.count("b.warc") == 3 and names.count("c.warc") == 0 and sum(n == "a.warc" and r["off"] == 0 for n, r in zip(names, rows)) == 1
    assert {r["bytes"] for r in rows if r["off"] == 0} == {5}


def test_nothing(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = shared_dir(spark, "test-warc")
    warc.write_archives(df, path)
    assert warc.read_archives(spark, path).count() == 0


def test_sql(spark):
    rows = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", rows.astype({"page_id": "Int64"}))
    got = sorted(con.execute(warc.RECORDS_SQL.format(pages="pages")).fetchall(), key=str)
    assert got == expected(ROWS)


def test_chains_against_walk():
    r = random.Random(3)
    for _ in range(200):
        off = np.array(sorted(r.sample(range(60), 25)))
        succ = np.array([r.choice([o + r.randint(1, 12), *off[off > o][:3]]) for o in off])
        to = warc.following(off, succ)
        for i in range(len(off)):
            assert to[i] == (list(off).index(succ[i]) if succ[i] in off else i)
