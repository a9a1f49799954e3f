import hashlib

from rankloom.llm import warc
from rankloom.llm.common import shared_folder


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, d in data:
        same = [j for j, x in data if x == d]
        first = max((j for j in same if j is not None), default=None)
        again = len(d) >= 1000 and first is not None and i != first
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def back(spark, rows, parts=3):
    path = shared_folder(spark, "archives")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    warc.write_archives(pages, path)
    return sorted((tuple(r) for r in warc.page_records(spark, path).collect()), key=str)


def test_magic_in_payloads_and_small_ranges(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    long = "é<p>" * 700
    rows = [(1, "http://a b\r\n", fake * 40), (2, None, None), (3, "u", ""), (4, "u", long), (5, "u", long), (6, "u", "WARC/1.1\r\n"), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 300), (8, "u", fake * 40), (None, "u", long), (10, "u", "short"), (11, "u", "short")]
    rows += [(100 + i, "u", f"page {i} " * (i + 1)) for i in range(60)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("700", "4096", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert back(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_empty_and_repeated(spark):
    assert back(spark, []) == []
    rows = [(1, "u", "a" * 2000), (1, "u", "a" * 2000), (0, "v", "a" * 2000)]
    assert back(spark, rows) == expected(rows)
