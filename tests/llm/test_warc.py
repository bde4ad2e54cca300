import base64
import gzip
import hashlib
import random

import pytest

from tidemark.llm import warc
from tidemark.session import new_path

SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows, least=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(ids, default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = len(data) >= least and page_id != first
        out.append((page_id, len(data), digest, "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=str)


def pages():
    r = random.Random(3)
    rows = [(i, f"http://host/{i}", "".join(r.choices("aé中<p>\r\n\r\nWARC/1.1 \n", k=r.choice([0, 3, 50, 400, 3000])))) for i in range(60)]
    rows += [(100 + i, None, "same page " * 200) for i in range(40)] + [(200, "u\r\nX-Page-ID: 9", None), (201, "", ""), (None, "n", "null id"), (139, None, "same page " * 200)]
    return rows + [(300, "long", "x" * 2_000_000), (None, "m", "same page " * 200)]


@pytest.mark.parametrize(("least", "segment", "chunk", "file_records"), [(0, 700, 64, 7), (20, 1 << 14, 1 << 12, 4096)])
def test_round_trip(spark, least, segment, chunk, file_records):
    rows = pages()
    docs = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA).repartition(5)
    path = new_path(spark, "archives")
    warc.write_archives(docs, path, least=least, segment=segment, chunk=chunk, file_records=file_records)
    got = warc.read_archives(spark, path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    assert sorted((tuple(x) for x in got.select(*columns).collect()), key=str) == brute(rows, least)
    by_page = {x.page_id: bytes(x.payload) for x in got.filter("payload is not null").collect()}
    assert all(by_page[p] == (h or "").encode() for p, _, h in rows if p is not None and p in by_page) and len(by_page) > 60


def test_no_pages(spark):
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


def written(spark, records):
    """An archive of two gzip members and a plain file, records dealt out in the given order."""
    path = new_path(spark, "archives")
    third = len(records) // 3
    packed = lambda part: gzip.compress(b"".join(r + b"\r\n\r\n" for r in part))
    files = {"a.warc.gz": packed(records[:third]) + packed(records[third : 2 * third]), "b.warc": b"".join(r + b"\r\n\r\n" for r in records[2 * third :])}
    import os

    folder = path.removeprefix("file:")
    os.makedirs(folder)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(data)
    return path


def parts(page_id=1, text="é" * 3000):
    return list(warc.records(page_id, "u", text.encode(), page_id, False, 500, 100))


def one(spark, records):
    return warc.read_archives(spark, written(spark, records)).first()


def test_segments_in_any_order_and_repeated(spark):
    records = parts()
    random.Random(2).shuffle(records)
    row = one(spark, records + records[:3])
    assert row.valid and bytes(row.payload).decode() == "é" * 3000


@pytest.mark.parametrize("fault", ["missing", "last", "altered", "total"])
def test_broken_segments_are_marked(spark, fault):
    records = parts()
    if fault == "missing":
        del records[3]
    elif fault == "last":
        del records[-1]
    elif fault == "altered":
        records[2] = records[2][:-40] + b"#" * 40
    else:
        records[-1] = records[-1].replace(b"Total-Length: 6", b"Total-Length: 7")
    row = one(spark, records)
    assert not row.valid and (row.payload is None or fault == "altered")


def test_chunks():
    for size in (1, 7, 4096):
        assert warc.unchunked(warc.chunked(b"0\r\n\r\nabc" * 50, size)) == b"0\r\n\r\nabc" * 50
    assert warc.unchunked(b"3;note=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"4\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
