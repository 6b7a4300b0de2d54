"""R6 equals the standard library's reading of a header block."""

import io
import random
from http.client import HTTPResponse

from pyspark.sql import functions as F

from linkloom.operators.fetchlog import status_and_headers

FIXED = [
    "HTTP/1.0 200 OK\r\nA: 1\r\n", "HTTP/2 200\r\nA: 1\r\n", "HTTP/1.1 200 OK\r\nA: one\r\n two\r\nB: 3\r\n",
    "HTTP/1.1 200 OK\r\nX: 1\r\nx: 2\r\n", "HTTP/1.1 200 OK\r\nA: 1\r\nno colon\r\nB: 2\r\n",
    "HTTP/1.1 100 Continue\r\nA: 0\r\n\r\nHTTP/1.1 204 No\r\nA: 1\r\n", "HTTP/1.1 100 Continue\r\n", "",
    "HTTP/1.1 0404 Gone\r\n", "HTTP/1.1 99 x\r\n", "HTTP/1.1 1000 x\r\n", "HTTP/0.9 200\n", "ICY 200 OK\r\n",
    "HTTP/1.1 200 OK\r\n folded first\r\nA: 1\r\n", "HTTP/1.1 200 OK\r\n: none\r\n gone\r\nA: 1\r\n",
    "HTTP/1.1 200 OK\r\nA: 1\r\n\r\nB: 2\r\n", "HTTP/1.1 200 OK\r\n" + "".join(f"H{i}: {i}\r\n" for i in range(98)),
    "HTTP/1.1 200 OK\r\n" + "".join(f"H{i}: {i}\r\n" for i in range(101)), "HTTP/1.1 200 OK\r\nA: 1\rB: 2\r\n",
]


def stdlib(text):
    class Socket:
        def makefile(self, *_):
            return io.BytesIO(text.encode("latin-1"))
    r = HTTPResponse(Socket())
    try:
        r.begin()
    except Exception:
        return False, None, None
    return True, r.status, dict(r.headers)


def test_header_blocks_as_the_standard_library_reads_them(spark):
    rnd = random.Random(4)
    pieces = ["HTTP/1.1 200 OK\r\n", "HTTP/1.1 100 Continue\r\n", "A: 1\r\n", "a:  2 \r\n", "B b: 3\r\n", "\r\n", "\n",
              " more\r\n", "\tmore\n", "From x\r\n", ":\r\n", "C:\r\n", "nothing\r\n", "HTTP/1.x 301\r\n"]
    texts = FIXED + ["".join(["HTTP/1.1 200 OK\r\n"] * (rnd.random() < 0.8) + rnd.choices(pieces, k=rnd.randint(0, 7)))
                     for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, header string")
    rows = df.select("i", status_and_headers(F.col("header")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.s.headers_valid, r.s.http_code, r.s.headers) == stdlib(texts[r.i]), texts[r.i]
