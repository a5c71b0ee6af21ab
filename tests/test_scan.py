"""Files read in ranges against the csv reader over the whole file, at every cut."""

import csv
import io

import pytest

from gridloom.sources import scan

TEXTS = [
    b'a,b\n1,"x\ny"\n"q ""z"" ,\n\n",2\n3,5" pipe\n"un"closed,4\n\n5,"a,b"\n',
    b'\xef\xbb\xbfh,"k\r\nk"\r\n1,2\r\n"\r\n",3\r\n,\r\n4,5',
    b'caf\xe9,b\n"\xe9\n\xe9",2\nx,y\n',
    "é,ü\n1,\"é\n\n\n\n\n\n\nü\"\n2,3\n".encode(),
    b"one\rtwo,2\rthree\n\"a\rb\",4\r\n",
    b"only a header\n",
]


def reference(data):
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return [[c or None for c in row] for row in csv.reader(io.StringIO(text, newline=""))]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 16, 1 << 20])
def test_ranges_of_any_size(spark, tmp_path, size):
    paths = []
    for i, data in enumerate(TEXTS):
        (tmp_path / f"{i}.csv").write_bytes(data)
        paths.append(str(tmp_path / f"{i}.csv"))
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = scan.stitched(scan.scanned(spark, paths)).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for i, data in enumerate(TEXTS):
        got = sorted((r.record, r.cells) for r in rows if r.file_id.endswith(f"/{i}.csv"))
        assert [c for _, c in got] == reference(data), (i, size)
        assert [n for n, _ in got] == list(range(len(got)))


def test_states():
    for text, fresh, quoted in ((b'a"b\n', False, False), (b'"a\n', True, False), (b'a,"b\n', True, False), (b'"a""\n', True, False), (b'x\n', False, True), (b'"",",\n', True, False)):
        assert (scan.open_after(text, False), scan.open_after(text, True)) == (fresh, quoted), text
