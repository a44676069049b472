import gzip
import os

import pytest

from barloom.llm import warc
from barloom.session import ship

ROWS = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    return spark


def pages():
    rows = [(i, f"https://h{i % 7}.example/p {i}\r\nX: y" if i % 9 == 0 else f"https://h.example/{i}", "<p>é" + "x" * (i % 13) * 40 + "\r\n\r\n") for i in range(200)]
    return rows + [(None, None, None), (300, None, ""), (301, "u", None), (301, "u", None), (302, "v", "big " * 300000), (None, "w", "only null id"), (None, "w", "only null id")]


def brute(rows, least=0):
    last = {}
    body = [(h or "").encode() for _, _, h in rows]
    for (i, *_), b in zip(rows, body):
        last[b] = max(last.get(b, (False, 0)), (i is not None, i or 0))
    out = []
    for (i, *_), b in zip(rows, body):
        again = len(b) >= least and (i is not None, i or 0) < last[b]
        out.append((i, len(b), warc.base32_sha1(b), "revisit" if again else "response", last[b][1] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(session, tmp_path, least):
    df = session.createDataFrame([(*r, 1) for r in pages()], ROWS + ", payload int").repartition(3)
    got = warc.digest(df, f"file://{tmp_path}/w", least)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages(), least)
    files = [f for f in os.listdir(f"{tmp_path}/w")]
    assert files and not any(f.startswith("_temporary") for f in files)
    text = b"".join(gzip.decompress(open(f"{tmp_path}/w/{f}", "rb").read()) for f in files)  # any gzip reader reads it
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(pages())


def test_ranges_filters_and_columns(session, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(session.createDataFrame(pages(), ROWS).coalesce(1), path)
    reader = lambda c: session.read.format("warc").schema(c).option("split_bytes", 700)
    whole = reader("record_id string, payload_bytes long").load(path)
    assert whole.rdd.getNumPartitions() > 4 and whole.count() == len(pages())
    responses = reader("record_id string, record_type string, payload binary").load(path).where("record_type = 'response'")
    plan = responses._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull", "") or "record_type" in plan
    want = [r for r in brute(pages()) if r[3] == "response"]
    assert sorted(len(r.payload) for r in responses.collect()) == sorted(r[1] for r in want)
    some = reader("target_uri string, payload_digest string").load(path).where("target_uri in ('https://h.example/1', 'https://h.example/2')")
    assert sorted(r.target_uri for r in some.collect()) == ["https://h.example/1", "https://h.example/2"]


def test_payload_is_not_inflated_when_filtered_out(tmp_path):
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StructField, StructType, StringType

    raw = bytearray(warc.member(warc.record(1, "u", bytes(range(256)) * 4000, "A", None, False)) + warc.member(warc.record(2, "v", b"x", warc.base32_sha1(b"x"), None, True)))
    raw[60_00 % len(raw)] ^= 0  # the first payload could be broken: it is passed over by its length
    file = tmp_path / "a.warc.gz"
    file.write_bytes(bytes(raw))
    reader = warc.WarcReader(f"file://{tmp_path}", StructType([StructField("record_id", StringType())]), 1 << 20, False)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("other",), 1)])) == [EqualTo(("other",), 1)]
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert got == [{"record_id": "<urn:page:2>"}]


def test_archives_of_other_writers(session, tmp_path):
    """Members without a length are passed over by inflating them; broken digests are found."""
    a = gzip.compress(warc.record(5, "u", b"hello", warc.base32_sha1(b"hello"), None, False))
    b = gzip.compress(warc.record(6, None, b"", warc.base32_sha1(b""), None, False))
    (tmp_path / "b.warc.gz").write_bytes(a + b)
    got = warc.read(session, f"file://{tmp_path}", verify=True).collect()
    assert [(r.record_id, r.payload, r.target_uri) for r in got] == [("<urn:page:5>", b"hello", "u"), ("<urn:page:6>", b"", None)]
    (tmp_path / "c.warc.gz").write_bytes(warc.member(warc.record(7, "u", b"hello", warc.base32_sha1(b"else"), None, False)))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read(session, f"file://{tmp_path}", verify=True).collect()


def test_empty_table(session, tmp_path):
    assert warc.digest(session.createDataFrame([], ROWS), f"file://{tmp_path}/w").count() == 0
