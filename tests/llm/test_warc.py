import gzip
import hashlib
import io
from collections import defaultdict

import pyarrow as pa
import pytest

from strataline.llm import warc
from strataline.llm.queries import op7_warc

PAGES = [(i, f"http://h{i % 3}.org/{i}" if i % 5 else None, f"x{i % 4}" * 600 if i % 7 else ("s" if i % 2 else None)) for i in range(40)]
PAGES += [(100, "http://a/\r\nX: y", "é\r\n\r\n" * 500), (101, "", ""), (39, "http://again/", "x3" * 600), (None, "http://null/", "x1" * 600)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def archive(spark, folder, tmp_path_factory):
    warc.register(spark)
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    warc.page_records(spark.read.parquet(f"{folder}/pages.parquet")).repartition(2).write.format("warc").option("file_bytes", "2000").mode("append").save(path)
    return path


def test_round_trip(spark, folder):
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        target = max(known) if known else None
        revisit = len(raw) >= 1000 and i is not None and len(groups[h or ""]) > 1 and i != target
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    got = [tuple(r) for r in op7_warc(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_standard_readers_can_read_it(archive):
    names = [x.path for x in pa.fs.LocalFileSystem().get_file_info(pa.fs.FileSelector(archive[7:]))]
    assert len(names) > 2 and all(n.endswith(".warc.gz") for n in names)
    text = b"".join(gzip.open(n).read() for n in names)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES)


def test_filters_are_pushed_and_payloads_left_out(spark, archive):
    df = spark.read.format("warc").option("payload", "false").load(archive).where("record_type = 'revisit' and target_uri like 'http://h1%'")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo" not in plan and "StartsWith(target_uri" not in plan.split("Physical")[1]
    rows = df.collect()
    assert rows and all(r["payload"] is None and r["target_uri"].startswith("http://h1") and r["payload_bytes"] >= 1000 for r in rows)


@pytest.mark.parametrize("packed", [False, True])
def test_plain_and_foreign_files(tmp_path, archive, packed):
    names = [x.path for x in pa.fs.LocalFileSystem().get_file_info(pa.fs.FileSelector(archive[7:]))]
    raw = gzip.open(sorted(names)[0]).read()
    if packed:  # members without skip lengths, one per record
        out = io.BytesIO()
        for part in raw.split(b"WARC/1.1\r\n")[1:]:
            out.write(gzip.compress(b"WARC/1.1\r\n" + part))
        data = out.getvalue()
    else:
        data = raw
    source = pa.BufferReader(data)
    mine = list(warc.records(source, len(data), [], True))
    first = pa.OSFile(sorted(names)[0], "rb")
    assert mine == list(warc.records(first, first.size(), [], True)) and mine
    wanted = mine[-1][0]["record_id"]
    few = list(warc.records(pa.BufferReader(data), len(data), [("record_id", "in", (wanted,))], False))
    assert [f[0]["record_id"] for f in few] == [wanted]


def test_nothing(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/none"
    warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


def test_a_broken_file_is_an_error():
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(b"not a header"), 12, [], True))
