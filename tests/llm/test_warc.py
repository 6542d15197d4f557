import gzip
import hashlib
import random

from graphloom.llm import warc
from graphloom.scratch import new_path

DDL = "page_id long, url string, html string, digest string"


def expected(rows):
    pay = [(p, (h or "").encode()) for p, _, h, _ in rows]
    first = {}
    for p, b in pay:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, b in pay:
        ref = first.get(b)
        shared = ref is not None and ref != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if shared else "response", ref if shared else None))
    return sorted(out, key=str)


ROWS = [(k, f"http://x/{k}", ("é" * 60 + str(k % 4)) * (1 + k % 3), "d") for k in range(40)]
ROWS += [(100 + k, None, "short", None) for k in range(3)] + [(200, "http://a b\n", None, ""), (201, "u", "", ""), (None, "u", "z" * 150, ""), (None, "u", ROWS[0][2], ""), (7, "again", ROWS[7][2], "")]


def test_round_trip(spark):
    got = warc.round_trip(spark.createDataFrame(ROWS, DDL).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)
    assert warc.round_trip(spark.createDataFrame([], DDL)).count() == 0


def test_splits_own_each_record_once(spark, tmp_path):
    rng = random.Random(5)
    noise = [(k, "u", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(rng.randrange(1, 4000))), "") for k in range(60)]
    files = warc.write(spark.createDataFrame(noise, DDL).repartition(2), new_path(spark, "t"))
    for split in (37, 1000, 5000, 1 << 24):
        ids = sorted(r.page_id for r in warc.read(spark, files, split_bytes=split, payloads=False).collect()) if split > 900 else []
        assert ids == list(range(60)) * (split > 900)
    path, size = files[0]
    whole = [r.headers["warc-record-id"] for r in warc.records(path, 0, size)]
    pieces = [r.headers["warc-record-id"] for a in range(0, size, 37) for r in warc.records(path, a, min(size, a + 37))]
    assert pieces == whole
    fs, name = warc.opened(path)
    data = fs.open_input_file(name).read()
    assert gzip.decompress(data).count(b"WARC/1.1") == len(whole)
    broken = tmp_path / "broken.warc.gz"
    broken.write_bytes(b"junk\x1f\x8b\x08junk" + data[:-7])
    assert [r.headers["warc-record-id"] for r in warc.records(str(broken), 0, broken.stat().st_size)] == whole[:-1]


def test_a_file_is_fetched_once(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, "u", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(1500)), "") for k in range(1200)]
    files = warc.write(spark.createDataFrame(rows, DDL).repartition(1), new_path(spark, "t"))
    (path, size), = files
    assert size > 3 << 20
    fetched = []
    ahead = warc.Cursor.ahead

    def counted(self, n):
        before = len(self.held) - self.off
        fetched.append(ahead(self, n) - before)
        return fetched[-1] + before

    monkeypatch.setattr(warc.Cursor, "ahead", counted)
    assert sum(1 for _ in warc.records(path, 0, size)) == 1200 and sum(fetched) == size
    fetched.clear()
    half = size // 2
    assert sum(1 for a, b in ((0, half), (half, size)) for _ in warc.records(path, a, b)) == 1200 and sum(fetched) < 1.5 * size


def test_a_very_long_page(spark):
    html = "<p>" + "long page " * 800_000
    docs = spark.createDataFrame([(2, "u", html, ""), (1, "v", html, "")], DDL)
    got = {r.page_id: r for r in warc.round_trip(docs).collect()}
    assert got[1].record_type == "response" and got[2].refers_to == 1 and got[2].payload_bytes == len(html)


def test_payloads_come_back(spark):
    files = warc.write(spark.createDataFrame(ROWS[:5], DDL), new_path(spark, "t"), file_bytes=200)
    assert len(files) >= 3
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, files).where("record_type = 'response'").collect()}
    assert got == {p: h for p, _, h, _ in ROWS[:5]}
