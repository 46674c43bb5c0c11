"""The WAV data source: headers alone, patterns on the listing, a round trip, and failed jobs."""

import numpy as np
import pytest

from gatelight.sources import records, wav

SCHEMA = "path string, rate int, samples array<float>"
HEADERS = "path string, rate int, channels int, n long"


@pytest.fixture()
def source(spark):
    spark.dataSource.register(wav.WavSource)
    return spark


def put(folder, n=12):
    rng, want = np.random.default_rng(1), {}
    for i in range(n):
        x = np.round(rng.uniform(-0.9, 0.9, 50 * i), 3)
        path = folder / f"d{i % 2}" / f"u{i:02}.wav"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(records.encode_wav(x, 8000 if i % 3 else 16000))
        want[str(path)] = (8000 if i % 3 else 16000, 1, len(x), x)
    return want


@pytest.mark.parametrize("part_bytes", [1, 3000, 1 << 26])
def test_rows_of_files(source, tmp_path, part_bytes):
    want = put(tmp_path)
    (tmp_path / "note.txt").write_text("no sound")
    df = source.read.format("wav").option("part_bytes", part_bytes).load(str(tmp_path))
    got = {r.path: r for r in df.collect()}
    assert got.keys() == want.keys()
    for path, (rate, channels, n, x) in want.items():
        r = got[path]
        assert (r.rate, r.channels, r.n) == (rate, channels, n) and np.allclose(r.samples, x, atol=1e-4)
    assert df.rdd.getNumPartitions() == {1: 12, 3000: df.rdd.getNumPartitions(), 1 << 26: 1}[part_bytes]


def test_a_listing_decodes_no_samples(source, tmp_path):
    """Files whose samples can't be read still have headers."""
    want = put(tmp_path)
    for path in want:
        with open(path, "r+b") as f:
            f.truncate(44)
    got = source.read.format("wav").schema(HEADERS).load(str(tmp_path)).collect()
    assert {r.path: (r.rate, r.channels) for r in got} == {p: v[:2] for p, v in want.items()}
    assert {r.n for r in got} == {0}  # what is there, not what the header says
    paths = source.read.format("wav").schema("path string").load(str(tmp_path))
    assert {r.path for r in paths.collect()} == set(want)


def test_patterns_open_no_other_file(source, tmp_path):
    want = put(tmp_path)
    kept = sorted(want)[3:5]
    for path in want:
        if path not in kept:
            open(path, "wb").write(b"broken")
    read = lambda files: sorted(r.path for r in source.read.format("wav").option("files", files).load(str(tmp_path)).collect())
    assert read("*" + kept[0][-10:]) == kept[:1]
    assert read(",".join(kept)) == kept and read("*none*") == []
    with pytest.raises(Exception, match="not a WAV file"):
        read("*")


def test_round_trip(source, tmp_path):
    rows = [(f"a/s{i}.wav", 16000 if i % 2 else None, [round(0.01 * k * (-1) ** k, 4) for k in range(i * 5)]) for i in range(9)]
    out = str(tmp_path / "out")
    df = source.createDataFrame(rows, SCHEMA).repartition(3)
    for _ in range(2):  # the second replaces the first
        df.write.format("wav").mode("overwrite").save(out)
    got = {r.path.removeprefix(out + "/"): r for r in source.read.format("wav").load(out).collect()}
    assert got.keys() == {r[0] for r in rows}
    for path, _, x in rows:
        assert got[path].rate == 16000 and np.allclose(got[path].samples, x, atol=1e-4)
    meta = {r.path: (int(r.rate), int(r.n)) for r in source.read.option("header", True).csv(out + "/meta.csv").collect()}
    assert meta == {p: (16000, len(x)) for p, _, x in rows}
    source.createDataFrame([("b/new.wav", 8000, [0.5])], SCHEMA).write.format("wav").mode("append").save(out)
    assert source.read.format("wav").schema(HEADERS).load(out).count() == 10


def test_failed_jobs_leave_nothing(source, tmp_path):
    out = tmp_path / "out"
    bad = source.createDataFrame([("a.wav", 8000, [0.1]), ("../b.wav", 8000, [0.2])], SCHEMA).repartition(2)
    with pytest.raises(Exception, match="no name for a WAV file"):
        bad.write.format("wav").mode("append").save(str(out))
    with pytest.raises(Exception, match="two rows for one file"):
        source.createDataFrame([("a.wav", 8000, [0.1]), ("a.wav", 8000, [0.2])], SCHEMA).write.format("wav").mode("append").save(str(out))
    assert not out.exists() or not list(out.rglob("*.wav"))


def test_no_files(source, tmp_path):
    assert source.read.format("wav").load(str(tmp_path / "none")).count() == 0
