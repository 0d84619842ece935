"""Binary files: times in names, pruning by periods, decoding, refused files."""

from __future__ import annotations

import struct

from echolith.sources import binary


def _decode(content, name):
    if len(content) % 8:
        raise ValueError("broken file")
    for (v,) in struct.iter_unpack("<d", content):
        yield {"value": v, "n": len(name)}


def _files(folder):
    folder.mkdir()
    for hour, minute in ((21, 50), (21, 55), (22, 0), (22, 5), (23, 0)):
        (folder / f"det_20240101_{hour:02d}{minute:02d}00.pgdf").write_bytes(struct.pack("<3d", hour, minute, 7))
    (folder / "other.txt").write_bytes(b"no")
    (folder / "untimed.pgdf").write_bytes(struct.pack("<d", 5))


def test_files_are_pruned_and_decoded(spark, tmp_path):
    _files(tmp_path / "d")
    files = binary.list_files(spark, str(tmp_path / "d"))
    assert files.count() == 6 and files.filter("start IS NULL").count() == 1
    day = 1_704_067_200
    p = spark.createDataFrame([(day + 78_960, day + 79_260), (day + 78_961, day + 79_000)], "start long, end long")  # 21:56 to 22:01
    kept = {r.path.rsplit("/", 1)[-1] for r in binary.in_periods(files, p).collect()}
    assert kept == {"det_20240101_215500.pgdf", "det_20240101_220000.pgdf", "untimed.pgdf"}
    rows = binary.read(spark, str(tmp_path / "d"), _decode, "value double, n int", periods=p, batch=2).collect()
    assert len(rows) == 7 and all(r.error is None for r in rows)
    assert len(binary.read(spark, str(tmp_path / "d"), _decode, "value double, n int").collect()) == 16


def test_refused_file(spark, tmp_path):
    _files(tmp_path / "d")
    (tmp_path / "d" / "bad_20240102_000000.pgdf").write_bytes(b"12345")
    bad = binary.read(spark, str(tmp_path / "d"), _decode, "value double, n int").filter("error IS NOT NULL").collect()
    assert [(r.file, r.value, r.error) for r in bad] == [("bad_20240102_000000.pgdf", None, "broken file")]
