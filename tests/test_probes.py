"""Probes of bytes against plain Python on built files; readers that choose files by name and stream them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from skyshear.sources import probes, products, volumes


def binary(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content binary")


def test_strings(spark):
    rng = np.random.default_rng(3)
    files = {f"f{n}": bytes(rng.choice(np.frombuffer(b"\0\0\0 \t\nabZ9_-\x80\xff", np.uint8), rng.integers(0, 700))) for n in range(30)} | {"none": None, "empty": b""}

    def brute(data):
        pieces = [p.strip() for p in (data or b"")[:512].split(b"\0")]
        return {(n, p.decode("ascii", "replace")) for n, p in enumerate(pieces) if len(p) > 2 and any(chr(b).isalnum() for b in p if b < 128)}

    got = probes.strings(binary(spark, files)).collect()
    assert {(r.path, r.seq, r.text) for r in got} == {(p, *x) for p, d in files.items() for x in brute(d)} and len(got) > 100


def test_shapes(spark):
    sizes = [0, 1024, 1025, 1024 + 360 * 230, 2048 + 360 * 460 + 1999, 2048 + 360 * 460 + 2000, 128 + 720 * 1000 * 2, 10**9]
    got = probes.shapes(spark.createDataFrame([(str(n), n) for n in sizes], "path string, length long")).collect()
    want = {(str(n), a, g, h, b, h + a * g * b) for n in sizes if n > 1024 for a in (360, 720, 1440) for g in (230, 460, 920, 1000) for h, b in ((1024, 1), (2048, 1), (128, 2)) if abs(n - h - a * g * b) < 2000}
    assert {tuple(r) for r in got} == want and len(want) > 4


@pytest.mark.parametrize("counted, deciding", [(100_000, 50_000), (None, None), (700, 300)])
def test_byte_kinds(spark, counted, deciding):
    rng = np.random.default_rng(4)
    body = lambda pool, n: bytes(rng.choice(np.array(pool, np.uint8), n))
    files = {"dbz": body([0, 0, 5, 20, 75, 75], 9000), "vel": body([0] * 3 + [128, 129, 210], 5000), "text": b"plain text " * 400, "short": body([0, 9], 2000), "none": None, "long": body([0, 0, 77, 78, 2, 250], 120_000), "ties": b"\0\1\2\3" * 1000 + b"\0" * 2000}

    def brute(data):
        out = set()
        for header in (0, 128, 256, 512, 1024, 2048, 4096) if data and len(data) > 2000 else ():
            seen, head = data[header:][:counted], data[header:][:deciding]
            if not seen:
                continue
            count = Counter(seen)
            zeros, typical = 100 * count[0] / len(seen), 100 * sum(1 <= b <= 200 for b in head) / len(head)
            if zeros > 30 and typical > 20:
                top = [b for b, _ in sorted(count.items(), key=lambda x: -x[1])]
                kind = "reflectivity" if sum(5 <= b <= 75 for b in head) > 0.4 * len(head) else "velocity" if sum(abs(b - top[0]) < 30 for b in head) > 0.3 * len(head) else None
                out.add((header, zeros, typical, tuple(top[:8]), kind))
        return out

    got = probes.byte_kinds(binary(spark, files), counted, deciding).collect()
    assert {(r.path, r.header, r.zeros, r.typical, tuple(r.top), r.kind) for r in got} == {(p, *x) for p, d in files.items() for x in brute(d)}
    assert {r.path for r in got} >= {"dbz", "vel"} and {r.kind for r in got} >= {"reflectivity", "velocity"}


def test_index_records(spark, tmp_path):
    folder = tmp_path / "Z9317" / "PPI" / "026"
    folder.mkdir(parents=True)
    record = lambda n, code: b"Z9317\0\0VCP11D\0" + code + b"\0" + f"Z_{n:03d}_PPI_01_026_end".encode() + b"\0" * 30
    parts = [record(1, b"026"), b"Z9317" + b"\1" * 50, record(2, b"999"), b"Z9317"]
    (folder / "ProductIndex").write_bytes(b"head" + b"".join(parts))
    (folder / "Empty").write_bytes(b"")
    got = probes.index_records(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))).orderBy("record").collect()
    assert [(r.station, r.record, r.size) for r in got] == [("Z9317", n, len(p)) for n, p in enumerate(parts)]
    data = (folder / "ProductIndex").read_bytes()
    assert all(data[r.offset : r.offset + r.size] == p for r, p in zip(got, parts, strict=True))
    assert [(r.mode_at, r.code, r.code_at) for r in got] == [(7, "026", 14), (None, None, None), (7, "026", parts[2].index(b"026")), (None, None, None)]
    assert got[0].name_at == 0 and got[0].name.startswith("Z9317") and got[0].name.count("_") >= 3 and got[1].name is None and got[3].name is None


def sweep(path, value):
    np.savez(path, azimuth=np.arange(2.0), elevation=np.array([0.5]), v=np.full((2, 3), float(value)))


def test_sweeps_by_name_and_as_a_stream(spark, tmp_path):
    """Files whose names don't match aren't opened; a stream reads each file once and goes on where it stopped."""
    root = tmp_path / "in"
    root.mkdir()
    for n, name in enumerate(("Z9317_20260511070900Z_PPI_01_026", "Z9317_20260512070900Z_PPI_01_026", "Z9543_20260511070900Z_PPI_01_026", "Z9317_20260511070900Z_PPI_01_019")):
        sweep(root / f"{name}.npz", n)
    (root / "Z9543_20260511080000Z_PPI_01_026.npz").write_bytes(b"damaged")
    day = volumes.read_sweeps(spark, str(root), station="Z9317", time="20260511*", code="026")
    assert [f.rsplit("/", 1)[1] for f in day.inputFiles()] == ["Z9317_20260511070900Z_PPI_01_026.npz"] and {r.value for r in day.collect()} == {0.0}
    everything = volumes.read_sweeps(spark, str(root))
    assert everything.count() == 25 and everything.filter("corrupt IS NOT NULL").count() == 1

    def run():
        q = volumes.read_sweeps(spark, str(root), stream=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return len(q.recentProgress), sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str)

    batches, rows = run()
    assert batches >= 3 and rows == sorted(everything.collect(), key=str)
    sweep(root / "Z9317_20260513070900Z_PPI_01_026.npz", 7)
    assert run()[1] == sorted(volumes.read_sweeps(spark, str(root)).collect(), key=str)


def test_bad_tile_says_why(spark, tmp_path):
    (tmp_path / "N35E118.hgt").write_bytes(b"\0\1" * 4)
    (tmp_path / "N36E118.hgt").write_bytes(b"\0\1\0")
    rows = products.read_dem(spark, str(tmp_path), 2).collect()
    assert sorted((r.tile, r.row is None, r.corrupt) for r in rows) == sorted([("N35E118", False, None)] * 4 + [("N36E118", True, "3 bytes, not 8")], key=str)
