"""Point files of all forms, some of them broken, through the data source."""
import io
import zipfile

import numpy as np
import pytest

from scangrid.sources import scans, sweeps

FORMS = ("bin", "ply", "big.ply", "text.pcd", "pcd", "lzf.pcd")


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("rows", [1, 77])
def test_forms_round_trip(form, rows):
    values = np.random.default_rng(3).uniform(-90, 90, (rows, 4)).astype("f4")
    got = scans.decode_any(f"a.{form}", sweeps.encode_sweep(values, form))
    assert np.array_equal(np.stack([got[c] for c in ("x", "y", "z", "intensity")], 1), values.astype("f8"))


def test_vertices_after_other_elements():
    xyz = np.array([[1, 2, 3], [4, 5, 6]], ">f4")
    head = ("ply\nformat {} 1.0\ncomment c\nelement face 2\nproperty list uchar int vertex_indices\nproperty uchar flag\n"
            "element vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    faces = b"".join(bytes([n]) + np.arange(n, dtype=">i4").tobytes() + b"\x07" for n in (3, 4))
    got = scans.decode_ply(head.format("binary_big_endian").encode() + faces + xyz.tobytes())
    assert got["y"].tolist() == [2, 5] and got["intensity"].tolist() == [0, 0]
    text = head.format("ascii") + "3 0 1 2 7\n4 0 1 2 3 7\n1 2 3\n4 5 6\n"
    assert scans.decode_ply(text.encode())["z"].tolist() == [3, 6]


def test_compressed_data_with_references():
    # "abcabcabcabc!" : three literals, a reference of nine that overlaps itself, one literal.
    assert scans.lzf_decompress(b"\x02abc" + bytes([7 << 5, 0, 2]) + b"\x00!", 13) == b"abcabcabcabc!"
    assert scans.lzf_decompress(b"\x01ab" + bytes([1 << 5, 1]), 5) == b"ababa"
    for bad, size in ((b"\x00a", 2), (bytes([1 << 5, 9]), 3), (b"\x02abc" + bytes([7 << 5]), 13)):
        with pytest.raises((ValueError, IndexError)):
            scans.lzf_decompress(bad, size)


def test_broken_files_become_findings(spark, tmp_path):
    base = tmp_path / "sequences" / "03"
    base.mkdir(parents=True)
    good = np.arange(40, dtype="<f4").reshape(10, 4)
    for name, content in {
            "000001.bin": good.tobytes(), "000002.bin": good.tobytes()[:-3], "000003.bin": b"",
            "000004.ply": b"ply\nformat strange 1.0\nend_header\n", "000005.ply": b"garbage",
            "000006.pcd": sweeps.encode_sweep(good, "pcd")[:-30], "000007.pcd": b"VERSION",
            "000008.ply": sweeps.encode_sweep(good, "ply"), "000009.zip": b"PK no archive", "notes.txt": b"x"}.items():
        (base / name).write_bytes(content)
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in (10, 9, 1):
            z.writestr(f"scan{i}.bin", good[:i].tobytes())
        z.writestr("odd.bin", b"123")
        z.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "escape.zip", "w") as z:
        z.writestr("../out.bin", good.tobytes())
    rows = sweeps.read_sweeps(spark, str(tmp_path)).collect()
    points = [r for r in rows if r.finding is None]
    plain = {r.frame_id for r in points if r.member is None}
    assert plain == {1, 8} and sum(r.member is None for r in points) == 20
    members = {(r.member, r.frame_id): sum(q.member == r.member for q in points) for r in points if r.member}
    assert members == {("scan1.bin", 1): 1, ("scan9.bin", 2): 9, ("scan10.bin", 3): 10}
    bad = {r.path.rsplit("/", 1)[-1]: (r.member, r.finding) for r in rows if r.finding}
    assert set(bad) == {"000002.bin", "000003.bin", "000004.ply", "000005.ply", "000006.pcd", "000007.pcd",
                        "000009.zip", "escape.zip", "many.zip"}
    assert bad["many.zip"][0] == "odd.bin" and bad["escape.zip"] == (None, "unsafe member path")
    assert "multiple" in bad["000002.bin"][1] and bad["000003.bin"][1] == "no points"


def test_partitions_follow_bytes_and_members_are_read_once(tmp_path, monkeypatch):
    good = np.zeros((1000, 4), "<f4").tobytes()
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(6):
            z.writestr(f"{i}.bin", good)
    reader = sweeps.SweepReader({"path": str(tmp_path), "bytesPerPartition": str(2 * len(good))})
    portions = reader.partitions()
    assert [len(p.items) for p in portions] == [2, 2, 2]
    read = []
    plain = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name: (read.append(name), plain(self, name))[1])
    assert sum(b.num_rows for p in portions for b in reader.read(p)) == 6000
    assert sorted(read) == [f"{i}.bin" for i in range(6)]


def test_nothing_to_read(spark, tmp_path):
    assert sweeps.read_sweeps(spark, str(tmp_path)).collect() == []
    (tmp_path / "b.zip").write_bytes(io.BytesIO(b"").getvalue())
    assert [r.finding[:15] for r in sweeps.read_sweeps(spark, str(tmp_path)).collect()] == ["broken archive:"]


def test_archive_rules_as_a_query(spark, tmp_path):
    from scangrid.operators import checks
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.bin", b"x" * 16)
        z.writestr("../2.bin", b"y")
    members = scans.archive_members(scans.binary_files(spark, str(tmp_path), "*.zip"))
    assert {(r.member, r.expanded_bytes, r.is_link) for r in members.collect()} == {
        ("1.bin", 16, False), ("../2.bin", 1, False)}
    assert [r.finding for r in checks.archive_findings(members).collect()] == ["unsafe member path"]
