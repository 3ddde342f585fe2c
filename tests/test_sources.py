"""Archives read with Spark's binary reader: members, parts, faults."""

import io
import tarfile
import zipfile

import pytest

from glosswork.sources import archives as A


def tar_of(files, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        folder = tarfile.TarInfo("sub")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


FILES = {"a.tsv": "1\t2\n3\tÄ\r\n".encode(), "sub/b.tsv": b"x\n\ny", "empty.tsv": b"", "c.bin": b"\x00"}


@pytest.mark.parametrize("mode", ["w:", "w:bz2", "w:gz", "w:xz", "zip"])
def test_members(spark, tmp_path, mode):
    if mode == "zip":
        with zipfile.ZipFile(tmp_path / "x", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("sub/", b"")
            for name, data in FILES.items():
                z.writestr(name, data)
    else:
        (tmp_path / "x").write_bytes(tar_of(FILES, mode))
    got = A.members(spark, f"file://{tmp_path}", "*.tsv")
    assert {r["member"]: bytes(r["content"]) for r in got.collect()} == {k: v for k, v in FILES.items() if k.endswith(".tsv")}
    assert sorted((r["member"], r["line"], r["text"]) for r in A.lines(got).collect()) == [("a.tsv", 0, "1\t2"), ("a.tsv", 1, "3\tÄ"), ("sub/b.tsv", 0, "x"), ("sub/b.tsv", 1, ""), ("sub/b.tsv", 2, "y")]


def test_parts_end_at_line_feeds(spark, tmp_path):
    data = "".join(f"line {k}\n" for k in range(5000)).encode()
    (tmp_path / "x.tar.bz2").write_bytes(tar_of({"l": data}, "w:bz2"))
    got = A.members(spark, f"file://{tmp_path}", part_bytes=1000).orderBy("part").collect()
    assert len(got) > 20 and b"".join(bytes(r["content"]) for r in got) == data and all(bytes(r["content"]).endswith(b"\n") for r in got)


def test_faults_and_plain_packed_files(spark, tmp_path):
    import bz2

    whole = tar_of({"a": b"1\n", "b": bytes(range(256)) * 4000}, "w:")
    (tmp_path / "broken").write_bytes(whole[:3000])
    (tmp_path / "none").write_bytes(b"no archive")
    (tmp_path / "plain").write_bytes(bz2.compress(b"7\n8\n"))
    got = A.members(spark, f"file://{tmp_path}").collect()
    by = {}
    for r in got:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["member"], r["fault"] is not None))
    assert by["none"] == [(None, True)] and by["plain"] == [("", False)]
    assert by["broken"][0] == ("a", False) and by["broken"][-1] == (None, True)


def test_packed_tar_comes_back(spark):
    rows = spark.createDataFrame([("g", "m2", "b\nc"), ("g", "m1", "a"), ("h", "m1", None)], "g string, m string, t string")
    got = A.unpacked(A.packed_tar(rows, "g", "m", "t")).collect()
    assert sorted((r["path"], r["member"], bytes(r["content"])) for r in got) == [("g", "m1", b"a"), ("g", "m2", b"b\nc"), ("h", "m1", b"")]


def test_a_large_group_is_several_archives_of_its_path(spark):
    rows = [("a" if k < 40 else "b", f"m{k}.txt", f"{k}\n" + "x" * 1000) for k in range(42)]
    packed = A.packed_tar(spark.createDataFrame(rows, "g string, m string, t string"), "g", "m", "t", volume_bytes=8000)
    files = packed.groupBy("path").count().collect()
    got = sorted((r["path"], r["member"], bytes(r["content"]).decode()) for r in A.unpacked(packed).collect())
    assert {r["path"]: r["count"] > 3 for r in files} == {"a": True, "b": False} and got == sorted(rows)
