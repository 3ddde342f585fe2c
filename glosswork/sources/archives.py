"""Archives as sources: the members of tar (also bz2, gz, xz) and zip files, and the lines of their texts.

Files are read with Spark's binary reader, so they may lie in any store that
Spark reads; archives are spread over tasks by their sizes and each is read as
a stream, member by member, so a task holds one archive's packed bytes and one
part of a member. Parts of a member end at a line feed, so lines stay whole, and
have a number, so their order is kept.

Defined results: folders and links have no rows; an empty member has one empty
part; a file that is no archive, or is broken off, gives a row with `fault` after
the members that were read whole.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "path string, member string, part int, content binary, fault string"
#: Bytes of a part, and packed bytes that one task is to read.
PART_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Bytes of text in one archive that is packed here.
VOLUME_BYTES = 16 << 20
_PACKED = ((b"BZh", bz2.open), (b"\x1f\x8b", gzip.open), (b"\xfd7zXZ", lzma.open))


def _opened(content: bytes) -> Iterator[tuple[str, IO[bytes]]]:
    """(name, stream) of each file in an archive; a packed file that is no tar is one member without a name."""
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.open(info)
        return
    unpack = next((f for magic, f in _PACKED if content.startswith(magic)), None)
    raw = unpack(io.BytesIO(content)) if unpack else io.BytesIO(content)
    try:
        tar = tarfile.open(fileobj=raw, mode="r:")
    except tarfile.ReadError:
        if not unpack:
            raise
        yield "", unpack(io.BytesIO(content))
        return
    for info in tar:
        if info.isfile():
            yield info.name, tar.extractfile(info)


def _cut(stream: IO[bytes], size: int) -> Iterator[bytes]:
    """A stream in parts that end at a line feed, of about so many bytes."""
    rest = stream.read(size)
    while block := stream.read(size):
        end = rest.rfind(b"\n") + 1
        if end:
            yield rest[:end]
        rest = rest[end:] + block
    yield rest


def unpacked(files: DataFrame, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, member, part, content, fault) of the members, of files (path, content), whose names fit the pattern."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for name, stream in _opened(content or b""):
                if fnmatch(name, pattern):
                    for k, data in enumerate(_cut(stream, part_bytes)):
                        yield path, name, k, data, None
        except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, lzma.LZMAError) as e:
            yield path, None, None, None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("part", pa.int32()), ("content", pa.binary()), ("fault", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows(path.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, row, strict=True))], kinds)

    return files.select("path", "content").mapInArrow(run, PARTS)


def members(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """The members of all archives under a path (a file, a folder or a glob), see unpacked."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    return unpacked(files.repartition(max(1, -(-size // TASK_BYTES)), "path"), pattern, part_bytes)


def lines(parts: DataFrame) -> DataFrame:
    """(path, member, part, line, text): the lines of members as UTF-8, without the line feeds; line counts from 0 within a part."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r?\n\\z", "")
    cut = parts.filter("fault IS NULL AND length(content) > 0").select("path", "member", "part", F.posexplode(F.split(text, "\r?\n")).alias("line", "text"))
    return cut


def packed_tar(rows: DataFrame, group: str, member: str, text: str, packing: str = "bz2", volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """(path, content): a tar of each group with a file for each row, in the order of their names.

    A group of more than `volume_bytes` of text is several archives of its path,
    of about that size, each a task; a member is in one of them, by its name.
    """

    def run(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=f"w:{packing}") as tar:
            for row in sorted(table.to_pylist(), key=lambda r: r["_m"]):
                data = (row["_t"] or "").encode()
                info = tarfile.TarInfo(row["_m"])
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pa.table({"path": [table.column("_g")[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    x = rows.select(F.col(group).cast("string").alias("_g"), F.col(member).alias("_m"), F.col(text).alias("_t"))
    volumes = x.groupBy(F.col("_g").alias("_h")).agg(F.ceil(F.sum(F.coalesce(F.octet_length("_t"), F.lit(0)).cast("long") + 1) / volume_bytes).alias("_n"))
    x = x.join(F.broadcast(volumes), F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_v", F.pmod(F.xxhash64("_m"), F.col("_n")))  # a name and a number an archive
    return x.groupBy("_g", "_v").applyInArrow(run, "path string, content binary")
