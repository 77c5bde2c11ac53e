"""Members of tar and zip files as rows, read by byte ranges: a data source whose partitions are runs of members.

A tar's headers and a zip's directory say where each member's bytes are, so planning reads those alone and tasks
read only their own members; a large archive is many tasks and a small one does not hold its rows in one. Compressed
tars have no such places: one is read as a stream, in one task, member by member.

    spark.dataSource.register(MemberSource)
    spark.read.format("members").option("pattern", "*.json*").load("/data/*.tar")

Defined results: of an archive that is cut off, the members that are whole; of a member that does not unpack,
a row with null content; gzipped members are unpacked; directories and links are no members; a file that is no
archive, or a pattern without files, gives no rows. Paths may be of any file system that pyarrow knows by URI.
"""

from __future__ import annotations

import fnmatch
import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of packed members of a partition, about; a larger member stands alone.
PARTITION_BYTES = 32_000_000
HEADER = 512


@dataclass
class Members(InputPartition):
    """A run of members of one archive: (name, offset of the data, packed size, method); None: all of a stream."""

    path: str
    members: list[tuple[str, int, int, str]] | None


def system_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(pattern: str) -> list[str]:
    """Files that a path with wildcards in its last part names, or all of a folder."""
    from pyarrow import fs

    system, path = system_of(pattern)
    prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    folder, _, last = path.rpartition("/")
    if not any(c in last for c in "*?["):
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [pattern]
        folder, last = path, "*"
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(prefix + i.path for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, last))


def number(field: bytes) -> int:
    """A size of a tar header: octal digits, or binary where the first bit is set."""
    if field[:1] >= b"\x80":
        return int.from_bytes(field[1:], "big")
    text = field.split(b"\0")[0].strip()
    return int(text, 8) if text else 0


def checked(block: bytes) -> bool:
    """Whether a block is a tar header: its sum, with the sum's own field as spaces, is what it says."""
    try:
        return len(block) == HEADER and number(block[148:156]) == sum(block[:148]) + 8 * 32 + sum(block[156:])
    except ValueError:
        return False


def text_of(field: bytes) -> str:
    return field.split(b"\0")[0].decode("utf-8", "replace")


def tar_members(file, size: int) -> Iterator[tuple[str, int, int, str]]:
    """Whole regular members of a tar, by its headers alone; long names of both kinds are followed."""
    at, long_name = 0, None
    while at + HEADER <= size:
        file.seek(at)
        block = file.read(HEADER)
        if not checked(block):
            return  # the end, or what is no tar
        kind, length, data = block[156:157], number(block[124:136]), at + HEADER
        if data + length > size:
            return
        name = text_of(block[:100])
        if block[257:262] == b"ustar" and block[345:346] != b"\0" and kind not in (b"L", b"x"):
            name = text_of(block[345:500]) + "/" + name
        if kind == b"L":
            file.seek(data)
            long_name = text_of(file.read(length))
        elif kind == b"x":
            file.seek(data)
            long_name = extended_path(file.read(length)) or long_name
        else:
            if kind in (b"0", b"\0", b"7"):
                yield long_name or name, data, length, "stored"
            long_name = None
        at = data + -(-length // HEADER) * HEADER


def extended_path(records: bytes) -> str | None:
    """The path of an extended header, whose records are 'length key=value' lines."""
    while records:
        length = int(records.split(b" ", 1)[0] or 0)
        if not length:
            break
        key, _, value = records[:length].split(b" ", 1)[1].rstrip(b"\n").partition(b"=")
        if key == b"path":
            return value.decode("utf-8", "replace")
        records = records[length:]
    return None


def zip_members(file) -> Iterator[tuple[str, int, int, str]]:
    """Members of a zip by its directory; the two lengths of each local header tell where its data begin."""
    import zipfile

    with zipfile.ZipFile(file) as archive:
        entries = archive.infolist()
    for e in entries:
        if e.is_dir() or e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            continue
        file.seek(e.header_offset)
        local = file.read(30)
        data = e.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
        yield e.filename, data, e.compress_size, "stored" if e.compress_type == zipfile.ZIP_STORED else "deflated"


def unpacked(raw: bytes, method: str) -> bytes | None:
    """The member's content, gunzipped if it is gzipped; null if it does not unpack."""
    try:
        content = zlib.decompress(raw, -15) if method == "deflated" else raw
        return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    except (OSError, EOFError, zlib.error):
        return None


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.most = options["path"], options.get("pattern", "*"), int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Members]:
        import zipfile

        out = []
        for path in files_of(self.path):
            system, where = system_of(path)
            size = system.get_file_info(where).size
            with system.open_input_file(where) as file:
                head = file.read(HEADER)
                if head[:4] in (b"PK\3\4", b"PK\5\6"):
                    try:
                        members = list(zip_members(file))
                    except (zipfile.BadZipFile, OSError):
                        continue
                elif checked(head):
                    members = list(tar_members(file, size))
                elif head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\0":
                    out.append(Members(path, None))
                    continue
                else:
                    continue
            out.extend(self.runs(path, [m for m in members if fnmatch.fnmatch(m[0], self.pattern)]))
        return out

    def runs(self, path: str, members: list[tuple[str, int, int, str]]) -> Iterator[Members]:
        held, size = [], 0
        for m in members:
            if held and size + m[2] > self.most:
                yield Members(path, held)
                held, size = [], 0
            held.append(m)
            size += m[2]
        if held:
            yield Members(path, held)

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no partitions
            return
        rows = self.streamed(partition.path) if partition.members is None else self.ranged(partition)
        for name, size, content in rows:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([name]), pa.array([size], pa.int64()), pa.array([content], pa.binary())], ["archive", "member", "size", "content"])

    def ranged(self, partition: Members) -> Iterator[tuple[str, int, bytes | None]]:
        system, where = system_of(partition.path)
        with system.open_input_file(where) as file:
            for name, offset, size, method in partition.members:
                file.seek(offset)
                yield name, size, unpacked(file.read(size), method)

    def streamed(self, path: str) -> Iterator[tuple[str, int, bytes | None]]:
        import tarfile

        system, where = system_of(path)
        with system.open_input_file(where) as file:
            try:
                with tarfile.open(fileobj=file, mode="r|*") as archive:
                    for m in archive:
                        if not m.isfile():
                            continue
                        raw = archive.extractfile(m).read()
                        if len(raw) == m.size and fnmatch.fnmatch(m.name, self.pattern):
                            yield m.name, m.size, unpacked(raw, "stored")
            except (tarfile.TarError, EOFError, OSError, zlib.error):
                return


class MemberSource(DataSource):
    """format("members"): (archive, member, size, content). Options: path; pattern, of member names; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)
