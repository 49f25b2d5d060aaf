"""Media columns: a Spark data source over directories of image archives.

An archive is a tar file of lossless 8-bit greyscale PNG members with an index
beside it.  Writing commits archives by a manifest, so what a lost or repeated
task left behind is never read.  Reading plans byte ranges over the archives;
a range holds the members that start in it, each member is fetched and checked
by its own offset, and retried on its own.
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import tarfile
import time
import uuid
import zlib
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Samples in a row of the image.
WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_ENTRY = struct.Struct("<qqqI")  # offset of the header, of the data, length, crc32
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, feature string"
#: With the option ``content=digest``: what is known of the bytes, without the bytes.
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of WIDTH."""
    return data + b" " * ((-len(data)) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(data: bytes, level: int = 1) -> bytes:
    """The padded bytes as an 8-bit greyscale image; the unpadded length goes to a text chunk."""
    payload = pad(data)
    rows = len(payload) // WIDTH
    raw = b"".join(b"\x00" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\x00%d" % len(data)) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(samples, unpadded length) of an image that ``encode_png`` made; raises ValueError if damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, width, n, packed = 8, 0, 0, []
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"tEXt":
            n = int(body.partition(b"\x00")[2])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    raw = zlib.decompress(b"".join(packed))
    return b"".join(raw[i + 1 : i + 1 + width] for i in range(0, len(raw), width + 1)), n


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Archived(WriterCommitMessage):
    archives: list


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int

    def __hash__(self):
        return hash((self.archive, self.start))


class ArchiveWriter(DataSourceArrowWriter):
    """Appends every row of a task to archives of bounded size."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("archive_bytes", 128 << 20))

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        done, out, entries, name = [], None, [], ""

        def finish():
            out.write(b"\0" * 1024)
            size = out.tell()
            out.close()
            with fs.open_output_stream(posixpath.join(root, name + ".idx")) as idx:
                idx.write(b"".join(_ENTRY.pack(*e) for e in entries))
            done.append([name, size, len(entries)])

        for batch in iterator:
            ids, data = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.tar"
                    out, entries = fs.open_output_stream(posixpath.join(root, name)), []
                media = encode_png(data[i].as_py() or b"")
                info = tarfile.TarInfo(f"{ids[i].as_py()}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                at = out.tell()
                out.write(head + media + b"\0" * (-len(media) % 512))
                entries.append((at, at + len(head), len(media), zlib.crc32(media)))
                if out.tell() >= self.limit:
                    finish()
                    out = None
        if out is not None:
            finish()
        return Archived(done)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        archives = [a for m in messages if m is not None for a in m.archives]
        with fs.open_output_stream(posixpath.join(root, f"manifest-{uuid.uuid4().hex}.json")) as f:
            f.write(json.dumps(archives).encode())

    def abort(self, messages):
        pass  # what no manifest lists is never read


class ArchiveReader(DataSourceReader):
    """Plans byte ranges over the archives that manifests list and streams their members."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 16 << 20))
        self.batch = int(options.get("batch_bytes", 4 << 20))
        self.digest = options.get("content", "bytes") == "digest"
        self.retries = int(options.get("retries", 3))
        self.wait = float(options.get("retry_seconds", 0.2))

    def partitions(self):
        from pyarrow import fs as afs

        fs, root = _filesystem(self.path)
        found = []
        for f in sorted(fs.get_file_info(afs.FileSelector(root)), key=lambda f: f.path):
            if f.base_name.startswith("manifest-"):
                with fs.open_input_stream(f.path) as s:
                    found += json.loads(s.read())
        ranges = [ByteRange(name, lo, min(size, lo + self.split)) for name, size, _ in found for lo in range(0, size, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def fetch(self, fs, path: str, entry: tuple, opened: list | None = None) -> tuple[int | None, bytes, bytes, int]:
        """One member by its offset, read again by itself from a file opened anew if the read or a check fails.

        ``opened`` holds the archive between members.
        """
        at, start, length, crc = entry
        opened = [] if opened is None else opened
        for attempt in range(self.retries + 1):
            try:
                if not opened:
                    opened.append(fs.open_input_file(path))
                opened[0].seek(at)
                raw = opened[0].read(start - at + length)
                info = tarfile.TarInfo.frombuf(raw[:512], "utf-8", "strict")
                media = raw[start - at :]
                if len(media) != length or zlib.crc32(media) != crc:
                    raise ValueError("short or damaged member")
                payload, n = decode_png(media)
                stem = info.name.removesuffix(".png")
                return (None if stem == "None" else int(stem)), media, payload, n
            except (OSError, ValueError, zlib.error, tarfile.TarError) as e:
                for f in opened:
                    f.close()
                opened.clear()
                if attempt == self.retries:
                    raise OSError(f"{path} at {at}: {e}") from e
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def row(self, doc_id, media: bytes, payload: bytes, n: int) -> tuple:
        if not self.digest:
            return doc_id, n, media, payload, feature(payload)
        return doc_id, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), feature(payload)

    def read(self, partition):
        from lattica.llm.chunks import rows as batch_of

        if not partition.archive:
            return
        fs, root = _filesystem(self.path)
        path = posixpath.join(root, partition.archive)
        with fs.open_input_stream(path + ".idx") as s:
            index = s.read()
        schema, held, size, opened = DIGEST if self.digest else SCHEMA, [], 0, []
        for entry in _ENTRY.iter_unpack(index):
            if not partition.start <= entry[0] < partition.stop:
                continue
            doc_id, media, payload, n = self.fetch(fs, path, entry, opened)
            held.append(self.row(doc_id, media, payload, n))
            size += len(media) + len(payload)
            if size >= self.batch:
                yield batch_of(schema, *zip(*held, strict=True))
                held, size = [], 0
        for f in opened:
            f.close()
        if held:
            yield batch_of(schema, *zip(*held, strict=True))


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(dir)``; writes rows of (doc_id long, data binary).

    Null data are empty bytes, a null doc_id comes back as null, repeated rows
    are members each, and a folder without rows gives none.
    """

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return DIGEST if self.options.get("content") == "digest" else SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


def feature(payload: bytes) -> str:
    """Whole-number features of the samples: size, extremes, sum, mean square, a 16-bin histogram, edges along rows."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    grid = x.reshape(-1, WIDTH).astype(np.int64)
    hist = np.bincount(x >> 4, minlength=16)
    edges = int(np.abs(np.diff(grid, axis=1)).sum())
    return f"w={WIDTH};h={len(grid)};min={x.min()};max={x.max()};sum={int(grid.sum())};sq={int((grid * grid).sum())};edges={edges};hist={','.join(map(str, hist.tolist()))}"


def tar_members(archive: bytes) -> list[str]:
    """Names in an archive, by the standard reader; for tests and inspection."""
    return tarfile.open(fileobj=io.BytesIO(archive)).getnames()
