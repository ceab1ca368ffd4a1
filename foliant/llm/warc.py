"""WARC records of pages in ZIP packages, written and read back by byte ranges.

A package is a ZIP archive with two stored members: ``archive/data.warc.gz`` (each record compressed on its own) and
``indexes/index.cdxj`` (a line for each record: offset and length in the archive member). Readers take the end of the
package, follow the ZIP64 locator if there is one, parse the central directory, and read single records by their
range: nothing is extracted. Archive members without an index are walked record by record.

Of pages with equal payloads the one with the smallest id is a response and the others revisit it; payloads of fewer
bytes than a minimum are all responses. Payload groups are found by digest: only pages whose digest is marked as one
that occurs twice are joined, the others don't leave their task.

Packages go to the folder that driver and executors share; the list of packages is kept there too, so that each is
written once; packages of failed attempts are not in the list.

Defined results: a null html is an empty payload, a null url no target; rows that repeat an id give a record each,
all responses if their id is the smallest of its payload; a null id counts as larger than all others; an empty table
gives no package and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, shared_dir, small_batches

PACKAGE_BYTES = 32 << 20
#: Records of so many bytes of a package are read by one task.
RANGE_BYTES = 4 << 20
MAX_TASKS = 100_000
#: Repeated digests are marked in a bitmap of so many bits, through which all others pass without a shuffle.
MARK_BITS = 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
FULL = 0xFFFFFFFF


def file_system(uri: str):
    """The file system and path of a URI, for reading and writing on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: str | None) -> str:
    return f"<urn:x-page:{quote(page_id or '', safe='')}>"


def _page_id(record_id: str) -> str | None:
    return unquote(record_id.removeprefix("<urn:x-page:").removesuffix(">")) or None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the same HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; the digest of a response is that of the payload it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != size:
        raise ValueError(f"{fields['WARC-Record-ID']}: {len(payload)} bytes of {size}")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def zip_package(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP archive of stored members; with ``zip64`` all sizes and offsets are in the 64-bit fields."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        crc, size, at, raw = zlib.crc32(data), len(data), len(out), name.encode()
        shown = FULL if zip64 else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra))
        out += raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else b""
        central += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra),
            0, 0, 0, 0, FULL if zip64 else at,
        )
        central += raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    return bytes(out) + struct.pack(
        "<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF if zip64 else n, 0xFFFF if zip64 else n,
        FULL if zip64 else len(central), FULL if zip64 else at, 0,
    )


def zip_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member begin, and how many they are. ``read`` gets an offset and a length."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    locator = tail[at - 20 : at] if at >= 20 else read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, place, found = read(start, length), 0, {}
    for _ in range(n):
        entry = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, place)
        method, packed, plain, n_name, n_extra, n_note, offset = (entry[i] for i in (4, 8, 9, 10, 11, 12, 16))
        name = directory[place + 46 : place + 46 + n_name].decode()
        extra = directory[place + 46 + n_name : place + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL else plain
                packed = next(wide) if packed == FULL else packed
                offset = next(wide) if offset == FULL else offset
            extra = extra[4 + width :]
        place += 46 + n_name + n_extra + n_note
        if method == 0:
            local = struct.unpack("<IHHHHHIIIHH", read(offset, 30))
            found[name] = (offset + 30 + local[9] + local[10], packed)
    return found


def _write(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = file_system(root)
        system.create_dir(folder, recursive=True)
        archive, index, written = bytearray(), [], []

        def flush() -> None:
            name = f"{uuid.uuid4()}.wacz"
            package = zip_package([(ARCHIVE, bytes(archive)), (INDEX, "".join(index).encode())])
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(package)
            written.append((f"{root}/{name}", len(index), len(package)))

        for batch in batches:
            for page_id, url, payload, refers_to in batch.itertuples(index=False):
                plain = record(page_id, url, payload, refers_to)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = packer.compress(plain) + packer.flush()
                about = {"offset": len(archive), "length": len(packed), "filename": ARCHIVE}
                index.append(f"{_record_id(page_id)} {json.dumps(about)}\n")
                archive += packed
                if len(archive) >= PACKAGE_BYTES:
                    flush()
                    archive, index = bytearray(), []
        if index:
            flush()
        yield pd.DataFrame(written, columns=["path", "records", "bytes"])

    return run


def write_packages(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    folder: str | None = None,
    min_revisit_bytes: int = 0,
) -> DataFrame:
    """path, records, bytes of the packages that now hold a record for each page."""
    root = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4()}"
    rows = small_batches(pages).select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    twice = (
        rows.groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("size"))
        .where((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes))
        .select("sha", "first")
    )
    twice = cut(twice)
    mark = F.pmod(F.xxhash64("sha"), F.lit(1 << MARK_BITS))
    marks = F.broadcast(twice.select(mark.alias("mark")).distinct())  # 2^MARK_BITS rows at most
    once = rows.join(marks, mark == F.col("mark"), "left_anti").withColumn("first", F.lit(None).cast(rows.schema["page_id"].dataType))
    marked = rows.join(marks, mark == F.col("mark"), "left_semi").join(twice, "sha", "left")
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    ready = once.unionByName(marked).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", refers_to.cast("string").alias("refers_to")
    )
    return cut(ready.mapInPandas(_write(root), "path string, records long, bytes long"))


def _opened(path: str):
    system, name = file_system(path)
    file = system.open_input_file(name)
    return file, lambda at, n: file.read_at(n, at)


def _walk(read: Callable[[int, int], bytes], at: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each compressed record of an archive member without an index."""
    end = at + size
    while at < end:
        unpacker, place = zlib.decompressobj(31), at
        while not unpacker.eof and place < end:
            part = read(place, min(1 << 16, end - place))
            unpacker.decompress(part)
            place += len(part)
        place -= len(unpacker.unused_data)
        yield at, place - at
        at = place


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            file, read = _opened(path)
            with file:
                members = zip_members(read, file.size())
                places, indexed = [], set()
                for name, (at, size) in members.items():
                    if not name.endswith(".cdxj"):
                        continue
                    for line in read(at, size).decode().splitlines():
                        about = json.loads(line.split(" ", 1)[1])
                        indexed.add(about["filename"])
                        places.append((members[about["filename"]][0] + about["offset"], about["length"]))
                for name, (at, size) in members.items():
                    if name.endswith(".warc.gz") and name not in indexed:
                        places += _walk(read, at, size)
            yield pd.DataFrame({"path": path, "at": [a for a, _ in places], "length": [n for _, n in places]})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, group in batch.groupby("path"):
            file, read = _opened(path)
            with file:
                for at, length in zip(group["at"].tolist(), group["length"].tolist()):
                    out.append(parse_record(zlib.decompress(read(at, length), 31)))
        yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def list_records(packages: DataFrame) -> DataFrame:
    """path, at, length: the byte range of each record of the packages (path)."""
    paths = packages.select("path").repartition(F.col("path"))
    return paths.mapInPandas(_list, "path string, at long, length long")


def read_records(packages: DataFrame) -> DataFrame:
    """page_id (string), payload_bytes, payload_digest, record_type, refers_to (string), payload of each record.

    ``packages``: path, and bytes if known, which then decide on the number of tasks.
    """
    ranges = list_records(packages)
    by = [F.col("path"), F.expr(f"at div {RANGE_BYTES}")]
    if "bytes" in packages.columns:  # ranges are small rows that stand for many bytes
        total = packages.agg(F.sum("bytes")).first()[0] or 0
        by = [min(MAX_TASKS, max(1, total // RANGE_BYTES)), *by]
    ranges = ranges.repartition(*by)
    fields = "payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    return ranges.sortWithinPartitions("path", "at").mapInPandas(_read, f"page_id string, {fields}")
