"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP archive of stored members: ``archive/data.warc.gz`` holds one gzip member for each WARC record,
``indexes/index.cdxj`` one JSON line for each record with its offset and length there. The reader parses the directory at the
end of the package (with its ZIP64 form), finds the stored members, reads the index and then only the ranges of records, many
neighbouring records in one read. Packages without an index are walked record by record.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is a response, the others are
revisits that name it and hold its size and digest, but no payload. All others are responses. Digests are computed in the JVM
and counted before rows move, so copies of a payload meet as one row; payloads move once, by (id, url, digest). Payloads that
make up many of the rows are joined by broadcast: fewer than ``SHARES`` can have more than a 1 / ``SHARES`` part each.

Null html is an empty payload. A null id sorts behind all others; refers_to is then null too. Equal rows are records of their
own: of equal rows of the smallest id one is the response. Urls keep no control characters (they are percent-encoded), a null
url is left out. Payloads of any size are records as they are. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.batches import file_system, map_batches
from shardloom.session import materialize, scratch_path

REVISIT_BYTES = 100
# A package is closed at this size or number of records.
PACKAGE_BYTES = 128 << 20
PACKAGE_RECORDS = 100_000
# Bytes of neighbouring records read in one go, about.
READ_BYTES = 8 << 20
# Ranges that one task reads, about.
READS = 4
SHARES = 10_000

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadPackage(ValueError):
    """A package or record that cannot be read as what it says it is."""


# --- ZIP directories -----------------------------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    header: int  # where its local header begins
    size: int
    stored: bool


_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_LIMIT16, _LIMIT32 = 0xFFFF, 0xFFFFFFFF


def _directory(file: pa.NativeFile) -> tuple[int, int, int, int]:
    """Place, size and number of entries of the central directory, and by how many bytes the package is shifted in its file."""
    size = file.size()
    tail_at = max(0, size - 22 - _LIMIT16)
    tail = file.read_at(size - tail_at, tail_at)
    at = len(tail)
    while (at := tail.rfind(_END, 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise BadPackage("no end of a central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    locator = file.read_at(20, end - 20) if end >= 20 else b""
    if locator[:4] == _LOCATOR and (entries == _LIMIT16 or length == _LIMIT32 or offset == _LIMIT32):
        noted = struct.unpack_from("<Q", locator, 8)[0]
        # Bytes in front of a package shift everything; the record stands right before its locator then.
        for place in (noted, end - 20 - 56):
            record = file.read_at(56, place) if 0 <= place <= size - 56 else b""
            if record[:4] == _END64:
                break
        else:
            raise BadPackage("no ZIP64 end of the central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        end = place
    return end - length, length, entries, end - length - offset


def members(file: pa.NativeFile, window: int = 1 << 20) -> Iterator[Member]:
    """Members by the central directory, which is read in windows."""
    place, length, entries, shift = _directory(file)
    if place < 0:
        raise BadPackage("the central directory begins before the file")
    buffer, at, end = b"", 0, place + length
    for _ in range(entries):
        if len(buffer) - at < 46 + 3 * _LIMIT16 and place < end:
            more = file.read_at(min(max(window, 46 + 3 * _LIMIT16), end - place), place)
            place += len(more)
            buffer, at = buffer[at:] + more, 0
        if buffer[at : at + 4] != _ENTRY:
            raise BadPackage("a damaged entry in the central directory")
        flags, method = struct.unpack_from("<HH", buffer, at + 8)
        packed, size, n, m, k = struct.unpack_from("<IIHHH", buffer, at + 20)
        header = struct.unpack_from("<I", buffer, at + 42)[0]
        name = buffer[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = buffer[at + 46 + n : at + 46 + n + m]
        at += 46 + n + m + k
        while len(extra) >= 4:
            tag, count = struct.unpack_from("<HH", extra)
            if tag == 1:  # wide numbers, in this order, for those that have no room
                wide = iter(struct.unpack_from(f"<{count // 8}Q", extra, 4))
                try:
                    size, packed, header = (next(wide) if x == _LIMIT32 else x for x in (size, packed, header))
                except (StopIteration, RuntimeError) as gone:
                    raise BadPackage(f"no wide sizes for {name!r}") from gone
            extra = extra[4 + count :]
        yield Member(name, header + shift, size, method == 0 and packed == size and not flags & 1)


def data_begin(file: pa.NativeFile, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if not member.stored:
        raise BadPackage(f"{member.name!r} is not stored as it is, so ranges of it cannot be read")
    header = file.read_at(30, member.header)
    if header[:4] != _LOCAL:
        raise BadPackage(f"no local header of {member.name!r}")
    n, m = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n + m


# --- WARC records -----------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, copy]))}>"


def write_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, copy: int = 0,
                 refers: tuple[int | None, str | None] | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response with its payload, or a revisit of ``refers`` (id and url) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers is None else http
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
            ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if refers is not None:
        target, target_url = refers
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target, target_url, digest, 0)),
                 ("WARC-Refers-To-Target-URI", None if target_url is None else _clean(target_url)), ("X-Refers-To-Page-ID", target)]
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in head if value is not None) + "\r\n"
    return zlib.compress(text.encode() + block + b"\r\n\r\n", 6, 31)


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {"": lines[0], **{name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and body of one record; names are lower-case, the first line has the name ``""``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _header(head)
    if not warc[""].startswith("WARC/"):
        raise BadPackage("no WARC record at an indexed place")
    block = rest[: int(warc["content-length"])]
    if len(block) < int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise BadPackage("a WARC record is not as long as it says")
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, _header(http) if http.startswith(b"HTTP/") else {}, body


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_record(raw: bytes) -> dict | None:
    """A record's row; null for records of other types. The digest of a payload is computed again and must agree."""
    warc, http, body = parse_record(raw)
    kind = warc.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    method, _, noted = warc.get("warc-payload-digest", "").partition(":")
    row = {"page_id": _number(warc.get("x-page-id")), "url": warc.get("warc-target-uri"), "record_id": warc.get("warc-record-id"),
           "record_type": kind, "refers_to": _number(warc.get("x-refers-to-page-id")), "payload": None}
    if kind == "revisit":
        return row | {"payload_bytes": _number(http.get("content-length")), "payload_digest": noted if method == "sha256" else None}
    digest = hashlib.sha256(body).hexdigest()
    if method == "sha256" and noted != digest:
        raise BadPackage(f"the payload of {row['record_id']} is not what its digest says")
    return row | {"payload_bytes": len(body), "payload_digest": digest, "payload": body}


# --- packages ----------------------------------------------------------------------------------------------------------------


class _Package:
    """One package that is being written; nothing of it is held but its index."""

    def __init__(self, folder: str, name: str):
        self.name = name
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(_Forward(self.out), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(_info(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, record: bytes, **noted) -> None:
        self.data.write(record)
        self.lines.append(json.dumps({"offset": self.at, "length": len(record), **noted}))
        self.at += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(_info(INDEX), "".join(line + "\n" for line in self.lines))
        self.zip.close()
        self.out.close()
        return self.name, len(self.lines), self.at


class _Forward:
    """A stream that cannot go back, as object stores have it."""

    def __init__(self, out):
        self.write, self.flush = out.write, lambda: None


def _info(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))


def index_of(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(absolute offset, length) of every record of a package, in order for each member."""
    data: dict[str, Member] = {}
    indexes: list[Member] = []
    for member in members(file):
        if re.fullmatch(r"archive/.*\.warc(\.gz)?", member.name):
            data[member.name] = member
        elif re.fullmatch(r"indexes/.*\.cdxj", member.name):
            indexes.append(member)
    begin = {name: data_begin(file, member) for name, member in data.items()}
    seen = set()
    for member in indexes:
        for line in _lines(file, data_begin(file, member), member.size):
            entry = json.loads(line[line.index(b"{") :])
            name = entry.get("filename", DATA)
            name = name if name in data else f"archive/{name}"
            if name not in data or int(entry["offset"]) + int(entry["length"]) > data[name].size:
                raise BadPackage("the index names a place outside the archive")
            seen.add(name)
            yield begin[name] + int(entry["offset"]), int(entry["length"])
    for name in data.keys() - seen:
        if not indexes or data[name].size:
            yield from _walk(file, begin[name], data[name].size)


def _lines(file: pa.NativeFile, at: int, size: int, window: int = 1 << 20) -> Iterator[bytes]:
    rest, end = b"", at + size
    while at < end:
        some = file.read_at(min(window, end - at), at)
        at += len(some)
        *lines, rest = (rest + some).split(b"\n")
        yield from filter(None, lines)
    if rest:
        yield rest


def _walk(file: pa.NativeFile, begin: int, size: int, window: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Gzip members of an archive without an index, one after the other."""
    end, at, buffer = begin + size, begin, b""
    while at < end:
        inflate, place = zlib.decompressobj(31), at
        while not inflate.eof:
            some = buffer or file.read_at(min(window, end - place), place)
            if not some:
                raise BadPackage("an archive ends within a record")
            buffer = b""
            inflate.decompress(some)
            place += len(some)
        buffer = inflate.unused_data
        stop = place - len(buffer)
        yield at, stop - at
        at = stop


# --- jobs ------------------------------------------------------------------------------------------------------------------------


def _same(left: list[str], prefix: str) -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in left))


def _prefixed(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in names], *[c for c in df.columns if c not in names])


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Different pages (page_id, url, digest, size) with their number, how many of them are responses, and head (id and url) for revisits.

    ``pages`` has page_id, url, digest and size. Written, since several steps read it.
    """
    rows = materialize(pages.groupBy("page_id", "url", "digest", "size").agg(F.count(F.lit(1)).alias("n")), "pages")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url"))
    heads = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(
        first.alias("head"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).where("all > 1")
    heads = _prefixed(heads, "head_", ["digest", "size"])
    many = rows.count() // SHARES + 1  # fewer than SHARES payloads can have more rows than this
    on = (F.col("digest") == F.col("head_digest")) & (F.col("size") == F.col("head_size"))
    common = F.broadcast(heads.where(F.col("k") > many))
    beside = rows.join(common, on, "left")
    rest = beside.where("head_digest is null").select(*rows.columns).join(heads.where(F.col("k") <= many), on, "left")
    joined = beside.where("head_digest is not null").unionByName(rest)
    is_head = F.col("page_id").eqNullSafe(F.col("head.page_id")) & F.col("url").eqNullSafe(F.col("head.url"))
    responses = F.when(F.col("head").isNull(), F.col("n")).when(is_head, 1).otherwise(0).cast("bigint")
    return joined.select(*rows.columns, responses.alias("responses"), F.struct("head.page_id", "head.url").alias("head"))


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the records of ``pages`` into packages below ``folder``, one of all executors; returns (file, records, bytes).

    Names are new for every attempt of a task, and only files in the returned list are whole.
    """
    raw = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    base = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), raw.alias("raw"))
    base = base.withColumns({"digest": F.sha2("raw", 256), "size": F.octet_length("raw").cast("bigint")})
    plan = materialize(plan_records(base.select("page_id", "url", "digest", "size")), "records")
    keys = ["page_id", "url", "digest"]
    written = _prefixed(plan.where("responses > 0").select(*keys, "size", "n", "responses"), "p_", [*keys, "size"])
    # A row is a record, but for equal rows of which only one has a payload.
    shared = (F.col("n") > F.col("responses"))
    single = base.join(written.where(~shared), _same(keys, "p_")).select(*keys, "size", "raw")
    parts = [single]
    if not written.where(shared).isEmpty():
        parts.append(base.join(written.where(shared), _same(keys, "p_")).groupBy(*keys, "size").agg(F.any_value("raw").alias("raw")))
    head = plan.schema["head"].dataType
    responses = reduce(DataFrame.union, parts).select(*keys, "size", "raw", F.lit(None).cast(head).alias("head"), F.lit(0).cast("bigint").alias("copy"))
    revisits = plan.where("n > responses").select(
        *keys, "size", F.lit(None).cast("binary").alias("raw"), "head",
        F.explode(F.sequence(F.col("responses"), F.col("n") - 1)).alias("copy"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, package = TaskContext.get().partitionId(), 0, None

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("file", "records", "bytes"), package.close())})

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "raw", "head", "copy")))
            for page, target, digest, size, payload, refers, copy in rows:
                if package is None:
                    package = _Package(folder, f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.wacz")
                refers = None if refers is None else (refers["page_id"], refers["url"])
                package.add(write_record(page, target, digest, size, payload, copy, refers), page_id=page, digest=f"sha256:{digest}")
                if package.at >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                    yield listed()
                    package, number = None, number + 1
        if package is not None:
            yield listed()

    made = map_batches(responses.unionByName(revisits), step, "file string, records bigint, bytes bigint")
    return materialize(made.withColumn("file", F.concat(F.lit(folder + "/"), "file")), "packages")


RECORDS = ("page_id bigint, url string, record_id string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")


def read_packages(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of packages, a table with a column ``file``.

    Directories and indexes are read by one task for each package; ranges of records are then dealt to all tasks.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, inner = file_system(path)
                with system.open_input_file(inner) as file:
                    lengths: list[int] = []
                    begin = 0
                    for at, length in index_of(file):
                        if lengths and (at != begin + sum(lengths) or at + length - begin > READ_BYTES):
                            yield unit(path, begin, lengths)
                            lengths = []
                        begin = begin if lengths else at
                        lengths.append(length)
                    if lengths:
                        yield unit(path, begin, lengths)

    def unit(path: str, begin: int, lengths: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [path], "begin": [begin], "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    fields = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.string(), pa.binary()]
    kind = pa.schema(list(zip(fields, types)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, lengths in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "lengths"))):
                system, inner = file_system(path)
                with system.open_input_file(inner) as file:
                    raw = file.read_at(sum(lengths), begin)
                rows, at = [], 0
                for length in lengths:
                    row = read_record(zlib.decompress(raw[at : at + length], 31))
                    at += length
                    if row:
                        rows.append(row if with_payload else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(rows, kind)

    # Rows of a few bytes stand for much to read, so the number of tasks follows the number of rows, not their bytes.
    names = files.select("file").repartition(max(1, files.count()), "file")
    units = materialize(map_batches(names, locate, "file string, begin bigint, lengths array<bigint>"), "ranges")
    return map_batches(units.repartition(max(1, -(-units.count() // READS)), "file", "begin"), read, RECORDS)


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """Every package below ``folder``; only names are listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into packages in the shared folder; returns their list."""
    return write_packages(pages, scratch_path(pages.sparkSession, "packages"))
