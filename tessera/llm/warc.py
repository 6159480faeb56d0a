"""WARC archives packed into ZIP files: written by tasks, and read back by byte ranges, without extraction.

A package is a ZIP file with stored members: ``archive/N.warc.gz``, a WARC file whose records are gzip members of their own, and
``indexes/N.cdxj``, a line for each record with its place in it. As both are stored, a record is a byte range of the
package. Reading goes in three steps, each a DataFrame: the packages' directories (the end of central directory record, that of ZIP64
where the package needs one, the entries), the index lines of the members, then the records' ranges, sorted by place and read in runs.

Packages are read and written in tasks through pyarrow's file systems (local and shared folders, HDFS, object stores)."""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import checkpoint, free_names, give_back, join_by_key, limit_batches

#: Bytes of compressed records in an archive member, about, and of members in a package.
MEMBER_BYTES = 8_000_000
PACKAGE_BYTES = 256_000_000
#: Payloads from which equal ones are written once.
LEAST_REVISIT = 1000
#: Bytes that are read at once: ranges of neighbouring records are joined up to it, directories and indexes are read in such pieces.
READ_BYTES = 4_000_000

# Signatures and layouts of ZIP, and names of WARC.
EOCD, EOCD64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
EOCD_SIZE, LOCATOR64_SIZE, EOCD64_SIZE, ENTRY_SIZE, LOCAL_SIZE, COMMENT = 22, 20, 56, 46, 30, 65535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MEMBER = "package string, member string, method int, size long, stored_size long, data_offset long, error string"
RECORD = "package string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_sha1 string, payload_bytes long, payload binary, error string"


def file_system(path: str):
    """(pyarrow's file system, path in it) of a URI; a path with no scheme, and ``file:/x`` as Hadoop writes it, are local."""
    from pyarrow import fs

    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(path)


# --- ZIP


def directory_place(tail: bytes, size: int, read) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory of a package of ``size`` bytes whose last bytes are ``tail``; ``read(offset, n)``.

    The record is the last one whose comment reaches just to the end. Where a field of it is full, that of ZIP64 holds, to which a
    locator before it points."""
    at = len(tail)
    while True:
        at = tail.rfind(EOCD, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        if at + EOCD_SIZE <= len(tail) and at + EOCD_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL16 or length == FULL32 or offset == FULL32:
        locator = tail[at - LOCATOR64_SIZE : at] if at >= LOCATOR64_SIZE else read(size - len(tail) + at - LOCATOR64_SIZE, LOCATOR64_SIZE)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], EOCD64_SIZE)
        if record[:4] != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    if offset + length > size:
        raise ValueError("the central directory lies beyond the end")
    return offset, length, entries


def entries_of(read, offset: int, length: int, entries: int, piece: int = READ_BYTES) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, size, stored size, offset of the local header) of each entry, the directory being read in pieces."""
    held, at, end = b"", offset, offset + length
    for _ in range(entries):
        while len(held) < ENTRY_SIZE or len(held) < ENTRY_SIZE + sum(struct.unpack_from("<HHH", held, 28)):
            more = read(at, min(piece, end - at)) if at < end else b""
            if not more:
                raise ValueError("the central directory is cut")
            held, at = held + more, at + len(more)
        if held[:4] != ENTRY:
            raise ValueError("no entry where one should be")
        flags, method = struct.unpack_from("<HH", held, 8)
        stored, size = struct.unpack_from("<II", held, 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", held, 28)
        local = struct.unpack_from("<I", held, 42)[0]
        name, extra = held[ENTRY_SIZE : ENTRY_SIZE + n_name], held[ENTRY_SIZE + n_name : ENTRY_SIZE + n_name + n_extra]
        place = 0
        while place + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, place)
            if tag == 1:  # ZIP64: of the fields below only those that are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                size = next(values) if size == FULL32 else size
                stored = next(values) if stored == FULL32 else stored
                local = next(values) if local == FULL32 else local
            place += 4 + n
        yield name.decode("utf-8" if flags & 0x800 else "cp437"), method, size, stored, local
        held = held[ENTRY_SIZE + n_name + n_extra + n_comment :]


def members_of(path: str) -> list[dict]:
    """The members of a package; one with an error if it can't be read as such."""
    at = {"package": path, "member": None, "method": None, "size": None, "stored_size": None, "data_offset": None, "error": None}
    try:
        system, place = file_system(path)
        with system.open_input_file(place) as f:
            size = f.size()
            read = lambda offset, n: f.read_at(n, offset)
            n = min(size, EOCD_SIZE + COMMENT)
            out = []
            for name, method, full, stored, local in entries_of(read, *directory_place(read(size - n, n), size, read)):
                head = read(local, LOCAL_SIZE)
                if head[:4] != LOCAL:
                    raise ValueError(f"no local header of {name}")
                begins = local + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))
                if begins + stored > size:
                    raise ValueError(f"{name} lies beyond the end")
                out.append(at | {"member": name, "method": method, "size": full, "stored_size": stored, "data_offset": begins})
            return out
    except (OSError, ValueError, struct.error, StopIteration, UnicodeDecodeError) as e:
        return [at | {"error": f"{type(e).__name__}: {e}"}]


def members(packages: DataFrame) -> DataFrame:
    """The members of packages (column package: a path): MEMBER columns; a package that is no ZIP file has a row with its error."""

    schema = StructType.fromDDL(MEMBER)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(members_of(path), schema=arrow)

    return packages.select("package").where("package is not null").mapInArrow(run, schema)


# --- WARC


def record_bytes(kind: str, record_id: str, uri: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """A WARC record whose block is an HTTP response; that of a revisit ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The named fields of a record and its payload (what follows the HTTP header; null in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut")
    block = rest[:n]
    payload = None
    if fields.get("warc-type") == "response":
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    return {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest"), "payload": payload}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Packages:
    """The packages that a task writes: members are filled, then packed; a new package begins once one is large."""

    def __init__(self, folder: str, member_bytes: int, package_bytes: int):
        self.folder, self.member_bytes, self.package_bytes = folder, member_bytes, package_bytes
        self.zip = None
        self.written: list[dict] = []
        self._empty()

    def _empty(self):
        self.body, self.index = io.BytesIO(), []

    def add(self, record: bytes, entry: dict) -> None:
        packed = _gzip(record)
        self.index.append(json.dumps(entry | {"offset": self.body.tell(), "length": len(packed)}, ensure_ascii=False))
        self.body.write(packed)
        if self.body.tell() >= self.member_bytes:
            self.pack()

    def pack(self) -> None:
        """Write the member that has been filled, and its index."""
        import zipfile

        if not self.index:
            return
        if self.zip is None:
            path = f"{self.folder}/{uuid.uuid4().hex}.wacz"  # an attempt's own: what a lost one has left is in no list
            system, place = file_system(path)
            self.stream = system.open_output_stream(place)
            self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
            self.written.append({"package": path, "records": 0, "bytes": 0})
        now = self.written[-1]
        nth = len(self.zip.namelist()) // 2
        self.zip.writestr(f"archive/{nth}.warc.gz", self.body.getvalue())
        self.zip.writestr(f"indexes/{nth}.cdxj", "\n".join(self.index) + "\n")
        now["records"] += len(self.index)
        now["bytes"] += self.body.tell()
        self._empty()
        if now["bytes"] >= self.package_bytes:
            self.close()

    def close(self) -> None:
        self.pack()
        if self.zip is not None:
            self.zip.close()
            self.stream.close()
            self.zip = None


class _Sink(io.RawIOBase):
    """A stream that can only be written on, as object stores have it."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)


def deduplicated(pages: DataFrame, keep: list[str], least: int = LEAST_REVISIT) -> DataFrame:
    """``keep``, page_id, url, html, payload_digest (SHA-1), record_type and refers_to (a page_id) of every page, before it is written.

    Of payloads of ``least`` bytes or more that are equal (by SHA-1, a 64-bit hash and size) the one with the largest page_id is the response. Rows that
    repeat that page_id are all responses; null page_ids are the smallest. Texts stay where they are: keys alone are grouped."""
    key, first, n = free_names(pages, "_key", "_first", "_n")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.withColumn(key, F.struct(F.sha1(payload).alias("sha1"), F.xxhash64(payload).alias("x"), F.octet_length(payload).alias("size")))
    large = F.when(F.col(f"{key}.size") >= least, F.col(key))
    groups = hashed.where(F.col(f"{key}.size") >= least).groupBy(key).agg(F.max("page_id").alias(first), F.count("*").alias(n)).where((F.col(n) > 1) & F.col(first).isNotNull()).drop(n)
    groups = checkpoint(groups)
    met = join_by_key(hashed, groups, [key])
    again = F.col(first).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(first)) & large.isNotNull()
    return met.select(*keep, "page_id", "url", "html", F.col(f"{key}.sha1").alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col(first)).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_id_of(column: str) -> Column:
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


def write_packages(pages: DataFrame, folder: str, member_bytes: int = MEMBER_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every page into packages below ``folder``; package, records and bytes of each, written to the shared folder.

    ``pages`` as ``deduplicated`` has them. Null urls are written as ``about:blank``, white space and control characters in urls by their codes."""
    limit_batches(pages.sparkSession)
    system, place = file_system(folder)
    system.create_dir(place)

    body = F.when(F.col("record_type") == "response", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", body.alias("body"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), "payload_digest", "record_type", "refers_to")

    def run(batches):
        out = _Packages(folder, member_bytes, package_bytes)
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, size, digest, kind, refers = (c[i].as_py() for c in batch.columns)
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
                refers_to = record_id(refers) if kind == "revisit" else None
                record = record_bytes(kind, record_id(page), url, digest, refers_to, payload or b"")
                out.add(record, {"url": url, "digest": f"sha1:{digest}", "type": kind, "size": size})
        out.close()
        if out.written:
            yield pa.RecordBatch.from_pylist(out.written, schema=pa.schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
        give_back()

    return checkpoint(rows.mapInArrow(run, "package string, records long, bytes long"))


def _pieces(f, offset: int, length: int, piece: int = READ_BYTES) -> Iterator[bytes]:
    for at in range(offset, offset + length, piece):
        yield f.read_at(min(piece, offset + length - at), at)


def gzip_members(pieces: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members of a stream that has no index; what they hold is not kept."""
    start, at, z = 0, 0, None
    for data in pieces:
        while data:
            z = z or zlib.decompressobj(31)
            z.decompress(data, 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            if not z.eof:
                at += len(data)
                break
            at += len(data) - len(z.unused_data)
            yield start, at - start
            data, z, start = z.unused_data, None, at
    if z is not None:
        raise ValueError("the last record is cut")


def places(found: DataFrame) -> DataFrame:
    """package, offset and length of every record of the stored archive members in ``members``: from the member's index where there is one, else
    from the archive itself, which is then read through; error for those that can't be told."""
    sort = F.regexp_extract("member", r"^(archive|indexes)/(.*?)\.(?:warc\.gz|cdxj)$", 1)
    name = F.regexp_extract("member", r"^(?:archive|indexes)/(.*?)\.(?:warc\.gz|cdxj)$", 1)
    named = found.where("error is null").withColumn("sort", sort).withColumn("name", name).where("sort <> ''")
    entry = F.struct("data_offset", "stored_size", "method", "member")
    pick = lambda s: F.max(F.when(F.col("sort") == s, entry)).alias(s)
    pairs = named.groupBy("package", "name").agg(pick("archive"), pick("indexes")).where("archive is not null")
    rows = pairs.select("package", F.to_json("archive").alias("archive"), F.to_json("indexes").alias("indexes"))
    schema = "package string, offset long, length long, error string"

    def lines(f, index) -> Iterator[bytes]:
        rest = b""
        for data in _pieces(f, index["data_offset"], index["stored_size"]):
            *whole, rest = (rest + data).split(b"\n")
            yield from whole
        yield rest

    def run(batches):
        arrow = pa.schema([("package", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("error", pa.string())])
        put = lambda path, rows, error=None: pa.RecordBatch.from_pylist([{"package": path, "offset": a, "length": n, "error": error} for a, n in rows], schema=arrow)
        for batch in batches:
            for path, archive, index in zip(*(c.to_pylist() for c in batch.columns)):
                archive, index = json.loads(archive), json.loads(index) if index else None
                try:
                    if archive["method"]:
                        raise ValueError(f"{archive['member']} is compressed in the package")
                    system, place = file_system(path)
                    with system.open_input_file(place) as f:
                        begins, out = archive["data_offset"], []
                        if index is None or index["method"]:
                            spots = gzip_members(_pieces(f, begins, archive["stored_size"]))
                        else:
                            spots = ((x["offset"], x["length"]) for x in (json.loads(s) for s in lines(f, index) if s.strip()))
                        for a, n in spots:
                            if a < 0 or n < 0 or a + n > archive["stored_size"]:
                                raise ValueError("a record lies beyond its archive")
                            out.append((begins + a, n))
                            if len(out) == 10_000:
                                yield put(path, out)
                                out = []
                        yield put(path, out)
                except (OSError, ValueError, KeyError, TypeError, zlib.error) as e:
                    yield put(path, [(None, None)], f"{type(e).__name__}: {e}")

    return rows.mapInArrow(run, schema)


def runs_of(spots: list[tuple[int, int]], limit: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, which spots) of reads that take neighbouring spots (offset, length), in order, together."""
    start = end = 0
    held: list[int] = []
    for i, (a, n) in enumerate(spots):
        if held and (a != end or end + n - start > limit):
            yield start, end - start, held
            held = []
        if not held:
            start = a
        held.append(i)
        end = a + n
    if held:
        yield start, end - start, held


def records(spots: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at ``places``: RECORD columns; payload_sha1 and payload_bytes are taken from the payload that was read.

    Without ``payloads`` the payload itself is left out. Records are dealt by package and offset, so that a task reads its ranges in order; a record that
    can't be read has a row with its error."""
    limit_batches(spots.sparkSession)
    dealt = spots.where("error is null").select("package", "offset", "length").repartitionByRange("package", "offset").sortWithinPartitions("package", "offset")

    def read(path: str, spots: list[tuple[int, int]]) -> Iterator[dict]:
        import hashlib

        none = dict.fromkeys(c.split()[0] for c in RECORD.split(", ")) | {"package": path}
        try:
            system, place = file_system(path)
            f = system.open_input_file(place)
        except OSError as e:
            yield from (none | {"offset": a, "error": f"{type(e).__name__}: {e}"} for a, _ in spots)
            return
        with f:
            for start, length, which in runs_of(spots):
                data = f.read_at(length, start)
                for i in which:
                    a, n = spots[i]
                    try:
                        row = parse_record(zlib.decompress(data[a - start : a - start + n], 31))
                    except (ValueError, KeyError, zlib.error) as e:
                        yield none | {"offset": a, "error": f"{type(e).__name__}: {e}"}
                        continue
                    if row["payload"] is not None:
                        row |= {"payload_sha1": hashlib.sha1(row["payload"]).hexdigest(), "payload_bytes": len(row["payload"])}
                    yield none | row | {"offset": a, "payload": row["payload"] if payloads else None}

    schema = StructType.fromDDL(RECORD)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            paths, offsets, lengths = (c.to_pylist() for c in batch.columns)
            begins = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
            for a, b in zip(begins, [*begins[1:], len(paths)]):
                out, size = [], 0
                for row in read(paths[a], list(zip(offsets[a:b], lengths[a:b]))):
                    out.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        give_back()

    return dealt.mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Records without payloads (a written table), revisits with the payload_bytes and payload_sha1 of the response that they refer to.

    A response is known by its record id and digest, as ids of repeated pages are not unique."""
    key = [F.col("payload_digest").alias("payload_digest")]
    told = found.where("warc_type = 'response' and payload_bytes >= 1000").select(F.col("record_id").alias("refers_to"), *key, "payload_bytes", "payload_sha1")
    told = checkpoint(told.groupBy("refers_to", "payload_digest").agg(F.max("payload_bytes").alias("told_bytes"), F.max("payload_sha1").alias("told_sha1")))
    met = join_by_key(found, told, ["refers_to", "payload_digest"])
    return met.withColumn("payload_bytes", F.coalesce("payload_bytes", "told_bytes")).withColumn("payload_sha1", F.coalesce("payload_sha1", "told_sha1")).drop("told_bytes", "told_sha1")


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of packages (column package), by ranges; packages, archives and records that can't be read have a row with an error each."""
    found = checkpoint(members(packages))
    spots = checkpoint(places(found))
    broken = [df.where("error is not null").select("package", "error") for df in (found, spots)]
    out = records(spots, payloads)
    for df in broken:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*[c.split()[0] for c in RECORD.split(", ")])


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from packages written below ``folder``.

    A null html is an empty payload. Repeated rows are records each; a null page_id is read back as such; other columns are left
    out; an empty table gives no rows. What was read is written to the shared folder, so ``folder`` may go after that. Raises if a record
    can't be read back or its payload's SHA-1 is not the written one."""
    written = write_packages(deduplicated(pages.select("page_id", "url", "html"), []), folder)
    found = checkpoint(read_packages(written, payloads=False))
    found = checkpoint(resolved(found))
    wrong = found.where("error is not null or payload_sha1 is null or payload_digest <> concat('sha1:', payload_sha1)").select("package", "offset", "error").first()
    if wrong:
        raise ValueError(f"{wrong['package']} at {wrong['offset']}: {wrong['error'] or 'another payload than was written'}")
    digest = F.expr("substr(payload_digest, 6)")
    return found.select(page_id_of("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), page_id_of("refers_to").alias("refers_to"))
