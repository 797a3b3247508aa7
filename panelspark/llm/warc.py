"""WARC records in ZIP packages: written as stored members, read by ranges through the ZIP's directories.

A task writes its rows to packages of bounded size. A package is a ZIP file with two stored members: a WARC file, each
record a gzip member of its own, and a sorted index of JSON lines that gives every record's place in it. The reader
finds the end-of-directory record, follows the ZIP64 locator where there is one, parses the central directory, and takes
a member's place from its local header; nothing is extracted and no package is read as a whole. Index lines become rows,
so records are fetched by ranges in as many tasks as there are; neighbours are fetched together. An archive member
without an index is walked from one gzip member to the next.

Of rows with equal payloads of ``least_bytes`` or more, the one with the largest page_id is a response and the others
are revisits of it, without a payload; a null page_id is below all others, and of rows that repeat one, one is the
response. A counting Bloom filter finds payloads that may repeat, by their SHA-1: only those rows shuffle. A null html
is an empty payload, a null url a record without a target. An empty table makes no package. Columns other than the id,
url and html are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .shared import located, partitions, shared_dir, written

#: Fixed words of the formats.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
LONGEST_COMMENT = 65_535
ARCHIVES, INDEXES = "archive/", "indexes/"

#: A package is closed when it holds about so many bytes or so many records, whose index lines are held until then.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 100_000
#: Neighbouring records are fetched in reads of about so many bytes.
FETCH_BYTES = 4 << 20

ROWS = "page_id long, url string, payload binary, payload_bytes long, digest binary, mark string, refers_id long, refers_mark string"
PLACES = "package string, member string, at long, length long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_record string, payload binary"


# ---------------------------------------------------------------- which row is the response


def _repeating(bitmap, bits: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = repeats.maybe_repeated(bitmap.value, bits, *_halves(batch.column("digest"))) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "maybe"])

    return probe


def _halves(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first two 64-bit words of 20-byte digests."""
    raw = np.frombuffer(b"".join(d[:16] for d in digests.to_pylist()), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def fates(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page, as ROWS: revisits have no payload and name the page they refer to."""
    own = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("digest"))
    long_enough = own.filter(F.col("payload_bytes") >= least_bytes)
    bitmap, bits = repeats.build(long_enough.select("digest"), lambda b: _halves(b.column(0)), long_enough.count())
    probed = own.mapInArrow(_repeating(bitmap, bits), "page_id long, url string, payload binary, payload_bytes long, digest binary, maybe boolean")
    nobody = [F.lit(None).cast("long").alias("refers_id"), F.lit(None).cast("string").alias("refers_mark")]
    again = F.col("maybe") & (F.col("payload_bytes") >= least_bytes)
    single = probed.filter(~again).select("page_id", "url", "payload", "payload_bytes", "digest", F.lit("").alias("mark"), *nobody)
    held = written(probed.filter(again).drop("maybe").withColumn("row", F.monotonically_increasing_id()), "repeats")
    narrow = held.drop("payload")
    # the greatest stays: known ids before unknown ones, then the last row
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("best")
    best_of = written(narrow.groupBy("digest").agg(best).select("digest", F.col("best.page_id").alias("refers_id"), F.col("best.row").alias("best_row")), "responses")
    revisits = narrow.join(best_of, "digest").filter(F.col("row") != F.col("best_row")).select(
        "page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "digest", F.col("row").cast("string").alias("mark"), "refers_id", F.col("best_row").cast("string").alias("refers_mark")
    )
    stay = best_of.select(F.col("best_row").alias("row"))
    responses = held.join(stay, "row", "left_semi").select("page_id", "url", "payload", "payload_bytes", "digest", F.col("row").cast("string").alias("mark"), *nobody)
    return single.unionByName(responses).unionByName(revisits)


# ---------------------------------------------------------------- writing


def digest_name(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _visible(value: str) -> str:
    """A header's value: what is not visible ASCII is percent-encoded in UTF-8, and so is the percent sign before it."""
    return "".join(c if "!" <= c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _plain(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def _record_id(page_id: int | None, digest: str, mark: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{mark}>"


def record(row: dict) -> bytes:
    """One WARC record of a row of ``fates``, not compressed."""
    digest = digest_name(row["digest"])
    head = [("WARC-Type", "revisit" if row["payload"] is None else "response"), ("WARC-Record-ID", _record_id(row["page_id"], digest, row["mark"])), ("WARC-Date", DATE)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _visible(row["url"])))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if row["payload"] is None:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id(row["refers_id"], digest, row["refers_mark"]))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + (row["payload"] or b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _zipped(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Package:
    """A ZIP file that is written once, from front to end."""

    def __init__(self, where: fs.FileSystem, path: str, zip64: bool):
        self.path, self.zip64 = path, zip64
        self.stream = where.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Forward(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.name = ARCHIVES + "data.warc.gz"
        self.member = self.zip.open(self.name, "w", force_zip64=zip64)
        self.lines: list[str] = []
        self.size = 0

    def add(self, row: dict) -> None:
        data = _zipped(record(row))
        self.member.write(data)
        self.lines.append(json.dumps({"url": row["url"], "page_id": row["page_id"], "digest": digest_name(row["digest"]), "filename": self.name, "offset": self.size, "length": len(data)}))
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(INDEXES + "index.jsonl", "w", force_zip64=self.zip64) as index:
            index.write("".join(x + "\n" for x in sorted(self.lines)).encode())
        self.zip.close()
        self.stream.close()


class _Forward(io.RawIOBase):
    """What a ZIP writer needs of a stream that cannot go back."""

    def __init__(self, stream):
        self.stream, self.done = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        self.stream.write(data)
        self.done += len(data)
        return len(data)


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, package_records: int = PACKAGE_RECORDS, package_bytes: int = PACKAGE_BYTES, zip64: bool = True, **columns) -> DataFrame:
    """Writes the packages and returns the manifest: package, records, bytes.

    Each attempt of a task writes files of its own; the manifest names those of the attempts that ended.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = located(folder)
        where.create_dir(base, recursive=True)
        package = None

        def closed() -> pa.RecordBatch:
            package.close()
            return pa.RecordBatch.from_pydict({"package": [f"{folder.rstrip('/')}/{package.path.rpartition('/')[2]}"], "records": pa.array([len(package.lines)], pa.int64()), "bytes": pa.array([package.size], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                package = package or _Package(where, f"{base}/{uuid.uuid4().hex}.wacz", zip64)
                package.add(batch.slice(i, 1).to_pylist()[0])
                if len(package.lines) >= package_records or package.size >= package_bytes:
                    yield closed()
                    package = None
        if package:
            yield closed()

    rows = fates(pages, least_bytes, **columns)
    return written(rows.mapInArrow(store, "package string, records long, bytes long"), "manifest")


# ---------------------------------------------------------------- reading


class BadPackage(ValueError):
    pass


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    out = f.read(n)
    if len(out) != n:
        raise BadPackage(f"{n} bytes at {at} end early")
    return out


def directory(f, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, stored size, size, place of the local header) of every member, from the central directory."""
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = _range(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < END_SIZE or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # these bytes stand in a comment
    if at < 0:
        raise BadPackage("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= LOCATOR_SIZE and (loc := _range(f, end_at - LOCATOR_SIZE, LOCATOR_SIZE)).startswith(LOCATOR):
        end_at = struct.unpack_from("<Q", loc, 8)[0]
        wide = _range(f, end_at, END64_SIZE)
        if not wide.startswith(END64):
            raise BadPackage("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    elif start == 0xFFFFFFFF or length == 0xFFFFFFFF or count == 0xFFFF:
        raise BadPackage("no ZIP64 locator")
    raw, at, out = _range(f, start, length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise BadPackage("no central directory entry")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
        full, packed, local = _wide(extra, full, packed, local)
        out.append((name, method, packed, full, local))
        at += ENTRY_SIZE + n_name + n_extra + n_comment
    return out


def _wide(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int, int]:
    """The values of the ZIP64 extra field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            own, k, out = extra[at + 4 : at + 4 + n], 0, []
            for value in (full, packed, local):
                if value == 0xFFFFFFFF:
                    value = struct.unpack_from("<Q", own, k)[0]
                    k += 8
                out.append(value)
            return out[0], out[1], out[2]
        at += 4 + n
    return full, packed, local


def _data_at(f, local: int) -> int:
    head = _range(f, local, LOCAL_SIZE)
    if not head.startswith(LOCAL):
        raise BadPackage("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + LOCAL_SIZE + n_name + n_extra


def _walked(f, at: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(place, length) of each gzip member from ``at`` on."""
    begin = now = at
    inflate = zlib.decompressobj(31)
    while now < at + size:
        chunk = _range(f, now, min(step, at + size - now))
        now += len(chunk)
        while chunk:
            inflate.decompress(chunk)
            chunk = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield begin, now - len(chunk) - begin
                begin, inflate = now - len(chunk), zlib.decompressobj(31)
    if begin < now:
        raise BadPackage("the last record ends early")


def places(packages: DataFrame) -> DataFrame:
    """PLACES of every record in the packages (column ``package``): from the stored indexes, or by walking an archive that none covers."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("package").to_pylist():
                where, own = located(path)
                with where.open_input_file(own) as f:
                    found = {name: (method, packed, local) for name, method, packed, _, local in directory(f, f.size())}
                    starts = {}
                    for name, (method, packed, local) in found.items():
                        if name.startswith((ARCHIVES, INDEXES)) and not name.endswith("/"):
                            if method != zipfile.ZIP_STORED:
                                raise BadPackage(f"{name} is not stored")
                            starts[name] = _data_at(f, local), packed
                    rows, seen = [], set()
                    for name in (n for n in starts if n.startswith(INDEXES)):
                        for line in _range(f, *starts[name]).splitlines():
                            x = json.loads(line)
                            seen.add(x["filename"])
                            rows.append((x["filename"], starts[x["filename"]][0] + x["offset"], x["length"]))
                    for name in (n for n in starts if n.startswith(ARCHIVES) and n not in seen):
                        rows += [(name, a, n) for a, n in _walked(f, *starts[name])]
                rows.sort()
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "package": pa.array([path] * len(part)), "member": pa.array([r[0] for r in part], pa.string()), "at": pa.array([r[1] for r in part], pa.int64()), "length": pa.array([r[2] for r in part], pa.int64()),
                    })

    return packages.select("package").repartition(_spread(packages), "package").mapInArrow(look, PLACES)


def _spread(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, partitions(df.sparkSession))


def parse(data: bytes) -> dict:
    """One record, not compressed -> a row of RECORDS; a response's payload has to have its digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise BadPackage("no WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    inner, _, body = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in inner.decode("latin-1").split("\r\n")[1:])}
    digest, kind = h["warc-payload-digest"].partition(":")[2], h["warc-type"]
    if kind == "response" and digest_name(hashlib.sha1(body).digest()) != digest:
        raise BadPackage(f"{h['warc-record-id']}: payload and digest differ")

    def page(record_id: str | None) -> int | None:
        number = (record_id or "").removeprefix("<urn:page:").partition(":")[0]
        return int(number) if number.lstrip("-").isdigit() else None

    return {
        "page_id": page(h["warc-record-id"]), "url": _plain(h["warc-target-uri"]) if "warc-target-uri" in h else None, "record_type": kind,
        "payload_bytes": int(http["content-length"]) if "content-length" in http else len(body), "payload_digest": digest, "refers_to": page(h.get("warc-refers-to")),
        "record_id": h["warc-record-id"], "refers_to_record": h.get("warc-refers-to"), "payload": body if kind == "response" else None,
    }


def read(packages: DataFrame, payload: bool = True) -> DataFrame:
    """RECORDS of the packages, fetched by ranges; without ``payload`` that column is null."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary())])
        path, f = None, None
        for batch in batches:
            rows = sorted(batch.select(["package", "at", "length"]).to_pylist(), key=lambda r: (r["package"], r["at"]))
            i = 0
            while i < len(rows):
                j, end = i + 1, rows[i]["at"] + rows[i]["length"]
                while j < len(rows) and rows[j]["package"] == rows[i]["package"] and rows[j]["at"] == end and end - rows[i]["at"] < FETCH_BYTES:
                    end += rows[j]["length"]
                    j += 1
                if rows[i]["package"] != path:
                    if f:
                        f.close()
                    path = rows[i]["package"]
                    where, own = located(path)
                    f = where.open_input_file(own)
                raw, made = _range(f, rows[i]["at"], end - rows[i]["at"]), []
                for r in rows[i:j]:
                    a = r["at"] - rows[i]["at"]
                    made.append(parse(zlib.decompress(raw[a : a + r["length"]], 31)))
                    if not payload:
                        made[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                i = j
        if f:
            f.close()

    block = F.floor(F.col("at") / F.lit(FETCH_BYTES))
    return places(packages).repartition(_spread(packages), "package", block).mapInArrow(fetch, RECORDS)
