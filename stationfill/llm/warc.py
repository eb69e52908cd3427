"""A content-addressed archive of web records.

An archive is a folder with two tables. ``payloads`` holds the bytes of every different payload
once, compressed, under their SHA-256; ``records`` holds a row per record: its WARC header and
the start of its block (the HTTP header) byte for byte, and the digest of its payload. Joining the
two gives the original records back. Digests are verified twice: payloads that share a SHA-256
must share length and SHA-1 when they are stored, and bytes are hashed again when they are read.

Pages are written as one record each. Of equal payloads the page with the smallest id is a
response, the others are revisits that refer to it; payloads shorter than ``least_bytes`` are
responses always. Real WARC files are written and read as well (``write_files``, ``read_files``,
``ingest``), plain or gzip.

Only digests are shuffled to find equal payloads. A payload with very many records is sent to
several joins, its records dealt among them, so no digest is one task's work.

Null html is an empty payload; a null id comes after all others and stays null; a null address
has no Target-URI. Rows equal in id, address and html are records of their own, numbered. Records
that do not parse are an error that names the place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import bounded_batches

#: Pages have no time of capture; their records carry this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one payload that meet in one join task, and the most parts a payload is sent to.
RECORDS_PER_PART, PARTS = 1024, 64
#: Parts that a digest's records are dealt to when they learn which of them is the response.
SALTS = 16
#: Records of one WARC file.
RECORDS_PER_FILE = 10_000
_END = b"\r\n\r\n"
#: Rows that are rebuilt at a time, for few payloads at once outside Arrow.
_SLICE = 64


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_header(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record_id(page_id: int | None, url: str | None, sha256: bytes, copy: int) -> str:
    tail = hashlib.sha256((url or "").encode() + b"\n" + sha256 + (b"-" if url is None else b"")).hexdigest()[:24]
    return f"<urn:x-page:{'' if page_id is None else page_id}:{copy}:{tail}>"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return int(page) if page else None


def _address(url: str) -> str:
    # What could end a header line, or is no ASCII, is percent-encoded; all else is as given.
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def warc_header(page_id, url, sha256, sha1, n, copy, refers: tuple | None) -> bytes:
    """Header of a page's record with the empty line that ends it; ``refers``: page id, url and copy of the response."""
    front = http_header(n)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, sha256, copy)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_address(url)}"]),
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(front) + (0 if refers else n)}",
    ]
    if refers:
        page, address, number = refers
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(page, address, sha256, number)}", f"WARC-Refers-To-Date: {DATE}"]
        lines += [] if address is None else [f"WARC-Refers-To-Target-URI: {_address(address)}"]
    return "\r\n".join(lines).encode() + _END


def fields(header: bytes) -> dict[str, str]:
    """Names (lower case) and values of a WARC header; folded lines are joined."""
    found: dict[str, str] = {}
    name = None
    for line in header.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            left, _, right = line.partition(b":")
            name = left.strip().lower().decode("utf-8", "replace")
            found[name] = right.strip().decode("utf-8", "replace")
    return found


def split_record(record: bytes) -> tuple[bytes, bytes]:
    """Header (with its empty line) and block of a record."""
    cut = record.index(_END) + len(_END)
    n = int(fields(record[:cut])["content-length"])
    if len(record) != cut + n + len(_END) or not record.endswith(_END):
        raise ValueError(f"a record of {len(record)} bytes does not end where its Content-Length of {n} says")
    return record[:cut], record[cut : cut + n]


def split_block(header: bytes, block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload of a block; blocks that are no HTTP message are payload as a whole."""
    http = fields(header).get("content-type", "").replace(" ", "").lower().startswith("application/http")
    cut = block.find(_END) if http else -1
    return (b"", block) if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def parse(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or gzip (in members or whole), byte for byte."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            if not member.eof:
                raise ValueError("a gzip member is cut off")
            data = member.unused_data.lstrip(b"\0")
        data = b"".join(parts)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        cut = data.find(_END, at)
        if not data.startswith(b"WARC/", at) or cut < 0:
            raise ValueError(f"no WARC record at byte {at}")
        n = int(fields(data[at:cut])["content-length"])
        end = cut + 4 + n + 4
        if data[end - 4 : end] != _END:
            raise ValueError(f"the record at byte {at} is cut off")
        yield data[at:end]
        at = end


def captured(pages: DataFrame, with_payload: bool) -> DataFrame:
    """page_id, url, sha256, sha1 and n of every page's html in UTF-8; on request the bytes, compressed."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [x.as_buffer().to_pybytes() for x in batch.column("data")]
            columns = {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "sha256": pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                "sha1": pa.array(list(map(base32_sha1, data)), pa.string()),
                "n": pa.array(list(map(len, data)), pa.int64()),
            }
            if with_payload:
                columns["packed"] = pa.array(list(map(packer.compress, data)), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    data = F.coalesce("html", F.lit("")).cast("binary").alias("data")
    schema = "page_id long, url string, sha256 binary, sha1 string, n long" + (", packed binary" if with_payload else "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", data).mapInArrow(run, schema)


def _parts(references: Column) -> Column:
    return F.least(F.lit(PARTS), 1 + F.floor(references / RECORDS_PER_PART)).cast("int")


def payload_table(rows: DataFrame) -> DataFrame:
    """A row per different payload: sha256, n, parts, packed. ``rows`` has sha256, sha1, n, packed.

    Payloads with one SHA-256 but another SHA-1 or length are an error.
    """
    proof = F.struct("n", "sha1")
    found = rows.groupBy("sha256").agg(
        F.any_value("packed").alias("packed"),
        F.min(proof).alias("least"),
        F.max(proof).alias("most"),
        F.count(F.lit(1)).alias("references"),
    )
    clash = F.raise_error(F.concat(F.lit("different payloads with SHA-256 "), F.hex("sha256"))).cast("binary")
    return found.select(
        "sha256",
        F.col("least.n").alias("n"),
        _parts(F.col("references")).alias("parts"),
        F.when(F.col("least") == F.col("most"), F.col("packed")).otherwise(clash).alias("packed"),
    )


def record_table(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row per page: sha256, parts, part, header, front."""
    same = ["page_id", "url", "sha256", "sha1", "n"]
    keys = captured(pages, False).groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    shared = keys.groupBy("sha256").agg(F.min(order).alias("first"), F.sum("copies").alias("references")).where("references > 1")
    dealt = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    known = salted.join(dealt, ["sha256", "salt"], "left").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1)
    revisit = F.col("first").isNotNull() & ~first & (F.col("n") >= least_bytes)
    parts = _parts(F.coalesce("references", F.lit(1)))
    rows = known.select(
        *same, "copy", revisit.alias("revisit"),
        F.col("first.page_id").alias("to_page"), F.col("first.url").alias("to_url"),
        parts.alias("parts"), F.pmod(F.xxhash64("page_id", "url", "copy"), parts).cast("int").alias("part"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, fronts = [], []
            for r in batch.to_pylist():
                refers = (r["to_page"], r["to_url"], 1) if r["revisit"] else None
                headers.append(warc_header(*(r[c] for c in same), r["copy"], refers))
                fronts.append(http_header(r["n"]))
            texts = [pa.array(headers, pa.binary()), pa.array(fronts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sha256", "part")), *texts], ["sha256", "part", "header", "front"])

    return rows.mapInArrow(run, "sha256 binary, part int, header binary, front binary")


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """A record per page (page_id, url, html), as an archive in ``folder``."""
    payload_table(captured(pages, True)).write.parquet(f"{folder}/payloads")
    record_table(pages, least_bytes).write.parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """record (the whole record, byte for byte) and payload (of revisits, what they refer to) of every record."""
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads")
    bounded_batches(spark)
    sent = payloads.select("sha256", "n", "packed", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    both = records.join(sent, ["sha256", "part"], "left").select("sha256", "n", "packed", "header", "front")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in (batch.slice(i, _SLICE) for i in range(0, batch.num_rows, _SLICE)):
                rebuilt, payloads = [], []
                for r in part.to_pylist():
                    if r["packed"] is None:
                        raise ValueError(f"no payload is stored under {r['sha256'].hex()}")
                    data = opener.decompress(r["packed"], max_output_size=max(r["n"], 1))
                    if hashlib.sha256(data).digest() != r["sha256"]:
                        raise ValueError(f"the payload stored under {r['sha256'].hex()} is damaged")
                    n = int(fields(r["header"])["content-length"])
                    block = r["front"] if n == len(r["front"]) else r["front"] + data
                    rebuilt.append(r["header"] + block + _END)
                    payloads.append(data)
                yield pa.RecordBatch.from_arrays([pa.array(rebuilt, pa.binary()), pa.array(payloads, pa.binary())], ["record", "payload"])

    return both.mapInArrow(run, "record binary, payload binary")


def described(rebuilt: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read from records and their payloads.

    A record whose header names another payload digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, payload in zip(batch.column("record"), batch.column("payload")):
                payload = payload.as_buffer().to_pybytes()
                header, block = split_record(record.as_buffer().to_pybytes())
                said, digest = fields(header), base32_sha1(payload)
                own = split_block(header, block)[1]
                if said["warc-payload-digest"] != f"sha1:{digest}" or (said["warc-type"] == "response" and own != payload):
                    raise ValueError(f"{said['warc-record-id']}: payload and header disagree")
                to = said.get("warc-refers-to")
                rows.append((page_of(said["warc-record-id"]), len(payload), digest, said["warc-type"], to and page_of(to)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else ([] for _ in types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return rebuilt.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def write_files(records: DataFrame, folder: str, compressed: bool = True) -> None:
    """The ``record`` column as WARC files of at most ``RECORDS_PER_FILE`` records, by Spark's own text writer.

    Every record ends with two line ends, which is what separates the writer's lines.
    """
    bare = F.expr("substring(record, 1, length(record) - 4)").cast("string").alias("value")
    out = records.select(bare).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE)
    out.option("compression", "gzip" if compressed else "none").text(folder)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every record of WARC files: file and record. A file is read by one task and must fit its memory."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                kept, size = [], 0
                try:
                    for record in parse(content.as_buffer().to_pybytes()):
                        kept.append(record)
                        size += len(record)
                        if size > 16 << 20:
                            yield _named(path.as_py(), kept)
                            kept, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                yield _named(path.as_py(), kept)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record binary")


def _named(path: str, records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(records), pa.string()), pa.array(records, pa.binary())], ["file", "record"])


def ingest(records: DataFrame, folder: str) -> None:
    """Any WARC records (column ``record``) as an archive in ``folder``; ``read_archive`` gives each back byte for byte."""

    def split(with_payload: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            packer = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                headers = [split_record(x.as_buffer().to_pybytes()) for x in batch.column("record")]
                blocks = [split_block(*x) for x in headers]
                data = [x[1] for x in blocks]
                columns = {"sha256": pa.array([hashlib.sha256(x).digest() for x in data], pa.binary())}
                if with_payload:
                    columns["sha1"] = pa.array(list(map(base32_sha1, data)), pa.string())
                    columns["n"] = pa.array(list(map(len, data)), pa.int64())
                    columns["packed"] = pa.array(list(map(packer.compress, data)), pa.binary())
                else:
                    columns["header"] = pa.array([x[0] for x in headers], pa.binary())
                    columns["front"] = pa.array([x[0] for x in blocks], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

        return run

    bounded_batches(records.sparkSession)
    payload_table(records.select("record").mapInArrow(split(True), "sha256 binary, sha1 string, n long, packed binary")).write.parquet(f"{folder}/payloads")
    rows = records.select("record").mapInArrow(split(False), "sha256 binary, header binary, front binary")
    # Only payloads with very many records have several parts; without a match there is one.
    stored = records.sparkSession.read.parquet(f"{folder}/payloads").where("parts > 1").select("sha256", "parts")
    dealt = stored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.shiftright(F.xxhash64("header"), 8), parts).cast("int").alias("part")
    known = salted.join(dealt, ["sha256", "salt"], "left").select("sha256", part, "header", "front")
    known.write.parquet(f"{folder}/records")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared place that checkpoints use."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/archive-{uuid.uuid4().hex}"


def digests(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as an archive in the shared folder and read back from it."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    write_archive(pages, folder, least_bytes)
    return described(read_archive(spark, folder))
