"""WARC archives compressed with Zstandard and a dictionary: one frame per record after a leading dictionary frame.

An archive is a row (archive, content) of bounded size, or the same bytes as a `.warc.zst` file.  Its first frame is a
skippable one with the dictionary (plain, or a Zstandard frame itself); every further frame is decoded alone and must be
exactly one record, whose version line, headers, block length, digests, HTTP head and closing line ends are checked.

Of records with equal payloads of some size the one with the largest id is a response; the others become revisits, which
keep the HTTP head with the payload's length but not the payload, and name the response by its record id and URL.  The reader
takes archives of other writers too: other kinds of records, heads without a length, and digests in base32.  Rows that repeat the largest id are all responses, as
are all rows of a group without any id.  A null payload is an empty one; a null url or id leaves its header out.  Further
columns are ignored; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Magic numbers of the formats, little-endian.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Payload bytes of an archive, records of an archive, and payloads and bytes that a dictionary is trained from.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8_000_000, 4_000
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 200, 1_000_000, 16_384, 3
#: Payloads from this size on are written once.
REVISIT_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Other profiles of revisits, and kinds of records that the reader passes over unless they are asked for.
PROFILES = ("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "http://netpreserve.org/warc/1.1/revisit/server-not-modified", "http://netpreserve.org/warc/1.0/revisit/server-not-modified")
OTHERS = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")
#: Slots that payloads are folded to: the largest number of rows (8 bytes each) that is broadcast.
SLOTS = 1 << 20
READ_SCHEMA = "archive string, record long, record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class InvalidArchive(ValueError):
    """Bytes that are not an archive of this kind, or a record whose headers or lengths do not agree."""


# ---------------------------------------------------------------------------------------------------------------------
# writing


def urn(page_id: int | None, url: str | None, digest: str) -> str:
    """A record's id: the same on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def record_bytes(row: dict) -> bytes:
    """One WARC record, uncompressed."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    response = row["record_type"] == "response"
    block = head + payload if response else head
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", urn(row["page_id"], row["url"], row["payload_digest"])), ("WARC-Date", DATE)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")))
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", row["page_id"]))
    if not response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(row["refers_to"], row["refers_to_url"], row["payload_digest"])), ("X-Refers-To-Page-ID", row["refers_to"])]
        if row["refers_to_url"] is not None:
            fields.append(("WARC-Refers-To-Target-URI", row["refers_to_url"].replace("\r", "%0D").replace("\n", "%0A")))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary trained from the first records; none (empty) if they are too few or too short."""
    sample = [r for r, upto in zip(records[:SAMPLE_RECORDS], itertools.accumulate(map(len, records)), strict=False) if upto <= SAMPLE_BYTES]
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of these records, with a dictionary of its own."""
    words = dictionary_of(records)
    packed = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(words) if words else b""
    out = [DICTIONARY_FRAME.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    own = zstandard.ZstdCompressionDict(words) if words else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True, write_content_size=True)
    return b"".join([*out, *map(compressor.compress, records)])


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Each page as a record to write; pages with the payload of another become revisits.

    Groups are counted with partial sums and only groups of two or more are joined back, so a payload that very many pages
    share is one row on one side of a join that Spark can split on the other.  A bounded table of slots keeps the payloads of
    pages that share theirs with nobody out of that join.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"), body.alias("payload"))
    narrow = rows.where(F.col("payload_bytes") >= least).groupBy("payload_bytes", "payload_digest").agg(F.max_by(F.struct("page_id", "url"), "page_id").alias("first"), F.count("*").alias("n"))
    shared = materialize(narrow.where("n > 1 AND first IS NOT NULL").select("payload_bytes", "payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "payloads")
    slot = F.pmod(F.xxhash64("payload_bytes", "payload_digest"), F.lit(SLOTS)).alias("slot")
    taken = materialize(shared.select(slot).distinct(), "slots")
    marked = rows.withColumn("slot", slot)
    lone = marked.join(F.broadcast(taken), "slot", "left_anti").drop("slot").withColumns({"first_id": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    some = marked.join(F.broadcast(taken), "slot", "left_semi").drop("slot").join(shared, ["payload_bytes", "payload_digest"], "left")
    joined = lone.unionByName(some)
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame) -> DataFrame:
    """(archive, content): archives of bounded size, each from consecutive records of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            content = archive_bytes(held)
            name = f"{hashlib.sha1(content).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                record = record_bytes(row)
                if held and (size + len(record) > ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS):
                    yield close()
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield close()

    bounded_batches(records.sparkSession, 500)
    return records.mapInArrow(run, "archive string, content binary")


def save_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder that all executors share; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                own = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(row["content"])
                fs.move(own, f"{base}/{row['archive']}")
            yield batch.select(["archive"])

    archives.mapInArrow(run, "archive string").count()


# ---------------------------------------------------------------------------------------------------------------------
# reading


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its header and block sizes."""
    if len(data) < at + 6 or int.from_bytes(data[at : at + 4], "little") != FRAME:
        raise InvalidArchive(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    content = (1 if single else 0, 2, 4, 8)[flags >> 6]
    pos = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        if pos + 3 > len(data):
            raise InvalidArchive(f"the frame at byte {at} is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        if kind == 3:
            raise InvalidArchive(f"the frame at byte {at} has a reserved block")
        pos += 3 + (1 if kind == 1 else size)
        if block & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise InvalidArchive(f"the frame at byte {at} is cut off")
    return pos


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records begin."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        raise InvalidArchive("no dictionary frame at the start")
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise InvalidArchive("the dictionary frame is cut off")
    words = bytes(data[8:end])
    if words[:4] == FRAME.to_bytes(4, "little"):
        words = zstandard.ZstdDecompressor().decompress(words)
    if not words:
        return None, end
    if words[:4] != DICTIONARY.to_bytes(4, "little"):
        raise InvalidArchive("the dictionary has no magic number")
    return zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_FULLDICT), end


def headers_of(head: bytes, first: str) -> dict[str, str]:
    """Named fields below a first line; names in lower case."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise InvalidArchive(f"no {first} line but {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise InvalidArchive(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes) -> dict:
    """A checked record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise InvalidArchive("the headers have no end")
    fields = headers_of(head, "WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise InvalidArchive(f"no {name}")
    kind = fields["warc-type"]
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise InvalidArchive("the block's length is not the one its header names")
    block = rest[:-4]
    digest = fields.get("warc-block-digest")
    if digest and digest != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise InvalidArchive("the block's digest differs")
    if kind in OTHERS:
        return {"record_id": fields["warc-record-id"], "record_type": kind, "page_id": None, "url": fields.get("warc-target-uri"), "payload_bytes": len(block), "payload_digest": hashlib.sha1(block).hexdigest(), "refers_to": None, "payload": block}
    if kind not in ("response", "revisit"):
        raise InvalidArchive(f"unexpected record type {kind[:40]!r}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise InvalidArchive("the HTTP head has no end")
    inner = headers_of(http, "HTTP/")
    length = inner.get("content-length", str(len(payload)) if kind == "response" else "0")  # a response may go without
    if not length.isdigit():
        raise InvalidArchive("the HTTP head's length is no number")
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    own = hashlib.sha1(payload)
    if kind == "response" and (int(length) != len(payload) or named not in ("", own.hexdigest(), base64.b32encode(own.digest()).decode())):
        raise InvalidArchive("the payload's length or digest differs")
    if kind == "response":
        named = own.hexdigest()
    if kind == "revisit" and (payload or not {"x-refers-to-page-id", "warc-refers-to", "warc-refers-to-target-uri"} & set(fields) or fields.get("warc-profile") not in (PROFILE, *PROFILES)):
        raise InvalidArchive("a revisit with a payload, without a target or with another profile")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"record_id": fields["warc-record-id"], "record_type": kind, "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": int(length), "payload_digest": named, "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None}


def read_archive(content: bytes, others: bool = False, errors: bool = False) -> Iterator[dict]:
    """The records of one archive, one frame at a time; records that are neither responses nor revisits only if asked for.

    A record that can't be read is an error, or, if asked for, a dict with only `error`; what a frame that has no end hides stays unread.
    """
    data = memoryview(content)
    words, at = load_dictionary(data)
    decoder = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except InvalidArchive as problem:
            if not errors:
                raise
            yield {"error": str(problem)}
            return
        try:
            record = parse_record(decoder.decompress(data[at:end], allow_extra_data=False))
            if others or record["record_type"] not in OTHERS:
                yield record
        except (InvalidArchive, UnicodeDecodeError, zstandard.ZstdError) as problem:
            if not errors:
                raise InvalidArchive(f"the frame at byte {at} can't be read: {problem}") from problem
            yield {"error": f"the frame at byte {at} can't be read: {problem}"}
        at = end


def read_archives(archives: DataFrame, payload: bool = True, others: bool = False, errors: bool = False) -> DataFrame:
    """All responses and revisits of archives, a row each; `archives` has (archive, content), or (path, content) of a binaryFile scan.

    With `others`, records of the other kinds are rows too, their block as the payload.  With `errors`, a record that can't be read is a
    row that says why in the last column, instead of failing the job.
    """
    name = "archive" if "archive" in archives.columns else "path"
    schema = (READ_SCHEMA if payload else READ_SCHEMA.removesuffix(", payload binary")) + (", error string" if errors else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for n, row in enumerate(read_archive(content.as_buffer(), others, errors)):
                    held.append({c: (row | {"archive": archive, "record": n}).get(c) for c in columns})
                    size += len(row.get("payload") or b"") if payload else 0
                    if size > ARCHIVE_BYTES or len(held) >= 2_000:
                        yield pa.RecordBatch.from_pylist(held, target)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, target)

    return archives.select(name, "content").mapInArrow(run, schema)
