"""WARC archives in Zstandard: one frame per record behind a skippable frame that holds the dictionary.

Writing: each task writes archives of a bounded size to the shared folder and
returns their names; the list is stored, so archives of a task attempt that was
lost are never read. Reading: the dictionary comes from the leading skippable
frame, then every frame is decoded by itself and its record is checked (version
line, named headers, Content-Length against the block, digest of the payload).

Records of equal payloads of at least ``least`` bytes are written once: the row
with the largest page_id is the response, the others are revisits that refer to
it. Rows with equal page_id and payload share their role. A null page_id is
never the largest unless all are null. Null html is an empty payload.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.common import stored, utf8
from scorelab.session import opened_store, scratch_path

#: Fixed by the formats: the dictionary's skippable frame, zstd's frame, a zstd dictionary.
DICTIONARY_MAGIC, FRAME_MAGIC, TRAINED_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages that the dictionary is trained on (picked by a hash of their id), and the largest page taken.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 32_768
ARCHIVE_BYTES = 16_000_000
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload`` with ``digest``, ``record_type`` and ``refers_to``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = rows.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(
        F.max("page_id").alias("kept"), F.count("*").alias("copies")
    )
    shared = stored(groups.where("copies > 1").select("digest", "n_bytes", "kept"), "payload-groups")
    # 40-character digest, two numbers: 200,000 rows are below 32 MB
    small = shared.limit(200_001).count() <= 200_000
    joined = rows.join(F.broadcast(shared) if small else shared, ["digest", "n_bytes"], "left")
    visit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.withColumns(
        {"record_type": F.when(visit, "revisit").otherwise("response"), "refers_to": F.when(visit, F.col("kept"))}
    ).drop("kept")


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary for these pages, trained on a bounded sample; empty if there is too little to learn from."""
    share = F.pmod(F.xxhash64("page_id"), F.lit(max(1, pages.count()))) < 2 * SAMPLE_ROWS
    some = pages.where(share & (F.octet_length("html") <= SAMPLE_BYTES)).select("html").limit(SAMPLE_ROWS)
    texts = [utf8(r[0]) for r in some.collect()]
    texts = [t for t in texts if len(t) >= 8]
    if len(texts) < 20:
        return b""
    try:
        return zstandard.train_dictionary(min(65_536, max(4096, sum(map(len, texts)) // 50)), texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _line(value: str) -> str:
    """A header value on one line: blanks and control characters are percent-encoded."""
    return "".join(c if 0x20 < ord(c) and ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record. A revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",  # the pages have no date; a fixed one keeps reruns equal
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _line(url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def opening(trained: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained if trained else b""


def write_archives(rows: DataFrame, folder: str, trained: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``roles()`` rows as ``*.warc.zst`` below ``folder``; the stored list of names, one row per archive."""
    names = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened_store(folder)
        store.create_dir(root, recursive=True)
        press = zstandard.ZstdCompressor(
            level=3, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None
        )
        frames, size, count = [opening(trained)], 0, 0

        def close() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.warc.zst"  # each attempt writes names of its own
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["name", "records"])

        for batch in batches:
            for row in zip(*[batch.column(n) for n in names], strict=True):
                frame = press.compress(record(*[v.as_py() for v in row]))
                frames.append(frame)
                size, count = size + len(frame), count + 1
                if size >= archive_bytes:
                    yield close()
                    frames, size, count = [opening(trained)], 0, 0
        if count:
            yield close()

    return stored(rows.select(*names).mapInArrow(written, "name string, records long"), "archives")


def frames(archive: bytes) -> Iterator[bytes]:
    """Decoded records of one archive, frame by frame."""
    view, at, trained = memoryview(archive), 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        if 8 + size > len(archive):
            raise ValueError("the dictionary frame is cut off")
        trained, at = bytes(view[8 : 8 + size]), 8 + size
        if struct.unpack_from("<I", trained)[0] == FRAME_MAGIC:  # the dictionary itself may be compressed
            trained = zstandard.ZstdDecompressor().decompress(trained)
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(archive):
        magic = struct.unpack_from("<I", archive, at)[0] if at + 8 <= len(archive) else None
        if magic is not None and magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts, to = reader.decompressobj(), [], at
        while not one.eof:  # in steps, as what lies behind the frame is copied
            if to >= len(archive):
                raise ValueError(f"the frame at byte {at} is cut off")
            parts.append(one.decompress(view[to : to + 16_384]))
            to = min(to + 16_384, len(archive))
        yield b"".join(parts)
        at = to - len(one.unused_data)


def parse(raw: bytes) -> tuple:
    """``page_id, url, payload_bytes, digest, type, refers_to, payload`` of a record; raises if it is malformed."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    named = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a header line without a name: {line[:80]!r}")
        named[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in named:
            raise ValueError(f"the record has no {name}")
    size = int(named["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's length")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    sizes = [line.split(b":", 1)[1] for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise ValueError("the block has no HTTP Content-Length")
    digest = base64.b32decode(named["warc-payload-digest"].partition(":")[2]).hex()
    if named["warc-type"] == "response":
        import hashlib

        if len(payload) != int(sizes[0]) or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload does not have its stated length and digest")
    number = lambda name: (lambda v: int(v) if v else None)(named[name].removeprefix("<urn:page:").removesuffix(">"))
    refers = number("warc-refers-to") if "warc-refers-to" in named else None
    return number("warc-record-id"), named.get("warc-target-uri"), int(sizes[0]), digest, named["warc-type"], refers, payload


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in the list (column ``name``) below ``folder``."""
    spark = archives.sparkSession
    names = READ.split(", ")
    schema = READ if payloads else ", ".join(names[:-1])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        wide = len(types) if payloads else len(types) - 1
        columns = [n.split(" ")[0] for n in names[:wide]]
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for raw in frames(archive.as_py()):
                    rows.append(parse(raw)[:wide])
                    held += len(raw) if payloads else 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], columns)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], columns)

    if archives.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    listed = files.withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).join(archives.select("name"), "name", "left_semi")
    return listed.select("content").mapInArrow(decoded, schema)


def round_trip(pages: DataFrame, payloads: bool = True, least: int = 1000) -> DataFrame:
    """Write all pages as archives below the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(roles(pages, least), folder, dictionary(pages))
    return read_archives(archives, folder, payloads)
