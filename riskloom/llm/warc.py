"""WARC archives, Zstandard-compressed with a dictionary: one frame a record, the dictionary in front.

Pages are dealt to archives; each archive trains its dictionary on its own records, holds it in a
leading skippable frame (magic 0x184D2A5D), and compresses every record as a frame of its own. Of the
pages with equal payloads of at least ``LEAST`` bytes, the one with the largest page_id is a response
and the others are revisits that name it; smaller payloads are all responses. ``write_archives`` tells the
size of each archive's dictionary and whether it was trained or is the records' beginnings. Reading takes time in proportion to the archive.

Null html is an empty payload, a null url an empty URI. A null page_id is smaller than all others.
Rows that repeat a page_id and its payload are all responses if that page_id is the largest. An empty
table writes no archive. Other columns are ignored. Archives are written under names of their own and
listed by the rows that the writing tasks return, so what an ended attempt has left is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import materialize, new_folder, read_file, table, write_file

LEAST, ARCHIVE, DICTIONARY, PIECE, LEVEL = 1000, 24 << 20, 64 << 10, 16 << 10, 3
#: Parts of a group of equal payloads, so that a large one is not one task's.
SALTS = 16
MAGIC, DATE = 0x184D2A5D, "2024-01-01T00:00:00Z"
#: Bytes that a reader takes of a record at a time; how a trained dictionary begins.
STEP, TRAINED = 4096, b"\x37\xa4\x30\xec"
INDEX = "archive string, records long, bytes long, dictionary_bytes long, trained boolean"
READ = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _id(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str):
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name in ("", "null") else int(name)


def record(page, url: str, digest: str, refers, payload: bytes) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join(url.split()), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers)}"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from pieces of all the records, whole ones of long records too.

    Where the trainer finds too little in them, the records' own beginnings are the dictionary, as raw content.
    """
    total = sum(map(len, records))
    size, piece = min(DICTIONARY, max(256, total // 20)), max(64, min(PIECE, total // 100))
    try:
        return zstandard.train_dictionary(size, [r[i : i + piece] for r in records for i in range(0, len(r), piece)], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: max(16, size // len(records))] for r in records)[:size]


def archive(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame, then a frame for each record."""
    raw = dictionary(records)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(press.compress, records)])


def read_archive(data: bytes):
    """(headers, block) of each record, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    raw = data[8 : 8 + size]
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest, at = memoryview(data), 8 + size
    while at < len(data):
        one, parts = opener.decompressobj(), []
        while not one.eof:  # by small steps: what a step takes beyond the frame's end is given back
            step = rest[at : at + STEP]
            if not step:
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, size: int = ARCHIVE) -> DataFrame:
    """Write ``pages(page_id, url, html, digest, refers_to)``; the rows list the archives that count."""

    def task(batches):
        def end(records):
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            write_file(path, data)
            return pa.RecordBatch.from_pydict({"archive": [path], "records": [len(records)], "bytes": [len(data)], "dictionary_bytes": [struct.unpack_from("<I", data, 4)[0]], "trained": [data[8:12] == TRAINED]})

        held, total = [], 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for page, url, digest, refers, html in zip(*cols, b.column("html").cast(pa.binary()).to_pylist()):
                held.append(record(page, url or "", digest, refers, html or b""))
                total += len(held[-1])
                if total >= size:
                    yield end(held)
                    held, total = [], 0
        if held:
            yield end(held)

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(task, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """The records of the archives that ``index`` lists; a response whose payload doesn't fit its digest is an error."""

    def task(batches):
        for b in batches:
            for path in b.column("archive").to_pylist():
                rows = []
                for head, block in read_archive(read_file(path)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.decode().rpartition("Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].partition(":")[2]
                    if head["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], length, digest, head["WARC-Type"], refers, path))
                names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    archives = index.count()  # an archive to a task while there are not thousands of them, then some to each
    return index.repartition(max(1, min(4 * archives, 4096), archives // 8), "archive").mapInArrow(task, READ)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to. Payloads are equal by SHA-1, xxHash64 and length; only those that occur twice or more are joined."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html).alias("digest"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= least, F.concat_ws(":", "digest", F.hex(F.xxhash64("html")), F.octet_length("html"))))
    large = rows.where("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    shared = large.where("n > 1").select(F.col("same").alias("of"), "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    met = rows.join(shared, (F.col("same") == F.col("of")) & (part == F.col("salt")), "left")
    return met.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first")).alias("refers_to"))


def op4_warc(spark, sf_dir):
    index = materialize(write_archives(with_revisits(table(spark, sf_dir, "pages")), new_folder(spark, "warc")), "warc-index")
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as payload_digest from p),
g as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as top from d)
select page_id, payload_bytes, payload_digest, case when page_id < top then 'revisit' else 'response' end as record_type,
  case when page_id < top then top end as refers_to from g"""
QUERIES = {"op4_warc": op4_warc}
SQL = {"op4_warc": _SQL}
