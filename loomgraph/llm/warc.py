"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame that holds the dictionary, then has one frame for each record; it ends when it has `ARCHIVE_BYTES`
or `ARCHIVE_RECORDS`, so only a record that is larger by itself makes a larger one. Spark's text
writer makes the files, so they appear in any store Spark can write and only when a task commits: a row is an archive's
bytes, and the line separator is an empty skippable frame, which readers of the format pass over.

Of records with equal payloads, the one with the largest page_id is a response, the others are revisits that name it
and carry no payload. If several rows have that page_id, one with the smallest url (null last) is the response. Payloads under
`min_bytes` are all responses. A null html is an empty payload; a null page_id
sorts first and is named by an empty string: nothing can refer to it, so where no row of a payload has a page_id all are responses. The reader checks version, header lines, types, content lengths, the frame's end, the
payload's length and its digest, and fails on the first record that is wrong.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# Fixed values of the format: the dictionary's skippable frame, and an empty skippable frame.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\0\0\0\0"
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bounds of what the dictionary is trained on, and its size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 65_536
LEVEL = 3
#: An archive's size: a writer's and a reader's task hold one at a time.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32 << 20, 20_000


class WarcError(ValueError):
    """A record or archive that isn't as it must be."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def payload_digest(html: Column) -> Column:
    """SHA-1 of the payload as bare upper-case base32: each 5 hex digits are 4 letters."""
    hexed = F.sha1(F.coalesce(html, F.lit("")).cast("binary"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def group(i: Column) -> Column:
        bits = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(letters, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the first bytes of SAMPLE_PAGES pages, chosen by a hash of their ids and addresses; empty if they are too few."""
    import zstandard

    rows = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "url").alias("h"), "html")
    last = rows.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    # Only rows up to the last hash of the sample send their first bytes to the driver.
    chosen = rows.where(F.col("h") <= F.lit(last)).select("h", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    samples = [r.html.encode("utf-8") for r in chosen.orderBy("h", "html").limit(SAMPLE_PAGES).collect()] if last is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record_bytes(page_id, url, payload: bytes, digested: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit of the page `refers_to`."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digested}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The checked record in one frame's bytes."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or version != VERSION:
        raise WarcError(f"no {VERSION.decode()} header: {data[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.decode("utf-8").partition(":")
        if not colon or not key or key != key.strip() or key.lower() in fields:
            raise WarcError(f"bad header line {line!r}")
        fields[key.lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-payload-length"):
        if needed not in fields:
            raise WarcError(f"{needed} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"content length {fields['content-length']} doesn't fit a block of {len(rest) - 4} bytes")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/1.1 "):
        raise WarcError("the block is no HTTP response")
    kind, digested = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    page, refers = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
    if kind == "response":
        if digest(payload) != digested or str(len(payload)) != fields["warc-payload-length"]:
            raise WarcError(f"the payload of {page} isn't what its digest and length say")
    elif kind != "revisit" or payload or not refers:
        raise WarcError(f"a {kind} record that can't be")
    return {
        "page_id": int(page) if page else None, "url": fields.get("warc-target-uri", ""), "record_type": kind, "payload": payload if kind == "response" else None,
        "payload_bytes": int(fields["warc-payload-length"]), "payload_digest": digested, "refers_to": int(refers) if refers else None,
    }


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, frame by frame."""
    import zstandard

    def skippable(at: int) -> int | None:
        """The end of the skippable frame that starts here."""
        if len(content) < at + 8 or content[at + 1 : at + 4] != b"\x2a\x4d\x18" or content[at] >> 4 != 5:
            return None
        end = at + 8 + struct.unpack_from("<I", content, at + 4)[0]
        if end > len(content):
            raise WarcError("a skippable frame runs over the archive's end")
        return end

    at = skippable(0)
    if at is None or content[:4] != DICTIONARY_MAGIC:
        raise WarcError("the archive doesn't start with a dictionary frame")
    words = content[8:at]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while at < len(content):
        if (end := skippable(at)) is not None:
            at = end
            continue
        frame = reader.decompressobj()
        try:
            # A frame's length isn't written anywhere: feed growing pieces until it ends.
            parts, upto = [], at
            while not frame.eof:
                if upto >= len(content):
                    raise WarcError("the last frame is cut off")
                parts.append(frame.decompress(content[upto : upto + 65_536]))
                upto = min(upto + 65_536, len(content))
        except zstandard.ZstdError as e:
            raise WarcError(f"byte {at}: {e}") from e
        yield parse_record(b"".join(parts))
        at = upto - len(frame.unused_data)


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` with payload_digest and refers_to (null for responses)."""
    rows = pages.select("page_id", "url", "html", payload_digest(F.col("html")).alias("payload_digest"))
    small = F.coalesce(F.octet_length("html"), F.lit(0)) < min_bytes
    of_page = rows.where(~small).groupBy("payload_digest", "page_id").agg(F.count("*").alias("m"))
    top = of_page.groupBy("payload_digest").agg(F.max(F.struct("page_id", "m")).alias("top"), F.sum("m").alias("n")).where("n > 1")
    owners = checkpointed(top.select("payload_digest", F.col("top.page_id").alias("owner"), (F.col("top.m") > 1).alias("several")))
    met = rows.join(owners, "payload_digest", "left")
    is_owner = F.col("page_id").eqNullSafe(F.col("owner"))
    revisits = F.col("owner").isNotNull() & ~small & ~is_owner
    columns = ["page_id", "url", "html", "payload_digest"]
    typed = [*columns, F.when(revisits, F.col("owner")).alias("refers_to")]
    if owners.where("several and owner is not null").isEmpty():
        return met.select(*typed)
    tied = F.coalesce("several", F.lit(False)) & ~small & is_owner & F.col("page_id").isNotNull()
    others = met.where(~tied).select(*typed)
    # Rows of one page_id and payload differ by url at most, so they are counted, not sorted.
    same = met.where(tied).groupBy("payload_digest", "page_id", "url").agg(F.first("html").alias("html"), F.count("*").alias("m"))
    named = F.struct(F.col("url").isNull().alias("none"), "url")
    head = same.groupBy("payload_digest").agg(F.min(named).alias("head"))
    same = same.join(head, "payload_digest").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    repeated = (F.col("nth") > 1) | ~F.col("url").eqNullSafe(F.col("head.url"))
    return others.unionByName(same.select(*columns, F.when(repeated, F.col("page_id")).alias("refers_to")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archives: int | None = None, records: int = ARCHIVE_RECORDS) -> None:
    """Writes a record for each row of `pages` (page_id, url, html) to Zstandard archives in the folder `path`.

    Each task begins an archive, and another one whenever it has written `records` or ARCHIVE_BYTES; a number of tasks can be asked for,
    at the price of one more shuffle.
    """
    words, most = train_dictionary(pages), ARCHIVE_BYTES

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        first = DICTIONARY_MAGIC + struct.pack("<I", len(words)) + words
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        archive, written = bytearray(first), 0
        for pdf in batches:
            for page_id, url, html, digested, owner in zip(pdf.page_id, pdf.url, pdf.html, pdf.payload_digest, pdf.refers_to):
                page_id, owner = (None if x is None else int(x) for x in (page_id, owner))
                frame = writer.compress(record_bytes(page_id, url, (html or "").encode("utf-8"), digested, owner))
                if written and (written == records or len(archive) + len(frame) > most):
                    yield pd.DataFrame({"archive": [bytes(archive)]})
                    archive, written = bytearray(first), 0
                archive += frame
                written += 1
        if written:
            yield pd.DataFrame({"archive": [bytes(archive)]})

    typed = record_types(pages, min_bytes)
    typed = typed.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # whole numbers with nulls lose digits in pandas
    typed = typed.repartition(archives) if archives else typed
    as_text = typed.mapInPandas(whole, "archive binary").select(F.col("archive").cast("string").alias("value"))
    as_text.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder."""
    columns = [c.split()[0] for c in RECORD.split(", ") if payloads or not c.startswith("payload ")]
    schema = ", ".join(c for c in RECORD.split(", ") if payloads or not c.startswith("payload "))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

        for pdf in batches:
            for content in pdf.content:
                rows: list[dict] = []
                for record in read_archive(content):
                    rows.append(record)
                    if len(rows) == 256:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInPandas(records, schema)
