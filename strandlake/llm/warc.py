"""WARC archives of pages: writing records, and a salvage reader that recovers what follows damage.

A null html is an empty payload. Rows with a null page_id are written without an id and come back as
null; repeated rows give a record each: the first of equal rows may be the response, the others revisit
it. A null id ranks below all others. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import table
from strandlake.session import shared_folder

# The parts of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")

LEAST_REVISIT = 0           # payloads of at least so many bytes are written once
FILE_BYTES = 8 << 20        # payload of one archive file, about; a single larger page has a file of its own size
PAD = "\x00"                # what the text sink puts after each member; readers of members skip zero bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(kind: str, page_id: int | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has no block but names the response's record and the payload's size."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    else:
        head.append(f"WARC-Block-Digest: sha1:{digest}")
    head.append(f"Content-Length: {len(payload)}")
    return VERSION + "\r\n".join(head).encode() + END + payload + END


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse_record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that begins at a version line and the place after it; None if a check fails."""
    line = START.match(data, at)
    if not line or data[at:at + 1] != b"W":
        return None
    body = data.find(END, at)
    if body < 0:
        return None
    fields = {}
    for row in data[line.end():body].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit() or "warc-type" not in fields:
        return None
    begin = body + len(END)
    stop = begin + int(size)
    if data[stop:stop + len(END)] != END:
        return None
    block = data[begin:stop]
    promised = fields.get("warc-block-digest", "")
    if promised.startswith("sha1:") and promised[5:] != sha1_base32(block):
        return None
    return {"fields": fields, "block": block}, stop + len(END)


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and the place after it; None if it is damaged or cut."""
    unpack, out, step = zlib.decompressobj(31), [], 2048
    while not unpack.eof and at < len(data):
        part = data[at:at + step]   # what follows the member is copied once a step only
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            return None
        at, step = at + len(part), min(2 * step, 1 << 18)
    return (b"".join(out), at - len(unpack.unused_data)) if unpack.eof else None


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records of an archive and the quarantined gaps (start, end, reason) that no valid record covers.

    A record must pass its checks: inflation with checksum, header syntax, length, closing blank lines and
    block digest. After a failure the next place that starts with a member's or a version line's bytes is
    tried, so that damage costs the damaged records only. Zero bytes between members are no gap.
    """
    records, gaps = [], []
    at, bad, why = 0, None, ""
    while at < len(data):
        found, after, reason = [], at, "no record"
        if data.startswith(MEMBER, at):
            reason = "damaged member"
            if got := inflate(data, at):
                content, after = got
                inner, whole = 0, True
                while inner < len(content):
                    one = parse_record(content, inner)
                    if one is None:
                        later = next((m.start() for m in START.finditer(content, inner + 1) if m[0][:1] == b"W"), len(content))
                        gaps.append((at, after, f"member bytes {inner} to {later}: failed record"))
                        inner, whole = later, False
                    else:
                        found.append(one[0])
                        inner = one[1]
                reason = "" if whole or found else "failed record"
        elif data.startswith(b"WARC/1.", at):
            reason = "failed record"
            if one := parse_record(data, at):
                found, after = [one[0]], one[1]
        elif data[at] == 0 and bad is None:
            at += 1
            continue
        if found or after > at:
            if bad is not None:
                gaps.append((bad, at, why))
                bad = None
            records += found
            at = after
            continue
        if bad is None:
            bad, why = at, reason
        later = START.search(data, at + 1)
        at = later.start() if later else len(data)
    if bad is not None:
        gaps.append((bad, len(data), why))
    return records, gaps


def with_roles(pages: DataFrame, files: int, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, payload, size, shared and first (the largest page_id of the payload), dealt to ``files`` partitions, equal rows together.

    Digests are grouped without the payloads; the payloads move once, by page and digest, never by digest
    alone: copies under other ids, however many, are spread over all tasks.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    name = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("")).alias("name")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), name, payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    light = rows.select("page_id", "name", "digest", "size").filter(F.col("size") >= least)
    firsts = light.groupBy("digest").agg(F.max("page_id").alias("first"))
    roles = light.select("name", "digest").distinct().join(firsts, "digest").withColumn("shared", F.lit(True))
    met = rows.repartition(files, "name", "digest").join(roles, ["name", "digest"], "left").sortWithinPartitions("name", "digest")
    return met.select("page_id", "payload", "size", F.coalesce("shared", F.lit(False)).alias("shared"), "first")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> None:
    """Gzip members, one a record, in files of about FILE_BYTES payload; the sink is Spark's own, so any store that Spark writes serves."""
    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for f in frames:
            out = []
            for page_id, payload, size, shared, first in zip(f["page_id"], f["payload"], f["size"], f["shared"], f["first"], strict=True):
                page = None if pd.isna(page_id) else int(page_id)
                ref = None if pd.isna(first) else int(first)
                digest = sha1_base32(payload)
                again = shared and (page != ref or last == (page, digest))
                last = (page, digest)
                out.append(member(record("revisit", page, digest, size, b"", ref) if again else record("response", page, digest, size, payload, None)))
            yield pd.DataFrame({"value": out})

    spark = pages.sparkSession
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // FILE_BYTES + 1)
    with_roles(pages, files, least).mapInPandas(members, "value binary").select(F.col("value").cast("string")).write.option("lineSep", PAD).text(folder)


RECORDS = "file string, start long, stop long, reason string, kind string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def page_number(uri: str) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+)>", uri)
    return int(got[1]) if got else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record (kind set), and one a quarantined gap (reason set). A task holds one file at a time."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                records, gaps = salvage(bytes(content))
                out = []
                for r in records:
                    h = r["fields"]
                    size = h.get("x-payload-length", h["content-length"])
                    out.append((path, None, None, None, h["warc-type"], page_number(h.get("warc-record-id", "")), int(size) if size.isdigit() else None,
                                h.get("warc-payload-digest", "").removeprefix("sha1:"), page_number(h.get("warc-refers-to", "")),
                                r["block"] if payloads else None))
                out += [(path, a, b, why, None, None, None, None, None, None) for a, b, why in gaps]
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
                for c in ("start", "stop", "page_id", "payload_bytes", "refers_to"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(rows, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/strandlake/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    found = read_archives(spark, folder, payloads=False).filter("kind is not null")
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")




OP6_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS first,
         row_number() OVER (PARTITION BY h, page_id) AS copy
  FROM payloads)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first AND copy = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first AND copy = 1 THEN NULL ELSE first END AS refers_to
FROM ranked
"""
