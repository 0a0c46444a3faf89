"""Writing pages as WARC records, and a reader that salvages what damaged archives still hold.

An archive is a run of gzip members, one record in each (plain archives are read too). The
reader checks every record: the member's own checksum, the version line, Content-Length and
the block digest. After a failed check it looks for the next member or version line that
passes, goes on from there, and reports the bytes between as a quarantined gap. A member may
hold several records: those that pass are kept whatever is wrong with others, and where the
member itself is damaged, those before the damage whose block digests are right.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import bounded_batches, durable, text_bytes, text_or_empty

#: An archive is closed when it reaches so many bytes.
ARCHIVE_BYTES = 1 << 19
#: The table of repeated payloads is broadcast up to so many rows (of about 50 bytes), else joined by shuffling.
BROADCAST_ROWS = 200_000
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARCHIVES = pa.schema([("archive", pa.string()), ("content", pa.binary())])
_FOUND = pa.schema([
    ("archive", pa.string()), ("first_byte", pa.int64()), ("last_byte", pa.int64()), ("gap_reason", pa.string()),
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
_FOUND_DDL = "archive string, first_byte bigint, last_byte bigint, gap_reason string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def sha1_base32(text: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text's UTF-8 bytes: five hex digits make four base32 digits."""
    digits = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit has the HTTP head alone, which still tells the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives (name, content) with a record for every row of pages.

    Of rows with equal payloads of at least least_bytes, those with the smallest id are
    responses and the others revisits of it. Null html is an empty payload; a null url gives
    no target; a null id is never the smallest, unless all ids of the payload are null. Rows
    that repeat an id and its payload are all written. An empty table gives no archives.
    """
    bounded_batches(pages.sparkSession)
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), sha1_base32(html).alias("digest"))
    slim = pages.select(F.col(id_col).cast("bigint").alias("id"), sha1_base32(html).alias("digest"), F.octet_length(html).alias("size"))
    shared = slim.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = durable(shared.where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "warc-shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    joined = rows.join(shared, rows["digest"] == shared["d"], "left").select("id", "url", "html", "digest", refers.alias("refers"))
    return joined.mapInArrow(_pack, "archive string, content binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], schema=_ARCHIVES)

    for batch in batches:
        ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for page, url, payload, digest, to in zip(ids, urls, text_bytes(batch.column(2)), digests, refers):
            whole = record(f"urn:page:{'' if page is None else page}", url, payload, digest, None if to is None else f"urn:page:{to}")
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            held.append(member.compress(whole) + member.flush())
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield closed()
                n, held, size = n + 1, [], 0
    if held:
        yield closed()


def _body(data: bytes, at: int) -> int | None:
    """Where the compressed data of the gzip member that starts here begin."""
    flags, k = data[at + 3 : at + 4], at + 10
    if not flags or flags[0] & 0xE0:
        return None
    if flags[0] & 4:
        k += 2 + int.from_bytes(data[k : k + 2], "little")
    for named in (8, 16):
        if flags[0] & named:
            k = data.find(b"\0", k) + 1 or len(data) + 1
    k += 2 if flags[0] & 2 else 0
    return k if k <= len(data) else None


def _member(data: bytes, at: int) -> tuple[bytes, int | None, str | None]:
    """What a gzip member inflates to as far as it does, its end where that is known, and what is wrong with it."""
    if (k := _body(data, at)) is None:
        return b"", None, "member has no head"
    inflate, out, view = zlib.decompressobj(-15), [], memoryview(data)
    while not inflate.eof and k < len(data):
        before, step = inflate.copy(), min(65536, len(data) - k)
        try:
            out.append(inflate.decompress(view[k : k + step]))
        except zlib.error:
            for x in range(k, k + step):  # what comes before the damage
                try:
                    out.append(before.decompress(view[x : x + 1]))
                except zlib.error:
                    break
            return b"".join(out), None, "member is damaged"
        k += step
    inner = b"".join(out)
    if not inflate.eof:
        return inner, None, "member has no end"
    end = k - len(inflate.unused_data)
    right = zlib.crc32(inner).to_bytes(4, "little") + (len(inner) & 0xFFFFFFFF).to_bytes(4, "little")
    return inner, min(len(data), end + 8), None if data[end : end + 8] == right else "member's checksum is wrong"


def _inside(inner: bytes, sound: bool) -> tuple[list[tuple[dict[str, str], bytes]], list[str]]:
    """The records of a member's content that pass, and why stretches between them don't; of a damaged one those with a digest."""
    found, reasons, at = [], [], 0
    while at < len(inner):
        got = _plain(inner, at)
        if isinstance(got, str) or not sound and "warc-block-digest" not in got[0]:
            reasons.append(got if isinstance(got, str) else "nothing vouches for it")
            ahead = inner.find(b"\n" + _VERSION, at) + 1
            while ahead and isinstance(_plain(inner, ahead), str):
                ahead = inner.find(b"\n" + _VERSION, ahead) + 1
            if not ahead:
                break
            at = ahead
        else:
            found.append(got[:2])
            at = got[2]
    return found, reasons


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record that starts here, or what is wrong with it."""
    if data[at : at + len(_VERSION)] != _VERSION:
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "headers have no end"
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
    heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch(r"[0-9]{1,18}", heads.get("content-length", "")):
        return "no content length"
    first, last = stop + 4, stop + 4 + int(heads["content-length"])
    if data[last : last + 4] != b"\r\n\r\n":
        return "length is wrong"
    block = data[first:last]
    if (said := heads.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest_of(block):
        return "digest is wrong"
    return heads, block, last + 4


def _at(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int | None, str | None]:
    """The records of the member or version line that starts here, its end where that is known, and what is wrong."""
    if data[at : at + 3] == _MAGIC:
        inner, end, wrong = _member(data, at)
        found, reasons = _inside(inner, wrong is None)
        return found, end if found or wrong is None else None, wrong or (reasons[0] if reasons else None)
    if isinstance(got := _plain(data, at), str):
        return [], None, got
    return [got[:2]], got[2], None


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """(start, end, headers, block) of every record that passes its checks, and (start, end, None, reason) of gaps.

    A record of a member that holds several has the member's start and end, and so has a gap in it.
    """
    at = 0
    while at < len(data):
        found, end, wrong = _at(data, at)
        start, at = at, end if end is not None else at
        while end is None:  # the next member or version line with a record
            ahead = [k for k in (data.find(_MAGIC, at + 1), data.find(b"\n" + _VERSION, at) + 1) if k > at]
            at = min(ahead, default=len(data))
            if not ahead or (got := _at(data, at))[2] is None and not got[0]:
                break
            if any(x not in found for x in got[0]):  # a member that only stores its bytes shows its records twice
                break
        for heads, block in found:
            yield start, at, heads, block
        if wrong:
            yield start, at, None, wrong


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (name, content), and a row with gap_reason for every gap.

    Takes what write_archives returns, or files read as binaryFile (path, ..., content).
    payload is filled only on request; a revisit's payload_bytes is what its HTTP head tells.
    An empty archive or table gives no rows; null content counts as empty. A task holds an
    archive as a whole, so archives should stay well below its memory.
    """
    bounded_batches(archives.sparkSession)
    name = "archive" if "archive" in archives.columns else "path"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [_row(name.as_py(), *x, with_payload) for x in salvage(content.as_py() or b"")]
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return archives.select(F.col(name), F.col("content")).mapInArrow(unpack, _FOUND_DDL)


def _row(archive: str, first: int, last: int, heads: dict[str, str] | None, block: bytes | str, with_payload: bool) -> dict:
    row = dict.fromkeys(_FOUND.names) | {"archive": archive, "first_byte": first, "last_byte": last}
    if heads is None:
        return row | {"gap_reason": block}
    head, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)
    kind = heads.get("warc-type")
    row |= {"record_id": heads.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": heads.get("warc-target-uri"), "payload": payload if with_payload else None}
    if "warc-refers-to" in heads:
        row["refers_to"] = heads["warc-refers-to"].strip("<>")
    revisit = kind == "revisit"
    row["payload_bytes"] = int(told[1]) if revisit and told else len(payload)
    row["payload_digest"] = heads.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest_of(payload)
    return row
