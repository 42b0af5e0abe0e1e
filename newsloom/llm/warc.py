"""Writing pages as WARC files and reading them back by a verified chain of records.

Files are written by Spark's text writer, one record per row with two line ends as the separator, in
gzip. To read, tasks emit every place that looks like a record, with the place where the next record
must start if it is one. Candidates that only follow each other are one link of a chain from the start. From each file's first byte,
pointer jumping over these links keeps what is reachable; what looks like a record inside a payload is not. A chain must
reach the end of its file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.util import arrow_map, materialize, shared_dir, table

END = "\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Payloads below this many bytes are never revisits.
LEAST = 100


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with html (null: empty), bytes, digest, first: the page_id that a revisit refers to, null for a response."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    p = p.withColumn("_k", F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest"))
    thin = materialize(p.select("page_id", "bytes", "digest", "_k"), "digests")
    first = thin.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = thin.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("_k", "first").dropDuplicates(["_k"])
    size = thin.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-size // (16 << 20)))
    # the one shuffle of the payloads; it also makes files of about 16 MB
    return p.repartition(int(files), "_k").join(again.repartition(int(files), "_k"), "_k", "left").drop("_k")


def record_text() -> Column:
    """One WARC record without the two line ends that close it."""
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    block = F.when(F.col("first").isNull(), F.concat(http, F.col("html"))).otherwise(http)
    ident = lambda c: F.concat(F.lit("<urn:newsloom:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "), ident("first"), F.lit(END)
    )
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(F.col("first").isNull(), "response").otherwise("revisit"),
        F.lit(f"{END}WARC-Record-ID: "), ident("page_id"),
        F.lit(f"{END}WARC-Target-URI: "), clean,
        F.lit(f"{END}WARC-Date: 2024-01-01T00:00:00Z{END}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(END),
        F.when(F.col("first").isNull(), "").otherwise(revisit),
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block,
    )


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write pages(page_id, url, html) as WARC files; of equal payloads of `least` bytes or more, only one is stored.

    The smallest page_id of such a group is the response; rows that repeat it are responses too. A
    null html is an empty payload, a null page_id is written as "none". An empty table gives no record.
    """
    records(pages, least).select(record_text().alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def _header(data: bytes, start: int) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        return {}, -1
    lines = data[start:end].decode("utf-8", "replace").split(END)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def _ident(value: str) -> int | None:
    tail = value.rstrip(">").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def _members(data: bytes) -> bytes:
    """The bytes of all gzip members, or data itself if it is not compressed."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(47)
        out.append(d.decompress(data))
        if not d.eof:  # cut off: what there is counts, and the chain will not reach the end
            return b"".join(out) + b"\0"
        data = d.unused_data
    return b"".join(out) + data


def _heads(out: list[dict]) -> None:
    """Give each candidate `head`: the first of the candidates that lead to it with no other way in, and `last`: whether it ends such a run."""
    at = {r["at"]: i for i, r in enumerate(out)}
    ways: dict[int, int] = {}
    for r in out:
        ways[r["next"]] = ways.get(r["next"], 0) + 1
    for r in out:
        r.setdefault("head", r["at"])
        i = at.get(r["next"])
        r["last"] = i is None or ways[r["next"]] > 1
        if not r["last"]:
            out[i]["head"] = r["head"]


def _candidates(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """Every place that looks like a record, parsed as if it were one; and each file's end, without a type."""
    kind = [("file", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("head", pa.int64()), ("last", pa.bool_()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema([*kind, *([("url", pa.string()), ("payload", pa.binary())] if payload else [])])
    for b in batches:
        for file, raw in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
            data = raw.as_py()
            data = _members(data)
            out = []
            for m in MAGIC.finditer(data):
                head, body = _header(data, m.start())
                size = head.get("content-length", "")
                if body < 0 or not size.isdigit() or data[body + int(size) : body + int(size) + 4] != b"\r\n\r\n":
                    continue
                block = data[body : body + int(size)]
                http, at = _header(block, 0)
                content = block[at:] if at >= 0 else b""
                row = {"file": file, "at": m.start(), "next": body + int(size) + 4, "page_id": _ident(head.get("warc-record-id", "")), "record_type": head.get("warc-type")}
                if row["record_type"] == "revisit":
                    n = http.get("content-length", "")
                    row |= {"refers_to": _ident(head.get("warc-refers-to", "")), "payload_bytes": int(n) if n.isdigit() else None, "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2]}
                else:
                    row |= {"refers_to": None, "payload_bytes": len(content), "payload_digest": hashlib.sha256(content).hexdigest()}
                out.append(row | ({"url": head.get("warc-target-uri"), "payload": content} if payload else {}))
            out.append({"file": file, "at": len(data), "next": -1})
            _heads(out)
            yield pa.RecordBatch.from_pylist(out, schema)


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of links(file, at, next) that a chain from the file's first byte reaches, by pointer jumping.

    Each round, what is reached marks what its jump leads to, and every jump is doubled: a chain of n
    links takes about log2 n rounds. Jumps that lead to no candidate end there. Links only lead forward.
    """
    jump = materialize(links.select("file", "at", "next"), "jump")
    reach = materialize(jump.where("at = 0").select("file", "at"), "reach")
    n = reach.count()
    while True:
        hit = jump.join(reach, ["file", "at"]).select("file", F.col("next").alias("at"))
        hit = hit.join(jump.select("file", "at"), ["file", "at"])
        new = materialize(reach.union(hit).distinct(), "reach")
        m = new.count()
        if m == n:
            return new
        n, reach = m, new
        then = jump.select("file", F.col("at").alias("next"), F.col("next").alias("_n"))
        jump = materialize(jump.join(then, ["file", "next"], "left").select("file", "at", F.coalesce("_n", F.lit(-1).cast("long")).alias("next")), "jump")


def read_warc(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of all files under path: file (a hash of the path), at (offset), next, page_id, record_type, refers_to,
    payload_bytes, payload_digest (of the full payload; for a revisit, as its headers state them)[, url, payload].

    Plain files and gzip files of one or many members are read. A file is read in one piece, so files should be of tens of MB, as
    write_warc makes them. Where a file's chain stops before its end (a broken or cut record), ValueError is
    raised; with strict=False the records before that place are returned.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")
    kind = "file long, at long, next long, head long, last boolean, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", url string, payload binary" if payload else "")
    found = materialize(arrow_map(files, partial(_candidates, payload=payload), kind), "candidates")
    reached = reachable(found.where("last").select("file", F.col("head").alias("at"), "next")).withColumnRenamed("at", "head")
    if strict:
        broken = found.where("next < 0").join(reached, ["file", "head"], "left_anti").count()
        if broken:
            raise ValueError(f"{broken} files have records that do not lead to the file's end")
    return found.where("next >= 0").join(reached, ["file", "head"]).drop("head", "last")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
