"""WARC archives with a two-level capture index.

Every partition of pages becomes an archive, a file of WARC records compressed one by one, in the shared
folder; what the task returns are its records' places, so that a repeated task leaves at most a file that nothing refers to. Places are sorted by a key, the
URL with its host reversed, and written as lines in blocks, each compressed by itself; a
sparse directory has the first and last key of each block. Keys are looked up by binary search in
the directory, then in the blocks it names, each of which is read once; records are then read by their ranges.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, opened, table, written

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Lines of an index block at least; blocks and the key length in the directory, which bound its size.
BLOCK_LINES, MOST_BLOCKS, KEY_CHARS = 512, 65_536, 128
#: Index blocks and bytes of records that a task reads.
TASK_BLOCKS, TASK_BYTES = 16, 4 << 20
DATE = "2000-01-01T00:00:00Z"

#: Characters that a URI may hold as they are.
URI_CHARACTERS = "%:/?#[]@!$&'()*+,;=-._~"

_LAST = (1 << 63) - 1
MANIFEST = "key string, page_id long, url string, record_type string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL; '' for null."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]*", "")
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(page_id: int | str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def warcinfo(name: str, date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, '')}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers_to`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page: {json.dumps([page_id, url, refers_to])}",  # as they are, whatever they hold
    ]
    if url:
        head.insert(4, f"WARC-Target-URI: {quote(url, safe=URI_CHARACTERS)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of a record; a response's digest is that of its payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page_id, url, refers_to = (x if x is None or i == 1 else int(x) for i, x in enumerate(json.loads(fields["X-Page"])))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't match its headers")
    return {
        "page_id": page_id, "url": url, "record_type": kind, "payload_bytes": size, "payload_digest": digest,
        "refers_to": refers_to, "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write every row of ``pages`` to archives in ``root``; the manifest, a written table of the records' places.

    Of records with equal payloads of ``LEAST_BYTES`` or more the one with the least page_id (null last) is the response that
    the others revisit. A null html is an empty payload. Columns other than page_id, url and html are not read. Rows that repeat
    page_id and html are all written, as responses or revisits alike.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), url_key(F.col("url")).alias("key"))
    ids = pages.where(F.octet_length("html") >= LEAST_BYTES).select(F.coalesce("page_id", F.lit(_LAST)).alias("w_id"), F.sha2("html", 256).alias("w_digest"))
    firsts = ids.groupBy("w_digest").agg(F.min("w_id").alias("w_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = ids.join(firsts, "w_digest").where("w_id <> w_first").distinct()
    same = (F.coalesce("page_id", F.lit(_LAST)) == F.col("w_id")) & (F.col("digest") == F.col("w_digest"))
    # Ids go to Python as text: beside nulls pandas would make them floating-point numbers.
    rows = rows.join(revisits, same, "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "key", F.col("w_first").cast("string").alias("refers_to")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(root)
        name, out, at = f"archive-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for frame in batches:
                places = []
                for page_id, url, text, digest, key, first in frame.itertuples(index=False):
                    if out is None:
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        data = _gzip(warcinfo(name))
                        out.write(data)
                        at = len(data)
                    data = _gzip(record(page_id, url, text.encode("utf-8"), digest, first))
                    out.write(data)
                    places.append((key, None if page_id is None else int(page_id), url, "response" if first is None else "revisit", name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(places, columns=[c.split()[0] for c in MANIFEST.split(", ")]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInPandas(write, MANIFEST), "warc-manifest")


def build_index(manifest: DataFrame, root: str) -> DataFrame:
    """Write the sorted blocks to ``root``; the directory, a written table with a row a block, at most about ``MOST_BLOCKS``."""
    lines = max(BLOCK_LINES, -(-manifest.count() // MOST_BLOCKS))
    order = ["key", "file", "offset"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(root)
        name, at, held, out = f"index-{uuid.uuid4().hex}.gz", 0, [], None

        def flush(block: list) -> tuple:
            nonlocal at, out
            if out is None:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            data = _gzip("\n".join(json.dumps(x) for x in block).encode())
            out.write(data)
            at += len(data)
            return block[0][0][:KEY_CHARS], block[-1][0][:KEY_CHARS], name, at - len(data), len(data)

        columns = ["first_key", "last_key", "file", "offset", "length"]
        for frame in batches:
            rows = []
            for x in zip(frame["key"], frame["file"], frame["offset"].tolist(), frame["length"].tolist()):
                held.append(x)
                if len(held) == lines:
                    rows.append(flush(held))
                    held = []
            yield pd.DataFrame(rows, columns=columns)
        if held:
            yield pd.DataFrame([flush(held)], columns=columns)
        if out is not None:
            out.close()

    parts = max(1, min(2000, -(-manifest.count() // (8 * lines))))
    rows = manifest.select("key", "file", "offset", "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(rows.mapInPandas(write, "first_key string, last_key string, file string, offset long, length long"), "warc-directory")


def look_up(keys: DataFrame, directory: DataFrame, root: str) -> DataFrame:
    """(key, file, offset, length) of all captures of the distinct ``keys`` (one column, key)."""
    blocks = directory.orderBy("first_key", "last_key", "file", "offset").toPandas()
    shared = keys.sparkSession.sparkContext.broadcast(blocks)

    @F.pandas_udf("array<int>")
    def block_numbers(key: pd.Series) -> pd.Series:
        d = shared.value
        short = key.str[:KEY_CHARS].to_numpy(object)
        low = np.searchsorted(d["last_key"].to_numpy(object), short, side="left")
        high = np.searchsorted(d["first_key"].to_numpy(object), short, side="right")
        return pd.Series([np.arange(i, j, dtype=np.int32) for i, j in zip(low, high)], dtype=object)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(root)
        d, now, wanted = shared.value, None, set()

        def found() -> pd.DataFrame:
            with system.open_input_file(f"{path}/{d['file'][now]}") as source:
                data = zlib.decompress(source.read_at(int(d["length"][now]), int(d["offset"][now])), 31)
            return pd.DataFrame([x for x in map(json.loads, data.decode().split("\n")) if x[0] in wanted], columns=["key", "file", "offset", "length"])

        for frame in batches:
            for block, key in zip(frame["block"], frame["key"]):
                if block != now:
                    if now is not None:
                        yield found()
                    now, wanted = block, set()
                wanted.add(key)
        if now is not None:
            yield found()

    asked = keys.select("key").distinct().select("key", block_numbers.asNondeterministic()("key").alias("x")).select("key", F.explode("x").alias("block"))
    # A number of tasks by blocks, since the places that come in are small beside what is read.
    return asked.repartition(max(1, -(-len(blocks) // TASK_BLOCKS)), "block").sortWithinPartitions("block").mapInPandas(scan, "key string, file string, offset long, length long")


def read_records(places: DataFrame, root: str) -> DataFrame:
    """The records at ``places`` (file, offset, length), read by ranges in order of place."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(root)
        name, source = None, None
        for frame in batches:
            out = []
            for file, offset, length in zip(frame["file"], frame["offset"].tolist(), frame["length"].tolist()):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{path}/{file}")
                out.append(parse(zlib.decompress(source.read_at(length, offset), 31)))
            columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
            yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    size = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-int(size) // TASK_BYTES))
    rows = places.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return rows.mapInPandas(read, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, index the archives, look every URL up and read its records back.

    An empty table gives an empty result; a null URL has the empty key. Columns other than page_id, url and html are not read.
    """
    root = new_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, root)
    directory = build_index(manifest, root)
    places = written(look_up(pages.select(url_key(F.col("url")).alias("key")), directory, root), "warc-places")
    return read_records(places, root)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
"""
