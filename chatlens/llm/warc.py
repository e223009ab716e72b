"""WARC archives: writing, reading, and an index merged from locally sorted runs.

Records are text rows written by Spark's text writer with the record separator as line
separator, so archive files go through the usual commit of a job into any file system Spark
knows, and a lost executor costs a task. A file holds ``per_file`` records and about ``file_bytes`` at
most (a longer record has a file of its own): rows are written by classes of payload size, each with its
number of records to a file. A file is a run: its captures are sorted by URL key and time. Reading takes whole files, follows each
record's Content-Length, and checks every payload against its digest.

The index of all captures is merged externally: captures are dealt by ranges of
(URL key, time), and each task merges the runs of its range with a loser tree. The
ranges in order, each in order, are the ordered capture histories of all URLs.

A payload of at least ``least`` bytes is stored once, in the response of the smallest page_id
(null page_ids last; one of the rows, if several have that page_id); all other captures of it are revisits
that refer to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

LEAST, PER_FILE, FILE_BYTES, BROADCAST_ROWS, EPOCH = 100, 500, 64 << 20, 200_000, 1_704_067_200
#: Payloads up to this length are one class; each further class is four times as long.
SMALL = 64 << 10
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = ("run string, seq long, offset long, length long, url_key string, date string, url string, page_id long, "
            "record_type string, payload_bytes long, payload_digest string, refers_to long")


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, then ``)`` and the rest.
    Without a host (or null), the whole text after ``)``."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest)


def _header_safe(c: Column) -> Column:
    """Control characters and blanks percent-encoded: a header field is one line."""
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    for k in [*range(32), 127]:
        c = F.replace(c, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    return c


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST, per_file: int = PER_FILE,
                  broadcast_rows: int = BROADCAST_ROWS, file_bytes: int = FILE_BYTES) -> None:
    """Writes one WARC record per row of ``pages`` (page_id, url, html) into folder ``path``.

    The payload is the html in UTF-8, empty if null. Of equal rows (page_id and payload) one is the
    response, and the others revisit it. The time of a capture is its page_id in
    seconds after 2024-01-01, repeating after a year. Other columns are not used.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    lengths = p.select("size")
    again = p.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n")).groupBy("digest").agg(
        F.sum("n").alias("n"), F.min("page_id").alias("first"), F.min_by("n", F.struct(F.col("page_id").isNull(), "page_id")).alias("firsts"))
    again = written(again.where("n > 1").select("digest", "first", "firsts", F.lit(True).alias("repeated")), "payloads")
    few = again.count() <= broadcast_rows  # at most about 30 MB
    p = p.join(F.broadcast(again) if few else again, "digest", "left")
    at_first = F.coalesce(F.col("repeated"), F.lit(False)) & F.col("page_id").eqNullSafe(F.col("first"))
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.withColumn("twin", at_first & (F.col("firsts") > 1))
    if not again.where("firsts > 1").isEmpty():  # rows of one page_id and payload: the first written is the response
        twins = written(p.where("twin").withColumn("no", F.monotonically_increasing_id()), "twins")
        low = written(twins.groupBy("digest").agg(F.min("no").alias("low")), "low")
        twins = twins.join(low.select(F.col("digest").alias("_d"), "low"), F.col("digest") == F.col("_d")).withColumn("no", F.col("no") - F.col("low"))
        p = p.where("not twin").withColumn("no", F.lit(0).cast("long")).unionByName(twins.drop("_d", "low"))
    else:
        p = p.withColumn("no", F.lit(0).cast("long"))
    revisit = revisit | (F.col("no") > 0)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(SEPARATOR))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    field = lambda name, c: F.concat(F.lit(name + ": "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.concat("digest", F.when(F.col("no") > 0, F.concat(F.lit("/"), F.col("no").cast("string"))).otherwise("")))), field("WARC-Date", date),
        field("WARC-Target-URI", _header_safe(F.col("url"))), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), field("WARC-X-Page-Id", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"))),
                                 F.when(F.col("first").isNotNull(), field("WARC-X-Refers-To-Page-Id", F.col("first").cast("string"))).otherwise(""))).otherwise(""),
        field("WARC-X-Url-Key", _header_safe(url_key(F.col("url")))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    # in the order that merge_index merges by: the key as it stands in the header, null ids last
    kind = F.greatest(F.lit(0), F.ceil(F.log(4.0, (F.col("size") + 1) / F.lit(SMALL)))).cast("int")
    sizes = [r[0] for r in lengths.select(kind.alias("kind")).distinct().collect()] or [0]  # a dozen classes at most
    rows = p.select(kind.alias("kind"), _header_safe(url_key(F.col("url"))).alias("k"), date.alias("d"), "page_id", F.concat(head, block).alias("value"))
    for k in sizes:
        some = rows.where(F.col("kind") == k) if len(sizes) > 1 else rows
        records = max(1, min(per_file, file_bytes // (SMALL * 4 ** k)))
        some.sortWithinPartitions("k", "d", F.col("page_id").asc_nulls_last()).select("value").write.option("lineSep", SEPARATOR).option(
            "maxRecordsPerFile", records).text(f"{path}/size-{k}")


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of each record of an archive."""
    at, end = 0, content.find(b"\r\n\r\n")
    while end >= 0:
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop + 4 - at, head, content[end + 4:stop]
        at, end = stop + 4, content.find(b"\r\n\r\n", stop + 4)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``: its place (run, seq, offset, length),
    URL key, date, and what it says of its payload. Responses' payloads are hashed anew; one
    that differs from its header, or a broken record, fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _CAPTURE.split(", "))])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for seq, (at, length, head, block) in enumerate(parse_records(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x[16:] for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")))
                    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append({"run": name.as_py(), "seq": seq, "offset": at, "length": length, "url_key": head["warc-x-url-key"], "date": head["warc-date"],
                                 "url": head["warc-target-uri"], "page_id": number("warc-x-page-id"), "record_type": kind, "payload_bytes": size,
                                 "payload_digest": digest, "refers_to": number("warc-x-refers-to-page-id")})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, _CAPTURE)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, the winner
    moves up; after each output only the path of its run is played again."""

    def __init__(self, runs: Iterable[Iterator[tuple]]) -> None:
        self.runs = list(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._enter(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._less(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (w := self.losers[0]) >= 0 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node, i = (w + self.k) // 2, w
            while node > 0:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.losers[0] = i


def merge_index(captures: DataFrame) -> DataFrame:
    """``captures`` in one global order by (url_key, date, page_id, run, seq), as column ``place``
    (increasing, with gaps). Written. A URL with most of the captures is split by date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # the narrow index rows of one range
        if not held:
            return
        t = pa.Table.from_batches(held)
        names = t["run"].to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        no_id = 1 << 63
        keys = list(zip(t["url_key"].to_pylist(), t["date"].to_pylist(), (no_id if x is None else x for x in t["page_id"].to_pylist()),
                        names, t["seq"].to_pylist(), range(len(names)), strict=True))
        merged = LoserTree(iter(keys[s:e]) for s, e in zip(cuts, cuts[1:], strict=False) if e > s)
        yield from t.take(pa.array([x[-1] for x in merged], pa.int64())).to_batches(max_chunksize=10_000)

    order = [F.col("url_key"), F.col("date"), F.col("page_id").asc_nulls_last(), F.col("run"), F.col("seq")]
    dealt = captures.repartitionByRange(*order).sortWithinPartitions("run", "seq")
    return written(dealt.mapInArrow(run, _CAPTURE).withColumn("place", F.monotonically_increasing_id()), "index")


def archive(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Writes ``pages`` as archives (into ``path``, or a new folder of the shared one), reads
    them back and returns the merged index, one row per row of ``pages``. An empty table
    gives no rows. See ``write_archive`` for nulls and repeated rows."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, **kw)
    return merge_index(written(read_captures(pages.sparkSession, path), "captures"))  # the archives are read once


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what the archives say of every page."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The contract, stated over the table.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first,
    row_number() over (partition by payload_digest order by page_id nulls last) as nth from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and nth > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and nth > 1 then first end as refers_to
from f
"""
