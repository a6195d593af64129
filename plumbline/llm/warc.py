"""WARC files written as sorted runs, read back, and their indexes merged into one global order."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, new_path

#: Smaller payloads are never revisits.
LEAST_REVISIT_BYTES = 100
#: A run holds as many records as make so many bytes of payload on average.
RUN_BYTES = 64_000_000
#: Index rows for each task that merges runs, at most.
MERGE_ROWS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

INDEX = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, url_key string, captured_at string, warc_file string, warc_offset long, warc_length long, run_place long"
)


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query: captures of a site sort together.

    Without scheme, user, port, a leading www. and the fragment; in lower case. Null counts as empty.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*", 0), r"^.*@|:\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.concat(
        F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    )


def record_id(name: Column) -> Column:
    digest = F.md5(name)
    part = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; without a value, nothing. Line breaks in a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", " "), F.lit("\r\n")), F.lit(""))


def warc_records(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None
) -> DataFrame:
    """(record, url_key, captured_at, page_id): each page as the text of a WARC record without its end.

    Of pages with equal payloads of LEAST_REVISIT_BYTES or more the one with the smallest id is a
    response and the others are revisits without a payload. time: when a page was captured; by default
    as many seconds after the start of 2024 as its id says.
    """
    page = F.col(f"`{id_col}`").cast("long")
    if time is None:
        time = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(page, F.lit(0)))
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    # as a header can hold it, so that the runs are in the order of the keys that are read back
    url = F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\r\n]", " ")
    source = pages.select(
        page.alias("page_id"),
        url.alias("url"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n"),
    )
    first = (
        source.where(F.col("n") >= LEAST_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("of_digest"), "first_id")
    )
    linked = source.join(first, F.col("digest") == F.col("of_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    linked = linked.select("*", revisit.alias("revisit"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit("\r\n\r\n"),
        F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")),
    )
    linked = linked.withColumn("block", http)
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(F.col("revisit"), F.col("first_id"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", record_id(F.concat_ws("|", F.lit("page"), F.col("page_id").cast("string")))),
        _header("WARC-Date", F.col("captured_at")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.concat_ws("|", F.lit("page"), refers.cast("string"))))),
        _header("X-Page-ID", F.col("page_id")),
        _header("X-Refers-To-Page-ID", refers),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return linked.select(record.alias("record"), url_key(F.col("url")).alias("url_key"), "captured_at", "page_id")


#: What the text writer puts behind each record: a gzip member of nothing, which readers pass over.
_NOTHING = gzip.compress(b"", mtime=0)


def write_runs(records: DataFrame, path: str, run_records: int) -> None:
    """Write WARC files, each sorted by URL key and time and with a gzip member for each record.

    Spark writes them as text, so that a store that only Spark reaches will do: the bytes of a member count as a
    line, and its end is an empty member.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip.compress(record.as_buffer().to_pybytes() + b"\r\n\r\n", mtime=0) for record in batch.column("record")]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["record"])

    ordered = records.sortWithinPartitions("url_key", "captured_at", "page_id").select(F.col("record").cast("binary"))
    (
        ordered.mapInArrow(packed, "record binary")
        .select(F.col("record").cast("string"))
        .write.option("lineSep", _NOTHING.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", run_records)
        .text(path)
    )


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; the block's length comes from the headers, never from the content."""
    head_end = data.index(b"\r\n\r\n")
    lines = data[:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = head_end + 4 + int(headers["Content-Length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    return headers, data[head_end + 4 : end]


def read_members(packed: bytes, at: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """(content, offset, length) of each gzip member that holds something, one after another, from an offset on."""
    view = memoryview(packed)
    while at < len(view):
        member = zlib.decompressobj(wbits=31)
        data, end = [], at
        while not member.eof:
            if end >= len(view):
                raise ValueError(f"the member at {at} is cut short")
            data.append(member.decompress(view[end : end + 4096]))
            end += 4096
        end = min(end, len(view)) - len(member.unused_data)
        if any(data):
            yield b"".join(data), at, end - at
        at = end


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of the WARC files under path, from their content (INDEX columns but url_key)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for place, (data, offset, length) in enumerate(read_members(packed.as_buffer())):
                    headers, block = parse_record(data)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(head.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if headers["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload at {offset} of {name.as_py()}")
                    rows.append(
                        (
                            _number(headers.get("X-Page-ID")),
                            n,
                            digest,
                            headers["WARC-Type"],
                            _number(headers.get("X-Refers-To-Page-ID")),
                            headers.get("WARC-Target-URI"),
                            headers["WARC-Date"],
                            name.as_py().rpartition("/")[2],
                            offset,
                            length,
                            place,
                        )
                    )
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(columns, fields, strict=True)],
                    [f for f, _ in fields],
                )

    fields = [tuple(f.split()) for f in INDEX.split(", ") if not f.startswith("url_key")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(index, ", ".join(" ".join(f) for f in fields)).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its two sides, so an item costs log2(runs) comparisons."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.n = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.n)
        for k in range(self.n - 1, -1, -1):
            self._play(k)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _play(self, k: int) -> None:
        at = (k + self.n) // 2
        while at > 0:
            if self.losers[at] < 0:
                self.losers[at] = k
                return
            if self._beats(self.losers[at], k):
                k, self.losers[at] = self.losers[at], k
            at //= 2
        self.losers[0] = k

    def __iter__(self) -> Iterator:
        while self.n and self.heads[k := self.losers[0]] is not None:
            yield self.heads[k]
            self.heads[k] = next(self.runs[k], None)
            self._play(k)


def merge_index(index: DataFrame) -> DataFrame:
    """The index in one global order by URL key, time and page: partition after partition, row after row.

    Partitions take ranges of the whole key with about MERGE_ROWS rows at most, so a URL with very many captures
    is split among them. In a partition the slices of the runs, each in the order of its file, meet in a loser
    tree. index must be a stored table.
    """
    rows = index.count()
    usual = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(usual, rows // 1000 + 1), rows // MERGE_ROWS + 1)
    names = index.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        files = table.column("warc_file").to_pylist()
        keys = [
            (key, time, page is not None, page or 0)
            for key, time, page in zip(*(table.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True)
        ]
        starts = [k for k in range(len(files)) if not k or files[k] != files[k - 1]]
        runs = ([(keys[k], k) for k in range(a, b)] for a, b in zip(starts, [*starts[1:], len(files)], strict=True))
        order = pa.array([k for _, k in LoserTree(runs)], pa.int64())
        yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)

    dealt = index.repartitionByRange(parts, "url_key", "captured_at", "page_id").sortWithinPartitions("warc_file", "run_place")
    return dealt.select(*names).mapInArrow(merge, index.schema)


def archive_pages(pages: DataFrame, *, path: str | None = None, **columns) -> DataFrame:
    """Write pages as WARC runs under path, read them back, and give the merged index (INDEX columns).

    Nulls: a null html is an empty payload, a null url an empty key without a header, a null page_id stays
    null, sorts first, is a revisit if its payload has another id to refer to, and a response else. Rows
    that repeat the smallest id are all responses. Extra columns are not written. An empty table gives none.
    """
    path = path or new_path(pages.sparkSession, "warc")
    html = F.octet_length(F.col(f"`{columns.get('html_col', 'html')}`").cast("string"))
    mean = pages.agg(F.avg(F.coalesce(html, F.lit(0)))).first()[0] or 0
    write_runs(warc_records(pages, **columns), path, max(1, int(RUN_BYTES / (mean + 1000))))
    return merge_index(materialize(read_runs(pages.sparkSession, path), "index"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
