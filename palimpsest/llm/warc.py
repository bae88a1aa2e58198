"""WARC archives with revisit records, and their index merged into one order.

Writing: every page is one record. Of pages with equal payloads of 1000 bytes or more, the
one with the largest page_id is a response, the others are revisits that name it and carry
no payload. Records are text, so Spark's text writer makes the archives on any storage,
gzip-compressed. Records are written by classes of size, so an archive holds at most
64 MB of payload, or one record.

Reading: the archives come back as binary files and are taken apart record by record.
Payloads are hashed again and held against the digest they were written with.

Index: the captures of one archive are sorted by URL key, time and page: a run. Keys
sampled from all runs cut the order into ranges, and a task merges the pieces of all runs
that fall into its range with a loser tree. Ranges are cut within a URL too, so a URL or
host with very many captures is no task's burden.

Pages have no capture time, so it is made from page_id.

Defined cases: NULL html is an empty payload; rows that share the largest page_id of their
payload are all responses; a NULL page_id is a revisit when another page has its payload;
a NULL or unusual url gets a key all the same; control characters in it are percent-coded
in headers; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .neardup import _grouped
from .shared import in_batches, shared_folder, staged

MIN_REVISIT_BYTES = 1000
#: Payloads of up to so many bytes, and how many of them an archive holds; of larger ones it holds one.
ARCHIVE_CLASSES = ((64 << 10, 1000), (1 << 20, 64))
#: Captures of a range, and keys sampled for each, to find the bounds.
RANGE_ROWS = 100_000
SAMPLES_PER_RANGE = 20

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE_SCHEMA = (
    "run string, seq int, url_key string, captured_at string, page_id bigint, payload_bytes bigint,"
    " payload_digest string, record_type string, refers_to bigint"
)
MERGED_SCHEMA = (
    "range_no int, place bigint, url_key string, captured_at string, page_id bigint, payload_bytes bigint,"
    " payload_digest string, record_type string, refers_to bigint"
)


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, root: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a record for each page into archives below ``root``."""
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.col("bytes") >= min_revisit_bytes)
    kept = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND kept IS NOT NULL")
        .select("digest", "kept")
    )
    rows = rows.join(staged(kept, "kept"), "digest", "left")
    rows = rows.withColumn("kept", F.when(F.col("bytes") >= min_revisit_bytes, F.col("kept")))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    when = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        _id(F.col("page_id")),
        F.lit("\r\nWARC-Date: "),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _id(F.col("kept"))),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )
    above = -1
    for i, (up_to, together) in enumerate((*ARCHIVE_CLASSES, (None, 1))):
        mine = rows.where(F.col("bytes") > above)
        mine = mine if up_to is None else mine.where(F.col("bytes") <= up_to)
        records = mine.withColumn("block", block).select(F.concat(header, F.col("block")).alias("value"))
        (
            records.write.option("lineSep", END)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", together)
            .text(f"{root}/size_class={i}")
        )
        above = up_to


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and content block of every record of an archive."""
    end = END.encode()
    at = 0
    while at < len(data):
        head = data.index(end, at)
        first, *lines = data[at:head].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
        start = head + len(end)
        stop = start + int(fields["content-length"])
        if data[stop : stop + len(end)] != end:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, data[start:stop]
        at = stop + len(end)


def url_key(url: str) -> str:
    """The URL with its host turned round, as indexes of captures sort them: ``com,example,www)/path?query``."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    path = parts.path.lower() or "/"
    return ",".join(reversed(host.split("."))) + f"{port}){path}" + (f"?{parts.query.lower()}" if parts.query else "")


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("none", "") else int(number)


def capture(fields: dict[str, str], block: bytes) -> tuple:
    """What the index keeps of a record: url_key, time, page, bytes, digest, type, refers_to."""
    head, _, payload = block.partition(END.encode())
    size = int(head.decode().rpartition("Content-Length: ")[2])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"the payload of {fields['warc-record-id']} is not the one that was written")
    return (
        url_key(fields["warc-target-uri"]),
        fields["warc-date"],
        _page(fields["warc-record-id"]),
        size,
        digest,
        fields["warc-type"],
        _page(fields.get("warc-refers-to")),
    )


def order_of(key: tuple) -> tuple:
    """What captures are ordered by: URL key, time, page."""
    return key[0], key[1], key[2] is not None, key[2] or 0


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The captures of every archive, sorted: CAPTURE_SCHEMA, a run for each archive."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = zlib.decompress(content.as_buffer(), 31)
                found = sorted((capture(*r) for r in records(data)), key=order_of)
                columns = list(zip(*found, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
                yield pa.record_batch(
                    {
                        "run": pa.array([path.as_py()] * len(found), pa.string()),
                        "seq": pa.array(range(len(found)), pa.int32()),
                        **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)},
                    }
                )

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(root).select("path", "content")
    return staged(in_batches(archives, parse, CAPTURE_SCHEMA), "runs")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step is one path to the root."""

    def __init__(self, runs: Sequence[Iterator[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] or [None]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; an ended run never does, and ties go to the earlier run."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        first, second = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = second
        return first

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """Heads in order, each with the number of its run."""
        while self.head[self.winner] is not None:
            yield self.head[self.winner], self.winner
            now = self.winner
            self.head[now] = next(self.runs[now], None)
            node = (now + self.size) // 2
            while node >= 1:
                if self._before(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def merge_runs(runs: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with their place in the order of URL key, time and page, in MERGED_SCHEMA plus position."""
    spark = runs.sparkSession
    total = runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows))
    rate = min(1.0, SAMPLES_PER_RANGE * ranges / max(total, 1))
    drawn = F.pmod(F.xxhash64("run", "seq"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1)
    sampled = sorted(order_of(tuple(r)) for r in runs.where(drawn).select("url_key", "captured_at", "page_id").collect())
    bounds = sorted({sampled[len(sampled) * i // ranges] for i in range(1, ranges)}) if sampled else []
    shared = spark.sparkContext.broadcast(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True)
            number = [bisect.bisect_right(bounds, order_of(k)) for k in keys]
            yield batch.append_column("range_no", pa.array(number, pa.int32()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["range_no"]):
            rows = group.combine_chunks()
            run = rows.column("run").to_pylist()
            keys = [order_of(k) for k in zip(*(rows.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True)]
            cuts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
            pieces = [((keys[i], i) for i in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            order = [i for (_, i), _ in LoserTree(pieces)]
            merged = rows.take(pa.array(order)).drop_columns(["run", "seq"])
            merged = merged.add_column(1, "place", pa.array(range(len(order)), pa.int64()))
            yield from merged.combine_chunks().to_batches()

    columns = ["url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    numbered = in_batches(runs, cut, CAPTURE_SCHEMA + ", range_no int")
    dealt = numbered.repartition(ranges, "range_no").sortWithinPartitions("range_no", "run", "seq")
    merged = staged(in_batches(dealt.select("range_no", "run", "seq", *columns), merge, MERGED_SCHEMA), "histories")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    first = merged.groupBy("range_no").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return merged.join(F.broadcast(first.select("range_no", "first")), "range_no").withColumn(
        "position", F.col("first") + F.col("place")
    ).select("position", *columns)


def capture_histories(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Archive the pages, read the archives back, and return all captures in order with their position."""
    spark = pages.sparkSession
    root = root or shared_folder(spark, "archives")
    write_archives(pages, root)
    return merge_runs(read_runs(spark, root))


#: Keys are of URLs whose host is a name, as those of ``pages`` are; places are of pages with ids of their own.
SQL = f"""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           strftime(make_timestamp(CAST(1704067200 + coalesce(page_id, 0) % 1000000000 AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at,
           regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7F]', '%20', 'g') AS url
    FROM pages),
k AS (
    SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES}
    GROUP BY payload_digest HAVING count(*) > 1),
parts AS (
    SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:\\[\\]@]+)(?::([0-9]*))?(?:/[^?#]*|)(?:[?][^#]*)?(?:#.*)?$', ['host', 'port']) AS site,
           regexp_extract(url, '//[^/?#]*([^?#]*)(?:[?]([^#]*))?', ['path', 'query']) AS below
    FROM p LEFT JOIN k USING (payload_digest)),
keyed AS (
    SELECT *, CASE WHEN site.host = '' THEN url ELSE
        array_to_string(list_reverse(string_split(lower(site.host), '.')), ',')
        || CASE WHEN site.port = '' OR TRY_CAST(site.port AS INT) IN (80, 443) THEN '' ELSE ':' || TRY_CAST(site.port AS INT) END
        || ')' || CASE WHEN below.path = '' THEN '/' ELSE lower(below.path) END
        || CASE WHEN below.query = '' THEN '' ELSE '?' || lower(below.query) END END AS url_key
    FROM parts)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to,
       row_number() OVER (ORDER BY url_key, captured_at, page_id IS NOT NULL, page_id) - 1 AS position,
       url_key, captured_at
FROM keyed
"""
