"""WARC archives through Spark's own writers, revisit records, and a merged capture index.

A record ends with CRLF CRLF, so the text sink writes a valid WARC file of records given as rows, on any
file system Spark knows, with Spark's task commit: a task that runs again replaces its file.  Files are
gzip streams, one for each archive.  Reading takes whole files, one at a time, bounded in bytes: records go by size class, and an archive of
larger records holds fewer, down to one.

The index follows the external merge: each archive yields a run sorted by (URL key, timestamp, page);
runs are dealt by key range, and within a range a loser tree merges the k run slices.  Ranges come from
Spark's sampled range partitioning on the whole sort key, so the captures of one URL may span ranges; there are so many
that a range holds about `PER_RANGE` records whatever their number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Stages, small_batches

LEAST_REVISIT = 1000
#: Records of an archive, of at most SMALL bytes each; of larger ones half as many for each doubling.
PER_FILE, SMALL = 2000, 1 << 15
#: Records that one task merges.
PER_RANGE = 200_000
#: Captures are dated by the second from here on, by page, over some thirty years.
FIRST, SPAN = 1704067200, 10**9
HEAD_END = b"\r\n\r\n"
#: Record id: a URN that carries the page.
URN = "urn:warc-page:"


def warc_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages plus digest, n_bytes and refers_to; equal payloads of `least` bytes or more refer to the largest page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    known = rows.filter(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    known = known.filter("n > 1").select("digest", "n_bytes", "last")
    joined = rows.join(known, ["digest", "n_bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("last") > F.col("page_id"), F.col("last"))).drop("last")


def write_warc(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """One text row per record; the sink adds the closing CRLF CRLF."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), page, F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.octet_length(block) / SMALL))).cast("int")
    for c in sorted(r[0] for r in records.select(size.alias("c")).distinct().collect()) or [0]:  # 16 classes below 1 GB
        some = records.filter(size == c).select(record.alias("value"))
        some.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, per_file >> c)).mode("overwrite").text(f"{path}/class={c}")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview, int]]:
    """Headers, block and offset of each record, by Content-Length alone: a block may hold anything."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(HEAD_END, at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = end + 4
        stop = block + int(head["Content-Length"])
        if data[stop : stop + 4] != HEAD_END:
            raise ValueError(f"record at {at} doesn't end where it says")
        yield head, view[block:stop], at
        at = stop + 4


def url_key(url: str) -> str:
    """Sort key: host labels reversed, then the path and query, lower case."""
    try:
        u = urlsplit(url.strip().lower())
        host = u.hostname or ""
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return f"{','.join(reversed(labels))}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive string, offset long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path; each archive's records come sorted by (url_key, captured, page_id).

    A response's payload is hashed again and held against its header; a revisit states those of the response.
    """
    import gzip

    number = lambda s: None if s.strip("<>").removeprefix(URN) == "null" else int(s.strip("<>").removeprefix(URN))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, archive = [], name.rsplit("/", 1)[-1]
                for head, block, at in parse(gzip.decompress(data)):
                    revisit = head["WARC-Type"] == "revisit"
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if not revisit and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    refers = number(head["WARC-Refers-To"]) if revisit else None
                    rows.append((number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, url_key(head["WARC-Target-URI"]), head["WARC-Date"], archive, at))
                rows.sort(key=lambda r: (r[5], r[6], r[0] is not None, r[0] or 0))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, READ)


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, so the next winner takes one path of log k matches."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.heads[i := self.tree[0]] is not None:
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merged_index(records: DataFrame, partitions: int) -> DataFrame:
    """Capture histories in global order of (url_key, captured, page_id), over the partitions in their order."""
    order = ["url_key", "captured", "page_id", "archive", "offset"]
    dealt = records.repartitionByRange(partitions, *order).sortWithinPartitions("archive", *order[:3])

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        archive = table.column("archive").to_pylist()
        starts = [0, *(i for i in range(1, len(archive)) if archive[i] != archive[i - 1]), len(archive)]
        cols = [table.column(c).to_pylist() for c in order[:3]]
        key = lambda i: (cols[0][i], cols[1][i], cols[2][i] is not None, cols[2][i] or 0, i)
        tree = LoserTree([map(key, range(a, b)) for a, b in zip(starts, starts[1:])])
        take = np.fromiter((k[-1] for k in tree), np.int64, len(archive))
        yield from table.take(pa.array(take)).combine_chunks().to_batches()

    return dealt.mapInArrow(run, READ)


def capture_index(spark: SparkSession, pages: DataFrame, least: int = LEAST_REVISIT, per_file: int = PER_FILE) -> DataFrame:
    """Write pages as WARC, read the archives back, merge their sorted runs.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive, offset.  Null html is an
    empty payload, a null url an empty key.  A null page_id stays null and is never referred to unless no other
    has its payload.  Rows that repeat a page_id and payload are both responses.  Other columns are ignored.
    """
    small_batches(spark)
    st = Stages(spark, "warc")
    write_warc(st.put("pages", warc_records(pages, least)), st.path("archives"), per_file)
    st.drop("pages")
    # one archive in a batch: a worker holds no more
    records = st.put("records", read_warc(spark, st.path("archives")), 1)
    return merged_index(records, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // PER_RANGE)))
