"""Deterministic sharded WARC archives: written, committed and read back.

Pages are cut into ranges of page ids with about equal bytes (``range_cuts``: exact histograms, so the cuts
follow from the data alone), dealt out by range and sorted inside each. A range's records go to gzip members
of files that roll once they hold ``roll_bytes`` compressed bytes. Headers, lengths and digests are made
anew for every record. Every file is written under a temporary name; the names, sizes and digests of the
files of successful tasks are Spark's own committed manifest, and only its files are then renamed. A task
that runs again writes other temporary names, and renaming is idempotent, so lost executors leave no trace.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the smallest page id is a
response and the others revisit it; smaller ones are all responses.

Defined cases: a null payload is empty; a null page id is larger than any other (a group of null ids only
has responses only); repeated rows of one page id and payload get the same type and consecutive record ids;
line breaks in a URL are percent-encoded; an empty table makes an archive without files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import fresh_path, small_batches, spread_join, stored

MIN_REVISIT = 100
ROLL_BYTES = 256 << 20
SHARD_BYTES = 1 << 30
#: Ranges for each shuffle partition at least, so that ranges even out over tasks.
SHARDS_PER_PARTITION = 4
#: Bytes of pages that a task sorts and packs, or of archives that one reads, at most on average.
PARTITION_BYTES = 256 << 20
FEWEST_BINS = 16
LEVEL = 6
#: Fixed values of the records: the date of the archive and the text of the HTTP header.
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
READ_BYTES = 1 << 20

MANIFEST = "shard bigint, part int, temporary string, name string, bytes bigint, records bigint, sha256 string"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, file string, intact boolean"


def range_cuts(sizes: DataFrame, target: int) -> np.ndarray:
    """First ids of ranges with about ``target`` bytes each, from (page_id, size); null ids count nowhere.

    A histogram of equal ranges of ids is refined where a bin is too heavy, until every bin is light or one id wide.
    A range gets bins in proportion to its bytes, FEWEST_BINS at least, so that what reaches the driver grows with the
    number of cuts; a row finds its bin by binary search in the open ranges, without a join.
    """
    spark = sizes.sparkSession
    known = sizes.filter(F.col("page_id").isNotNull())
    ends = known.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum("size").alias("size")).first()
    if ends["lo"] is None:
        return np.zeros(0, np.int64)
    open_, light = [(int(ends["lo"]), int(ends["hi"]) + 1, int(ends["size"]))], []
    while open_:
        counts = [max(FEWEST_BINS, -(-4 * size // target)) for _, _, size in open_]
        widths = [max(1, -(-(hi - lo) // n)) for (lo, hi, _), n in zip(open_, counts)]
        starts = np.concatenate([[0], np.cumsum(counts)])
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in open_], np.int64), np.array([r[1] - 1 for r in open_], np.int64), np.array(widths, np.uint64), starts[:-1]))

        @F.pandas_udf("bigint")
        def bin_of(page_id: pd.Series) -> pd.Series:
            low, last, width, start = sent.value
            ids = page_id.to_numpy("int64")
            at = np.searchsorted(low, ids, "right") - 1
            inside = (at >= 0) & (ids <= last[at])
            # unsigned differences: ids may span all of 64 bits
            steps = (ids.astype(np.uint64) - low[at].astype(np.uint64)) // width[at]
            return pd.Series(np.where(inside, start[at] + steps.astype(np.int64), -1))

        heavy = []
        for r in known.groupBy(bin_of("page_id").alias("bin")).agg(F.sum("size").alias("size")).filter("bin >= 0").orderBy("bin").collect():
            i = int(np.searchsorted(starts, r["bin"], "right")) - 1
            first = open_[i][0] + (r["bin"] - int(starts[i])) * widths[i]
            last = min(first + widths[i], open_[i][1])
            (heavy if r["size"] > target and last - first > 1 else light).append((first, last, int(r["size"])))
        open_ = heavy
    cuts, held = [], target
    for first, _, size in sorted(light):
        if held + size > target:
            cuts.append(first)
            held = 0
        held += size
    return np.array(cuts, np.int64)


def _header(kind: str, page_id: int | None, again: int, url: str | None, digest: str, block: bytes, refers_to: int | None) -> bytes:
    def urn(i: int | None, n: int = 0) -> str:
        return f"<urn:page:{'none' if i is None else i}{f':{n}' if n else ''}>"

    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id, again)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class _Files:
    """The files of one shard; each is closed with its manifest row."""

    def __init__(self, store: pafs.FileSystem, folder: str, shard: int, roll: int) -> None:
        self.store, self.folder, self.shard, self.roll = store, folder, shard, roll
        self.part, self.out = 0, None

    def write(self, record: bytes) -> dict | None:
        if self.out is None:
            self.name = f"{self.shard:08d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)
        self.records += 1
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.part = None, self.part + 1
        return {"shard": self.shard, "part": self.part - 1, "temporary": self.temporary, "name": self.name, "bytes": self.bytes, "records": self.records, "sha256": self.sha.hexdigest()}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archive below ``path`` (shared by all executors) and returns its committed manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    facts = stored(base.select("page_id", "digest", "size"), "warc-facts")
    total = facts.agg(F.sum(F.col("size") + 500)).first()[0] or 0
    n = max(n, -(-total // PARTITION_BYTES))
    target = max(1, min(shard_bytes, -(-total // (SHARDS_PER_PARTITION * n))))
    cuts = range_cuts(facts.select("page_id", (F.col("size") + 500).alias("size")), target)
    sent = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("bigint")
    def shard_of(page_id: pd.Series, spread: pd.Series) -> pd.Series:
        missing = page_id.isna().to_numpy()
        ids = page_id.fillna(0).astype("int64").to_numpy()
        at = np.maximum(np.searchsorted(sent.value, ids, "right") - 1, 0)
        return pd.Series(np.where(missing, len(sent.value) + spread.to_numpy() % n, at))

    shard = shard_of(F.col("page_id"), F.abs(F.xxhash64("digest") % 1_000_003))
    # neighbouring shards share a task, as many in each; those without ids follow one by one
    task = F.when(F.col("shard") < len(cuts), F.expr(f"shard * {n} div {max(1, len(cuts))}")).otherwise(F.col("shard") - len(cuts)).cast("int")
    groups = facts.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) & F.col("first").isNotNull())
    groups = stored(groups, "warc-digests")
    # any share of the pages may have one payload: such pages are dealt by their ids
    later = spread_join(facts, groups.select("digest", "first"), ["digest"], groups, ["page_id"], "inner").filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = base.select("page_id", "digest", F.lit(1).alias("kind"), "url", F.col("payload").cast("binary").alias("payload"), F.lit(None).cast("bigint").alias("refers_to"))
    notes = later.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    dealt = rows.unionByName(notes).withColumn("shard", shard).repartitionById(n, task).sortWithinPartitions("shard", "page_id", "digest", "kind")
    store, folder = _store(path)
    store.create_dir(f"{folder}/_temporary", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _store(path)
        files, refers, last, again = None, None, None, 0
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if files is None or files.shard != row["shard"]:
                    if files:
                        done.append(files.close())
                    files, last = _Files(where, root, row["shard"], roll_bytes), None
                key = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    refers = (key, row["refers_to"])
                    continue
                again = again + 1 if last is not None and last == (row["page_id"],) else 0
                last = (row["page_id"],)
                target_page = refers[1] if refers and refers[0] == key else None
                head = HTTP.format(len(row["payload"])).encode()
                block = head if target_page is not None else head + row["payload"]
                header = _header("response" if target_page is None else "revisit", row["page_id"], again, row["url"], row["digest"], block, target_page)
                done.append(files.write(header + block + b"\r\n\r\n"))
            done = [d for d in done if d]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)
                done = []
        if files:
            done.append(files.close())
        done = [d for d in done if d]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)

    temporary = dealt.select("shard", "page_id", "digest", "kind", "url", "payload", "refers_to").mapInArrow(write, MANIFEST)
    temporary.write.parquet(f"{path}/_manifest-temporary")
    committed = spark.read.schema(T._parse_datatype_string(MANIFEST)).parquet(f"{path}/_manifest-temporary")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                if where.get_file_info(f"{root}/{row['name']}").size != row["bytes"]:
                    where.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
            yield batch

    committed.repartition(n, "name").mapInArrow(commit, MANIFEST).write.parquet(f"{path}/_manifest")
    return spark.read.schema(T._parse_datatype_string(MANIFEST)).parquet(f"{path}/_manifest")


_MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])


def members(source: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file one by one, read in pieces."""
    left = b""
    while True:
        unpack = zlib.decompressobj(31)
        out = []
        while not unpack.eof:
            if not left:
                left = source.read(READ_BYTES)
                if not left:
                    if out:
                        raise ValueError("the archive ends within a record")
                    return
            out.append(unpack.decompress(left))
            left = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse(record: bytes) -> dict:
    """Header fields, payload facts and digests of one record; payload is that of a response."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    intact = fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and rest[len(block) :] == b"\r\n\r\n"
    if kind == "response":
        intact = intact and stated == len(payload) and hashlib.sha256(payload).hexdigest() == digest
    number = lambda urn: None if urn.split(":")[2].rstrip(">") == "none" else int(urn.split(":")[2].rstrip(">"))
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": stated, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "record_id": fields["WARC-Record-ID"], "intact": intact, "payload": payload if kind == "response" else None}


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the committed files; with ``payloads`` also the responses' bytes."""
    schema = RECORDS + (", payload binary" if payloads else "")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("intact", pa.bool_()), *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    for record in members(source):
                        rows.append(parse(record) | {"file": name})
                        held += len(record) if payloads else 500
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in arrow.names} for r in rows], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in arrow.names} for r in rows], schema=arrow)

    manifest = spark.read.schema(T._parse_datatype_string(MANIFEST)).parquet(f"{path}/_manifest")
    packed = manifest.agg(F.sum("bytes")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packed // PARTITION_BYTES))
    return manifest.select("name").repartition(n, "name").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads it back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
