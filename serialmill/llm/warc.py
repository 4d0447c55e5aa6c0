"""Web archives and a Merkle audit of their replicas.

Pages become WARC resource records, dealt by ranges of page id to files and laid end to end in each:
every record has its number, offset and length there. For a replica, a leaf hash binds a record's digest
to its offset range; parents hash up to FANOUT children in order, up to one root for each file. The tree
has as many levels as its largest file needs. An audit joins the roots of two replicas and goes down only
below hashes that differ, level by level, to the records that are altered, missing or extra; it ends as
soon as a level agrees. Levels and differing branches are written to the shared folder, so a plan never
holds more than one level.

Defined results: null urls and pages count as empty; records with equal ids are told apart by their place,
repeated rows have one record each, in any order; null page ids come first; very long pages are one
record; columns other than the three named are not read, whatever their names; two empty replicas agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import materialise, ship_code

FANOUT = 64
CAPTURED = "1970-01-01T00:00:00Z"  # the capture date of pages that have none

RECORD_SCHEMA = "file int, seq bigint, offset bigint, length bigint, page_id bigint, record binary"


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "replace")
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {CAPTURED}\r\n"
        f"WARC-Target-URI: {url or ''}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + body + b"\r\n\r\n"


def _lay_out(batches):
    file, seq, offset = TaskContext.get().partitionId(), 0, 0
    names = ["file", "seq", "offset", "length", "page_id", "record"]
    for b in batches:
        rows = []
        for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
            r = record_bytes(i, u, h)
            rows.append((file, seq, offset, len(r), i, r))
            seq, offset = seq + 1, offset + len(r)
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records of all pages, written to the shared folder and read back."""
    ship_code(pages.sparkSession)
    tie = F.xxhash64("u", "h")
    ranged = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).repartitionByRange("k", tie)
    return materialise(ranged.sortWithinPartitions("k", tie).mapInArrow(_lay_out, RECORD_SCHEMA))


def leaves(records: DataFrame) -> DataFrame:
    digest = F.sha2("record", 256)
    return records.select("file", F.col("seq").alias("idx"), "page_id", "offset", "length", digest.alias("digest"), F.sha2(F.concat_ws(":", digest, "offset", "length"), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """One level up; groups have FANOUT rows at most."""
    children = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    up = nodes.groupBy("file", F.expr(f"idx div {FANOUT}").alias("idx")).agg(children.alias("c"))
    return up.select("file", "idx", F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["idx"], x["hash"]))), 256).alias("hash"))


def levels_of(*leaf_tables: DataFrame) -> int:
    """Levels above the leaves, so that one node covers the largest file of all tables."""
    top = max((t.agg(F.max("idx")).first()[0] or 0) for t in leaf_tables)
    n = 1
    while top >= FANOUT**n:
        n += 1
    return n


def tree(leaf_table: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the leaves to the files' roots, each written once; a level has one FANOUT-th of the rows of the one below."""
    out = [leaf_table]
    for _ in range(levels):
        out.append(materialise(parents(out[-1])))
    return out


ON = ["file", "idx"]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where two levels differ, or that only one has."""
    return a.join(b.withColumnRenamed("hash", "other"), ON, "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select(*ON)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records of the replica that differ: file, seq, offset, length, page_id, status, expected_sha256, actual_sha256."""
    one, two = materialise(leaves(primary)), materialise(leaves(replica))
    n = levels_of(one, two)
    ups = [tree(x.select(*ON, "hash"), n) for x in (one, two)]
    bad = None
    for level in range(n, 0, -1):
        a, b = ups[0][level], ups[1][level]
        if bad is not None:
            a, b = _below(a, bad), _below(b, bad)
        bad = materialise(_differing(a, b))
        if bad.isEmpty():
            break
    a, b = _below(one, bad), _below(two, bad)
    b = b.select(*ON, *[F.col(c).alias(f"r_{c}") for c in ("page_id", "offset", "length", "digest", "hash")])
    found = a.join(b, ON, "full").where(~F.col("hash").eqNullSafe(F.col("r_hash")))
    status = F.when(F.col("r_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("altered")
    either = lambda c: F.coalesce(c, f"r_{c}").alias(c)
    return found.select("file", F.col("idx").alias("seq"), either("offset"), either("length"), either("page_id"), status.alias("status"), F.col("digest").alias("expected_sha256"), F.col("r_digest").alias("actual_sha256"))


def _below(nodes: DataFrame, bad: DataFrame) -> DataFrame:
    up = bad.select(F.col("file").alias("f"), F.col("idx").alias("p"))
    return nodes.join(up, (F.col("file") == F.col("f")) & (F.expr(f"idx div {FANOUT}") == F.col("p")), "left_semi")


def _every(n: int) -> Column:
    return F.coalesce(F.col("page_id") % n == 0, F.lit(False))


def rotten(records: DataFrame) -> DataFrame:
    """A replica with planted damage: every 97th page has a byte changed, every 101st is missing, every 103rd has a second record behind its file's end."""
    kept = records.where(~_every(101))
    changed = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit(b"\x00"), F.expr("substring(record, length(record) - 3, 4)"))
    held = kept.withColumn("record", F.when(_every(97), changed).otherwise(F.col("record")))
    ends = records.groupBy("file").agg((F.max("seq") + 1).alias("n"), F.sum("length").alias("end"))
    stray = records.where(_every(103)).join(ends, "file").withColumn("seq", F.col("seq") + F.col("n")).withColumn("offset", F.col("offset") + F.col("end"))
    return held.unionByName(stray.select(*held.columns))


ORACLE = f"""
WITH r AS (
  SELECT page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: {CAPTURED}' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
)
SELECT page_id, CASE WHEN page_id % 101 = 0 THEN 'missing' ELSE 'altered' END AS status,
  octet_length(encode(record))::BIGINT AS length, sha256(record) AS expected_sha256
FROM r WHERE page_id % 97 = 0 OR page_id % 101 = 0
UNION ALL SELECT page_id, 'extra', octet_length(encode(record))::BIGINT, NULL FROM r WHERE page_id % 103 = 0
"""
