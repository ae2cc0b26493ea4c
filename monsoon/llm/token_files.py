"""Token counts of flat token files by a separator scan.

A token file is nothing but token ids of two bytes, big-endian, in which an end-of-document id closes every document; there
is no index. Files are cut into blocks of equal size wherever documents begin. Each block is read and searched for the
separator as one vector; it yields the lengths of its pieces. A prefix scan over the numbers of separators, first inside
groups of blocks, then over groups, gives every piece the number of its document, and the pieces of documents that
cross blocks are added up. So a file or a document of any size is handled in bounded memory.

``write_files`` makes such files with Spark's text writer: a row is the bytes of a document, and the writer's line
separator is the end-of-document id, 50304 by default (the size to which vocabularies of about 50,000 are padded), whose two
bytes are one UTF-8 character. So files are committed like any of Spark's. As a flat file names no documents, each can start
with ``HEADER`` ids that spell its doc_id; the scan reads them where a document begins, past the end of the block if
need be, and leaves them out of the counts.

Defined results: null and empty texts have 0 tokens; a null doc_id stays null; equal rows are documents of their own; an
empty table gives an empty result; extra columns are ignored. A last document without a separator counts if it has a
token. An odd byte at the end of a file is ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monsoon.session import cut_lineage, ensure_checkpoint_dir

END = 50_304
ID = np.dtype(">u2")
#: Ids that spell a doc_id, in base BASE, all below END.
HEADER, BASE = 5, 50_000
BLOCK = 8 << 20
GROUP = 1024


def header(doc_id: int | None) -> list[int]:
    """0 for null, else one more than the id as an unsigned number."""
    rest, out = 0 if doc_id is None else (doc_id % 2**64) + 1, []
    for _ in range(HEADER):
        rest, digit = divmod(rest, BASE)
        out.append(digit)
    return out


def doc_id_of(ids: np.ndarray) -> int | None:
    value = sum(int(d) * BASE**i for i, d in enumerate(ids)) - 1
    return None if value < 0 else value - 2**64 if value >= 2**63 else value


def separator(end: int) -> str:
    """The end-of-document id as the character that the writer puts after each row."""
    return np.array([end], ID).tobytes().decode("utf-8")


_ENCODINGS: dict[tuple[str, int], object] = {}


def _encoding(vocabulary: bytes, pattern: str):
    """A worker keeps the encoding for its later tasks."""
    import tiktoken

    key = (pattern, hash(vocabulary))
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def write_files(docs: DataFrame, path: str, vocabulary: str, pattern: str, end: int = END) -> None:
    """Tokenize every whole text; ``vocabulary`` is a tiktoken file that the driver reads (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value, pattern)
        for b in batches:
            for begin in range(0, len(b), 256):
                part = b.slice(begin, 256)
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encoding.encode_ordinary(text) if text else []
                    out.append(np.array(header(doc) + ids, ID).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.text(path, lineSep=separator(end))


def _open(uri: str):
    """The file behind a path as Spark names it, in any store that pyarrow opens."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def pieces(ids: np.ndarray, size: int, end: int, first: bool, head: int) -> tuple[list[int], list[int | None]]:
    """Lengths of the pieces of the first ``size`` ids, and the doc_id of each that starts here (else null).

    ``ids`` goes past the block by the ids that a header may need.
    """
    at = np.flatnonzero(ids[:size] == end)
    starts = np.r_[0, at + 1]
    lengths = np.r_[at, size] - starts
    found: list[int | None] = []
    for i, s in enumerate(starts.tolist()):
        own = ids[s : s + head]
        begins = (i > 0 or first) and head > 0 and len(own) == head and end not in own
        found.append(doc_id_of(own) if begins else None)
    return lengths.tolist(), found


def _scan(end: int, head: int):
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("lengths", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, start, size in zip(*(b.column(c).to_pylist() for c in ("file", "block", "start", "size"))):
                with _open(file) as f:
                    data = f.read_at(size + head * ID.itemsize, start)
                ids = np.frombuffer(data, ID, len(data) // ID.itemsize).astype(np.int64)
                lengths, found = pieces(ids, size // ID.itemsize, end, start == 0, head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((file, block, lengths, found), schema)], schema=schema
                )

    return scan


def scan_files(spark: SparkSession, path: str, end: int = END, head: int = HEADER, block: int = BLOCK) -> DataFrame:
    """Every document of the files: file, number (from 0 in its file), doc_id, n_tokens."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    length = F.col("length") - F.col("length") % ID.itemsize
    count = F.ceil(length / block)
    blocks = files.filter(length > 0).select(
        "file", length.alias("length"), F.explode(F.sequence(F.lit(0), count - 1)).alias("block")
    )
    blocks = blocks.withColumn("start", F.col("block") * block)
    blocks = blocks.withColumn("size", F.least(F.lit(block), F.col("length") - F.col("start")))
    scanned = blocks.repartition("file", "block").mapInArrow(
        _scan(end, head), "file string, block bigint, lengths array<bigint>, ids array<bigint>"
    )
    scanned = scanned.withColumn("ends", F.size("lengths") - 1).withColumn("part", F.floor(F.col("block") / GROUP))
    scanned = cut_lineage(scanned)  # the lengths are read three times below, the files once
    # The prefix scan: inside a group of blocks, and over the groups of a file.
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    groups = scanned.groupBy("file", "part").agg(F.sum("ends").alias("ends"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "part", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("offset"))
    placed = scanned.withColumn("inside", F.coalesce(F.sum("ends").over(before), F.lit(0))).join(groups, ["file", "part"])
    each = placed.select(
        "file", "ends", (F.col("inside") + F.col("offset")).alias("first"),
        F.posexplode_outer(F.arrays_zip("lengths", "ids")).alias("i", "piece"),
    ).select(
        "file", (F.col("first") + F.col("i")).alias("number"), F.col("piece.ids").alias("doc_id"),
        F.col("piece.lengths").alias("length"), (F.col("i") < F.col("ends")).alias("ended"),
        ((F.col("i") > 0) & (F.col("i") < F.col("ends"))).alias("whole"),
    )
    whole = each.filter("whole").select("file", "number", "doc_id", "length")
    stitched = each.filter("not whole").groupBy("file", "number").agg(
        F.max("doc_id").alias("doc_id"), F.sum("length").alias("length"), F.max("ended").alias("ended")
    )
    stitched = stitched.filter("ended or length > 0").select("file", "number", "doc_id", "length")
    return whole.unionByName(stitched).select("file", "number", "doc_id", (F.col("length") - head).alias("n_tokens"))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, in the store that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/token-files/{uuid.uuid4().hex}"


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every document, by way of token files."""
    path = fresh_folder(docs.sparkSession)
    write_files(docs, path, vocabulary, pattern)
    return scan_files(docs.sparkSession, path, block=block)
