"""Exact duplicates through an extendible-hash index kept in files of the shared folder.

The index maps the 64-bit hash of a normalised text to a bucket by the hash's leading bits. The
directory starts small and doubles until no bucket holds more than its capacity; a split gives the
overfull bucket one more bit, the others just get two directory entries. Buckets are key ranges, so
an owner task takes a run of neighbouring buckets, walks its entries in key order, chains different
texts that share a key, and tells them apart by comparing bytes.

Copies that one batch of documents holds enter the index once, with the ids they stand for. So a
text that fills a third of the corpus costs one entry per batch, and its ids are matched with the
group's totals by a join that Spark may split.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, keep, scratch, slices

BUCKET_ENTRIES = 4096
#: A directory has at most two to this power entries; beyond, a bucket just grows.
MAX_DEPTH = 18

_ENTRIES = "key long, text binary, sha string, n long, ids array<long>"
_INDEX = "bucket int, key long, chain int, uid long, sha string, n long, ids array<long>"


def _entries(key_bits: int):
    """One entry per distinct text of a batch: key, normalised bytes, digest, ids in order."""
    mask = ((1 << key_bits) - 1) << (64 - key_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: dict[bytes, list] = {}
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                # bytes.lower() changes A-Z alone.
                found.setdefault((text or b"").lower(), []).append(doc_id)
            keys, shas, lists = [], [], []
            for text, ids in found.items():
                keys.append((xxhash.xxh64_intdigest(text) & mask) - (1 << 63))
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append(sorted(ids, key=lambda i: (i is not None, i or 0)))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(list(found), pa.binary()),
                pa.array(shas, pa.string()), pa.array([len(x) for x in lists], pa.int64()),
                pa.array(lists, pa.list_(pa.int64())),
            ], names=["key", "text", "sha", "n", "ids"])
    return run


def build_directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> np.ndarray:
    """Bucket number per directory entry; entry k holds the keys whose leading bits are k.

    `keys` has the column `key`: hashes moved down by 2**63, so that signed order is key order. Only
    counts per prefix reach the driver, at most four per bucket of the final directory at first
    and `2**max_depth` in all.
    """
    total = keys.count()
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, total / capacity)))) + 2))
    while True:
        prefix = F.shiftright(F.col("key"), 64 - depth) + 2 ** (depth - 1) if depth else F.lit(0)
        cells = np.zeros(1 << depth, np.int64)
        spread = np.zeros(1 << depth, bool)
        for row in keys.groupBy(prefix.alias("p")).agg(
                F.count("*").alias("n"), (F.min("key") < F.max("key")).alias("spread")).collect():
            cells[row["p"]], spread[row["p"]] = row["n"], row["spread"]
        if depth >= max_depth or not ((cells > capacity) & spread).any():
            break
        depth += 2
    directory, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    # Doubling: one bucket of all keys, split wherever it is overfull.
    sums = np.append(0, np.cumsum(cells))
    buckets = [(0, 1 << depth)]
    done = []
    while buckets:
        low, high = buckets.pop()
        if high - low == 1 or sums[high] - sums[low] <= capacity:
            done.append((low, high))
        else:
            middle = (low + high) // 2
            buckets += [(middle, high), (low, middle)]
    first = np.array([low for low, _ in done])
    size = np.array([high - low for low, high in done])
    directory = np.repeat(np.arange(len(first)), size)
    while len(directory) > 1 and (directory[::2] == directory[1::2]).all():
        directory = directory[::2]
    return directory


def bucket_of(directory: np.ndarray, key: str = "key"):
    """The bucket of a key, looked up in the directory by its leading bits."""
    depth = int(np.log2(len(directory)))
    if depth == 0:
        return F.lit(0)
    slots = F.split(F.lit(",".join(map(str, directory))), ",").cast("array<int>")
    slot = F.shiftright(F.col(key), 64 - depth) + 2 ** (depth - 1)
    return F.get(slots, slot.cast("int"))


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the texts that share a key. Entries come in key order; one chain is held at a time."""
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 33
    key, chain = None, []
    for batch in batches:
        links = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            text = text.as_buffer()
            if k != key:
                key, chain = k, []
            for i, other in enumerate(chain):
                if other.equals(text):
                    links.append(i)
                    break
            else:
                links.append(len(chain))
                chain.append(pa.py_buffer(text.to_pybytes()))
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            batch.column("bucket"), batch.column("key"), pa.array(links, pa.int32()),
            pa.array(np.arange(serial, serial + rows)), batch.column("sha"), batch.column("n"),
            batch.column("ids"),
        ], names=["bucket", "key", "chain", "uid", "sha", "n", "ids"])
        serial += rows


def write_index(docs: DataFrame, path: str, tables: Scratch, capacity: int = BUCKET_ENTRIES,
                key_bits: int = 64) -> DataFrame:
    """Build the index of `docs` (doc_id, text) under `path`, one folder per bucket; return it."""
    spark = docs.sparkSession
    entries = tables.table(docs.mapInArrow(_entries(key_bits), _ENTRIES))
    directory = build_directory(entries.select("key"), capacity)
    owners = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(directory[-1]) + 1)
    placed = entries.withColumn("bucket", bucket_of(directory))
    owner = F.floor(F.col("bucket") * owners / (int(directory[-1]) + 1)).cast("int")
    (placed.repartitionById(owners, owner).sortWithinPartitions("bucket", "key")
     .mapInArrow(_owner, _INDEX).write.partitionBy("bucket").parquet(path))
    return spark.read.schema(_INDEX).parquet(path)


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_ENTRIES,
                     key_bits: int = 64) -> DataFrame:
    """Which documents have the same text after lower-casing A-Z, and which of them stays.

    Reads `doc_id` (integer) and `text`; other columns are ignored. Returns a row per input row:
    doc_id, keep_id, group_size, kept, text_sha256. The row with the largest doc_id of a group
    stays. A null text counts as empty, so all null and empty texts are one group. If a row is
    repeated, exactly one of the rows with the largest doc_id is kept. A null doc_id is below all
    others: such a row stays only if its group has no id, and keep_id is null then. An empty table
    gives an empty table. `key_bits` below 64 makes collisions likely, for tests.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as tables:
        index = write_index(docs, f"{tables.root}/index", tables, capacity, key_bits)
        groups = index.groupBy("key", "chain").agg(
            F.sum("n").alias("group_size"),
            F.max(F.struct(F.element_at("ids", -1).alias("id"), "uid")).alias("top"))
        rows = (index.join(groups, ["key", "chain"])
                .select("sha", "group_size", "top", "uid", "n", F.posexplode("ids").alias("at", "doc_id")))
        return keep(rows.select(
            "doc_id", F.col("top.id").alias("keep_id"), "group_size",
            ((F.col("uid") == F.col("top.uid")) & (F.col("at") == F.col("n") - 1)).alias("kept"),
            F.col("sha").alias("text_sha256")))
