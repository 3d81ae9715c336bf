"""Token-id files: documents as ids in compressed, checksummed blocks (``idcoder``).

Files are written in ascending order of the document number by tasks that each
own a range of it; a manifest with one row per block says where everything is.
A block holds whole documents, starts from empty models and can be read alone.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.llm import idcoder
from tonelake.llm.store import written
from tonelake.llm.texts import chunks
from tonelake.llm.tokens import default_vocabulary, encoder
from tonelake.session import scratch_path

BLOCK_IDS = 1 << 21
VOCABULARY = 49_408
_TEXT_BYTES = 2_000_000

MANIFEST = "file int, block int, path string, at long, bytes long, n_docs long, n_ids long"
READ = "doc_id long, file int, block int, place int, before long, n_tokens long, ids binary"


def _open(folder: str):
    """The file system of a folder's URI, and the path in it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Encodes every document, writes the files and returns their manifest.

    * Null and empty texts become the end id alone. Rows with the same number stand side by side,
      ordered by a hash of the text; a null number is written as the smallest 64-bit number, so it comes first.
    * A block closes once it has ``block_ids`` ids; a longer document is a block of its own.
    * A task that runs again writes a new file under a new name. The manifest, itself written to the
      shared folder, names the file of the attempt that counted.
    * An empty table gives an empty manifest.
    """
    number = F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63)))
    rows = docs.select(number.alias("doc_id"), docs[text_col].cast("string").alias("text"))
    tie = F.xxhash64("text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def write(batches):
        task = TaskContext.get()
        file, path = task.partitionId(), None
        out = where = None
        held_ids, held_docs, held_lens, n, block, at = [], [], [], 0, 0, 0

        def flush():
            nonlocal held_ids, held_docs, held_lens, n, block, at, out, where, path
            if out is None:
                files, base = _open(folder)
                files.create_dir(base, recursive=True)
                path = os.path.join(base, f"part-{file:05d}-{uuid.uuid4().hex}.ids")
                out = files.open_output_stream(path)
            data = idcoder.encode_block(np.concatenate(held_ids), np.concatenate(held_docs), np.concatenate(held_lens), VOCABULARY)
            out.write(data)
            row = (file, block, path, at, len(data), int(sum(map(len, held_docs))), n)
            at, block, n = at + len(data), block + 1, 0
            held_ids, held_docs, held_lens = [], [], []
            return row

        found = []
        for t in chunks(batches, _TEXT_BYTES):
            ids, lens = encoder(vocabulary).encode(t["text"])
            numbers = t["doc_id"].to_numpy()
            ends, lo = np.cumsum(lens), 0
            while lo < len(lens):
                done = int(ends[lo - 1]) if lo else 0
                hi = min(len(lens), int(np.searchsorted(ends, done + block_ids - n)) + 1)
                held_ids.append(ids[done : int(ends[hi - 1])])
                held_docs.append(numbers[lo:hi])
                held_lens.append(lens[lo:hi])
                n += int(ends[hi - 1]) - done
                lo = hi
                if n >= block_ids:
                    found.append(flush())
        if held_docs:
            found.append(flush())
        if out is not None:
            out.close()
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema=_MANIFEST)

    return written(rows.mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST = pa.schema(
    [("file", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
)


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files, one row each, in any order: number, file, block, place in the block, ids
    before it in the block, number of ids, crc32 of the ids, and the ids themselves (little-endian unsigned 32-bit).

    Blocks are read one by one by all tasks; a wrong checksum raises ``ValueError``.
    """
    schema = "doc_id long, file int, block int, place int, before long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        files, _ = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_file(r["path"]) as f:
                    f.seek(r["at"])
                    docs, lens, ids = idcoder.decode_block(f.read(r["bytes"]))
                ends = np.cumsum(lens)
                view = memoryview(ids).cast("B")
                pieces = [view[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist())]
                out = {
                    "doc_id": pa.array(docs, pa.int64()),
                    "file": pa.array(np.full(len(docs), r["file"], np.int32)),
                    "block": pa.array(np.full(len(docs), r["block"], np.int32)),
                    "place": pa.array(np.arange(len(docs), dtype=np.int32)),
                    "before": pa.array(ends - lens, pa.int64()),
                    "n_tokens": pa.array(lens, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([bytes(p) for p in pieces], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return manifest.repartition(max(parts, 1), "file", "block").mapInArrow(read, schema)


def block_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each block: summed over the few blocks of a file, and over one row per file."""
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.groupBy("file").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_f"))
    blocks = manifest.select("file", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_b"))
    return blocks.join(files, "file").select("file", "block", (F.col("_f") + F.col("_b")).alias("first_id"))


def op7_token_files(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(docs, folder, default_vocabulary())
    back = read_token_files(manifest, folder, with_ids=False)
    # Spark takes the documents for as small as the manifest they come from: they must not be broadcast.
    return back.join(block_starts(manifest).hint("merge"), ["file", "block"]).select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"),
        (F.col("first_id") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
