"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of fixed-width token numbers in which an end-of-document number closes each document; nothing says
where documents start. Files are read in blocks of bounded size. Each block's separators are found by one vectorised comparison; a block
reports the documents that end in it, and the tokens after its last separator. A prefix scan over the blocks of a file gives each block its first
document's number and the tokens carried in from before, so documents that span many blocks are stitched.

Cases: an empty file has no documents. Tokens after the last separator are a last, unclosed document (``closed`` false). Two
separators in a row are a document of no tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippleset.llm.common import shared_dir, slices, table, written

#: Tokens of one block.
BLOCK = 1 << 21


def _filesystem(uri: str):
    """The store of a URI or absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def scan_blocks(files: DataFrame, separator: int, dtype: str = "uint16", block: int = BLOCK) -> DataFrame:
    """``path``, ``document`` (number in its file), ``n_tokens`` and ``closed`` of every document of files given as ``path``, ``n_bytes``."""
    width = np.dtype(dtype).itemsize
    blocks = files.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / (block * width))))).alias("block")).where("n_bytes > 0")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _filesystem(row["path"])
                with store.open_input_file(path) as file:
                    tokens = np.frombuffer(file.read_at(block * width, row["block"] * block * width), dtype)
                ends = np.flatnonzero(tokens == separator)
                sizes = np.diff(ends, prepend=-1) - 1
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "block": [row["block"]], "sizes": [sizes.tolist()], "tail": [len(tokens) - 1 - (int(ends[-1]) if len(ends) else -1)], "last": [(row["block"] + 1) * block * width >= row["n_bytes"]]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("sizes", pa.list_(pa.int64())), ("tail", pa.int64()), ("last", pa.bool_())])
    found = written(blocks.repartition(F.col("path"), F.col("block")).mapInArrow(search, "path string, block bigint, sizes array<bigint>, tail bigint, last boolean"), "token-blocks")
    # Prefix scan: documents closed before a block, and open tokens since the last separator before it.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    light = found.select("path", "block", "tail", "last", F.size("sizes").cast("long").alias("closed_here"))
    numbered = light.withColumn("first", F.coalesce(F.sum("closed_here").over(before), F.lit(0))).withColumn("run", F.coalesce(F.sum((F.col("closed_here") > 0).cast("long")).over(before), F.lit(0)))
    since = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.coalesce(F.max(F.when(F.col("closed_here") > 0, F.struct("block", "tail"))).over(before)["tail"], F.lit(0))
    carried = numbered.withColumn("carry", last_tail + F.coalesce(F.sum(F.when(F.col("closed_here") == 0, F.col("tail"))).over(since), F.lit(0)))
    joined = found.select("path", "block", "sizes").join(carried, ["path", "block"])
    sizes = F.transform("sizes", lambda n, i: F.struct((F.col("first") + i).alias("document"), F.when(i == 0, n + F.col("carry")).otherwise(n).alias("n_tokens"), F.lit(True).alias("closed")))
    open_tokens = F.when(F.col("closed_here") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry"))
    rest = F.when(F.col("last") & (open_tokens > 0), F.array(F.struct((F.col("first") + F.col("closed_here")).alias("document"), open_tokens.alias("n_tokens"), F.lit(False).alias("closed"))))
    rest = F.coalesce(rest, F.expr("cast(array() as array<struct<document: bigint, n_tokens: bigint, closed: boolean>>)"))
    return joined.select("path", F.inline(F.concat(sizes, rest)))


def write_token_files(df: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes one flat file of 16-bit numbers for each input partition; ``path``, ``n_bytes`` of the files, and ``path``, ``document``, ``id_col``.

    Files go to the shared folder, each attempt's under its own name; only names that the finished attempts report are read.
    """
    spark: SparkSession = df.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    id_type = df.schema[id_col].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        path = f"{folder}/part-{uuid.uuid4().hex}.u16"
        store, place = _filesystem(folder)
        store.create_dir(place, recursive=True)
        done = size = 0
        with store.open_output_stream(f"{place}/{path.rpartition('/')[2]}") as file:
            for batch in slices(batches):
                encoded = encoder.encode_ordinary_batch([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
                flat = np.fromiter((i for ids in encoded for i in (*ids, separator)), np.uint16)
                file.write(flat.tobytes())
                size += flat.nbytes
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(encoded)), pa.array(range(done, done + len(encoded)), pa.int64()), batch.column(0), pa.array([None] * len(encoded), pa.int64())], ["path", "document", "_id", "n_bytes"])
                done += len(encoded)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([-1], pa.int64()), pa.nulls(1, batch.schema.field(0).type), pa.array([size], pa.int64())], ["path", "document", "_id", "n_bytes"])

    given = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = written(given.mapInArrow(write, f"path string, document bigint, _id {id_type}, n_bytes bigint"), "token-files")
    return rows.where("document < 0").select("path", "n_bytes"), rows.where("document >= 0").select("path", "document", F.col("_id").alias(id_col))


_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """The byte-level encoder of a rank file, once per worker."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files of the whole table."""
    import public_tokenizers

    separator = 50256
    files, documents = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), separator)
    return scan_blocks(files, separator).join(documents, ["path", "document"]).select("doc_id", "n_tokens")
