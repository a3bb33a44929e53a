"""Token-id files: whole documents encoded, packed in 64-bit words, read back.

Ids are written in ascending order of document id: documents are dealt out by
ranges of the id, sorted inside a range, and a range is one run of segments (format:
``simple8b``). A reader needs no other table; the place of a document in the whole
stream follows from the sizes of the ranges before it.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simple8b, wordbpe

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 1
# Ids at which a segment ends with its document.
SEGMENT_IDS = 1 << 18

SCHEMA = (
    "part int, segment long, first long, doc_ids array<long>, doc_tokens array<long>, n_ids long, "
    "words binary, blocks binary"
)


def encode_documents(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write all ids of all rows to token files at ``path``.

    A null text is empty and has its end id alone; rows of one id keep no order
    among themselves; a row without an id comes first. Other columns are ignored.
    """
    vocabulary = tokenizer or wordbpe.default_path()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        encoder, part = wordbpe.Encoder.at(vocabulary), TaskContext.get().partitionId()
        segment, done = 0, 0
        ids, doc_ids, doc_tokens, held = [], [], [], 0

        def row():
            flat = np.concatenate(ids)
            words, blocks = simple8b.encode(flat)
            cells = [part, segment, done, doc_ids, doc_tokens, len(flat), words, blocks]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, flat, counts in encoder.texts(batch.column(1)):
                sizes = counts + 1
                out = np.full(int(sizes.sum()), end_id, np.int64)
                inside = np.ones(len(out), bool)
                inside[np.cumsum(sizes) - 1] = False
                out[inside] = flat
                ids.append(out)
                doc_ids += keys[a:b]
                doc_tokens += sizes.tolist()
                held += len(out)
                if held >= SEGMENT_IDS:
                    yield row()
                    done, segment = done + held, segment + 1
                    ids, doc_ids, doc_tokens, held = [], [], [], 0
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the token files: ``doc_id, start, n_tokens`` and ``ids``, or their crc32.

    ``start`` counts the ids of all documents before it in the stream.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["doc_tokens"], np.int64)
                stops = np.cumsum(sizes)
                raw = simple8b.decode(r["words"], r["n_ids"]).astype("<u4")
                edges = list(zip((stops - sizes).tolist(), stops.tolist()))
                if digest:
                    last = pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in edges], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(raw.astype(np.int32))
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * len(sizes), pa.int32()),
                     pa.array(r["first"] + stops - sizes), pa.array(sizes), last],
                    names=["doc_id", "part", "own_start", "n_tokens", "value"],
                )

    kind = "long" if digest else "array<int>"
    files = spark.read.schema(SCHEMA).parquet(path)
    found = files.select("part", "first", "doc_ids", "doc_tokens", "n_ids", "words").mapInArrow(
        run, f"doc_id long, part int, own_start long, n_tokens long, value {kind}"
    )
    # One row per range, as many as there are files.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens",
        F.col("value").alias("ids_crc32" if digest else "ids"),
    )
