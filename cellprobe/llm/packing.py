"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised once and cut into pieces of at most ``capacity`` tokens; the pieces (ids dropped unless asked
for) go to the shared folder. Full pieces are sequences by themselves. Of the others the driver sees counts by length
only, fewer than ``capacity`` numbers whatever the input. Best-fit decreasing runs over these counts: it yields runs of
slots (length, ranks from-to, first sequence, offset), whose number depends on the lengths that occur. Each piece then
takes the slot of its rank among the pieces of its length. Ranks are a chunk's base plus the rank within length and
chunk, so a length that a third of all pieces share is numbered by many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellprobe.llm.bpe import library_encoder
from cellprobe.llm.io import cut

#: Chunks of a length's pieces: so many at least, and more where a chunk of all pieces would have over so many rows.
CHUNKS, CHUNK_ROWS = 64, 20_000_000
END_OF_DOCUMENT = 1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length: (length, first rank, number, first sequence, offset) runs.

    A run's ranks go to consecutive sequences at the same offset. The work and the number of runs depend on
    the distinct lengths, not on how many pieces have them.
    """
    out, sequences = [], 0
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual -> runs of (first sequence, number)
    residuals: list[int] = []  # sorted keys of open_

    def add(residual: int, first: int, number: int) -> None:
        if residual and number:
            if not open_[residual]:
                bisect.insort(residuals, residual)
            open_[residual].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, number = open_[residual].pop()
                if not open_[residual]:
                    residuals.pop(at)
                take = min(number, left)
                out.append((length, rank, take, first, capacity - residual))
                add(residual, first + take, number - take)
                add(residual - length, first, take)
                rank, left = rank + take, left - take
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for k in range(each if full else 0):
                out.append((length, rank, full, sequences, k * length))
                rank += full
            add(capacity - each * length, sequences, full)
            sequences += full
            for k in range(rest):
                out.append((length, rank, 1, sequences, k * length))
                rank += 1
            if rest:
                add(capacity - rest * length, sequences, 1)
                sequences += 1
            left = 0
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every text's ids and the closing id; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = library_encoder(vocabulary), END_OF_DOCUMENT.to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            rows, ids_out = [], []
            for i, ids in enumerate(enc.encode_all(t.as_py() for t in batch.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids_out.append(memoryview(part).cast("i").tolist())
            source, *cols = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``pieces`` with their sequence_id and gapless offset there.

    Null and empty texts are documents of one token. Repeated rows, also with the same or a null id, are
    packed each by itself; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    out = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    cells = cut(pieces(docs, vocabulary, capacity, id_col, text_col, with_ids).withColumn("_number", F.monotonically_increasing_id()))
    full = cells.where(F.col("length") == capacity).select(*out, (-1 - F.col("_number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = cells.where(F.col("length") < capacity)
    chunks = max(CHUNKS, -(-open_.count() // CHUNK_ROWS))
    open_ = open_.withColumn("_chunk", F.pmod(F.xxhash64("_number"), F.lit(chunks)).cast("int"))
    histogram = cut(open_.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r["length"]: r["n"] for r in histogram.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = plan(counts, capacity)
    slots = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length bigint, _rank bigint, _count bigint, _sequence bigint, _offset bigint")
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = histogram.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # Both small tables are bounded by the capacity: under ``capacity * CHUNKS`` rows of bases, and of slots what the plan has.
    small = F.broadcast if chunks == CHUNKS else lambda df: df
    order = Window.partitionBy("length", "_chunk").orderBy("_number")
    ranked = open_.withColumn("_row", F.row_number().over(order) - 1).join(small(bases), ["length", "_chunk"]).withColumn("_at", F.col("_base") + F.col("_row"))
    c, s = ranked.alias("c"), F.broadcast(slots).alias("s")
    fits = (F.col("c.length") == F.col("s.length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_count"))
    placed = c.join(s, fits).select(*[F.col(f"c.{x}") for x in out], (F.col("_sequence") + F.col("_at") - F.col("_rank")).alias("sequence_id"), F.col("_offset").alias("offset"))
    columns = [*out[:5], "sequence_id", "offset", *out[5:]]
    return full.unionByName(placed).select(*columns)
