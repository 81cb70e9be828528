"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents in a shuffled order. A window adds its quantum to the deficit of each
queue, the window's size times the source's share of all tokens, takes the whole tokens of the deficit from the
queue and carries the rest of it on. What a queue has given after r windows is thus floor(r * quantum), so any
task knows where any window cuts its documents, without the windows before it, and deficits pass over windows
and partitions alike. Windows follow each other in one stream, which sequences cut at every `length` tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import grouped_prefix, ordered_index
from ..plans.storage import materialize, scratch_path
from . import subwords

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 1024, 0
#: Windows, and leading hexadecimal digits of a document's hash, in one chunk of a running sum.
CHUNK, HASH_DIGITS = 65_536, 2
_IDS = "_uid long, doc_id long, source string, _h string, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def width(vocabulary: str) -> int:
    """Bytes by which ids are stored: two where all of them fit, else four."""
    return 2 if max(subwords.token_bytes(vocabulary)) < 1 << 16 else 4


def tokenize(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """docs(doc_id, source, text) as _uid, doc_id, source, _h, n, ids: whole texts encoded, then `end`; ids are little-endian numbers of width() bytes. Null texts are empty."""
    own = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.md5(F.concat_ws("\x1f", F.lit("pack"), F.col("doc_id").cast("string"), F.col("text"))).alias("_h"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = subwords.batch_encoder(vocabulary), width(vocabulary)
        for batch in batches:
            *kept, texts = batch.columns
            found, bounds = ids(texts)
            found, bounds = np.insert(found.astype(f"<u{size}"), bounds[1:], end), bounds + np.arange(len(bounds))
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds * size), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds), pa.int64()), lists.cast(pa.binary())], names=["_uid", "doc_id", "source", "_h", "n", "ids"])

    path, spark = scratch_path(docs.sparkSession, "pack-ids"), docs.sparkSession
    own.mapInArrow(encode, _IDS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_IDS).parquet(path)


def _served(size: Column, quantum: Column, windows: int, r: Column) -> Column:
    """Tokens that a queue has given before window r: whole tokens of r quanta, all after the last window."""
    return F.when(r >= windows, size).otherwise(F.least(size, F.floor(quantum * r)))


def schedule(placed: DataFrame, windows: int) -> DataFrame:
    """(_uid, window, idx, from, to): the parts that windows take of documents placed(_uid, idx, source_size, quantum, at, n).

    A document offers the windows near its place in its queue; those that take none of it fall away. With a quantum
    below one token, most windows pass a queue by, so its tokens name the windows instead.
    """
    a, b, q = F.col("at"), F.col("at") + F.col("n"), F.col("quantum")
    last = F.lit(windows - 1)
    clamp = lambda x: F.greatest(F.lit(0), F.least(last, x)).cast("long")
    near = F.sequence(clamp(F.floor(a / q) - 1), clamp(F.floor((b - 1) / q) + 1))
    by_token = F.array_distinct(F.flatten(F.transform(F.sequence(a, b - 1), lambda k: F.transform(F.array(F.lit(-2), F.lit(-1), F.lit(0)), lambda d: clamp(F.ceil((k + 1) / q) + d)))))
    asked = placed.select("_uid", "idx", "source_size", "quantum", "at", "n", F.explode(F.when(q >= 1, near).otherwise(by_token)).alias("window"))
    given = lambda r: _served(F.col("source_size"), q, windows, r)
    first, end = F.greatest(a, given(F.col("window"))), F.least(b, given(F.col("window") + 1))
    return asked.select("_uid", "window", "idx", "at", first.alias("from"), end.alias("to")).filter("`from` < `to`")


def _tail(total: int, length: int) -> list[int]:
    """Starts of the last sequences: what is left beyond full ones is cut into powers of two, which need no padding."""
    starts, at = [], total - total % length
    for bit in range(length.bit_length() - 1, -1, -1):
        if total % length & 1 << bit:
            starts.append(at)
            at += 1 << bit
    return starts


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and (with_ids) ids: little-endian unsigned 32-bit numbers.

    docs(doc_id, source, text). Null and empty texts hold the ending id alone; a null source is a queue of its own,
    last in order. Repeated rows are packed each; those alike in doc_id and text follow each other. An empty table
    gives no pieces. Every window holds each source's share of all tokens to within a token for each source; no
    sequence is padded.
    """
    tokens = tokenize(docs, vocabulary, end)
    sizes = materialize(tokens.groupBy("source").agg(F.sum("n").alias("source_size")), "pack-sources")
    total = int(sizes.agg(F.sum("source_size")).first()[0] or 0)
    windows = max(1, -(-total // length))
    queues = ordered_index(sizes, [F.col("source")], "idx", "pack-queues").withColumn("quantum", F.col("source_size") / F.lit(float(max(1, total))) * length)

    narrow = tokens.select("_uid", "doc_id", "source", "_h", "n").withColumn("_part", F.conv(F.substring("_h", 1, HASH_DIGITS), 16, 10).cast("int"))
    there = narrow.select("source", "_part").distinct()  # so a queue of many documents meets its row in many tasks
    q = queues.select(F.col("source").alias("_s"), "source_size", "idx", "quantum")
    wide = there.join(q, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnsRenamed({"source": "_s", "_part": "_q"})
    rows = narrow.join(wide, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q"))).drop("_s", "_q")
    placed = grouped_prefix(rows, ["idx"], F.col("_part"), [F.col("_h"), F.col("doc_id"), F.col("_uid")], F.col("n"), "at")
    parts = materialize(schedule(placed, windows), "pack-parts")

    inside = Window.partitionBy("window").orderBy("idx", "from").rowsBetween(Window.unboundedPreceding, -1)  # at most a window's tokens
    taken = materialize(parts.groupBy("window").agg(F.sum(F.col("to") - F.col("from")).alias("_n")).withColumn("_g", F.lit(0)), "pack-windows")
    starts = grouped_prefix(taken, ["_g"], F.floor(F.col("window") / CHUNK), [F.col("window")], F.col("_n"), "_w").select("window", "_w")
    at = parts.select("*", F.coalesce(F.sum(F.col("to") - F.col("from")).over(inside), F.lit(0)).alias("_in")).join(starts, "window")
    at = at.select("_uid", (F.col("from") - F.col("at")).alias("_start"), (F.col("_w") + F.col("_in")).alias("_p"), (F.col("to") - F.col("from")).alias("_n"))

    full, tail = total // length, _tail(total, length)
    late = lambda p: sum((F.when(p >= t, 1).otherwise(0) for t in tail), F.lit(-1))
    sequence_of = lambda p: F.when(p < full * length, F.floor(p / length)).otherwise(F.lit(full) + late(p)).cast("long") if tail else F.floor(p / length)
    start_of = lambda s: F.when(s < full, s * length).otherwise(F.element_at(F.array(*[F.lit(t).cast("long") for t in tail]), F.greatest(F.lit(1), (s - full + 1)).cast("int"))) if tail else s * length
    end_of = lambda s: F.when(s + 1 < full + len(tail), start_of(s + 1)).otherwise(F.lit(total)) if tail else (s + 1) * length
    p, e, s = F.col("_p"), F.col("_p") + F.col("_n"), F.col("sequence_id")
    cut = at.withColumn("sequence_id", F.explode(F.sequence(sequence_of(p), sequence_of(e - 1))))
    begin, stop = F.greatest(p, start_of(s)), F.least(e, end_of(s))
    pieces = cut.select("_uid", F.struct((F.col("_start") + begin - p).alias("start"), (stop - begin).alias("length"), "sequence_id", (begin - start_of(s)).alias("offset")).alias("_piece"))

    # A document's pieces meet its ids in one row, so ids are shuffled once and no piece carries more than its own.
    of_doc = pieces.groupBy("_uid").agg(F.collect_list("_piece").alias("_pieces"))
    met = tokens.drop("_h").join(of_doc.hint("merge"), "_uid").select("doc_id", "source", "n", "ids", "_pieces")
    return met.mapInArrow(_cutter(width(vocabulary), with_ids), _PIECES + (", ids binary" if with_ids else ""))


def _cutter(size: int, with_ids: bool):  # noqa: ANN202
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, source, n, ids, lists = batch.columns
            count, pieces = np.diff(np.asarray(lists.offsets)), lists.flatten()
            start, length, sequence, offset = (pieces.field(i).to_numpy() for i in range(4))
            row, sums, own = np.repeat(np.arange(len(count)), count), np.empty(len(start), np.int64), []
            at = 0
            for k, held in zip(count.tolist(), ids, strict=True):
                whole = memoryview(np.frombuffer(held.as_buffer(), f"<u{size}").astype("<u4").tobytes())
                for i in range(at, at + k):
                    part = whole[4 * start[i] : 4 * (start[i] + length[i])]
                    sums[i] = zlib.crc32(part)
                    if with_ids:
                        own.append(bytes(part))
                at += k
            columns = [doc.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums), n.take(pa.array(row)), pa.array(sequence), pa.array(offset), source.take(pa.array(row)), *([pa.array(own, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids)

    return cut
