"""Token ids of every text of a corpus through a table of its distinct words.

1. Words are split by Spark.  A task gathers its texts into blocks of some megabytes, lists
   each block's distinct words, and writes the texts as positions in that list.
2. The lists of all blocks, exploded, shuffle by word.  Each distinct word meets in one place
   and is encoded once, whatever the number of blocks it came from.
3. Ids shuffle back by block, where the positions of its texts pick them up.

The words of a block are a small part of its text, and positions compress to about a byte
each, so neither shuffle moves as much as the texts.  No dictionary of the corpus is ever in one
place: a task holds one block and its words.  Both shuffles have as many partitions as their data fill
at the session's advisory partition size, which the staged blocks tell.

Decoding goes the same way back: blocks list their distinct ids, a join with the table (id, piece) of the
vocabulary gives their pieces, and those return by block to the positions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.tokens import Vocabulary, batch_words, slices, words_column
from flowloom.staging import stage

#: Rows of (block, position, ids) put together before they go on, sorted by block.
GATHER = 1 << 20
#: What a row of a block's words or ids takes beside the word.
ROW_BYTES = 12
#: Ids of a block when decoding.
BLOCK_IDS = 1 << 20


def _partitions(blocks: DataFrame, size: Column) -> int:
    """As many as the size summed over the blocks fills at half the advisory size, as blocks fall unevenly, but all cores at least."""
    spark = blocks.sparkSession
    advised = spark._jsparkSession.sessionState().conf().getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    each = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(advised)
    return max(spark.sparkContext.defaultParallelism, math.ceil(2 * (blocks.agg(F.sum(size)).first()[0] or 0) / each))


def _packed(codes: np.ndarray) -> bytes:
    """32-bit numbers by bytes of equal weight, most of them zero, compressed."""
    import zstandard

    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """block, ids of the texts, their numbers of words, positions of all words in a row, the block's distinct words, and bytes of these and of the positions."""
    words, hard = words_column(F.col(text))
    kind = texts.schema[key].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                flat, counts = batch_words(part)
                coded = flat.dictionary_encode()
                codes = coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
                often = np.bincount(codes, minlength=len(coded.dictionary))
                order = np.argsort(-often, kind="stable")  # small positions for frequent words
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                distinct = coded.dictionary.take(pa.array(order))
                positions = _packed(place[codes])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)),
                        pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                        pa.array([positions], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct),
                        pa.array([(pc.sum(pc.binary_length(distinct)).as_py() or 0) + ROW_BYTES * len(distinct)], pa.int64()),
                        pa.array([len(positions) + ROW_BYTES * len(distinct)], pa.int64()),
                    ],
                    names=["block", "keys", "counts", "positions", "words", "word_bytes", "position_bytes"],
                )
                number += 1

    schema = (
        T.StructType()
        .add("block", T.LongType())
        .add("keys", T.ArrayType(kind))
        .add("counts", T.BinaryType())
        .add("positions", T.BinaryType())
        .add("words", T.ArrayType(T.StringType()))
        .add("word_bytes", T.LongType())
        .add("position_bytes", T.LongType())
    )
    return texts.select(F.col(key).alias("key"), words.alias("words"), hard.alias("hard")).mapInArrow(pack, schema)


def _encoded_words(blocks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """block, positions, and the ids of the words there, each distinct word encoded once."""
    each = blocks.select("block", F.posexplode("words").alias("position", "word"))
    met = each.repartition(_partitions(blocks, F.col("word_bytes")), "word").sortWithinPartitions("word")
    wide = "<u2" if vocabulary.size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = vocabulary.single()
        last, last_ids = None, None
        held, n = [], 0

        def release() -> Iterator[pa.RecordBatch]:
            block = np.concatenate([h[0] for h in held])
            position = np.concatenate([h[1] for h in held])
            ids = pa.chunked_array([h[2] for h in held]).combine_chunks()
            order = np.argsort(block, kind="stable")
            block, position, ids = block[order], position[order], ids.take(pa.array(order))
            size = np.diff(ids.offsets.to_numpy()).astype("<u4")
            flat, ends = ids.flatten().to_numpy().astype(wide), np.r_[0, np.cumsum(size)]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            stops = np.r_[starts[1:], len(block)]
            for some in range(0, len(starts), 4096):
                a, b = starts[some : some + 4096], stops[some : some + 4096]
                blob = lambda xs: pa.array(xs, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[a]),
                        blob([position[i:j].astype("<u4").tobytes() for i, j in zip(a, b)]),
                        blob([size[i:j].tobytes() for i, j in zip(a, b)]),
                        blob([flat[ends[i] : ends[j]].tobytes() for i, j in zip(a, b)]),
                    ],
                    names=["block", "positions", "sizes", "ids"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).dictionary_encode()
            found = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, one(w)
                found.append(last_ids)
            table = pa.array(found, pa.list_(pa.int32()))
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), table.take(coded.indices)))
            n += batch.num_rows
            if n >= GATHER:
                yield from release()
                held, n = [], 0
        if held:
            yield from release()

    return met.mapInArrow(encode, "block bigint, positions binary, sizes binary, ids binary")


def encode(texts: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """key and ids (array of int) of every row.

    Null and empty texts have no ids: an empty array.  Strings of special tokens in a text are
    ordinary text.  Repeated keys give one row each.  Other columns are not looked at.
    """
    blocks = stage(_blocks(texts, key, text), "blocks")
    kind = texts.schema[key].dataType
    words = _encoded_words(blocks, vocabulary).select(
        "block", F.lit(0).alias("part"), "positions", "sizes", "ids", F.lit(None).cast(T.ArrayType(kind)).alias("keys")
    )
    rows = blocks.select("block", F.lit(1).alias("part"), "positions", F.col("counts").alias("sizes"), F.lit(None).cast("binary").alias("ids"), "keys")
    together = words.unionByName(rows).repartition(_partitions(blocks, F.col("position_bytes")), "block").sortWithinPartitions("block", "part")
    wide = "<u2" if vocabulary.size <= 1 << 16 else "<u4"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, size, ids = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() == 0:
                    for held, c, t in ((place, 2, "<u4"), (size, 3, "<u4"), (ids, 4, wide)):
                        held.append(np.frombuffer(batch.column(c)[i].as_buffer(), t))
                    continue
                counts = np.frombuffer(batch.column(3)[i].as_buffer(), "<i8")
                keys = batch.column(5)[i].values
                if place:
                    order = np.argsort(np.concatenate(place))
                    n = np.concatenate(size).astype(np.int32)
                    table = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32))).take(pa.array(order))
                    codes = _unpacked(batch.column(2)[i].as_py())
                    ends = np.r_[0, np.cumsum(n[order][codes], dtype=np.int64)]
                    flat = table.take(pa.array(codes)).flatten()
                else:
                    ends, flat = np.zeros(1, np.int64), pa.array([], pa.int32())
                offsets = ends[np.r_[0, np.cumsum(counts)]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["key", "ids"])
                place, size, ids = [], [], []

    return together.mapInArrow(pick, T.StructType().add("key", kind).add("ids", T.ArrayType(T.IntegerType()))).select(F.col("key").alias(key), "ids")


def _id_blocks(encoded: DataFrame, key: str, ids: str) -> DataFrame:
    """block, keys, their numbers of ids, positions of all ids in a row, the block's distinct ids, and bytes that go on."""
    kind = encoded.schema[key].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(counts), 0
            while at < batch.num_rows:  # rows of about BLOCK_IDS ids, or one that has more
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_IDS, side="right")))
                part = batch.slice(at, to - at)
                distinct, places = np.unique(pc.fill_null(part.column(1).flatten(), -1).to_numpy(zero_copy_only=False), return_inverse=True)
                positions = _packed(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)),
                        pa.array([counts[at:to].astype("<i8").tobytes()], pa.binary()),
                        pa.array([positions], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct, pa.int32())),
                        pa.array([len(positions) + 3 * ROW_BYTES * len(distinct)], pa.int64()),
                    ],
                    names=["block", "keys", "counts", "positions", "ids", "bytes"],
                )
                number, at = number + 1, to

    schema = T.StructType().add("block", T.LongType()).add("keys", T.ArrayType(kind)).add("counts", T.BinaryType()).add("positions", T.BinaryType())
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("bytes", T.LongType())
    return encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(pack, schema)


def decode(encoded: DataFrame, key: str, ids: str, vocabulary: Vocabulary) -> DataFrame:
    """key and text, by joining the distinct ids of each block with their pieces of the vocabulary.

    Null and empty ids give an empty text, ids that the vocabulary lacks, or null, give nothing.  A text
    is put together from all its bytes before it is read as UTF-8; what is no UTF-8 becomes replacement
    characters.  Repeated keys give one row each.
    """
    kind = encoded.schema[key].dataType
    blocks = stage(_id_blocks(encoded, key, ids), "idblocks")
    each = blocks.select("block", F.posexplode("ids").alias("position", "id"))
    # the table of pieces has a fixed size, some ten thousand rows
    found = each.join(F.broadcast(vocabulary.table(encoded.sparkSession)), "id", "left").select(
        "block", "position", "piece", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("positions"), F.lit(None).cast(T.ArrayType(kind)).alias("keys")
    )
    rows = blocks.select("block", F.lit(2**31 - 1).alias("position"), F.lit(None).cast("binary").alias("piece"), "counts", "positions", "keys")  # after the pieces
    together = found.unionByName(rows).repartition(_partitions(blocks, F.col("bytes")), "block").sortWithinPartitions("block", "position")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            at = 0
            for i in np.flatnonzero(pc.is_valid(batch.column(4)).to_numpy(zero_copy_only=False)).tolist():
                pieces = pc.fill_null(pa.concat_arrays([*held, batch.column(2).slice(at, i - at)]).cast(pa.large_binary()), b"")
                held, at = [], i + 1
                counts = np.frombuffer(batch.column(3)[i].as_buffer(), "<i8")
                keys = batch.column(5)[i].values
                codes = _unpacked(batch.column(4)[i].as_py())
                first = np.r_[0, np.cumsum(counts)]
                for some in range(0, len(keys), 512):
                    own = first[some : some + 513]
                    picked = pieces.take(pa.array(codes[own[0] : own[-1]]))
                    offsets = np.frombuffer(picked.buffers()[1], np.int64)[picked.offset : picked.offset + len(picked) + 1] if len(picked) else np.zeros(1, np.int64)
                    data = picked.buffers()[2] or pa.py_buffer(b"") if len(picked) else pa.py_buffer(b"")
                    texts = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(offsets[own - own[0]].tobytes()), data])
                    try:
                        texts = texts.cast(pa.large_string())
                    except pa.ArrowInvalid:
                        texts = pa.array([x.as_py().decode(errors="replace") for x in texts], pa.large_string())
                    yield pa.RecordBatch.from_arrays([keys.slice(some, 512), texts.cast(pa.string())], names=["key", "text"])
            if at < batch.num_rows:
                held.append(batch.column(2).slice(at))

    return together.mapInArrow(pick, T.StructType().add("key", kind).add("text", T.StringType())).withColumnRenamed("key", key)
