"""A public tokenizer, and the words it works on.

The tokenizer first splits a text into words by a pattern, then turns each word into ids
by itself; a text's ids are its words' ids in a row.  Words are split in Spark by the JVM's
regular expressions.  Two kinds of text are split in Python instead, with the same
pattern: those longer than LONG_CHARS, whose words would be too large an array for one row,
and those with code points that the JVM's Unicode tables do not know yet, which it would
take for neither letters nor digits.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.staging import ship

#: Where the vocabularies lie on the driver; executors get theirs from it.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"

#: Fixed values of the public tokenizer: its split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Takes a text as a single word.
WHOLE = r"[\s\S]+"

#: Beyond, a text's words come some at a time; a matter of memory, as both ways give the same words.
LONG_CHARS = 1_000_000

_LOADED: dict[tuple[str, str], object] = {}
_PATTERN: list = []
#: Numbers of ids by word, of one tokenizer, whose mark is at None.
_COSTS: dict = {}
REMEMBERED = 500_000


class Vocabulary:
    """The rank file of a tokenizer, read on the driver and sent to each executor once (under a megabyte)."""

    def __init__(self, spark: SparkSession, name: str = NAME, folder: str = FOLDER):
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            data = f.read()
        ship(spark)
        self.mark = hashlib.sha256(data).hexdigest()
        self.size = data.count(b"\n")
        self._data = spark.sparkContext.broadcast(data)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self._data.value.splitlines())}

    def table(self, spark: SparkSession) -> DataFrame:
        """id and piece, as many rows as the vocabulary has."""
        return spark.createDataFrame(pa.table({"id": pa.array(list((r := self.ranks()).values()), pa.int32()), "piece": pa.array(list(r), pa.binary())}))

    def encoding(self):
        """In a worker: the loaded tokenizer, one per process."""
        return self._loaded(PATTERN)

    def single(self):
        """In a worker: the function from a word, as the pattern splits them, to its ids."""
        return self._loaded(WHOLE).encode_ordinary

    def _loaded(self, pattern: str):
        if (self.mark, pattern) not in _LOADED:
            import tiktoken

            _LOADED[self.mark, pattern] = tiktoken.Encoding(self.mark, pat_str=pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return _LOADED[self.mark, pattern]


def split_by_python(text: str) -> Iterator[list[str]]:
    """The words of a text, some at a time; cut where a space follows and precedes other characters, always a word's start."""
    if not _PATTERN:
        import regex

        _PATTERN.extend([regex.compile(PATTERN), regex.compile(r"(?<=\S) (?=\S)")])
    words, seam = _PATTERN
    at = 0
    while at < len(text):
        cut = seam.search(text, at + LONG_CHARS) if at + LONG_CHARS < len(text) else None
        end = cut.start() if cut else len(text)
        yield words.findall(text, at, end) if end == len(text) and at == 0 else words.findall(text[at:end])
        at = end


def words_column(text: Column) -> tuple[Column, Column]:
    """(words, hard): the words by the JVM and null, or null and the text itself for Python to split."""
    hard = (F.length(text) > LONG_CHARS) | text.rlike(r"\p{Cn}")
    words = F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))
    return F.when(~hard, words), F.when(hard, text)


def batch_words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch with columns words and hard, and the number of each row's."""
    words, hard = batch.column(batch.schema.get_field_index("words")), batch.column(batch.schema.get_field_index("hard"))
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    if hard.null_count == len(hard):
        return flat, counts
    parts, at = [], 0
    ends = np.cumsum(counts)
    for i in np.flatnonzero(pc.is_valid(hard).to_numpy(zero_copy_only=False)):
        parts.append(flat.slice(at, ends[i] - at))
        at = ends[i]
        for some in split_by_python(hard[int(i)].as_py()):
            parts.append(pa.array(some, flat.type))
            counts[i] += len(some)
    parts.append(flat.slice(at))
    return pa.concat_arrays(parts), counts


def joined(words: pa.Array, start: int, stop: int) -> str:
    """Words start to stop of a string array without nulls, which lie next to each other, as one text."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset + start : words.offset + stop + 1]
    return words.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().decode() if stop > start else ""


def distinct_costs(words: list[str], one, mark: str) -> np.ndarray:
    """The number of ids of each of the words, remembered within the process up to a bound; ``mark`` names the tokenizer."""
    if len(_COSTS) > REMEMBERED or _COSTS.get(None) != mark:
        _COSTS.clear()
        _COSTS[None] = mark
    get, known = _COSTS.get, _COSTS.setdefault
    return np.fromiter((get(w) or known(w, len(one(w))) for w in words), np.int64, len(words))


def word_costs(words: pa.Array, one, mark: str) -> np.ndarray:
    """The number of ids of each word; every distinct word of the batch is looked at once."""
    coded = words.dictionary_encode()
    costs = distinct_costs(coded.dictionary.to_pylist(), one, mark)
    return costs[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def count_tokens(rows: DataFrame, text: str, keep: list[str], vocabulary: Vocabulary) -> DataFrame:
    """keep and n_tokens; a null text has 0."""
    words, hard = words_column(F.col(text))
    given = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words.alias("words"), hard.alias("hard"))
    kept = [rows.schema[c] for c in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = vocabulary.single()
        for batch in batches:
            for part in slices(batch):
                flat, counts = batch_words(part)
                ends = np.r_[0, np.cumsum(word_costs(flat, one, vocabulary.mark))]
                at = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(ends[at] - ends[at - counts])], names=[*keep, "n_tokens"]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint"])
    return given.mapInArrow(count, schema)


def slices(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes or, where one row is larger, that row."""
    if not batch.num_rows:
        return
    words = batch.column(batch.schema.get_field_index("words"))
    hard = batch.column(batch.schema.get_field_index("hard"))
    flat = words.flatten()
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    upto = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64))] if len(flat) else np.zeros(1, np.int64)
    size = upto[ends] + np.cumsum(pc.fill_null(pc.binary_length(hard), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
