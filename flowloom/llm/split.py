"""Cutting long texts into pieces under a size in tokens, at natural boundaries.

A text is first seen as atomic segments, one between each two places where it could be cut.
Places are graded: within a line between words, at the end of a sentence, at the end of a
line, at a blank line, where the depth of quoting changes or a signature begins, at the end of
a header block, and at the edges of MIME parts, digests and forwarded messages.  Adjacent segments
wait in a heap; the pair at the weakest place, the smaller pair first among equals, merges
as long as both together and the overlap fit the limit.  What remains are the pieces' cores.
Each piece but the first begins with the end of the piece before it, up to the
overlap.

Sizes are exact: places are where the tokenizer itself would split, so a piece's tokens are
those of its words.  White space may tokenize differently once a piece ends after it; runs of it
are counted at the larger of both, so a piece is never larger than counted.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.tokens import Vocabulary, batch_words, distinct_costs, joined, slices, words_column

LIMIT, OVERLAP = 4000, 100

WORD, SENTENCE, LINE, BLANK, QUOTE, HEADER, PART = range(7)

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_QUOTED = re.compile(r"(?:[ \t]?[>|])+")
_PART = re.compile(r"--\S|-{5,}|={5,}|_{10,}|From |Begin forwarded|(?i:-+ ?original message)")
_FIELD = re.compile(r"[A-Za-z][A-Za-z0-9-]*:(?: |\t|$)")
_SENTENCE = re.compile(r"[.!?][\"')\]]*(?=\s)")


def line_places(text: str) -> tuple[list[int], list[int]]:
    """Offsets where lines begin, but the first, and the grade of each as a place to cut."""
    at, grades = [], []
    depth, blank, header = 0, True, bool(_FIELD.match(text))
    for m in _LINE.finditer(text):
        start, end = m.span()
        if start == end:
            break
        line = text[start:end]
        bare = line.strip()
        quoted = _QUOTED.match(line)
        now = quoted.group().count(">") + quoted.group().count("|") if quoted else 0
        if start:
            if _PART.match(line) and not line.startswith("-- "):
                grade = PART
            elif header and blank or blank and _FIELD.match(line):
                grade = HEADER
            elif now != depth and bare or line.startswith("-- ") or bare == "--":
                grade = QUOTE
            elif blank and bare:
                grade = BLANK
            else:
                grade = LINE
            at.append(start)
            grades.append(grade)
        if bare:
            depth = now
        if blank and _FIELD.match(line):
            header = True
        elif not bare or not (header and (_FIELD.match(line) or line[0] in " \t")):
            header = header and not bare
        blank = not bare
        if blank and header:
            continue
    return at, grades


def merged(sizes: list[int], grades: list[int], room: int) -> list[int]:
    """First segments of the runs left after merging: segment i and i + 1 meet at a place of grade grades[i].

    The heap holds a pair as one number: grade, size of both, first segment.  Pairs that do not fit
    never will, as segments only grow, and stay out of it.
    """
    n = len(sizes)
    size, left, right = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    both = np.array(sizes[:-1], np.int64) + np.array(sizes[1:], np.int64)
    fits = np.flatnonzero(both <= room)
    of = [g << 56 for g in grades]
    heap = np.sort((np.array(grades, np.int64)[fits] << 56) | (both[fits] << 32) | fits).tolist()  # sorted, so it is a heap
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        pair = pop(heap)
        a = pair & 0xFFFFFFFF
        if not alive[a]:
            continue
        b = right[a]
        if b >= n or of[b - 1] | (now := size[a] + size[b]) << 32 | a != pair:
            continue  # one of them has grown since: the pair as it is now waits elsewhere
        c = right[b]
        size[a], alive[b], right[a] = now, False, c
        if c < n:
            left[c] = a
            if (larger := now + size[c]) <= room:
                push(heap, of[c - 1] | larger << 32 | a)
        if (p := left[a]) >= 0 and (larger := size[p] + now) <= room:
            push(heap, of[a - 1] | larger << 32 | p)
    return [i for i in range(n) if alive[i]]


def _refined(text: str, lengths: np.ndarray, costs: np.ndarray, spaces: np.ndarray, one, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than ``most`` tokens in parts of whole characters, anything else as it is; where a part is followed by one of the same word."""
    step = max(1, most // 4)  # a character is at most four bytes, each at most a token
    starts = np.cumsum(lengths) - lengths
    parts: list[list[np.ndarray]] = [[], [], [], []]
    at = 0
    for i in [*np.flatnonzero(costs > most).tolist(), len(costs)]:
        own = slice(at, i)
        for held, xs in zip(parts, (lengths[own], costs[own], spaces[own], np.zeros(i - at, bool))):
            held.append(xs)
        at = i + 1
        if i < len(costs):
            word = text[starts[i] : starts[i] + lengths[i]]
            cut = [word[k : k + step] for k in range(0, len(word), step)]
            inner = np.ones(len(cut), bool)
            inner[-1] = False
            sizes = [len(one(x)) for x in cut]
            for held, xs in zip(parts, ([len(x) for x in cut], sizes, [bool(spaces[i])] * len(cut), inner)):
                held.append(np.array(xs))
    return tuple(np.concatenate(held) for held in parts)


def pieces(text: str, lengths: np.ndarray, costs: np.ndarray, spaces: np.ndarray, encode, one, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, core_start, end, tokens) of each piece of one text, in characters; a piece overlaps its predecessor on [start, core_start).

    lengths, costs, spaces: characters and tokens of the text's words, and whether each is white space.
    encode, one: the ids of a text, and those of a single word.
    """
    room = limit - overlap
    most = min(room, overlap) if overlap else room
    inner = np.zeros(len(lengths), bool)
    if refined := int(costs.max(initial=0)) > most:
        lengths, costs, spaces, inner = _refined(text, lengths, costs, spaces, one, most)
    ends = np.cumsum(lengths)
    costs = costs.copy()
    fixed = np.ones(len(lengths), bool)  # a cut may come after this word
    for i in np.flatnonzero(spaces[1:] & spaces[:-1] & ~inner[:-1]).tolist():  # white space in two words, the second of which would join the first
        joint = len(one(text[ends[i] - lengths[i] : ends[i + 1]]))
        costs[i + 1] = max(costs[i + 1], joint - costs[i])
        fixed[i] = False
    # grades of the places after each word
    grades = np.full(len(lengths), WORD, np.int64)
    for offsets, of in (([m.end() for m in _SENTENCE.finditer(text)], None), line_places(text)):
        if len(offsets):
            spots = np.searchsorted(ends, offsets)
            np.maximum.at(grades, spots, np.array(of, np.int64) if of is not None else SENTENCE)
    # segments: lines first; those that are too long by sentences, and by words where even these are
    upto = np.r_[0, np.cumsum(costs)]
    starts = _segments(grades, fixed, upto, room)
    sizes = np.diff(upto[np.r_[starts, len(lengths)]])
    kept = merged(sizes.tolist(), grades[starts[1:] - 1].tolist(), room)
    cores = starts[kept]
    stops = np.r_[cores[1:], len(lengths)]
    begins = np.r_[0, ends]
    out, last = [], 0
    waiting = list(zip(cores.tolist(), stops.tolist()))[::-1]
    while waiting:
        a, b = waiting.pop()
        first = a
        if out and overlap:
            first = max(int(np.searchsorted(upto, upto[a] - overlap, side="left")), last)
            while first < a and first and not fixed[first - 1]:
                first += 1
        size = int(upto[b] - upto[first])
        if refined:  # parts of a word may join into other tokens than they are alone, seldom more of them
            size = len(encode(text[begins[first] : begins[b]]))
            if size > limit and first < a:  # less overlap, or none
                first = next((i for i in range((first + a + 1) // 2, a) if fixed[i - 1]), a)
                size = len(encode(text[begins[first] : begins[b]]))
                if size > limit:
                    first, size = a, len(encode(text[begins[a] : begins[b]]))
            places = np.flatnonzero(fixed[a : b - 1]) + a + 1
            if size > limit and len(places):  # this piece only, as near its middle as can be
                middle = int(places[np.argmin(np.abs(2 * upto[places] - upto[a] - upto[b]))])
                waiting += [(middle, b), (a, middle)]
                continue
        out.append((int(begins[first]), int(begins[a]), int(begins[b]), size))
        last = first
    return out


def _segments(grades: np.ndarray, fixed: np.ndarray, upto: np.ndarray, room: int) -> np.ndarray:
    """First words of the atomic segments, each of at most ``room`` tokens where words allow.

    Segments are lines; of lines that are too long, sentences; of sentences that are too long, words.
    """
    n = len(grades)
    cuts = np.flatnonzero((grades >= LINE) & fixed) + 1
    for finer in (SENTENCE, WORD):
        starts = np.unique(np.r_[0, cuts[cuts < n]])
        stops = np.r_[starts[1:], n]
        long = np.flatnonzero(upto[stops] - upto[starts] > room)
        if not len(long):
            return starts
        inside = np.zeros(n, bool)
        for i in long.tolist():
            inside[starts[i] : stops[i]] = True
        cuts = np.r_[starts, np.flatnonzero((grades >= finer) & fixed & inside) + 1]
    return np.unique(np.r_[0, cuts[cuts < n]])


def split(documents: DataFrame, key: str, text: str, vocabulary: Vocabulary, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """key, piece, pieces, start, core_start, end, n_tokens, doc_tokens and, if asked for, text.

    Offsets count characters; cores ([core_start, end)) of a document follow each other without
    gap, so they put it together again.  A text within the limit is one piece, an empty one an empty
    piece, a null one none.  Overlap is the most whole words of at most ``overlap`` tokens.
    Repeated keys are split each by itself.  Other columns are not looked at.
    """
    if not 0 <= overlap * 4 <= limit or limit < 32:
        raise ValueError("limit must be at least 32, and overlap at most a quarter of it")
    words, hard = words_column(F.col(text))
    kind = documents.schema[key].dataType.simpleString()
    given = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("words"), hard.alias("hard"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, one = vocabulary.encoding().encode_ordinary, vocabulary.single()
        for batch in batches:
            for part in slices(batch):
                flat, counts = batch_words(part)
                coded = flat.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                each = distinct_costs(distinct, one, vocabulary.mark)
                blank = np.fromiter((not w.strip() for w in distinct), bool, len(distinct))
                codes = coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
                costs, spaces = each[codes], blank[codes]
                sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.r_[0, np.cumsum(counts)]
                upto = np.r_[0, np.cumsum(costs)]
                chars = np.r_[0, np.cumsum(sizes)]
                tokens, length = np.diff(upto[ends]), np.diff(chars[ends])
                row, rest = [], []
                for i in range(len(part)):
                    if tokens[i] <= limit:
                        row.append(i)
                        rest.append((1, 1, 0, 0, int(length[i]), int(tokens[i])))
                        continue
                    own = slice(ends[i], ends[i + 1])
                    found = pieces(joined(flat, ends[i], ends[i + 1]), sizes[own], costs[own], spaces[own], encode, one, limit, overlap)
                    row += [i] * len(found)
                    rest += [(k + 1, len(found), a, c, b, t) for k, (a, c, b, t) in enumerate(found)]
                names = ["piece", "pieces", "start", "core_start", "end", "n_tokens"]
                columns = [part.column(0).take(pa.array(row, pa.int64()))] + [pa.array([r[j] for r in rest], pa.int64()) for j in range(6)]
                columns.append(pa.array(tokens[np.array(row, np.int64)], pa.int64()))
                if with_text:
                    whole: dict[int, str] = {}
                    texts = []
                    for i, r in zip(row, rest):
                        if i not in whole:
                            whole = {i: joined(flat, ends[i], ends[i + 1])}
                        texts.append(whole[i][r[2] : r[4]])
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", *names, "doc_tokens", *["text"] * with_text])

    schema = f"key {kind}, piece bigint, pieces bigint, start bigint, core_start bigint, end bigint, n_tokens bigint, doc_tokens bigint" + ", text string" * with_text
    return given.mapInArrow(cut, schema).withColumnRenamed("key", key)
