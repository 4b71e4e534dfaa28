"""Packing token sequences in order, with window cuts chosen by dynamic programming.

Documents are laid end to end in the order in which they are stored.  Windows of
at most ``size`` tokens are cut from that line; a cut costs nothing at the end of
a document, a little at the end of a sentence and more elsewhere, and each window
costs its padding.  A monotone queue finds the cheapest set of cuts in linear
time.  Every scan task packs its own rows: nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from markbook.llm.common import held, text_or_empty

TOKENIZER_FILE = public_tokenizers.path("word_bpe_49k.json")
SIZE = 2048
END_ID = 1


@dataclass(frozen=True)
class Costs:
    """What a cut costs, in tokens of padding, by where it falls."""

    document: int = 0
    sentence: int = 4
    elsewhere: int = 16
    #: In each stretch of so many tokens the last sentence end is a place for a cut, else its first token.
    step: int = 32
    #: Tokens laid out before cuts are chosen; the last window of a line is carried on.
    line: int = 1 << 20


# Fixed values, from the tokenizer's file: how it splits normalised text into pieces, here
# for texts of ASCII and Latin-1 characters, which its normaliser leaves alone but for case
# and white space.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")
_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
# Byte-level vocabularies write bytes that do not print as the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit numbers."""

    def __init__(self, model, keep: int) -> None:
        self.model, self.keep = model, keep

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.keep:
            self.clear()
        printed = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        ids = self[piece] = np.array([t.id for t in self.model.tokenize(printed)], dtype="<u4").tobytes()
        return ids


class Encoder:
    """Token ids of texts; the ids of a piece are worked out once and remembered."""

    def __init__(self, file: str, keep: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        self.tokenizer = Tokenizer.from_file(file)
        self.pieces = _Pieces(self.tokenizer.model, keep)
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for piece, i in vocabulary.items():
            self.ends_sentence[i] = piece.removesuffix("</w>").endswith((".", "!", "?"))

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def choose_cuts(places: list[int], costs: list[int], size: int, powers: Sequence[int]) -> list[int]:
    """The cheapest cuts of a line: indexes of ``places``, first and last included.

    ``places`` ascend from 0 and no two neighbours are further apart than ``size``;
    ``costs`` are theirs.  A window costs ``size`` less its length, or nothing when
    its length is one of ``powers`` (of two).  The cost of a window grows by one with each token
    less, so ``best[i] + places[i]`` orders the starts: a queue of ascending values
    has the best start of all that are within reach at its front.
    """
    count = len(places)
    best = [0] * count
    start_of = [0] * count
    index = {p: i for i, p in enumerate(places)}
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # best + place, place, index
    for j in range(1, count):
        here = places[j]
        while queue[0][1] < here - size:
            queue.popleft()
        low, _, begin = queue[0]
        low += size - here
        if low:
            for length in powers:
                i = index.get(here - length)
                if i is not None and best[i] < low:
                    low, begin = best[i], i
        best[j] = low = low + costs[j]
        start_of[j] = begin
        low += here
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, here, j))
    cuts = [count - 1]
    while cuts[-1]:
        cuts.append(start_of[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Lays documents end to end and yields pieces of finished windows."""

    def __init__(self, ends_sentence: np.ndarray, size: int, costs: Costs, first_window: int) -> None:
        self.ends_sentence, self.size, self.costs = ends_sentence, size, costs
        self.window = first_window
        #: Documents on the line: id, ids, tokens of the whole, tokens packed before.
        self.line: list[tuple[object, np.ndarray, int, int]] = []
        self.laid = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        done = 0
        while done < len(ids):  # a very long document fills several lines
            part = ids[done : done + self.costs.line]
            self.line.append((doc_id, part, len(ids), done))
            done += len(part)
            self.laid += len(part)
            if self.laid >= self.costs.line:
                yield from self.cut(last=False)

    def _places(self) -> tuple[list[int], list[int]]:
        tokens = np.concatenate([part for _, part, _, _ in self.line])
        count, step = len(tokens), self.costs.step
        ends = np.flatnonzero(self.ends_sentence[tokens]) + 1
        ends = ends[np.append(ends[1:] // step != ends[:-1] // step, True)] if len(ends) else ends
        documents = np.cumsum([len(part) for _, part, _, _ in self.line])
        whole = np.array([done + len(part) == total for _, part, total, done in self.line])
        cost = np.full(count + 1, self.costs.elsewhere, dtype=np.int64)
        cost[ends] = self.costs.sentence
        cost[documents[whole]] = self.costs.document
        empty = np.ones(count // step + 1, dtype=bool)
        empty[ends // step] = False
        at = np.zeros(count + 1, dtype=bool)
        at[np.flatnonzero(empty) * step] = True
        at[ends] = True
        at[documents] = True
        at[0] = True
        places = np.flatnonzero(at)
        return places.tolist(), cost[places].tolist()

    def cut(self, last: bool) -> Iterator[tuple]:
        """Pieces of the line's windows; unless it is the last line, the last window stays."""
        if not self.line:
            return
        places, costs = self._places()
        # Short windows without padding help little but at the very end.
        powers = [1 << b for b in range(self.size.bit_length()) if last or 1 << b >= self.size // 4]
        cuts = [places[i] for i in choose_cuts(places, costs, self.size, powers)]
        if not last and len(cuts) > 2:
            cuts.pop()
        at = begun = 0  # document on the line, its start
        for start, stop in zip(cuts, cuts[1:]):
            here = start
            while here < stop:
                doc_id, part, total, done = self.line[at]
                until = min(stop, begun + len(part))
                piece = part[here - begun : until - begun]
                yield (
                    doc_id,
                    done + here - begun,
                    len(piece),
                    zlib.crc32(piece.astype("<u4").tobytes()),
                    total,
                    self.window,
                    here - start,
                )
                here = until
                if until == begun + len(part):
                    at, begun = at + 1, until
            self.window += 1
        left = self.line[at:]
        if left and cuts[-1] > begun:
            doc_id, part, total, done = left[0]
            left[0] = (doc_id, part[cuts[-1] - begun :], total, done + cuts[-1] - begun)
        self.line = left
        self.laid = sum(len(part) for _, part, _, _ in left)


_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame,
    tokenizer_file: str = TOKENIZER_FILE,
    size: int = SIZE,
    end_id: int = END_ID,
    costs: Costs | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and then ``end_id``; a null or empty text is that id
    alone.  Each id lies in exactly one piece; the pieces of a sequence follow each
    other without a gap and hold at most ``size`` ids.  Sequence numbers are unique:
    the task's number in the upper bits, the window's in the lower 40.  Repeated rows
    and null ids are packed like any other row; extra columns are ignored; an empty
    table gives no rows.  A task holds one line of tokens, whatever it reads: long
    documents span several lines.  The tokenizer's file must be readable where tasks
    run.
    """
    costs = costs or Costs()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("tokenizer", tokenizer_file), lambda: Encoder(tokenizer_file))
        packer = Packer(encoder.ends_sentence, size, costs, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4").tobytes()
        id_type = None
        types = [None, *[pa.int64()] * 6]

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [()] * 7
            types[0] = id_type
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(_PIECE)
            )

        for batch in batches:
            id_type = batch.column("doc_id").type
            pieces: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("body"), strict=True):
                tokens = encoder.encode(text.as_py())
                pieces += packer.add(doc_id.as_py(), np.frombuffer(tokens + end, dtype="<u4"))
            if pieces:
                yield rows(pieces)
        pieces = list(packer.cut(last=True))
        if pieces:
            yield rows(pieces)

    body = docs.select("doc_id", text_or_empty("text").alias("body"))
    return body.mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
