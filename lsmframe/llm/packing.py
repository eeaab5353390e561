"""Vector bin packing of token sequences: dot-product placement under limits on tokens, segments and loss-bearing tokens.

Documents are cut into pieces of at most `capacity` tokens and `loss` loss-bearing ones. Which tokens bear loss is told by a
column of masks, if any, else all but a document's first do; so without masks a limit of `capacity` never acts. Each task
packs windows of a bounded number of tokens and pieces: into the open sequence goes the piece whose (tokens, segments, loss)
vector has the largest dot product with what is left of the three limits, until none fits. Equal vectors are one entry with a
count, placed as many at once as the heuristic would place in a row, so the work grows with sequences and distinct vectors. Then the emptiest sequences are taken apart and cut to fill the holes of the others, and
what stays over goes to the next window. A sequence that the loss limit closes early is cut into powers of two. At the end of a task what is left is cut into sequences whose lengths are powers
of two, so nothing is padded. No shuffle: a task needs only the documents of its input split.

Null or empty texts are one end id; null ids stay null; repeated rows are packed as often as they come; an empty table
gives no rows. Sequence ids are unique within a run: the task's number and a count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy
from .token_files import words

CAPACITY, SEGMENTS, END_ID, TOKENIZER = 2048, 256, 1, "word_bpe_49k.json"
#: Tokens and pieces that are packed together.
WINDOW, PIECES = 1 << 21, 1 << 17


class Piece:
    """A stretch of a document: the document (id, token ids, loss-bearing tokens before each or None), first id, length."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length

    def loss(self) -> int:
        """A document's first id has nothing before it to be predicted from."""
        before = self.doc[2]
        return self.length - (self.start == 0) if before is None else int(before[self.start + self.length] - before[self.start])

    def fits(self, room: int, loss: int) -> int:
        """How many of its first tokens are within room tokens and loss loss-bearing ones."""
        before = self.doc[2]
        most = loss + (self.start == 0) if before is None else int(np.searchsorted(before, before[self.start] + loss, "right")) - 1 - self.start
        return min(self.length, room, most)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, n), Piece(self.doc, self.start + n, self.length - n)


def place(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Dot-product placement of vectors (rows of sizes) into bins under limits; every row must fit an empty bin.

    The vectors are scaled by the limits and weighted by each dimension's total demand, as the heuristic asks. Ties go to
    the larger vector, and between copies of one to the earlier row.
    """
    radix = sizes.max(axis=0) + 1
    keys = np.ravel_multi_index(sizes.T, radix)
    found, which, counts = np.unique(-keys, return_inverse=True, return_counts=True)
    vectors = np.stack(np.unravel_index(-found, radix), axis=1)
    rows, taken = np.split(np.argsort(which, kind="stable"), np.cumsum(counts)[:-1]), np.zeros(len(counts), np.int64)
    scaled = vectors / limits
    weight = counts @ scaled
    weighted = scaled * (weight / max(weight.max(), 1e-12))
    bins = []
    while (taken < counts).any():
        live = np.flatnonzero(taken < counts)
        room, inside = limits.astype(np.int64), []
        while len(live := live[(vectors[live] <= room).all(axis=1) & (taken[live] < counts[live])]):
            score = weighted[live] @ (room / limits)
            best = int(score.argmax())
            k = live[best]
            # each copy lowers the scores; this vector stays the best until one that falls more slowly has caught up
            falls = weighted[live] @ scaled[k]
            slower = falls < falls[best]
            caught = ((score[best] - score[slower]) / (falls[best] - falls[slower])).min(initial=np.inf)
            some = vectors[k] > 0
            n = int(min(counts[k] - taken[k], (room[some] // vectors[k][some]).min(initial=counts[k]), caught + 1))
            inside += rows[k][taken[k] : taken[k] + n].tolist()
            taken[k] += n
            room = room - n * vectors[k]
        bins.append(inside)
    return bins


def fill(bins: list[list[Piece]], capacity: int, segments: int, loss: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Bins that are full by one of the limits, and the pieces left over: the emptiest bins' pieces are cut to fill the fullest ones' holes."""
    used = [sum(p.length for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -used[k])
    done, spare, last = [], [], len(order)
    for at, k in enumerate(order):
        if at >= last:
            break
        b, room, left, closed = list(bins[k]), capacity - used[k], loss - sum(p.loss() for p in bins[k]), False
        while room and len(b) < segments:
            if not spare:
                if last - 1 <= at:
                    break
                last -= 1
                spare = list(bins[order[last]])
            j = next((j for j in reversed(range(len(spare))) if spare[j].fits(room, left)), None)
            if closed := j is None:
                break
            p = spare.pop(j)
            n = p.fits(room, left)
            if n < p.length:
                p, rest = p.cut(n)
                spare.append(rest)
            b.append(p)
            room -= p.length
            left -= p.loss()
        if room and len(b) < segments and not closed:
            return done, b + spare
        done.append(b)
    return done, spare


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two and sum to the pieces' tokens; none bears more loss than the pieces together."""
    out, stack = [], pieces[::-1]
    total = sum(p.length for p in pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, row = 1 << bit, []
            while room:
                p = stack.pop()
                if p.length > room:
                    p, rest = p.cut(room)
                    stack.append(rest)
                row.append(p)
                room -= p.length
            out.append(row)
    return out


def pack_window(pieces: list[Piece], capacity: int, segments: int, loss: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences that are full or a power of two long, and the pieces to carry on (none if last)."""
    full = [[p] for p in pieces if p.length == capacity]
    rest = [p for p in pieces if p.length != capacity]
    if rest:
        sizes = np.array([(p.length, 1, p.loss()) for p in rest], np.int64)
        bins, rest = fill([[rest[k] for k in b] for b in place(sizes, np.array([capacity, segments, loss], np.int64))], capacity, segments, loss)
        for b in bins:
            full += [b] if sum(p.length for p in b) == capacity else powers(b)
    while last and rest or len(rest) > segments:
        head, room, left = [], capacity, loss
        while rest and len(head) < segments and (n := rest[-1].fits(room, left)):
            p = rest.pop()
            if n < p.length:
                p, back = p.cut(n)
                rest.append(back)
            head.append(p)
            room -= p.length
            left -= p.loss()
        full += powers(head)
    return full, rest


def cut_up(doc, capacity: int, loss: int) -> list[Piece]:
    """A document's pieces, each within both limits."""
    out, rest = [], Piece(doc, 0, len(doc[1]))
    while (n := rest.fits(capacity, loss)) < rest.length:
        p, rest = rest.cut(n)
        out.append(p)
    return [*out, rest]


def before_each(mask, size: int) -> np.ndarray | None:
    """Loss-bearing ids before each of a document's ids and before its end, by the mask of its text's ids; its first id bears none, its end id does."""
    if mask is None:
        return None
    if len(mask) != size - 1:
        raise ValueError(f"a mask of {len(mask)} for a text of {size - 1} tokens")
    bears = np.array([*mask, size > 1], bool)
    bears[0] = False
    return np.concatenate([[0], np.cumsum(bears)])


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, window: int = WINDOW, mask_col: str | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens. window: tokens packed together, in PIECES pieces at most.

    loss: limit on a sequence's loss-bearing tokens, the capacity if None. mask_col: per token of the text (without the end id,
    which bears loss) whether it bears loss, as array<boolean>; null if all do.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    loss = capacity if loss is None else loss
    if loss < 1:
        raise ValueError("no loss-bearing token can be packed under a limit below 1")

    def run(batches):
        enc, part, number = words(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.kind)
        pieces, held = [], 0

        def flush(last: bool):
            nonlocal pieces, held, number
            rows, pieces = pack_window(pieces, capacity, segments, loss, last)
            held = sum(p.length for p in pieces)
            out = []
            for row in rows:
                at = 0
                for p in row:
                    i, ids, _ = p.doc
                    out.append((i, p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].astype("<u4")), len(ids), (part << 36) + number, at, p.loss()))
                    at += p.length
                number += 1
            cols = list(zip(*out, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        names, id_type = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"], pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            masks = b.column(2).to_pylist() if mask_col else [None] * len(b)
            for i, x, mask in zip(b.column(0).to_pylist(), b.column(1), masks, strict=True):
                ids = np.concatenate([np.frombuffer(enc.encode(x.as_py()), enc.kind), end])
                doc = (i, ids, before_each(mask, len(ids)))
                pieces += cut_up(doc, capacity, loss)
                held += len(doc[1])
                if held >= window or len(pieces) >= PIECES:
                    yield flush(False)
        if pieces:
            yield flush(True)

    columns = [docs[id_col].alias("id"), docs[text_col].alias("text")] + ([docs[mask_col].alias("mask")] if mask_col else [])
    made = docs.select(*columns).mapInArrow(tidy(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
    return made.withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed with the query's parameters."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))
