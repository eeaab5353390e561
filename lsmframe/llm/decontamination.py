"""Benchmark decontamination by templates, which also finds re-parameterised questions.

Texts become canonical tokens: numbers, units and names turn into typed placeholders, other words are lower-cased without
signs. Windows of `window` canonical tokens (an item's whole length if shorter) are hashed and joined with the benchmark's
windows by hash. Runs of names, and a number with its unit, are one slot. A match gives a diagonal (an offset between document
and item), around which the item's tokens are aligned over the diagonals at most DRIFT away, so inserted, dropped and replaced
words don't end an alignment. Its slots have to be consistent: each placeholder value of the item stands for one value in the
document; values of the item that come to the same one there are counted, not refused. An item counts as contained if an alignment covers at least `share` of its windows (one diagonal
each, added up), or if NEAR of the item's tokens are equal. Shorter windows of items below 17 tokens let one edit anywhere
be found from 6 tokens on; several edits are found where they leave a window whole.

The benchmark's windows are written in blocks of at most `block_bytes` of text (a longer item is a block of its own) to the
shared folder. One scan of the documents looks each slice of them up in block after block; a worker holds one block, which
stays if it is the only one. Nothing is broadcast or shuffled, however long the benchmark is. Scripts that set no spaces
between words are split into characters.

Windows with fewer than LITERALS literals say little as templates and are looked up by their exact values; items of fewer than
`least` words match only as a whole and word for word, before slots are joined.

There is one row per document and item, its best alignment. Null and empty texts match nothing; repeated rows each give their
own rows; ties go to the first alignment; empty tables give no rows. Names: capitalised words. At the start of a sentence,
where any word has a capital, windows are looked up both with the word itself and with the name's placeholder.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import scratch, slices, table, text_list, tidy
from .token_files import get, put

WINDOW, SHARE, LEAST, LITERALS = 8, 0.4, 5, 3
#: Diagonals joined to one alignment; share of an item's tokens that makes a copy whatever its windows; characters looked at together.
DRIFT, NEAR, PART = 4, 0.8, 1 << 19
#: Units of measure, money and time.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent mph kmh km/h".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\d?[%$€£]?\Z")
NUMBER_UNIT = re.compile(r"(\d[\d.,]*)([a-z]{1,6}|%)\Z")
EDGE = re.compile(r"\A[^\w$€£%]+|[^\w$€£%]+\Z")
#: Scripts without spaces between words (South-East Asian, kana, ideographs).
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NUM, UNIT, NAME = "\0num", "\0unit", "\0name"
MIX = np.uint64(0x9E3779B97F4A7C15)


def code(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode())


#: By kind: 0 literal, 1 number, 2 unit, 3 name, MAYBE a capitalised word at the start of a sentence.
PLACEHOLDERS, MAYBE = np.array([0, code(NUM), code(UNIT), code(NAME)], np.uint64), 4
#: Of a chunk, beside its kind: whether it is capitalised, a sentence ends after it, it is empty, a sign follows its word.
CAPITAL, ENDS, EMPTY, BREAK = 4, 8, 16, 32


def fact(chunk: str) -> tuple[int, int]:
    """A chunk's code as a word, and its flags."""
    if chunk.isascii() and (word := chunk[:-1] if (end := chunk[-1:]) in (".", ",") else chunk).isalpha() and word.islower() and word not in UNITS:
        return code(word), ENDS * (end == ".")
    core = EDGE.sub("", chunk)
    flags = ENDS * (chunk == "\n" or chunk.rstrip("\"')]”’")[-1:] in (".", "!", "?", ":", "。", "！", "？")) | BREAK * (not chunk.endswith(core[-1:] or " "))
    low = re.sub(r"[^\w$€£%]+", "", core.lower())
    if not low:
        return 0, flags | EMPTY
    if (pair := NUMBER_UNIT.match(core.lower())) and pair[2] in UNITS:
        number, unit = (np.array([code(re.sub(r"\W", "", x))], np.uint64) for x in pair.groups())
        with np.errstate(over="ignore"):
            return int((number + second(unit))[0]), flags | 1
    if NUMBER.match(core) or pair:
        return code(low), flags | 1
    if low in UNITS and len(low) > 1:
        return code(low), flags | 2
    return code(low), flags | CAPITAL * (core[0].isupper() and core[1:].islower())


class Tokens(NamedTuple):
    """Canonical tokens of texts one after another: own codes (the slots' values), kinds, and where each text starts.

    words, starts and heads: the codes before slots were joined, where each text starts among them, and each token's first.
    """

    own: np.ndarray
    kind: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    heads: np.ndarray

    def template(self, starts_are_names: bool) -> np.ndarray:
        """Codes with placeholders for slots; a capitalised word at the start of a sentence is a literal or a name."""
        k = np.where(self.kind == MAYBE, 3 if starts_are_names else 0, self.kind)
        return np.where(k > 0, PLACEHOLDERS[k], self.own)


class Canon(dict):
    """Canonical tokens of texts. As a dictionary it holds each chunk's row in `codes` and `flags`; beyond `keep` it starts anew."""

    def __init__(self, keep: int = 200_000):
        self.codes, self.flags, self.keep = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8), keep

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        if k >= len(self.codes):
            self.codes, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.codes, self.flags))
        self.codes[k], self.flags[k] = fact(chunk)
        return k

    def tokens(self, texts: list[str]) -> Tokens:
        if len(self) > self.keep:
            self.clear()
        rows, bounds = [], [0]
        for x in texts:
            rows += map(self.__getitem__, spaced(x).replace("\n", " \n ").replace("\t", " ").replace("\r", " ").split(" "))
            bounds.append(len(rows))
        flags = self.flags[rows]
        # empty chunks go, and hand on that a sentence has ended
        at = np.flatnonzero(flags & EMPTY == 0)
        ended = np.cumsum(flags & ENDS > 0)[at] - (flags[at] & ENDS > 0)
        own, flags, bounds = self.codes[rows][at], flags[at], np.searchsorted(at, bounds)
        starts = np.diff(ended, prepend=0) > 0
        starts[bounds[:-1][bounds[:-1] < len(at)]] = True
        kind = flags & 3
        kind[(flags & CAPITAL > 0) & starts], kind[(flags & CAPITAL > 0) & ~starts] = MAYBE, 3
        return collapsed(own, kind, starts, flags & BREAK > 0, bounds)


def spaced(text: str) -> str:
    """The text with spaces around characters of scripts that set none."""
    if text.isascii():
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return SPACELESS.sub(r" \g<0> ", text)
    return text


def collapsed(own: np.ndarray, kind: np.ndarray, starts: np.ndarray, breaks: np.ndarray, bounds: np.ndarray) -> Tokens:
    """Runs of names, and numbers with their unit, as one slot each."""
    joined = np.zeros(len(own), bool)
    joined[1:] = ((kind[1:] == 3) & (kind[:-1] == 3) & ~breaks[:-1]) | ((kind[1:] == 2) & (kind[:-1] == 1) & ~starts[1:])
    words, first, heads = own, bounds, np.flatnonzero(~joined)
    if joined.any():
        more = np.flatnonzero(joined)
        to = np.searchsorted(heads, more) - 1
        with np.errstate(over="ignore"):
            values = own[heads]
            np.add.at(values, to, second(own[more]) * (more - heads[to]).astype(np.uint64))
        own, kind, bounds = values, kind[heads], np.searchsorted(heads, bounds)
    return Tokens(own, kind, bounds, words, first, heads)


def second(codes: np.ndarray) -> np.ndarray:
    """What a code adds to that of the slot it is joined to."""
    return (codes ^ (codes >> np.uint64(29))) * MIX


def windows(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """By length n, a hash of every n codes in a row."""
    found, out = {}, np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(lengths, default=0)):
            out = (out[: max(len(codes) - k, 0)] ^ codes[k:]) * MIX
            out ^= out >> np.uint64(29)
            if k + 1 in lengths:
                found[k + 1] = out.copy()
    return found


class Item(NamedTuple):
    item_id: object
    own: list[int]
    kind: list[int]
    window: int
    total: int


class Index:
    """Windows of a block of items, sorted by hash, by variant of the template and window length.

    Besides its windows, an item of fewer than 2 * window + 1 tokens has windows of half its length: one changed word leaves
    one of them whole.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, least: int = LEAST):
        canon, self.items, rows = Canon(), [], defaultdict(list)
        for item_id, text in items:
            t = canon.tokens([text or ""])
            if not len(t.words):
                continue
            k, size = len(self.items), len(t.own)
            if (short := len(t.words)) < least:
                self.items.append(Item(item_id, t.own.tolist(), t.kind.tolist(), size, 1))
                rows["short", short].append((windows(t.words, [short])[short][:1], np.array([k], np.int32), np.zeros(1, np.int32)))
                continue
            n = min(window, size)
            self.items.append(Item(item_id, t.own.tolist(), t.kind.tolist(), n, size - n + 1))
            for m in {n, min(n, max((size - 1) // 2, 3))}:
                self.add(rows, t, k, m)
        self.groups = defaultdict(dict)
        for (variant, n), found in rows.items():
            h, at, first = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((first, at, h))
            self.groups[variant][n] = (h[order], at[order], first[order])
        self.bits = {}

    def some(self, variant: str, n: int) -> np.ndarray:
        """A bit per low 20 bits of the windows' hashes, which spares nearly all look-ups."""
        if (variant, n) not in self.bits:
            bits = np.zeros(1 << 20, bool)
            bits[self.groups[variant][n][0] & np.uint64((1 << 20) - 1)] = True
            self.bits[variant, n] = bits
        return self.bits[variant, n]

    def add(self, rows: dict, t: Tokens, k: int, n: int) -> None:
        per = lambda x: np.convolve(x, np.ones(n, int), "valid")
        literal = per((t.kind == 0) | (t.kind == MAYBE)) >= min(LITERALS, n)
        # what is a name in the middle of a sentence here can start one in a text, and the reverse
        named = (per((t.kind == MAYBE) | (t.kind == 3)) > 0) & (per(t.kind == 0) >= min(LITERALS, n))
        for variant, w, chosen in (("literal", t.template(False), literal), ("name", t.template(True), named), ("exact", t.own, ~literal)):
            at = np.flatnonzero(chosen).astype(np.int32)
            if len(at):
                rows[variant, n].append((windows(w, [n])[n][at], np.full(len(at), k, np.int32), at))

    def find(self, t: Tokens, share: float = SHARE):
        """(text, item index, first token, number of tokens, windows matched, all slots equal, values merged) of each item contained."""
        seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
        short = {}
        for variant, groups in self.groups.items():
            codes = t.words if variant == "short" else t.own if variant == "exact" else t.template(variant == "name")
            bounds = t.starts if variant == "short" else t.bounds
            for n, w in windows(codes, list(groups)).items():
                h, item, place = groups[n]
                at = np.flatnonzero(self.some(variant, n)[w & np.uint64((1 << 20) - 1)])
                lo, hi = np.searchsorted(h, w[at], "left"), np.searchsorted(h, w[at], "right")
                text = np.searchsorted(bounds, at, "right") - 1
                inside = (hi > lo) & (at + n <= bounds[text + 1])
                for p, d, i, j in zip(*(x[inside].tolist() for x in (at, text, lo, hi)), strict=True):
                    for k, q in zip(item[i:j].tolist(), place[i:j].tolist(), strict=True):
                        if variant == "short":
                            short.setdefault((d, k), (p, p + n - 1))
                        else:
                            seen[d, k][p - int(bounds[d]) - q] += 1
        out, held = [], None
        for (d, k), ends in short.items():
            first, last = (np.searchsorted(t.heads, ends, "right") - 1 - t.bounds[d]).tolist()
            out.append((d, k, first, last + 1 - first, 1, True, 0))
        for (d, k), shifts in sorted(seen.items()):
            if held is None or held[0] != d:
                part = slice(t.bounds[d], t.bounds[d + 1])
                held = d, t.own[part].tolist(), t.kind[part].tolist()
            if row := contained(self.items[k], *held[1:], shifts, share):
                out.append((d, k, *row))
        return out


def contained(item: Item, own: list[int], kind: list[int], shifts: Counter, share: float):
    """(first token, number of tokens, windows matched, all slots equal, values merged) of the item's best alignment, or None."""
    best = None
    for shift, _ in sorted(shifts.items(), key=lambda x: (-x[1], x[0])):
        straight = [q + shift if 0 <= q + shift < len(own) and equal(item, q, own, kind, q + shift) else -1 for q in range(len(item.own))]
        for pairs in [straight] if min(straight) >= 0 else [align(item, own, kind, shift), straight]:
            row = judged(item, own, kind, pairs, share)
            if row and (best is None or row[2] > best[2]):
                best = row
        if best and best[2] == item.total:
            break
    return best


def equal(item: Item, q: int, own: list[int], kind: list[int], p: int) -> bool:
    a, b = item.kind[q], kind[p]
    return item.own[q] == own[p] or a > 0 and (a == b or a + b == 3 + MAYBE)


def align(item: Item, own: list[int], kind: list[int], shift: int) -> list[int]:
    """Per token of the item its token in the text or -1, from the diagonals at most DRIFT from shift: most equal tokens, then fewest changes of diagonal."""
    wide, size = 2 * DRIFT + 1, len(item.own)
    last, moves = [0] * wide, []
    for q in range(size):
        row, move = [0] * wide, [0] * wide
        for j in range(wide):
            p = q + shift - DRIFT + j
            same = 0 <= p < len(own) and equal(item, q, own, kind, p)
            score, how = last[j] + 4 * same, 1 if same else 0
            if j + 1 < wide and last[j + 1] - 1 > score:
                score, how = last[j + 1] - 1, 2
            if j and row[j - 1] - 1 > score:
                score, how = row[j - 1] - 1, 3
            row[j], move[j] = score, how
        moves.append(move)
        last = row
    pairs, j, q = [-1] * size, max(range(wide), key=lambda j: (last[j], -abs(j - DRIFT))), size - 1
    while q >= 0:
        how = moves[q][j]
        if how == 3:
            j -= 1
            continue
        if how == 1:
            pairs[q] = q + shift - DRIFT + j
        j += how == 2
        q -= 1
    return pairs


def judged(item: Item, own: list[int], kind: list[int], pairs: list[int], share: float):
    """The row of an alignment whose windows reach the share, or whose equal tokens reach NEAR; None if neither or its slots are at odds."""
    pairs, slots = settled(item, own, kind, pairs)
    n, good, covered, run = item.window, 0, set(), 0
    for q, p in enumerate(pairs):
        run = run + 1 if p >= 0 and q and p == pairs[q - 1] + 1 else int(p >= 0)
        if run >= n and counts(item, own, pairs, slots, range(q - n + 1, q + 1)):
            good += 1
            covered.update(range(q - n + 1, q + 1))
    kept = [q for q, p in enumerate(pairs) if p >= 0]
    for tokens, enough in ((sorted(covered), good and good >= share * item.total), (kept, len(kept) >= NEAR * len(pairs) and counts(item, own, pairs, slots, kept))):
        if enough and (slot := consistent(item, own, pairs, slots, tokens)):
            first, end = pairs[tokens[0]], pairs[tokens[-1]] + 1
            return first, end - first, good, *slot
    return None


def counts(item: Item, own: list[int], pairs: list[int], slots: set[int], tokens) -> bool:
    """Whether enough of the tokens are literals, or all are equal as they stand."""
    return sum(q not in slots for q in tokens) >= min(LITERALS, len(tokens)) or all(item.own[q] == own[pairs[q]] for q in tokens)


def settled(item: Item, own: list[int], kind: list[int], pairs: list[int]) -> tuple[list[int], set[int]]:
    """pairs without the words at the start of a sentence that stand for another word and can't be names, and the slots.

    Such a word is a name for sure if it is one in the middle of a sentence too; else it is if it stands for one name throughout.
    """
    aligned = [(q, p) for q, p in enumerate(pairs) if p >= 0]
    names, others = ({x for x, k in zip(item.own, item.kind, strict=True) if k == 3}, {own[p] for _, p in aligned if kind[p] == 3})
    sure = lambda q, p: item.kind[q] and kind[p] and (MAYBE not in (item.kind[q], kind[p]) or item.own[q] in names or own[p] in others)
    slots = {q for q, p in aligned if sure(q, p)}
    there, back = {item.own[q]: own[pairs[q]] for q in slots}, {own[pairs[q]]: item.own[q] for q in slots}  # for words in doubt both ways
    pairs = list(pairs)
    for q, p in aligned:
        a, b = item.own[q], own[p]
        if q not in slots and a != b:
            if there.setdefault(a, b) == b and back.setdefault(b, a) == a:
                slots.add(q)
            else:
                pairs[q] = -1
    return pairs, slots


def consistent(item: Item, own: list[int], pairs: list[int], slots: set[int], tokens: list[int]) -> tuple[bool, int] | None:
    """Whether all slots are equal, and how many of the item's values share one with others; None if a value stands for two."""
    there, same = {}, True
    for q in tokens:
        if q in slots:
            a, b = item.own[q], own[pairs[q]]
            if there.setdefault(a, b) != b:
                return None
            same &= a == b
    return same, len(there) - len(set(there.values()))


def matches(index: Index, canon: Canon, texts: list[str], share: float):
    """(row, *row of find()) of all texts, in parts of bounded size."""
    first = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= PART or k + 1 == len(texts):
            yield from ((first + d, *r) for d, *r in index.find(canon.tokens(texts[first : k + 1]), share))
            first, size = k + 1, 0


def blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark's rows in blocks of whole texts, at most block_bytes together unless one is longer; the driver holds one at a time."""
    held, size = [], 0
    for r in bench.select(bench[id_col].alias("i"), bench[text_col].alias("t")).where("t is not null").toLocalIterator():
        n = len(r.t.encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    if held:
        yield held


def indexed(bench: DataFrame, item_col: str, block_bytes: int) -> list[str]:
    """Paths of the benchmark's blocks, as Index each, in the shared folder."""
    paths, root = [], scratch(bench.sparkSession, "benchmark")
    for k, items in enumerate(blocks(bench, item_col, "text", block_bytes)):
        put(path := f"{root}/block-{k:06d}", pickle.dumps(Index(items), pickle.HIGHEST_PROTOCOL))
        paths.append(path)
    return paths


def found_in(batches, paths: list[str], column: int, share: float, most: int = 16 << 20):
    """(slice of rows, rows of matches() with the item's Item for its index) of Arrow batches. With more than one block the
    slices are larger, as each reads all blocks."""
    canon, index = Canon(), None
    for b in (part for whole in batches for part in (slices(whole, column, most) if len(paths) > 1 else slices(whole, column))):
        texts, out = text_list(b.column(column)), []
        for path in paths:
            if index is None or len(paths) > 1:
                index = pickle.loads(get(path))
            out += [(d, index.items[k], *more) for d, k, *more in matches(index, canon, texts, share)]
        yield b, out


def find_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = SHARE, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document and item contained in it: ids, first_token, n_tokens, matched and item_windows, exact (all slots equal), and
    merged: by how many the item's distinct slot values are more than those that they stand for in the document."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, first_token long, n_tokens long, matched_windows long, item_windows long, exact boolean, merged long"
    names = ["id", "item", "first_token", "n_tokens", "matched_windows", "item_windows", "exact", "merged"]
    paths, item_type = indexed(bench, item_col, block_bytes), to_arrow_type(bench.schema[item_col].dataType)

    def run(batches):
        for b, got in found_in(batches, paths, 1, share):
            ids = b.column(0).to_pylist()
            cols = list(zip(*[(ids[d], item.item_id, int(first), int(n), int(good), item.total, bool(exact), int(merged)) for d, item, first, n, good, exact, merged in got], strict=True)) or [[]] * 8
            types = [b.schema.field(0).type, item_type, *[pa.int64()] * 4, pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", share: float = SHARE, block_bytes: int = 8 << 20) -> DataFrame:
    """docs without those that contain an item; rows pass through a task, without a join."""
    at, paths = docs.columns.index(text_col), indexed(bench, item_col, block_bytes)

    def run(batches):
        for b, got in found_in(batches, paths, at, share):
            keep = np.ones(len(b), bool)
            keep[[d for d, *_ in got]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))
