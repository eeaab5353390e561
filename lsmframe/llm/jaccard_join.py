"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

1. Every text becomes its set of shingles as 64-bit hashes. Texts with equal sets form a class, named by a 128-bit digest of
   the set; classes stand for their copies from here on. A table of SLOTS counters sums shingle counts of all documents; its
   size is fixed, so it is collected and broadcast. A slot's rank among all slots orders shingles rare first: a shingle that
   some tens of texts share lifts its slot over those that a prefix takes. Any order gives right results.
2. A class's prefix is its first n - ceil(t n) + 1 shingles in that order. Linked classes share a prefix shingle, so prefix
   rows are dealt by shingle. Within a shingle, pairs pass the length filter, the positional filter and the suffix filter
   (numbers of shingles in sixteen hash ranges bound the symmetric difference from below).
3. Candidate pairs are made distinct, pass the suffix filter on 256 ranges and are verified on whole sets.
4. A shingle that more than SMALL classes share, as in large groups of near copies, isn't expanded into all pairs. In rounds
   some 2, 16, 128, ... of its classes are compared with all others, but only across components: a pair already connected by
   links can't change the components. Classes are chosen by a hash of their own, so shingles of the same classes, as near
   copies have many, choose the same. Rounds go on until no shingle has classes of two components left
   uncompared, so no link between components is lost, and nothing is capped. The rows of a shingle are dealt to tasks in
   blocks, to each of which its chosen classes go, so no shingle is one task's work. `join_links` compares all with all and
   gives every link between classes, and each row's number of links.

A class in very many pairs (HOT) has them dealt to several tasks, to each of which its set goes.

Components of at most FEW links are found in one task, those of more by label propagation with pointer jumping over tables in
the shared folder.

Null and empty texts, or texts without words, have 0 shingles and are linked with nothing. Ids may be null or repeated: a
row is a document, null ids don't count for a component's smallest id, and a component of null ids only has null. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shed, slices, table, tidy, written

SLOTS, SPANS, SMALL, FIRST, GROWTH = 1 << 21, 1 << 10, 16, (2, 16), 8
#: Rows of a shingle that meet in a task at least, chosen classes that it holds at most, pairs of a class that make it hot,
#: rows of a table that are broadcast at most, classes that a task remembers as named, copies of a class that aren't hot.
BLOCK, PIVOTS, HOT, FEW, NAMED, COPIES = 512, 1 << 15, 1 << 16, 1 << 18, 1 << 19, 1024
BITS = 1 << 23
#: Bytes of a text whose words are hashed together.
PART = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


def odd_inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


BASE = 0x9E3779B97F4A7C15 | 5
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A random 64-bit value for each byte, A-Z as a-z.
_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_VALUES[65:91] = _VALUES[97:123]


def powers(x: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64)


class Words:
    """Hashes of words and shingles of a text, in a few passes over its bytes.

    A word's hash is a polynomial in BASE over its bytes' values, a difference of running sums divided by a power of BASE,
    which is odd and so has an inverse modulo 2^64. A text is taken in parts of whole words of at most PART bytes, so tables of
    powers and running sums are bounded; a longer word is a part of its own.
    """

    def __init__(self, size: int = 1 << 15):
        self.grow(size)

    def grow(self, size: int) -> None:
        self.up, self.down = powers(BASE, size), powers(odd_inverse(BASE), size)

    def hashes(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if len(raw) <= PART:
            return self.of_part(raw)
        spaces, out, at = np.flatnonzero(_SPACE[raw]), [], 0
        while at < len(raw):
            k = int(np.searchsorted(spaces, at + PART, "right"))
            if len(raw) - at <= PART:
                end = len(raw)
            elif k and spaces[k - 1] > at:
                end = int(spaces[k - 1])
            else:
                end = int(spaces[k]) if k < len(spaces) else len(raw)
            out.append(self.of_part(raw[at:end]))
            at = end
        return np.concatenate(out)

    def of_part(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.up):
            self.grow(2 * len(raw))
        word = np.concatenate([[False], ~_SPACE[raw], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, end = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * self.up[: len(raw)], dtype=np.uint64)])
            h = (total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * MIX
        return h ^ (h >> np.uint64(29))

    def shingles(self, text: str | None, size: int) -> np.ndarray:
        """Sorted distinct hashes of `size` words in a row; of the whole sequence, if there are fewer. Words are split at
        \\x20 and \\x09 to \\x0D, and A-Z count as a-z."""
        codes = self.hashes(text)
        if not len(codes):
            return codes
        n = min(size, len(codes))
        m = len(codes) - n + 1
        out = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = (out ^ codes[k : k + m]) * MIX
                out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def slots(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Numbers of shingles in sixteen ranges of the hash, modulo 256 each, in two signed 64-bit integers."""
    return tuple((np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16) & 255).astype(np.uint8).view("<i8").tolist())


def text_hash(text: str | None) -> int:
    """A signed 64-bit hash of a text, far cheaper than its shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest((text or "").encode())).view(np.int64))


def ranges(s: np.ndarray) -> bytes:
    """Numbers of shingles in 256 ranges of the hash, modulo 256 each."""
    return (np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 255).astype(np.uint8).tobytes()


def spans(counts: np.ndarray) -> pa.Array:
    """Each row of counters as little-endian 32-bit integers, which stop at their largest value."""
    return pa.array([x.tobytes() for x in np.minimum(counts, (1 << 32) - 1).astype("<u4")], pa.binary())


def added(rows: DataFrame) -> DataFrame:
    """(slot, total): stretches of counters, those of one place added up within each task."""

    def run(batches):
        held = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), spans(np.stack(list(held.values())))], ["slot", "total"])

    return rows.mapInArrow(run, "slot long, total binary")


def describe(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(id, n, cls) of every row; (cls, n, hash, ranges) of every class, hash being one of its texts'; and the shingle
    counts of all rows by slot, which tasks hand on in SPANS stretches of slots. A task names a class's ranges once."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n", "cls", "hash", "ranges", "slot", "total"]

    def run(batches):
        words, counts, id_type, seen = Words(), np.zeros(SLOTS, np.int64), pa.int64(), set()
        for b in (part for whole in batches for part in slices(whole, 1)):
            id_type = b.schema.field(0).type
            if len(seen) > NAMED:
                seen.clear()
            n, cls, hashes, bins = [], [], [], []
            for x in b.column(1):
                text = x.as_py()
                s = words.shingles(text, size)
                name = digest(s) if len(s) else None
                n.append(len(s))
                cls.append(name)
                first = name is not None and name not in seen
                hashes.append(text_hash(text) if first else None)
                bins.append(ranges(s) if first else None)
                seen.add(name)
                np.add.at(counts, slots(s), 1)
            no_slot, no_total = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(hashes, pa.int64()), pa.array(bins, pa.binary()), no_slot, no_total], names)
        if counts.any():
            none = [pa.nulls(SPANS, t) for t in (id_type, pa.int64(), pa.binary(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(SPANS)), spans(counts.reshape(SPANS, -1))], names)

    all_rows = written(docs.mapInArrow(tidy(run), f"id {kind}, n long, cls binary, hash long, ranges binary, slot long, total binary"), "rows")
    counts = np.zeros((SPANS, SLOTS // SPANS), np.int64)
    for r in added(added(all_rows.where("slot is not null").select("slot", "total")).repartition("slot")).toLocalIterator():
        counts[r.slot] = np.frombuffer(r.total, "<u4")
    classes = written(all_rows.where("hash is not null").select("cls", "n", "hash", "ranges").dropDuplicates(["cls"]), "classes")
    return all_rows.where("slot is null").select("id", "n", "cls"), classes, counts.reshape(-1)


def levels(counts: np.ndarray) -> np.ndarray:
    """Ranks of slots by count on a scale of 65,536 steps. A slot's count varies with the shingles it happens to get, and that
    by a share that falls as counts grow, so a scale of counts would have to be finer the larger the input."""
    return (np.searchsorted(np.sort(counts), counts) * 65_536 // len(counts)).astype(np.uint16)


def prefixes(docs: DataFrame, size: int, level: np.ndarray, num: int, den: int) -> DataFrame:
    """(gram, cls, n, pos, sig, sig2): the prefix shingles of every class, pos counting from 1; a task names a class once."""
    held = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        words, seen = Words(), set()
        for b in (part for whole in batches for part in slices(whole, 1)):
            out = []
            if len(seen) > NAMED:
                seen.clear()
            for x in b.column(1):
                s = words.shingles(x.as_py(), size)
                if not len(s) or (cls := digest(s)) in seen:
                    continue
                seen.add(cls)
                n = len(s)
                p = n - -(-num * n // den) + 1
                out.append((s[np.lexsort((s, held.value[slots(s)]))[:p]], cls, n, *signature(s)))
            if out:
                sizes = [len(o[0]) for o in out]
                rep = lambda k, t, sizes=sizes, out=out: np.repeat(np.array([o[k] for o in out], t), sizes)
                cls = np.repeat(np.frombuffer(b"".join([o[1] for o in out]), np.int64).reshape(-1, 2), sizes, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), named(cls), pa.array(rep(2, np.int32)), pa.array(np.concatenate([np.arange(1, m + 1, dtype=np.int32) for m in sizes])), pa.array(rep(3, np.int64)), pa.array(rep(4, np.int64))], ["gram", *ROW])

    return docs.mapInArrow(tidy(run), "gram long, cls binary, n int, pos int, sig long, sig2 long")


ROW = ["cls", "n", "pos", "sig", "sig2"]
PAIR = "kind int, a binary, b binary, gram long, n int, pos int, sig long, sig2 long"
NAMES = ["kind", "a", "b", "gram", "n", "pos", "sig", "sig2"]


def named(cls: np.ndarray) -> pa.Array:
    """Class names from pairs of 64-bit integers."""
    return pa.Array.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(np.ascontiguousarray(cls).tobytes())]).cast(pa.binary())


def unnamed(column: pa.Array) -> np.ndarray:
    """Class names, 16 bytes each, as pairs of 64-bit integers."""
    fixed = column.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], np.int64, 2 * len(fixed), 16 * fixed.offset).reshape(-1, 2) if len(fixed) else np.zeros((0, 2), np.int64)


def passing(n, pos, sig, n2, pos2, sig2, num: int, den: int) -> np.ndarray:
    """Length, positional and suffix filter for arrays of pairs that share a shingle at pos and pos2; sig: k by 2."""
    n, n2, pos, pos2 = (np.asarray(x, np.int64) for x in (n, n2, pos, pos2))
    need = -(-num * (n + n2) // (num + den))
    ok = (den * np.minimum(n, n2) >= num * np.maximum(n, n2)) & (1 + np.minimum(n - pos, n2 - pos2) >= need)
    at = np.flatnonzero(ok)
    a, b = (np.ascontiguousarray(x[at]).view(np.uint8).reshape(-1, 16).astype(np.int16) for x in (sig, sig2))
    apart = np.abs(a - b)
    ok[at] = np.minimum(apart, 256 - apart).sum(axis=1) <= (n + n2 - 2 * need)[at]
    return ok


def as_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    k, none = len(a), lambda t: pa.nulls(len(a), t)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), named(np.where(swap[:, None], b, a)), named(np.where(swap[:, None], a, b)), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64())], NAMES)


def as_rows(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    k = len(c["gram"])
    return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), named(c["cls"]), pa.nulls(k, pa.binary()), pa.array(c["gram"]), pa.array(c["n"]), pa.array(c["pos"]), *(pa.array(np.ascontiguousarray(c["sig"][:, j])) for j in (0, 1))], NAMES)


def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    gram, n, pos, s1, s2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5))
    return {"gram": gram, "cls": unnamed(b.column(1)), "n": n, "pos": pos, "sig": np.stack([s1, s2], axis=1)}


def take(c: dict, rows) -> dict:
    return {k: v[rows] for k, v in c.items()}


def fresh(c: dict) -> dict:
    """Without rows that name the gram and class of the row before them: other tasks may have named the same class."""
    again = (c["gram"][1:] == c["gram"][:-1]) & (c["cls"][1:] == c["cls"][:-1]).all(axis=1)
    return take(c, np.concatenate([[True], ~again])) if again.any() else c


def small_groups(batches, num: int, den: int):
    """Rows sorted by gram, pos, n, cls: pairs (kind 0) of shingles of at most SMALL classes, rows (kind 1) of larger ones.

    Of an unfinished group it holds SMALL classes at most: a larger one's rows pass through at once. Groups that have ended
    are compared together, row by row with the rows 1, 2, ... places on.
    """
    held, large = None, None

    def ended(c: dict):
        if not len(c["gram"]):
            return
        g = c["gram"]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(g)))[np.cumsum(first) - 1]
        big = (size > SMALL) | (g == large if large is not None else False)
        if big.any():
            yield as_rows(take(c, big))
        c = take(c, ~big & (size > 1))
        g = c["gram"]
        for lag in range(1, SMALL):
            at = np.flatnonzero(g[lag:] == g[:-lag])
            if not len(at):
                break
            i, j = at, at + lag
            ok = passing(c["n"][i], c["pos"][i], c["sig"][i], c["n"][j], c["pos"][j], c["sig"][j], num, den)
            if ok.any():
                yield as_pairs(c["cls"][i[ok]], c["cls"][j[ok]])

    for b in batches:
        if not len(b):
            continue
        new = columns(b)
        c = fresh(new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new})
        start = int(np.searchsorted(c["gram"], c["gram"][-1]))
        yield from ended(take(c, slice(0, start)))
        held = take(c, slice(start, None))
        if len(held["gram"]) > SMALL or large == held["gram"][0]:
            large = held["gram"][0]
            if len(held["gram"]) > 1:  # the last row stays, to know it again in the next batch
                yield as_rows(take(held, slice(0, -1)))
            held = take(held, slice(-1, None))
    if held is not None:
        yield from ended(held)


def large_groups(batches, num: int, den: int, block: int = 1 << 18):
    """Rows (gram, cls, n, pos, sig, sig2, comp, block, chunk, side) sorted by gram, block, chunk, side: pairs of the chosen
    classes (side 0) with the rows of their block (side 1) of other components. It holds the chosen of one block and compares
    `block` pairs at a time."""
    at, pivots = None, None
    for b in batches:
        if not len(b):
            continue
        c = columns(b) | {"comp": unnamed(b.column(6))}
        keys = np.stack([c["gram"], *(b.column(k).to_numpy(zero_copy_only=False) for k in (7, 8, 9))], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(b)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            *place, side = keys[lo].tolist()
            g = take(c, slice(lo, hi))
            if place != at:
                at, pivots = place, None
            if side == 0:
                pivots = g if pivots is None else {k: np.concatenate([pivots[k], g[k]]) for k in g}
                continue
            rows = hi - lo
            for k in range(0, 0 if pivots is None else len(pivots["gram"]), step := max(1, block // rows)):
                p = take(pivots, slice(k, k + step))
                i, j = np.nonzero((p["comp"][:, None, 0] != g["comp"][:, 0]) | (p["comp"][:, None, 1] != g["comp"][:, 1]))
                ok = passing(p["n"][i], p["pos"][i], p["sig"][i], g["n"][j], g["pos"][j], g["sig"][j], num, den)
                if ok.any():
                    yield as_pairs(p["cls"][i[ok]], g["cls"][j[ok]])


def looked_up(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """rows (with a class each) whose key is in `of`, a written table, with its columns. One key may have most rows: a table of at
    most FEW keys is broadcast, a larger one is joined over 64 parts of each key."""
    if of.count() <= FEW:
        return rows.join(F.broadcast(of), key)
    parts = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(64)).cast("int")).join(parts, [key, "part"]).drop("part")


def compared(rows: DataFrame, tested: int, first: int, num: int, den: int) -> DataFrame:
    """Candidates among rows (gram, cls, n, pos, sig, sig2, comp, m), m being the classes of the shingle: the classes chosen at
    numbers tested..first-1 of 0..m-1, to which their hash is scaled, with all of other components."""
    blocks = F.ceil(F.col("m") / F.lit(max(BLOCK, min(first, PIVOTS)))).cast("int")
    number = F.floor(F.pmod(F.xxhash64("cls"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("m"))
    chunks = -(-(first - tested) // PIVOTS)
    chosen = rows.withColumn("number", number).where(F.col("number").between(tested, first - 1))
    chosen = chosen.select("gram", *ROW, "comp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.floor((F.col("number") - tested) / PIVOTS).cast("int").alias("chunk"), F.lit(0).alias("side"))
    last = F.least(F.lit(chunks), F.ceil((F.col("m") - tested) / PIVOTS)).cast("int") - 1
    others = rows.select("gram", *ROW, "comp", F.pmod(F.xxhash64("cls", F.lit(1)), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("chunk"), F.lit(1).alias("side"))
    dealt = chosen.unionByName(others).repartition("gram", "block", "chunk").sortWithinPartitions("gram", "block", "chunk", "side")
    return dealt.mapInArrow(tidy(lambda it: large_groups(it, num, den)), PAIR)


def attached(pairs: DataFrame, of: DataFrame, side: str, other: str, columns: list[str], most: int) -> DataFrame:
    """pairs with the columns of `of` for the class on a side, named with the side after them. most: the number of pairs."""
    data = of.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    if most <= HOT:
        return pairs.join(data, side)
    hot = written(pairs.groupBy(side).agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"), "hot")
    if hot.isEmpty():
        return pairs.join(data, side)
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    spread = pairs.join(hot, side, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    data = data.join(hot, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return spread.join(data, [side, "part"]).drop("part")


def both_sides(pairs: DataFrame, of: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written pairs with the columns of `of` for both classes, and the table of the rows of `of` that they need. Where pairs are
    few, the others aren't shuffled."""
    most = pairs.count()
    names = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    needed = written(of.join(F.broadcast(names) if most <= FEW else names, "cls", "left_semi").select("cls", *columns), "needed")
    return attached(attached(pairs, needed, "a", "b", columns, most), needed, "b", "a", columns, most), needed


def near_enough(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct pairs that pass the suffix filter on 256 ranges, for which no shingles are moved."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b.column(k).cast(pa.binary(256)).buffers()[1], np.uint8, 256 * len(b), 256 * b.column(k).offset).reshape(-1, 256).astype(np.int16) if len(b) else np.zeros((0, 256), np.int16) for k in (2, 3))
            n = b.column(4).to_numpy(zero_copy_only=False)
            apart = np.abs(x - y)
            ok = np.minimum(apart, 256 - apart).sum(axis=1) <= n - 2 * -(-num * n // (num + den))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    distinct = written(pairs.select("a", "b").distinct(), "pairs")
    both, needed = both_sides(distinct, classes, ["n", "ranges"])
    near = written(both.select("a", "b", "ranges_a", "ranges_b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(tidy(run), "a binary, b binary"), "near")
    discard(distinct, needed)
    return near


def sets_of(docs: DataFrame, names: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(cls, n, shingles) of the classes named, made anew from one text each. A bitmap of BITS bits, of fixed size, over the
    texts' hashes spares nearly all other texts the work; the few it lets through are harmless."""
    wanted = classes.join(names.distinct(), "cls", "left_semi").select(F.pmod("hash", F.lit(BITS)).alias("k"))
    words = wanted.groupBy((F.col("k") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["word"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        words, seen, found = Words(), set(), np.unpackbits(held.value.view(np.uint8), bitorder="little")
        for b in (part for whole in batches for part in slices(whole, 1)):
            out = []
            if len(seen) > NAMED:
                seen.clear()
            for x in b.column(1):
                if found[(h := text_hash(text := x.as_py())) % BITS] and h not in seen:
                    seen.add(h)
                    if len(s := words.shingles(text, size)):
                        out.append((digest(s), len(s), s.view(np.int64)))
                if len(out) >= 256:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out):
        ends = np.cumsum([0, *(o[1] for o in out)])
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([o[2] for o in out])))], ["cls", "n", "shingles"])

    return written(docs.mapInArrow(tidy(run), "cls binary, n long, shingles array<long>").dropDuplicates(["cls"]), "sets")


def verified(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    both, needed = both_sides(near, sets, ["n", "shingles"])
    same = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = written(both.where(same * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b"), "links")
    discard(needed)
    return links


def lowest(batches):
    """(cls, comp) of every class in all links (a, b) of the batches, which are held together. Classes are numbered in order of
    their names; turns hang the root of a link's higher class below that of the lower one, until both are the same."""
    links = [np.concatenate([unnamed(b.column(0)), unnamed(b.column(1))], axis=1) for b in batches if len(b)]
    if not links:
        return
    names = np.concatenate([x.reshape(-1, 2) for x in links])
    high, low = names.view(">u8").astype(np.uint64).T
    order = np.lexsort((low, high))
    names = names[order]
    first = np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    names, (x, y) = names[first], number.reshape(-1, 2).T
    root = np.arange(len(names))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((up := root[root]) != root).any():
            root = up
    for at in range(0, len(names), HOT):
        yield pa.RecordBatch.from_arrays([named(names[at : at + HOT]), named(names[root[at : at + HOT]])], ["cls", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) of every class in links; comp is the least class name of its component.

    At most FEW links, 32 bytes each, are one task's work: turns over tables would be some ten jobs each, whose plans and
    tasks the driver keeps. Of more, each turn takes the least label among neighbours, then the label's own label; it ends
    when no label changes.
    """
    if links.count() <= FEW:
        return written(links.select("a", "b").repartition(1).mapInArrow(tidy(lowest), "cls binary, comp binary"), "labels")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("cls"), F.col("b").alias("to"))
    labels = written(edges.groupBy("cls").agg(F.min("to").alias("to")).select("cls", F.least("cls", "to").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cls").alias("to"), "comp"), "to").groupBy("cls").agg(F.min("comp").alias("near"))
        moved = labels.join(near, "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("cls").alias("via"), F.col("comp").alias("then"))
        moved = written(moved.join(jump, "via").select("cls", "was", F.least("via", "then").alias("comp")), "labels")
        done = moved.where("comp <> was").isEmpty()
        discard(labels)
        labels = moved.drop("was")
        labels._written_at = moved._written_at
        if done:
            return labels


def candidates(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id, n, cls) per row; the classes; pairs of classes that share a shingle of at most SMALL classes; and the prefix rows
    (gram, cls, n, pos, sig, sig2, m) of the other shingles, m being their number of classes."""
    rows, classes, counts = describe(docs, size)
    shed(docs.sparkSession)
    dealt = prefixes(docs, size, levels(counts), num, den).repartition("gram").sortWithinPartitions("gram", "pos", "n", "cls")
    found = written(dealt.mapInArrow(tidy(lambda it: small_groups(it, num, den)), PAIR), "candidates")
    large = written(found.where("kind = 1").select("gram", F.col("a").alias("cls"), "n", "pos", "sig", "sig2").dropDuplicates(["gram", "cls"]), "large")
    grams = written(large.groupBy("gram").agg(F.count("*").alias("m")), "grams")
    shed(docs.sparkSession)
    return rows, classes, found.where("kind = 0").select("a", "b"), looked_up(large, grams, "gram")


def linked_classes(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) per row, and (cls, comp) of the classes that have links."""
    rows, classes, pairs, prefix = candidates(docs, size, num, den)
    large = written(prefix, "large")
    near = near_enough(pairs, classes, num, den)
    sets = sets_of(docs, near.select(F.col("a").alias("cls")).union(near.select("b")).union(large.select("cls")), classes, size)
    links = verified(near, sets, num, den)
    labels = components(links)
    tested, turn = 0, 0
    while True:
        first = FIRST[turn] if turn < len(FIRST) else tested * GROWTH
        marked = large.drop("comp").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        left = marked.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("m").alias("m")).where((F.col("lo") != F.col("hi")) & (F.col("m") > tested))
        grams = written(left.select("gram"), "grams")
        if grams.isEmpty():
            discard(large, near, sets)
            return rows, labels
        was, large = large, written(looked_up(marked, grams, "gram"), "large")
        discard(was, near, grams)
        near = near_enough(compared(large, tested, first, num, den), classes, num, den)
        if not near.isEmpty() and not (new := verified(near, sets, num, den)).isEmpty():
            was, links = links, written(links.unionByName(new), "links")
            discard(was, new, labels)
            labels = components(links)
        tested, turn = first, turn + 1


def class_links(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) per row, and all links (a, b) between classes, a < b. Every pair of a shared prefix shingle is looked at."""
    rows, classes, pairs, prefix = candidates(docs, size, num, den)
    large = written(prefix.withColumn("comp", F.col("cls")), "large")
    most = large.agg(F.max("m")).first()[0] or 0
    near = near_enough(pairs.unionByName(compared(large, 0, most, num, den).select("a", "b")) if most else pairs, classes, num, den)
    sets = sets_of(docs, near.select(F.col("a").alias("cls")).union(near.select("b")), classes, size)
    return rows, verified(near, sets, num, den)


def join_links(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, class (of equal sets, null without shingles) and n_links, the other rows that it is linked with.

    As a group of near copies may have links between all its classes, the work grows with the links between classes; rows of
    a class count for each other without being paired.
    """
    rows, links = class_links(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), size, num, den)
    sizes = written(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies")), "sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
    per = sizes.join(others, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = rows.join(per, "cls", "left").select("id", F.col("n").alias("n_shingles"), F.lower(F.hex("cls")).alias("class"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return out.withColumnRenamed("id", id_col)


def join_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id. Two rows link if den * intersection >= num * union."""
    rows, labels = linked_classes(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), size, num, den)
    least = written(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "least")
    linked = least.join(labels, "cls")
    by_comp = written(linked.groupBy("comp").agg(F.min("least").alias("component_id")), "components")
    found = looked_up(linked, by_comp, "comp").select("cls", "component_id", F.lit(True).alias("found"))
    named = least.join(found, "cls", "left").select("cls", "copies", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    named = written(named, "named")
    # classes with very many copies are broadcast: fewer than FEW can have more than a FEWth of all rows
    hot = F.broadcast(named.where(F.col("copies") > max(COPIES, rows.count() // FEW)).drop("copies"))
    rest = rows.join(hot.select("cls"), "cls", "left_anti").join(named.drop("copies"), "cls", "left")
    out = rest.unionByName(rows.join(hot, "cls")).select("id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Rows that share an id stay or go together; rows
    without an id stay."""
    groups = join_components(docs, size, num, den)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
