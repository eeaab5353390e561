"""Behavioural cases as op-logs, against expected values and a dictionary model."""

import pytest

from lsmframe.functions.hashing import xxh64
from lsmframe.functions.values import valid
from lsmframe.operators import bloom, directory, lru, merge, pages, placement, running, state
from lsmframe.sources.store import Config, Store, drop_databases, write_results

LOG = "seq long, op string, key long, value long"


def log(spark, text):
    rows = []
    for seq, word in enumerate(text.split()):
        k, _, v = word[1:].partition("=")
        rows.append((seq, word[0], int(k) if k else None, int(v) if v else None))
    return spark.createDataFrame(rows, LOG)


def pairs(df):
    return sorted((r.key, r.value) for r in df.collect())


DELETE_CHAIN = "P1=100 P2=200 P3=300 P4=400 P5=500 P6=600 P7=700 D1 P8=800 P9=900 P2=200 D9"


def test_reads_and_versions(spark):
    ops = log(spark, DELETE_CHAIN)
    assert pairs(state.scan(ops, 1, 9)) == [(k, 100 * k) for k in range(2, 9)]
    assert state.get(ops, 9).count() == 0 and pairs(state.get(ops, 2)) == [(2, 200)]
    got = sorted((r.key, r.value) for r in state.scan_versions(placement.place(ops, 2), 1, 9).collect())
    assert len(got) == 11 and got.count((2, 200)) == 2 and [v for k, v in got if k == 9] == [900, 2**32 - 1]
    assert state.scan(ops, 9, 3).count() == 0


def test_reinsert_after_delete_is_kept(spark):
    ops = log(spark, "D5 P6=1 P5=9")
    stored = merge.runs(placement.place(ops, 1))
    assert pairs(merge.compact(stored)) in ([(5, 9), (6, 1)], [(6, 1)]) and pairs(state.latest(ops)) == [(5, 9), (6, 1)]


def test_placement_matches_a_step_by_step_model(spark):
    import random

    rng = random.Random(3)
    words = [f"P{rng.randrange(20)}={k}" if rng.random() < 0.7 else f"D{rng.randrange(20)}" for k in range(150)]
    got = {r.seq: r.level for r in placement.place(log(spark, " ".join(words)), 4).collect()}
    levels, run, puts, where = [], [], 0, {}
    for seq, w in enumerate(words):
        run.append(seq)
        puts += w[0] == "P"
        if w[0] == "P" and puts == 4:
            levels = [run, *levels] if not levels or levels[0] is None else levels
            carry, k = run, 0
            levels = levels if levels and levels[0] is not run else levels[1:]
            while k < len(levels) and levels[k]:
                carry, levels[k], k = levels[k] + carry, None, k + 1
            levels[k : k + 1] = [carry]
            run, puts = [], 0
    where = {s: k for k, x in enumerate(levels) for s in x or []} | dict.fromkeys(run, -1)
    assert got == where


def test_closes_flush_early(spark):
    got = placement.place_with_closes(log(spark, "P4=400 P1=100 C P3=300 P2=200 C"), 3)
    assert {r.level for r in got.collect()} == {1}


def test_invalid_rows_are_refused(spark):
    for text in ("P1=4294967295", "P4294967295=1", "X1=1"):
        with pytest.raises(Exception, match="not a valid op-log row"):
            valid(log(spark, text)).collect()


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, Config(f"file://{tmp_path}/db"))
    s.put_batch(log(spark, "P1=100 P2=200 P3=300"))
    s.flush()
    again = Store(spark, Config(f"file://{tmp_path}/db"))
    again.put_batch(log(spark, "P9=9 P9=9 P9=9 D1 P2=201"))
    assert again.get(1) is None and again.get(2) == 201
    again.compact()
    assert pairs(Store(spark, Config(f"file://{tmp_path}/db")).scan(0, 10)) == [(2, 201), (3, 300), (9, 9)]


def test_stream_flushes_batches(spark, tmp_path):
    from lsmframe.streaming.ingest import read_oplog_stream, stream_to_store

    log(spark, "P1=1 P2=2 D1").write.parquet(f"{tmp_path}/in")
    stream_to_store(read_oplog_stream(spark, f"{tmp_path}/in"), f"file://{tmp_path}/db", f"{tmp_path}/cp").awaitTermination()
    assert pairs(Store(spark, Config(f"file://{tmp_path}/db")).scan(0, 9)) == [(2, 2)]


def test_hash_pages_and_lru(spark):
    from pyspark.sql import functions as F

    d = spark.sql("select 1 as k, '' as e, 'a' as a")
    assert d.select(xxh64(F.col("k")), xxh64(F.col("k"), 42), xxh64(F.col("e")), xxh64(F.col("a"))).first() == (-851299076295404719, -6698625589789238999, -1205034819632174695, -3292477735350538661)
    n = spark.createDataFrame([(1,), (30,), (264209,)], "n long")
    assert [r[0] for r in n.orderBy("n").select(pages.node_count(F.col("n"))).collect()] == [2, 31, 264732]
    keys = spark.range(0, 1100).select((F.col("id") * 2).alias("key"))
    leaves = pages.leaves(keys, 100)
    assert leaves.count() == 11
    got = {r.key: r.leaf_no for r in pages.fence_lookup(leaves, spark.createDataFrame([(0,), (199,), (198,), (2198,), (2199,)], "key long")).collect()}
    assert got == {0: 0, 198: 0, 199: 1, 2198: 10, 2199: None}
    trace = spark.createDataFrame([(1, k, p) for k, p in enumerate([1, 2, 1, 3, 2])], "trace int, seq long, page int")
    assert [r.evicted for r in lru.replay(trace, 2).orderBy("seq").collect()] == [None, None, None, 2, 1]


def levels(store):
    return {r.level: (r.first_run, r.last_run, r.entries) for r in store.manifest().collect()}


def test_store_carries_runs_up_levels(spark, tmp_path):
    s = Store(spark, Config(f"file://{tmp_path}/db", memtable=2))
    for k in range(1, 9):
        s.put(k, 100 * k)
        if k in (2, 4, 8):
            assert [r.sst_num for r in s.manifest().collect()] == [{2: 0, 4: 2, 8: 4}[k]]
    assert levels(s) == {2: (0, 3, 8)}
    s.put(9, 900)
    assert pairs(s.scan(3, 7)) == [(k, 100 * k) for k in range(3, 8)] and s.get(9) == 900
    assert Store(spark, s.config).get(9) is None  # what is in the memtable alone is not stored
    s.vacuum()
    assert pairs(s.scan(0, 10)) == [(k, 100 * k) for k in range(1, 10)]


def test_store_as_the_chain_of_deletes(spark, tmp_path):
    s = Store(spark, Config(f"file://{tmp_path}/db", memtable=2))
    for k in range(1, 8):
        s.put(k, 100 * k)
    s.delete(1)
    s.put(8, 800)
    s.put(9, 900)
    s.put(2, 200)
    s.delete(9)
    assert s.get(9) is None and s.get(1) is None and s.get(2) == 200 and s.get(7) == 700
    got = sorted((r.key, r.value) for r in s.scan_versions(1, 9).collect())
    want = sorted((r.key, r.value) for r in state.scan_versions(placement.place(log(spark, DELETE_CHAIN), 2), 1, 9).collect())
    want.remove((1, 2**32 - 1))  # a merge into the last level drops tombstones
    assert got == want and s.scan(9, 3).count() == 0
    wanted = spark.createDataFrame([(1,), (2,), (9,), (77,)], "key long")
    assert {r.key: r.value for r in s.multi_get(wanted).collect()} == {1: None, 2: 200, 9: None, 77: None}


def test_store_closes_early_and_opens_again(spark, tmp_path):
    config = Config(f"file://{tmp_path}/db", memtable=3)
    s = Store(spark, config)
    s.put(4, 400)
    s.put(1, 100)
    s.close()
    s.close()  # nothing to write, nothing done
    s.put(3, 300)
    s.put(2, 200)
    s.close()
    again = Store(spark, config)
    assert levels(again) == {1: (0, 1, 4)} and [again.get(k) for k in (1, 2, 3, 4, 5)] == [100, 200, 300, 400, None]
    again.delete(4)
    again.close()
    assert levels(again).keys() == {0, 1}
    again.compact_level(0)
    assert levels(again) == {1: (0, 2, 3)} and again.get(4) is None and again.get(1) == 100
    empty = Store(spark, Config(f"file://{tmp_path}/other"))
    empty.flush()
    empty.compact()
    assert empty.get(1) is None and empty.scan(0, 9).count() == 0 and levels(empty) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_store_equals_a_dictionary(spark, tmp_path, seed):
    import random

    rng, model, seq = random.Random(seed), {}, 0
    s = Store(spark, Config(f"file://{tmp_path}/db", memtable=4))
    for _ in range(3):
        rows = []
        for _ in range(rng.randrange(1, 40)):
            k, v = rng.randrange(12), rng.randrange(1000)
            rows.append((seq, "P", k, v) if rng.random() < 0.7 else (seq, "D", k, None))
            model[k] = rows[-1][3]
            seq += 1
        s.put_batch(spark.createDataFrame(rows, LOG))
        assert pairs(s.scan(0, 20)) == sorted((k, v) for k, v in model.items() if v is not None)
        n = 1 + max((r.last_run for r in s.levels()), default=-1)
        assert set(levels(s)) == {b for b in range(9) if n >> b & 1}
    assert all(s.get(k) == model.get(k) for k in range(4))
    s.compact()
    assert pairs(Store(spark, s.config).scan(0, 20)) == sorted((k, v) for k, v in model.items() if v is not None)


def test_databases_results_and_contents(spark, tmp_path):
    for name in ("test_a", "test_b", "other"):
        (tmp_path / name).mkdir()
    assert drop_databases(spark, f"file://{tmp_path}", "test_") == ["test_a", "test_b"] and (tmp_path / "other").exists()
    assert drop_databases(spark, f"file://{tmp_path}/none", "x") == []
    write_results(spark.createDataFrame([("put", 1, 2.5)], "op_type string, `data_size(MB)` int, `throughput(op/s)` double"), f"file://{tmp_path}/csv")
    assert [f.read_text() for f in (tmp_path / "csv").glob("part*")] == ["op_type,data_size(MB),throughput(op/s)\nput,1,2.5\n"]
    a = spark.createDataFrame([(1, None), (2, 3), (2, 3)], "k long, v long")
    assert state.identical(a, a.select("v", "k").select("k", "v")) and not state.identical(a, a.distinct())
    assert [tuple(r) for r in state.differences(a, a.distinct()).collect()] == [(2, 3, 1)]


def test_running_sums_over_stretches(spark):
    import random

    rng = random.Random(4)
    keys = [rng.randrange(-(2**62), 2**62) for _ in range(200)] + list(range(300)) + [2**20 * k for k in range(1, 100)]
    rows = [(k, rng.choice([None, 0, 1, 5])) for k in set(keys)]
    got = {r.k: r.s for r in running.running(spark.createDataFrame(rows, "k long, v long"), "k", {"s": __import__("pyspark").sql.functions.col("v")}).collect()}
    at, want = 0, {}
    for k, v in sorted(rows):
        at += v or 0
        want[k] = at
    assert got == want


def test_closes_match_a_step_by_step_model(spark):
    import random

    rng = random.Random(8)
    words = [rng.choice(["P", "P", "P", "D", "C"]) for _ in range(160)]
    rows = [(k, w, None if w == "C" else rng.randrange(9), 1 if w == "P" else None) for k, w in enumerate(words)]
    got = {r.seq: (r.run, r.n) for r in placement.place_with_closes(spark.createDataFrame(rows, LOG), 4).collect()}
    run, puts, pending, where = 0, 0, 0, {}
    for k, w in enumerate(words):
        if w == "C":
            run, puts, pending = run + (pending > 0), 0, 0
            continue
        where[k], pending = run, pending + 1
        puts += w == "P"
        if puts == 4:
            run, puts, pending = run + 1, 0, 0
    assert got == {k: (r, run) for k, r in where.items()}


def test_tree_up_to_the_root(spark):
    leaves = spark.createDataFrame([(k, 10, 10 * k, 10 * k + 9) for k in range(30)], "leaf_no int, num_keys long, min_key long, max_key long")
    got = sorted((r.height, r.node_no, r.children, r.fence) for r in pages.tree(leaves, 4).collect())
    assert got == [*[(1, k, min(4, 30 - 4 * k), 10 * min(4 * k + 3, 29) + 9) for k in range(8)], (2, 0, 4, 159), (2, 1, 4, 299), (3, 0, 2, 299)]
    assert [tuple(r) for r in pages.tree(leaves.where("leaf_no = 0"), 4).collect()] == [(1, 0, 1, 9)] and pages.tree(leaves.where("false")).count() == 0


def test_bloom_positions_and_absent_keys(spark):
    import xxhash

    at = lambda key, bits, k: {xxhash.xxh64_intdigest(key.to_bytes(4, "little"), seed) % bits for seed in range(k)}
    one = bloom.build(spark.createDataFrame([(1,)], "key long"), 150, 10)
    row = one.first()
    assert (bloom.hashes(15), row.total_bits, row.k) == (10, 150, 10) and set(row.positions) == at(1, 150, 10)
    keys = [3, 2**31, 2**32 - 3, 77]
    asked = spark.createDataFrame([(k,) for k in [*keys, *range(100, 400)]], "key long")
    held = bloom.build(spark.createDataFrame([(k,) for k in keys], "key long"), 60, 3)
    full = set().union(*(at(k, 60, 3) for k in keys))
    assert set(held.first().positions) == full
    assert {r.key: r.maybe for r in bloom.probe(asked, held, 60, 3).collect()} == {k: at(k, 60, 3) <= full for k in [*keys, *range(100, 400)]}
    assert not any(r.maybe for r in bloom.probe(asked, bloom.build(asked.where("false"), 60, 3), 60, 3).collect())


def test_directory_against_a_plain_one(spark):
    import xxhash

    low = lambda p, d: format(xxhash.xxh64_intdigest(p.encode()), "064b")[64 - d :]
    names = [f"db/sst_{k % 7}.dat-{k}" for k in range(200)]
    rows = spark.createDataFrame([(x,) for x in [*names, names[0], None]], "page_id string")
    assert {r.page_id: r.b for r in rows.where("page_id is not null").select("page_id", directory.bucket_id(rows.page_id, 4).alias("b")).collect()} == {x: low(x, 4) for x in names}

    def plain(bucket, d, inside, limit, most):
        if len(inside) <= limit or d == most:
            return {bucket: (d, len(inside))} if inside else {}
        return {k: v for bit in "01" for k, v in plain(bit + bucket, d + 1, [x for x in inside if low(x, d + 1) == bit + bucket], limit, most).items()}

    for limit, most, step in ((4, 40, 20), (1, 7, 3), (500, 10, 20)):
        directory.STEP = step
        want = {k: v for b in "01" for k, v in plain(b, 1, [x for x in names if low(x, 1) == b], limit, most).items()}
        got = directory.split(rows, limit, 1, most)
        assert {r.bucket: (r.local_depth, r.pages) for r in got.collect()} == want
    directory.STEP = 20
    got = directory.split(rows, 4, 1, 40)
    c = directory.counters(got, 1).first()
    assert (c.size, c.num_directory) == (200, 2**c.global_depth) and c.num_buckets == got.count()
    merged = {r.bucket: (r.local_depth, r.pages) for r in directory.merge(got, 8).collect()}
    before = {r.bucket: (r.local_depth, r.pages) for r in got.collect()}
    flip = lambda b: ("1" if b[0] == "0" else "0") + b[1:]
    want = {}
    for b, (d, n) in before.items():
        other = before.get(flip(b))
        want |= {b[1:]: (d - 1, n + other[1])} if other and other[0] == d and n + other[1] <= 8 else {b: (d, n)}
    assert merged == want
    more = spark.createDataFrame([("x",), (names[0],)], "page_id string")
    assert directory.insert(rows, more).count() == 201 and directory.remove(rows, more).count() == 199
    assert directory.get(rows, names[5], 3).first().bucket == low(names[5], 3) and directory.get(rows, "x", 3).count() == 0
    assert directory.depths(2, 8) == (1, 3) and directory.create(spark, 2).count() == 2 and directory.shrink(directory.expand(directory.create(spark, 4))).count() == 4
    assert [r.b for r in spark.createDataFrame([("111",)], "b string").select(directory.pair(__import__("pyspark").sql.functions.col("b")).alias("b")).collect()] == ["011"]


def test_lru_with_removals_and_over_stretches(spark):
    import random
    from collections import OrderedDict

    rows = [(1, k, op, p) for k, (op, p) in enumerate([("A", 1), ("A", 2), ("R", 1), ("A", 3), ("A", 4), ("R", 3), ("R", 77), ("E", None), ("E", None), ("E", None)])]
    got = lru.replay(spark.createDataFrame(rows, "trace int, seq long, op string, page int"), 9).orderBy("seq").collect()
    assert [r.evicted for r in got][-3:] == [2, 4, None]
    rng = random.Random(5)
    trace = [(k + 5, rng.choice([rng.randrange(12), rng.randrange(300)])) for k in range(3000) if rng.random() < 0.9]
    for capacity, bits in ((8, 4), (8, 16), (1, 7), (500, 6)):
        cache, want = OrderedDict(), {}
        for seq, p in trace:
            hit = p in cache
            cache[p] = True
            cache.move_to_end(p)
            want[seq] = (hit, cache.popitem(last=False)[0] if len(cache) > capacity else None)
        got = {r.seq: (r.hit, r.evicted) for r in lru.replay_whole(spark.createDataFrame(trace, "seq long, page int"), capacity, bits).collect()}
        assert got == want, (capacity, bits)
