"""One query per operator over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import FANOUT
from ..operators import bloom, directory, lru, merge, pages, placement, state
from ..sources import oplog
from ..sources.shared import scratch
from ..sources.store import Config, Store

M, LO, HI, KEY = 64, 10, 60, 42
SMALL_FANOUT = 8


def log(spark, sf_dir) -> DataFrame:
    return oplog.events(spark, sf_dir)


def placed(spark, sf_dir) -> DataFrame:
    return placement.place(log(spark, sf_dir), M)


def order_pages(spark, sf_dir) -> DataFrame:
    return pages.leaves(oplog.orders(spark, sf_dir))


def wanted(spark, sf_dir) -> DataFrame:
    """Keys to look up: every customer number, most of which are no event's user."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"))


def page_names(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("db/sst_"), (F.col("leaf_no") % 7).cast("string"), F.lit(".dat"))
    got = pages.with_offsets(order_pages(spark, sf_dir)).withColumn("path", path)
    return got.select(pages.page_id(F.col("path"), F.col("offset")).alias("page_id"), oplog.run_number(F.col("path")).alias("number"), oplog.run_level(oplog.run_number(F.col("path"))).alias("level"))


def trace(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).select("seq", F.col("key").alias("page"))


def entries(spark, depth: int) -> DataFrame:
    return spark.range(1 << depth).select(F.lpad(F.bin("id"), depth, "0").alias("id"), F.lpad(F.bin("id"), depth, "0").alias("bucket"))


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The log's stored ops as two runs: those of the first half of all flushes, and the rest."""
    stored = placed(spark, sf_dir).where("level >= 0")

    def one(rows: DataFrame) -> DataFrame:
        return state.versions(rows, "key").select("key", F.when(F.col("op") == "P", F.col("value")).alias("value"), (F.col("op") == "D").alias("is_tombstone"), "seq")

    return one(stored.where("run < n div 2")), one(stored.where("run >= n div 2"))


def bloom_params(spark, sf_dir) -> DataFrame:
    layout = placed(spark, sf_dir).where("level >= 0").groupBy("level").agg(F.count_distinct("key").alias("keys"))
    leaf = F.ceil(F.col("keys") / 508).cast("long")
    return layout.select("level", bloom.total_bits(5, leaf).alias("bits"), F.lit(bloom.hashes(5)).alias("hashes"), bloom.total_bits(15, F.col("keys")).alias("bits_by_key"), F.lit(bloom.hashes(15)).alias("hashes_by_key"))


def bloom_runs(spark, sf_dir) -> DataFrame:
    """A filter per level, sized by its number of keys: the positions that are set."""
    keys = merge.runs(placed(spark, sf_dir)).select("level", "key")
    bits = keys.groupBy("level").agg(bloom.total_bits(15, F.count("*")).alias("bits"))
    got = bloom.build(keys.join(F.broadcast(bits), "level"), F.col("bits"), bloom.hashes(15), "level")
    return got.select("level", "total_bits", F.explode("positions").alias("position"))


def bloom_probe(spark, sf_dir) -> DataFrame:
    """Every customer number against a filter of the log's keys: most are in the log, absent ones are rejected or false positives."""
    bits, k = 4088, 3
    keys = log(spark, sf_dir).select("key").distinct()
    return bloom.probe(wanted(spark, sf_dir).distinct(), bloom.build(keys, bits, k), bits, k)


def bucket_ids(spark, sf_dir) -> DataFrame:
    ids = page_names(spark, sf_dir).select("page_id")
    return ids.select("page_id", directory.bucket_id(F.col("page_id"), 4).alias("bucket"))


def page_insert(spark, sf_dir) -> DataFrame:
    """Pages of the lower numbers, and then all pages: those that are there already stay one."""
    names = page_names(spark, sf_dir)
    return directory.insert(names.where("number < 4"), names)


def page_remove(spark, sf_dir) -> DataFrame:
    names = page_names(spark, sf_dir)
    return directory.remove(names, names.where("level = 0"))


def bucket_split(spark, sf_dir) -> DataFrame:
    return directory.split(page_names(spark, sf_dir), 4, 1, 40)


def lru_replay(spark, sf_dir) -> DataFrame:
    """Hits and evictions of a cache of 8 pages, over the whole trace, counted by thousands of sequence numbers."""
    got = lru.replay_whole(trace(spark, sf_dir), 8, 12).groupBy(F.floor(F.col("seq") / 1000).cast("long").alias("trace"))
    return got.agg(F.count("*").alias("accesses"), F.sum(F.col("hit").cast("long")).alias("hits"), F.count("evicted").alias("evictions"))


def opened(spark, sf_dir) -> Store:
    """A new database that has taken the whole log and holds its last ops in the memtable."""
    store = Store(spark, Config(scratch(spark, "db"), M))
    store.put_batch(log(spark, sf_dir))
    return store


def reopened(spark, sf_dir, close: bool) -> Store:
    store = opened(spark, sf_dir)
    if close:
        store.close()
    return Store(spark, store.config)


def store_compact(spark, sf_dir) -> DataFrame:
    store = opened(spark, sf_dir)
    store.compact()
    return store.runs().select("level", "key", "value")


def differing(spark, sf_dir) -> DataFrame:
    """Rows that the memtable changes: those that only the latest state has (more is 1) or only the stored levels give (-1)."""
    return state.differences(state.latest(log(spark, sf_dir)), state.newest_level_wins(merge.runs(placed(spark, sf_dir))))


def node_counts(spark, sf_dir) -> DataFrame:
    got = order_pages(spark, sf_dir).agg(F.count("*").alias("leaves"))
    return got.select("leaves", pages.node_count(F.col("leaves"), FANOUT).alias("nodes"), pages.node_count(F.col("leaves"), SMALL_FANOUT).alias("nodes_small"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "latest_state": lambda s, d: state.latest(log(s, d)),
    "get_point": lambda s, d: state.get(log(s, d), 7),
    "get_missing": lambda s, d: state.get(log(s, d), 4_000_000_000),
    "multi_get": lambda s, d: state.multi_get(log(s, d), wanted(s, d)),
    "scan_latest": lambda s, d: state.scan(log(s, d), LO, HI),
    "scan_versions": lambda s, d: state.scan_versions(placed(s, d), LO, HI),
    "memtable_scan": lambda s, d: state.memtable_scan(placed(s, d), 0, 2**32 - 3).select("key", "value"),
    "sst_scan": lambda s, d: state.scan_versions(placed(s, d).where("level >= 0"), LO, HI),
    "op_placement": lambda s, d: placed(s, d).select("seq", "run", "level"),
    "flush_batches": lambda s, d: merge.flush_batches(placed(s, d)),
    "level_layout": lambda s, d: merge.level_layout(placed(s, d)),
    "newest_level_wins": lambda s, d: state.newest_level_wins(merge.runs(placed(s, d))),
    "merge_two_runs": lambda s, d: merge.merge(*halves(s, d)),
    "merge_last_level": lambda s, d: merge.merge(*halves(s, d), last_level=True),
    "compact_all": lambda s, d: merge.compact(merge.runs(placed(s, d))),
    "tombstones": lambda s, d: merge.collected(merge.runs(placed(s, d))).where("is_tombstone").groupBy("level").agg(F.count("*").alias("tombstones")),
    "leaf_pages": order_pages,
    "leaf_offsets": lambda s, d: pages.with_offsets(order_pages(s, d)).select("leaf_no", "offset"),
    "node_count": node_counts,
    "internal_fences": lambda s, d: pages.internal_fences(order_pages(s, d), SMALL_FANOUT),
    "fence_lookup": lambda s, d: pages.fence_lookup(order_pages(s, d), wanted(s, d).select((F.col("key") * 97).alias("key"))),
    "tree_levels": lambda s, d: pages.tree(order_pages(s, d), SMALL_FANOUT),
    "page_ids": page_names,
    "bloom_params": bloom_params,
    "bloom_runs": bloom_runs,
    "bloom_probe": bloom_probe,
    "bucket_ids": bucket_ids,
    "page_insert": page_insert,
    "page_get": lambda s, d: directory.get(page_names(s, d), "db/sst_1.dat-2", 4),
    "page_remove": page_remove,
    "bucket_split": bucket_split,
    "bucket_merge": lambda s, d: directory.merge(bucket_split(s, d), 6),
    "directory_counters": lambda s, d: directory.counters(bucket_split(s, d), 1),
    "directory_expand": lambda s, d: directory.expand(entries(s, 3)),
    "directory_shrink": lambda s, d: directory.shrink(entries(s, 3)),
    "pair_ids": lambda s, d: entries(s, 4).select("bucket", directory.pair(F.col("bucket")).alias("pair")),
    "lru_order": lambda s, d: lru.order(trace(s, d)),
    "lru_victims": lambda s, d: lru.victims(trace(s, d), 16),
    "lru_replay": lru_replay,
    "content_differences": differing,
    "store_layout": lambda s, d: reopened(s, d, False).manifest().select("level", "entries", "min_key", "max_key", "sst_num"),
    "store_versions": lambda s, d: opened(s, d).scan_versions(LO, HI),
    "store_scan": lambda s, d: opened(s, d).scan(LO, HI),
    "store_get": lambda s, d: reopened(s, d, False).multi_get(wanted(s, d)),
    "store_reopen": lambda s, d: reopened(s, d, True).scan(0, 2**32 - 3),
    "store_compact": store_compact,
}

_LOG = "l AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, CAST(round(value * 100) AS BIGINT) AS value FROM events)"
_LATEST = f"{_LOG}, s AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM l) WHERE k = 1 AND op = 'P')"
_PLACED = f"""{_LOG}, c AS (SELECT *, CAST(sum(CASE WHEN op = 'P' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS puts FROM l),
r AS (SELECT seq, op, key, value, CASE WHEN op = 'P' THEN (puts - 1) // {M} ELSE puts // {M} END AS run, (SELECT max(puts) // {M} FROM c) AS n FROM c),
p AS (SELECT seq, op, key, value, run, n, CAST(CASE WHEN run >= n THEN -1 ELSE floor(log2(xor(run, n))) END AS INTEGER) AS level FROM r)"""
_VERSIONS = f"{_PLACED}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, key ORDER BY seq DESC) AS k FROM p) WHERE k = 1)"
_RUN = f"{_PLACED}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM p WHERE level >= 0) WHERE k = 1)"
#: Versions of the stored levels, without the tombstones that a merge into the last level has dropped, and of the memtable.
_STORED = f"{_VERSIONS}, y AS (SELECT * FROM v WHERE NOT (op = 'D' AND level >= 1 AND level = (SELECT max(level) FROM v)))"
_NEWEST = f"{_VERSIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level) AS q FROM v WHERE level >= 0), b AS (SELECT key, value FROM w WHERE q = 1 AND op = 'P')"


#: The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _u(x: int) -> str:
    return f"{x}::UHUGEINT"


def _hashed(keys: str, hashes: str) -> str:
    """CTEs: h0(key, bits, h) from rows (key, bits) of `keys`, h being XXH64 of a 4-byte key under the seeds `hashes`, unsigned."""
    u = _u
    two64, p1, p2, p3, _, p5 = map(u, (1 << 64, *PRIMES))
    return f"""e AS (SELECT DISTINCT key, bits, s FROM ({keys}) z, {hashes} t(s)),
e1 AS (SELECT key, bits, s, xor((s::UHUGEINT + {p5} + {u(4)}) % {two64}, (key::UHUGEINT * {p1}) % {two64}) AS h FROM e),
e2 AS (SELECT key, bits, s, (((h * {u(1 << 23)}) % {two64} + h // {u(1 << 41)}) * {p2} % {two64} + {p3}) % {two64} AS h FROM e1),
e3 AS (SELECT key, bits, s, xor(h, h // {u(1 << 33)}) * {p2} % {two64} AS h FROM e2),
e4 AS (SELECT key, bits, s, xor(h, h // {u(1 << 29)}) * {p3} % {two64} AS h FROM e3),
h0 AS (SELECT key, bits, s, CAST(xor(h, h // {u(1 << 32)}) % bits::UHUGEINT AS INTEGER) AS position FROM e4)"""


def _hashed_names(names: str) -> str:
    """CTEs: hn(page_id, h) from the distinct page_id of the table `names`, ASCII of 8 to 31 characters, h being XXH64 under seed 0."""
    two64, p1, p2, p3, p4, p5 = map(_u, (1 << 64, *PRIMES))
    number = lambda at, width: "(" + " + ".join(f"ascii(substr(page_id, CAST({at} + {k + 1} AS BIGINT), 1))::UHUGEINT * {_u(256**k)}" for k in range(width)) + ")"
    turned = lambda x, r: f"(({x} * {_u(1 << r)}) % {two64} + {x} // {_u(1 << (64 - r))})"
    out = [f"n0 AS (SELECT DISTINCT page_id, length(page_id) AS n, {p5} + length(page_id)::UHUGEINT AS h FROM {names})"]

    def step(when: str, h: str) -> None:
        out.append(f"n{len(out)} AS (SELECT page_id, n, CASE WHEN {when} THEN {h} ELSE h END AS h FROM n{len(out) - 1})")

    for k in range(3):
        lane = f"({number(8 * k, 8)} * {p2} % {two64})"
        step(f"n >= {8 * k + 8}", f"xor(h, {turned(lane, 31)} * {p1} % {two64})")
        step(f"n >= {8 * k + 8}", f"({turned('h', 27)} * {p1} + {p4}) % {two64}")
    step("n % 8 >= 4", f"xor(h, {number('n // 8 * 8', 4)} * {p1} % {two64})")
    step("n % 8 >= 4", f"({turned('h', 23)} * {p2} + {p3}) % {two64}")
    for k in range(3):
        step(f"n % 4 > {k}", f"xor(h, {number(f'n // 4 * 4 + {k}', 1)} * {p5} % {two64})")
        step(f"n % 4 > {k}", f"{turned('h', 11)} * {p1} % {two64}")
    step("true", f"xor(h, h // {_u(1 << 33)}) * {p2} % {two64}")
    step("true", f"xor(h, h // {_u(1 << 29)}) * {p3} % {two64}")
    return ",\n".join([*out, f"hn AS (SELECT page_id, xor(h, h // {_u(1 << 32)}) AS h FROM n{len(out) - 1})"])


_LEAVES = "g AS (SELECT o_orderkey AS key, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 508 AS INTEGER) AS leaf_no FROM (SELECT DISTINCT o_orderkey FROM orders)), f AS (SELECT leaf_no, count(*) AS num_keys, min(key) AS min_key, max(key) AS max_key FROM g GROUP BY leaf_no)"
_NODES = lambda f: f"CASE WHEN n = 0 THEN 0 ELSE n + ceil(n / {f}.0) + CASE WHEN ceil(n / {f}.0) > 1 THEN ceil(n / {f ** 2}.0) ELSE 0 END + CASE WHEN ceil(n / {f ** 2}.0) > 1 THEN ceil(n / {f ** 3}.0) ELSE 0 END + CASE WHEN ceil(n / {f ** 3}.0) > 1 THEN ceil(n / {f ** 4}.0) ELSE 0 END END"
_PAGES = f"{_LEAVES}, t AS (SELECT count(*) AS n FROM f), pg AS (SELECT 'db/sst_' || (leaf_no % 7) || '.dat-' || CAST({_NODES(FANOUT)} - leaf_no AS INTEGER) AS page_id, CAST(leaf_no % 7 AS INTEGER) AS number, CAST((leaf_no % 7) // 2 AS INTEGER) AS level FROM f, t)"
_NAMED = f"{_PAGES}, {_hashed_names('pg')}"
#: The low d bits of h as text; a page's bucket is the shallowest that it shares with at most three others.
_LOW = lambda d: f"right(CAST(CAST(CAST(h % {_u(1 << 40)} AS BIGINT) AS BIT) AS VARCHAR), CAST({d} AS INTEGER))"
_SPLIT = f"""{_NAMED}, dc AS (SELECT d, {_LOW('d')} AS bucket, count(*) AS pages FROM hn, range(1, 41) r(d) GROUP BY ALL),
dp AS (SELECT page_id, min(dc.d) AS d FROM hn, dc WHERE dc.bucket = {_LOW('dc.d')} AND (dc.pages <= 4 OR dc.d = 40) GROUP BY page_id),
sp AS (SELECT {_LOW('d')} AS bucket, CAST(d AS INTEGER) AS local_depth, count(*) AS pages FROM dp JOIN hn USING (page_id) GROUP BY ALL)"""
_BITS = "CAST(i >> 3 & 1 AS VARCHAR) || CAST(i >> 2 & 1 AS VARCHAR) || CAST(i >> 1 & 1 AS VARCHAR) || CAST(i & 1 AS VARCHAR)"

ORACLE: dict[str, str] = {
    "latest_state": f"WITH {_LATEST} SELECT * FROM s",
    "get_point": f"WITH {_LATEST} SELECT * FROM s WHERE key = 7",
    "get_missing": f"WITH {_LATEST} SELECT * FROM s WHERE key = 4000000000",
    "multi_get": f"WITH {_LATEST} SELECT c.key, s.value FROM (SELECT DISTINCT c_custkey AS key FROM customer) c LEFT JOIN s ON s.key = c.key",
    "scan_latest": f"WITH {_LATEST} SELECT * FROM s WHERE key BETWEEN {LO} AND {HI}",
    "scan_versions": f"WITH {_VERSIONS} SELECT level, key, CASE WHEN op = 'D' THEN 4294967295 ELSE value END AS value FROM v WHERE key BETWEEN {LO} AND {HI}",
    "memtable_scan": f"WITH {_VERSIONS} SELECT key, CASE WHEN op = 'D' THEN 4294967295 ELSE value END AS value FROM v WHERE level = -1",
    "sst_scan": f"WITH {_VERSIONS} SELECT level, key, CASE WHEN op = 'D' THEN 4294967295 ELSE value END AS value FROM v WHERE level >= 0 AND key BETWEEN {LO} AND {HI}",
    "op_placement": f"WITH {_PLACED} SELECT seq, run, level FROM p",
    "flush_batches": f"WITH {_PLACED} SELECT run, count(*) AS ops, CAST(sum(CASE WHEN op = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS puts, count(DISTINCT key) AS keys, min(seq) AS min_seq, max(seq) AS max_seq FROM p GROUP BY run",
    "level_layout": f"WITH {_PLACED} SELECT level, count(DISTINCT run) AS runs, count(DISTINCT key) AS keys, min(key) AS min_key, max(key) AS max_key, CAST(level * 2 AS BIGINT) AS sst_num FROM p WHERE level >= 0 GROUP BY level",
    "newest_level_wins": f"WITH {_VERSIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level) AS q FROM v WHERE level >= 0) SELECT key, value FROM w WHERE q = 1 AND op = 'P'",
    "merge_two_runs": f"WITH {_RUN} SELECT key, CASE WHEN op = 'P' THEN value END AS value, op = 'D' AS is_tombstone, seq FROM a",
    "merge_last_level": f"WITH {_RUN} SELECT key, value, op = 'D' AS is_tombstone, seq FROM a WHERE op = 'P'",
    "compact_all": f"WITH {_PLACED} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM p WHERE level >= 0) WHERE k = 1 AND op = 'P'",
    "tombstones": f"WITH {_VERSIONS} SELECT level, count(*) AS tombstones FROM v WHERE op = 'D' AND level >= 0 AND NOT (level >= 1 AND level = (SELECT max(level) FROM v)) GROUP BY level",
    "leaf_pages": f"WITH {_LEAVES} SELECT * FROM f",
    "leaf_offsets": f"WITH {_LEAVES}, t AS (SELECT count(*) AS n FROM f) SELECT leaf_no, CAST({_NODES(FANOUT)} - leaf_no AS INTEGER) AS \"offset\" FROM f, t",
    "node_count": f"WITH {_LEAVES}, t AS (SELECT count(*) AS n FROM f) SELECT n AS leaves, CAST({_NODES(FANOUT)} AS BIGINT) AS nodes, CAST({_NODES(SMALL_FANOUT)} AS BIGINT) AS nodes_small FROM t",
    "internal_fences": f"WITH {_LEAVES} SELECT CAST(leaf_no // {SMALL_FANOUT} AS INTEGER) AS node_no, count(*) AS children, max(max_key) AS fence FROM f GROUP BY 1",
    "fence_lookup": f"WITH {_LEAVES}, k AS (SELECT DISTINCT c_custkey * 97 AS key FROM customer) SELECT k.key, (SELECT min(leaf_no) FROM f WHERE max_key >= k.key) AS leaf_no FROM k",
    "page_ids": f"WITH {_PAGES} SELECT * FROM pg",
    "page_insert": f"WITH {_PAGES} SELECT DISTINCT page_id FROM pg",
    "page_get": f"WITH {_NAMED} SELECT page_id, {_LOW(4)} AS bucket FROM hn WHERE page_id = 'db/sst_1.dat-2'",
    "page_remove": f"WITH {_PAGES} SELECT DISTINCT page_id FROM pg WHERE level <> 0",
    "bucket_ids": f"WITH {_NAMED} SELECT page_id, {_LOW(4)} AS bucket FROM pg JOIN hn USING (page_id)",
    "bucket_split": f"WITH {_SPLIT} SELECT * FROM sp",
    "bucket_merge": f"""WITH {_SPLIT}, pr AS (SELECT local_depth, substr(bucket, 2) AS parent, sum(pages) AS both FROM sp GROUP BY 1, 2 HAVING count(*) = 2 AND sum(pages) <= 6)
SELECT DISTINCT coalesce(pr.parent, bucket) AS bucket, CAST(sp.local_depth - CASE WHEN pr.parent IS NULL THEN 0 ELSE 1 END AS INTEGER) AS local_depth, CAST(coalesce(pr.both, pages) AS BIGINT) AS pages
FROM sp LEFT JOIN pr ON pr.local_depth = sp.local_depth AND pr.parent = substr(bucket, 2)""",
    "directory_counters": f"WITH {_SPLIT} SELECT greatest(1, max(local_depth)) AS global_depth, CAST(sum(pages) AS BIGINT) AS size, CAST(2 ** greatest(1, max(local_depth)) AS BIGINT) AS num_directory, count(*) AS num_buckets FROM sp",
    "bloom_params": f"WITH {_PLACED}, q AS (SELECT level, count(DISTINCT key) AS keys FROM p WHERE level >= 0 GROUP BY level) SELECT level, CAST(least(5 * ceil(keys / 508.0), 4088) AS INTEGER) AS bits, CAST(round(ln(2) * 5) AS INTEGER) AS hashes, CAST(least(15 * keys, 4088) AS INTEGER) AS bits_by_key, CAST(round(ln(2) * 15) AS INTEGER) AS hashes_by_key FROM q",
    "bloom_runs": f"WITH {_VERSIONS}, n0 AS (SELECT level, CAST(least(15 * count(*), 4088) AS INTEGER) AS bits FROM v WHERE level >= 0 GROUP BY level), {_hashed('SELECT v.key, n0.bits FROM v JOIN n0 USING (level)', 'range(10)')} SELECT DISTINCT v.level, n0.bits AS total_bits, h0.position FROM v JOIN n0 USING (level) JOIN h0 ON h0.key = v.key AND h0.bits = n0.bits",
    "bloom_probe": f"WITH {_hashed('SELECT user_id AS key, 4088 AS bits FROM events UNION ALL SELECT c_custkey, 4088 FROM customer', 'range(3)')}, o AS (SELECT DISTINCT position FROM h0 WHERE key IN (SELECT user_id FROM events)) SELECT key, bool_and(position IN (SELECT position FROM o)) AS maybe FROM h0 WHERE key IN (SELECT c_custkey FROM customer) GROUP BY key",
    "directory_expand": f"WITH d AS (SELECT substr({_BITS}, 2) AS id FROM range(8) t(i)) SELECT bit || id AS id, id AS bucket FROM d, (VALUES ('0'), ('1')) b(bit)",
    "directory_shrink": f"WITH d AS (SELECT substr({_BITS}, 2) AS id FROM range(8) t(i)) SELECT substr(id, 2) AS id, min(id) AS bucket FROM d GROUP BY 1",
    "pair_ids": f"WITH d AS (SELECT {_BITS} AS bucket FROM range(16) t(i)) SELECT bucket, translate(left(bucket, 1), '01', '10') || substr(bucket, 2) AS pair FROM d",
    "lru_order": "SELECT user_id AS page, max(event_id) AS last_seq FROM events GROUP BY 1",
    "lru_victims": "SELECT page, last_seq FROM (SELECT user_id AS page, max(event_id) AS last_seq, row_number() OVER (ORDER BY max(event_id) DESC) AS k FROM events GROUP BY 1) WHERE k > 16",
    "lru_replay": """WITH t AS (SELECT event_id AS seq, user_id AS page, row_number() OVER (ORDER BY event_id) AS i FROM events),
x AS (SELECT *, lag(i) OVER (PARTITION BY page ORDER BY i) AS was FROM t),
y AS (SELECT seq, was, sum(CASE WHEN was IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, (SELECT count(DISTINCT u.page) FROM t u WHERE u.i > x.was AND u.i < x.i) AS apart FROM x),
z AS (SELECT seq // 1000 AS trace, was IS NOT NULL AND apart < 8 AS hit, coalesce(seen, 0) >= 8 AS is_full FROM y)
SELECT trace, count(*) AS accesses, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN is_full AND NOT hit THEN 1 ELSE 0 END) AS BIGINT) AS evictions FROM z GROUP BY trace""",
    "tree_levels": f"""WITH {_LEAVES}, t AS (SELECT count(*) AS n FROM f), l AS (SELECT * FROM range(1, 9) q(height), t WHERE height = 1 OR n > {SMALL_FANOUT} ** (height - 1))
SELECT CAST(height AS INTEGER) AS height, CAST(leaf_no // CAST({SMALL_FANOUT} ** height AS BIGINT) AS BIGINT) AS node_no, count(DISTINCT leaf_no // CAST({SMALL_FANOUT} ** (height - 1) AS BIGINT)) AS children, max(max_key) AS fence FROM f, l GROUP BY ALL""",
    "content_differences": f"WITH {_NEWEST}, {_LATEST.removeprefix(_LOG + ', ')} SELECT key, value, CAST(1 AS BIGINT) AS more FROM (SELECT * FROM s EXCEPT SELECT * FROM b) UNION ALL SELECT key, value, CAST(-1 AS BIGINT) FROM (SELECT * FROM b EXCEPT SELECT * FROM s)",
    "store_layout": f"WITH {_STORED} SELECT level, count(*) AS entries, min(key) AS min_key, max(key) AS max_key, CAST(level * 2 AS BIGINT) AS sst_num FROM y WHERE level >= 0 GROUP BY level",
    "store_versions": f"WITH {_STORED} SELECT level, key, CASE WHEN op = 'D' THEN 4294967295 ELSE value END AS value FROM y WHERE key BETWEEN {LO} AND {HI}",
    "store_scan": f"WITH {_LATEST} SELECT * FROM s WHERE key BETWEEN {LO} AND {HI}",
    "store_get": f"WITH {_NEWEST} SELECT c.key, b.value FROM (SELECT DISTINCT c_custkey AS key FROM customer) c LEFT JOIN b ON b.key = c.key",
    "store_reopen": f"WITH {_LATEST} SELECT * FROM s",
    "store_compact": f"WITH {_LATEST}, n AS (SELECT count(*) FILTER (op = 'P') // {M} + CASE WHEN count(*) FILTER (op = 'P') % {M} > 0 OR (SELECT op FROM l ORDER BY seq DESC LIMIT 1) = 'D' THEN 1 ELSE 0 END AS n FROM l) SELECT CAST(floor(log2(n)) AS INTEGER) AS level, key, value FROM s, n",
}
