"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import wrapping as W
from tidemark.operators import crdt, derived, incremental, sketch, small, versioned
from tidemark.sources import formats
from tidemark.sources.table import VersionedTable, scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an op log: an error deletes its user's key, anything else puts its value."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), gone.alias("tombstone"), F.when(~gone, F.col("value")).alias("value"))


_LOG = "log AS (SELECT user_id AS key, event_id AS seq, event_type = 'error' AS tombstone, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
_LAST = "last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log)"


# ---- versioned tables


@query(f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE rn = 1 AND NOT tombstone AND key >= 10 AND key < 1000")
def lsm_scan_latest(spark, d):
    return versioned.scan(event_log(spark, d), 10, 1000).select("key", "seq", "value")


@query(f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE rn = 1 AND NOT tombstone AND key IN (1, 3, 7, 12, 999999)")
def lsm_get_points(spark, d):
    return versioned.get(event_log(spark, d), [1, 3, 7, 12, 999999]).select("key", "seq", "value")


@query(f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE rn = 1 AND NOT tombstone")
def lsm_scan_open_bounds(spark, d):
    return versioned.scan(event_log(spark, d)).select("key", "seq", "value")


_GEN = "bounds AS (SELECT min(event_id) AS lo, (max(event_id) - min(event_id)) // 4 + 1 AS w FROM events), g AS (SELECT log.*, ((seq - lo) // w)::INTEGER AS gen FROM log, bounds)"
_RUN = "r AS (SELECT *, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM g)"


def _runs(spark, d):
    return versioned.generations(event_log(spark, d), 4)


@query(f"WITH {_LOG}, {_GEN}, {_RUN} SELECT key, seq, tombstone, value FROM r WHERE rn = 1 AND gen = 1 AND key >= 5 AND key < 60")
def lsm_run_range(spark, d):
    return versioned.run_range(_runs(spark, d).filter("gen = 1").drop("gen"), 5, 60).select("key", "seq", "tombstone", "value")


@query(f"WITH {_LOG}, {_GEN}, {_RUN} SELECT gen, key, seq, tombstone, value FROM r WHERE rn = 1")
def lsm_flush_gen(spark, d):
    return versioned.flush_generations(_runs(spark, d))


@query(f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE rn = 1 AND NOT tombstone")
def lsm_compact(spark, d):
    return versioned.compact(lsm_flush_gen(spark, d)).select("key", "seq", "value")


@query(f"WITH {_LOG}, {_GEN}, {_RUN} SELECT gen, count(*)::BIGINT AS n_entries, count(*) FILTER (WHERE tombstone)::BIGINT AS n_tombstones, min(key) AS low_key, max(key) AS high_key FROM r WHERE rn = 1 GROUP BY gen")
def lsm_run_stats(spark, d):
    return lsm_flush_gen(spark, d).groupBy("gen").agg(
        F.count("*").alias("n_entries"), F.sum(F.col("tombstone").cast("long")).alias("n_tombstones"), F.min("key").alias("low_key"), F.max("key").alias("high_key"),
    )


@query(
    "WITH l AS (SELECT 'u' || user_id AS key, CASE WHEN event_type <> 'error' THEN event_type || event_id END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) "
    "SELECT sum(strlen(key) + coalesce(strlen(value), 0) + 24)::BIGINT AS bytes, count(*)::BIGINT AS n_keys FROM l WHERE rn = 1"
)
def lsm_memtable_bytes(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.concat("event_type", F.col("event_id").cast("string"))).alias("value"))
    return versioned.latest(log).agg(F.sum(versioned.entry_bytes(F.col("key"), F.col("value"))).cast("long").alias("bytes"), F.count("*").alias("n_keys"))


@query(f"WITH {_LOG} SELECT seq, key, tombstone, value FROM log")
def wal_replay(spark, d):
    """The whole log, in the order of writing."""
    return event_log(spark, d).orderBy("seq").select("seq", "key", "tombstone", "value")


def _stored(spark, d) -> VersionedTable:
    """events written to a table on storage in three parts: two flushed, the last one in the log, however large it is. A run
    has its part's number from 1, also after an empty part; events without an id are the oldest, in the first part."""
    t = VersionedTable(spark, scratch(spark), memtable_limit=None, compaction_threshold=4)
    e = table(spark, d, "events")
    low, top = e.agg(F.min("event_id"), F.max("event_id")).first()
    seq = F.coalesce("event_id", F.lit((low or 0) - 1))
    third = F.try_divide((F.col("event_id") * 3).cast("double"), F.lit(float(top or 0)))  # in doubles as in SQL
    part = F.greatest(F.lit(0), F.ceil(third) - 1)  # a null is skipped
    ops = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") != "error", F.concat("event_type", F.col("event_id").cast("string"))).alias("value"), seq.alias("seq"), part.alias("part"))
    for k in range(3):
        t.write(ops.filter(F.col("part") == k if k < 2 else F.col("part") >= k))
        if k < 2:
            t.flush(k + 1)
    return t


_OPS = "o AS (SELECT 'u' || user_id AS key, CASE WHEN event_type <> 'error' THEN event_type || event_id END AS value, event_id AS seq, greatest(0, ceil(event_id * 3 / (SELECT max(event_id) FROM events))::BIGINT - 1) AS part FROM events)"


@query(f"WITH {_OPS}, l AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o) SELECT key, value FROM l WHERE rn = 1 AND value IS NOT NULL AND key >= 'u1' AND key < 'u5'")
def table_scan(spark, d):
    return _stored(spark, d).scan("u1", "u5").select("key", F.decode("value", "utf-8").alias("value"))


@query(f"WITH {_OPS} SELECT key, value, value IS NULL AS tombstone FROM o WHERE part = 2")
def table_replay(spark, d):
    """What the log still holds after two flushes: the third part."""
    return _stored(spark, d).replay().select("key", F.decode("value", "utf-8").alias("value"), "tombstone")


@query(f"WITH {_OPS} SELECT (part + 1)::INTEGER AS gen, count(DISTINCT key)::BIGINT AS n FROM o WHERE part < 2 GROUP BY part")
def table_runs(spark, d):
    return _stored(spark, d).run_sizes()


@query(f"WITH {_OPS}, l AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o) SELECT 2::INTEGER AS n_runs, count(*) FILTER (WHERE value IS NOT NULL AND key <> 'u1' AND key <> 'u2') + 1 AS n_live, 'new' AS u1 FROM l WHERE rn = 1")
def table_mutations(spark, d):
    """A put and a delete after the log was flushed by closing, then everything compacted by a forced fold and one more run."""
    t = _stored(spark, d)
    t.crash()
    t = VersionedTable(spark, t.path)
    t.flush()
    t.compact(force=True)
    t.put("u1", "new")
    t.delete("u2")
    t.close()
    t = VersionedTable(spark, t.path)
    live = t.scan().agg(F.count("key").alias("n_live"))
    return live.select(F.lit(t.run_count()).alias("n_runs"), "n_live", F.lit((t.get("u1") or b"").decode()).alias("u1"))


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos % 64 = 0")
def lsm_sparse_index(spark, d):
    return versioned.sparse_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("pos").cast("long").alias("pos"))


@query(
    "WITH i AS (SELECT o_orderkey AS k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos % 64 = 0), p AS (SELECT p_partkey * 7 - 3 AS probe FROM part) "
    "SELECT probe, k AS floor_key FROM p ASOF LEFT JOIN i ON p.probe >= i.k"
)
def lsm_floor_probe(spark, d):
    index = versioned.sparse_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return versioned.floor_probe(table(spark, d, "part").select((F.col("p_partkey") * 7 - 3).alias("probe")), index, "probe", "o_orderkey")


@query(f"WITH {_LOG} SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS previous FROM log QUALIFY NOT tombstone")
def kv_put_previous(spark, d):
    return versioned.with_previous(event_log(spark, d)).filter(~F.col("tombstone")).select("key", "seq", "value", "previous")


@query(f"WITH {_LOG} SELECT key, seq, lag(value) OVER (PARTITION BY key ORDER BY seq) AS removed FROM log QUALIFY tombstone")
def kv_removed_value(spark, d):
    return versioned.with_previous(event_log(spark, d)).filter("tombstone").select("key", "seq", F.col("previous").alias("removed"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 77")
def btree_get(spark, d):
    return table(spark, d, "part").filter("p_partkey = 77").select("p_partkey", "p_name")


@query("SELECT DISTINCT l_partkey + 900 AS probe, l_partkey + 900 IN (SELECT p_partkey FROM part) AS found FROM lineitem")
def btree_contains(spark, d):
    probes = table(spark, d, "lineitem").select((F.col("l_partkey") + 900).alias("probe")).distinct()
    keys = table(spark, d, "part").select("p_partkey")
    return probes.join(keys, F.col("probe") == F.col("p_partkey"), "left").select("probe", F.col("p_partkey").isNotNull().alias("found"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def btree_range(spark, d):
    return table(spark, d, "orders").filter(versioned.in_range(F.col("o_orderkey"), 100, 900)).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT p_partkey, p_name FROM part")
def btree_entries(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey")


@query("SELECT count(*)::BIGINT AS n_entries, count(DISTINCT o_orderkey)::BIGINT AS n_keys, count(*) FILTER (WHERE o_orderkey IS NULL)::BIGINT AS n_null, 0::BIGINT AS n_repeated FROM orders")
def btree_audit(spark, d):
    return versioned.audit(table(spark, d, "orders"), "o_orderkey")


@query("WITH b AS (SELECT p_partkey AS low, lead(p_partkey) OVER (ORDER BY p_partkey) AS high FROM part WHERE p_partkey % 100 = 1) SELECT low, count(l_partkey)::BIGINT AS n FROM b JOIN lineitem ON l_partkey >= low AND (l_partkey < high OR high IS NULL) GROUP BY low")
def btree_leaf_lookup(spark, d):
    bounds = table(spark, d, "part").filter("p_partkey % 100 = 1").select("p_partkey")
    keys = table(spark, d, "lineitem").groupBy("l_partkey").count()
    found = versioned.floor_probe(keys.select("l_partkey"), bounds, "l_partkey", "p_partkey").filter("floor_key is not null")
    return found.join(keys, "l_partkey").groupBy(F.col("floor_key").alias("low")).agg(F.sum("count").cast("long").alias("n"))


@query("SELECT count(*)::BIGINT AS n, (WITH RECURSIVE h(n, k) AS (SELECT count(*), 0 FROM orders UNION ALL SELECT CASE WHEN n <= 64 THEN 0 ELSE ceil(n / 64)::BIGINT END, k + 1 FROM h WHERE n > 0) SELECT max(k) FROM h)::INTEGER AS height, 0::BIGINT AS n_broken FROM orders")
def btree_shape(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    n = o.count()
    stored = versioned.numbered(o, "o_orderkey")
    return versioned.chain(stored, "o_orderkey", "pos").select(F.lit(n).alias("n"), F.lit(versioned.height(n)).alias("height"), "n_broken")


@query("SELECT count(*)::BIGINT AS n_broken FROM (SELECT l_orderkey, lag(l_orderkey) OVER (ORDER BY l_orderkey * 8 + l_linenumber) AS b FROM lineitem) WHERE l_orderkey <= b")
def chain_breaks(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    return versioned.chain(rows, "l_orderkey", "place")


@query("WITH i AS (SELECT c_name AS k FROM customer WHERE c_custkey % 16 = 5), p AS (SELECT DISTINCT o_clerk AS probe FROM (SELECT 'Customer#' || lpad((o_custkey * 3 - 7)::VARCHAR, 9, '0') AS o_clerk FROM orders)) SELECT probe, k AS floor_key FROM p ASOF LEFT JOIN i ON p.probe >= i.k")
def lsm_floor_strings(spark, d):
    index = table(spark, d, "customer").filter("c_custkey % 16 = 5").select("c_name")
    probes = table(spark, d, "orders").select(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 3 - 7).cast("string"), 9, "0")).alias("probe")).distinct()
    return versioned.floor_probe(probes, index, "probe", "c_name")


# ---- sketches


def _wrapped(x: str, k: int) -> str:
    return f"((({x})::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _mix_steps(source: str, keep: str, item: str) -> str:
    """CTEs that end in h(keep, h UBIGINT) from source(keep, item)."""
    keep = keep and keep + ", "
    return (
        f"z0 AS (SELECT {keep}((({item})::UHUGEINT + {W.GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM {source}), "
        f"z1 AS (SELECT {keep}{_wrapped('xor(z, z >> 30)', W.SPLIT_1)} AS z FROM z0), "
        f"z2 AS (SELECT {keep}{_wrapped('xor(z, z >> 27)', W.SPLIT_2)} AS z FROM z1), "
        f"h AS (SELECT {keep}xor(z, z >> 31) AS h FROM z2)"
    )


def _registers_sql(p: int, keep: str = "") -> str:
    low = 2 ** (64 - p)
    rank = f"CASE WHEN h % {low} = 0 THEN {64 - p + 1} ELSE {64 - p} - length(bin(h % {low})) + 1 END"
    by = keep and keep + ", "
    return f"reg AS (SELECT {by}(h // {low})::INTEGER AS idx, max({rank})::INTEGER AS rank FROM h GROUP BY {by}(h // {low})::INTEGER)"


def _estimate_sql(p: int, keep: str = "", source: str = "reg") -> str:
    m, by = 2**p, keep and keep + ", "
    total = f"(SELECT {by}sum(n * pow(2.0, -rank)) AS s, sum(n) AS n FROM (SELECT {by}rank, count(*) AS n FROM {source} GROUP BY {by}rank)" + (f" GROUP BY {keep}" if keep else "") + ")"
    raw = f"({sketch.alpha(m) * m * m!r} / (coalesce(s, 0) + {m} - coalesce(n, 0)))"
    return f"SELECT {by}floor(CASE WHEN {raw} <= {2.5 * m} AND {m} - coalesce(n, 0) > 0 THEN {m}.0::DOUBLE * ln({m}.0::DOUBLE / ({m} - coalesce(n, 0))::DOUBLE) ELSE {raw} END + 0.5)::BIGINT AS estimate FROM {total}"


@query(f"WITH {_mix_steps('lineitem', '', 'l_partkey')}, {_registers_sql(8)} SELECT * FROM reg")
def hll_registers(spark, d):
    return sketch.registers(table(spark, d, "lineitem"), F.col("l_partkey"), 8)


@query(f"WITH {_mix_steps('lineitem', '', 'l_partkey')}, {_registers_sql(8)} {_estimate_sql(8)}")
def hll_estimate(spark, d):
    return sketch.estimate(hll_registers(spark, d), 8)


@query(f"WITH {_mix_steps('lineitem', '', 'l_orderkey')}, {_registers_sql(10)} {_estimate_sql(10)}")
def hll_estimate_harmonic(spark, d):
    return sketch.estimate(sketch.registers(table(spark, d, "lineitem"), F.col("l_orderkey"), 10), 10)


@query(f"WITH {_mix_steps('lineitem', 'l_returnflag', 'l_partkey')}, {_registers_sql(14, 'l_returnflag')} {_estimate_sql(14, 'l_returnflag')}")
def hll_group_estimate(spark, d):
    by = ("l_returnflag",)
    return sketch.estimate(sketch.registers(table(spark, d, "lineitem"), F.col("l_partkey"), 14, by), 14, by)


def _shards(spark, d):
    return sketch.registers(table(spark, d, "lineitem"), F.col("l_partkey"), 12, ("l_returnflag",))


_SHARDS = f"{_mix_steps('lineitem', 'l_returnflag', 'l_partkey')}, {_registers_sql(12, 'l_returnflag')}"


@query(f"WITH {_SHARDS}, u AS (SELECT idx, max(rank) AS rank FROM reg GROUP BY idx) {_estimate_sql(12, source='u')}")
def hll_union(spark, d):
    return sketch.estimate(sketch.merge(_shards(spark, d).select("idx", "rank")), 12)


@query(f"WITH {_SHARDS} SELECT sum(estimate)::BIGINT AS naive_sum FROM ({_estimate_sql(12, 'l_returnflag')})")
def hll_naive_sum(spark, d):
    return sketch.estimate(_shards(spark, d), 12, ("l_returnflag",)).agg(F.sum("estimate").alias("naive_sum"))


def _bytes_sql(c: str) -> str:
    return f"list_transform(range(strlen({c})), lambda i: ('0x' || substr(hex({c}), 2 * i::INTEGER + 1, 2))::UBIGINT)"


def _fnv_sql(c: str, seed: int = 0) -> str:
    step = f"(((xor(h, b))::UHUGEINT * {W.FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"list_reduce({_bytes_sql(c)}, lambda h, b: {step}, {(seed ^ W.FNV_OFFSET) % 2**64}::UBIGINT)"


@query(f"WITH f AS (SELECT {_fnv_sql('c_name')} AS v FROM customer), {_mix_steps('f', '', 'v')}, {_registers_sql(12)} {_estimate_sql(12)}")
def hll_strings(spark, d):
    return sketch.estimate(sketch.registers(table(spark, d, "customer"), F.col("c_name"), 12, hashed=W.hash_bytes), 12)


@query(
    f"WITH {_SHARDS}, e AS ({_estimate_sql(12, 'l_returnflag')}), x AS (SELECT l_returnflag, count(DISTINCT l_partkey) AS exact FROM lineitem GROUP BY l_returnflag) "
    "SELECT count(*)::BIGINT AS n_shards, sqrt(avg(pow((estimate - exact) / exact::DOUBLE, 2))) < 0.0488 AS within_three_errors, median(exact)::DOUBLE AS median_exact FROM e JOIN x USING (l_returnflag)"
)
def hll_error_report(spark, d):
    e = sketch.estimate(_shards(spark, d), 12, ("l_returnflag",))
    x = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    rel = (F.col("estimate") - F.col("exact")) / F.col("exact")
    return e.join(x, "l_returnflag").agg(F.count("*").alias("n_shards"), (F.sqrt(F.avg(rel * rel)) < 0.0488).alias("within_three_errors"), F.percentile("exact", F.lit(0.5)).alias("median_exact"))


@query("SELECT count(DISTINCT l_partkey)::BIGINT AS n FROM lineitem")
def exact_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("n"))


_BITS = "greatest(64, ceil(-n * ln(0.01) / (ln(2) * ln(2))))::BIGINT"


@query(f"SELECT n, {_BITS} AS bits, greatest(1, floor({_BITS} / n * ln(2) + 0.5))::BIGINT AS hashes FROM (SELECT count(*)::BIGINT AS n FROM supplier)")
def bloom_params(spark, d):
    bits = F.greatest(F.lit(64), F.ceil(-F.col("n") * F.log(F.lit(0.01)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))).cast("long")
    sized = table(spark, d, "supplier").agg(F.count("*").alias("n")).withColumn("bits", bits)
    return sized.withColumn("hashes", F.greatest(F.lit(1), F.floor(F.col("bits") / F.col("n") * F.log(F.lit(2.0)) + 0.5)).cast("long"))


def _bloom(spark, d):
    """The suppliers' filter, sized by their number: words, bits and hashes."""
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))
    size = sketch.bloom_size(keys.count(), 0.01)
    return sketch.bloom_words(keys, F.col("key"), *size), *size


_SIZE = f"size AS (SELECT {_BITS} AS bits, greatest(1, floor({_BITS} / n * ln(2) + 0.5))::BIGINT AS hashes FROM (SELECT count(*)::BIGINT AS n FROM supplier))"


def _positions_sql(source: str, key: str) -> str:
    def mixed(n: int) -> str:
        f = f"f{n}"
        inner = _wrapped(f"xor({f}, {f} >> 33)", W.BLOOM_MULTIPLIER)
        return f"xor({inner}, {inner} >> 33)"

    step = "((a::UHUGEINT + (b::UHUGEINT * i::UHUGEINT) % 18446744073709551616::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    signed = f"({step}::HUGEINT - CASE WHEN {step} >= 9223372036854775808::UHUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END)"
    return (
        f"{_SIZE}, fn AS (SELECT {key} AS key, {_fnv_sql(key, W.BLOOM_SEEDS[0])} AS f0, {_fnv_sql(key, W.BLOOM_SEEDS[1])} AS f1 FROM {source}), "
        f"ab AS (SELECT key, {mixed(0)} AS a, {mixed(1)} AS b FROM fn), "
        f"pos AS (SELECT key, (({signed} % bits + bits) % bits)::BIGINT AS pos FROM (SELECT key, a, b, bits, unnest(range(hashes)) AS i FROM ab, size))"
    )


_SUPPLIERS = "k AS (SELECT s_suppkey::VARCHAR AS key FROM supplier)"


@query(f"WITH {_SUPPLIERS}, {_positions_sql('k', 'key')}, one AS (SELECT DISTINCT pos FROM pos) SELECT (pos // 64)::INTEGER AS word, sum(CASE WHEN pos % 64 = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (pos % 64)::INTEGER END)::BIGINT AS bits FROM one GROUP BY 1")
def bloom_bits(spark, d):
    return _bloom(spark, d)[0]


_PROBES = "p AS (SELECT DISTINCT l_suppkey::VARCHAR AS key FROM lineitem UNION SELECT (l_suppkey + 5000000)::VARCHAR FROM lineitem)"
_PROBE_SQL = f"WITH {_SUPPLIERS}, {_PROBES}, every AS (SELECT key FROM k UNION SELECT key FROM p), {_positions_sql('every', 'key')}, bits AS (SELECT DISTINCT pos FROM pos JOIN k USING (key)) SELECT key, min(CASE WHEN bits.pos IS NULL THEN 0 ELSE 1 END)::INTEGER AS maybe FROM pos JOIN p USING (key) LEFT JOIN bits ON pos.pos = bits.pos GROUP BY key"


def _bloom_probes(spark, d):
    keys = table(spark, d, "lineitem").select("l_suppkey").distinct()
    return keys.select(F.col("l_suppkey").cast("string").alias("key")).union(keys.select((F.col("l_suppkey") + 5000000).cast("string")))


@query(_PROBE_SQL)
def bloom_probe(spark, d):
    return sketch.bloom_probe(_bloom_probes(spark, d), F.col("key"), *_bloom(spark, d))


@query(_PROBE_SQL)
def bloom_reloaded(spark, d):
    """The same probes against the filter as it is read back from storage, joined by word as a large filter is."""
    path = scratch(spark)
    sketch.bloom_save(*_bloom(spark, d), path)
    return sketch.bloom_probe(_bloom_probes(spark, d), F.col("key"), *sketch.bloom_load(spark, path), limit=0)


@query("SELECT p::INTEGER AS p, (1 << p)::BIGINT AS memory_bytes, 1.04 / sqrt((1 << p)::DOUBLE) AS standard_error FROM range(4, 19) AS t(p)")
def hll_facts(spark, d):
    rows = [(p, sketch.memory_bytes(p), sketch.standard_error(p)) for p in range(sketch.MIN_P, sketch.MAX_P + 1)]
    return spark.createDataFrame(rows, "p int, memory_bytes long, standard_error double")


# ---- conflict-free types


def _counters(spark, d):
    e = table(spark, d, "events")
    plus = F.sum((F.col("event_type") != "error").cast("long"))
    return e.groupBy(F.col("event_type").alias("counter"), (F.col("user_id") % 3).cast("string").alias("replica")).agg(F.count("*").alias("p"), (F.count("*") - plus).alias("n"))


_COUNTERS = "c AS (SELECT event_type AS counter, (user_id % 3)::VARCHAR AS replica, count(*)::BIGINT AS p, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS n FROM events GROUP BY 1, 2)"


@query(f"WITH {_COUNTERS} SELECT counter, sum(p)::BIGINT AS value FROM c GROUP BY counter")
def gcounter_value(spark, d):
    return crdt.counter_value(_counters(spark, d).withColumn("n", F.lit(0).cast("long")))


@query(f"WITH {_COUNTERS} SELECT counter, replica, p AS value FROM c")
def gcounter_merge(spark, d):
    state = _counters(spark, d)
    stale = state.withColumns({"p": F.floor(F.col("p") / 2), "n": F.lit(0).cast("long")})
    return crdt.counter_merge(stale, state, state).select("counter", "replica", F.col("p").alias("value"))


@query(f"WITH {_COUNTERS} SELECT counter, sum(p - n)::BIGINT AS value FROM c GROUP BY counter")
def pncounter_value(spark, d):
    return crdt.counter_value(_counters(spark, d))


def _sets(spark, d):
    """Element: user; every event but an error adds a tag, an error retires the tags seen before it."""
    e = table(spark, d, "events")
    adds = e.filter("event_type <> 'error'").select(F.col("user_id").alias("element"), F.concat((F.col("user_id") % 3).cast("string"), F.lit(":"), F.col("event_id").cast("string")).alias("tag"), "event_id")
    last = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("element")).agg(F.max("event_id").alias("seen"))
    removed = adds.join(last, "element").filter("event_id < seen").select("tag")
    return adds.select("element", "tag"), removed


_SETS = "a AS (SELECT user_id AS element, event_id FROM events WHERE event_type <> 'error'), x AS (SELECT user_id AS element, max(event_id) AS seen FROM events WHERE event_type = 'error' GROUP BY 1), live AS (SELECT a.* FROM a LEFT JOIN x USING (element) WHERE seen IS NULL OR event_id > seen)"


@query(f"WITH {_SETS} SELECT DISTINCT element FROM live")
def orset_values(spark, d):
    return crdt.set_values(*_sets(spark, d))


@query(f"WITH {_SETS} SELECT element, count(*)::BIGINT AS n_tags FROM live GROUP BY element")
def orset_merge(spark, d):
    adds, removed = _sets(spark, d)
    half = adds.filter(F.substring_index("tag", ":", 1) == "0"), removed.limit(0)
    adds, removed = crdt.set_merge((adds, removed), half)
    return adds.join(removed, "tag", "left_anti").groupBy("element").agg(F.count("*").alias("n_tags"))


@query("SELECT element, count(*)::BIGINT AS n FROM (SELECT user_id AS element FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0 UNION ALL SELECT DISTINCT user_id FROM events WHERE user_id % 6 = 0) GROUP BY element")
def orset_add_remove(spark, d):
    """Every third element is removed; of these every second is added again, with a fresh tag."""
    adds, removed = _sets(spark, d)
    removed = removed.limit(0)
    users = table(spark, d, "events").select(F.col("user_id").alias("element")).distinct()
    removed = crdt.set_remove(adds, removed, users.filter("element % 3 = 0"))
    adds = crdt.set_add(adds, users.filter("element % 6 = 0"), "1")
    return adds.join(removed, "tag", "left_anti").groupBy("element").agg(F.count_distinct("tag").alias("n"))


def _ops(spark, d, missing: bool = False):
    """conversations as ops: turn t is inserted after turn t div 2 - 1 (turn 0: the root) with clock t + 1; system turns are deleted."""
    c = table(spark, d, "conversations").filter("turn is not null and conv_id is not null")
    clock, parent = F.col("turn") + 1, F.floor((F.col("turn") + 1) / 2)
    rep = F.concat(F.lit("r"), (F.col("turn") % 2).cast("string"))
    parent_rep = F.concat(F.lit("r"), ((F.greatest(parent, F.lit(1)) - 1) % 2).cast("string"))
    ins = c.select(F.col("conv_id").alias("doc"), F.lit("ins").alias("type"), clock.alias("c"), rep.alias("r"), F.when(F.col("turn") == 0, "").otherwise(F.concat(parent.cast("string"), F.lit(":"), parent_rep)).alias("after"), F.lit(None).cast("string").alias("target"), F.col("role").alias("value"))
    if missing:
        return ins.filter("c <> 2")
    gone = c.filter("turn % 5 = 3").select(F.col("conv_id").alias("doc"), F.lit("del").alias("type"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("after"), F.concat(clock.cast("string"), F.lit(":"), rep).alias("target"), F.lit(None).cast("string").alias("value"))
    return ins.unionByName(gone).unionByName(ins.filter("c % 3 = 0"))  # some come twice


_TREE = (
    "t AS (SELECT DISTINCT conv_id AS doc, turn, turn + 1 AS c, (turn + 1) // 2 AS up, role AS value FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL), "
    "w(doc, c, path, value, turn) AS (SELECT doc, c, [-c], value, turn FROM t WHERE turn = 0 UNION ALL SELECT t.doc, t.c, list_append(w.path, -t.c), t.value, t.turn FROM t JOIN w ON t.doc = w.doc AND t.up = w.c AND t.turn > 0), "
    "o AS (SELECT doc, c, value, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS pos FROM w WHERE turn % 5 <> 3)"
)


@query(f"WITH RECURSIVE {_TREE} SELECT doc, c || ':r' || ((c - 1) % 2) AS key, pos::BIGINT AS pos FROM o")
def rga_order(spark, d):
    return crdt.sequence_order(_ops(spark, d)).filter("pos is not null").select("doc", "key", "pos")


@query(f"WITH RECURSIVE {_TREE} SELECT doc, string_agg(value, '|' ORDER BY pos) AS text FROM o GROUP BY doc")
def rga_text(spark, d):
    return crdt.sequence_text(_ops(spark, d), "|")


@query(
    "WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS doc, turn + 1 AS c, (turn + 1) // 2 AS up FROM conversations WHERE turn <> 1), "
    "ok(doc, c) AS (SELECT doc, c FROM t WHERE c = 1 UNION ALL SELECT t.doc, t.c FROM t JOIN ok ON t.doc = ok.doc AND t.up = ok.c AND t.c > 1) "
    "SELECT t.doc, t.c || ':r' || ((t.c - 1) % 2) AS key FROM t LEFT JOIN ok ON t.doc = ok.doc AND t.c = ok.c WHERE ok.c IS NULL"
)
def rga_pending(spark, d):
    return crdt.sequence_order(_ops(spark, d, missing=True)).filter("pending").select("doc", "key")


@query("SELECT conv_id AS doc, count(DISTINCT turn)::BIGINT AS n_nodes, max(turn + 1)::BIGINT AS clock FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1")
def rga_dedup(spark, d):
    ins = _ops(spark, d).filter("type = 'ins'").dropDuplicates(["doc", "c", "r"])
    return ins.groupBy("doc").agg(F.count("*").alias("n_nodes"), F.max("c").alias("clock"))


@query(f"WITH RECURSIVE {_TREE}, m AS (SELECT min(doc) AS doc FROM o), k AS (SELECT o.* FROM o JOIN m USING (doc)) SELECT string_agg(value, '|' ORDER BY p) AS text FROM (SELECT value, pos + 0.0 AS p FROM k WHERE pos <> 1 UNION ALL SELECT '!', 0.5)")
def rga_edits(spark, d):
    """An insertion after the first place and a deletion of the place after it, in the first document."""
    ops = _ops(spark, d)
    doc = ops.agg(F.min("doc")).first()[0]
    ops = ops.filter(F.col("doc") == doc)
    one = lambda op: spark.createDataFrame([op], "doc long, type string, c long, r string, after string, target string, value string")
    ops = ops.unionByName(one(crdt.insert_at(ops, doc, 1, "zz", "!")))
    ops = ops.unionByName(one(crdt.delete_at(ops, doc, 2)))
    return crdt.sequence_text(ops, "|").select("text")


# ---- formats


@query("SELECT o_orderkey::VARCHAR AS k, '\"' || o_orderpriority || '\", ' || o_orderstatus AS p, '' AS e FROM orders")
def csv_roundtrip(spark, d):
    text = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('", '), F.col("o_orderstatus"))
    row = F.struct(F.col("o_orderkey").alias("k"), text.alias("p"), F.lit("").alias("e"))
    line = table(spark, d, "orders").select(F.to_csv(row, {"escape": '"', "quoteAll": "true"}).alias("line"))
    return line.select(formats.csv_fields(F.col("line"), "k string, p string, e string").alias("f")).select("f.*")


@query("SELECT sum(o_orderkey * 3)::BIGINT AS total FROM orders")
def csv_third_sum(spark, d):
    line = table(spark, d, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", (F.col("o_orderkey") * 3).cast("string")).alias("line"))
    fields = line.select(formats.csv_fields(F.col("line"), "a string, b string, c string").alias("f"))
    return fields.agg(F.sum(F.col("f.c").try_cast("long")).alias("total"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0)::BIGINT AS n_int, count(*)::BIGINT AS n_double FROM orders")
def csv_try_parse(spark, d):
    c = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    rows = table(spark, d, "orders").select(c.alias("x"))
    return rows.agg(F.count("*").alias("n"), F.count(formats.to_int(F.col("x"))).alias("n_int"), F.count(formats.to_double(F.col("x"))).alias("n_double"))


@query("SELECT o_orderkey, r::INTEGER AS row, CASE r WHEN 0 THEN o_orderstatus || chr(10) || 'x' WHEN 2 THEN 'last' ELSE '' END AS first, CASE r WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END::INTEGER AS n_fields FROM orders, range(3) AS t(r)")
def csv_strict_rows(spark, d):
    text = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('\nx",b\r\n\nlast,,'))
    rows = formats.csv_rows(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "t", "o_orderkey")
    return rows.select("o_orderkey", "row", F.get("fields", F.lit(0)).alias("first"), F.size("fields").alias("n_fields"))


@query("SELECT o_orderkey, r::INTEGER AS row, CASE r WHEN 0 THEN o_orderstatus || ' \"y' || chr(10) || 'z\" w,2' ELSE '\"a\"\"b\" ,c' END AS raw, CASE r WHEN 0 THEN o_orderstatus || ' \"y' || chr(10) || 'z\" w' ELSE 'a\"b' END AS first, CASE r WHEN 0 THEN 2 ELSE 1 END::INTEGER AS n_fields, r = 1 AS escaped FROM orders, range(2) AS t(r)")
def csv_raw_rows(spark, d):
    """A quote inside a field keeps its row together but quotes nothing; text after a closing quote ends its row's fields."""
    text = F.concat(F.col("o_orderstatus"), F.lit(' "y\nz" w,2\r\n"a""b" ,c'))
    rows = formats.csv_rows(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "t", "o_orderkey")
    return rows.select("o_orderkey", "row", "raw", F.get("fields", F.lit(0)).alias("first"), F.size("fields").alias("n_fields"), F.get("escaped", F.lit(0)).alias("escaped"))


@query("SELECT c_custkey, replace(c_name || chr(34) || chr(34) || c_mktsegment || chr(34), chr(34) || chr(34), chr(34)) AS value FROM customer")
def csv_unescape(spark, d):
    raw = F.concat("c_name", F.lit('""'), "c_mktsegment", F.lit('"'))
    return table(spark, d, "customer").select("c_custkey", formats.unescape(raw).alias("value"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_find(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", formats.json_find(F.col("props"), "k").cast("long").alias("k"), formats.json_find(F.col("props"), "none").alias("none"))


#: Texts that events are put into: all six kinds, nesting, escapes, repeats, and ways to be malformed.
_JSON = ['{"a": P, "a": [1, 2], "b": null}', "[P, [], {}, true]", '"x\\u00e9\\n"', " -12.5e3 ", "true", "null", "[]", "{}", "[P P]", '{"a" P}', "P P", "tru", "[1.]", '"\\x"', "[P"]


def _json_text(k, props):
    out = F.lit(None).cast("string")
    for i, t in enumerate(_JSON):
        out = F.when(k == i, F.replace(F.lit(t), F.lit("P"), props)).otherwise(out)
    return out


_JSON_SQL = "t AS (SELECT event_id, replace(CASE event_id % 15 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_JSON)) + " END, 'P', props) AS x FROM events)"
_JSON_KIND = "CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def _json_rows(spark, d):
    return table(spark, d, "events").select("event_id", _json_text(F.col("event_id") % len(_JSON), F.col("props")).alias("x"))


@query(f"WITH {_JSON_SQL} SELECT event_id, {_JSON_KIND} AS kind FROM t WHERE json_valid(x)")
def json_types(spark, d):
    return _json_rows(spark, d).filter(F.col("event_id") % 15 < 8).select("event_id", formats.json_kind(F.col("x")).alias("kind"))


@query(f"WITH {_JSON_SQL} SELECT event_id, coalesce(CASE json_type(x) WHEN 'OBJECT' THEN len(json_keys(x)) WHEN 'ARRAY' THEN json_array_length(x) END, 0)::INTEGER AS n FROM t WHERE json_valid(x)")
def json_size(spark, d):
    return _json_rows(spark, d).filter(F.col("event_id") % 15 < 8).select("event_id", formats.json_size(F.col("x")).alias("n"))


@query(f"WITH {_JSON_SQL} SELECT event_id, json_valid(x) AS ok, CASE WHEN json_valid(x) THEN {_JSON_KIND} END AS kind FROM t")
def json_strict(spark, d):
    return _json_rows(spark, d).select("event_id", formats.strict_json("x").alias("r")).select("event_id", "r.ok", "r.kind")


@query("SELECT event_id, 10 + strlen(props) + (CASE WHEN event_id % 2 = 0 THEN 4 ELSE 2 END) AS error_at FROM events")
def json_error_offset(spark, d):
    """The offset in bytes of a number out of range that also stands, earlier, inside a key."""
    wide = F.when(F.col("event_id") % 2 == 0, "\u00e9\u00e9").otherwise("ab")

    text = F.concat(F.lit('["'), wide, F.lit('1e999",'), F.col("props"), F.lit(",1e999]"))
    return table(spark, d, "events").select("event_id", formats.strict_json(text)["error_at"].cast("long").alias("error_at"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same FROM events")
def json_equality(spark, d):
    """Equal but for blanks and a number's spelling; equal but for the order of members; malformed."""
    e = table(spark, d, "events")
    k, p = F.col("event_id") % 3, F.col("props")
    other = F.when(k == 0, F.concat(F.lit('{ "x":1.0,"y" : '), p, F.lit("}"))).when(k == 1, F.concat(F.lit('{"y":'), p, F.lit(',"x":1}'))).otherwise("{")
    return e.select("event_id", formats.json_equal(F.concat(F.lit('{"x":1,"y":'), p, F.lit("}")), other).alias("same"))


@query("SELECT doc_id, true AS same, 0::INTEGER AS err FROM documents")
def codec_roundtrip(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    back = raw.withColumn("z", formats.compress(F.col("raw"), 6)).withColumn("o", formats.decompress(F.col("z")))
    return back.select("doc_id", (F.col("o.data") == F.col("raw")).alias("same"), F.col("o.err").alias("err"))


@query("SELECT doc_id, true AS same FROM documents")
def gzip_roundtrip(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    back = raw.withColumn("z", formats.compress(F.col("raw"), 9, formats.GZIP)).withColumn("o", formats.decompress(F.col("z"), formats.GZIP))
    return back.select("doc_id", (F.col("o.data") == F.col("raw")).alias("same"))


_CRC_BIT = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"


@query(f"SELECT c_custkey, xor(list_reduce({_bytes_sql('c_name')}, lambda c, b: list_reduce(list_transform(range(8), lambda i: i::UBIGINT), lambda x, i: {_CRC_BIT}, xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS crc FROM customer")
def crc32_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.crc32(F.encode("c_name", "utf-8")).alias("crc"))


@query("SELECT r_regionkey, CASE r_regionkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN -3 ELSE -1 END::INTEGER AS err, CASE WHEN r_regionkey % 4 = 0 THEN strlen(r_name) * 9 END::BIGINT AS n FROM region")
def codec_errors(spark, d):
    """A whole stream, one cut short, one that is malformed, and one longer than its limit."""
    raw = table(spark, d, "region").select("r_regionkey", F.encode(F.repeat("r_name", 9), "utf-8").alias("raw")).withColumn("z", formats.compress(F.col("raw")))
    k = F.col("r_regionkey") % 4
    z = F.when(k == 1, F.substring("z", 1, 5)).when(k == 2, F.unhex(F.lit("07"))).otherwise(F.col("z"))
    got = F.when(k == 3, formats.decompress(z, limit=10)).otherwise(formats.decompress(z))
    return raw.select("r_regionkey", got.alias("o")).select("r_regionkey", "o.err", F.octet_length("o.data").cast("long").alias("n"))


@query("WITH l AS (SELECT n_regionkey, n_nationkey AS symbol, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 5 END AS length FROM nation), c AS (SELECT *, coalesce(sum(1 << (30 - length)) OVER (PARTITION BY n_regionkey ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (30 - length) AS k FROM l) SELECT n_regionkey, symbol, length, lpad(bin(k), length, '0') AS code FROM c")
def huffman_codes(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("symbol"), F.when(F.col("n_nationkey") % 2 == 0, 3).otherwise(5).alias("length"))
    return formats.huffman_codes(n, "n_regionkey")


@query("WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*)::BIGINT AS n_symbols, 1.0::DOUBLE AS kraft, true AS monotone FROM c GROUP BY 1")
def huffman_lengths(spark, d):
    """Of each group's codes: the sum of 2**-length (1 for a full tree), and whether rarer symbols never have shorter codes."""
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("int").alias("symbol")).agg(F.count("*").alias("n"))
    both = formats.huffman_lengths(counts, "l_returnflag").join(counts, ["l_returnflag", "symbol"])
    before = F.lag("length").over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "length"))
    both = both.withColumn("ok", F.coalesce(before <= F.col("length"), F.lit(True)))
    return both.groupBy("l_returnflag").agg(F.count("*").alias("n_symbols"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"), F.bool_and("ok").alias("monotone"))


@query("SELECT doc_id, (n + (n // 65535 + 1) * 5 + 8)::BIGINT AS bound FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def deflate_bound(spark, d):
    return table(spark, d, "documents").select("doc_id", formats.deflate_bound(F.octet_length("text").cast("long")).cast("long").alias("bound"))


@query("SELECT symbol, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, '')) AS symbol FROM documents) WHERE symbol <> '' GROUP BY symbol")
def deflate_symbols(spark, d):
    each = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("symbol")).filter("symbol <> ''")
    return each.groupBy("symbol").agg(F.count("*").alias("n"))


def _code_sql(c: str, bases: list[int]) -> str:
    return f"greatest(0, len(list_filter({bases}, lambda b: b <= {c})) - 1)::INTEGER"


@query(f"SELECT p_partkey, {_code_sql('(3 + p_partkey % 256)', formats.LENGTH_BASES)} AS length_code, {_code_sql('(1 + p_partkey % 32768)', formats.DISTANCE_BASES)} AS distance_code FROM part")
def deflate_codes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", formats.code_of(3 + F.col("p_partkey") % 256, formats.LENGTH_BASES).alias("length_code"), formats.code_of(1 + F.col("p_partkey") % 32768, formats.DISTANCE_BASES).alias("distance_code"))


@query("SELECT p_partkey, ((xor(xor((p_partkey % 251) << 10, (p_partkey % 241) << 5), p_partkey % 239)) & 32767)::BIGINT AS h FROM part")
def deflate_hash3(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", formats.hash3(k % 251, k % 241, k % 239).cast("long").alias("h"))


# ---- incremental values


@query("SELECT user_id AS node, event_id AS seq, floor(value / 50)::BIGINT AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w = 1 OR floor(value / 50) IS DISTINCT FROM lag(floor(value / 50)) OVER w")
def signal_changes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 50).alias("value"))
    return incremental.changes(e, "node", "seq", "value")


@query("SELECT user_id AS node, event_id // 500 AS batch, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id DESC) = 1")
def signal_batch_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), "value")
    return incremental.batch_last(e, "node", "seq", "value", 500)


@query("SELECT event_id, event_id::DOUBLE AS sink FROM events")
def diamond_consistent(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").cast("double").alias("sink"))
    return incremental.diamond(e, "sink", 6)


@query("SELECT user_id, count(*)::BIGINT AS n, 2::INTEGER AS computations FROM events GROUP BY user_id")
def derived_table(spark, d):
    """A derived table read three times around one change of its source: it is computed twice. What it takes from a snapshot is
    no dependency."""
    e = table(spark, d, "events").select("user_id", "event_id")
    stats = derived.Stats()
    source, other = derived.Source(e.filter("event_id < 10")), derived.Source(e.select("user_id").distinct())
    counts = derived.Derived(lambda t: t.join(derived.snapshot(other), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")), source, name="counts", stats=stats)
    counts.read()
    other.write(e.select("user_id").distinct().filter("user_id < 0"))
    counts.read()
    other.write(e.select("user_id").distinct())
    source.write(e)
    found = counts.read()
    return found.withColumn("computations", F.lit(stats.computations["counts"]))


# ---- labels, counting, generators

LABELS = [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (2, "second")]
_CASE = "CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' ELSE l_linenumber::VARCHAR END"


@query(f"SELECT {_CASE} AS label, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def enum_label(spark, d):
    return table(spark, d, "lineitem").groupBy(small.label(F.col("l_linenumber"), LABELS).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_linenumber IN (1, 2, 3, 4) AS defined, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def enum_defined(spark, d):
    return table(spark, d, "lineitem").groupBy(small.defined(F.col("l_linenumber"), LABELS).alias("defined")).agg(F.count("*").alias("n"))


@query("SELECT 499999500000::BIGINT AS total")
def parallel_sum(spark, d):
    return spark.range(1_000_000).agg(F.sum("id").alias("total"))


@query("SELECT count(*)::BIGINT AS total, 0::BIGINT AS repeated, 0::BIGINT AS missing FROM orders")
def exactly_once(spark, d):
    ids = table(spark, d, "orders").select("o_orderkey")
    return small.exactly_once(ids.repartition(7), "o_orderkey", ids)


@query("SELECT range AS value FROM range(10)")
def generator_rows(spark, d):
    return small.generator_rows(spark, 10)


#: Event ids folded in one array.
FOLD_IDS = 10_000


@query("SELECT user_id, sum(event_id + 1)::BIGINT AS total FROM events GROUP BY user_id")
def coroutine_fold(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    # one array for each user and stretch of ids, their states added: the state starts at 0 and only grows by what is read
    parts = events.groupBy("user_id", F.floor(F.col("event_id") / FOLD_IDS).alias("part")).agg(F.collect_list("event_id").alias("xs"))
    states = parts.select("user_id", small.fold(F.col("xs"), lambda acc, x: acc + x + 1, F.lit(0).cast("long")).alias("state"))
    return states.groupBy("user_id").agg(F.sum("state").alias("total"))


@query("SELECT r::BIGINT AS region, count(*)::BIGINT AS n FROM range(5) AS t(r) JOIN nation ON n_regionkey = r GROUP BY r")
def pool_counts(spark, d):
    """One action for each region on a pool of threads, each of which submits another."""
    n = table(spark, d, "nation")
    pool = small.Pool(3)
    try:
        count = lambda r: pool.submit(n.filter(F.col("n_regionkey") == r).count).result()
        found = [(r, f.result()) for r, f in [(r, pool.submit(count, r)) for r in range(5)]]
        pool.wait_idle()
    finally:
        pool.close()
    return spark.createDataFrame(found, "region long, n long")


@query("SELECT o_orderkey, (o_orderkey * 2)::BIGINT AS twice FROM orders")
def mapped_partitions(spark, d):
    return small.map_partitions(table(spark, d, "orders").select("o_orderkey"), lambda f: f.assign(twice=f.o_orderkey * 2), "o_orderkey long, twice long")


@query("SELECT CASE WHEN u = 0 THEN 0 ELSE least(15, length(bin(u))) END::INTEGER AS class, count(*)::BIGINT AS n FROM (SELECT floor(o_totalprice / 32)::BIGINT AS u FROM orders) GROUP BY 1")
def size_class_hist(spark, d):
    return table(spark, d, "orders").groupBy(small.size_class(F.col("o_totalprice")).alias("class")).agg(F.count("*").alias("n"))
