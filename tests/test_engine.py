"""The engine's operators: queries against SQL, models, algebraic laws, case tables."""

import csv
import io
import json
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import wrapping as W
from tidemark.operators import crdt, derived, sketch, small, versioned
from tidemark.plans import catalogue
from tidemark.sources import formats
from tidemark.sources.table import VersionedTable
from tidemark.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in found)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf_dir, con, name):
    got = catalogue.queries()[name](spark, sf_dir)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", compaction_threshold=2)
    rng, model, seq = random.Random(90210), {}, 0
    for _ in range(4):
        batch = []
        for _ in range(300):
            k = f"k{rng.randrange(200)}"
            v = None if rng.random() < 0.25 else f"v{rng.randrange(10**6)}"
            batch.append((k, v, seq))
            model[k] = v
            seq += 1
        seq = 0
        t.write(spark.createDataFrame(batch, "key string, value string, seq long"))
        t.flush()
    t.write(spark.createDataFrame([("k0", "tail", 0), ("k1", None, 1)], "key string, value string, seq long"))
    model |= {"k0": "tail", "k1": None}
    again = VersionedTable(spark, f"file://{tmp_path}/t")
    assert again.run_count() <= 2 and again.get("k0") == b"tail" and again.get("k1") is None and again.replay().count() == 2
    live_keys = {k: v.encode() for k, v in model.items() if v is not None}
    assert [(r.key, bytes(r.value)) for r in again.scan().collect()] == sorted(live_keys.items())
    assert [r.key for r in again.scan("k100", "k20").collect()] == sorted(k for k in live_keys if "k100" <= k < "k20")
    with pytest.raises(RuntimeError):
        t._commit(t.manifest() | {"version": 0})
    t.close()
    with pytest.raises(ValueError):
        t.put("k", "v")
    assert again.replay().count() == 0 and again.get("k0") == b"tail" and again.run_sizes().count() == again.run_count()


def test_stored_queries_on_parts_beyond_the_memtable(spark, tmp_path):
    kind = "CASE WHEN i % 7 = 3 THEN 'error' ELSE 'purchase' END"
    duckdb.sql(f"COPY (SELECT i AS event_id, i % 40000 AS user_id, {kind} AS event_type, i / 2.0 AS value FROM range(100001) t(i)) TO '{tmp_path}/events.parquet'")
    for name in ("table_replay", "table_runs", "table_scan"):
        found = catalogue.queries()[name](spark, str(tmp_path))
        want = duckdb.sql(catalogue.oracle_sql()[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet'"))
        assert rows(found.select(*want.columns).collect()) == rows(want.fetchall()), name


ODD_EVENTS = {
    "no user": "SELECT i, if(i % 10 = 0, NULL, i % 40) FROM range(301) t(i)",
    "no id": "SELECT if(i % 11 = 0, NULL, i), if(i % 11 = 0, 100 + i, i % 40) FROM range(301) t(i)",
    "first part empty": "SELECT i, i % 40 FROM range(150, 301) t(i)",
    "bounds rounded in doubles": "SELECT unnest([5, 100000000000000001, 300000000000000000]), unnest([1, 2, 3])",
}


@pytest.mark.parametrize("name", ODD_EVENTS)
def test_stored_queries_on_odd_events(spark, tmp_path, name):
    kind = "CASE WHEN event_id % 7 = 3 THEN 'error' ELSE 'purchase' END"
    duckdb.sql(f"COPY (SELECT event_id, user_id, {kind} AS event_type, 0.5 AS value FROM ({ODD_EVENTS[name]}) t(event_id, user_id)) TO '{tmp_path}/events.parquet'")
    for name in ("table_replay", "table_runs", "table_scan", "table_mutations"):
        found = catalogue.queries()[name](spark, str(tmp_path))
        want = duckdb.sql(catalogue.oracle_sql()[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet'"))
        assert rows(found.select(*want.columns).collect()) == rows(want.fetchall()), name


def test_flush_as_a_given_generation(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.flush(1)  # nothing to flush
    t.put("a", "1")
    t.flush(2)
    t.put("a", "2")
    with pytest.raises(ValueError):
        t.flush(2)
    t.flush()
    assert sorted(map(tuple, t.run_sizes().collect())) == [(2, 1), (3, 1)] and t.get("a") == b"2"


def test_wrapping_arithmetic(spark):
    xs = [0, 1, -1, 2**62, -(2**63), 123456789123456789]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for k in (3, W.SPLIT_1, 2**64 - 1):
        assert [r[0] for r in df.select(W.mul64(F.col("x"), k)).collect()] == [W.signed(x * k) for x in xs]
    assert [r[0] for r in df.select(W.add64(F.col("x"), F.lit(-(2**63)))).collect()] == [W.signed(x - 2**63) for x in xs]
    mask = 2**64 - 1

    def mixed(z):
        z = (z + W.GOLDEN) & mask
        z = ((z ^ z >> 30) * W.SPLIT_1) & mask
        z = ((z ^ z >> 27) * W.SPLIT_2) & mask
        return z ^ z >> 31

    assert [r.hash for r in W.hash_long(df, F.col("x")).collect()] == [W.signed(mixed(x & mask)) for x in xs]
    texts = ["hello", "", "é", "hello world", None, "a" * 300]
    s = spark.createDataFrame([(x,) for x in texts], "s string")
    want = []
    for t in texts:
        h = W.FNV_OFFSET
        for b in (t or "").encode():
            h = ((h ^ b) * W.FNV_PRIME) & mask
        want.append(None if t is None else W.signed(mixed(h)))
    assert [r.hash for r in W.hash_bytes(s, F.col("s")).collect()] == want == [r.hash for r in W.hash_bytes(s, F.encode("s", "utf-8")).collect()]
    plan = W.hash_long(df, F.col("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") > 3 and "transform" not in plan


def test_hll(spark):
    for p in (3, 19):
        with pytest.raises(ValueError):
            sketch.check_precision(p)
    item = F.col("id") * 2654435761
    regs = lambda a, b: sketch.registers(spark.range(a, b), item, 14)
    value = lambda s: sketch.estimate(s, 14).first()[0]
    assert value(regs(0, 0)) == 0 and abs(value(regs(0, 100)) - 100) <= 2
    a, b = regs(0, 60_000), regs(40_000, 100_000)
    both = value(sketch.merge(a, b))
    assert sketch.precision(sketch.merge(a, b)) == 14 and sketch.memory_bytes(14) == 16_384
    with pytest.raises(ValueError):
        sketch.merge(a, sketch.registers(spark.range(9), item, 12))
    with pytest.raises(ValueError):
        sketch.estimate(a, 12)
    assert abs(both - 100_000) < 3000 and both == value(sketch.merge(b, a)) and value(sketch.merge(a, a)) == value(a)


def test_bloom(spark):
    bits, hashes = sketch.bloom_size(2000, 0.01)
    words = sketch.bloom_words(spark.range(2000).selectExpr("concat('present', id) k"), F.col("k"), bits, hashes)
    probes = spark.range(2000).selectExpr("concat('present', id) k").union(spark.range(4000).selectExpr("concat('absent', id) k"))
    got = sketch.bloom_probe(probes, F.col("k"), words, bits, hashes)
    joined = sketch.bloom_probe(probes, F.col("k"), words, bits, hashes, limit=0)
    assert rows(got.collect()) == rows(joined.collect()) and got.count() == 6000
    assert got.filter("k like 'present%' and maybe = 0").count() == 0
    assert got.filter("k like 'absent%' and maybe = 1").count() < 120


def test_bloom_of_rows_whose_order_differs_each_time(spark):
    def shuffled(batches):
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(2**31))

    bits, hashes = sketch.bloom_size(500, 0.001)
    words = sketch.bloom_words(spark.range(500).selectExpr("cast(id as string) k"), F.col("k"), bits, hashes)
    probes = spark.range(0, 1000, 1, 2).selectExpr("id", "cast(if(id % 100 = 99, null, id % 800) as string) k").mapInPandas(shuffled, "id long, k string")
    got = {r.id: (r.k, r.maybe) for r in sketch.bloom_probe(probes, F.col("k"), words, bits, hashes, limit=0).collect()}
    want = {r.id: (r.k, r.maybe) for r in sketch.bloom_probe(probes, F.col("k"), words, bits, hashes).collect()}
    assert got == want and len(got) == 1000 and got[99] == (None, 0) and all(got[i][1] for i in range(500) if i % 100 != 99)


def test_sequences(spark):
    schema = live.OPS
    ops = [(1, "ins", 1, "A", "", None, "h"), (1, "ins", 2, "A", "1:A", None, "e"), (1, "ins", 3, "A", "2:A", None, "i"), (1, "ins", 4, "B", "1:A", None, "X"), (1, "ins", 9, "B", "8:Z", None, "lost")]
    rng = random.Random(58)
    texts = set()
    for _ in range(3):
        rng.shuffle(ops)
        texts.add(crdt.sequence_text(spark.createDataFrame(ops + ops[:2], schema)).first().text)
    assert texts == {"hXei"}
    df = spark.createDataFrame(ops, schema)
    op = crdt.insert_at(df, 1, 1, "C", "!")
    assert op["after"] == "1:A" and op["c"] == 10
    gone = crdt.delete_at(df, 1, 1)
    assert gone["target"] == "4:B" and crdt.delete_at(df, 1, 99) is None
    assert crdt.sequence_text(df.unionByName(spark.createDataFrame([gone], schema))).first().text == "hei"


def test_counter_laws(spark):
    s = "counter string, replica string, p long, n long"
    a, b = spark.createDataFrame([("c", "A", 10, 3)], s), spark.createDataFrame([("c", "A", 4, 1), ("c", "B", 5, 9)], s)
    assert crdt.counter_value(crdt.counter_merge(a, b, b)).first().value == 3
    assert crdt.equal(crdt.counter_merge(a, b), crdt.counter_merge(b, a))
    with pytest.raises(Exception):
        a.select(crdt.checked_increment(F.lit(-1).cast("long"))).collect()


def plain_csv(text):
    """The rules of CSV, one character after another."""
    rows, row, start, quoted, i = [], [], 0, False, 0
    raws = []
    while i < len(text):
        c = text[i]
        if quoted and text[i : i + 2] == '""':
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif c in "\r\n" and not quoted:
            raws.append(text[start:i])
            i += text[i : i + 2] == "\r\n"
            start = i + 1
        i += 1
    if start < len(text):
        raws.append(text[start:])
    for raw in raws:
        row, i = [], 0
        while True:
            if raw[i : i + 1] == '"':
                i, field = i + 1, ""
                while i < len(raw) and (raw[i] != '"' or raw[i : i + 2] == '""'):
                    field += raw[i]
                    i += 2 if raw[i] == '"' else 1
                i += 1
            else:
                end = raw.find(",", i)
                end = len(raw) if end < 0 else end
                field, i = raw[i:end], end
            row.append(field)
            if raw[i : i + 1] != ",":
                break
            i += 1
        rows.append(row)
    return rows


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab,"\r\n é', max_size=14))
def test_csv_of_any_text(text):
    assert formats.parse_csv(text) == plain_csv(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='xy;,"\n\r ', max_size=6), min_size=1, max_size=4), max_size=5), st.sampled_from(",;|"), st.sampled_from(["\n", "\r\n", "\r"]))
def test_csv_written_by_the_library(table, delimiter, end):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(table)
    assert formats.parse_csv(out.getvalue(), delimiter) == table


json_values = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v["object"]} if isinstance(v, dict) else v


@settings(max_examples=300, deadline=None)
@given(json_values, st.booleans(), st.integers(0, 30), st.sampled_from(["", ",", "]", "}", '"', "1", "x", ":", "\\"]))
def test_json_against_the_library(value, ascii, at, put):
    text = json.dumps(value, ensure_ascii=ascii)
    assert plain(formats.parse_json(text)) == value and formats.same_json(text, " " + text + "\n") is True
    broken = text[:at] + put + text[at + 1 :]
    try:
        want = json.loads(broken, strict=False, parse_int=float, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        with pytest.raises(ValueError) as e:
            formats.parse_json(broken)
        assert 0 <= e.value.at <= len(broken.encode())
    else:
        assert plain(formats.parse_json(broken)) == want


def test_json_edges(spark):
    for text, at in (('{"7e888": 7e888}', 10), ('["é", -]', 7), ('"\\udbff!"', 1), ('"\\udbff\\u0041"', 1), ("[0,\n 00]", 6), ("Infinity", 0), ("", 0)):
        with pytest.raises(ValueError) as e:
            formats.parse_json(text)
        assert e.value.at == at, text
    assert formats.parse_json('"\\udfff"') == "\udfff" and formats.parse_json('"\t"') == "\t"
    assert formats.parse_json('{"k": 1, "k": []}') == {"object": [("k", 1.0), ("k", [])]}
    assert formats.same_json('{"p":1,"q":2}', '{"q":2,"p":1}') is False and formats.same_json("[1]", "[") is None
    got = spark.createDataFrame([("[null,[2],{}]",), ("[",), (None,)], "j string").select(formats.strict_json("j").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [(True, "array", 3, -1), (False, None, 0, 1), (None, None, None, None)]


def test_codec(spark):
    rng = random.Random(417)
    data = [b"", b"tide", bytes(range(256)) * 300, rng.randbytes(40_000)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    for level in (0, 1, 6, 9, 42):
        for r in df.select("i", formats.compress(F.col("d"), level).alias("z")).collect():
            assert zlib.decompress(bytes(r.z), -15) == data[r.i] and len(r.z) <= len(data[r.i]) * 1.001 + 16
    assert formats.inflate(b"\x07")[1] == formats.CORRUPT and formats.inflate(b"\x01\x05\x00\x00\x00hello")[1] == formats.CORRUPT
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(b"x" * 500) + z.flush()
    assert formats.inflate(packed[:-2])[1] == formats.TRUNCATED and formats.inflate(packed, limit=10)[1] == formats.TOO_LARGE
    assert spark.createDataFrame([(bytearray(b"123456789"),)], "b binary").select(F.crc32("b")).first()[0] == 0xCBF43926
    lengths = formats.code_lengths({i: 2**i for i in range(20)}, 15)
    assert max(lengths.values()) <= 15 and sum(2.0**-n for n in lengths.values()) <= 1
    known = formats.canonical_codes(lengths)
    found = formats.huffman_codes(spark.createDataFrame([(0, s, n) for s, n in lengths.items()], "g int, symbol int, length int"), "g")
    assert {r.symbol: r.code for r in found.collect()} == known
    codes = sorted(known.values())
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert len(formats.LENGTH_BASES) == 29 and len(formats.DISTANCE_BASES) == 30 and formats.DISTANCE_BASES[-1] == 24577


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 1, 2, 2, 1])], "node long, seq long, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("node long, seq long, value double").parquet(f"{tmp_path}/in")
    out = live.changes(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination(100)
    assert [r.seq for r in spark.sql("select * from changed order by seq").collect()] == [0, 2, 4]
    seen = []
    q = live.effect(stream, live.last_per_batch("node", "seq", "value", lambda df, n: seen.extend(df.collect())), f"{tmp_path}/e")
    q.awaitTermination(100)
    assert [(r.node, r.value) for r in seen] == [(1, 1.0)]
    calls = []
    q = live.effect(stream, lambda df, n: (calls.append("run"), lambda: calls.append("clean"))[1], f"{tmp_path}/f")
    q.awaitTermination(100)
    q.stop()
    assert calls == ["run", "clean"]
    names = spark.createDataFrame([(1, "one")], "node long, name string")
    out = live.with_snapshot(stream, names, "node").writeStream.format("memory").queryName("named").outputMode("append").option("checkpointLocation", f"{tmp_path}/g").trigger(availableNow=True).start()
    out.awaitTermination(100)
    assert {r.name for r in spark.sql("select name from named").collect()} == {"one"}


def test_derived_tables(spark):
    stats, log = derived.Stats(), []
    a, b = derived.Source(spark.range(5)), derived.Source(spark.range(3))
    total = derived.Derived(lambda t: t.agg(F.sum("id").alias("s")), a, name="total", stats=stats)
    both = derived.Derived(lambda t: t.crossJoin(derived.snapshot(b).agg(F.count("*").alias("n"))), total, name="both", stats=stats)
    assert not hasattr(both, "write") and stats.computations == {}
    assert both.read().first() == (10, 3) and both.read() is both.read()
    b.write(spark.range(9))
    assert both.read().first() == (10, 3) and stats.computations == {"total": 1, "both": 1}

    def run(table):
        log.append(table.first().s)
        return lambda: log.append("clean")

    effect = derived.Effect(run, total, name="effect", stats=stats)
    a.write(spark.range(2))
    a.write(spark.range(4))
    assert effect.flush() and not effect.flush() and log == [10, "clean", 6] and both.read().first() == (6, 9)
    a.write(spark.range(4))
    assert not effect.flush()
    effect.dispose()
    a.write(spark.range(1))
    assert not effect.flush() and log == [10, "clean", 6, "clean"] and stats.computations["effect"] == 2


def test_causal_delivery(spark, tmp_path):
    ops = [(1, "ins", 3, "A", "2:A", None, "c"), (1, "ins", 2, "A", "1:A", None, "b"), (1, "ins", 1, "A", "", None, "a"), (1, "ins", 1, "A", "", None, "a"), (1, "ins", 9, "A", "8:A", None, "z")]
    spark.createDataFrame(ops, live.OPS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(live.OPS).parquet(f"{tmp_path}/in")
    q = live.causal(stream).writeStream.format("memory").queryName("causal").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert [r.c for r in spark.sql("select * from causal").collect()] == [1, 2, 3]


def test_concurrent_actions(spark):
    assert small.gather([lambda i=i: spark.range(i).count() for i in (3, 1, 2)]) == [3, 1, 2] and small.gather([]) == []
    with pytest.raises(ZeroDivisionError):
        small.gather([lambda: 1, lambda: 1 // 0])
    assert small.first_completed([lambda: 5]) == 5
    pool = small.Pool(1)
    outer = pool.submit(lambda: pool.submit(lambda x: x + 1, 4).result() * 2)
    failed = pool.submit(lambda: 1 // 0)
    pool.wait_idle()
    assert outer.result() == 10 and isinstance(failed.exception(), ZeroDivisionError) and pool.size == 1
    pool.close()


def test_ordered_keys(spark):
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(["b", "d", "d", "f", None, "h"])], "k string, at long")
    assert versioned.chain(keys, "k", "at").first().n_broken == 3 and versioned.chain(keys.filter("at < 2"), "k", "at").first().n_broken == 0
    assert versioned.chain(keys.limit(0), "k", "at").first().n_broken == 0
    probes = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "p string")
    found = versioned.floor_probe(probes, keys.filter("k is not null"), "p", "k").collect()
    assert sorted(map(tuple, found)) == [("a", None), ("b", "b"), ("c", "b"), ("z", "h")]
    big = spark.createDataFrame([(2**60 + 1,), (2**60 + 3,)], "p long")
    assert [r.floor_key for r in versioned.floor_probe(big, big.filter(f"p = {2**60 + 1}"), "p", "p").orderBy("p").collect()] == [2**60 + 1] * 2
    assert [versioned.height(n) for n in (0, 1, 64, 65, 4096, 4097)] == [0, 1, 1, 2, 2, 3]
    assert [r.pos for r in versioned.numbered(spark.range(1000), "id").orderBy("id").collect()] == list(range(1000))


def test_range_is_pushed_down(spark, sf_dir):
    log = catalogue.event_log(spark, sf_dir)
    plan = versioned.scan(log, 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(user_id,10)" in plan and "LessThan(user_id,20)" in plan
