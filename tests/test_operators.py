"""Processing operators against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions.keys import plain_key
from rillflow.operators import dedup, incremental, intervals, references, skew

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


# 1
def test_pending_is_an_anti_join(spark):
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 1, "x"), (None, 1, None), ("c", None, "x")], "path string, size int, checksum string")
    m = spark.createDataFrame([("a", 1, "x"), (None, 1, None), ("b", 2, "x")], "path string, size int, checksum string")
    assert sorted(r.path for r in incremental.pending(a, m, ["path"]).collect()) == ["b", "c"]
    assert incremental.pending(a.limit(0), m, ["path"]).count() == 0


def test_file_manifest_survives_failure(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, rows):
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"v": rows}), src / name)

    def process(paths):
        return spark.read.parquet(*paths).select("v", F.input_file_name().alias("_file"))

    def rows(m):
        df = m.read()
        return sorted(r.v for r in df.collect()) if df is not None else []

    put("a.parquet", [1, 2])
    put("b.parquet", [3])
    m = incremental.FileManifest(spark, str(tmp_path / "state"))
    assert m.read() is None
    first = m.run(m.listing([str(src)]), process)
    assert rows(m) == [1, 2, 3] and m.run(m.listing([str(src)]), process) is None
    put("c.parquet", [4])

    class Dies(incremental.FileManifest):
        def _commit(self, *a):
            raise OSError("lost before the commit")

    dead = Dies(spark, str(tmp_path / "state"))
    with pytest.raises(OSError):
        dead.run(dead.listing([str(src)]), process)
    assert rows(m) == [1, 2, 3]  # written, not committed: nobody sees it
    second = m.run(m.listing([str(src)]), process)
    assert second != first and rows(m) == [1, 2, 3, 4]
    put("b.parquet", [30, 31])
    m.run(m.listing([str(src)]), process)
    assert rows(m) == [1, 2, 3, 4, 30, 31]
    assert sorted(r.v for r in m.read("_file").collect()) == [1, 2, 4, 30, 31]
    assert m.entries().count() == 3
    with pytest.raises(RuntimeError):
        m._commit(0, "again", [])


def test_file_runs_hold_each_record_once(spark, tmp_path):
    day = lambda n, h: f"2024-01-{n:02d} {h:02d}:00:00"
    rows = [(1, day(1, 0)), (2, day(2, 5)), (2, day(2, 5)), (3, day(4, 1)), (4, day(4, 12)), (5, day(4, 13)), (6, day(6, 0)), (7, day(8, 0)), (8, None)]
    df = spark.createDataFrame(rows, "v int, t string").select("v", F.col("t").cast("timestamp").alias("at"))
    got = sorted((x.v, x.run) for x in incremental.file_runs(df, "at", str(tmp_path / "a")).collect())
    # The middle is noon of day 4: that day's file changes, so all of it is processed again.
    assert got == [(1, 1), (2, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 2), (8, 1)]
    m = incremental.FileManifest(spark, str(tmp_path / "a" / "state"))
    assert len(m._committed()) == 2 and m.read().count() == 11  # both versions of the changed file are stored
    assert incremental.file_runs(df.limit(0), "at", str(tmp_path / "b")) is None
    assert sorted((x.v, x.run) for x in incremental.file_runs(df.where("v in (2, 8)"), "at", str(tmp_path / "c")).collect()) == [(2, 1), (2, 1), (8, 1)]


def test_pending_offsets_cases(spark, tmp_path):
    wire = "k".ljust(32, "\0")
    rec = [("s", "k", 0, 1, '{"a":1,"b":2}', None, day(1)), ("s", wire, 0, 2, '{"b": 2, "a": 1}', None, day(9)), ("s", "k", 1, 1, '{"a":1}', None, day(1)), ("s", "k", 1, 2, '{"a":2}', None, day(9)), ("s", "k", 2, 1, '{"a":3}', None, day(1)), ("s", "k", 2, 1, '{"a":3}', None, day(1)),
           ("s", "k", 3, 1, "no json", None, day(2)), ("s", None, None, 1, "{}", None, day(1)), ("s", "k", 4, 1, None, None, day(3)), ("s", "K", 0, 1, "{}", None, day(1)), ("s", "k", 5, 1, "{}", None, day(3))]
    records = spark.createDataFrame(rec, "stream_name string, partition_id string, record_offset bigint, write_no int, data string, event_ts timestamp_ntz, arrived_at timestamp_ntz")
    snap = spark.createDataFrame([("u", "s", wire, 0, 0, 4, None, None, None, None, None), ("u", "s", "k", 0, 0, 3, 2, day(4), None, None, None), ("v", "s", "k", 1, 0, 2, None, None, None, None, None), ("w", "s", "k", None, None, None, None, None, None, None, None)],
                                 "subscription_id string, stream_name string, partition_id string, first_offset bigint, range_start bigint, range_end bigint, committed bigint, committed_at timestamp_ntz, inflight_since timestamp_ntz, inflight_by bigint, snapshot_at timestamp_ntz")
    runs = spark.createDataFrame([("u", "s", "k", "1", " DO ne", 2, 2, None, day(3), None), ("u", "s", "k", "2", None, 99, 4, None, day(30), None), ("u", "s", "k", "3", "done", None, 4, None, day(40), None)],
                                 "subscription_id string, stream_name string, offset_key string, run_id string, run_state string, last_completed_offset bigint, max_offset bigint, started_at timestamp_ntz, finished_at timestamp_ntz, reported_at timestamp_ntz")
    import itertools

    number = itertools.count()

    def found(*tables):
        m = incremental.RecordManifest(spark, str(tmp_path / str(next(number))))
        return sorted(tuple(r) for r in m.read(m.run(*incremental.offset_listing(*tables))).select(*incremental.RECORD).collect())

    assert found(records, snap, runs) == [("u", "s", "k", 1), ("u", "s", "k", 3), ("u", "s", "k", 4), ("v", "s", "k", 1), ("v", "s", "k", 2)]
    assert found(records.limit(0), snap, runs) == [] and found(records, snap.limit(0), runs) == [] and len(found(records, snap, runs.limit(0))) > 0
    wild = snap.where("subscription_id = 'v'").withColumn("range_end", F.lit(2**62)).withColumn("first_offset", F.lit(-5).cast("bigint"))
    far = records.unionByName(records.where("record_offset = 5").withColumn("record_offset", F.lit(2**50 + 3)))
    assert [r[3] for r in found(far, wild, runs)] == [0, 1, 2, 3, 4, 5, 2**50 + 3]


def test_stretches_rise_with_the_offset(spark):
    at = sorted({x + d for b in range(63) for x in [1 << b] for d in (-1, 0, 1)} | {2**63 - 1, -7, 3 << 40})
    got = [r.s for r in spark.createDataFrame([(x,) for x in at if x < 2**63], "o bigint").orderBy("o").select(incremental.stretch_of_offset("o").alias("s")).collect()]
    assert got == sorted(got) and got[-1] < 4_000_000


def test_record_runs_survive_failure(spark, tmp_path):
    schema = "subscription_id string, stream_name string, partition_id string, record_offset bigint, stretch bigint, size int, checksum bigint"
    rows = lambda *x: spark.createDataFrame([("u", "s", "k", o, 0, 1, c) for o, c in x], schema)
    m = incremental.RecordManifest(spark, str(tmp_path))
    got = lambda b: sorted((r.record_offset, r.checksum) for r in m.read(b).collect())
    covered = rows((0, 10))

    class Dies(incremental.RecordManifest):
        def _commit(self, *a):
            raise OSError("lost before the commit")

    with pytest.raises(OSError):
        Dies(spark, str(tmp_path)).run(rows((0, 10), (1, 11), (2, 12)), covered)
    assert m.batches() == []
    assert got(m.run(rows((0, 10), (1, 11), (2, 12)), covered)) == [(1, 11), (2, 12)]
    assert m.run(rows((0, 10), (1, 11), (2, 12)), covered) is None
    assert got(m.run(rows((0, 10), (1, 21), (2, 12), (3, 13)), covered)) == [(1, 21), (3, 13)]
    assert got(m.run(rows((0, 10), (1, 11), (2, 12), (3, 13)), covered)) == [(1, 11)]  # back to an older form is a change
    with pytest.raises(RuntimeError):
        m._commit(1, "again")


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    for n in "abc":
        (src / f"{n}.txt").write_text(n)
        __import__("os").utime(src / f"{n}.txt", (1_700_000_000, 1_700_000_000))
    m = incremental.FileManifest(spark, str(tmp_path / "state"))
    process = lambda paths: spark.createDataFrame([(p,) for p in paths], "v string")
    first = m.listing([str(src)])
    m.run(first, process)
    plan = lambda: [r.asDict() for r in m.listing([str(src)]).collect()]
    (src / "b.txt").write_text("other")
    real = incremental._hash_files

    def spy(batches):
        for b in real(batches):
            (tmp_path / f"read-{b.column(0)[0].as_py().rpartition('/')[2]}").write_text(str(b.num_rows)) if b.num_rows else None
            yield b

    monkeypatch.setattr(incremental, "_hash_files", spy)
    monkeypatch.setattr(incremental, "SNAPSHOT", 2)
    now = plan()
    assert [p.name for p in tmp_path.glob("read-*")] == ["read-b.txt"] and len({r["checksum"] for r in now}) == 3
    for i in range(5):
        (src / "b.txt").write_text("x" * (10 + i))
        assert m.run(m.listing([str(src)]), process) is not None
    assert m.entries().count() == 3 and (tmp_path / "state" / "snapshots").exists() and m.run(m.listing([str(src)]), process) is None


# 2
def test_salted_statistics(spark):
    r = random.Random(1)
    rows = [("hot", "k", r.randrange(200), day(r.randrange(50))) for _ in range(900)] + [(f"s{i % 40}", "k", i % 3, day(1)) for i in range(300)] + [("hot", None, 1, None), (None, "k", None, None), ("s0", "k", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, o bigint, t timestamp_ntz").withColumn("__salt", F.lit("x"))
    stats = skew.key_statistics(df, ["a", "b"], "o", "t", 0.02, 16)
    want = {}
    for a, b, o, t in rows:
        if a is not None and b is not None:
            w = want.setdefault((a, b), [0, set(), []])
            w[0] += 1
            w[1] |= {o} - {None}
            w[2] += [t] if t else []
    assert {(x.a, x.b): (x.n_rows, x.n_records, x.first_arrival, x.last_arrival) for x in stats.collect()} == {k: (n, len(o), min(t, default=None), max(t, default=None)) for k, (n, o, t) in want.items()}
    assert [tuple(x) for x in skew.heavy_keys(df, ["a", "b"], 0.02).collect()] == [("hot", "k", 900)]
    assert skew.key_statistics(df.limit(0), ["a", "b"], "o", "t").count() == 0 and skew.heavy_keys(df.limit(0), ["a", "b"], 0.02).count() == 0


def test_salts_come_from_few_files_and_counts_from_all(spark, tmp_path):
    for i in range(20):  # the first file, which is looked at for salts, doesn't hold the heavy key
        spark.createDataFrame([("cold" if i == 0 else "hot", j) for j in range(50)] + [(f"s{i}", 1), (None, 1)], "k string, o bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / f"{i:02d}"))
    df = spark.read.parquet(*[str(tmp_path / f"{i:02d}") for i in range(20)]).select("k", "o")
    assert sorted(tuple(x) for x in skew.heavy_keys(df, ["k"], 0.04).collect()) == [("cold", 50), ("hot", 950)]
    assert 0 < len(skew.salted_keys(df, ["k"], 0.04)) <= 50


# 3
def test_orphans_by_brute_force(spark):
    r = random.Random(2)
    changes = [(r.choice("abcde"), day(r.randrange(30)), i, r.choice((0, 1, 1))) for i in range(40)] + [("late", day(25), 1, 1), ("gone", None, 2, 1), (None, day(1), 3, 1)]
    refs = [(r.choice(["a", "b", "c", "d", "e", "late", "missing", "gone", None]), day(r.choice((None, *range(30)))), i, "x") for i in range(300)]
    refs += refs[:20]
    c = spark.createDataFrame(changes, "key string, at timestamp_ntz, ordinal bigint, alive int")
    f = spark.createDataFrame(refs, "key string, at timestamp_ntz, row_id bigint, stretch string")
    got = sorted((x.key, x.row_id, x.reason) for x in references.orphans(f, c).collect())
    want = []
    for k, at, i, _ in refs:
        if k is None or at is None:
            continue
        ever = [x for x in changes if x[0] == k]
        upto = sorted((x for x in ever if x[1] is not None and x[1] <= at), key=lambda x: (x[1], x[2]))
        if not ever:
            want.append((k, i, "missing"))
        elif not upto:
            want.append((k, i, "late"))
        elif not upto[-1][3]:
            want.append((k, i, "deleted"))
    assert got == sorted(want)
    assert references.orphans(f, c.limit(0)).where("reason <> 'missing'").count() == 0 and references.orphans(f.limit(0), c).count() == 0
    now = {x.key: x.n_refs for x in references.current_orphans(f, c, []).collect()}
    assert "missing" in now and "late" not in now


def asof(refs, changes):
    out = []
    for k, at, i in refs:
        ever = [x for x in changes if x[0] == k]
        upto = sorted((x for x in ever if x[1] is not None and x[1] <= at), key=lambda x: (x[1], x[2]))
        reason = "missing" if not ever else "late" if not upto else None if upto[-1][3] else "deleted"
        if reason:
            out.append((k, i, reason))
    return sorted(out)


def test_one_key_on_one_day_fills_several_tasks(spark):
    r = random.Random(8)
    refs = [("hot", T0 + dt.timedelta(seconds=r.randrange(86_000)), i) for i in range(3000)] + [("hot", T0, 9000 + i) for i in range(500)] + [(k, T0, 20_000) for k in "az"]
    changes = [("hot", T0 + dt.timedelta(seconds=r.randrange(86_000)), i, r.choice((0, 1))) for i in range(400)]
    f, c = spark.createDataFrame(refs, "key string, at timestamp_ntz, row_id bigint"), spark.createDataFrame(changes, "key string, at timestamp_ntz, ordinal bigint, alive int")
    rows, _ = references._sorted_rows(f, c, None)
    assert max(x[0] for x in rows.where("key = 'hot'").groupBy(F.spark_partition_id()).count().select("count").collect()) < 2500
    assert sorted((x.key, x.row_id, x.reason) for x in references.orphans(f, c).collect()) == asof(refs, changes)


def test_delta_runs_equal_one_run(spark, tmp_path):
    r = random.Random(12)
    keys = [f"k{i}" for i in range(12)]
    changes = [(r.choice(keys[:8]), T0 + dt.timedelta(hours=r.randrange(300)), i, r.choice((0, 1, 1))) for i in range(60)] + [("k9", None, 100, 1), ("k8", T0 + dt.timedelta(hours=290), 101, 1)]
    refs = [(r.choice(keys), T0 + dt.timedelta(hours=r.randrange(300)), i) for i in range(400)]
    mid = [T0 + dt.timedelta(hours=h) for h in (100, 200)]
    part = lambda at: 0 if at is None or at < mid[0] else 1 if at < mid[1] else 2
    for i in range(3):
        counts = references.ReferenceCounts(spark, str(tmp_path / "c"))
        f = spark.createDataFrame([x for x in refs if part(x[1]) == i], "key string, at timestamp_ntz, row_id bigint")
        c = spark.createDataFrame([x for x in changes if part(x[1]) == i], "key string, at timestamp_ntz, ordinal bigint, alive int")
        if i == 1:  # a run that dies before its commit
            dead = references.ReferenceCounts(spark, str(tmp_path / "c"))
            dead.files = type("F", (), {"put_new": lambda *a: False})()
            with pytest.raises(RuntimeError):
                dead.run(f, c, "1")
        counts.run(f, c, str(i))
        counts.run(f, c, str(i))
    assert sorted((x.key, x.row_id, x.reason) for x in counts.orphans().collect()) == asof(refs, changes)
    want = {}
    for k, at, i, alive in sorted((x for x in changes if x[1] is not None), key=lambda x: (x[1], x[2])):
        want[k] = alive
    held = {x.key: (x.n_refs, x.existing) for x in counts.counts().collect()}
    assert all(held[k][1] == v for k, v in want.items()) and all(held[k][0] == sum(x[0] == k for x in refs) for k in held)
    assert {x.key for x in counts.current().collect()} == {k for k in {x[0] for x in refs} if not want.get(k, 0)}


# 4
def spans(rows):
    out = set()
    by = {}
    for k, a, b in rows:
        if a is not None and b is not None and a <= b:
            by.setdefault(k, []).append((a, b))
    for k, v in by.items():
        v.sort()
        merged = [list(v[0])]
        for a, b in v[1:]:
            if a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*k, "period", a, b) for a, b in merged} | {(*k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed, hot", [(1, 0.3), (2, 0.9), (3, 1.0)])
def test_periods_and_gaps(spark, seed, hot):
    r = random.Random(seed)
    rows = []
    for _ in range(600):
        k = ("u", "hot") if r.random() < hot else (r.choice(("u", None)), r.choice(("x", "y", None)))
        a = r.randrange(3000)
        rows.append((k, r.choice((None, a)) if r.random() < 0.05 else a, a + r.choice((0, 1, 5, -1, 400 if r.random() < 0.02 else 2))))
    rows += rows[:30] + [(("u", "x"), -(2**63), -(2**63) + 1), (("u", "x"), 2**63 - 1, 2**63 - 1)]
    df = spark.createDataFrame([(*k, a, b, "clash") for k, a, b in rows], "u string, k string, a bigint, b bigint, __start string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = intervals.periods_and_gaps(df, ["u", "k"], "a", "b")
        got = [tuple(x) for x in out.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == len(set(got)) and set(got) == spans(rows)


def test_no_intervals(spark):
    df = spark.createDataFrame([("u", None, 1), ("u", 3, 2)], "u string, a bigint, b bigint")
    assert intervals.periods_and_gaps(df, ["u"], "a", "b").count() == 0


def test_combine_prefix():
    facts = [(0, (("a",), ("a",), 0, 10)), (1, (("a",), ("a",), 50, 60)), (2, (("a",), ("b",), 3, 4)), (5, (("b",), ("b",), 4, 9)), (6, (("c",), ("c",), 1, 1))]
    carried, closes = intervals.combine(facts)
    assert carried == {0: None, 1: (("a",), 0, 10), 2: (("a",), 50, 60), 5: (("b",), 3, 4), 6: None}
    assert closes == {0: False, 1: False, 2: False, 5: True, 6: True}


# 5
def test_bloom_has_no_false_negatives():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 2_200_000).astype(np.uint64)
    b = dedup.Bloom()
    b.add(h[:2_000_000])
    assert len(b.parts) < 11 and b.may_hold(h[:2_000_000]).all() and b.may_hold(h[2_000_000:]).mean() < 0.01


def test_exactly_one_delivery_stays(spark):
    r = random.Random(4)
    rows = [(i, r.choice(("u", "v", None)), "s", r.choice(("k", "k".ljust(32, "\0"), "hot", None)), r.choice((None, *range(40))), day(r.choice((None, *range(200)))), "x") for i in range(800)]
    rows += [(1000 + i, "u", "s", "hot", 7, day(5), "x") for i in range(300)] + rows[:50] + [(None, "u", "s", "k", 1, day(0), "x")]
    df = spark.createDataFrame(rows, "delivery_id bigint, u string, s string, k string, o bigint, t timestamp_ntz, h string")
    ids = [F.col("u"), F.col("s"), plain_key("k"), F.col("o")]
    got = sorted(x.delivery_id for x in dedup.surplus(df, ids, "delivery_id", "t").collect())
    by = {}
    for i, u, s, k, o, t, _ in set(rows):
        if i is not None and k is not None and o is not None:
            by.setdefault((u, s, k.rstrip("\0"), o), []).append((t is None, t or T0, i))
    want = sorted(i for v in by.values() for _, _, i in sorted(v)[1:])
    assert got == want
    kept = dedup.exactly_once(df, ids, "delivery_id", "t")
    assert kept.count() == len(set(rows)) - len(want) and kept.columns == df.columns
    assert dedup.surplus(df.limit(0), ids, "delivery_id", "t").count() == 0


def test_batches_of_deliveries_equal_one_table(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, r.choice("uv"), r.randrange(60), day(r.choice((None, *range(100))))) for i in range(400)] + [(900 + i, "u", -1, day(i % 90)) for i in range(200)] + [(i, "w", i, day(1)) for i in range(2000, 2400)]
    df = spark.createDataFrame(rows, "delivery_id bigint, u string, o bigint, t timestamp_ntz")
    args = [F.col("u"), F.col("o")], "delivery_id", "t"
    want = sorted(x.delivery_id for x in dedup.surplus(df, *args).collect())
    got = set()
    for i in (2, 0, 1):
        part = df.where(F.pmod("delivery_id", F.lit(3)) == i)
        store = dedup.DeliveryStore(spark, str(tmp_path / "s"), slices=4)

        class Dies(dedup.DeliveryStore):
            pass

        if i == 0:  # a batch that dies before its commit leaves nothing
            dying = Dies(spark, str(tmp_path / "s"))
            dying.files = type("F", (), {"data_files": store.files.data_files, "put_new": lambda *a: False})()
            with pytest.raises(RuntimeError):
                dying.add(part, *args, "0")
        got |= {x.delivery_id for x in store.add(part, *args, str(i)).collect()}
        assert store.add(part, *args, str(i)).count() == 0
    assert sorted(got) == want and len(want) > 400
    assert dedup.DeliveryStore(spark, str(tmp_path / "s")).slices == 4


def test_only_possible_repeats_pass_the_scan(spark):
    df = spark.range(40_000).select(F.col("id").alias("d"), F.when(F.col("id") < 300, F.lit(7)).otherwise(F.col("id")).alias("o"), F.lit("u").alias("u"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("t"))
    base, ids = dedup._identified(df, [F.col("u"), F.col("o")], "d", "t", 86_400)
    screened = dedup._screened(base, 8)
    array, n = dedup._marked(screened)
    assert 1 <= n < 100 and dedup._passing(base, array).count() < 800
    assert dedup.surplus(df, [F.col("u"), F.col("o")], "d", "t").count() == 299
