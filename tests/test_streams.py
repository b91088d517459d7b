"""Streams against their batch twins, and batches that come twice."""

import glob
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import core
from tessera.plans.replay import live_rollups, promoted, promotion_observations
from tessera.streaming import commits, pending, rollups


def drain(stream, write=None, mode="append"):
    """Runs a stream to its end; the rows of an append stream, or what ``write`` does with each batch."""
    held = []
    stream.writeStream.outputMode(mode).option("checkpointLocation", tempfile.mkdtemp()).foreachBatch(write or (lambda b, i: held.extend(b.collect()))).trigger(availableNow=True).start().awaitTermination(180)
    return held


def files(spark, rows, schema, n=3):
    """A folder with ``n`` files, in the order of the rows."""
    path = tempfile.mkdtemp()
    step = -(-len(rows) // n)
    for i in range(n):
        if rows[i * step : (i + 1) * step]:
            spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_live_rollups_equal_batch_and_keep_late_rows_where_they_belong(spark):
    """A replay of the arrivals of the registered query, a file a batch, equals it; minutes end, hours don't."""
    rows = spark.createDataFrame([(i, "ab"[i % 2], 1_700_000_000 + i * 5_000 - (9 * 86_400 if i % 13 == 5 else 100_000 if i % 13 == 7 else 0), (i * 5_000) // 300_000) for i in range(400)], "id long, actor string, t long, batch long")
    want = {(r.seconds, r.bucket, r.actor): r["items"] for r in live_rollups(rows, 48 * 3600).collect()}
    path, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    for (batch,) in rows.select("batch").distinct().orderBy("batch").collect():
        rows.where(F.col("batch") == batch).coalesce(1).write.mode("append").parquet(path)
    stream = rollups.read_items(spark, path, rows.schema, 1).withColumn("at", F.timestamp_seconds("t"))
    for name, writer in rollups.live_rollups(stream, "at", "actor", out).items():
        writer.option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).queryName(f"{name}_rollup").start().awaitTermination(300)
    fine = {(r.seconds, int(r.b), r.actor): r["items"] for r in spark.read.parquet(f"{out}/fine").withColumn("b", F.unix_seconds("bucket")).collect()}
    coarse = {(r.seconds, int(r.b), r.actor): r["items"] for r in rollups.merged(spark, f"{out}/coarse", ["items"]).withColumn("b", F.unix_seconds("bucket")).collect()}
    assert fine | coarse == want and sum(n for (g, _, _), n in want.items() if g == 60) < 400 == sum(n for (g, _, _), n in want.items() if g == 3600)


def test_state_of_minutes_falls(spark):
    """Batches a month apart: the state holds the last one only."""
    import datetime as dt

    t = lambda month, i: dt.datetime(2024, month, 1) + dt.timedelta(minutes=i)
    path = files(spark, [("ab"[i % 2], t(m, i)) for m in range(1, 7) for i in range(50)], "k string, at timestamp", 6)
    query = rollups.tumbling(rollups.read_items(spark, path, "k string, at timestamp", 1), "at", "k", 60).writeStream.outputMode("update").option("checkpointLocation", tempfile.mkdtemp()).foreachBatch(lambda b, i: b.count()).trigger(availableNow=True).start()
    query.awaitTermination(180)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 100 and held[-1] <= 50


def test_merged_sums_survive_repeated_batches(spark):
    out = f"{tempfile.mkdtemp()}/t"
    sink = rollups.merge_sink(out, ["k"], ["n", "m"], F.length("k"))
    made = lambda rows: spark.createDataFrame(rows, "k string, n long, m long")
    for rows, batch in (([("a", 2, 5), ("bb", 1, 1), ("a", 1, 0)], 0), ([("a", 4, -5)], 1), ([("a", 4, -5)], 1), ([("bb", -1, -1), ("c", 0, 7)], 2), ([("bb", -1, -1), ("c", 0, 7)], 2), ([("c", 1, 0)], 3)):
        sink(made(rows), batch)
    assert sorted(map(tuple, rollups.merged(spark, out, ["n", "m"]).collect())) == [("a", 7, 0), ("c", 1, 7)]


ITEMS = "block_number long, item_index long, actor string"


def test_block_sink_replaces_and_repeats(spark):
    """Blocks are replaced as a whole, surplus items go, a block that became empty loses all of its items, and a batch
    that comes twice changes nothing."""
    base = tempfile.mkdtemp()
    sink = commits.block_sink(base, chunk=10, others={"actors": lambda b: b.where("actor IS NOT NULL").select("block_number", "actor")})
    made = lambda rows: spark.createDataFrame(rows, ITEMS)
    first = made([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (12, 0, "d"), (25, 0, "e"), (26, None, None)])
    second = made([(1, 0, "a"), (1, 1, "x"), (13, 0, "f"), (25, None, None)])
    for rows, batch in ((first, 0), (first, 0), (second, 1), (second, 1)):
        sink(rows, batch)
    read = lambda name, schema: sorted(map(tuple, commits.current(spark, base, name, schema).collect()))
    assert read("items", ITEMS) == [(1, 0, "a"), (1, 1, "x"), (12, 0, "d"), (13, 0, "f")]
    assert read("blocks", "block_number long, n long") == [(1, 2), (12, 1), (13, 1), (25, 0), (26, 0)]
    assert read("actors", "block_number long, actor string") == [(1, "a"), (1, "x"), (12, "d"), (13, "f")]
    assert {p for _, p in commits.parts(spark, base) if _ == "items"} == {0, 1}


def test_a_commit_that_fails_between_tables_is_not_seen(spark):
    base = tempfile.mkdtemp()
    made = lambda rows: spark.createDataFrame(rows, ITEMS)
    broken = {"fail": False}

    def other(batch):
        return batch.select("block_number", F.raise_error("lost").cast("string").alias("x") if broken["fail"] else F.lit("x").alias("x"))

    sink = commits.block_sink(base, chunk=10, others={"zz": other})
    state = lambda: (sorted(map(tuple, commits.current(spark, base, "items", ITEMS).collect())), sorted(map(tuple, commits.current(spark, base, "blocks", "block_number long, n long").collect())), commits.current(spark, base, "zz", "block_number long, x string").count())
    sink(made([(1, 0, "a"), (12, 0, "b")]), 0)
    before = state()
    broken["fail"] = True
    try:
        sink(made([(1, 0, "z"), (1, 1, "z")]), 1)
        raise AssertionError("the commit should have failed")
    except Exception as e:
        assert "lost" in str(e)
    assert glob.glob(f"{base}/items/commit=1/part=*") and state() == before
    broken["fail"] = False
    sink(made([(1, 0, "z"), (1, 1, "z")]), 1)
    assert state() == ([(1, 0, "z"), (1, 1, "z"), (12, 0, "b")], [(1, 2), (12, 1)], 2)


def test_change_feed(spark):
    out = tempfile.mkdtemp()
    feed = rollups.change_feed(out)
    rows = spark.createDataFrame([(2, 1, "b"), (2, 0, "a"), (3, 0, "c")], "block_number long, item_index long, actor string")
    for _ in range(2):
        feed(rows, 5)
    got = sorted((r.block_number, r.event) for r in spark.read.parquet(f"{out}/batch=5").collect())
    assert got == [(2, '{"block_number":2,"items":[{"item_index":0,"actor":"a"},{"item_index":1,"actor":"b"}]}'), (3, '{"block_number":3,"items":[{"item_index":0,"actor":"c"}]}')]
    built = lambda s: s.createDataFrame([(2, "P")], "block_number long, producer string")
    rollups.change_feed(out, producers=built)(rows, 6)
    got = [(r.block_number, r.event) for r in spark.read.parquet(f"{out}/batch=6").collect()]
    assert got == [(2, '{"block_number":2,"producer":"P","items":[{"item_index":0,"actor":"a"},{"item_index":1,"actor":"b"}]}'), (3, '{"block_number":3,"items":[{"item_index":0,"actor":"c"}]}')]


def test_snapshots_give_differences(spark):
    out = tempfile.mkdtemp()
    sink = rollups.diff_sink(out, ["tx_hash"])
    for batch, held in enumerate((["a", "b", "b"], ["b", "c"], ["b", "c"], [])):
        sink(spark.createDataFrame([(x,) for x in held], "tx_hash string"), batch)
    of = lambda i: sorted(map(tuple, spark.read.parquet(f"{out}/events/batch={i}").collect()))
    assert [of(i) for i in range(4)] == [[], [("a", "removed"), ("c", "added")], [], [("b", "removed"), ("c", "removed")]]


def test_totals_are_refreshed_and_some_less_often(spark):
    out = tempfile.mkdtemp()
    sink = rollups.totals_sink(lambda s: {"network": s.range(3).agg(F.count("*").alias("n")), "actors*": s.range(2)}, out, every=2)
    for i in range(3):
        sink(spark.range(1), i)
    sink(spark.range(0), 3)
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{out}/network/batch=*")) == ["0", "1", "2"]
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{out}/actors/batch=*")) == ["0", "2"]


def test_rows_read_again_add_nothing(spark):
    rows = [(i % 20, f"2024-01-01 00:{i % 20:02d}:00") for i in range(60)]
    path = files(spark, rows, "n long, at string")
    stream = rollups.read_items(spark, path, "n long, at string", 1).withColumn("at", F.to_timestamp("at"))
    assert sorted(r.n for r in drain(rollups.first_seen(stream, "at", ["n"]))) == list(range(20))


def test_life_of_pending_items(spark):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    seen = [
        ("seen", "a1", "A", 1, 5, 1, t(0)), ("seen", "b1", "B", 7, None, None, t(0)), ("seen", "n1", "A", None, 3, 1, t(1)), ("seen", "a1", "A", 1, 5, 1, t(2)),
        ("seen", "a2", "A", 1, 9, 2, t(3)), ("seen", "a1", "A", 1, 5, 1, t(4)), ("confirmed", "a2", "A", 1, 9, 2, t(5)), ("seen", "a2", "A", 1, 9, 2, t(6)),
        ("confirmed", "c1", "C", 2, 4, 1, t(7)), ("seen", "f1", "F", 3, 4, 1, t(7)), ("confirmed", "f2", "F", 3, 6, 8, t(8)), ("seen", "f1", "F", 3, 4, 1, t(9)),
        ("seen", "d1", "D", 0, 1, 1, t(300)), ("seen", "e1", "E", 0, 1, 1, t(500)), ("seen", "e1", "E", 0, 1, 1, t(501)),
    ]
    path = files(spark, [(*r, 4, 2) for r in seen], pending.OBSERVED, 4)
    got = drain(pending.lifecycle(rollups.read_items(spark, path, pending.OBSERVED, 1)))
    short = sorted((r.event, r.tx_hash, r.replacement or "", r.max_fee, r.tip, r.replacement_fee, r.replacement_tip, r.first_seen) for r in got if r.event in ("replaced", "confirmed"))
    assert short == [("confirmed", "a2", "", 9, 2, None, None, t(3)), ("confirmed", "c1", "", 4, 1, None, None, None), ("confirmed", "f2", "", 6, 8, None, None, None), ("replaced", "a1", "a2", 5, 1, 9, 2, t(0)), ("replaced", "f1", "f2", 4, 1, 6, 8, t(7))]
    assert sorted(r.tx_hash for r in got if r.event == "added") == ["a1", "a2", "b1", "d1", "e1", "f1", "n1"]
    expired = {r.tx_hash: (r.first_seen, r.last_seen) for r in got if r.event == "expired"}
    assert expired["b1"] == (t(0), t(0)) and expired["n1"] == (t(1), t(1)) and not {"a2", "e1", "f1"} & set(expired)


def test_promotion_writes_facts_and_the_log(spark):
    """A replay of observations in files equals the registered query, also when batches come twice."""
    observed = promotion_observations(spark, "/root/testdata/sf0.001")
    want = {r.tx_hash: r for r in promoted(observed).collect()}
    rows = observed.orderBy("at", "kind", "tx_hash").collect()
    path, out = files(spark, rows, observed.schema, 5), tempfile.mkdtemp()
    sink = pending.promotion_sink(out)
    stream = pending.lifecycle(rollups.read_items(spark, path, observed.schema, 1), ttl=90 * 86400)
    drain(stream, lambda b, i: (b.persist(), sink(b, i), sink(b, i)))
    facts, log = spark.read.parquet(f"{out}/facts").collect(), spark.read.parquet(f"{out}/replacements").collect()
    assert Counter(r.tx_hash for r in facts) == {tx: r["items"] for tx, r in want.items()}
    assert all((r.first_seen, r.block_number) == (want[r.tx_hash].first_seen, want[r.tx_hash].block_number) for r in facts)
    evicted = {(r.replaced, r.replacement, r.max_fee, r.tip, r.replacement_fee, r.replacement_tip) for r in log if r.replacement in want and want[r.replacement].evicted == r.replaced}
    assert evicted == {(r.evicted, r.tx_hash, r.evicted_max_fee, r.evicted_tip, r.max_fee, r.tip) for r in want.values() if r.evicted} and evicted
    assert sum(r.first_seen is not None for r in want.values()) > 10


def test_snapshots_trim_what_no_message_removed(spark):
    import datetime as dt

    out = tempfile.mkdtemp()
    sink = pending.reconcile_sink(out)
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for batch, held in enumerate((["a", "b", "b"], ["b", "c"], ["b", "c"], [], ["a"])):
        for _ in range(2):
            sink(spark.createDataFrame([(x, x.upper(), t(batch)) for x in held], "tx_hash string, actor string, at timestamp"), batch)
    of = lambda kind, i: sorted((r.tx_hash, r.actor, r.first_seen, r.last_seen) for r in spark.read.parquet(f"{out}/{kind}/batch={i}").collect())
    assert of("pending", 2) == [("b", "B", t(0), t(2)), ("c", "C", t(1), t(2))] and of("trimmed", 1) == [("a", "A", t(0), t(0))]
    assert of("trimmed", 3) == [("b", "B", t(0), t(2)), ("c", "C", t(1), t(2))] and of("pending", 4) == [("a", "A", t(4), t(4))]


def heads_of(spark, heads, n=1):
    rows = [(c, i, number, h, p) for i, (c, number, h, p) in enumerate(heads)]
    return rollups.read_items(spark, files(spark, rows, pending.HEADS, n), pending.HEADS, 1)


def line(chain, name, first, last, base=None):
    """Heads ``name``first to ``name``last, each on the one before, the first one on ``base``."""
    return [(chain, n, f"{name}{n}", f"{name}{n - 1}" if n > first or base is None else base) for n in range(first, last + 1)]


def test_forks_of_a_chain(spark):
    cases = {
        1: (line(1, "h", 1, 7) + line(1, "g", 7, 8, "h6"), [(7, "g7", "fork", 6, 1)]),  # depth 1, a sibling of the tip
        2: (line(2, "h", 1, 9) + line(2, "g", 7, 10, "h6"), [(7, "g7", "fork", 6, 3)]),  # depth 3
        3: (line(3, "h", 1, 4) + [(3, 3, "x3", "h2")], [(3, "x3", "fork", 2, 2)]),  # a sibling below the tip
        4: (line(4, "h", 1, 5) + line(4, "g", 4, 7, "h3")[::-1], [(7, "g7", "fork", 3, 2)]),  # the new branch from above
        5: (line(5, "h", 1, 30) + line(5, "g", 10, 31, "h9"), [(10, "g10", "exhausted", None, None)]),  # beyond the cap of 8
        6: (line(6, "h", 1, 5) + [(6, 5, "h5", "h4"), (6, 3, "h3", "h2")] + line(6, "h", 6, 7), []),  # told again
        7: (line(7, "h", 5, 8) + line(7, "g", 5, 6, "q4"), [(5, "g5", "start", 4, 4)]),  # from below the first block
        8: (line(8, "h", 1, 6) + [(8, 6, "x6", "h5"), (8, 7, "h7", "h6")], [(6, "x6", "fork", 5, 1), (7, "h7", "fork", 5, 1)]),  # there and back
        9: (line(9, "h", 1, 3) + line(9, "h", 5, 6) + [(9, 4, "h4", "h3")] + line(9, "g", 6, 7, "h5"), [(6, "g6", "fork", 5, 1)]),  # a gap that closes
        10: (line(10, "h", 1, 3) + line(10, "h", 7, 20), [(14, "h14", "exhausted", None, None)]),  # a gap that stays
    }
    for n in (1, 7):
        got = drain(pending.forks(heads_of(spark, [h for heads, _ in cases.values() for h in heads], n), depth=8))
        found = {c: [tuple(r)[1:] for r in got if r.chain == c] for c in cases}
        assert found == {c: want for c, (_, want) in cases.items()}


def test_forks_equal_the_batch_query(spark):
    """Every five hundred blocks the last ones are told again on another branch."""
    from tessera.plans.maintenance import reorgs

    stale = {n for n in range(1, 3001) if n % 500 >= 500 - n // 500 - 1}
    chain = spark.createDataFrame([(n, f"o{n}" if n in stale else f"h{n}", f"h{n}") for n in range(1, 3001)], "n long, stored string, current string")
    want = {(r.fork, r.top - r.fork) for r in reorgs(chain).collect()}
    heads, name = [], lambda n, old: f"o{n}" if old and n in stale else f"h{n}"
    for n in range(1, 3001):
        heads.append((1, n, name(n, True), name(n - 1, True)))
        if n in stale and n + 1 not in stale:
            low = n
            while low - 1 in stale:
                low -= 1
            heads += [(1, m, name(m, False), name(m - 1, False)) for m in range(low, n + 1)]
    heads = [(c, n, h, p if not (p[0] == "o" and h[0] == "h") else "h" + p[1:]) for c, n, h, p in heads]
    got = drain(pending.forks(heads_of(spark, heads, 4)))
    assert {(r.fork, r.dropped) for r in got} == want and len(want) == 6 and {r.outcome for r in got} == {"fork"}


def test_late_rows_are_left_out(spark):
    """A row older than the watermark makes no bucket; one inside it does."""
    rows = [("a", "2024-01-10 00:00:10"), ("a", "2024-01-10 00:00:20"), ("a", "2024-01-10 00:05:00"), ("a", "2024-01-07 23:00:00"), ("a", "2024-01-08 01:00:00")]
    path = files(spark, rows, "k string, at string", 5)
    stream = rollups.read_items(spark, path, "k string, at string", 1).withColumn("at", F.to_timestamp("at"))
    held = {}
    drain(rollups.tumbling(stream, "at", "k", 60), lambda b, i: held.update({str(r.bucket): r["items"] for r in b.collect()}), "update")
    assert held == {"2024-01-10 00:00:00": 2, "2024-01-10 00:05:00": 1, "2024-01-08 01:00:00": 1}


def test_the_first_snapshot_of_a_live_block_stays(spark):
    out = f"{tempfile.mkdtemp()}/missed"
    made = lambda rows: lambda s: s.createDataFrame(rows, "tx_hash string, actor string, nonce long, items long, max_fee long, max_exec long, tip long, seen long")
    blocks = spark.createDataFrame([(1, 7200, 0, 5, 5, 7230), (2, 7920, 0, 5, 5, 9999)], "block_number long, t long, items long, fee long, base_fee long, arrived long")
    one, two = [("a", "A", 1, 1, 9, 9, 3, 7000), ("b", "A", 2, 1, 9, 9, 3, 7000), ("c", "C", 1, 1, 4, 9, 3, 7000)], [("d", "D", 1, 1, 9, 9, 3, 7000)]
    for pending_rows, batch in ((one, 0), (one, 0), (two, 1)):
        pending.snapshot_sink(made(pending_rows), out)(blocks, batch)
    assert sorted((r.block_number, r.tx_hash, r.reason) for r in spark.read.parquet(out).collect()) == [(1, "a", "eligible"), (1, "b", "nonce_gap"), (1, "c", "priced_out_item_fee")]


def test_set_diff(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("ab", "bc"))
    assert sorted(map(tuple, core.set_diff(a, b, ["k"]).collect())) == [("a", "removed"), ("c", "added")]
