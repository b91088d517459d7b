"""Small fixtures for operators, and invariants."""

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import core


def test_islands_are_stitched_over_range_borders(spark):
    counts = {7: 2, 8: 6, 9: 6, 10: 6, 11: 6, 12: 0, 13: 6, 14: 5, 15: 6, 16: 7}
    rows = spark.createDataFrame([("full", n) for n, c in counts.items() if c >= 6], "kind string, n long")
    for span in (1, 3, 100):
        assert sorted(map(tuple, core.islands(rows, ["kind"], "n", span).select("first", "last", "length").collect())) == [(8, 11, 4), (13, 13, 1), (15, 16, 2)]


def test_percentiles_are_exact_beyond_doubles(spark):
    big = 10**18
    rows = spark.createDataFrame([("a", str(big + i)) for i in range(1, 8)], "k string, v string").withColumn("v", F.col("v").cast("decimal(38,0)"))
    got = core.disc_percentiles(rows, ["k"], "v", p50="0.5", p95="0.95").first()
    assert (int(got.p50), int(got.p95)) == (big + 4, big + 7)


def test_merge_drops_keys_without_sums(spark):
    old = spark.createDataFrame([("a", 2), ("b", 1)], "k string, n long")
    new = spark.createDataFrame([("b", -1), ("c", 5)], "k string, n long")
    assert sorted(map(tuple, core.merge(old, new, ["k"], ["n"]).collect())) == [("a", 2), ("c", 5)]


def test_expressions(spark):
    row = spark.range(1).select(
        X.units(F.lit("70000000000000123").cast("decimal(38,0)"), 9).alias("u"), X.slug(F.lit(" Rollup  X! ")).alias("s"), X.share(F.lit(1), F.lit(3)).alias("p"),
        X.share(F.lit(1), F.lit(0)).alias("z"), X.effective_tip(F.lit(5), F.lit(None).cast("long"), F.lit(1)).alias("t"), X.units(F.lit(10**9), 9).alias("one"),
    ).first()
    assert (row.u, row.s, row.p, row.z, row.t, row.one) == ("70000000.000000123", "rollup_x", 33.333333, 0.0, None, "1")


def test_reasons_take_the_first_rule_and_unknown_caps_never_price_out(spark):
    from tessera.sources import views as V

    # age, nonce, lowest, max_fee, fee, max_exec, base_fee, wanted, items
    rows = [(59, 1, 1, 9, 5, 9, 5, 1, 0), (60, 2, 1, 1, 5, 1, 5, 9, 6), (60, None, 1, None, 5, None, 5, 1, 0), (60, 1, None, 4, 5, 1, 5, 1, 0), (60, 1, 1, 5, 5, 4, 5, 1, 0), (60, 1, 1, 5, 5, 4, 0, 1, 0), (60, 1, 1, 5, 5, 5, 5, 2, 5), (60, 1, 1, 5, 5, 5, 5, 1, 5)]
    names = ["age", "nonce", "lowest", "max_fee", "fee", "max_exec", "base_fee", "wanted", "items"]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} long" for n in names))
    got = [r[1] for r in sorted(table.select("i", V.reason(*(F.col(n) for n in names))).collect())]
    assert got == ["too_recent", "nonce_gap", "eligible", "priced_out_item_fee", "priced_out_exec_fee", "eligible", "no_room", "eligible"]


def test_percentiles_of_few_keys_equal_those_of_many(spark):
    rows = spark.sql("SELECT id % 3 AS k, (id * 7919 % 1000) * (id * 7919 % 1000) * 12345678901 AS v FROM range(3000)")
    one, two = (f(rows, ["k"], "v", p05="0.05", p50="0.5", p95="0.95").orderBy("k").collect() for f in (core.disc_percentiles, core.few_disc_percentiles))
    assert one == two
    one, two = (f(rows, ["k"], "v", p10="0.1", p50="0.5").orderBy("k").collect() for f in (core.cont_percentiles, core.few_cont_percentiles))
    assert [tuple(r) for r in one] == [tuple(r) for r in two]


def test_amounts_and_texts(spark):
    row = spark.range(1).select(
        X.units(F.lit("12x"), 9).alias("bad"), X.units(F.lit(""), 9).alias("empty"), X.units(F.lit("-0015"), 2).alias("below"), X.percent_text(F.lit(1), F.lit(3)).alias("third"), X.percent_text(F.lit(-2), F.lit(3)).alias("minus"), X.percent_text(F.lit(1), F.lit(0)).alias("none"),
        X.slot(F.lit(100), 40, 12).alias("own"), X.slot(F.lit(100), 40, 12, F.lit(7)).alias("kept"), X.slot(F.lit(10), 40, 12).alias("early"), X.extra_text(F.lit("0x416220")).alias("text"), X.extra_text(F.lit("0x41ff")).alias("raw"), X.extra_text(F.lit("zz")).alias("junk"),
        X.producer_label(F.lit("0x"), F.lit(" "), []).alias("nobody"),
    ).first()
    assert (row.bad, row.empty, row.below, row.third, row.minus, row.none) == ("", "", "-0.15", "33.333333", "-66.666667", None)
    assert (row.own, row.kept, row.early, row.text, row.raw, row.junk, row.nobody.key) == (5, 7, None, "Ab", "", "", "addr:unknown")


def test_fees_and_schedules(spark):
    from tessera.plans import fees

    assert [fees.fake_exponential(n, d) for n, d in ((0, 3338477), (3338477, 3338477), (10 * 3338477, 3338477))] == [1, 2, 22026]
    table = lambda rows: spark.createDataFrame(rows, "since long, target long, cap long, fraction long")
    built = fees.build(table([(0, 3, 6, 1), (10, 6, 9, 2)]), table([(10, 7, 9, 2), (20, 7, 9, 2), (30, 9, 12, 2)])).orderBy("since").collect()
    assert [tuple(r) for r in built] == [(0, 3, 6, 1, 20), (10, 7, 9, 2, 20), (30, 9, 12, 2, 20)]
    left = fees.reconcile(table([(0, 1, 1, 1), (50, 1, 1, 1), (60, 1, 1, 1)]), table([(60, 2, 2, 2)]), now=20).orderBy("since").collect()
    assert [(r.since, r.target) for r in left] == [(0, 1), (60, 2)]


def test_waiting_begins_with_the_next_block(spark):
    from tessera.plans import inclusion

    blocks = spark.createDataFrame([(1, 100), (2, 86300), (5, 3 * 86400 + 5)], "block_number long, t long")
    asked = spark.createDataFrame([("a", 50), ("b", 100), ("c", 101), ("d", 86301), ("e", 2 * 86400), ("f", 4 * 86400)], "tx_hash string, seen long")
    got = dict(map(lambda r: (r.tx_hash, r.from_block), inclusion.first_at_or_after(blocks, asked, "tx_hash", "seen").collect()))
    assert got == {"a": 1, "b": 1, "c": 2, "d": 5, "e": 5, "f": None}


def test_waiting_in_a_busy_hour_takes_one_step_a_row(spark):
    """Against the next block of each second; no window frame shrinks, since each of its rows would sum up the rest anew."""
    import bisect

    from tessera.plans import inclusion

    times = [5, 5 + 600, 3599, 3600, 4000, 9 * 3600 + 1]
    blocks = spark.createDataFrame(list(enumerate(times)), "block_number long, t long")
    asked = spark.range(0, 10 * 3600, 7).selectExpr("concat('x', id) AS tx_hash", "id AS seen")
    found = inclusion.first_at_or_after(blocks, asked, "tx_hash", "seen")
    want = lambda t: (lambda i: i if i < len(times) else None)(bisect.bisect_left(times, t))
    assert all(r.from_block == want(r.seen) for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_chains_of_replacements_lead_to_their_ends(spark):
    from tessera.plans import maintenance

    edges = [(f"a{i}", f"a{i + 1}") for i in range(11)] + [("b0", "b1")]
    got = {r.tx_hash: r.end for r in maintenance.chain_ends(spark.createDataFrame(edges, "replaced string, replacement string")).collect()}
    assert got == {f"a{i}": "a11" for i in range(11)} | {"b0": "b1"}


def test_runs_follow_changes_in_the_middle(spark):
    """Against runs from scratch, on random blocks; two changes inside one run; only rows near the changes are asked for."""
    import random

    from tessera.plans.incremental import follow_runs, kinds_of

    rng = random.Random(2)
    n = 240
    before = [rng.choice([0, 0, 0, 1, 3, 4, 6]) for _ in range(n)]
    before[40:120] = [0] * 80
    for changed in ([(60, 61), (90, 92)], [(0, 3)], [(n - 2, n - 1), (5, 5)], [(39, 39), (120, 120)], [(150, 170), (171, 180)], []):
        after = list(before)
        for a, b in changed:
            for i in range(a, b + 1):
                after[i] = rng.choice([0, 6, 3])
        frame = lambda items: spark.createDataFrame(list(enumerate(items)), "block_number long, items long")
        runs = lambda items: core.islands(kinds_of(frame(items)), ["kind"], "n", span=50)
        asked = []

        def rows_of(lo, hi, after=after, asked=asked):
            asked.append((lo, hi))
            return kinds_of(frame(after).where(f"block_number BETWEEN {lo} AND {hi}"))

        got = follow_runs(runs(before), changed, rows_of)
        assert sorted(map(tuple, got.collect())) == sorted((r.kind, r.first, r.last, r.length) for r in runs(after).collect())
        assert sum(hi - lo + 1 for lo, hi in asked) < n / 2


def test_totals_follow_images(spark):
    import random

    from tessera.plans.incremental import changes, follow, totals

    rng = random.Random(4)
    schema = "block_number long, item_index long, actor string, label string, cost decimal(38,0), t long"
    from decimal import Decimal

    row = lambda b, i: (b, i, rng.choice("abcdef"), rng.choice(["", "  ", "X", "Y", None]), Decimal(rng.randrange(9)), b * 10)
    for _ in range(3):
        old = {(b, i): row(b, i) for b in range(12) for i in range(rng.randrange(4))}
        new = {k: v if rng.random() < 0.6 else row(*k) for k, v in old.items() if rng.random() < 0.8} | {(b, 7): row(b, 7) for b in range(0, 12, 5)}
        a, b = (spark.createDataFrame(list(x.values()), schema) for x in (old, new))
        plain = lambda rows: sorted((r.actor, r["items"], r.cost, r.last_t, r.named and r.named.label) for r in rows.collect())
        assert plain(follow(totals(a), changes(a, b, ["block_number", "item_index"]), b)) == plain(totals(b))


def test_totals_follow_images_of_repeated_keys(spark):
    """A row that comes may have the key of one that stays; each counts once."""
    from decimal import Decimal

    from tessera.plans.incremental import changes, follow, totals

    schema = "block_number long, item_index long, actor string, label string, cost decimal(38,0), t long"
    row = lambda i, actor, label, cost: (1, i, actor, label, Decimal(cost), 10)
    old = [row(0, "m", "X", 1), row(1, "m", "", 2), row(2, "n", "Y", 3), row(2, "o", "", 4), row(2, "o", "", 4)]
    new = [row(0, "m", "X", 1), row(0, "a", "Z", 8), row(1, "m", "", 2), row(1, "z", "", 9), row(1, "z", "", 9), row(2, "o", "", 4), row(2, "p", "", 5)]
    a, b = (spark.createDataFrame(x, schema) for x in (old, new))
    plain = lambda rows: sorted((r.actor, r["items"], r.cost, r.last_t, r.named and r.named.label) for r in rows.collect())
    images = changes(a, b, ["block_number", "item_index"])
    assert plain(follow(totals(a), images, b)) == plain(totals(b))
    # no row of either table stands in two images
    assert images.where("old IS NOT NULL").count() <= len(old) and images.where("new IS NOT NULL").count() <= len(new)


def test_nested_blocks(spark):
    from tessera.sources import nested

    lines = [
        '{"number": 1, "time": 10, "fee": 3, "transactions": [{"hash": "x", "sender": "A", "item_hashes": ["h1", "h2"]}, {"hash": "y", "item_hashes": []}, {"hash": "w"}, {"hash": "z", "nonce": 4, "item_hashes": ["h3"]}]}',
        '{"number": 2, "time": 11, "transactions": []}', '{"number": 3, "time": 12}', "no json", '{"time": 1}', None, "",
    ]
    parsed = nested.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = [(r.block_number, r.item_index, r.tx_index, r.ordinal, r.tx_hash, r.actor, r.nonce, r.content_hash) for r in nested.items(parsed).orderBy("item_index").collect()]
    assert got == [(1, 0, 0, 0, "x", "A", None, "h1"), (1, 1, 0, 1, "x", "A", None, "h2"), (1, 2, 3, 0, "z", None, 4, "h3")]
    assert sorted(map(tuple, nested.counts(parsed).collect())) == [(1, 10, 4, 3), (2, 11, 0, 0), (3, 12, 0, 0)]
    assert sorted(str(r.line) for r in nested.rejected(parsed).collect()) == sorted(["no json", '{"time": 1}', "None", ""])


def test_nested_blocks_of_many_transactions(spark):
    """Places in a block whose transactions hold 0 to 3 items; no row carries a list that grows with the block."""
    import json

    from tessera.sources import nested

    held = [[f"h{i}-{j}" for j in range(i % 4)] for i in range(3000)]
    line = json.dumps({"number": 1, "time": 10, "transactions": [{"hash": f"t{i}", "item_hashes": x} for i, x in enumerate(held)] + [None, {"item_hashes": [None, "last"]}]})
    items = nested.items(nested.parse(spark.createDataFrame([(line,)], "value string")))
    got = sorted((r.item_index, r.tx_index, r.ordinal, r.content_hash) for r in items.collect())
    places = [(i, j, h) for i, x in enumerate([*held, [], [None, "last"]]) for j, h in enumerate(x)]
    assert got == [(n, *p) for n, p in enumerate(places)]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "slice(" not in plan and plan.count("Generate") == 1


def test_chart_requests():
    import pytest

    from tessera.plans.spec import Refused, chart_spec

    at = lambda *a, **k: (lambda s: (s.granularity, s.step, s.first, s.last))(chart_spec(*a, now=1_000_001, block_seconds=12, **k))
    assert at("1h") == ("minute", 60, 1_000_020 - 3600, 1_000_020) and at("24h") == ("minute", 300, 1_000_200 - 86400, 1_000_200)
    assert at("7d")[:2] == ("hour", 3600) and at("30d")[:2] == ("hour", 21600) and at("all") == ("day", 86400, None, 1_036_800)
    assert at("1h", "block") == ("block", 12, 1_000_001 - 3600, 1_000_001) and at(" 7D ", "Day")[:2] == ("day", 86400)
    for bad in (dict(range="2h"), dict(granularity="week"), dict(points=0), dict(points=1001), dict(range="all", view="market"), dict(range="all", granularity="hour"), dict(range="all", granularity="block"), dict(range="1h", granularity="day"), dict(range="24h", granularity="minute"), dict(range="24h", granularity="block"), dict(range="30d", granularity="hour")):
        with pytest.raises(Refused):
            chart_spec(**({"now": 1_000_001, "block_seconds": 12} | bad))
    assert chart_spec("30d", "hour", points=1000).step == 3600


def test_rolling_queries_read_stored_rollups(spark):
    """From a store no events are scanned; renewed days alone get new files; results equal those from rows."""
    import glob
    import tempfile

    from tessera.plans import detail, inclusion, tiers
    from tessera.sources import views as V

    sf, store = "/root/testdata/sf0.01", tempfile.mkdtemp()
    tiers.build(spark, sf, store)
    for q in (detail.q26, detail.q27, inclusion.q28):
        stored, made = q(spark, sf, store=store), q(spark, sf)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, made.collect()))
        assert "events.parquet" not in "".join(stored.inputFiles()) and stored.inputFiles()
    files = lambda: set(glob.glob(f"{store}/items/hourly/day=*/*.parquet"))
    before, day = files(), 19730
    tiers.renew(V.blocks(spark, sf, day * 86400, day * 86400 + 86400).where(f"t < {day * 86400 + 86400}"), V.facts(spark, sf, day * 86400, day * 86400 + 86400).where(f"t < {day * 86400 + 86400}"), store)
    assert {f for f in before - files() if f"day={day}/" not in f} == set() and before & files() and before - files()


def test_leaders_and_charts_read_the_store(spark):
    import tempfile

    from tessera.plans import charts, detail, leaders, tiers

    sf, store = "/root/testdata/sf0.01", tempfile.mkdtemp()
    tiers.build(spark, sf, store)
    assert [tiers.widest(x) for x in (None, 86400 * 7, 3600 * 25, 60 * 61)] == ["days", "days", "hourly", "minutes"]
    windowed = [leaders.q12, leaders.q12_spend, leaders.q14, leaders.a7, leaders.q16, leaders.q18, leaders.q55]
    charted = [lambda *a, f=f, **k: f(*a, seconds=21600, **k) for f in (charts.q31, detail.q34, detail.q37)]
    for q in windowed + charted + [leaders.q13, leaders.q17, leaders.q19, leaders.q20]:  # the last four count pending items in
        stored, made = q(spark, sf, store=store), q(spark, sf)
        assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, made.collect()), key=str) and stored.columns == made.columns
        if q in windowed + charted:
            assert "events.parquet" not in "".join(stored.inputFiles()) and stored.inputFiles()


def test_labels_of_stored_rollups_that_change_within_a_bucket(spark):
    """The newest label of all history, and the greatest one of a window, whatever bucket they stand in."""
    import tempfile

    from tessera.plans import leaders, tiers

    rows = [(0, 0, "0xA", "b", 5), (0, 1, "0xA", " ", 5), (1, 0, "0xA", "c", 65), (2, 1, "0xA", "a", 66), (2, 0, "0xA", "z", 66), (3, 0, "0xB", None, 90000)]
    facts = spark.createDataFrame(rows, "block_number long, item_index long, actor string, label string, t long").withColumn("cost", F.lit(7).cast("decimal(38,0)"))
    store = tempfile.mkdtemp()
    for tier in tiers.STORED:
        tiers.save(tiers.of_items(facts, tiers.TIERS[tier][0]), store, "items", tier)
    of = lambda since: sorted(map(tuple, leaders._actors(spark, None, since, store).select("actor", "items", F.col("cost").cast("int"), "label", "last_t").collect()))
    assert of(None) == [("0xA", 5, 35, "a", 66), ("0xB", 1, 7, None, 90000)]
    assert of(0) == [("0xA", 5, 35, "z", 66), ("0xB", 1, 7, None, 90000)]
    assert of(60) == [("0xA", 3, 21, "z", 66), ("0xB", 1, 7, None, 90000)] and of(86400) == [("0xB", 1, 7, None, 90000)]


def test_only_parts_that_hold_changed_keys_are_rewritten(spark):
    import glob
    import tempfile

    from tessera.plans.incremental import rewrite

    path = f"{tempfile.mkdtemp()}/t"
    spark.createDataFrame([(p, k, "old") for p in range(4) for k in ("a", f"k{p}")][1:], "part long, address string, label string").write.partitionBy("part").parquet(path)
    files = lambda: {f for f in glob.glob(f"{path}/part=*/*.parquet")}
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "address string")
    new = lambda t: t.withColumn("label", F.when(F.col("address").isin("k2", "a"), "new").otherwise(F.col("label")))
    made = spark.createDataFrame([("k2", "new"), ("a", "new")], "address string, name string")
    before = files()
    assert rewrite(spark, path, "part", "address", keys("k2"), made, new) == [2]
    assert {f for f in before if "part=2/" not in f} <= files() and not {f for f in before if "part=2/" in f} & files()
    kept = files()
    assert rewrite(spark, path, "part", "address", keys("k0"), made.orderBy("name"), new) == [] and files() == kept
    assert rewrite(spark, path, "part", "address", keys("nobody"), made.limit(1), new) == [] and files() == kept
    assert rewrite(spark, path, "part", "address", keys("a"), made, new) == [1, 2, 3]
    assert sorted(map(tuple, spark.read.parquet(path).select("part", "address", "label").collect())) == [(0, "k0", "old"), (1, "a", "new"), (1, "k1", "old"), (2, "a", "new"), (2, "k2", "new"), (3, "a", "new"), (3, "k3", "old")]
