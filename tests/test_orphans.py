import random
from datetime import datetime

from lexweave.operators import orphans as op
from lexweave.streaming import windows as sw

T = lambda d: datetime(2024, 1, d)
REF = "id string, keys array<string>, at timestamp, tbl string, ref_key string"
ENT = "id string, loaded_at timestamp, status string, exists int"


def frames(spark):
    refs = spark.createDataFrame(
        [("a", ["K1 ", "k9", None, ""], T(5), "x", "x"), ("a", ["k1"], T(3), "x", "x"), ("b", ["k2", "k3"], T(2), None, None), (None, ["k9"], T(4), None, None), ("c", None, T(1), None, None), ("d", ["k4"], None, None, None)], REF
    )
    ents = spark.createDataFrame([("k1", T(4), "active", 1), ("K2", T(1), "active", 1), ("k2", T(3), "withdrawn", 1), ("k3", T(1), "withdrawn", 1), ("k3", T(2), "active", 1), (None, T(1), "active", 1), ("k4", T(9), None, 1)], ENT)
    return op.references(refs, "t", "id", "keys", "at", True), op.entities(ents)


def reasons(state):
    return {(r.rec_id, r.ref_key): r.reason for r in op.orphan_references(state).collect()}


def counts(state):
    return sorted((r.ref_key, r.refs, r.exists) for r in state.counts.collect())


def test_reasons(spark):
    state = op.advance(None, *frames(spark))
    assert reasons(state) == {("a", "k1"): "late", ("a", "k9"): "absent", ("b", "k2"): "withdrawn", (None, "k9"): "absent"}
    assert {r.ref_key for r in op.orphan_keys(state.counts).collect()} == {"k2", "k9"}


CHANGES = "tbl string, rec_id string, ref_key string, at timestamp, sign int, status string"


def some_changes(rng):
    """References held and retracted, records delivered, withdrawn and delivered again, in no order of time."""
    rows = [("t", f"r{rng.randrange(6)}", f"k{rng.randrange(5)}", T(rng.randrange(1, 25)), rng.choice([1, 1, -1]), None) for _ in range(40)]
    rows += [(None, None, f"k{rng.randrange(5)}", T(rng.randrange(1, 25)), None, rng.choice(["active", "withdrawn"])) for _ in range(20)]
    return rows + rows[:5] + rows[-5:]


def sides(spark, rows):
    df = spark.createDataFrame(rows, CHANGES)
    return df.where("tbl is not null").withColumnRenamed("at", "ref_at"), df.where("tbl is null").select("ref_key", "at", "status")


def brute(rows):
    """Counts from all rows, one by one."""
    refs, ents = {}, {}
    for tbl, rec, key, at, sign, status in rows:
        if tbl:
            refs[tbl, rec, key] = max(refs.get((tbl, rec, key), (T(1), -9)), (at, sign))
        else:
            ents[key] = max(ents.get(key, (T(1), "")), (at, status))
    keys = {k for _, _, k in refs} | set(ents)
    return sorted((k, sum(v[1] > 0 for (_, _, x), v in refs.items() if x == k), int(k in ents and ents[k][1] != "withdrawn")) for k in keys)


def test_any_split_in_time_gives_the_counts_of_one_batch(spark, tmp_path):
    for seed in range(2):
        rng = random.Random(seed)
        rows = some_changes(rng)
        whole = op.advance(None, *sides(spark, rows))
        assert counts(whole) == brute(rows)
        rng.shuffle(rows)
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), 2)), len(rows)]
        ledger = op.Ledger(spark, str(tmp_path / f"ledger{seed}"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            ledger.apply(*sides(spark, rows[a:b]), i)
            ledger.apply(*sides(spark, rows[a:b]), i)  # a batch run again counts once
        assert counts(ledger.state()) == counts(whole)
        assert reasons(ledger.state()) == reasons(whole)
        assert ledger.versions() == [1, 2]


def test_a_withdrawal_in_a_later_batch(spark):
    refs, none = sides(spark, [("t", "r", "k", T(2), 1, None)])
    there = op.advance(None, refs, sides(spark, [(None, None, "k", T(1), None, "active")])[1])
    assert counts(there) == [("k", 1, 1)] and reasons(there) == {}
    gone = op.advance(there, refs.limit(0), sides(spark, [(None, None, "k", T(3), None, "withdrawn")])[1])
    assert counts(gone) == [("k", 1, 0)] and reasons(gone) == {("r", "k"): "withdrawn"}
    dropped = op.advance(gone, sides(spark, [("t", "r", "k", T(4), -1, None)])[0], none)
    assert counts(dropped) == [("k", 0, 0)] and reasons(dropped) == {}


def test_stream_of_changes(spark, tmp_path):
    rows = some_changes(random.Random(7))
    for i, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    ledger = op.Ledger(spark, str(tmp_path / "ledger"))
    q = sw.maintain_orphans(stream, ledger, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert counts(ledger.state()) == brute(rows)


def test_report_and_empty(spark):
    refs, ents = frames(spark)
    assert sum(r.orphans for r in op.orphan_report(op.orphan_references(op.advance(None, refs, ents))).collect()) == 4
    assert op.orphan_references(op.advance(None, refs.limit(0), ents)).count() == 0
    assert op.orphan_references(op.advance(None, refs, ents.limit(0))).count() == 6
