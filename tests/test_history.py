import datetime
import random

from pyspark.sql import functions as F

from lotwise.operators import history as H
from lotwise.operators.ordered import block_of, running
from lotwise.streaming.lifecycle import run_lifecycle

LOG = "listing_id bigint, at timestamp, seq bigint, kind string"


def hour(h):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)


def state_of(spark, rows):
    df = spark.createDataFrame([(1, hour(h), i, k) for i, (h, k) in enumerate(rows)], LOG)
    return H.lifecycle_state(df, "listing_id", "at", "kind", ["at", "seq"]).first()


def test_timeline(spark):
    seen_missed = [(0, "seen"), (1, "miss"), (2, "miss")]
    assert state_of(spark, seen_missed)["availability"] == "active"
    three = seen_missed + [(3, "miss")]
    row = state_of(spark, three)
    assert (row["availability"], row["consecutive_misses"], row["possibly_unavailable_at"]) == ("possibly_unavailable", 3, hour(3))
    row = state_of(spark, three + [(24, "sweep")])
    assert (row["availability"], row["inactive_at"]) == ("inactive", hour(24))
    row = state_of(spark, three + [(24, "sweep"), (30, "seen")])
    assert (row["availability"], row["consecutive_misses"], row["inactive_at"]) == ("active", 0, None)
    row = state_of(spark, three + [(24, "sold"), (30, "seen")])
    assert (row["availability"], row["sold_at"], row["last_seen_at"]) == ("sold", hour(24), hour(30))


def fold(rows):
    """The rules one row at a time."""
    s = None
    for _, at, _, kind in rows:
        if s is None:
            if kind == "seen":
                s = dict(a="active", n=0, first=at, last=at, doubt=None, gone=None, sold=None)
            continue
        if kind == "sold":
            s.update(a="sold", sold=at)
        elif kind == "seen":
            s["first"], s["last"] = min(s["first"], at), max(s["last"], at)
            if s["a"] != "sold":
                s.update(a="active", n=0, doubt=None, gone=None)
        elif s["a"] != "sold":
            if kind == "miss" and at > s["last"]:
                s["n"] += 1
                if s["n"] >= 3:
                    s["a"] = "inactive" if s["a"] == "inactive" else "possibly_unavailable"
                    s["doubt"] = s["doubt"] or at
            if (kind == "sweep" or at > s["last"]) and s["n"] >= 3 and at - s["last"] >= datetime.timedelta(days=1):
                s["a"], s["gone"] = "inactive", s["gone"] or at
    return s


def logs(seed, listings=25, length=14):
    rng = random.Random(seed)
    rows = []
    for listing in range(listings):
        at = 0
        for i in range(length):
            at += rng.choice([1, 5, 9, 14])
            rows.append((listing, hour(at), i, rng.choice(["seen", "miss", "miss", "miss", "sweep", rng.choice(["sold", "miss", "miss"])])))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def check(rows, got):
    for listing in {r[0] for r in rows}:
        want = fold([r for r in rows if r[0] == listing])
        row = got.get(listing)
        if want is None:
            assert row is None
            continue
        have = (row["availability"], row["consecutive_misses"], row["first_seen_at"], row["last_seen_at"], row["possibly_unavailable_at"], row["inactive_at"], row["sold_at"])
        assert have == tuple(want[k] for k in ("a", "n", "first", "last", "doubt", "gone", "sold")), listing


def test_batch_agrees_with_one_row_at_a_time(spark):
    rows = logs(4)
    df = spark.createDataFrame(rows, LOG)
    got = {r["listing_id"]: r for r in H.lifecycle_state(df, "listing_id", "at", "kind", ["at", "seq"]).collect()}
    check(rows, got)


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = logs(8, 12, 12)
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = run_lifecycle(stream, str(tmp_path / "state"), str(tmp_path / "log"), "listing_id", "at", "kind", ["at", "seq"])
    check(rows, {r["listing_id"]: r for r in state.collect()})


def write_files(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)


def run_stream(spark, folder, tmp_path, **options):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    state = run_lifecycle(stream, str(tmp_path / "state"), str(tmp_path / "log"), "listing_id", "at", "kind", ["at", "seq"], **options)
    return {r["listing_id"]: r for r in state.collect()}


def test_stream_goes_on_after_a_restart_and_takes_a_late_file(spark, tmp_path):
    """The second run gets newer rows and a file that is older than all others."""
    folder, rows = str(tmp_path / "in"), logs(9, 10, 12)
    late = [r for r in rows if r[2] in (3, 4)]
    rest = [r for r in rows if r[2] not in (3, 4)]
    half = len(rest) // 2
    write_files(spark, folder, [rest[:half]])
    check(rest[:half], run_stream(spark, folder, tmp_path))
    write_files(spark, folder, [rest[half:]])
    write_files(spark, folder, [late])
    got = run_stream(spark, folder, tmp_path)
    check(rest + late, got)
    changed = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "state")).groupBy("listing_id").count()
    assert max(r["count"] for r in changed.collect()) <= 3


def test_timers_end_the_day_of_doubtful_listings(spark, tmp_path):
    doubtful = [(1, hour(h), i, k) for i, (h, k) in enumerate([(0, "seen"), (1, "miss"), (2, "miss"), (3, "miss")])]
    revived = [(2, r[1], r[2], r[3]) for r in doubtful] + [(2, hour(20), 4, "seen")]
    missed_late = [(3, hour(0), 0, "seen"), (3, hour(10), 1, "miss"), (3, hour(20), 2, "miss"), (3, hour(29), 3, "miss")]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [doubtful + revived, missed_late])
    write_files(spark, folder, [[(4, hour(40), 0, "seen"), (4, hour(41), 1, "miss")]])
    got = run_stream(spark, folder, tmp_path, timers=True)
    assert {k: (r["availability"], r["inactive_at"]) for k, r in got.items()} == {1: ("inactive", hour(24)), 2: ("active", None), 3: ("inactive", hour(29)), 4: ("active", None)}


def test_summaries_of_chunks_of_any_size(spark):
    rows = logs(11, 30, 16)
    df = spark.createDataFrame(rows, LOG)
    for hours in (1, 7, 100_000):
        chunk = F.floor(F.unix_seconds("at") / (3600 * hours))
        got = {r["listing_id"]: r for r in H.lifecycle_state(df, "listing_id", "at", "kind", ["at", "seq"], chunk=chunk).collect()}
        check(rows, got)


def test_log_is_read_once(spark, tmp_path):
    spark.createDataFrame(logs(3), LOG).write.parquet(str(tmp_path / "log"))
    state = H.lifecycle_state(spark.read.parquet(str(tmp_path / "log")), "listing_id", "at", "kind", ["at", "seq"])
    state.collect()
    plan = state._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert plan.count("REPARTITION_BY_COL") == 2  # where it is made, and where its name is given again


def test_running_values_do_not_depend_on_chunks(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.choice([None, rng.randint(0, 9)])) for k in range(3) for p in range(50)]
    df = spark.createDataFrame(rows, "k int, p int, v int")
    values = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "prior": ("last", F.col("v"))}
    results = [
        sorted(tuple(r) for r in running(df, ["k"], block_of("p", size), ["p"], values, inclusive=False).select("k", "p", "total", "top", "prior").collect())
        for size in (7, 1000)
    ]
    assert results[0] == results[1]


def test_no_chunk_of_a_one_day_log_is_too_large(spark):
    """A switch with all its rows in one day: chunks of a stated size, and episodes as of one sort."""
    from lotwise.operators.ordered import measured_chunks
    from lotwise.operators.queues import circuit_breaker

    rng = random.Random(5)
    rows = [(hour(0) + datetime.timedelta(seconds=rng.randrange(3000)), i, rng.choice(["pause", "resume"])) for i in range(3000)]
    log = spark.createDataFrame(rows, "at timestamp, seq bigint, kind string")
    parts = measured_chunks(log.withColumn("k", F.lit(1)), ["k"], ["at", "seq"], 100).orderBy("at", "seq").collect()
    sizes = {}
    for r in parts:
        sizes[tuple(r["_part"])] = sizes.get(tuple(r["_part"]), 0) + 1
    assert max(sizes.values()) <= 100 and list(sizes) == sorted(sizes)
    episodes, before = [], None
    for at, _, kind in sorted(rows):
        if kind == "pause" and before != "pause":
            episodes.append([at, None])
        elif kind == "resume" and before == "pause":
            episodes[-1][1] = at
        before = kind
    got = [(r["paused_at"], r["resumed_at"]) for r in circuit_breaker(log, 100).orderBy("generation").collect()]
    assert got == [tuple(e) for e in episodes]


def test_lifecycle_by_measured_chunks(spark):
    from lotwise.operators.ordered import measured_chunks

    rows = logs(13, 12, 16)
    df = measured_chunks(spark.createDataFrame(rows, LOG), ["listing_id"], ["at", "seq"], 5)
    got = H.lifecycle_state(df, "listing_id", "at", "kind", ["at", "seq"], chunk=F.col("_part")).collect()
    check(rows, {r["listing_id"]: r for r in got})


def test_missed_listings_like_all_links_times_all_scans(spark):
    rng = random.Random(17)
    links = [(i, s, hour(rng.randrange(40))) for s in range(3) for i in range(12)]
    scans = [(s, hour(h), rng.random() < 0.7) for s in range(4) for h in range(0, 48, 4)]
    seen = [(i, s, at) for i, s, born in links for t, at, _ in scans if t == s and at >= born and rng.random() < 0.5]
    seen += [(99, 0, hour(8)), (0, 3, hour(8)), (1, 1, hour(9))]
    a = spark.createDataFrame(links, "listing_id bigint, search_id bigint, first_seen_at timestamp")
    b = spark.createDataFrame(seen + seen[:5], "listing_id bigint, search_id bigint, at timestamp")
    c = spark.createDataFrame(scans, "search_id bigint, at timestamp, complete_snapshot boolean")
    want = {(i, s, at) for i, s, born in links for t, at, whole in scans if t == s and whole and born < at and (i, s, at) not in seen}
    got = [tuple(r) for r in H.missed_listings(a, b, c).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    streaks = {}
    for i, s, born in links:
        streak = 0
        for t, at, whole in scans:
            if t == s and whole and born < at:
                streak = streak + 1 if (i, s, at) in want else 0
        streaks[i, s] = streak
    assert {(r["listing_id"], r["search_id"]): r["misses"] for r in H.misses_since_seen(a, b, c).collect()} == streaks
    assert H.missed_listings(a, b, c.limit(0)).count() == 0


def test_late_prices_change_nothing(spark):
    rows = [(1, hour(0), 0, 1000_00), (1, hour(5), 1, 900_00), (1, hour(2), 2, 500_00), (1, hour(6), 3, 900_00), (1, hour(7), 4, 895_00)]
    df = spark.createDataFrame(rows, "listing_id bigint, at timestamp, seq bigint, price bigint")
    out = H.price_changes(df, ["listing_id"], "at", "price", ["seq"], F.floor(F.col("seq") / 2)).orderBy("seq").collect()
    assert [(r["seq"], r["previous_price"], r["meaningful"]) for r in out] == [(0, None, False), (1, 1000_00, True), (4, 900_00, False)]


def test_a_file_that_arrives_late_cannot_undo_a_sighting(spark):
    """Two batches in the wrong order: the misses of the older one count for nothing, its sighting
    only widens the span."""
    newer = [(1, hour(100), 3, "seen"), (2, hour(100), 7, "seen")]
    older = [(1, hour(1), 0, "seen"), (1, hour(20), 1, "miss"), (1, hour(40), 2, "miss"), (2, hour(90), 4, "miss"), (2, hour(130), 8, "miss"), (2, hour(140), 9, "miss"), (2, hour(150), 10, "miss")]
    state = H.lifecycle_state(spark.createDataFrame(newer, LOG), "listing_id", "at", "kind", ["at", "seq"])
    after = H.lifecycle_state(spark.createDataFrame(older[3:], LOG), "listing_id", "at", "kind", ["at", "seq"], state)
    rows = {r["listing_id"]: r for r in after.collect()}
    assert (rows[2]["availability"], rows[2]["consecutive_misses"], rows[2]["possibly_unavailable_at"], rows[2]["inactive_at"]) == ("inactive", 3, hour(150), hour(150))
    assert (rows[1]["availability"], rows[1]["consecutive_misses"], rows[1]["last_seen_at"]) == ("active", 0, hour(100))


def test_queue_items_follow_their_log(spark):
    from lotwise.operators.queues import enrichment_queue

    steps = [
        (1, 0, "enqueue", 5, None), (1, 1, "claim", None, None), (1, 2, "enqueue", 6, None), (1, 3, "success", None, None),
        (2, 0, "enqueue", 5, None), (2, 1, "claim", None, None), (2, 2, "failure", None, "timeout"),
        (3, 0, "enqueue", 5, None), (3, 1, "claim", None, None), (3, 2, "failure", None, "invalid_response"), (3, 3, "enqueue", 5, None),
        (4, 0, "enqueue", 5, None), (4, 1, "exclude", None, None), (4, 2, "enqueue", 5, None), (4, 3, "include", None, None), (4, 4, "enqueue", 5, None),
        (5, 0, "claim", None, None),
    ]
    log = spark.createDataFrame([(k, hour(a), a, kind, v, f) for k, a, kind, v, f in steps], "listing_id bigint, at timestamp, seq bigint, kind string, version bigint, failure string")
    got = {r["listing_id"]: (r["state"], r["version"], r["attempts"], r["last_error_code"]) for r in enrichment_queue(log).collect()}
    assert got == {
        1: ("queued", 6, 1, None), 2: ("queued", 5, 1, "timeout"), 3: ("failed", 5, 1, "invalid_response"), 4: ("queued", 5, 0, None)
    }


def test_stream_state_is_folded_from_plain_rows():
    from pyspark.sql import Row

    from lotwise.streaming.lifecycle import Lifecycle

    class Held:
        reads, value = 0, None

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.value = value

    fold = Lifecycle("listing_id", ["o0"], False)
    fold.held = Held()
    rows = [Row(kind="sold", at=9, o0=None), Row(kind="miss", at=9, o0=2), Row(kind="seen", at=5, o0=1)]
    (out,) = fold.handleInputRows(("a",), iter(rows), None)
    assert out.asDict() == {
        "listing_id": "a", "first_seen_at": 5, "last_seen_at": 5, "consecutive_misses": 1, "possibly_unavailable_at": None,
        "inactive_at": None, "sold_at": 9, "changes": 1,
    }
    assert fold.held.reads == 1 and fold.held.value == (5, 5, 1, None, None, 9, 1)
