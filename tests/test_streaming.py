"""Current tables by key, and the streams that keep them up."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ballotlake.operators.consensus import KEY, consensus
from ballotlake.sources.current import Current
from ballotlake.streaming import anchor, deltas, idempotent, late, recompute

from .test_audit import plain_root
from .test_collation import FORM, form


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def put(spark, path, rows):
    spark.createDataFrame(rows, "k long, v string, n long").coalesce(1).write.mode("append").parquet(path)


# tables


@pytest.fixture
def table(spark, tmp_path):
    return Current(spark, str(tmp_path / "table"), ["k"], 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, n long")


def test_upserts_replace_by_key_and_replays_change_nothing(spark, table):
    assert table.read() is None
    assert table.upsert(frame(spark, [(1, "a", 1), (2, "b", 1), (None, "c", 1)]), tag=("s", 0))
    assert table.upsert(frame(spark, [(2, "B", 2), (3, "d", 2)]), tag=("s", 1))
    after = rows_of(table.read(), "k", "v", "n")
    assert after == sorted([(1, "a", 1), (2, "B", 2), (3, "d", 2), (None, "c", 1)], key=str)
    for number in (0, 1):
        assert not table.upsert(frame(spark, [(1, "again", 9)]), tag=("s", number))
    assert rows_of(table.read(), "k", "v", "n") == after
    assert table.applied("s") == 1 and table.applied("other") == -1


def test_order_sticky_keep_and_add(spark, table):
    table.upsert(frame(spark, [(1, "new", 5), (1, "old", 3)]), F.col("n"))
    assert rows_of(table.read(), "k", "v", "n") == [(1, "new", 5)]
    table.upsert(frame(spark, [(1, "late", 4)]), F.col("n"))
    assert rows_of(table.read(), "k", "v", "n") == [(1, "new", 5)]
    table.upsert(frame(spark, [(1, None, 1)]), keep=["v"], sticky=["n"])
    assert rows_of(table.read(), "k", "v", "n") == [(1, "new", 5)]
    table.upsert(frame(spark, [(1, None, 1), (1, "x", 2)]), add=["n"])
    assert [r.n for r in table.read().collect()] == [8]


def test_null_is_a_value_that_replaces(spark, table):
    table.upsert(frame(spark, [(1, "a", 1)]))
    table.upsert(frame(spark, [(1, None, 2)]))
    assert rows_of(table.read(), "k", "v", "n") == [(1, None, 2)]


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(frame(spark, [(k, "a", 1) for k in range(40)]))
    before = table._manifest()["held"]
    table.upsert(frame(spark, [(7, "b", 2)]))
    after = table._manifest()["held"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1


def test_readers_see_the_table_before_or_after_but_never_a_part(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, "a", 1), (2, "a", 1)]))
    during = []
    real = table._folder.put

    def spied(name, text):
        during.append(rows_of(table.read(), "k", "v"))  # data are written, the manifest is not
        return real(name, text)

    reader = table.read()
    monkeypatch.setattr(table._folder, "put", spied)
    table.upsert(frame(spark, [(1, "b", 2), (2, "b", 2)]))
    assert during == [[(1, "a"), (2, "a")]] and rows_of(reader, "k", "v") == [(1, "a"), (2, "a")]
    assert rows_of(table.read(), "k", "v") == [(1, "b"), (2, "b")]
    table.vacuum(keep=1)
    assert rows_of(table.read(), "k", "v") == [(1, "b"), (2, "b")]


def test_the_slower_of_two_writers_starts_over(spark, table, monkeypatch):
    other = Current(spark, table.path, ["k"], 4)
    table.upsert(frame(spark, [(1, "a", 1)]))
    real, raced = table._folder.put, []

    def race(name, text):
        if not raced:
            raced.append(other.upsert(frame(spark, [(1, "a", 10)]), add=["n"]))
        return real(name, text)

    monkeypatch.setattr(table._folder, "put", race)
    table.upsert(frame(spark, [(1, "a", 100)]), add=["n"])
    assert rows_of(table.read(), "k", "n") == [(1, 111)]


def test_nothing_is_a_table_too(spark, table):
    assert table.upsert(frame(spark, []))
    assert table.read().count() == 0


# streams


def test_stream_keeps_results_of_the_whole_history(spark, tmp_path):
    inbox, history, results = (f"{tmp_path}/{n}" for n in ("in", "history", "results"))
    first = spark.createDataFrame([form(1, 1, "party_agent", {"A": 5}, "P"), form(2, 2, "official", {"A": 1})], FORM)
    second = spark.createDataFrame([form(3, 1, "observer", {"A": 5})], FORM)
    for rows in (first, second, second):
        rows.coalesce(1).write.mode("append").parquet(inbox)
        recompute.start(spark.readStream.schema(rows.schema).parquet(inbox), history, results, f"{tmp_path}/cp").awaitTermination()
    table = Current(spark, results, KEY)
    assert rows_of(table.read(), "pu", "status", "batch") == [(1, "consensus", 2), (2, "inec_published", 0)]
    forms = Current(spark, history, [*KEY, "id"]).read()
    assert forms.count() == 3 and {r.pu: r.status for r in consensus(forms).collect()} == {1: "consensus", 2: "inec_published"}


RESULT = "election string, pu long, seq long, status string, votes map<string,long>, state long, lga long, ward string"


def test_totals_follow_corrections_replays_and_moves(spark, tmp_path):
    inbox, totals = f"{tmp_path}/in", Current(spark, f"{tmp_path}/totals", deltas.TOTAL_KEY)
    old = [("e", 1, 1, "consensus", {"A": 5, "B": 1}, 1, 1, "w"), ("e", 2, 1, "consensus", {"A": 7}, 1, 2, "v"), ("e", 3, 1, "discrepancy", {"A": 99}, 1, 2, "v")]
    correction = [("e", 1, 2, "consensus", {"A": 2, "C": 4}, 1, 1, "w"), ("e", 3, 2, "single_source", {"A": 1}, 1, 2, "v")]
    gone = [("e", 2, 2, "discrepancy", {"A": 7}, 1, 2, "v"), ("e", 1, 3, "consensus", {"A": 3}, 2, 5, "z")]
    expected = [
        {(1, 1, "w", "A"): 5, (1, 1, "w", "B"): 1, (1, 2, "v", "A"): 7},
        {(1, 1, "w", "A"): 2, (1, 1, "w", "C"): 4, (1, 2, "v", "A"): 8},
        {(1, 1, "w", "A"): 2, (1, 1, "w", "C"): 4, (1, 2, "v", "A"): 8},
        {(1, 2, "v", "A"): 1, (2, 5, "z", "A"): 3},
    ]
    for rows, wards in zip((old, correction, old, gone), expected):  # the third batch is a replay of the first
        spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(inbox)
        deltas.start(spark.readStream.schema(RESULT).parquet(inbox), totals.path, f"{tmp_path}/cp").awaitTermination()
        now = {(r.state, r.lga, r.ward, r.party): r.n for r in totals.read().filter("units > 0").collect()}
        assert {k: v for k, v in now.items() if k[2] is not None} == wards
        for depth in range(3):  # every level is the sum of the wards
            sums = {}
            for key, n in wards.items():
                at = (*key[:depth], *[None] * (3 - depth), key[3])
                sums[at] = sums.get(at, 0) + n
            assert {k: v for k, v in now.items() if sum(x is not None for x in k[:3]) == depth} == sums


def test_a_batch_that_runs_again_is_left_out(spark, tmp_path):
    totals = Current(spark, f"{tmp_path}/totals", deltas.TOTAL_KEY)
    row = spark.createDataFrame([("e", 1, 1, "w", "A", 5, 1)], "election string, state long, lga long, ward string, party string, n long, units long")
    for _ in range(2):
        totals.upsert(row, add=("n", "units"), tag=("totals", 0))
    assert rows_of(totals.read(), "n") == [(5,)]


LATE = FORM + ", captured_at long, uploaded_at long"


def late_form(i, pu, kind, votes, captured, uploaded):
    return (*form(i, pu, kind, votes, f"P{i}"), captured, uploaded)


def test_late_forms_give_the_same_table_in_any_order_and_clear_no_flag(spark, tmp_path):
    declared = spark.createDataFrame([("e", 1, {"A": 5}), ("e", 2, {"A": 9})], "election string, pu long, votes map<string,long>")
    forms = [late_form(1, 1, "party_agent", {"A": 6}, 10, 12), late_form(2, 1, "observer", {"A": 5}, 11, 99), late_form(3, 1, "party_agent", {"A": 5}, 5, 200), late_form(4, 2, "observer", {"A": 9}, 1, 1)]
    times = [F.col(c).cast("timestamp").alias(c) for c in ("captured_at", "uploaded_at")]
    tables = set()
    for k, order in enumerate(permutations(range(4))):
        if k % 5:
            continue
        out, history = Current(spark, f"{tmp_path}/{k}/t", KEY), Current(spark, f"{tmp_path}/{k}/h", [*KEY, "id"])
        flags = []
        for number, i in enumerate(order):
            batch = spark.createDataFrame([forms[i]], LATE)
            batch = batch.select(*[c for c in batch.columns if c not in ("submitted_at", "captured_at", "uploaded_at")], *times)
            found = late.compare(recompute.touched_history(batch, history, number, "late"), declared)
            out.upsert(found, sticky=late.STICKY, tag=("late", number))
            flags.append({r.pu for r in out.read().collect() if r.flagged})
        assert all(a <= b for a, b in zip(flags, flags[1:]))
        tables.add(str(rows_of(out.read(), "pu", "status", "comparison", "flagged", "deepest", "votes")))
    assert len(tables) == 1
    assert rows_of(out.read(), "pu", "status", "comparison", "flagged", "deepest") == [(1, "discrepancy", "insufficient", True, 1), (2, "single_source", "clean", False, 0)]


def test_a_late_form_changes_the_result_and_is_noted(spark, tmp_path):
    declared = spark.createDataFrame([("e", 1, {"A": 5})], "election string, pu long, votes map<string,long>")
    schema = LATE.replace("captured_at long, uploaded_at long", "captured_at timestamp, uploaded_at timestamp").replace("submitted_at long, ", "")
    inbox, log, table = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/table"
    times = [F.col(c).cast("timestamp").alias(c) for c in ("captured_at", "uploaded_at")]
    for rows in ([late_form(1, 1, "party_agent", {"A": 5}, 50_000, 50_000)], [late_form(2, 1, "observer", {"A": 4}, 51_780, 81_720)]):
        df = spark.createDataFrame(rows, LATE)
        df.select(*[c for c in df.columns if c not in ("submitted_at", "captured_at", "uploaded_at")], *times).coalesce(1).write.mode("append").parquet(inbox)
        late.start(spark.readStream.schema(schema).parquet(inbox), declared, f"{tmp_path}/history", table, log, f"{tmp_path}/cp").awaitTermination()
    assert rows_of(Current(spark, table, KEY).read(), "status", "comparison", "flagged", "deepest") == [("discrepancy", "insufficient", True, 1)]
    notes = spark.read.parquet(log).orderBy("batch").collect()
    assert [(r.was, r.now) for r in notes] == [(None, "clean"), ("clean", "insufficient")]
    assert notes[1].note == "Comparison updated: new form received for unit 1 (captured 1970-01-01 14:23, uploaded 1970-01-01 22:42)"


def test_tokens_count_once_within_the_delay(spark, tmp_path):
    schema = "id long, client_submission_uuid string, uploaded_at timestamp"
    hour = lambda h: f"2024-01-01 {h:02d}:00:00"
    batches = [
        [(1, "a", hour(1)), (2, "a", hour(1)), (3, None, hour(1)), (4, None, hour(1))],
        [(5, "a", hour(2)), (6, "b", hour(3))],  # within two hours of the first
        [(7, "c", hour(12))],  # time moves on
        [(8, "d", hour(13))],
        [(9, "a", hour(14)), (10, "d", hour(14))],  # long after
    ]
    for rows in batches:
        df = spark.createDataFrame([(i, t, at) for i, t, at in rows], "id long, client_submission_uuid string, at string").select("id", "client_submission_uuid", F.col("at").cast("timestamp").alias("uploaded_at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = idempotent.once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    kept = {r.id for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()}
    assert kept - {2} - {1} == {3, 4, 6, 7, 8, 9} and len(kept & {1, 2}) == 1


def test_anchors_go_on_from_the_last_one(spark, tmp_path):
    path, table = f"{tmp_path}/log", f"{tmp_path}/anchors"
    hashes = [f"{k:064x}" for k in range(1, 12)]
    put_log = lambda a, b: spark.createDataFrame([(k, hashes[k - 1]) for k in range(a, b)], "seq long, log_hash string").coalesce(1).write.mode("append").parquet(path)
    run = lambda least=1: anchor.start(spark.readStream.schema("seq long, log_hash string").parquet(path), path, table, f"{tmp_path}/cp", least, availableNow=True).awaitTermination()
    anchors = anchor.anchors(spark, table)
    put_log(1, 4)
    run()
    put_log(4, 6)
    run(5)  # two wait, five are asked for
    put_log(6, 12)
    run(5)
    run()
    assert rows_of(anchors.read(), "start_seq", "end_seq", "leaf_count", "merkle_root", "status") == [
        (1, 3, 3, plain_root(hashes[:3]), "pending"), (4, 11, 8, plain_root(hashes[3:]), "pending")
    ]
    anchor.confirm(anchors, spark.createDataFrame([(1,), (99,)], "start_seq long"))
    assert rows_of(anchors.read(), "start_seq", "status") == [(1, "confirmed"), (4, "pending")]
    assert not anchor.pick_up(spark.read.parquet(path), anchors)
