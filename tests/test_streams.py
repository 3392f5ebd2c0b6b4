"""Streams that are stopped and started again, against plain replays."""

import hashlib
import hmac
import json
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.plans import registry, streams
from tessella.sources.tables import table
from tessella.streaming import budget, intake, sweeps

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


class Killed(Exception):
    pass


@pytest.mark.parametrize("after_marks", [False, True])
def test_a_sweep_that_is_killed_goes_on_where_it_was(spark, tmp_path, after_marks):
    docs = streams._crawled(spark, SMALL)
    parts = list(range(4))
    for k in parts:
        docs.where(F.pmod("doc_id", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    outcomes = lambda rows, marked: sweeps.staleness(rows, marked, streams.NOW)
    read = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    marks = sweeps.Marks(f"{tmp_path}/marks").begin(spark)
    work = sweeps.sweep(marks, outcomes)

    def killed(rows, number):
        if number == 2:
            if after_marks:  # the marks are there, the counters are not
                outcomes(rows, marks.marked(spark, number)).where("outcome = 'flagged'").select("key").write.mode("overwrite").parquet(f"{marks.path}/changes/batch=2")
            raise Killed
        work(rows, number)

    with pytest.raises(Exception, match="Killed"):
        sweeps.run(read(), killed, f"{tmp_path}/state")
    assert marks.summary(spark).first().batches == 2
    sweeps.run(read(), work, f"{tmp_path}/state")
    whole = outcomes(docs, spark.createDataFrame([], "key long, batch long"))
    assert rows_of(marks.marked(spark).select("key")) == rows_of(whole.where("outcome = 'flagged'").select("key"))
    got, want = marks.summary(spark).first(), {r["outcome"]: r["count"] for r in whole.groupBy("outcome").count().collect()}
    assert got.batches == 4 and got.examined == docs.count() and all(got[c] == want.get(c, 0) for c in sweeps.COUNTERS[1:])
    # A batch that is run again changes nothing, and a second sweep finds all of them marked.
    work(spark.read.parquet(f"{tmp_path}/in").limit(0), 9)
    sweeps.run(read(), work, f"{tmp_path}/state")
    assert marks.summary(spark).first().examined == docs.count()
    again = sweeps.staleness(docs, marks.marked(spark), streams.NOW)
    assert again.where("outcome = 'flagged'").isEmpty()


def test_a_dry_run_marks_nothing_and_repeated_rows_are_flagged_once(spark, tmp_path):
    marks = sweeps.Marks(str(tmp_path)).begin(spark)
    old = streams.NOW - 400 * 86_400_000
    rows = spark.createDataFrame([(1, "active", False, old, "low"), (1, "active", False, old, "low"), (2, "failed", False, old, "low"), (3, None, None, None, None), (4, "indexed", None, old, None)], "doc_id long, status string, stale boolean, crawled long, tier string")
    for dry in (True, False):
        sweeps.sweep(marks, lambda r, m: sweeps.staleness(r, m, streams.NOW), dry)(rows, 0)
        assert tuple(marks.summary(spark).first()) == (5, 2, 1, 2, 1)
        assert sorted(r.key for r in marks.marked(spark).collect()) == ([] if dry else [1, 4])


def replay(rows, user_limit, admin_limit, token_limit, window):
    users, shards, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
        ok = True
        if r.counted:
            start, used = users.get(r.user_id, (None, 0))
            if start is None or start < r.at - window:
                users[r.user_id] = (r.at, 1)
            else:
                ok = used + 1 <= (admin_limit if r.admin else user_limit)
                users[r.user_id] = (start, used + ok)
        passed = ok and sum(n for start, n in shards.values() if start >= r.at - window) + r.tokens <= token_limit
        if passed:
            k = sum(map(ord, r.user_id)) % 10
            start, n = shards.get(k, (-(1 << 62), 0))
            shards[k] = (start, n + r.tokens) if start >= r.at - window else (r.at, r.tokens)
        out[r.event_id] = (ok, passed)
    return out


def test_the_budget_is_that_of_a_replay_and_idle_users_are_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.STORE)
    try:
        requests = streams._requests(spark, SMALL)
        for stream in streams.arrivals(requests, f"{tmp_path}/in", "at"):
            found = budget.budgeted(stream, 2, 5, 400, 10, 7_200_000)
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = {r.event_id: (r.user_ok, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        want = replay(requests.collect(), 2, 5, 400, 7_200_000)
        assert got == want and 0 < sum(a for _, a in want.values()) < sum(u for u, _ in want.values()) < len(want)
        left = [spark.read.format("statestore").option("path", f"{tmp_path}/state").option("operatorId", k).option("stateVarName", "window") for k in (0, 1)]
        held = max(_rows(x) for x in left)
        last = requests.agg(F.max("at").alias("at")).first().at
        recent = requests.where(F.col("at") > last - 10 * 7_200_000).select("user_id").distinct().count()
        assert held <= recent < requests.select("user_id").distinct().count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _rows(reader):
    try:
        return reader.load().count()
    except Exception:  # the operator of the other number has no such state
        return -1


def test_shards_are_sums_of_code_units(spark):
    users = ["", "a", "user-17", "zz9"]
    found = spark.createDataFrame([(u,) for u in users], "u string").select(budget.shard_of(F.col("u"))).collect()
    assert [r[0] for r in found] == [sum(map(ord, u)) % 10 for u in users]


def test_signatures(spark):
    for secret in ("s", "x" * 64, "y" * 65):
        for message in ("", "1700.{}", "é" * 500):
            got = spark.range(1).select(intake.hmac_sha256(secret, F.encode(F.lit(message), "UTF-8"))).first()[0]
            assert got == hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


def delivery(number, at, body, secret="one", stamp=None, signature=None, stated=None):
    body = body if isinstance(body, str) else json.dumps(body)
    stamp = str(at if stamp is None else stamp)
    proof = hmac.new(secret.encode(), f"{stamp}.{body}".encode(), hashlib.sha256).hexdigest() if signature is None else signature
    return (number, at, stamp, proof, stated, body)


SCHEMA = "delivery long, at long, signed_at string, signature string, stated_bytes long, body string"


def test_verdicts_and_payload_shapes(spark):
    at = 1_700_000_000_000
    rows = [
        delivery(1, at, {"task_id": "t", "url": "https://a.b/x", "markdown": "# A"}),
        delivery(2, at, {"job_id": "j", "results": [{"url": "u1", "markdown": {"raw_markdown": "raw", "fit_markdown": ""}}, {"html": "<p>", "metadata": {"title": "T"}, "headers": {"etag": "e", "last-modified": "m"}}], "url": "top"}),
        delivery(3, at, {"task_id": "t3", "data": {"results": [{"url": "d", "text": "plain"}]}, "results": [{"url": "no"}]}, secret="two"),
        delivery(4, at, {"task_id": "t4"}),
        delivery(5, at, {"task_id": ""}),
        delivery(6, at, "{not json"),
        delivery(7, at, {"task_id": "t7"}, secret="unknown"),
        delivery(8, at, {"task_id": "t8"}, stamp=at - 300_001),
        delivery(9, at, {"task_id": "t9"}, stamp="soon"),
        delivery(10, at, {"task_id": "t10"}, signature=""),
        delivery(11, at, {"task_id": "t11", "text": "x" * 3000}),
        delivery(12, at, {"task_id": "t12"}, stated=2001),
        delivery(13, at, [1, 2]),
        (14, at, str(at), None, None, None),
        delivery(15, at, {"task_id": "t15"}, stamp=at + 300_000),
    ]
    found = {r.delivery: r for r in intake.verdicts(spark.createDataFrame(rows, SCHEMA), ["one", "two"], 2000).collect()}
    reasons = {1: None, 2: None, 3: None, 4: None, 5: "no task", 6: "no JSON", 7: "forged", 8: "expired", 9: "expired", 10: "no signature", 11: "too large", 12: "too large", 14: "no signature", 15: None}
    assert {k: found[k].reason for k in reasons} == reasons and found[13].verdict == "malformed"
    assert [(p.url, p.content, p.title) for p in found[1].results] == [("https://a.b/x", "# A", "Untitled")]
    assert [(p.url, p.content, p.title, p.etag, p.last_modified) for p in found[2].results] == [("u1", "raw", "Untitled", None, None), ("top", "<p>", "T", "e", "m")]
    assert [(p.url, p.content) for p in found[3].results] == [("d", "plain")] and found[4].results == []
    kept = spark.createDataFrame([("t", [(u, None, c, "T", None, None) for u, c in (("https://a.b/x", "text"), ("https://x.a.b:8/", "text"), ("https://evila.b/", "text"), ("pdf://z", "text"), ("https://a.b/", " \n"), (None, "text"))])], "task string, results array<struct<url: string, media_type: string, content: string, title: string, etag: string, last_modified: string>>")
    assert [r.outcome for r in intake.pages(kept, ["a.b"]).collect()] == ["success", "success", "skip", "success", "skip", "skip"]


def test_deliveries_that_come_twice_leave_the_same_tables(spark, tmp_path):
    day, start = 86_400_000, 1_700_000_000_000
    times = [0, 1, 29, 30, 31, 59, 61, 95]
    rows = [delivery(k, start + d * day, {"task_id": f"t{k % 2}", "url": "https://a.b"}) for k, d in enumerate([t for t in times for _ in (0, 1)])] + [delivery(90, start, "{"), delivery(91, start, {"task_id": "z" * 500})]
    tables = intake.Intake(f"{tmp_path}/tables").begin(spark)
    work = tables.batch(["one"], 400)
    frame = spark.createDataFrame(rows, SCHEMA)

    def held():
        return {name: rows_of(tables.read(spark, name).select("delivery", "verdict", "reason", "task")) for name in intake.TABLES}

    for number, (a, b) in enumerate(((0, 5), (5, 11), (11, 100))):
        work(frame.where(F.col("delivery").between(a, b - 1)), number)
        if number == 1:
            work(frame.where(F.col("delivery").between(a, b - 1)), number)  # the batch again
    once = held()
    kept, want = {}, set()
    for k, at, *_ in rows[:-2]:
        if k % 2 not in kept or at >= kept[k % 2] + 30 * day:
            kept[k % 2] = at
            want.add(k)
    assert {r[0] for r in once["accepted"]} == want and len(once["repeated"]) == len(rows) - 2 - len(want)
    assert [r[0] for r in once["malformed"]] == [90] and [r[0] for r in once["oversized"]] == [91]
    work(frame, 7)
    assert held() == once


def test_a_batch_is_one_write_of_a_few_files_and_holds_each_check_once(spark, tmp_path):
    at, kept = 1_700_000_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    rows = [delivery(k, at + k, {"task_id": f"t{k % 50}", "url": "https://a.b", "text": "x" * (9 * k)}) for k in range(100)] + [delivery(200, at, "{")]
    tables = intake.Intake(f"{tmp_path}/tables").begin(spark)
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        ran = spark._jsparkSession.sharedState().statusStore().executionsCount
        before = ran()
        tables.batch(["one"], 700)(frame, 0)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        assert ran() - before == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    large = sum(len(r[-1]) > 700 for r in rows)
    assert {name: tables.read(spark, name).count() for name in intake.TABLES} == {"accepted": 50, "oversized": large, "malformed": 1, "repeated": 50 - large} and large > 9
    assert tables.read(spark).count() == len(rows)
    assert len(list((tmp_path / "tables" / "batch=0").rglob("*.parquet"))) <= 8
    plan = intake.verdicts(frame, ["one"], 700)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("no signature") == 1


def test_the_plan_of_repeats_does_not_grow_with_the_time_they_span(spark):
    day, start = 86_400_000, 1_700_000_000_000
    rows = spark.range(1200).select(F.concat(F.lit("t"), F.col("id") % 3).alias("task"), (start + F.col("id") * day).alias("at"), F.col("id").alias("delivery"))
    known = spark.createDataFrame([("t0", start - 28 * day)], "task string, at long")
    found = intake.repeats(rows, known)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    kept, want = {"t0": start - 28 * day}, []
    for k in range(1200):
        if (at := start + k * day) >= kept.get(f"t{k % 3}", 0) + 30 * day:
            kept[f"t{k % 3}"] = at
            want.append((f"t{k % 3}", at, k))
    assert rows_of(found) == sorted(want, key=str)


def test_webhook_pages_of_many_years_are_those_of_the_sql(spark, tmp_path):
    # Two and a half days between deliveries, so their rounds of thirty days would be many.
    pages = table(spark, "/root/testdata/sf0.01", "pages").withColumn("page_id", F.col("page_id") * 61)
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert pages.agg(F.max("page_id")).first()[0] > 15 * 720
    got = rows_of(registry.QUERIES["webhook_pages"](spark, str(tmp_path)))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(duck.execute(registry.ORACLE["webhook_pages"]).fetchall(), key=str)


def test_stream_queries_write_below_the_shared_folder(spark):
    assert uuid.UUID(streams.folder_of(spark, "x").rpartition("/")[2])
    assert table(spark, SMALL, "documents").count() == streams._swept(spark, SMALL).summary(spark).first().examined
