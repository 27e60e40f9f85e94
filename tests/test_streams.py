"""State that streams keep, against plain loops: poll ticks, compaction, the registry and presence; with batches that fail half-way."""

import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tideway.operators import grouped, mesh
from tideway.plans import streams
from tideway.streaming import jobs, presence, registry, rollup, telemetry, ticks

TYPES = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType()}


def struct(ddl):
    return StructType([StructField(n, TYPES[t]) for n, t in (x.split() for x in ddl.split(","))])


CONTENT = struct("id string, source_id string, status string, observed_at bigint, expires bigint, severity int, note string")
BATCH = struct("kind string, poll int, now bigint, source_id string, ok boolean, suppressed boolean, error string, id string, successor string, force boolean, status string, observed_at bigint, expires bigint, severity int, note string, seq bigint")
SOURCES = [("a", "resolve", 0, 60, None), ("b", "expire", 500, 60, 100), ("c", "expire", 0, 60, None)]


def row(kind, poll, now, **given):
    return tuple({"kind": kind, "poll": poll, "now": now, **given}.get(f.name) for f in BATCH.fields)


def polls(rng, n):
    """n polls as (poll, now, rows)."""
    out, seq = [], 0
    for p in range(n):
        now, rows = 1_000 + 300 * p, []
        for s, *_ in SOURCES:
            ok = rng.random() < 0.75
            rows.append(row("attempt", p, now, source_id=s, ok=ok, suppressed=rng.random() < 0.2, error=None if ok else "no answer"))
            for i in range(8):
                for _ in range(rng.choice([0, 1, 1, 1, 2]) if rng.random() < 0.6 else 0):
                    seq += 1
                    rows.append(row("event", p, now, source_id=s, id=f"{s}{i}", status=rng.choice(["ACTIVE", "ACTIVE", "SCHEDULED", "RESOLVED"]), observed_at=now - rng.randint(0, 9), expires=rng.choice([None, now + 200, now + 5_000]), severity=rng.choice([1, 1, 2]), note=rng.choice("xyz"), force=rng.choice([None, False, True]), seq=seq))
                if rng.random() < 0.15:
                    rows.append(row("superseded", p, now, id=f"{s}{i}", successor=f"{rng.choice('abc')}{rng.randint(0, 7)}"))
        out.append((p, now, rows))
    return out


def plain_ticks(listed, window):
    events, made = {}, []
    health = {s: dict(policy=p, grace=g, every=e, stale=st, attempt=None, success=None, error=None, status=None) for s, p, g, e, st in SOURCES}
    names = [f.name for f in BATCH.fields]
    for _, now, rows in listed:
        rows = [dict(zip(names, r, strict=True)) for r in rows]
        asked = {r["source_id"]: r for r in rows if r["kind"] == "attempt"}
        seen = {}
        for r in sorted((r for r in rows if r["kind"] == "event"), key=lambda r: (r["observed_at"], r["seq"])):
            seen[r["id"]] = r
        by = {}
        for r in rows:
            if r["kind"] == "superseded":
                by[r["id"]] = min(by.get(r["id"], r["successor"]), r["successor"])
        for i, r in seen.items():
            e = events.get(i)
            content = {c: r[c] for c in ("source_id", "status", "observed_at", "expires", "severity", "note")}
            if e is None or (e["severity"], e["status"]) != (r["severity"], r["status"]):
                events[i] = e = {"first": now, "revision": 0, **(e or {}), **content, "ingested": now, "seen": now, "by": None}
                e["revision"] += 1
                made.append((i, e["revision"], e["status"], e["observed_at"], e["severity"], e["note"], e["by"]))
            else:
                if r["force"]:
                    e.update(content)
                if asked[r["source_id"]]["ok"] and e["seen"] < now - window:
                    e["seen"] = now
        for i, e in events.items():
            a, h = asked[e["source_id"]], health[e["source_id"]]
            if not a["ok"] or a["suppressed"] or e["status"] not in ("ACTIVE", "SCHEDULED"):
                continue
            to = None
            if i in by:
                to = "RESOLVED"
            elif i not in seen and h["policy"] == "resolve":
                to = "RESOLVED"
            elif i not in seen and ((e["expires"] is not None and e["expires"] < now) or (h["grace"] > 0 and now - e["seen"] > h["grace"])):
                to = "EXPIRED"
            if to:
                e.update(status=to, observed_at=now, ingested=now, revision=e["revision"] + 1, by=by.get(i, e["by"]))
                made.append((i, e["revision"], to, now, e["severity"], e["note"], e["by"]))
        for s, a in asked.items():
            h = health[s]
            h["attempt"] = now
            if a["ok"]:
                h.update(success=now, error="", status="OK")
            else:
                stale = h["stale"] if h["stale"] is not None else 3 * h["every"]
                h.update(error="no answer", status="STALE" if h["success"] is not None and now - h["success"] <= stale else "UNAVAILABLE")
    return events, made, health


def ticked(spark, path, **kinds):
    sources = spark.createDataFrame(SOURCES, "source_id string, policy string, expire_after bigint, poll_seconds bigint, stale_after bigint")
    return ticks.ingest(spark, path, sources, CONTENT, ["severity", "status"], ["observed_at", "seq"], 400)[0]


def frame(spark, *listed):
    return spark.createDataFrame([r for _, _, rows in listed for r in rows], BATCH)


def agrees(t, listed):
    events, made, health = plain_ticks(listed, 400)
    got = {r.id: (r.revision, r.status, r.observed_at, r.expires, r.severity, r.note, r.first_ingested, r.ingested_at, r.last_seen, r.replaced_by) for r in t.current().collect()}
    assert got == {i: (e["revision"], e["status"], e["observed_at"], e["expires"], e["severity"], e["note"], e["first"], e["ingested"], e["seen"], e["by"]) for i, e in events.items()}
    assert sorted((r.id, r.revision, r.status, r.observed_at, r.severity, r.note, r.replaced_by) for r in t.revisions().collect()) == sorted(made)
    assert {r.source_id: (r.last_attempt, r.last_success, r.last_error, r.status) for r in t.health().collect()} == {s: (h["attempt"], h["success"], h["error"], h["status"]) for s, h in health.items()}
    return made


def test_ticks_equal_a_loop(spark, tmp_path, monkeypatch):
    """Some polls share a batch; changes are folded into a new base and old folders removed on the way."""
    monkeypatch.setattr(ticks, "FOLD_AFTER", 3)
    listed = polls(random.Random(2), 9)
    t = ticked(spark, f"file://{tmp_path}/t")
    for n, part in enumerate((listed[:1], listed[1:3], listed[3:4], listed[4:6], listed[6:7], listed[7:8], listed[8:])):
        t(frame(spark, *part), n)
    made = agrees(t, listed)
    assert {"EXPIRED", "RESOLVED"} <= {m[2] for m in made} and any(m[6] for m in made)
    folders = t.tables.newest().tables
    assert len(folders["events"]) <= 4 and len(folders["revisions"]) <= 5
    assert len(list((tmp_path / "t" / "health").iterdir())) <= 5


@pytest.mark.parametrize("breaks", ["revisions", "health", "_commit"])
def test_a_batch_that_fails_half_way_is_not_seen(spark, tmp_path, monkeypatch, breaks):
    listed = polls(random.Random(7), 4)
    t = ticked(spark, f"file://{tmp_path}/t")
    t(frame(spark, *listed[:2]), 0)
    before = t.tables.newest()

    def fail(*args):
        raise RuntimeError("lost")

    write, commit = t.tables.write, t.tables.commit
    if breaks == "_commit":
        t.tables.commit = fail
    else:
        t.tables.write = lambda rows, table, *by: fail() if table == breaks else write(rows, table, *by)
    with pytest.raises(RuntimeError, match="lost"):
        t(frame(spark, *listed[2:]), 1)
    assert t.tables.newest() == before
    again = ticked(spark, f"file://{tmp_path}/t")  # a new driver
    again(frame(spark, *listed[2:]), 1)
    again(frame(spark, *listed[2:]), 1)  # the stream may hand on a batch that was committed
    agrees(again, listed)
    named = {f.split("/")[1] for f in again.tables.newest().tables["events"]}
    assert named <= {p.name for p in (tmp_path / "t" / "events").iterdir()}


def test_one_writer(spark, tmp_path):
    t = ticked(spark, f"file://{tmp_path}/t")
    old = t.tables.newest()
    t(frame(spark, *polls(random.Random(1), 1)), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        t.tables.commit(old, {}, {})


RAW = "obs_id bigint, pubkey string, heard_at bigint, snr int, path_nodes array<string>"
DAY = 86_400


def receptions(rng, ids):
    return [(i, f"n{rng.randint(0, 3)}", rng.randint(0, 6) * DAY + rng.randint(0, DAY - 1), rng.randint(-9, 9), [rng.choice(["", "r1", "r2", "n1"]) for _ in range(rng.randint(0, 3))]) for i in ids]


def plain_links(rows):
    out = {}
    for _, key, at, snr, path in rows:
        for x, y in zip([key, *path], path, strict=False):
            if x and y and x != y:
                k = (min(x, y), max(x, y), at - at % DAY)
                n, best, first, last = out.get(k, (0, snr, at, at))
                out[k] = (n + 1, max(best, snr), min(first, at), max(last, at))
    return out


def kept_links(r):
    return {(x.a, x.b, x.day): (x.n, x.best_snr, x.first_at, x.last_at) for x in r.links().collect()}


@pytest.fixture
def mesh_rollup(spark, tmp_path):
    schema = spark.createDataFrame([], RAW).schema
    return lambda chunk, span=DAY: rollup.Rollup(spark, f"file://{tmp_path}/mesh", schema, mesh.edges, chunk, span)


def test_compaction_in_chunks_of_unequal_size(spark, mesh_rollup, monkeypatch):
    rng = random.Random(3)
    r, known = mesh_rollup(40, 3 * DAY), []
    assert r.compact() == 0
    for n, ids in enumerate((range(1, 100), range(100, 104), [500, 501, 900], range(901, 960))):
        rows = receptions(rng, ids)
        known += rows
        r.add(spark.createDataFrame(rows, RAW), n)
        r.add(spark.createDataFrame(rows, RAW), n)  # again after a failure: stored once
        assert r.tables.newest().marks.get("mark", -1) < max(ids)
        if n == 1:  # a chunk that dies before its commit leaves nothing
            with monkeypatch.context() as m:
                m.setattr(r.tables, "commit", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    r.step()
        assert r.compact() == [3, 1, 2, 2][n]
        assert kept_links(r) == plain_links(known) and r.tables.newest().marks["mark"] == max(ids)
        assert r.receptions().count() == len(known)
    assert r.compact() == 0


def test_a_chunk_reads_and_writes_no_other_day(spark, mesh_rollup, tmp_path):
    r = mesh_rollup(1_000)
    r.add(spark.createDataFrame([(1, "a", 10, 1, ["b"]), (2, "a", DAY + 10, 1, ["b"])], RAW), 0)
    r.compact()
    before = {rollup.span_of(f): f for f in r.tables.newest().tables["links"]}
    shutil.rmtree(tmp_path / "mesh" / before[0])  # reading the untouched day would fail
    r.add(spark.createDataFrame([(3, "b", DAY + 99, 5, ["a"])], RAW), 1)
    r.compact()
    after = {rollup.span_of(f): f for f in r.tables.newest().tables["links"]}
    assert after[0] == before[0] and after[DAY] != before[DAY]
    assert [tuple(x) for x in r.tables.folders([after[DAY]], r.schema).select("n", "best_snr", "first_at", "last_at").collect()] == [(2, 5, DAY + 10, DAY + 99)]


@pytest.mark.parametrize("days", [1, 2])
def test_pruning_waits_for_the_mark(spark, mesh_rollup, days):
    r = mesh_rollup(1_000, days * DAY)
    r.add(spark.createDataFrame([(1, "a", 10, 1, ["b"]), (2, "a", DAY + 5, 1, ["b"]), (3, "a", DAY + 50, 1, [])], RAW), 0)
    r.compact()
    r.add(spark.createDataFrame([(4, "a", 11, 1, ["b"])], RAW), 1)
    r.prune(DAY + 20, 0)
    assert sorted(x.obs_id for x in r.receptions().collect()) == [3, 4] and len(kept_links(r)) == 2
    r.compact()
    assert kept_links(r)["a", "b", 0][0] == 2
    r.prune(DAY + 20, DAY)
    assert [x.obs_id for x in r.receptions().collect()] == [3] and list(kept_links(r)) == [("a", "b", DAY)]
    r.prune(9 * DAY, 9 * DAY)
    assert r.receptions().count() == 0 and kept_links(r) == {}
    r.prune(9 * DAY, 9 * DAY)


ADVERTS = "node long, gateway string, at long, name string"


def plain_registry(batches, retention):
    """(node, at, name, gateways, adverts, average, gone) as told, batch by batch; a watermark without delay, and a last empty batch."""
    nodes, told, mark, newest = {}, [], 0, 0

    def tell(i, gone):
        e = nodes[i]
        told.append((i, e["at"], e["name"], sorted(g for g, t in e["heard"].items() if t >= e["at"] - retention), e["n"], e["mean"], gone))

    for rows in [*batches, []]:
        mark = max(mark, newest)
        fresh = {}
        for r in rows:
            if r[2] >= mark:  # older ones are dropped by the watermark
                fresh.setdefault(r[0], []).append(r)
        for i, of in fresh.items():
            for _, gate, t, name in sorted(of, key=lambda r: (r[2], r[1], r[3])):
                if i in nodes and t - nodes[i]["at"] > retention:
                    tell(i, True)
                    del nodes[i]
                e = nodes.setdefault(i, {"at": t, "name": name, "heard": {}, "n": 0, "mean": None, "old": None})
                if e["n"] and t - e["at"] >= 30:
                    e["mean"] = float(t - e["at"]) if e["mean"] is None else e["mean"] + 0.3 * (t - e["at"] - e["mean"])
                e["n"] += 1
                e["heard"][gate] = max(t, e["heard"].get(gate, t))
                if t >= e["at"]:
                    e["at"], e["name"] = t, name
            e["heard"] = {g: t for g, t in e["heard"].items() if t >= e["at"] - retention}
            tell(i, False)
        for i in [i for i, e in nodes.items() if e["at"] + retention + 1 <= mark]:
            tell(i, True)
            del nodes[i]
        newest = max([newest, *(r[2] for r in rows)])
    return told


def test_silent_nodes_leave_the_registry(spark, tmp_path):
    rng, batches, at = random.Random(11), [], 0
    for b in range(4):
        rows = [(rng.randint(1, 9) if b != 1 else rng.randint(1, 2), rng.choice("ghk"), at + rng.randint(0, 900), f"n{rng.randint(0, 99)}") for _ in range(25)]
        batches.append(rows)
        at += rng.choice([900, 2_500])
    told = []
    with registry.timed_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, ADVERTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema(ADVERTS).parquet(f"file://{tmp_path}/in")
            out = registry.registry(stream, 1_000, "0 seconds").writeStream.outputMode("update").foreachBatch(lambda d, n: told.extend(d.collect()))
            jobs.run_available(out, f"file://{tmp_path}/checkpoint")
    got = sorted(((r.node, r.at, r.name, sorted(r.gateways), r.adverts, r.ewma and round(r.ewma, 6), r.gone) for r in told), key=repr)
    want = sorted(((*r[:5], r[5] and round(r[5], 6), r[6]) for r in plain_registry(batches, 1_000)), key=repr)
    assert list(map(repr, got)) == list(map(repr, want))
    assert any(r[6] for r in want) and spark.conf.get("spark.sql.streaming.stateStore.providerClass", "as it was") == "as it was"


def plain_spans(adverts, mark):
    """(node, began, heard, ended, adverts) that ended before the mark, from adverts before it in the order of time."""
    out = []
    for node in {n for n, _ in adverts}:
        began = heard = counted = mean = None
        n = gaps = 0
        window = lambda: 3600.0 if not gaps else min(86_400.0, max(3600.0, 3 * mean))  # noqa: E731, B023
        for t in sorted(t for q, t in adverts if q == node and t < mark):
            if began is not None and t > heard + window():
                out.append((node, began, heard, round(heard + window(), 3), n))
                began, n = None, 0
            began = t if began is None else began
            heard, n = t, n + 1
            if counted is None:
                counted = t
            elif t - counted >= 30:
                mean, counted, gaps = (float(t - counted) if mean is None else 0.3 * (t - counted) + 0.7 * mean), t, gaps + 1
        later = [t for q, t in adverts if q == node and t >= mark]
        if began is not None and heard + window() < mark and not any(t <= heard + window() for t in later):
            out.append((node, began, heard, round(heard + window(), 3), n))
    return sorted(out)


def test_presence_spans_with_late_adverts(spark, tmp_path):
    """Each batch holds adverts up to the allowed lateness behind the newest; spans are those of all rows in order."""
    rng, batches, late = random.Random(21), [], 7_200
    for b in range(5):
        rows = [(f"n{rng.randint(0, 6)}", 20_000 * b + rng.randint(0, 26_000) + 3) for _ in range(40)] + [("slow", 20_000 * b + 11_111), ("chatty", 20_000 * b + 5), ("chatty", 20_000 * b + 5), ("chatty", 20_000 * b + 20)]
        batches.append(rows)
    batches.append([("end", 260_001)])
    newest, kept, mark = 0, [], 0
    for rows in batches:
        kept += [r for r in rows if r[1] >= mark]
        newest = max([newest, *(t for _, t in rows)])
        mark = newest - late
    told = []
    with registry.timed_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, "node string, at long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema("node string, at long").parquet(f"file://{tmp_path}/in")
            out = presence.spans(stream, f"{late} seconds").writeStream.outputMode("append").foreachBatch(lambda d, n: told.extend(d.collect()))
            jobs.run_available(out, f"file://{tmp_path}/checkpoint")
    got = sorted((r.node, r.began, r.heard, round(r.ended, 3), r.adverts) for r in told)
    assert got == plain_spans(kept, newest - late) and len(got) > 15
    assert len({round(e - h) for _, _, h, e, _ in got}) > 5


SAMPLES = "seq long, pubkey string, reporter string, reported_at long, last_success double, uptime long, sent long, recv long"


@pytest.mark.parametrize("cuts", [[60, 61, 150], [200]])
def test_telemetry_in_any_batches_equals_the_loop(spark, tmp_path, cuts):
    """Late samples stand where their time puts them; the batch path over all rows says the same."""
    rng = random.Random(31)
    rows = [(i, rng.choice(["a", "b", ""]), rng.choice(["x", "y"]), 10 * (i + rng.randint(-30, 30)), rng.choice([None, 1.0, 2.0, float(i)]), rng.randint(0, 2), rng.randint(0, 1), rng.randint(0, 1)) for i in range(1, 300)]
    want = sorted(map(tuple, grouped.telemetry_kept(spark.createDataFrame(rows, SAMPLES)).collect()))
    told, sizes = [], []
    with registry.timed_state(spark):
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            spark.createDataFrame(rows[a:b], SAMPLES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            out = telemetry.kept(spark.readStream.schema(SAMPLES).parquet(f"file://{tmp_path}/in"), 700).writeStream.outputMode("append").foreachBatch(lambda d, n: told.extend(d.collect()))
            query = out.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(map(tuple, told)) == want and 50 < len(want) < 200
    assert sizes[-1] < len(want)


@pytest.mark.parametrize("job", ["presence", "registry", "telemetry"])
def test_state_is_one_row_for_each_node(spark, tmp_path, job):
    """Adverts that wait, gateways heard and samples kept are read and written with their node, not one by one."""
    rows = [(i, f"n{i % 3}", f"g{i % 7}", 1_000 + i, None, 0, i % 5, 0) for i in range(60)]
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SAMPLES).parquet(f"file://{tmp_path}/in")
    adverts = stream.selectExpr("CAST(substring(pubkey, 2) AS BIGINT) AS node", "reporter AS gateway", "reported_at AS at", "pubkey AS name")
    made = {"presence": lambda: presence.spans(adverts, "600 seconds"), "registry": lambda: registry.registry(adverts, 5_000), "telemetry": lambda: telemetry.kept(stream, 700)}[job]
    with registry.timed_state(spark):
        writer = made().writeStream.outputMode("update" if job == "registry" else "append").foreachBatch(lambda d, n: d.count())
        query = writer.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


def test_receptions_are_joined_before_they_arrive(spark, tmp_path):
    """A file of receptions brings its relay paths: no batch reads all lines again, and the files hold every reception once, in order."""
    orders = [(i if i else None, i % 4, datetime(2024, 1, 1 + i % 9)) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, n, i + n, 0.05) for i in range(1, 40) for n in (1, 2)], "l_orderkey long, l_linenumber int, l_suppkey long, l_discount double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    seen = streams.Arriving(spark, f"file://{tmp_path}", "orders", "o_orderkey")
    batches = []
    assert "l_suppkey" not in seen.mesh_observations._jdf.queryExecution().logical().toString()
    jobs.run_available(seen.mesh_observations.writeStream.foreachBatch(lambda d, n: batches.append(sorted(map(tuple, d.collect())))), f"file://{tmp_path}/checkpoint")
    assert len(batches) == 3 and [r for b in batches for r in b] == sorted(map(tuple, streams.Views(spark, f"file://{tmp_path}").mesh_observations.collect()))


def test_registry_nodes_share_rows_of_state(spark, tmp_path):
    """Nodes of two batches, one null, late adverts and a new start, against a loop; a batch has a call for each part, not for each node."""
    first = [(i, "abc"[i % 3], 1_000 + i, f"n{i}") for i in range(1_500)] + [(None, "a", 5, "x"), (2**60 + 1, "a", 7, "y")]
    later = [(i, "abc"[i % 2], 1_000 + i + (i % 5 - 1) * 400, f"m{i}") for i in range(0, 1_500, 2)] + [(None, "b", 50, "z"), (2**60 + 1, "c", 70, "w"), (9_000, "a", 1, "new")]
    schema, known, want, told, sizes = "node long, gateway string, at long, name string", {}, [], [], []
    for n, batch in enumerate((first, later)):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.registry(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1_000).writeStream.outputMode("update").foreachBatch(lambda d, n: told.extend((n, *r) for r in d.collect()))
        query = stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        for node, gate, t, said in batch:
            last, name, mean, count, seen = known.get(node, (None, None, None, 0, {}))
            if last is not None and t - last > 1_000:
                last, mean, count, seen = None, None, 0, {}
            if last is not None and t - last >= 30:
                mean = float(t - last) if mean is None else mean + 0.3 * (t - last - mean)
            seen = seen | {gate: max(t, seen.get(gate, t))}
            last, name = (t, said) if last is None or t >= last else (last, name)
            known[node] = last, name, mean, count + 1, {g: s for g, s in seen.items() if s >= last - 1_000}
            want.append((n, node, last, name, sorted(known[node][4]), mean, count + 1))
    assert sorted(told, key=repr) == sorted(want, key=repr)
    assert 0 < max(sizes) <= jobs.PARTS + 1


def test_telemetry_nodes_share_rows_of_state(spark, tmp_path):
    """Many nodes over three batches, some of them silent in one: a batch has a call for each part, and the rows are those of the loop."""
    rng = random.Random(41)
    rows = [(i, f"n{rng.randint(0, 1_400) if i % 3 else i % 2}", rng.choice(["x", "y", "z"]), 10 * (i + rng.randint(-30, 30)), rng.choice([None, 1.0, 2.0, float(i)]), rng.randint(0, 2), rng.randint(0, 1), rng.randint(0, 1)) for i in range(31, 4_000)]
    want = sorted(map(repr, map(tuple, grouped.telemetry_kept(spark.createDataFrame(rows, SAMPLES)).collect())))
    told, sizes = [], []
    with registry.timed_state(spark):
        for k in range(3):
            spark.createDataFrame(rows[k * 1_323 : (k + 1) * 1_323], SAMPLES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            out = telemetry.kept(spark.readStream.schema(SAMPLES).parquet(f"file://{tmp_path}/in"), 100_000).writeStream.outputMode("append").foreachBatch(lambda d, n: told.extend(d.collect()))
            query = out.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(map(repr, map(tuple, told))) == want and len(want) > 2_000
    assert 500 < sizes[-1] <= 1_024
