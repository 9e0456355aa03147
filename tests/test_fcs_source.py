"""FCS files through ``format("fcs")``: ranges, rejects, filters, the sink's commit, streams over several batches."""

import os
import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise import queries
from gatewise.model import Panel
from gatewise.sources import fcs
from gatewise.sources.fcs_source import FcsReader, FcsStreamReader, FcsWriter, Written, list_files, read_events, read_files, register, save_events, stream_events
from gatewise.sources.shared import LOCAL, LOGS, local_logs
from gatewise.streaming.ingest import store


def tube(n, seed=0, names=("FSC-A", "PE-A"), **more):
    return fcs.to_bytes(np.random.default_rng(seed).normal(0, 100, (n, len(names))), list(names), keywords={"$CYT": "x"}, **more)


def values(raw):
    h = fcs.read_header(raw)
    return fcs.decode(h, raw[h.data_start :])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.fcs").write_bytes(tube(1000, 1))
    (tmp_path / "in" / "deep" / "b.FCS").write_bytes(tube(7, 2, ("Time", "pe-a", "FSC-A")))
    (tmp_path / "in" / "bad.fcs").write_bytes(tube(50, 3)[:-9])
    (tmp_path / "in" / "odd.fcs").write_bytes(b"no file of this kind")
    (tmp_path / "in" / "_temporary-1").mkdir()
    (tmp_path / "in" / "_temporary-1" / "half.fcs").write_bytes(tube(5))
    (tmp_path / "in" / "notes.txt").write_text("x")
    return str(tmp_path / "in")


def test_events_and_rejects(spark, folder):
    whole = {"a": values(open(f"{folder}/a.fcs", "rb").read()), "b": values(open(f"{folder}/deep/b.FCS", "rb").read())[:, [2, 1]]}
    for size in ("100", "1000000"):
        rows = read_events(spark, folder, ["fsc-a", "PE-A", "APC-A"], rangeBytes=size).collect()
        for name, want in whole.items():
            got = sorted((r for r in rows if r["sample_id"] == name and r["error"] is None), key=lambda r: r["event_idx"])
            assert [r["event_idx"] for r in got] == list(range(len(want))) and np.array_equal([(r["c0"], r["c1"]) for r in got], want)
            assert {r["c2"] for r in got} == {None}
        lost = {r["sample_id"]: r["error"] for r in rows if r["error"] is not None}
        assert set(lost) == {"bad", "odd"} and "DATA" in lost["bad"] and sum(r["error"] is not None for r in rows) == 2
    assert read_events(spark, f"file:{folder}/a.fcs").columns == ["path", "sample_id", "event_idx", "c0", "c1", "error"]
    assert read_events(spark, f"{folder}/a*.fcs").count() == 1000
    assert read_events(spark, folder, mode="DROPMALFORMED").where("error IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="bad.fcs"):
        read_events(spark, folder, mode="FAILFAST").where("sample_id = 'bad'").collect()
    with pytest.raises(Exception, match="nowhere"):
        read_events(spark, f"{folder}/nowhere", ["a"]).collect()


def test_filters_choose_files(spark, folder):
    got = read_events(spark, folder, ["FSC-A"], mode="FAILFAST").where("sample_id IN ('a', 'b') AND c0 > 0")  # bad files would fail
    assert {r[0] for r in got.select("sample_id").distinct().collect()} == {"a", "b"}
    assert read_events(spark, folder, ["FSC-A"], mode="FAILFAST").where(F.col("path").startswith(f"{folder}/deep")).count() == 7
    reader = FcsReader({"path": folder}, ["FSC-A"])
    assert len([s for p in reader.partitions() for s in p.slices]) == 4 and not list(reader.pushFilters([]))


def test_files_view(spark, folder):
    rows = {r["sample_id"]: r for r in read_files(spark, folder).collect()}
    assert set(rows) == {"a", "b", "bad", "odd"} and rows["a"]["n_events"] == 1000 and rows["b"]["channels"][1]["name"] == "pe-a"
    assert rows["a"]["keywords"]["$CYT"] == "x" and rows["bad"]["error"] and rows["bad"]["n_events"] is None


def test_sink_refuses_and_commits(spark, tmp_path):
    ev = spark.createDataFrame([(s, i, float(i), float(-i)) for s in ("s1", "s2") for i in range(300, 0, -1)], "sample_id string, event_idx long, c0 double, c1 double").repartition(5)
    panel, out = Panel(("a", "b")), str(tmp_path / "out")
    assert sorted(tuple(r)[:2] for r in save_events(ev, panel, out).collect()) == [("s1", 300), ("s2", 300)]
    assert sorted(os.listdir(out)) == ["s1.fcs", "s2.fcs"]
    back = read_events(spark, out).where("sample_id = 's2'").orderBy("event_idx").collect()
    assert [r["c0"] for r in back] == list(range(1, 301))
    before = open(f"{out}/s1.fcs", "rb").read()
    with pytest.raises(Exception, match="there already"):
        save_events(ev.where("event_idx < 5"), panel, out)
    with pytest.raises(Exception, match="events come from"):
        save_events(read_events(spark, out).where("event_idx < 5"), panel, out, overwrite=True, inputs=[out])
    boom = F.when(F.col("event_idx") == 77, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("c0"))
    with pytest.raises(Exception, match="boom"):
        save_events(ev.withColumn("c0", boom), panel, out, suffix="_new")
    assert sorted(os.listdir(out)) == ["s1.fcs", "s2.fcs"] and open(f"{out}/s1.fcs", "rb").read() == before
    save_events(ev.where("event_idx < 5"), panel, out, overwrite=True)
    assert read_files(spark, out).agg(F.sum("n_events")).first()[0] == 8
    register(spark)
    with pytest.raises(Exception, match="several tasks"):
        ev.repartition(3).write.format("fcs").mode("append").save(str(tmp_path / "dealt"))
    assert os.listdir(tmp_path / "dealt") == []


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    schema = __import__("pyspark").sql.types.StructType.fromDDL("sample_id string, event_idx long, c0 double")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"sample_id": ["s", "s"], "event_idx": [0, 1], "c0": [1.0, 2.0]})
    writer = FcsWriter({"path": str(tmp_path)}, schema, False)

    def dies():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    slow, counted = writer.write(iter([batch])), writer.write(iter([batch]))  # speculative copies of one task
    assert isinstance(slow, Written) and not [f for f in os.listdir(tmp_path) if f.endswith(".fcs")]
    writer.commit([counted, None])
    assert os.listdir(tmp_path) == ["s.fcs"] and len(values((tmp_path / "s.fcs").read_bytes())) == 2
    other = FcsWriter({"path": str(tmp_path)}, schema, True)
    other.abort([other.write(iter([batch]))])
    assert os.listdir(tmp_path) == ["s.fcs"]


def arrive(folder, name, raw):
    """Moved in whole, as files are to come."""
    with open(f"{folder}/_{name}", "wb") as f:
        f.write(raw)
    os.rename(f"{folder}/_{name}", f"{folder}/{name}")


def test_stream_by_ranges(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(inbox)
    arrive(inbox, "z.fcs", tube(950, 1))
    arrive(inbox, "a.fcs", tube(30, 2))
    arrive(inbox, "m.fcs", b"damaged")
    seen = []

    def keep(df, batch):
        df.write.mode("append").parquet(out)
        seen.append(batch)

    def run():
        ev = stream_events(spark, inbox, ["FSC-A", "PE-A"], eventsPerBatch="400", eventsPerTask="150", progress=str(tmp_path / "progress"))
        q = ev.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert len(seen) == 3
    assert spark.read.parquet(out).groupBy("sample_id").agg(F.count("event_idx"), F.countDistinct("event_idx"), F.count("error")).orderBy("sample_id").collect() == [("a", 30, 30, 0), ("m", 0, 0, 1), ("z", 950, 950, 0)]
    run()  # nothing new
    arrive(inbox, "b.fcs", tube(500, 4))
    run()
    got = spark.read.parquet(out).groupBy("sample_id").agg(F.count("event_idx"), F.countDistinct("event_idx")).orderBy("sample_id").collect()
    assert got == [("a", 30, 30), ("b", 500, 500), ("m", 0, 0), ("z", 950, 950)] and len(seen) == 5
    first = spark.read.parquet(out).where("sample_id = 'z'").orderBy("event_idx").select("c0", "c1").collect()
    assert np.array_equal(first, values(open(f"{inbox}/z.fcs", "rb").read()))
    ev = stream_events(spark, inbox, ["FSC-A"])  # no bound: all there is at once
    name = f"t{uuid.uuid4().hex}"
    q = ev.writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table(name).where("error IS NULL").count() == 1480
    shutil.rmtree(inbox)
    assert list_files(str(tmp_path)) == []


def test_streams_share_files(spark, tmp_path):
    """Each event and each damaged file comes to one of the queries, whose batches keep the bound; files that come later are shared too."""
    inbox, parts = str(tmp_path / "in"), 3
    os.mkdir(inbox)
    arrive(inbox, "z.fcs", tube(1000, 1))
    arrive(inbox, "a.fcs", tube(2, 2))
    arrive(inbox, "m.fcs", b"damaged")

    def run():
        with local_logs(spark, str(tmp_path)):
            streams = [stream_events(spark, inbox, ["FSC-A"], eventsPerBatch="150", progress=f"{tmp_path}/{k}/progress", part=str(k), parts=str(parts)) for k in range(parts)]
            started = [s.writeStream.format("parquet").option("path", f"{tmp_path}/{k}/out").option("checkpointLocation", f"{tmp_path}/{k}/check").start() for k, s in enumerate(streams)]
        for q in started:
            q.processAllAvailable()
            q.stop()
        return [p.numInputRows for q in started for p in q.recentProgress if p.numInputRows]

    def told():
        got = [spark.read.parquet(f"{tmp_path}/{k}/out") for k in range(parts)]
        rows = got[0].unionByName(got[1]).unionByName(got[2]).groupBy("sample_id").agg(F.count("event_idx"), F.countDistinct("event_idx"), F.max("event_idx"), F.count("error"))
        return [tuple(r) for r in rows.orderBy("sample_id").collect()], [g.where("sample_id = 'z'").count() for g in got]

    assert max(run()) <= 150 and told() == ([("a", 2, 2, 1, 0), ("m", 0, 0, None, 1), ("z", 1000, 1000, 999, 0)], [333, 333, 334])
    arrive(inbox, "zz.fcs", tube(400, 3))
    assert max(run()) <= 150 and told()[0][-1] == ("zz", 400, 400, 399, 0) and told()[1] == [333, 333, 334]
    with pytest.raises(ValueError, match="part"):
        FcsStreamReader({"path": inbox, "part": "3", "parts": "3"}, [])


def test_stream_query_keeps_its_bound_in_several_queries(spark, monkeypatch):
    """The bound makes a batch one task, so one query would use one core whatever the cluster has."""
    seen, stream = [], queries.stream_events
    monkeypatch.setattr(queries, "stream_events", lambda *a, **options: seen.append(options) or stream(*a, **options))
    assert sum(r["n"] for r in queries.s_fcs_stream(spark, "/root/testdata/sf0.001").collect()) == 6000
    assert {o["eventsPerBatch"] for o in seen} == {"5000"} and len({(o["part"], o["parts"], o["progress"]) for o in seen}) == len(seen) > 1
    assert spark.conf.get(LOGS, None) is None


def test_stored_batches_come_in_once(spark, tmp_path):
    """A file for each batch and partition; a batch that runs again, here since its commit is lost, leaves the files as they are."""
    inbox, out, check = str(tmp_path / "in"), tmp_path / "out", tmp_path / "check"
    os.mkdir(inbox)
    arrive(inbox, "z.fcs", tube(950, 1))
    arrive(inbox, "a.fcs", tube(30, 2))
    arrive(inbox, "m.fcs", b"damaged")

    def run():
        with local_logs(spark, str(check)):
            q = store(stream_events(spark, inbox, ["FSC-A", "PE-A"], eventsPerBatch="400", eventsPerTask="150", progress=f"{tmp_path}/progress"), str(out), str(check))
        q.processAllAvailable()
        q.stop()
        return [p.numInputRows for p in q.recentProgress if p.numInputRows]

    def told():
        rows = spark.read.parquet(str(out)).groupBy("sample_id").agg(F.count("event_idx"), F.countDistinct("event_idx"), F.count("error"))
        return sorted(tuple(r) for r in rows.collect()), sorted(os.listdir(out))

    assert run() == [400, 400, 181]
    rows, files = told()
    assert rows == [("a", 30, 30, 0), ("m", 0, 0, 1), ("z", 950, 950, 0)] and files[:3] == ["000000000-00000.parquet", "000000000-00001.parquet", "000000000-00002.parquet"]
    assert not [f for _, _, names in os.walk(check) for f in names if f.endswith(".crc")]
    os.remove(check / "commits" / "2")
    os.remove(out / files[-1])
    assert run() == [181] and told() == (rows, files)
    got = spark.read.parquet(str(out)).where("sample_id = 'z'").orderBy("event_idx").select("c0", "c1").collect()
    assert np.array_equal(got, values(open(f"{inbox}/z.fcs", "rb").read()))
    with pytest.raises(Exception, match="NoneType"):  # no batch, so no name
        read_events(spark, inbox).mapInArrow(__import__("gatewise.streaming.ingest", fromlist=["x"])._parquet(str(out)), "n long").collect()


def test_a_batch_does_not_pay_for_those_before(spark, tmp_path, monkeypatch):
    """No log of a sink that each batch lists; files of at most a batch; settings of the session as before."""
    monkeypatch.setattr(queries, "shared_folder", lambda _, name: f"file:{tmp_path}/{name}")
    assert sum(r["n"] for r in queries.s_fcs_stream(spark, "/root/testdata/sf0.001").collect()) == 6000
    made = [f"{place}/{f}" for place, _, names in os.walk(tmp_path / "stream") for f in names]
    assert not [f for f in made if "_spark_metadata" in f or f.endswith(".crc")]
    assert len([f for f in made if f.endswith(".parquet")]) == 6 * queries.STREAMS and {spark.conf.get(n, None) for n in LOCAL} == {None}


def test_workers_do_not_search_modules_for_garbage(spark, folder):
    """Spark's workers look through all objects after each task, those of modules too unless they are set aside."""

    def read(batches):
        import gc

        import pyarrow as pa

        from gatewise.sources.fcs_source import Slice, _Events

        n = sum(len(b) for _ in batches for b in _Events(["FSC-A"], "PERMISSIVE").read([Slice(f"{folder}/a.fcs")]))
        yield pa.RecordBatch.from_pydict({"n": [n], "aside": [gc.get_freeze_count()]})

    (row,) = spark.range(0, 1, 1, 1).mapInArrow(read, "n long, aside long").collect()
    assert row["n"] == 1000 and row["aside"] > 10_000
