from rosterflow.operators.contacts import latest_results
from rosterflow.registry.fixtures import frame
from rosterflow.streaming import contacts


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_against_batch(spark, sf, tmp_path):
    events = frame(spark, sf, "contacts")
    events.repartition(3).write.parquet(f"{tmp_path}/log")
    out = drain(contacts.latest_states(contacts.read(spark, f"{tmp_path}/log", 1)), "latest_states", "update")
    newest = {}
    for r in out.collect():
        newest[r.turf_id, r.person_id] = max(newest.get((r.turf_id, r.person_id), (-1, None)), (r.sequence, r.outcome), key=lambda x: x[0])
    want = {(r.turf_id, r.person_id): (r.sequence, r.outcome) for r in latest_results(events).collect()}
    assert newest == want


def test_duplicates_in_a_stream(spark, sf, tmp_path):
    events = frame(spark, sf, "contacts").limit(200)
    events.unionAll(events).write.parquet(f"{tmp_path}/log")
    out = drain(contacts.deduplicated(contacts.read(spark, f"{tmp_path}/log"), "10000 days"), "deduplicated", "append")
    # events without an id of their own are told apart by their sequence
    assert out.count() == 200


def test_appending_batches_twice(spark, sf, tmp_path):
    events = frame(spark, sf, "contacts").where("client_event_id is not null").limit(50)
    path = f"{tmp_path}/log"
    contacts.append_new(events, path)
    contacts.append_new(events, path)
    assert spark.read.parquet(path).count() == events.select("client_event_id").distinct().count()


def test_scan_windows(spark, sf, tmp_path):
    frame(spark, sf, "contacts").write.parquet(f"{tmp_path}/log")
    out = drain(contacts.scans(contacts.read(spark, f"{tmp_path}/log")), "scans", "update")
    assert out.count() > 0
