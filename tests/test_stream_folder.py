import datetime

import pytest
from fieldloom.plans.queries import QUERIES


@pytest.mark.parametrize("files", [0, 3])
@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_daily_counts_stream_tables_of_one_file_or_many(spark, tmp_path, files, store, monkeypatch):
    from fieldloom import streaming

    rows = [(i, datetime.datetime(2024, 1, 1 + i % 4), "ab"[i % 2]) for i in range(100)]
    out = str(tmp_path / ("events.parquet" if files else "one"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").repartition(files or 1).write.parquet(out)
    if not files:
        next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "events.parquet")
    at = str(tmp_path)
    if store == "viewfs":
        spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.s{files}.link./in", f"file://{tmp_path}")
        at = f"viewfs://s{files}/in"
    streamed, plain = [], streaming.daily_counts
    monkeypatch.setattr(streaming, "daily_counts", lambda events, keys: streamed.append(events.isStreaming) or plain(events, keys))
    got = {(r.day, r.event_type): r.n for r in QUERIES["stream_daily_counts"](spark, at).collect()}
    assert got == {(f"2024-01-0{d + 1}", "ab"[d % 2]): 25 for d in range(4)} and streamed == [True]
