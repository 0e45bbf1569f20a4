"""Snapshots of an archive as a batch and as a stream that is stopped and started again."""

from datetime import datetime, timedelta

from kairosight.sources import archives


def put(folder, *days):
    for n in days:
        stamp = (datetime(2024, 1, 1) + timedelta(days=n)).strftime(archives.STAMP)
        (folder / stamp).write_text(f"body {stamp}")


def by_hand(folder, gap):
    kept = []
    for s in sorted(f.name for f in folder.iterdir()):
        if not kept or datetime.strptime(s, archives.STAMP) - datetime.strptime(kept[-1], archives.STAMP) >= timedelta(days=gap):
            kept.append(s)
    return kept


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(archives.ArchiveSnapshots)
    shelf = tmp_path / "shelf"
    shelf.mkdir()
    options = {"transport": "kairosight.sources.testing.shelf", "url": str(shelf), "target": "t", "days": "3"}

    def run():
        stream = spark.readStream.format("archive_snapshots").options(**options).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(spark.read.parquet(f"{tmp_path}/out").collect())

    put(shelf, 0, 1, 2, 3.5, 4, 5)
    first = run()
    assert [r.stamp for r in first] == by_hand(shelf, 3) and len(first) == 2
    put(shelf, 6, 6.5, 7, 9, 9.5, 10)  # 6 is nearer than three days to 3.5, which was kept in the run before
    second = run()
    assert [r.stamp for r in second] == by_hand(shelf, 3) and len(second) == 4
    assert all(r.body == f"body {r.stamp}" and r.target == "t" for r in second)
    assert run() == second  # nothing new
    asked = (tmp_path / "shelf.asked").read_text().split()
    assert sorted(asked) == [r.stamp for r in second]  # each once
    batch = spark.read.format("archive_snapshots").options(**options, to="20240106").load()
    assert sorted(r.stamp for r in batch.collect()) == [s for s in by_hand(shelf, 3) if s < "20240106"]


def test_an_empty_archive(spark, tmp_path):
    spark.dataSource.register(archives.ArchiveSnapshots)
    (tmp_path / "shelf").mkdir()
    options = {"transport": "kairosight.sources.testing.shelf", "url": str(tmp_path / "shelf")}
    assert spark.read.format("archive_snapshots").options(**options).load().count() == 0
    reader = archives._StreamReader(options)
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
