"""A table maintained by a stream of files is the one that all changes give in order."""

import random

from tesselace.streaming.upkeep import current, maintain


def test_stream_of_changes(spark, tmp_path):
    rng = random.Random(1)
    schema = "landmark long, view long, value long, op string, at long"
    folder, truth, at = tmp_path / "in", {}, 0
    folder.mkdir()
    assert current(spark, f"file://{tmp_path}/table") is None
    for k in range(3):
        rows = []
        for _ in range(60):
            at += 1
            row = (rng.randint(0, 9), rng.randint(0, 4), rng.randint(0, 99), rng.choice(["add", "add", "remove"]), at)
            rows.append(row)
            if row[3] == "add":
                truth[row[:2]] = row[2]
            else:
                truth.pop(row[:2], None)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        stream = spark.readStream.schema(schema).parquet(f"file://{folder}")
        query = maintain(stream, f"file://{tmp_path}/table", ["landmark", "view"], f"file://{tmp_path}/checkpoint")
        query.processAllAvailable()
        query.stop()
        got = {(r.landmark, r.view): r.value for r in current(spark, f"file://{tmp_path}/table").collect()}
        assert got == truth
