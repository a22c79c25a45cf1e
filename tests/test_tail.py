"""Tailed files: appended lines, a rotation, an emptied file and unfinished lines, each line once over a restart."""

import os
import random

from emberlog.sources import tail


def run(spark, path, out, state):
    q = spark.readStream.format("emberlog_tail").option("path", f"{path}/app.log*").option("partBytes", 40).load().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r.value for r in spark.read.schema("file string, offset long, value string").parquet(str(out)).collect())


def add(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_each_line_once(spark, tmp_path):
    tail.register(spark)
    log, out, state = tmp_path / "app.log", tmp_path / "out", tmp_path / "state"
    rnd = random.Random(3)
    lines = [f"line {i} {'x' * rnd.randint(0, 60)}" for i in range(40)]
    add(log, "".join(x + "\n" for x in lines[:10]) + lines[10][:4])
    assert run(spark, tmp_path, out, state) == sorted(lines[:10])  # the unfinished one waits
    add(log, lines[10][4:] + "\n" + lines[11] + "\n")
    os.rename(log, tmp_path / "app.log.1")
    add(log, "".join(x + "\n" for x in lines[12:20]))
    assert run(spark, tmp_path, out, state) == sorted(lines[:20])
    assert run(spark, tmp_path, out, state) == sorted(lines[:20])  # nothing new
    add(tmp_path / "app.log.1", lines[20] + "\r\n")
    with open(log, "w") as f:  # emptied in place
        f.write(lines[21] + "\n")
    assert run(spark, tmp_path, out, state) == sorted(lines[:22])
    got = spark.read.format("emberlog_tail").option("path", f"{tmp_path}/app.log*").option("partBytes", 7).load().collect()
    assert sorted(r.value for r in got) == sorted([*lines[:12], lines[20], lines[21]])


def test_no_files(spark, tmp_path):
    tail.register(spark)
    assert spark.read.format("emberlog_tail").option("path", f"{tmp_path}/none*").load().count() == 0
