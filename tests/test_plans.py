import pytest
from pyspark.sql import functions as F

from strataline.operators import grids, solve
from strataline.plans import recipes
from strataline.plans.store import StoreError, SurveyStore
from strataline.sources import text
from strataline.streaming import runs


def survey(spark):
    return spark.createDataFrame([(0, "001", 100.0, 5.0), (1, "002", 110.0, 6.0), (2, "001", None, 7.0)], "row_id long, line string, mag double, base double")


def test_store(spark, tmp_path):
    s = SurveyStore(spark, f"file://{tmp_path}/store")
    d = s.import_table("first", survey(spark), units={"mag": "nT"})
    assert [r["mag"] for r in s.scan(d, ["mag"], {"line": ["002"]}).collect()] == [110.0]
    version, invalid = s.derive(d, "res", "c('mag') - c('base')", "nT")
    assert [r["res"] for r in s.scan(d, ["res"]).orderBy("row_id").collect()] == [95, 104, None] and invalid == 1
    second, _ = s.derive(d, "res", "c('mag') - c('base') * 2")
    assert {r["name"]: r["number"] for r in s.channels(d).collect()} == {"base": 1, "line": 1, "mag": 1, "res": 2}
    third, _ = s.derive(d, "twice", "c('res') * 2")
    assert [r["depth"] for r in s.lineage(third).collect()] == [0, 1, 2, 2]
    with pytest.raises(StoreError):
        s.publish(d, "late", s.scan(d, ["res"]), inputs={"res": version})
    with pytest.raises(StoreError):
        s.derive(d, "mag", "c('base')")
    with pytest.raises(StoreError):
        s.publish(d, "short", s.scan(d, ["base"]).limit(1))
    s.rename(d, "twice", "double")
    assert s.lineage(third).count() == 4 and "double" in {r["name"] for r in s.channels(d).collect()}
    rows, more = s.page(d, ["base"], 2, 0)
    assert rows.count() == 2 and more and not s.page(d, ["base"], 2, 2)[1]
    assert s.verify(d, ["mag", "base"], survey(spark)) == 0 and s.verify(d, ["mag"], survey(spark).withColumn("mag", F.lit(1.0))) == 6
    s.export_csv(d, ["line", "res"], f"file://{tmp_path}/out")
    with pytest.raises(Exception):
        s.export_csv(d, ["line"], f"file://{tmp_path}/out")
    with pytest.raises(StoreError):
        s.export_csv(d, ["line"], f"file://{tmp_path}/none", {"line": ["009"]})
    assert [r["action"] for r in s.history(d).collect()] == ["import", "publish", "publish", "publish", "rename"]
    with pytest.raises(StoreError):
        s.import_table("first", survey(spark))
    with pytest.raises(StoreError):
        s.import_table("nested", spark.createDataFrame([(0, [1])], "row_id long, a array<int>"))
    assert second != version


def test_an_unlisted_version_is_not_seen(spark, tmp_path):
    """What a killed writer leaves: data without a catalogue row."""
    s = SurveyStore(spark, f"file://{tmp_path}/store")
    d = s.import_table("t", survey(spark))
    survey(spark).select("row_id", "mag").write.parquet(f"{s.path}/aside/x")
    assert s.channels(d).count() == 3
    s.derive(d, "ok", "c('base')")


def test_recipes(spark):
    cells = spark.createDataFrame([(0, r, c, float(r * c % 7)) for r in range(16) for c in range(20)], "grid int, r int, c int, z double")
    fft = lambda source, name, *args: {"operation": "fft", "parameters": {"cells": source, "filter": name, "arguments": list(args), "dx": 1.0, "dy": 1.0}}
    steps = [fft({"$input": "cells"}, "continuation", 1.0), fft({"$result": 0}, "continuation", 2.0), fft({"$result": 1}, "gaussian", 9.0)]
    assert [len(s["filters"]) for s in recipes.fused(steps)] == [3]
    got = recipes.run(steps, {"cells": cells})
    want = grids.fft_filter(cells, [grids.continuation(3.0), grids.gaussian(9.0)], 1.0, 1.0)
    d = got.join(want.select("r", "c", F.col("filtered").alias("w")), ["r", "c"]).agg(F.max(F.abs(F.col("filtered") - F.col("w")))).first()[0]
    assert d < 1e-9
    with pytest.raises(ValueError):
        recipes.run([fft({"$result": 0}, "gaussian", 1.0)], {})
    with pytest.raises(ValueError):
        recipes.run([{"operation": "no.such"}], {})
    assert "grids.nine_point" in recipes.operations() and "cells" in recipes.describe("grids.nine_point")["signature"]
    smooth = recipes.run([{"operation": "grids.nine_point", "parameters": {"cells": {"$input": "cells"}}}], {"cells": cells})
    assert smooth.count() == 320


def test_text_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text("preamble\nmore\nLine,Sensor ID,X [m],Y [m],Mag [nT]\n001,1,10,20,100.5\n002,1,11,21,\n001,2,12,22,7\n")
    layout = text.inspect(spark, str(tmp_path / "a.csv"))
    assert [(c.kind, c.role, c.unit) for c in layout.columns] == [("text", "line", None), ("integer", "sensor", None), ("integer", "x", "m"), ("integer", "y", "m"), ("float", None, "nT")]
    rows = text.read(spark, str(tmp_path / "a.csv"), layout).collect()
    assert [tuple(r) for r in rows] == [("001", 1, 10, 20, 100.5), ("002", 1, 11, 21, None), ("001", 2, 12, 22, 7.0)]
    (tmp_path / "b.txt").write_bytes("Línea;X;Mag\nL1;1,5;-9,25\nL2;2,5;*\n".encode("cp1252"))
    layout = text.inspect(spark, str(tmp_path / "b.txt"))
    assert (layout.separator, layout.encoding, layout.decimal_comma) == (";", "windows-1252", True)
    assert [tuple(r) for r in text.read(spark, str(tmp_path / "b.txt"), layout).collect()] == [("L1", 1.5, -9.25), ("L2", 2.5, None)]


def test_grid_and_log_files(spark, tmp_path):
    lattice = spark.createDataFrame([(10.0 + 5 * c, 3.0 * r, float(r + c)) for r in range(3) for c in range(4)], "x double, y double, z double")
    assert {(r["r"], r["c"], r["z"]) for r in text.read_grid(lattice, "x", "y", "z").collect()} == {(r, c, float(r + c)) for r in range(3) for c in range(4)}
    with pytest.raises(ValueError):
        text.read_grid(lattice.limit(11), "x", "y", "z")
    (tmp_path / "a.las").write_text("~Version\nVERS. 2.0 : v\n~Well\nNULL. -999.25 : null\nWELL. A1 : name\n~Curve\nDEPT.M : depth\nGR.API : gamma\n~A\n 1.0 50.5\n 1.5 -999.25\n")
    log, header = text.read_las(spark, str(tmp_path / "a.las"))
    assert [tuple(r) for r in log.orderBy("DEPT").collect()] == [(1.0, 50.5), (1.5, None)] and header["W"]["WELL"] == "A1"
    text.write_las(log, str(tmp_path / "out"), header)
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt")
    again, _ = text.read_las(spark, str(part))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)


def test_solves(spark):
    c = spark.createDataFrame([("L1", "T1", 10.0), ("L2", "T1", -4.0), ("L1", "T2", 8.0), ("L2", "T2", -6.0), ("L1", "T1", 1000.0)], "a string, b string, r double")
    x = {r["line"]: r["correction"] for r in solve.line_corrections(c, "a", "b", "r").collect()}
    assert abs(sum(x.values())) < 1e-9
    assert max(abs(r + x[a] - x[b]) for a, b, r in [tuple(q) for q in c.collect()][:4]) < 1e-8
    p = spark.createDataFrame([("L", k / 3 - 1, 5 + 3 * (k / 3 - 1)) for k in range(7)], "l string, p double, r double")
    got = solve.polynomial_corrections(p, "l", "p", "r", 2).first()
    assert abs(got["c0"] + 5) < 1e-9 and abs(got["c1"] + 3) < 1e-9 and abs(got["c2"]) < 1e-9
    net = spark.createDataFrame([("b", "a", 2.0), ("c", "b", 3.0), ("c", "a", 5.0)], "a string, b string, d double")
    v = {r["node"]: r["value"] for r in solve.network(net, "a", "b", "d", None, {"a": 100.0}).collect()}
    assert {k: round(x, 9) for k, x in v.items()} == {"a": 100, "b": 102, "c": 105}
    fit = solve.least_squares(spark.range(10).selectExpr("double(id) x", "double(3 * id + 2) y"), ["x"], "y")
    assert abs(fit["1"] - 2) < 1e-9 and abs(fit["x"] - 3) < 1e-9


def test_streaming_mean_keeps_open_runs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, ids in enumerate((range(0, 4), range(4, 9), range(9, 12))):
        rows = [("a", i, None if i == 6 else float(i)) for i in ids]
        spark.createDataFrame(rows, "line string, row_id long, v double").coalesce(1).write.parquet(str(folder / f"b{k}"))
    stream = spark.readStream.schema("line string, row_id long, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    q = runs.moving_mean(stream, "line", "row_id", "v", 3).writeStream.format("memory").queryName("means").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["row_id"], r["mean"]) for r in spark.table("means").collect()} == {(i, float(i)) for i in (1, 2, 3, 4, 8, 9, 10)}


def test_streaming_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2) for i in range(30)] + [(3, "2024-01-01 00:03:00", 1)]
    spark.createDataFrame(rows, "id int, t string, k int").selectExpr("id", "timestamp(t) t", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t timestamp, k int").parquet(str(tmp_path / "in"))
    once = runs.distinct_events(stream, "t", "1 hour", ["id"])
    q = once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 30
    w = runs.tumbling(stream, "t", "10 minutes", "1 minute", ["k"], F.count("*").alias("n"))
    q = w.writeStream.format("memory").queryName("tumbling").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["n"] for r in spark.table("tumbling").collect()} <= {5, 6} and spark.table("tumbling").count() >= 4
