from geowarden.engine import Engine
from geowarden.sources import tables
from geowarden.streaming.detect import detect_stream

SF = "/root/testdata/sf0.001"


def test_batch_equals_stream(spark, tmp_path):
    readings = tables.telemetry(spark, SF).orderBy("ts", "event_id").limit(240).toPandas()
    engine = Engine(spark, tables.objects(spark, SF))
    engine.add_rule("device INTERSECTS polygon(@) AND speed gt 20", "plain")
    engine.add_rule("device :radius 2km NEAR devices(@)", "peers")
    engine.add_rule("speed gt 20 { :trigger 2 times interval 1h :reset after 48h }", "times")
    engine.add_rule("speed gt 20 { :trigger once }", "once")
    whole = spark.createDataFrame(readings)
    want = {(r.event_id, r.rule.rule_id) for r in engine.detect(whole).collect()}
    assert {k for _, k in want} == {"plain", "peers", "times", "once"}
    schema = whole.schema
    found = set()
    for k in range(3):
        spark.createDataFrame(readings.iloc[80 * k : 80 * k + 80], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = detect_stream(engine, stream, f"{tmp_path}/state", lambda df, n: found.update((r.event_id, r.rule.rule_id) for r in df.collect()), availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None
    assert found == want


def test_a_lost_table_is_an_error_and_old_ones_go(spark, tmp_path):
    import os
    import shutil

    import pytest

    from geowarden.streaming.detect import StreamDetector

    engine = Engine(spark)
    engine.add_rule("speed gt 20 { :trigger once }", "once")
    detector = StreamDetector(engine, str(tmp_path), lambda df, n: df.collect())
    readings = tables.telemetry(spark, SF).limit(20)
    for number in range(4):
        detector(readings, number)
    assert sorted(os.listdir(f"{tmp_path}/states")) == ["batch=2", "batch=3"]
    engine.delete_rule("once")
    engine.add_rule("speed gt 30 { :trigger once }", "other")
    detector(readings, 4)
    assert {r.rule_id for r in detector.states(4).collect()} == {"other"}
    shutil.rmtree(f"{tmp_path}/states/batch=4")
    with pytest.raises(FileNotFoundError):
        detector(readings, 5)
    detector.restore(detector._read("devices", 3), detector.states(3), 4)
    detector(readings, 5)
