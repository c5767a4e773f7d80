import pytest

from textweave.plans.linkage import report_features
from textweave.streaming.reports import stream_features, write_available


def test_stream_equals_batch(spark, tmp_path):
    schema = (
        "crime_id string, location_type string, occurrence_start_date string, occurrence_start_time string, "
        "nztm_location_northing string, nztm_location_easting string, narrative string"
    )
    batch = spark.createDataFrame(
        [(f"c{i}", "Farm", "05/03/2017", "1:30 PM", "3", "1", "NARRATIVE: ROOM MESSY *") for i in range(5)], schema
    )
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = write_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, report_features(batch).collect()))
    with pytest.raises(ValueError):
        stream_features(batch)
