import datetime as dt

from pyspark.sql import functions as F

from rainloom.operators.sets import same_rows
from rainloom.streaming.hourly import hourly_grid, late_views, open_hours, stream_hourly_grid


def test_stream_equals_batch_on_closed_hours(spark, make_swath, tmp_path):
    """Three arrivals, the second one late but inside the watermark, the third far ahead."""
    t0 = dt.datetime(2020, 6, 1)

    def orbit(number, start, kind):
        times = {s: {"time": start + dt.timedelta(minutes=20 * s), "rain_type": kind} for s in range(6)}
        return make_swath(6, 8, orbit=number, per_scan=times).withColumn("near_sfc_rain", F.col("ray").cast("float"))

    arrivals = [orbit(1, t0 + dt.timedelta(hours=12), 1), orbit(2, t0 + dt.timedelta(hours=3), 2), orbit(3, t0 + dt.timedelta(days=4), 3)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for df in arrivals:
        df.write.mode("append").parquet(src)
        stream_hourly_grid(spark, src, out, state, available_now=True).awaitTermination()
    everything = arrivals[0].unionByName(arrivals[1]).unionByName(arrivals[2])
    batch = hourly_grid(everything)
    closed = batch.where(F.col("hour_start") < F.lit(t0 + dt.timedelta(days=3)).cast("timestamp"))
    done = spark.read.schema(batch.schema).parquet(out)
    assert closed.count() > 0
    assert same_rows(done, closed).isEmpty()


def test_second_delivery_and_open_hours(spark, make_swath, tmp_path):
    """An orbit that arrives twice counts once; open hours complete the grid; late rows are told."""
    t0 = dt.datetime(2020, 6, 1)

    def orbit(number, day):
        times = {s: {"time": t0 + dt.timedelta(days=day, minutes=20 * s), "rain_type": 1} for s in range(6)}
        return make_swath(6, 8, orbit=number, per_scan=times)

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for df in (orbit(1, 1), orbit(1, 1), orbit(2, 5), orbit(3, 0)):  # again, far ahead, too late
        df.write.mode("append").parquet(src)
        stream_hourly_grid(spark, src, out, state, available_now=True).awaitTermination()
    batch = hourly_grid(orbit(1, 1).unionByName(orbit(2, 5)))
    done = spark.read.schema(batch.schema).parquet(out).unionByName(open_hours(spark, src, out))
    assert same_rows(done, batch).isEmpty()
    assert sum(r.late for r in late_views(spark, src, out).collect()) == orbit(3, 0).where("near_sfc_rain IS NOT NULL").count()


def test_late_and_repeated_deliveries_are_merged(spark, make_swath, tmp_path):
    """Whatever comes late or again, the grid is that of all distinct pixels; a batch given twice changes nothing."""
    from rainloom.streaming.hourly import merge_pixels, merged_grid, stream_merged_grid

    t0 = dt.datetime(2020, 6, 1, 22)

    def orbit(number, day, rain=1.0):
        times = {s: {"time": t0 + dt.timedelta(days=day, minutes=20 * s), "rain_type": s % 4 - 1} for s in range(12)}
        return make_swath(12, 8, orbit=number, per_scan=times, every={"near_sfc_rain": rain})

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrivals = [orbit(1, 9), orbit(2, 0), orbit(1, 9), orbit(3, 0), orbit(4, 30, None)]
    for df in arrivals:
        df.write.mode("append").parquet(src)
        stream_merged_grid(spark, src, out, state, available_now=True).awaitTermination()
    batch = hourly_grid(orbit(1, 9).unionByName(orbit(2, 0)).unionByName(orbit(3, 0)))
    assert same_rows(merged_grid(spark, out), batch).isEmpty()
    for _ in range(2):
        merge_pixels(orbit(2, 0).unionByName(orbit(2, 0)), out)
    assert same_rows(merged_grid(spark, out), batch).isEmpty()
    merge_pixels(orbit(2, 0).limit(0), out)
    merge_pixels(orbit(3, 0, 2.5), out)  # other values of known pixels
    changed = hourly_grid(orbit(1, 9).unionByName(orbit(2, 0)).unionByName(orbit(3, 0, 2.5)))
    assert same_rows(merged_grid(spark, out), changed).isEmpty()
