"""Booking files: pandas-style values, headers that differ, stream against batch."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from bookwatch import schema as S
from bookwatch.sources.bookings import malformed_report, read_bookings
from bookwatch.streaming.scoring import read_booking_stream


def files(**texts):
    folder = tempfile.mkdtemp(prefix="bw-files-")
    for name, text in texts.items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write(text)
    return folder


def test_values_of_data_frame_tools(spark):
    p = files(a="booking_id,children,agent,adr,company,country\n"
                "9007199254740993,2.0,304.0,NaN,NULL,NA\n2,,304,1e2,NaN,PRT\n3,0.0, 7 ,50,None,\n")
    got = [tuple(r) for r in read_bookings(spark, p).orderBy("booking_id").collect()]
    assert got == [(2, None, 304, 100.0, None, "PRT"), (3, 0, 7, 50.0, None, None),
                   (9007199254740993, 2, 304, None, None, None)]


@pytest.mark.parametrize("bad", ["2.5", "two", "99999999999"])
def test_malformed_value_is_named_or_counted(spark, bad):
    p = files(a=f"booking_id,children\n1,{bad}\n2,NA\n")
    with pytest.raises(Exception, match="children cannot hold"):
        read_bookings(spark, p).collect()
    assert read_bookings(spark, p, malformed="null").where("children is null").count() == 2
    assert {r[0]: r[1] for r in malformed_report(spark, p).collect()} == {"booking_id": 0, "children": 1}


def test_files_with_other_headers(spark):
    p = files(a="booking_id,lead_time,adults\n1,3,99\n", b="booking_id,adults,lead_time\n2,3,99\n",
              c="lead_time,booking_id\n5,3\n")
    got = read_bookings(spark, p, mixed_headers=True).select("booking_id", "lead_time", "adults")
    assert sorted(map(tuple, got.collect())) == [(1, 3, 99), (2, 99, 3), (3, 5, None)]
    with pytest.raises(Exception):
        read_bookings(spark, p).collect()


def test_parquet_takes_declared_types(spark):
    p = tempfile.mkdtemp(prefix="bw-pq-") + "/t"
    spark.sql("select 1 booking_id, 2.0D children, double('NaN') adr").write.parquet(p)
    df = read_bookings(spark, p, fmt="parquet")
    assert [f.dataType.typeName() for f in df.schema] == ["long", "integer", "double"]
    assert tuple(df.first()) == (1, 2, None)


def run_stream(spark, src):
    base = tempfile.mkdtemp(prefix="bw-stream-")
    q = (read_booking_stream(spark, src).writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.read.parquet(base + "/out")


def test_stream_equals_batch_and_rejects_other_headers(spark):
    names = S.RAW_BOOKING_SCHEMA.names
    row = {n: "" for n in names} | {"booking_id": "1", "adults": "2.0", "booking_changes": "9", "adr": "NaN"}
    text = lambda cols: ",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n"
    src = files(a=text(names))
    assert [tuple(r) for r in run_stream(spark, src).select(*names).collect()] == \
        [tuple(r) for r in read_bookings(spark, src).select(*names).collect()]
    swapped = [{"adults": "booking_changes", "booking_changes": "adults"}.get(n, n) for n in names]
    with pytest.raises(Exception):
        run_stream(spark, files(a=text(swapped)))
    got = read_bookings(spark, files(a=text(swapped))).select("adults", "booking_changes")
    assert tuple(got.first()) == (2, 9)
    assert got.where(F.col("adults").isNull()).count() == 0
