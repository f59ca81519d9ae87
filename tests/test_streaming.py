import numpy as np
from pyspark.sql import functions as F

from gridsquall.functions.numeric import swinging_door
from gridsquall.streaming import ramps as S


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams_agree_with_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i % 3, int(1_704_067_200_000_000 + i * 600_000_000), float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=300)) * 0.05)]
    df = spark.createDataFrame(rows, "sid long, us long, value double").withColumn("ts", F.timestamp_micros("us"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r.sid, r.block): (r.n, r.top) for r in run(spark, S.block_counts(stream), "update", "blocks")}
    want = {(r.sid, r.w.start): (r.n, r.top) for r in df.groupBy("sid", F.window("ts", "90 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).collect()}
    assert got == want
    assert len(run(spark, S.event_clusters(stream), "append", "clusters")) <= 3
    out = run(spark, S.swinging_door(stream), "append", "door")
    for sid in range(3):
        v = np.array([x for s, _, x in rows if s == sid])
        t = [u for s, u, _ in rows if s == sid]
        assert sorted(r.us for r in out if r.sid == sid) == [t[k] for k in swinging_door(v, 0.02)[:-1]]
