"""The result cache in buckets."""

from pyspark.sql import functions as F

from faultline.sources import cache


def made(spark, keys, value):
    return spark.createDataFrame([(str(k), "t", "q", "r", "f", "{}", f'{{"v":{value}}}', 1, f"2024-01-{1 + k % 28:02d}") for k in keys], cache.RESULTS)


def test_cache_in_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BUCKETS", 4)
    monkeypatch.setattr(cache, "MOST_GENERATIONS", 3)
    c = cache.ResultCache(spark, f"file://{tmp_path}/cache")
    assert c.result("1") is None and c.table("results").collect() == [] and c.clean() == 0
    c.put("results", made(spark, range(200), 1))
    assert c._current("results") == {0: 1, 1: 1, 2: 1, 3: 1} and len(c.table("results").inputFiles()) <= 8
    one = next(k for k in range(200) if cache.zlib.crc32(str(k).encode()) % 4 == 2)
    c.put("results", made(spark, [one, one], 2))
    assert c._current("results") == {0: 1, 1: 1, 2: 2, 3: 1} and c.result(str(one)) == {"v": 2} and c.table("results").count() == 200
    c.put("results", made(spark, [one, 900], 3), replace=False)
    assert c.result(str(one)) == {"v": 2} and c.result("900") == {"v": 3}
    c.drop("results", c.table("results").filter(F.pmod(F.crc32(F.col("cache_key").cast("binary")), F.lit(4)) == 2).select("cache_key"))
    assert c.result(str(one)) is None and 100 < c.table("results").count() < 200  # the bucket that lost all its rows is empty
    for k in range(4):
        c.put("results", made(spark, [1000 + k], k))
    assert [c.result(str(1000 + k)) for k in range(4)] == [{"v": k} for k in range(4)] and len(c._numbers(f"{c.root}/results", "generation=")) <= 4
    before = c.table("results").count()
    assert c.clean(max_age_days=-1) == before and c.table("results").isEmpty()
    for intent in ("first", "second"):
        c.store_run(run_id="r", repo_root=".", repo_fingerprint="f", intent=intent, anchors=["x"], diff_hash="d")
        c.store_artifact(artifact_id="i", kind="k", repo_fingerprint_hash="f", path_or_blob=intent)
    assert c.table("runs").first().intent == "first" and c.table("artifacts").first().path_or_blob == "second" and tuple(c.stats().select("runs", "results", "artifacts").first()) == (1, 0, 1)
