from tabweave.streaming import on_examples


def test_examples_accumulate(spark, tmp_path):
    source = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, "k string, v string, score double").coalesce(1).write.mode("append").parquet(str(source))
    seen = {}
    for rows in ([("a", "1", 1.0)], [("b", "2", 0.5), ("a", "1", 0.7)]):
        write(rows)
        stream = spark.readStream.schema("k string, v string, score double").parquet(str(source))
        q = on_examples(stream, str(tmp_path / "kept"), str(tmp_path / "ck"), lambda e: e, lambda r, i: seen.update({i: {tuple(x) for x in r.collect()}}))
        q.awaitTermination(120)
    assert seen[max(seen)] == {("a", "1", 1.0), ("b", "2", 0.5)}
