"""The stream gives what the batch gives."""

from annalist.operators import anchors
from annalist.operators.graph import resolve_anchor
from annalist.operators.history import collapse, subjects_at
from annalist.sources import files
from annalist.sources.history import findings, ops
from annalist.streaming import journal
from annalist.streaming.anchors import anchor_stream
from pyspark.sql import functions as F


def test_sealed_segments_and_retries(spark, sf_dir, tmp_path):
    o = ops(spark, sf_dir)
    o.orderBy("sequence").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    q = journal.seal_stream(journal.read_journal(spark, str(tmp_path / "in"), o.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    sealed = spark.read.parquet(str(tmp_path / "out"))
    before = sealed.count()
    assert sealed.agg(F.sum("n")).first()[0] <= o.count() and before > 0
    journal.seal(o.limit(100), 0, str(tmp_path / "again"))
    journal.seal(o.limit(100), 0, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == collapse(o.limit(100)).count()


def test_windowed_activity(spark, sf_dir, tmp_path):
    o = ops(spark, sf_dir)
    o.write.parquet(str(tmp_path / "in"))
    s = journal.activity(journal.read_journal(spark, str(tmp_path / "in"), o.schema, 100), "1 hour")
    q = s.writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    hour = 3_600_000_000
    batch = {(r[0], r[1]): r[2] for r in o.groupBy((F.col("microtime") - F.col("microtime") % hour).alias("b"), "realm").count().collect()}
    assert {(r["bucket"], r["realm"]): r["operations"] for r in spark.table("activity").collect()} == batch


def test_ledger_state(spark, sf_dir, tmp_path):
    f = findings(spark, sf_dir).limit(300)
    f.write.parquet(str(tmp_path / "in"))
    q = journal.ledger_stream(journal.read_journal(spark, str(tmp_path / "in"), f.schema, 100)).writeStream.format("memory").queryName("ledger").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("ledger").collect():
        last[r["code"], r["scope"]] = max(last.get((r["code"], r["scope"]), (0, 0)), (r["n"], r["worst"]))
    f = spark.read.parquet(str(tmp_path / "in"))
    assert last == {(r["code"], r["scope"]): (r["n"], r["w"]) for r in f.groupBy("code", "scope").agg(F.count("*").alias("n"), F.max("severity").alias("w")).collect()}


def test_segments_prune_and_trees_compare(spark, sf_dir, tmp_path):
    o, day = ops(spark, sf_dir), 86_400_000_000
    files.write_segments(o, str(tmp_path / "seg"), day)
    start = 1_704_067_200_000_000
    got = files.read_segments(spark, str(tmp_path / "seg"), start, start + 3 * day)
    assert got.count() == o.where(F.col("microtime").between(start, start + 4 * day - 1)).count()
    assert "PartitionFilters: [isnotnull(level" in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x")
    tree = files.scan_tree(spark, str(tmp_path / "t"))
    assert tree.count() == 1 and files.compare_trees(tree, tree.limit(0)).first()["status"] == "removed"
    assert files.fingerprint(tree).first()["files"] == 1


def test_appended_sequences_have_no_gaps_and_replays_change_nothing(spark, sf_dir, tmp_path):
    o = ops(spark, sf_dir).select("microtime", F.col("sequence").alias("request"), "subject", F.repeat("field_json", 60).alias("label"))
    o.orderBy("request").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "journal")
    journal.append_stream(journal.read_journal(spark, str(tmp_path / "in"), o.schema), folder, str(tmp_path / "cp")).awaitTermination()
    before = sorted(map(tuple, journal.appended(spark, folder).select("sequence", "batch", "request").collect()))
    assert [s for s, *_ in before] == list(range(1, o.count() + 1)) and len({b for _, b, _ in before}) > 2
    assert journal.appended(spark, folder).agg(F.max(F.length("label"))).first()[0] == journal.LABEL_LENGTH
    journal.append(o.limit(50), 1, folder)  # a batch that comes again, even with other rows
    assert sorted(map(tuple, journal.appended(spark, folder).select("sequence", "batch", "request").collect())) == before
    more = spark.createDataFrame([(5, 1, "s", "x"), (3, 2, "s", None)], o.schema)
    more.withColumn("sequence", F.lit(7).cast("long")).write.parquet(f"{folder}/rows/batch=99")  # broke off before its offsets
    assert journal.appended(spark, folder).count() == len(before)
    journal.append(more.limit(0), 98, folder)
    journal.append(more, 99, folder)
    last = journal.appended(spark, folder).where("batch = 99").orderBy("sequence").select("sequence", "request").collect()
    assert [tuple(r) for r in last] == [(len(before) + 1, 2), (len(before) + 2, 1)]


def test_anchors_of_a_stream_are_those_of_the_batch(spark, sf_dir, tmp_path):
    day = 86_400_000_000
    o = ops(spark, sf_dir).withColumn("payload_length", F.when(F.col("sequence") % 17 != 0, F.col("payload_length")))
    first, last = o.agg(F.expr(f"min(microtime) div {day}"), F.expr(f"max(microtime) div {day}")).first()
    later = o.limit(1).withColumn("microtime", F.lit((last + 9) * day)).withColumn("subject", F.lit("end"))
    days = [o.where(F.expr(f"(microtime div {day} - {first}) div 8") == k) for k in range(5)]
    for k, part in enumerate([*days, later]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = anchor_stream(stream, first, day, 5, "40 days").writeStream.format("memory").queryName("anchors").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        waited = spark.table("anchors").count()
        q = anchor_stream(spark.readStream.schema(o.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), first, day, 5, "1 day").writeStream.format("memory").queryName("anchors2").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.table("anchors2").where(F.col("anchor") <= last)
    wanted = anchors.written(anchors.entries(o, day), first, last, 5)
    row = lambda r: (r["history"], r["subject"], r["anchor"], r["full"], r["size"])
    assert sorted(map(row, got.collect()), key=repr) == sorted(map(row, wanted.collect()), key=repr)
    assert waited == 0  # nothing is written before the watermark passes
    chain = anchors.chain_of(got, last).select("link", F.struct("history", "subject").alias("subject"), "size")
    there = subjects_at(o.withColumnRenamed("realm", "realm"), o.agg(F.max("sequence")).first()[0]).where("exists")
    assert {tuple(r["subject"]) for r in resolve_anchor(chain).collect()} == {(r["realm"], r["subject"]) for r in there.collect()}
