"""Adapters from the test tables to the history model, in DataFrame form, and the same as DuckDB SQL.

ops is the journal (one row a mutation), commits seals windows of it, keyspace, findings, restores and the others are what
the operators of this package read. All are deterministic and made of built-in functions, so filters and columns reach the
Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Microseconds of a commit's window: six hours.
COMMIT_WINDOW = 21_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col):
    """Microseconds since 1970 of a timestamp without time zone (the session's time zone must be UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp")) if isinstance(col, str) else F.unix_micros(col.cast("timestamp"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal: sequence, microtime, realm, subject, verb, actor, field, field_json, payload_length."""
    e = table(spark, sf_dir, "events")
    realm = F.when(F.col("user_id") % 4 == 0, "entity").when(F.col("user_id") % 4 == 1, "config").when(F.col("user_id") % 4 == 2, "state").otherwise("table")
    verb = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(
        F.col("event_id").alias("sequence"), micros("ts").alias("microtime"), realm.alias("realm"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"),
        verb.alias("verb"), (F.col("user_id") % 7).alias("actor"), F.col("event_type").alias("field"), F.col("props").alias("field_json"), F.length("props").cast("long").alias("payload_length"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear history of six-hour windows: commit_no, parent_no, microtime, operations, raw_bytes, stored_bytes, is_base."""
    w = F.expr(f"microtime div {COMMIT_WINDOW}")
    # bytes stored: those of the first operation with a payload in a window, by two grouped sums rather than a sort of all
    o = ops(spark, sf_dir).withColumn("commit_no", w)
    distinct = o.groupBy("commit_no", "field_json").agg(F.max("microtime").alias("t"), F.count("*").alias("n"), F.sum("payload_length").alias("raw"), F.min_by("payload_length", "sequence").alias("first"))
    c = distinct.groupBy("commit_no").agg(F.max("t").alias("microtime"), F.sum("n").alias("operations"), F.sum("raw").alias("raw_bytes"), F.sum("first").alias("stored_bytes"))
    order = Window.orderBy("commit_no")  # a row a window of time, however many operations
    return c.select("commit_no", F.lag("commit_no").over(order).alias("parent_no"), "microtime", "operations", "raw_bytes", "stored_bytes", (F.row_number().over(order) % 24 == 1).cast("int").alias("is_base"))


def restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restore log: id, started (seconds, shifted to January 2024), actor, outcome."""
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("refused")
    started = F.lit(1_704_067_200) + F.pmod(F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000"), F.lit(2_592_000)) + F.col("o_orderkey") % 86_400
    return o.select(F.col("o_orderkey").alias("id"), started.cast("long").alias("started"), F.col("o_custkey").alias("actor"), outcome.alias("outcome"))


def provider_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to storage by provider, day and operation: requests, failures, bytes, milliseconds, slowest."""
    li = table(spark, sf_dir, "lineitem")
    seconds = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000000")
    op = F.element_at(F.array(*map(F.lit, ("put", "get", "head", "list", "delete"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return li.groupBy(F.when(F.col("l_linestatus") == "O", "s3").otherwise("local").alias("provider"), (seconds - seconds % 86_400).alias("day"), op.alias("operation")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"),
        F.sum(F.col("l_partkey") % 1000).alias("millis"), F.max("l_suppkey").alias("slowest"),
    )


def keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a cache-like store with their sizes: key, bytes."""
    e = table(spark, sf_dir, "events")
    bin_ = F.element_at(F.array(*map(F.lit, ("cache", "session", "queue", "flood", "blob"))), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(F.concat_ws(":", bin_, F.col("event_type"), F.col("user_id").cast("string")).alias("key"), F.length("props").cast("long").alias("bytes"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health findings: id, code, severity (0 to 3), scope, rung, created, resolved (null: open)."""
    o = table(spark, sf_dir, "orders")
    created = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000")
    rung = F.element_at(F.array(*map(F.lit, ("observe", "reindex", "refetch", "rebuild", "quarantine", "refuse"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("code"), (F.col("o_custkey") % 4).alias("severity"),
        F.concat(F.lit("scope:"), (F.col("o_custkey") % 50).cast("string")).alias("scope"), rung.alias("rung"), created.alias("created"), F.when(F.col("o_orderstatus") == "F", created + 3600).alias("resolved"),
    )


def frames(spark: SparkSession, sf_dir: str, width: int = 16_384) -> DataFrame:
    """Content-addressed blocks of all documents: h (SHA-256), refs, raw_size."""
    from ..operators.store import frame_documents

    return frame_documents(table(spark, sf_dir, "documents"), "doc_id", "text", width)


#: DuckDB SQL of the adapters, to be put into a WITH clause.
SQL = {
    "ops": """select event_id as sequence, epoch_us(ts) as microtime,
 case user_id % 4 when 0 then 'entity' when 1 then 'config' when 2 then 'state' else 'table' end as realm,
 concat('user:', cast(user_id as varchar)) as subject,
 case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as verb,
 user_id % 7 as actor, event_type as field, props as field_json, cast(length(props) as bigint) as payload_length from events""",
    "commits": f"""select w as commit_no, lag(w) over (order by w) as parent_no, microtime, operations, raw_bytes, stored_bytes,
 case when row_number() over (order by w) % 24 = 1 then 1 else 0 end as is_base
from (select w, max(microtime) as microtime, count(*) as operations, cast(sum(payload_length) as bigint) as raw_bytes,
        cast(sum(case when rn = 1 then payload_length else 0 end) as bigint) as stored_bytes
      from (select *, microtime // {COMMIT_WINDOW} as w, row_number() over (partition by microtime // {COMMIT_WINDOW}, field_json order by sequence) rn from ops) group by w)""",
    "restores": """select o_orderkey as id, cast(1704067200 + (epoch_us(o_orderdate) // 1000000) % 2592000 + o_orderkey % 86400 as bigint) as started, o_custkey as actor,
 case o_orderstatus when 'F' then 'succeeded' when 'O' then 'pending' else 'refused' end as outcome from orders""",
    "provider_stat": """select case l_linestatus when 'O' then 's3' else 'local' end as provider,
 (epoch_us(l_shipdate) // 1000000) - (epoch_us(l_shipdate) // 1000000) % 86400 as day,
 case l_linenumber % 5 when 0 then 'put' when 1 then 'get' when 2 then 'head' when 3 then 'list' else 'delete' end as operation,
 count(*) as requests, count(case when l_returnflag = 'R' then 1 end) as failures, cast(sum(cast(trunc(l_quantity) as bigint)) as bigint) as bytes,
 cast(sum(l_partkey % 1000) as bigint) as millis, max(l_suppkey) as slowest from lineitem group by 1, 2, 3""",
    "keyspace": """select concat_ws(':', case user_id % 5 when 0 then 'cache' when 1 then 'session' when 2 then 'queue' when 3 then 'flood' else 'blob' end, event_type, cast(user_id as varchar)) as key,
 cast(length(props) as bigint) as bytes from events""",
    "findings": """select o_orderkey as id, lower(substr(o_orderpriority, 3, 20)) as code, o_custkey % 4 as severity, concat('scope:', cast(o_custkey % 50 as varchar)) as scope,
 case o_orderkey % 6 when 0 then 'observe' when 1 then 'reindex' when 2 then 'refetch' when 3 then 'rebuild' when 4 then 'quarantine' else 'refuse' end as rung,
 epoch_us(o_orderdate) // 1000000 as created, case when o_orderstatus = 'F' then epoch_us(o_orderdate) // 1000000 + 3600 end as resolved from orders""",
    "frames": """select sha256(encode(text)[p*16384+1:(p+1)*16384]) as h, count(*) as refs, cast(max(octet_length(encode(text)[p*16384+1:(p+1)*16384])) as bigint) as raw_size
from documents, unnest(range(0, greatest(octet_length(encode(text)) - 1, 0) // 16384 + 1)) t(p) group by 1""",
}


def with_views(query: str, *names: str) -> str:
    """query with the named adapters, and those they need, as common table expressions."""
    need = [n for n in ("ops", "commits", *SQL) if n in names or n == "ops" and "commits" in names]
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in dict.fromkeys(need)) + "\n" + query
