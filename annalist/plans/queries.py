"""The operators as queries over the test tables, with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import coding, graph, history, policy, quality, store, timeline
from ..sources import history as src
from ..sources.history import COMMIT_WINDOW, table, with_views
from .report import report

#: January 2024, in microseconds, and where in the journal's month the queries look.
START, END, MID = 1_704_067_200_000_000, 1_706_745_599_999_999, 1_705_000_000_000_000
HOUR6 = COMMIT_WINDOW
DAY = 86_400_000_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def point(ops: DataFrame, tenths: int) -> int:
    """The sequence that so many tenths of the journal's range end with."""
    return (ops.agg(F.max("sequence")).first()[0] or 0) * tenths // 10


def point_sql(tenths: int) -> str:
    return f"(select coalesce(max(sequence), 0) * {tenths} // 10 from ops)"


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its SQL over the named adapters."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


# --- timeline -------------------------------------------------------------------------------------------------------

_PER = f"""select microtime - microtime % {HOUR6} as bucket, count(*) as commits, cast(sum(operations) as bigint) as operations, cast(sum(raw_bytes) as bigint) as raw_bytes,
 cast(sum(stored_bytes) as bigint) as stored_bytes, cast(sum(is_base) as bigint) as bases from commits where microtime between {START} and {END} group by 1"""
_BUCKETS = f"""select b.bucket, coalesce(commits, 0) as commits, coalesce(operations, 0) as operations, coalesce(raw_bytes, 0) as raw_bytes, coalesce(stored_bytes, 0) as stored_bytes,
 coalesce(bases, 0) as bases, coalesce(restores, 0) as restores from (select unnest(range({START - START % HOUR6}, {END + 1}, {HOUR6})) as bucket) b
 left join ({_PER}) p using (bucket) left join (select started * 1000000 - (started * 1000000) % {HOUR6} as bucket, count(*) as restores from restores
 where started * 1000000 between {START} and {END} group by 1) r using (bucket)"""


@query(f"select * from ({_BUCKETS})", "ops", "commits", "restores")
def timeline_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.buckets(src.commits(spark, sf_dir), src.restores(spark, sf_dir), START, END, HOUR6)


@query(f"""select count(*) as commits, cast(coalesce(sum(operations), 0) as bigint) as operations, cast(coalesce(sum(raw_bytes), 0) as bigint) as raw_bytes, cast(coalesce(sum(stored_bytes), 0) as bigint) as stored_bytes,
 cast(coalesce(sum(is_base), 0) as bigint) as is_base, round(case when sum(stored_bytes) > 0 then sum(raw_bytes) / sum(stored_bytes) else 1.0 end, 6) as ratio from commits where microtime between {START} and {END}""", "ops", "commits")
def timeline_totals(spark, sf_dir):
    return timeline.totals(src.commits(spark, sf_dir), START, END)


@query("select min(microtime) as first, max(microtime) as last, count(*) as commits from commits", "ops", "commits")
def history_span(spark, sf_dir):
    return timeline.span(src.commits(spark, sf_dir))


@query(f"""select bucket, commit_no, rank from (select *, row_number() over (partition by bucket order by microtime desc, commit_no desc) as rank from
 (select *, microtime - microtime % {DAY} as bucket from commits order by microtime desc, commit_no desc limit 15360)) where rank <= 3""", "ops", "commits")
def newest_commits_per_day(spark, sf_dir):
    return timeline.newest_per_bucket(src.commits(spark, sf_dir), DAY, 3)


@query(f"select bucket, cast(greatest(0, 1000000 - coalesce(sum(stored_bytes) over (order by bucket rows between 1 following and unbounded following), 0)) as bigint) as cumulative from ({_BUCKETS})", "ops", "commits", "restores")
def cumulative_stored(spark, sf_dir):
    return timeline.cumulative_stored(timeline_buckets(spark, sf_dir), 1_000_000)


@query(f"""select bucket, metric, round(value, 6) as value from (select bucket, unnest(['operations_rate', 'ratio', 'stored_bytes']) as metric,
 unnest([operations * 1000000 / {HOUR6 - 1}, case when stored_bytes > 0 then raw_bytes / stored_bytes else 1.0 end, cast(stored_bytes as double)]) as value from ({_BUCKETS}))""", "ops", "commits", "restores")
def bucket_series(spark, sf_dir):
    return timeline.series(timeline_buckets(spark, sf_dir), HOUR6)


@query("select commit_no, round(case when e >= 1 then operations / e * 3600 else 0.0 end, 6) as rate from (select *, (microtime - lag(microtime) over (order by microtime, commit_no)) / 1000000 as e from commits)", "ops", "commits")
def operation_rate(spark, sf_dir):
    return timeline.operation_rate(src.commits(spark, sf_dir))


@query("""select commit_no, operations, n_before, median, mad, score, coalesce(abs(score) >= 4.0, false) as anomalous from (select *, round(case when n_before < 8 then null when scale > 0 then (operations - median) / scale when median <> 0 then (operations - median) / abs(median) else sign(operations) end, 6) as score
 from (select *, greatest(1.4826 * mad, 0.05 * abs(median)) as scale from (select commit_no, operations, cast(len(h) as bigint) as n_before, case when len(h) = 0 then 0.0 else list_median(h) end as median,
 case when len(h) = 0 then 0.0 else list_median(list_transform(h, lambda v: abs(v - list_median(h)))) end as mad
 from (select commit_no, operations, coalesce(list(cast(operations as double)) over (order by commit_no rows between 128 preceding and 1 preceding), []) as h from commits))))""".replace("list_median(h)", "list_aggregate(h, 'median')").replace("list_median(list_transform(h, lambda v: abs(v - list_aggregate(h, 'median'))))", "list_aggregate(list_transform(h, lambda v: abs(v - list_aggregate(h, 'median'))), 'median')"), "ops", "commits")
def anomalies(spark, sf_dir):
    return timeline.robust_scores(src.commits(spark, sf_dir).select("commit_no", "operations"), "commit_no", "operations")


@query('select probe_id, p."at" as "at", commit_no from (select id as probe_id, started * 1000000 as "at" from restores) p asof left join (select microtime, commit_no from commits) c on p."at" >= c.microtime', "ops", "commits", "restores")
def commit_as_of(spark, sf_dir):
    probes = src.restores(spark, sf_dir).select(F.col("id").alias("probe_id"), (F.col("started") * 1_000_000).alias("at"))
    return timeline.as_of(src.commits(spark, sf_dir), probes)


# --- storage statistics ---------------------------------------------------------------------------------------------

_SUMS = "cast(sum(requests) as bigint) as requests, cast(sum(failures) as bigint) as failures, cast(sum(bytes) as bigint) as bytes, cast(sum(millis) // 1000 as bigint) as seconds, max(slowest) as slowest"


def _provider(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("requests", "failures", "bytes")], F.expr("sum(millis) div 1000").alias("seconds"), F.max("slowest").alias("slowest"))


@query(f"select operation, {_SUMS} from provider_stat group by 1", "provider_stat")
def provider_by_operation(spark, sf_dir):
    return _provider(src.provider_stat(spark, sf_dir), "operation")


@query(f"select provider, {_SUMS} from provider_stat group by 1", "provider_stat")
def provider_by_provider(spark, sf_dir):
    return _provider(src.provider_stat(spark, sf_dir), "provider")


@query(f"select day, {_SUMS} from provider_stat where day between 820454400 and 883612800 group by 1", "provider_stat")
def provider_by_day(spark, sf_dir):
    return _provider(src.provider_stat(spark, sf_dir).where(F.col("day").between(820_454_400, 883_612_800)), "day")


@query("select provider, cast(sum(case when operation in ('get', 'head') then 0 else requests end) as bigint) as class_a, cast(sum(case when operation in ('get', 'head') then requests else 0 end) as bigint) as class_b from provider_stat group by 1", "provider_stat")
def provider_classes(spark, sf_dir):
    reads = F.col("operation").isin("get", "head")
    return src.provider_stat(spark, sf_dir).groupBy("provider").agg(F.sum(F.when(reads, 0).otherwise(F.col("requests"))).cast("long").alias("class_a"), F.sum(F.when(reads, F.col("requests")).otherwise(0)).cast("long").alias("class_b"))


@query("select count(*) as n, min(payload_length) as least, max(payload_length) as most, round(avg(payload_length), 6) as mean, cast(quantile_disc(payload_length, 0.95) as bigint) as p95 from (select * from ops order by sequence desc limit 1000)", "ops")
def latency_summary(spark, sf_dir):
    last = src.ops(spark, sf_dir).orderBy(F.desc("sequence")).limit(1000)
    return last.agg(F.count("*").alias("n"), F.min("payload_length").alias("least"), F.max("payload_length").alias("most"), F.round(F.avg("payload_length"), 6).alias("mean"), F.expr("cast(percentile_disc(0.95) within group (order by payload_length) as bigint)").alias("p95"))


@query("select * from frames", "frames")
def distinct_frames(spark, sf_dir):
    return src.frames(spark, sf_dir)


@query("select count(*) as frames, cast(sum(raw_size) as bigint) as stored_bytes, cast(sum(raw_size * refs) as bigint) as captured_bytes, count(case when refs = 0 then 1 end) as orphans, round(case when sum(raw_size) > 0 then sum(raw_size * refs) / sum(raw_size) else 1.0 end, 6) as ratio from frames", "frames")
def frame_statistics(spark, sf_dir):
    return store.statistics(src.frames(spark, sf_dir))


_CUT = "select {key} as key, p as idx, sha256(encode(text)[p*1024+1:(p+1)*1024]) as hash, cast(octet_length(encode(text)[p*1024+1:(p+1)*1024]) as bigint) as length from ({docs}), unnest(range(0, greatest(octet_length(encode(text)) - 1, 0) // 1024 + 1)) t(p) where text is not null"
_A = _CUT.format(key="doc_id", docs="select doc_id, text from documents where doc_id % 2 = 0")
_B = _CUT.format(key="doc_id - 1", docs="select doc_id, text from documents where doc_id % 2 = 1")


@query(f"""with a as ({_A}), b as ({_B}), changed as (select coalesce(a.key, b.key) as key, count(*) as positions, count(case when a.hash is distinct from b.hash then 1 end) as changed, count(a.hash) as na, count(b.hash) as nb from a full join b on a.key = b.key and a.idx = b.idx group by 1),
 n as (select key, count(*) as new from (select distinct key, hash from b except select distinct key, hash from a) group by 1), d as (select key, count(*) as dropped from (select distinct key, hash from a except select distinct key, hash from b) group by 1)
 select key, positions, changed, coalesce(new, 0) as new, coalesce(dropped, 0) as dropped, least(na, nb) >= 16 and changed / positions > 0.3 as shifted from changed left join n using (key) left join d using (key)""")
def block_differences(spark, sf_dir):
    """Each even document against the next odd one, as two versions of a file in blocks of 1,024 bytes."""
    d = table(spark, sf_dir, "documents")
    cut = lambda rest, shift: store.blocks(d.where(F.col("doc_id") % 2 == rest).select((F.col("doc_id") - shift).alias("doc_id"), "text"), "doc_id", "text", 1024)
    return store.block_diff(cut(0, 0), cut(1, 1))


@query(f"select distinct hash, length from ({_B}) where hash not in (select hash from ({_A}))")
def missing_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = (store.blocks(d.where(F.col("doc_id") % 2 == k), "doc_id", "text", 1024) for k in (0, 1))
    return store.missing(b, a)


@query("select c as pack, sequence, payload_length, cast(coalesce(sum(payload_length) over (partition by c order by sequence rows between unbounded preceding and 1 preceding), 0) as bigint) as pack_offset from (select *, microtime // 21600000000 as c from ops)", "ops")
def pack_offsets(spark, sf_dir):
    return store.pack_offsets(src.ops(spark, sf_dir).withColumn("pack", F.expr(f"microtime div {HOUR6}")), "pack", "sequence", "payload_length")


@query("select realm, cast(sum(payload_length) as bigint) as bytes, count(*) as pending from ops group by 1", "ops")
def bytes_by_realm(spark, sf_dir):
    return src.ops(spark, sf_dir).groupBy("realm").agg(F.sum("payload_length").cast("long").alias("bytes"), F.count("*").alias("pending"))


# --- history --------------------------------------------------------------------------------------------------------


@query("select count(*) as pending, cast(coalesce(sum(payload_length), 0) as bigint) as bytes, min(microtime) as oldest from ops", "ops")
def journal_head(spark, sf_dir):
    return src.ops(spark, sf_dir).agg(F.count("*").alias("pending"), F.coalesce(F.sum("payload_length"), F.lit(0)).cast("long").alias("bytes"), F.min("microtime").alias("oldest"))


@query("select sequence, microtime, realm, subject, verb, actor, field, field_json, payload_length from ops order by sequence limit 500", "ops")
def journal_window(spark, sf_dir):
    return src.ops(spark, sf_dir).orderBy("sequence").limit(500)


def _collapse_sql(keys: str, rows: str) -> str:
    return f"""o as (select *, row_number() over (partition by {keys} order by sequence) as i from {rows}),
a as (select *, coalesce(sum(case when verb = 'delete' then 1 else 0 end) over (partition by {keys} order by i rows between unbounded preceding and 1 preceding), 0) as g from o),
b as (select *, first_value(verb) over (partition by {keys}, g order by i) as hv from a),
c as (select *, min(case when hv <> 'create' then g end) over (partition by {keys}) as gb, max(g) over (partition by {keys}) as lg, max(i) over (partition by {keys}) as li, max(case when verb = 'create' then i when verb = 'delete' then i + 1 end) over (partition by {keys}) as rs from b),
h as (select *, case when gb is not null then min(case when g = gb then i end) over (partition by {keys}) else min(case when g = lg then i end) over (partition by {keys}) end as st, max(case when i = li then verb end) over (partition by {keys}) as lv from c),
s as (select *, case when gb is null then (case when lv = 'delete' then null else 'create' end) else (case when lv = 'delete' then 'delete' else 'update' end) end as ov from h),
net as (select {keys}, min(ov) as verb, min(sequence) as first_sequence, max(sequence) as last_sequence, list_sort(list_distinct(list(case when i = li or ov = 'update' and i >= greatest(st, coalesce(rs, 0)) then field end))) as fields, arg_max(field_json, i) as payload, count(*) as n from s where ov is not null and i >= st group by {keys})"""


_NET = "select {keys}, verb, first_sequence, last_sequence, array_to_string(fields, ',') as fields, payload, n from net"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("fields", F.concat_ws(",", "fields"))


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + ",\n" + _collapse_sql("realm, subject", "ops") + "\n" + _NET.format(keys="realm, subject"))
def collapse_journal(spark, sf_dir):
    return _flat(history.collapse(src.ops(spark, sf_dir)))


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + ",\n" + _collapse_sql("realm, subject", "ops") + "\nselect x.before, y.after, x.before - y.after as dropped, round(case when y.after > 0 then x.before / y.after else 1.0 end, 6) as ratio from (select count(*) as before from ops) x, (select count(*) as after from net) y")
def collapse_statistics(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return history.collapse_statistics(o, history.collapse(o))


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + f',\nw as (select *, microtime - microtime % {DAY} as "window" from ops),\n' + _collapse_sql('"window", realm, subject', "w") + "\n" + _NET.format(keys='"window", realm, subject'))
def rollup_by_day(spark, sf_dir):
    return _flat(history.rollup(src.ops(spark, sf_dir), DAY))


_REPLAY = "select realm, subject, field, arg_max(field_json, sequence) as value, max(sequence) as sequence from (select *, coalesce(max(case when verb in ('delete', 'truncate') then sequence end) over (partition by realm, subject), -1) as reset from ops{where}) where sequence > reset and field_json is not null group by 1, 2, 3"


@query(_REPLAY.format(where=""), "ops")
def replay_all(spark, sf_dir):
    return history.replay(src.ops(spark, sf_dir))


@query(_REPLAY.format(where=f" where sequence <= {point_sql(5)}"), "ops")
def replay_at(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return history.replay(o, point(o, 5))


_AT = "select realm, subject, arg_max(verb, sequence) not in ('delete', 'truncate') as exists, count(case when verb in ('delete', 'truncate') or field_json is not null then 1 end) as versions, max(sequence) as sequence from ops where sequence <= {n} group by 1, 2"


@query(_AT.format(n=point_sql(5)).replace("as exists", 'as "exists"'), "ops")
def subjects_at(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return history.subjects_at(o, point(o, 5))


@query(f"select * from (select realm, subject, max(microtime) as updated, arg_max(verb, sequence) in ('delete', 'truncate') as deleted, arg_max(payload_length, sequence) as size from ops group by 1, 2) where updated > {MID}", "ops")
def changed_since(spark, sf_dir):
    return history.changed_since(src.ops(spark, sf_dir), MID)


@query("select sequence, realm, subject, field_json, lag(field_json) over w as previous, field_json is distinct from lag(field_json) over w as changed, (row_number() over w - 1) % 33 as delta_depth from ops window w as (partition by realm, subject order by sequence)", "ops")
def previous_versions(spark, sf_dir):
    return history.previous_version(src.ops(spark, sf_dir))


_DIFF = f"""select * from (select coalesce(a.realm, b.realm) as realm, coalesce(a.subject, b.subject) as subject, coalesce(a.field, b.field) as field,
 case when a.sequence is null then 'added' when b.sequence is null then 'removed' when a.value is distinct from b.value then 'changed' end as status, a.value as before, b.value as after
 from ({_REPLAY.format(where=f" where sequence <= {point_sql(5)}")}) a full join ({_REPLAY.format(where=f" where sequence <= {point_sql(9)}")}) b on a.realm = b.realm and a.subject = b.subject and a.field = b.field) where status is not null"""


@query(_DIFF, "ops")
def diff_fields(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return history.diff_fields(o, point(o, 5), point(o, 9))


@query(f"""select d.realm, d.subject, case when a.subject is null and b.subject is not null then 'added' when a.subject is not null and b.subject is null then 'removed' else 'changed' end as status, n_fields
 from (select realm, subject, count(*) as n_fields from ({_DIFF}) group by 1, 2) d left join (select * from ({_AT.format(n=point_sql(5)).replace('as exists', 'as alive')}) where alive) a on a.realm = d.realm and a.subject = d.subject
 left join (select * from ({_AT.format(n=point_sql(9)).replace('as exists', 'as alive')}) where alive) b on b.realm = d.realm and b.subject = d.subject""", "ops")
def diff_subjects(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return history.diff_subjects(o, point(o, 5), point(o, 9))


_SIDE = "select p_partkey - p_partkey % 3 as id, {value} as value from part where p_partkey % 3 = {k}"
_SIDES = [("p_brand", 0), ("case when p_partkey % 2 = 0 then p_brand else p_type end", 1), ("case when p_partkey % 5 = 0 then null else p_type end", 2)]


@query("""select id, outcome, present, case when present then value end as value from (select id, outcome, case outcome when 'theirs' then ht when 'conflict' then hb else ho end is not null as present, case outcome when 'theirs' then t when 'conflict' then b else o end as value from
 (select *, case when same_o and same_t then 'unchanged' when same_t then 'ours' when same_o then 'theirs' when (ho is null and ht is null) or (ho is not null and ht is not null and o is not distinct from t) then 'both' else 'conflict' end as outcome from
 (select id, b, o, t, hb, ho, ht, (hb is null and ho is null) or (hb is not null and ho is not null and b is not distinct from o) as same_o, (hb is null and ht is null) or (hb is not null and ht is not null and b is not distinct from t) as same_t from
 (select coalesce(x.id, y.id, z.id) as id, x.value as b, y.value as o, z.value as t, x.id as hb, y.id as ho, z.id as ht from (%s) x full join (%s) y on x.id = y.id full join (%s) z on coalesce(x.id, y.id) = z.id))))""" % tuple(_SIDE.format(value=v, k=k) for v, k in _SIDES))
def merge_three_way(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sides = [p.where(F.col("p_partkey") % 3 == k).select((F.col("p_partkey") - F.col("p_partkey") % 3).alias("id"), F.expr(v).alias("value")) for v, k in _SIDES]
    return history.merge_three_way(*sides, ["id"])


@query("select subject, max(value) filter (field = 'click') as click, max(value) filter (field = 'view') as view, max(value) filter (field = 'purchase') as purchase from (%s) where realm = 'table' group by 1" % _REPLAY.format(where=f" where sequence <= {point_sql(5)}"), "ops")
def table_rows_at(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return history.rows_at(o, "table", point(o, 5), ["click", "view", "purchase"])


@query("""select actor, realm, x.sequence as sequence, x.verb as verb, x.subject as subject, n from (select actor, realm, arg_max({'sequence': sequence, 'verb': verb, 'subject': subject}, {'r': case verb when 'delete' then 2 when 'create' then 1 else 0 end, 's': sequence}) as x, count(*) as n from ops group by 1, 2)""", "ops")
def most_consequential(spark, sf_dir):
    rank = F.when(F.col("verb") == "delete", 2).when(F.col("verb") == "create", 1).otherwise(0)
    return history.most_consequential(src.ops(spark, sf_dir), ["actor", "realm"], rank)


@query("select commit_no, parent_no, microtime, operations, raw_bytes, stored_bytes, is_base from commits where microtime between %d and %d order by microtime desc, commit_no desc limit 100" % (START, MID), "ops", "commits")
def commit_range(spark, sf_dir):
    return report(src.commits(spark, sf_dir), ["commit_no", "parent_no", "microtime", "operations", "raw_bytes", "stored_bytes", "is_base"], [("microtime", "between", (START, MID))], ["-microtime", "-commit_no"], 100)


@query("select commit_no, stored_bytes from commits order by stored_bytes desc, commit_no limit 20", "ops", "commits")
def largest_commits(spark, sf_dir):
    return report(src.commits(spark, sf_dir), ["commit_no", "stored_bytes"], (), ["-stored_bytes", "commit_no"], 20)


@query("select c.commit_no, c.parent_no, p.microtime as parent_microtime, c.microtime - p.microtime as gap from commits c left join commits p on c.parent_no = p.commit_no", "ops", "commits")
def parent_commits(spark, sf_dir):
    c = src.commits(spark, sf_dir)
    p = c.select(F.col("commit_no").alias("parent_no"), F.col("microtime").alias("parent_microtime"))
    return c.select("commit_no", "parent_no", "microtime").join(p, "parent_no", "left").select("commit_no", "parent_no", "parent_microtime", (F.col("microtime") - F.col("parent_microtime")).alias("gap"))


@query("select outcome, c_mktsegment as segment, count(*) as n from restores left join customer on actor = c_custkey group by 1, 2", "restores")
def restores_by_actor(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor"), F.col("c_mktsegment").alias("segment"))
    return src.restores(spark, sf_dir).join(c, "actor", "left").groupBy("outcome", "segment").agg(F.count("*").alias("n"))


@query("select id, started, actor from restores where outcome = 'pending' order by started, id limit 200", "restores")
def unfinished_restores(spark, sf_dir):
    return report(src.restores(spark, sf_dir), ["id", "started", "actor"], [("outcome", "=", "pending")], ["started", "id"], 200)


# --- graph ----------------------------------------------------------------------------------------------------------

_EDGES = """e as (select commit_no as child, parent_no as parent, 0 as side from commits where parent_no is not null union all
 select c.commit_no, c.commit_no - 3, 1 from commits c where c.commit_no % 10 = 0 and exists (select 1 from commits p where p.commit_no = c.commit_no - 3))"""
_TIP = "(select max(commit_no) from commits)"


def _graph_sql(body: str, *views: str) -> str:
    head = with_views("select 1", "ops", "commits", *views).rsplit("\n", 1)[0]
    return head.replace("with ", "with recursive ", 1) + ",\n" + _EDGES + ",\n" + body


def _history(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    c = src.commits(spark, sf_dir)
    c = graph.staged(c)
    return c, graph.edges(c), c.agg(F.max("commit_no")).first()[0]


@query(_graph_sql(f"r(node, depth) as (select {_TIP}, 0 union select parent, depth + 1 from r join e on child = node) select node, cast(min(depth) as bigint) as depth from r group by 1"))
def reachable_commits(spark, sf_dir):
    c, e, tip = _history(spark, sf_dir)
    return graph.reachable(e, spark.createDataFrame([(tip,)], "node long"))


@query(_graph_sql(f"r(node, depth) as (select {_TIP}, 0 union all select parent, depth + 1 from r join e on child = node and side = 0) select node, cast(depth as bigint) as depth from r"))
def first_parents(spark, sf_dir):
    c, e, tip = _history(spark, sf_dir)
    return graph.chain(e, c, tip)


@query(_graph_sql(f"""a(node, depth) as (select {_TIP} - 5, 0 union select parent, depth + 1 from a join e on child = node), b(node) as (select {_TIP} - 9 union select parent from b join e on child = node)
 select node as commit_no, cast(min(depth) as bigint) as depth from a where node in (select node from b) group by 1 order by 2, 1 desc limit 1"""))
def merge_base(spark, sf_dir):
    c, e, tip = _history(spark, sf_dir)
    return graph.merge_base(e, tip - 9, tip - 5)


@query(_graph_sql(f"""a(node) as (select {_TIP} union select parent from a join e on child = node), b(node) as (select {_TIP} - 12 union select parent from b join e on child = node)
 select realm, subject, count(*) as n from ops where microtime // {HOUR6} in (select node from a except select node from b) group by 1, 2"""))
def touched_subjects(spark, sf_dir):
    c, e, tip = _history(spark, sf_dir)
    return graph.touched(src.ops(spark, sf_dir).withColumn("commit_no", F.expr(f"microtime div {HOUR6}")), e, tip, tip - 12)


@query(f"""select commit_no, count(case when owners = 1 then 1 end) as freed, cast(coalesce(sum(case when owners = 1 then stored end), 0) as bigint) as freed_bytes, count(case when owners > 1 then 1 end) as retained from
 (select distinct microtime // {HOUR6} as commit_no, sha256(field_json) as hash, payload_length as stored from ops) join (select sha256(field_json) as hash, count(distinct microtime // {HOUR6}) as owners from ops group by 1) using (hash) group by 1""", "ops")
def removal_cost(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return graph.removal_cost(o.select(F.expr(f"microtime div {HOUR6}").alias("commit_no"), F.sha2("field_json", 256).alias("hash"), F.col("payload_length").alias("stored")))


@query("""with f as (select o_orderkey as hash, case when o_orderstatus = 'F' then 0 else 1 end as refs, o_custkey as stored from orders)
 select * from f where refs = 0 and hash not in (select o_orderkey from orders where o_custkey % 10 = 0) and hash not in
 (select p.parent from (select o_orderkey as hash, o_orderkey - 1 as parent from orders) p where p.hash in (select hash from f where refs > 0 union select o_orderkey from orders where o_custkey % 10 = 0))""")
def collectable_frames(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    frames = o.select(F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("refs"), F.col("o_custkey").alias("stored"))
    live = o.where(F.col("o_custkey") % 10 == 0).select(F.col("o_orderkey").alias("hash"))
    return graph.collectable(frames, live, o.select(F.col("o_orderkey").alias("hash"), (F.col("o_orderkey") - 1).alias("parent")))


@query(f"""select subject, link, size from (select subject, arg_max({{'size': size}}, link) as x, max(link) as link, arg_max({{'size': size}}, link).size as size from
 (select microtime // {HOUR6} as link, subject, case when arg_max(verb, sequence) = 'delete' then null else arg_max(payload_length, sequence) end as size from ops group by 1, 2) group by 1) where size is not null""", "ops")
def resolve_anchors(spark, sf_dir):
    per = src.ops(spark, sf_dir).groupBy(F.expr(f"microtime div {HOUR6}").alias("link"), "subject").agg(F.when(F.max_by("verb", "sequence") != "delete", F.max_by("payload_length", "sequence")).alias("size"))
    return graph.resolve_anchor(per)


# --- quality and policy ---------------------------------------------------------------------------------------------

_OPEN = "(select * from findings where resolved is null)"
_RANKED = "case rung when 'observe' then 0 when 'reindex' then 1 when 'refetch' then 2 when 'rebuild' then 3 when 'quarantine' then 4 else 5 end"


@query(f"select code, max(severity) as severity, count(distinct scope) as scopes, max(created) as created, arg_max(rung, {_RANKED}) as rung, count(*) as n from {_OPEN} group by 1", "findings")
def findings_summary(spark, sf_dir):
    return quality.findings_summary(src.findings(spark, sf_dir))


@query(f"select s.severity, cast(coalesce(n, 0) as bigint) as n, coalesce(codes, 0) as codes from (select unnest(range(0, 4)) as severity) s left join (select severity, sum(n) as n, count(*) as codes from (select code, max(severity) as severity, count(*) as n from {_OPEN} group by 1) group by 1) using (severity)", "findings")
def findings_by_severity(spark, sf_dir):
    return quality.findings_by_severity(src.findings(spark, sf_dir))


@query(f"select id, code, severity, scope, created from {_OPEN} order by severity desc, created desc, id desc limit 50", "findings")
def open_findings(spark, sf_dir):
    return report(src.findings(spark, sf_dir), ["id", "code", "severity", "scope", "created"], [("resolved", "empty")], ["-severity", "-created", "-id"], 50)


@query(f"""select id, code, scope, max(severity) over w as worst, cast(max({_RANKED}) over w as bigint) as rung_no, min(created) over w as opened, coalesce(severity > max(severity) over (partition by code, scope order by created, id rows between unbounded preceding and 1 preceding), true) as announce
 from findings window w as (partition by code, scope order by created, id rows between unbounded preceding and current row)""", "findings")
def finding_ledger(spark, sf_dir):
    return quality.ledger(src.findings(spark, sf_dir))


_CLASS = "case " + " ".join(f"when regexp_matches(key, '{quality.glob(p)}') then '{c}'" for p, c in quality.RULES) + " else 'unclassified' end"


@query(f"select regexp_replace(key, ':[^:]*$', '') || ':*' as pattern, {_CLASS} as classification, count(*) as keys_seen, cast(sum(greatest(bytes, 0)) as bigint) as bytes_seen from keyspace group by 1, 2", "keyspace")
def discover_keys(spark, sf_dir):
    return quality.discover(src.keyspace(spark, sf_dir))


@query(f"select cast(count(*) as bigint) as total, cast(count(case when {_CLASS} = 'unclassified' then 1 end) as bigint) as unclassified, count(*) >= 100 and count(case when {_CLASS} = 'unclassified' then 1 end) > count(*) * 0.25 as fires from keyspace", "keyspace")
def unclassified_growth(spark, sf_dir):
    return quality.unclassified_growth(quality.discover(src.keyspace(spark, sf_dir)))


_PATTERNS = [("*", "default"), ("cache:*", "cache"), ("cache:click:*", "clicks"), ("*:view:*", "views"), ("queue:*", "queue"), ("blob:p*", "buys")]


@query("select key, x.pattern as pattern, x.classification as classification from (select key, arg_min({'pattern': pattern, 'classification': classification}, {'l': -l, 'p': pattern}) as x from (select distinct key from keyspace) join (values %s) p(pattern, classification, re, l) on regexp_matches(key, re) group by 1)" % ", ".join(f"('{p}', '{c}', '{quality.glob(p)}', {len(p.replace('*', ''))})" for p, c in _PATTERNS), "keyspace")
def stored_patterns(spark, sf_dir):
    return quality.stored_pattern(src.keyspace(spark, sf_dir), spark.createDataFrame(_PATTERNS, "pattern string, classification string"))


def _reading_sql(changed: str) -> str:
    return f"""select count(*) as row_count, max(c_custkey) as max_key, max({changed}) as max_changed,
 (select sha256(string_agg(concat(c_custkey, '|', {changed}), chr(10) order by c_custkey)) from (select * from customer order by c_custkey limit 200)) as digest from customer"""


_DRIFT = f"""select 'customer' as table_name, case when a.row_count is not distinct from b.row_count and a.max_key is not distinct from b.max_key and a.max_changed is not distinct from b.max_changed and a.digest is not distinct from b.digest then 'unchanged' else 'drifted' end as state,
 concat_ws(',', case when a.row_count is distinct from b.row_count then 'row_count' end, case when a.max_key is distinct from b.max_key then 'max_key' end, case when a.max_changed is distinct from b.max_changed then 'max_changed' end, case when a.digest is distinct from b.digest then 'digest' end) as differs
 from ({_reading_sql('c_nationkey')}) a, ({_reading_sql('(c_nationkey + 7) % 25')}) b"""


@query(_DRIFT)
def table_drift(spark, sf_dir):
    """Whole readings of a table and of what it was before a column was rewritten."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    before = c.withColumn("c_nationkey", (F.col("c_nationkey") + 7) % 25)
    return quality.drift(*(quality.reading(x, "customer", "c_custkey", "c_nationkey") for x in (c, before)))


@query("""select 'customer' as table_name, count(*) as row_count, max(c_custkey) as max_key, max(c_nationkey) as max_changed,
 (select sha256(string_agg(concat(coalesce(cast(c_custkey as varchar), ''), '|', coalesce(c_name, ''), '|', coalesce(cast(c_nationkey as varchar), ''), '|', coalesce(cast(c_acctbal as varchar), ''), '|', coalesce(c_mktsegment, '')), chr(10) order by c_custkey)) from (select * from customer order by c_custkey limit 200)) as digest from customer""")
def table_reading(spark, sf_dir):
    """Whole readings, with the digest of first rows."""
    return quality.reading(table(spark, sf_dir, "customer"), "customer", "c_custkey", "c_nationkey")


@query("""select 'c_custkey' as "column", count(*) as rows, count(distinct c_custkey) as distinct, count(*) = count(distinct c_custkey) as unique from customer union all
 select 'c_name', count(*), count(distinct c_name), count(*) = count(distinct c_name) from customer union all select 'c_nationkey', count(*), count(distinct c_nationkey), count(*) = count(distinct c_nationkey) from customer""".replace(" as rows", ' as "rows"').replace(" as distinct,", ' as "distinct",').replace(" as unique", ' as "unique"'))
def identity_columns(spark, sf_dir):
    return quality.identity_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey"])


@query("select subject from (select subject, row_number() over (order by subject) - 1 as r, count(*) over () as n from (select distinct subject from ops)) where r % greatest(1, n // 25) = 0 and r < greatest(1, n // 25) * 25", "ops")
def drill_sample(spark, sf_dir):
    return quality.stride_sample(src.ops(spark, sf_dir).select("subject").distinct(), "subject", 25)


@query(f"select a.realm, a.subject, count(*) as compared, count(case when a.value is distinct from b.value then 1 end) as differed, case when count(case when a.value is distinct from b.value then 1 end) > 0 then 'fail' else 'pass' end as verdict from ({_REPLAY.format(where=f' where sequence <= {point_sql(9)}')}) a join ({_REPLAY.format(where='')}) b on a.realm = b.realm and a.subject = b.subject and a.field = b.field group by 1, 2", "ops")
def drill_compare(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return quality.drill(history.replay(o, point(o, 9)), history.replay(o), ["realm", "subject"])


_LAG = "(select (max(microtime) - (select max(microtime) from ops where sequence <= (select max(sequence) // 2 from ops))) // 1000000 from ops)"


@query(f"""select code, severity, rung from (select 'commit.parent_missing' as code, 3 as severity, 'quarantine' as rung, (select count(*) from commits where parent_no is null) > 1 as fires
 union all select 'delta.chain_too_deep', 1, 'observe', (select max(n) - 1 from (select count(*) as n from ops group by realm, subject)) > 32
 union all select 'flush.stale', 1, 'observe', {_LAG} > 86400
 union all select 'watermark.drift', 1, 'observe', (select state from ({_DRIFT})) = 'drifted'
 union all select 'classification.unclassified_growth', 1, 'observe', (select count(case when {_CLASS} = 'unclassified' then 1 end) * 4 > count(*) and count(*) >= 100 from keyspace)) where fires""", "ops", "commits", "keyspace")
def trip_wires(spark, sf_dir):
    """What the tables show: roots but the first, versions of a subject as the chain that deltas would form, time since half of
    the journal was sealed, drift, and keys without a class. No table has frames without index or cut segments, so these wires see 0."""
    o = src.ops(spark, sf_dir)
    half = point(o, 5)
    roots = src.commits(spark, sf_dir).agg((F.count_if(F.col("parent_no").isNull()) - 1).alias("missing_parents"))
    depth = o.groupBy("realm", "subject").count().agg((F.max("count") - 1).alias("deepest"))
    lag = o.agg(F.expr(f"(max(microtime) - max(microtime) filter (where sequence <= {half})) div 1000000").alias("lag_seconds"))
    drifted = table_drift(spark, sf_dir).agg(F.count_if(F.col("state") == "drifted").alias("drifted"))
    keys = quality.unclassified_growth(quality.discover(src.keyspace(spark, sf_dir))).select((F.col("total") - F.col("unclassified")).alias("classified"), "unclassified")
    seen = roots.crossJoin(depth).crossJoin(lag).crossJoin(drifted).crossJoin(keys)  # a row each
    return quality.tripwires(seen.select("*", *[F.lit(0).alias(k) for k in ("missing_frames", "unindexed", "short_segments")]))


@query(f"select o_orderkey as id, age, case {' '.join(f'when age >= {a} then {t}' for t, a in reversed(policy.TIERS[1:]))} else 0 end as tier from (select o_orderkey, 1000000000 - epoch_us(o_orderdate) // 1000000 as age from orders)")
def tier_for_age(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.lit(1_000_000_000) - F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000")).alias("age"))
    return o.withColumn("tier", policy.tier_for_age(F.col("age")))


_OBJECTS = "select concat('seg/', cast(o_orderkey as varchar)) as object_key, o_orderkey % 2 as tier, o_custkey as bytes, epoch_us(o_orderdate) // 1000000 as recorded from orders"


@query(f"""select object_key, tier, tier + 1 as target, bytes, cast(running as bigint) as running from (select *, sum(bytes) over (partition by tier order by recorded // 86400, recorded, object_key rows between unbounded preceding and current row) as running
 from (select *, case {' '.join(f'when 1000000000 - recorded >= {a} then {t}' for t, a in reversed(policy.TIERS[1:]))} else 0 end as wanted from ({_OBJECTS})) where wanted > tier) where running <= 500000""")
def tier_promotions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("seg/"), F.col("o_orderkey").cast("string")).alias("object_key"), (F.col("o_orderkey") % 2).alias("tier"), F.col("o_custkey").alias("bytes"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("recorded"))
    return policy.plan_promotions(o, 1_000_000_000, 500_000)


@query("select t.tier, count(*) as objects, cast(sum(bytes) as bigint) as bytes, count(case when unplaced then 1 end) as unplaced from (select o_custkey as bytes, o_orderkey % 7 = 0 as unplaced, case when o_orderkey % 7 = 0 then [0, 1, 2, 3] else [cast(o_orderkey % 4 as integer)] end as ts from orders where o_orderstatus = 'P'), unnest(ts) t(tier) group by 1")
def tiers_needed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_key"), F.col("o_custkey").alias("bytes"), "o_orderstatus")
    placed = o.where(F.col("object_key") % 7 != 0).select("object_key", (F.col("object_key") % 4).alias("tier"))
    return policy.tiers_needed(o.where("o_orderstatus = 'P'"), placed)


@query("select level, second, due, case when due then second - second % (case level when 0 then 60 when 1 then 3600 when 2 then 86400 else 2592000 end) end as target from (select *, level < 4 and second + (case level when 0 then 3600 when 1 then 86400 when 2 then 604800 else 7776000 end) <= 1706000000 as due from (select distinct event_id % 5 as level, epoch_us(ts) // 1000000 as second from events))")
def rollups_due(spark, sf_dir):
    seg = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("level"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("second")).distinct()
    return policy.due_for_rollup(seg, 1_706_000_000)


@query("select day, requests, round(greatest(bytes / 2000.0, requests * 2630016.0 / 86400 / 1500.0), 6) as share, case when greatest(bytes / 2000.0, requests * 2630016.0 / 86400 / 1500.0) >= 1.5 then 'pause_all' when round(greatest(bytes / 2000.0, requests * 2630016.0 / 86400 / 1500.0), 6) >= 1.25 then 'pause_files' when round(greatest(bytes / 2000.0, requests * 2630016.0 / 86400 / 1500.0), 6) >= 1.0 then 'slow' when round(greatest(bytes / 2000.0, requests * 2630016.0 / 86400 / 1500.0), 6) >= 0.8 then 'warn' else 'none' end as action from (select day, cast(sum(requests) as bigint) as requests, cast(sum(bytes) as bigint) as bytes from provider_stat group by 1)", "provider_stat")
def budget_by_day(spark, sf_dir):
    use = src.provider_stat(spark, sf_dir).groupBy("day").agg(F.sum("requests").cast("long").alias("requests"), F.sum("bytes").cast("long").alias("bytes"))
    return policy.assess_budget(use, "bytes", "requests", F.lit(86_400), 2000.0, 1500.0).drop("bytes")


@query("select realm, writes, subjects, round(case when subjects <= 1 then least(writes, subjects) else subjects * (1 - exp(writes * ln(1 - 1 / subjects))) end, 4) as net from (select realm, count(*) as writes, count(distinct subject) as subjects from ops group by 1)", "ops")
def expected_net_operations(spark, sf_dir):
    shape = src.ops(spark, sf_dir).groupBy("realm").agg(F.count("*").alias("writes"), F.count_distinct("subject").alias("subjects"))
    return shape.withColumn("net", F.round(policy.expected_distinct(F.col("writes"), F.col("subjects")), 4))


@query("select provider, round(greatest(bytes / 1e9 - 0.0, 0.0) * 0.023 + greatest(w - 1000.0, 0.0) / 1e6 * 5.0 + greatest(r - 2000.0, 0.0) / 1e6 * 0.4, 6) as dollars from (select provider, sum(bytes) as bytes, sum(case when operation in ('get', 'head') then 0 else requests end) as w, sum(case when operation in ('get', 'head') then requests else 0 end) as r from provider_stat group by 1)", "provider_stat")
def monthly_cost(spark, sf_dir):
    use = provider_classes(spark, sf_dir).join(provider_by_provider(spark, sf_dir).select("provider", "bytes"), "provider")
    return use.select("provider", F.round(policy.monthly_cost(F.col("bytes"), F.col("class_a"), F.col("class_b"), {"gb": 0.023, "writes": 5.0, "reads": 0.4, "free_writes": 1000, "free_reads": 2000}), 6).alias("dollars"))


# --- functions ------------------------------------------------------------------------------------------------------

_HUMAN = "case " + " ".join(f"when n >= {1024**p} then concat(cast((n * 10 // {1024**p}) // 10 as varchar), '.', cast((n * 10 // {1024**p}) % 10 as varchar), ' {u}')" for p, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + " else concat(cast(n as varchar), ' B') end"
_LASTS = "case when s >= 86400 then concat(cast(s // 86400 as varchar), 'd ', cast(s % 86400 // 3600 as varchar), 'h') when s >= 3600 then concat(cast(s // 3600 as varchar), 'h ', cast(s % 3600 // 60 as varchar), 'm') when s >= 60 then concat(cast(s // 60 as varchar), 'm ', cast(s % 60 as varchar), 's') else concat(cast(s as varchar), 's') end"


@query(f"select id, {_HUMAN} as size, {_LASTS} as lasts, strftime(make_timestamp(microtime), '%Y-%m-%d %H:%M:%S.%g') as moment, concat(substr(h, 1, 2), '/', substr(h, 3, 2), '/', h) as path from (select sequence as id, sequence * sequence * 977 as n, sequence * 61 as s, microtime, sha256(subject) as h from ops)", "ops")
def readable(spark, sf_dir):
    o = src.ops(spark, sf_dir).select(F.col("sequence").alias("id"), (F.col("sequence") * F.col("sequence") * 977).alias("n"), (F.col("sequence") * 61).alias("s"), "microtime", F.sha2("subject", 256).alias("h"))
    return o.select("id", tx.human_bytes(F.col("n")).alias("size"), tx.human_duration(F.col("s")).alias("lasts"), tx.moment(F.col("microtime")).alias("moment"), store.shard_path(F.col("h")).alias("path"))


@query("select l_linestatus, l_returnflag, count(*) as n, cast(sum(cast(trunc(l_quantity) as bigint)) as bigint) as quantity from lineitem group by 1, 2")
def shipments(spark, sf_dir):
    """Plain grouped sums over the largest table, the bench's scan and aggregate figure."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).cast("long").alias("quantity"))


# --- without SQL ----------------------------------------------------------------------------------------------------


@query()
def content_chunks(spark, sf_dir):
    return coding.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def delta_coding(spark, sf_dir):
    return coding.delta_sizes(history.previous_version(src.ops(spark, sf_dir)), "sequence", "field_json", "previous")


@query()
def line_differences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") - F.col("doc_id") % 2).alias("id"), "doc_id", "text")
    pairs = d.groupBy("id").agg(F.min_by("text", "doc_id").alias("before"), F.max_by("text", "doc_id").alias("after"))
    return coding.line_diff(pairs, "id", "before", "after")
