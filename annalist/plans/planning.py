"""Queries of plans, capture, reachability and placement, with their SQL; importing this adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import capture, graph, history, payloads, planning, policy, quality, store
from ..sources import files
from ..sources import history as src
from ..sources.history import table, with_views
from .queries import _CLASS, _EDGES, _REPLAY, _TIP, HOUR6, ORACLE_SQL, QUERIES, _history, point, point_sql, query
from .report import report

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- restores -------------------------------------------------------------------------------------------------------

_SEEN = "(select sequence, microtime, case when realm = 'state' and actor = 3 then 'ephemeral' else realm end as realm, subject, verb, field, case when sequence % 3 = 0 then null else field_json end as field_json, sequence % 40 != 7 and subject not like '%1' as readable from ops)"
_GONE = "verb in ('delete', 'truncate')"
_PLAN = f"""(select *, status = 'restorable' as writable, case status when 'unrestorable' then 'nothing_usable' when 'degraded' then 'partly_unreadable' end as skipped from (select *, case when versions = 0 then 'unrestorable' when unreadable = 0 then 'restorable' else 'degraded' end as status from
 (select realm, subject, coalesce(arg_max(verb not in ('delete', 'truncate'), sequence) filter (where {_GONE} or field_json is null or readable), false) as exists_, count(case when {_GONE} or (field_json is not null and readable) then 1 end) as versions, count(case when not ({_GONE}) and field_json is not null and not readable then 1 end) as unreadable
 from {_SEEN} where sequence <= {point_sql(7)} and realm != 'ephemeral' group by 1, 2 having arg_max(verb, sequence) != 'delete')))"""


def _seen(spark, sf_dir):
    """The journal with an ephemeral realm, operations without payload and unreadable ones."""
    o = src.ops(spark, sf_dir)
    realm = F.when((F.col("realm") == "state") & (F.col("actor") == 3), "ephemeral").otherwise(F.col("realm"))
    return o.withColumn("realm", realm).withColumn("field_json", F.when(F.col("sequence") % 3 != 0, F.col("field_json"))).withColumn("readable", (F.col("sequence") % 40 != 7) & ~F.col("subject").endswith("1"))


def _plan(spark, sf_dir):
    o = _seen(spark, sf_dir)
    return planning.restore_plan(o, point(o, 7), commit=F.expr(f"microtime div {HOUR6}"))


@query(f'select realm, subject, exists_ as "exists", versions, unreadable, status, writable, skipped, (select count(distinct microtime // {HOUR6}) from ops where sequence <= {point_sql(7)}) as depth from {_PLAN}', "ops")
def restore_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""select realm, subject, coalesce(exists_, false) as "exists", coalesce(versions, 0) as versions, coalesce(unreadable, 0) as unreadable, coalesce(status, 'unrestorable') as status, coalesce(writable, false) as writable,
 case when realm = 'ephemeral' then 'realm_not_restored' when status is null then 'nothing_usable' else skipped end as skipped from (select distinct realm, subject from {_SEEN} where sequence > {point_sql(9)}) left join {_PLAN.replace("having arg_max(verb, sequence) != 'delete'", "")} using (realm, subject)""", "ops")
def restore_plan_of_named(spark, sf_dir):
    """A plan of just the subjects that the last tenth of the journal touches, there or not at the target."""
    o = _seen(spark, sf_dir)
    named = o.where(F.col("sequence") > point(o, 9)).select("realm", "subject")
    return planning.restore_plan(o, point(o, 7), named=named).drop("depth")


@query(f"select s.status, count(p.status) as n from (values ('restorable'), ('degraded'), ('unrestorable')) s(status) left join {_PLAN} p on p.status = s.status group by 1", "ops")
def restore_plan_counts(spark, sf_dir):
    return planning.counted(_plan(spark, sf_dir), "status", planning.STATUSES)


_PLANNED = f"(select max(microtime) from ops where sequence <= {point_sql(8)})"


@query(f"select realm, subject, max(microtime) as changed_at from {_SEEN} join (select realm, subject from {_PLAN} where writable) using (realm, subject) where microtime > {_PLANNED} group by 1, 2", "ops")
def concurrent_changes(spark, sf_dir):
    """What a plan would write and somebody changed between the plan, at eight tenths of the journal, and its end."""
    o = _seen(spark, sf_dir)
    planned = o.where(F.col("sequence") <= point(o, 8)).agg(F.max("microtime")).first()[0]
    return planning.concurrent_changes(_plan(spark, sf_dir), o, planned or 0)


@query("""select target, refused_by, quarantined_by, refused_by is not null or quarantined_by is not null as held from
 (select target, cast(null as varchar) as refused_by, min(code) as quarantined_by from (values ('scope:1'), ('scope:10'), ('scope:12'), ('scope:123'), ('other')) t(target)
 left join (select * from findings where resolved is null and rung = 'quarantine') on scope = target or (length(target) >= 8 and starts_with(scope, target)) group by 1)""", "findings")
def restore_holds(spark, sf_dir):
    """Targets against open findings, without those at refuse, which would hold all."""
    targets = spark.createDataFrame([(t,) for t in ("scope:1", "scope:10", "scope:12", "scope:123", "other")], "target string")
    return planning.restore_holds(targets, src.findings(spark, sf_dir).where("rung != 'refuse'"))


@query("select outcome, cast(max(started) as bigint) as newest, arg_max(id, {'s': started, 'i': id}) as id, count(*) as n from restores group by 1", "restores")
def restore_log(spark, sf_dir):
    """The restore log by outcome."""
    return src.restores(spark, sf_dir).groupBy("outcome").agg(F.max("started").alias("newest"), F.max_by("id", F.struct("started", "id")).alias("id"), F.count("*").alias("n"))


# --- branches and merges --------------------------------------------------------------------------------------------

_SPLIT = "(select max(commit_no) from commits where commit_no <= (select (min(commit_no) + max(commit_no)) // 2 from commits))"
_BRANCHED = f"""be as (select commit_no as child, case when commit_no <= {_SPLIT} then parent_no else coalesce(lag(commit_no) over (partition by commit_no > {_SPLIT}, commit_no % 2 order by commit_no), {_SPLIT}) end as parent from commits),
 ro(node) as (select max(commit_no) from commits where commit_no % 2 = 0 union select parent from ro join be on child = node where parent is not null),
 rt(node) as (select max(commit_no) from commits where commit_no % 2 = 1 union select parent from rt join be on child = node where parent is not null),
 rb as (select node from ro intersect select node from rt)"""


def _merge_sql(body: str) -> str:
    head = with_views("select 1", "ops", "commits").rsplit("\n", 1)[0]
    return head.replace("with ", "with recursive ", 1) + ",\n" + _BRANCHED + ",\n" + body


def _at(name: str) -> str:
    return "(" + _REPLAY.format(where=f" where realm = 'config' and microtime // {HOUR6} in (select node from {name})") + ")"


_MERGE = f"""touched as (select distinct subject from ops where realm = 'config' and microtime // {HOUR6} in ((select node from ro union select node from rt) except select node from rb)),
 cells as (select coalesce(b.subject, o.subject, t.subject) as subject, b.sequence is not null as hb, o.sequence is not null as ho, t.sequence is not null as ht, b.value as vb, o.value as vo, t.value as vt
  from {_at('rb')} b full join {_at('ro')} o on b.subject = o.subject and b.field = o.field full join {_at('rt')} t on coalesce(b.subject, o.subject) = t.subject and coalesce(b.field, o.field) = t.field),
 moved as (select *, (ho != hb or vo is distinct from vb) as om, (ht != hb or vt is distinct from vb) as tm, (ho != ht or vo is distinct from vt) as ot from cells),
 objects as (select subject, bool_or(hb) as b, bool_or(ho) as o, bool_or(ht) as t, bool_or(om) as om, bool_or(tm) as tm, bool_or(ot) as ot, count(case when (ho or ht) and om and tm and ot then 1 end) as n_conflict,
  count(case when (ho or ht) and om and not tm then 1 end) as from_ours, count(case when (ho or ht) and tm and not om then 1 end) as from_theirs from moved group by 1),
 plan as (select subject as object, case when not o and not t then 'unchanged' when not t and o and b and not om then 'theirs' when not t then 'conflict' when not o and not b then 'theirs' when not o and not tm then 'ours' when not o then 'conflict'
  when not b and ot then 'conflict' when n_conflict > 0 then 'conflict' when from_theirs = 0 and from_ours = 0 then 'unchanged' when from_theirs = 0 then 'ours' when from_ours = 0 then 'theirs' else 'merged' end as outcome,
  case when (o and t and b) or (o and t and not ot) then n_conflict else 1 end as n_conflict, from_ours, from_theirs from objects),
 full_plan as (select u.subject as object, coalesce(outcome, 'unchanged') as outcome, cast(case when outcome = 'conflict' then n_conflict else 0 end as bigint) as conflicts, coalesce(from_ours, 0) as from_ours, coalesce(from_theirs, 0) as from_theirs,
  coalesce(outcome, 'unchanged') != 'conflict' as resolved from touched u left join plan on object = u.subject)"""


def _branches(spark, sf_dir):
    """A history that parts at its middle into commits of even and of odd numbers, and the journal by commit."""
    from pyspark.sql import Window

    c = graph.staged(src.commits(spark, sf_dir))
    low, high = c.agg(F.min("commit_no"), F.max("commit_no")).first()
    split = c.where(F.col("commit_no") <= (low + high) // 2).agg(F.max("commit_no")).first()[0]
    w = Window.partitionBy(F.col("commit_no") > split, F.col("commit_no") % 2).orderBy("commit_no")
    parent = F.when(F.col("commit_no") <= split, F.col("parent_no")).otherwise(F.coalesce(F.lag("commit_no").over(w), F.lit(split)))
    edges = c.select(F.col("commit_no").alias("child"), parent.alias("parent"), F.lit(0).alias("side")).where("parent is not null")
    ours, theirs = (c.where(F.col("commit_no") % 2 == k).agg(F.max("commit_no")).first()[0] for k in (0, 1))
    return src.ops(spark, sf_dir).withColumn("commit_no", F.expr(f"microtime div {HOUR6}")), planning.branch_sets(edges, ours, theirs)


@query(_merge_sql(_MERGE + "\nselect * from full_plan"))
def merge_plan(spark, sf_dir):
    return planning.merge_plan(*_branches(spark, sf_dir))


@query(_merge_sql(_MERGE + "\nselect s.outcome, count(p.outcome) as n from (values ('unchanged'), ('ours'), ('theirs'), ('merged'), ('conflict')) s(outcome) left join full_plan p on p.outcome = s.outcome group by 1"))
def merge_plan_counts(spark, sf_dir):
    return planning.counted(planning.merge_plan(*_branches(spark, sf_dir)), "outcome", planning.OUTCOMES)


@query(_merge_sql(f"""t as (select distinct realm, subject from ops where realm != 'config' and microtime // {HOUR6} in (select node from rt except select node from rb))
 select realm, count(*) as subjects, array_to_string(list(subject order by subject)[1:20], ',') as named, cast(count(*) - least(count(*), 20) as bigint) as more from t group by 1"""))
def merge_refusals(spark, sf_dir):
    return planning.merge_refusals(*_branches(spark, sf_dir)).withColumn("named", F.array_join("named", ",")).withColumn("more", F.col("more").cast("long"))


# --- capture --------------------------------------------------------------------------------------------------------

_VERSIONS = "select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as version, l_returnflag as flag, l_linestatus as status, cast(cast(l_quantity as bigint) % 3 as varchar) as quantity, cast(l_suppkey % 2 as varchar) as access, cast(l_partkey as varchar) as changed from lineitem"
_DIFFERS = " ".join(f"case when version = 1 or {f} is distinct from p_{f} then '{f}' end," for f in ("flag", "status", "quantity"))[:-1]
_PAYLOAD = " ".join(f"case when version = 1 or {f} is distinct from p_{f} then '{f}=' || {f} end," for f in ("flag", "status", "quantity"))[:-1]


@query(f"""select id, version, case when version = 1 then 'create' else 'update' end as verb, concat_ws(',', {_DIFFERS}) as changed, concat_ws(',', {_PAYLOAD}) as payload,
 version > 1 and concat_ws(',', {_DIFFERS}) = '' and access is distinct from p_access as touch
 from (select *, {', '.join(f'lag({f}) over (partition by id order by version) as p_{f}' for f in ('flag', 'status', 'quantity', 'access'))} from ({_VERSIONS}))""")
def captured_rows(spark, sf_dir):
    """Lines of an order as versions of one row."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("version"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        (F.col("l_quantity").cast("long") % 3).alias("quantity"), (F.col("l_suppkey") % 2).alias("access"), F.col("l_partkey").alias("changed"),
    )
    out = capture.row_changes(rows, ["id"], ["version"], ["flag", "status", "quantity", "access", "changed"], access=("access",))
    pairs = F.transform("changed", lambda f: F.concat(f, F.lit("="), F.element_at("payload", f)))
    return out.select("id", "version", "verb", F.array_join("changed", ",").alias("changed"), F.array_join(pairs, ",").alias("payload"), "touch")


@query("select subject, sequence, case when v is null then 'delete' when before is null then 'create' else 'update' end as verb, v as value from (select *, lag(v) over (partition by subject order by sequence) as before from (select subject, sequence, case when verb != 'delete' then field_json end as v from ops where realm = 'state'))", "ops")
def captured_keys(spark, sf_dir):
    o = src.ops(spark, sf_dir).where("realm = 'state'").select("subject", "sequence", F.when(F.col("verb") != "delete", F.col("field_json")).alias("value"))
    return capture.key_writes(o, ["subject"], ["sequence"], "value")


_HEADS = "case actor when 0 then 'own_log' when 1 then 'cache_render' when 2 then 'cachetags' else 'node' end"


@query(f"select realm, head, count(*) as n from (select realm, {_HEADS} as head from ops) where realm in ('entity', 'table') and not (realm = 'entity' and head = 'own_log') and not (realm = 'table' and (starts_with(head, 'own_') or starts_with(head, 'cache_') or head = 'cachetags')) group by 1, 2", "ops")
def scoped_operations(spark, sf_dir):
    """Operations in scope by realm and kind of subject."""
    o = src.ops(spark, sf_dir).withColumn("head", F.expr(_HEADS)).withColumn("subject", F.concat_ws(":", "head", "subject"))
    return o.where(capture.in_scope(("entity", "table"), ("own_log",), "own_")).groupBy("realm", "head").agg(F.count("*").alias("n"))


_SINCE = [("user", 1_704_067_200), ("user:3", 1_706_000_000), ("user:7", 1_706_745_000), ("use", 0), ("user:11", 1_706_300_000)]


@query("select table_name, since, coalesce((select max(microtime) from ops where realm in ('table', 'schema') and (subject = table_name or starts_with(subject, table_name || ':'))) >= since * 1000000, false) as captured from (values %s) t(table_name, since)" % ", ".join(f"('{t}', cast({s} as bigint))" for t, s in _SINCE), "ops")
def captured_since(spark, sf_dir):
    return capture.captured_since(src.ops(spark, sf_dir), spark.createDataFrame(_SINCE, "table_name string, since long"))


@query("select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem where l_shipdate >= timestamp '1998-06-01' order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_shipdate desc limit 500")
def drifted_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("k"))
    return capture.drifted_rows(li, "k", "l_shipdate", F.lit("1998-06-01").cast("timestamp_ntz")).drop("k")


# --- reachability ---------------------------------------------------------------------------------------------------

_FRAMES = """fr as (select p_partkey as hash, case when p_size > 5 and p_partkey > 0 then p_partkey - 1 end as parent from part),
 d(hash, depth) as (select hash, 0 from fr where parent is null union all select fr.hash, d.depth + 1 from d join fr on fr.parent = d.hash)"""


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), F.when((F.col("p_size") > 5) & (F.col("p_partkey") > 0), F.col("p_partkey") - 1).alias("parent"))


@query(f"with recursive {_FRAMES} select hash, cast(depth as bigint) as depth from d")
def chain_depths(spark, sf_dir):
    return graph.chain_depths(_frames(spark, sf_dir))


@query(f"with recursive {_FRAMES} select hash, cast(depth as bigint) as depth from d where depth >= 8 order by depth desc, hash limit 100")
def deepest_chains(spark, sf_dir):
    return graph.deepest_chains(graph.chain_depths(_frames(spark, sf_dir)), 8)


@query(f"""with recursive {_FRAMES}, alone as (select hash from d where depth > 12 order by depth desc, hash limit 200), f2 as (select hash, case when hash in (select hash from alone) then null else parent end as parent from fr),
 d2(hash, depth) as (select hash, 0 from f2 where parent is null union all select f2.hash, d2.depth + 1 from d2 join f2 on f2.parent = d2.hash) select hash, cast(d.depth as bigint) as "before", cast(d2.depth as bigint) as "after" from d join d2 using (hash) where d.depth > 0""")
def reanchored(spark, sf_dir):
    return graph.reanchor(_frames(spark, sf_dir), cap=12)


@query(with_views("select 1", "ops").rsplit("\n", 1)[0].replace("with ", "with recursive ", 1) + """, f as (select realm as history, max(microtime) as microtime from ops group by realm, microtime // 3600000000),
 n as (select *, min(microtime) over (partition by history order by microtime range between 14400000000 following and unbounded following) as next from f),
 a(history, microtime, number) as (select history, min(microtime), 0 from f group by 1 union all select n.history, n.next, a.number + 1 from a join n on n.history = a.history and n.microtime = a.microtime where n.next is not null)
 select history, microtime, cast(number as bigint) as number, number % 24 = 0 as "full" from a""")
def anchors_due(spark, sf_dir):
    o = src.ops(spark, sf_dir)
    return graph.anchors_due(o.groupBy(F.col("realm").alias("history"), F.expr("microtime div 3600000000")).agg(F.max("microtime").alias("microtime")))


_LIVE = f"""anchors as (select commit_no, commit_no as anchor, row_number() over (order by commit_no) as r, lag(commit_no) over (order by commit_no) as before from commits where is_base = 1),
 ap as (select anchor as child, before as parent from anchors where r % 3 != 1),
 fp as (select distinct sequence % 4000 as child, sequence % 4000 - 1 as parent from ops where sequence % 4000 % 5 != 0),
 di as (select distinct sequence % 4000 as frame, sequence % 4000 % 7 as dictionary from ops where sequence % 4000 % 2 = 0),
 names as (select distinct 'commit' as kind, microtime // {HOUR6} as owner, sequence % 4000 as frame from ops where sequence % 9 != 0 union all select distinct 'anchor', microtime // {HOUR6}, sequence % 4000 from ops where sequence % 9 = 0),
 rc(node) as (select {_TIP} - 30 union select parent from rc join e on child = node),
 ra(node) as (select anchor from anchors where commit_no in (select node from rc) union select parent from ra join ap on child = node),
 rf(node) as (select frame from names where (kind = 'commit' and owner in (select node from rc)) or (kind = 'anchor' and owner in (select node from ra)) union select parent from rf join fp on child = node),
 live as (select 'commit' as kind, node as id from rc union all select 'anchor', node from ra union all select 'frame', node from rf union all select 'dictionary', dictionary from (select distinct dictionary from di where frame in (select node from rf))),
 present as (select 'commit' as kind, commit_no as id from commits where commit_no % 50 != 17 union all select 'anchor', anchor from anchors where r != 2 union all select distinct 'frame', sequence % 4000 from ops where sequence % 4000 % 97 != 3 union all select distinct 'dictionary', dictionary from di where dictionary != 5)"""


def _live_sql(body: str) -> str:
    head = with_views("select 1", "ops", "commits").rsplit("\n", 1)[0]
    return head.replace("with ", "with recursive ", 1) + ",\n" + _EDGES + ",\n" + _LIVE + "\n" + body


def _objects(spark, sf_dir):
    """Edges, refs, live and present objects, delta parents and dictionaries of a store in which some objects are missing."""
    from pyspark.sql import Window

    c, e, tip = _history(spark, sf_dir)
    o = src.ops(spark, sf_dir).select("sequence", F.expr(f"microtime div {HOUR6}").alias("owner"), (F.col("sequence") % 4000).alias("frame"))
    w = Window.orderBy("commit_no")  # a row an anchor
    a = c.where("is_base = 1").select("commit_no", F.col("commit_no").alias("anchor"), F.row_number().over(w).alias("r"), F.lag("commit_no").over(w).alias("before"))
    ap = a.where("r % 3 != 1").select(F.col("anchor").alias("child"), F.col("before").alias("parent"))
    frames = o.select("frame").distinct()
    fp = frames.where("frame % 5 != 0").select(F.col("frame").alias("child"), (F.col("frame") - 1).alias("parent"))
    di = frames.where("frame % 2 = 0").select("frame", (F.col("frame") % 7).alias("dictionary"))
    names = o.select(F.when(F.col("sequence") % 9 != 0, "commit").otherwise("anchor").alias("kind"), "owner", "frame").distinct()
    refs = spark.createDataFrame([(tip - 30,)], "node long")
    live = graph.live_objects(e, refs, a, ap, names, fp, di)
    kind = lambda k, df: df.select(F.lit(k).alias("kind"), df.columns[0]).toDF("kind", "id")
    present = kind("commit", c.where("commit_no % 50 != 17").select("commit_no")).union(kind("anchor", a.where("r != 2").select("anchor"))).union(kind("frame", frames.where("frame % 97 != 3"))).union(kind("dictionary", di.where("dictionary != 5").select("dictionary").distinct()))
    return e, refs, live, present, fp, di, frames


@query(_live_sql("select kind, id from live"))
def live_objects(spark, sf_dir):
    return _objects(spark, sf_dir)[2]


@query(_live_sql("select count(case when kind = 'commit' then 1 end) as commits, count(case when kind = 'anchor' then 1 end) as anchors, count(case when kind = 'frame' then 1 end) as frames, count(case when kind = 'dictionary' then 1 end) as dictionaries, count(case when (kind, id) not in (select (kind, id) from present) then 1 end) as unreadable from live"))
def live_counts(spark, sf_dir):
    _, _, live, present, *_ = _objects(spark, sf_dir)
    return graph.live_counts(live, present)


@query(_live_sql("""select p.kind, p.id, case when l.id is not null then case p.kind when 'commit' then 'reached from a ref' when 'anchor' then 'a reachable commit needs it' when 'frame' then 'a live object names it' else 'a live frame needs it' end
 when r.n > 0 then concat(r.n, ' referenced frames need it') end as reason from present p left join live l on l.kind = p.kind and l.id = p.id left join (select 'dictionary' as kind, dictionary as id, count(*) as n from di where frame % 3 = 0 group by 2) r on r.kind = p.kind and r.id = p.id"""))
def live_reasons(spark, sf_dir):
    _, _, live, present, _, di, _ = _objects(spark, sf_dir)
    return graph.reasons(present, live, di.where("frame % 3 = 0").groupBy(F.col("dictionary").alias("id")).agg(F.count("*").alias("n")))


@query(_live_sql("""select case kind when 'dictionary' then 'dict.missing' else concat(kind, '.missing') end as code, id as scope from live where kind != 'commit' and (kind, id) not in (select (kind, id) from present)
 union all select 'ref.missing', x from (select """ + _TIP + """ - 30 as x) where x not in (select id from present where kind = 'commit')
 union all select distinct 'commit.parent_missing', child from e where child in (select node from rc) and parent not in (select id from present where kind = 'commit')
 union all select 'delta.parent_missing', child from fp where child in (select node from rf) and parent not in (select id from present where kind = 'frame')
 union all select 'delta.chain_too_deep', child from fp where child in (select node from rf) and child % 5 > 3
 union all select 'frame.hash_mismatch', frame from (select distinct sequence % 4000 as frame from ops) where frame in (select node from rf) and frame % 301 = 0"""))
def verify_sweep(spark, sf_dir):
    """Findings over a store with missing objects, cut bodies and, at a cap of 3, chains that are too deep."""
    e, refs, live, present, fp, _, frames = _objects(spark, sf_dir)
    body = F.col("frame").cast("string")
    contents = frames.select("frame", F.when(F.col("frame") % 301 == 0, F.lit("cut")).otherwise(body).alias("body"), F.sha2(body, 256).alias("digest"))
    return graph.verify(e, refs, live, present, fp, contents, cap=3)


@query("select dictionary, count(*) as frames from (select p_brand as dictionary, p_size % 4 as refs from part where p_size % 3 != 0) where refs > 0 group by 1")
def frames_per_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("dictionary"), (F.col("p_size") % 4).alias("refs"))
    return store.frames_per_dictionary(p)


# --- tiers, allowances, readings ------------------------------------------------------------------------------------

_FREE = {"storage": 200_000, "writes": 25_000, "reads": 12_000}
_USE = "(select provider, cast(sum(bytes) as bigint) as storage, cast(sum(case when operation in ('get', 'head') then 0 else requests end) as bigint) as writes, cast(sum(case when operation in ('get', 'head') then requests else 0 end) as bigint) as reads from provider_stat group by 1)"


@query("select provider, storage, writes, reads, " + ", ".join(f"round({a} / {n}.0, 6) as {a}_share" for a, n in _FREE.items()) + ", " + ", ".join(f"greatest(0, {n} - {a}) as {a}_left" for a, n in _FREE.items()) + f""", storage <= {_FREE['storage']} and writes <= {_FREE['writes']} and reads <= {_FREE['reads']} as fits,
 case greatest({', '.join(f'{a} / {n}.0' for a, n in _FREE.items())}) {' '.join(f"when {a} / {n}.0 then '{a}'" for a, n in _FREE.items())} end as binding from {_USE}""", "provider_stat")
def free_use(spark, sf_dir):
    return policy.free_use(_provider_use(spark, sf_dir), _FREE)


def _provider_use(spark, sf_dir):
    reading = F.col("operation").isin("get", "head")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return src.provider_stat(spark, sf_dir).groupBy("provider").agg(total("bytes").alias("storage"), total(F.when(~reading, F.col("requests")).otherwise(0)).alias("writes"), total(F.when(reading, F.col("requests")).otherwise(0)).alias("reads"))


@query(with_views("select 1", "ops").rsplit("\n", 1)[0].replace("with ", "with recursive ", 1) + """, s as (select realm, count(*) as w, count(distinct subject) as n, cast(sum(payload_length) as bigint) as b from ops group by 1),
 h(realm, low, high, step) as (select realm, cast(1 as bigint), cast(100000000 as bigint), 0 from s union all
 select s.realm, case when high - low > 1 and b * ((low + high) // 2) <= 10000000000 and w * ((low + high) // 2) <= 1000000000 and n * ((low + high) // 2) <= 10000000 then (low + high) // 2 else low end,
  case when high - low > 1 and not (b * ((low + high) // 2) <= 10000000000 and w * ((low + high) // 2) <= 1000000000 and n * ((low + high) // 2) <= 10000000) then (low + high) // 2 else high end, step + 1 from h join s using (realm) where step < 24)
 select realm, low as users from h where step = 24""")
def free_capacity(spark, sf_dir):
    """How many sites of a realm's shape (its bytes, writes and subjects) an allowance holds."""
    s = src.ops(spark, sf_dir).groupBy("realm").agg(F.count("*").alias("w"), F.count_distinct("subject").alias("n"), F.sum("payload_length").alias("b"))
    return s.select("realm", policy.capacity(lambda u: (F.col("b") * u <= 10_000_000_000) & (F.col("w") * u <= 1_000_000_000) & (F.col("n") * u <= 10_000_000)).alias("users"))


@query("""select id, array_to_string(case when id % 11 = 0 then [0] else list_concat(tiers, list_filter([0, 1, 2, 3], lambda t: not list_contains(tiers, t))) end, ',') as read_order, array_to_string(list_sort(list_distinct(list_append(tiers, 1))), ',') as promoted, array_to_string(list_filter(tiers, lambda t: t != 2), ',') as dropped
 from (select o_orderkey as id, case when o_orderkey % 5 = 0 then [2, 3] when o_orderkey % 5 = 1 then [3] when o_orderkey % 5 = 2 then [0, 2] else [1] end as tiers from orders)""")
def placements(spark, sf_dir):
    arrays = F.expr("case when o_orderkey % 5 = 0 then array(2, 3) when o_orderkey % 5 = 1 then array(3) when o_orderkey % 5 = 2 then array(0, 2) else array(1) end")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), arrays.alias("tiers"))
    t = F.col("tiers")
    joined = lambda c, n: F.array_join(c.cast("array<string>"), ",").alias(n)
    return o.select("id", joined(policy.read_order(t, F.col("id") % 11 == 0), "read_order"), joined(policy.with_tier(t, F.lit(1)), "promoted"), joined(policy.without_tier(t, F.lit(2)), "dropped"))


@query("select object_key, array_to_string(list(distinct tier order by tier), ',') as tiers, arg_min(bytes, tier) as bytes, max(recorded) as recorded from (select o_custkey as object_key, cast(o_orderkey % 4 as integer) as tier, cast(o_custkey * 10 + o_orderkey % 4 as bigint) as bytes, epoch_us(o_orderdate) // 1000000 as recorded from orders) group by 1")
def rebuilt_placement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_key"), (F.col("o_orderkey") % 4).cast("int").alias("tier"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 4).alias("bytes"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("recorded"))
    return policy.rebuild_placement(o).withColumn("tiers", F.array_join(F.col("tiers").cast("array<string>"), ","))


@query("select c_custkey as object_key, case when c_custkey % 13 = 0 then 'absent' when c_custkey % 9 = 0 then 'differs' else 'proved' end as proof from customer")
def copy_proof(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    near = c.select(F.col("c_custkey").alias("object_key"), F.sha2("c_name", 256).alias("digest"))
    far = c.where("c_custkey % 13 != 0").select(F.col("c_custkey").alias("object_key"), F.sha2(F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(F.col("c_name")), 256).alias("digest"))
    return policy.copy_proof(near, far)


@query("""with f as (select p_partkey as hash, case when p_size > 5 and p_partkey > 0 then p_partkey - 1 end as parent, p_partkey // 10 as object_key from part), placed as (select object_key, min(object_key % 4) as tier from f where object_key % 6 != 0 group by 1)
 select object_key, target, count(case when tier < target then 1 end) as nearer, count(case when tier is null then 1 end) as unknown from (select distinct object_key, 3 as target from f where object_key % 2 = 0) join f using (object_key)
 join (select c.parent as hash, placed.tier from f c left join placed on placed.object_key = c.object_key where c.parent is not null) using (hash) group by 1, 2 having count(case when tier < target or tier is null then 1 end) > 0""")
def nearer_dependents(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("object_key", F.expr("hash div 10"))
    objects = f.select("object_key").distinct()
    return policy.nearer_dependents(objects.where("object_key % 2 = 0").withColumn("target", F.lit(3)), f, objects.where("object_key % 6 != 0").withColumn("tier", F.col("object_key") % 4))


_NOW = 1_706_800_000_000_000


@query(with_views("select 1", "ops", "commits", "frames", "findings").rsplit("\n", 1)[0] + f""", s as (select count(*) as frames, cast(sum(raw_size) as bigint) as raw, cast(sum(raw_size // 3) as bigint) as stored, count(case when refs = 1 then 1 end) as orphans from frames), c as (select count(*) as n, max(microtime) as t from commits),
 p as (select count(*) as n, cast(coalesce(sum(payload_length), 0) as bigint) as b, min(microtime) as t from ops where sequence > {point_sql(9)})
 select name, cast(value as double) as value, unit, '' as attribute from (select 'stored_bytes' as name, cast(stored as double) as value, 'By' as unit from s union all select 'raw_bytes', raw, 'By' from s union all select 'frames', frames, '{{frame}}' from s union all select 'orphan_frames', orphans, '{{frame}}' from s
 union all select 'compression_ratio', round(case when stored > 0 then raw / stored else 1.0 end, 6), '1' from s union all select 'commits', n, '{{commit}}' from c union all select 'rpo_lag_seconds', round(greatest(0.0, ({_NOW} - t) / 1e6), 3), 's' from c
 union all select 'flush_lag_seconds', round(coalesce(greatest(0.0, ({_NOW} - t) / 1e6), 0.0), 3), 's' from p union all select 'journal_pending', n, '{{operation}}' from p union all select 'journal_pending_bytes', b, 'By' from p)
 union all select 'open_findings', cast(count(f.code) as double), '{{finding}}', concat('severity=', s.severity) from (select unnest(range(0, 4)) as severity) s left join (select code, severity from findings where resolved is null) f on f.severity = s.severity group by s.severity""")
def telemetry_gauges(spark, sf_dir):
    """Readings, with frames of one reference as orphans and the last tenth of the journal pending."""
    f = src.frames(spark, sf_dir).agg(F.count("*").alias("frames"), F.sum("raw_size").alias("raw"), F.sum(F.expr("raw_size div 3")).alias("stored"), F.count_if(F.col("refs") == 1).alias("orphans"))
    o = src.ops(spark, sf_dir)
    return policy.gauges(f, src.commits(spark, sf_dir), o.where(F.col("sequence") > point(o, 9)), planning.counted(src.findings(spark, sf_dir).where("resolved is null").withColumn("severity", F.col("severity").cast("string")), "severity", ("0", "1", "2", "3")), _NOW)


# --- journal and index upkeep ---------------------------------------------------------------------------------------


@query(f"select realm, count(*) as n, min(sequence) as first_sequence from ops where sequence > {point_sql(6)} group by 1", "ops")
def trimmed_journal(spark, sf_dir):
    """What a trim through six tenths of the journal leaves."""
    o = src.ops(spark, sf_dir)
    return store.trim(o, point(o, 6)).groupBy("realm").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"))


@query("select h, refs, raw_size from frames where h not in (select sha256(encode(text)) from documents where doc_id % 3 = 0 and text is not null)", "frames")
def forgotten_frames(spark, sf_dir):
    """The frame index without a list of addresses."""
    d = table(spark, sf_dir, "documents")
    return store.forget(src.frames(spark, sf_dir), d.where("doc_id % 3 = 0 and text is not null").select(F.sha2(F.encode("text", "utf-8"), 256).alias("h")), "h")


@query("select id, code, created, resolved from findings where not (resolved is not null and resolved < 850000000)", "findings")
def purged_findings(spark, sf_dir):
    """The ledger without what was resolved before a moment."""
    return src.findings(spark, sf_dir).where("resolved is null or resolved >= 850000000").select("id", "code", "created", "resolved")


@query("select c_custkey as commit_no from customer order by c_acctbal, c_custkey")
def commit_ids(spark, sf_dir):
    """All ids, oldest first; a balance stands for the moment."""
    return report(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "commit_no"), ["commit_no"], (), ["c_acctbal", "commit_no"])


@query("select name, tip from (values ('main', 1000000), ('draft', 5)) r(name, tip) where tip not in (select p_partkey from part)")
def lost_refs(spark, sf_dir):
    """Refs to commits that aren't there, part keys standing for commits."""
    refs = spark.createDataFrame([("main", 1_000_000), ("draft", 5)], "name string, tip int")
    return refs.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tip")), "tip", "left_anti").select("name", "tip")


@query(f"select pattern, bytes_seen, keys_seen from (select regexp_replace(key, ':[^:]*$', '') || ':*' as pattern, {_CLASS} as classification, count(*) as keys_seen, cast(sum(greatest(bytes, 0)) as bigint) as bytes_seen from keyspace group by 1, 2) where classification = 'unclassified' order by bytes_seen desc, keys_seen desc, pattern limit 50", "keyspace")
def undecided_patterns(spark, sf_dir):
    return report(quality.discover(src.keyspace(spark, sf_dir)), ["pattern", "bytes_seen", "keys_seen"], [("classification", "=", "unclassified")], ["-bytes_seen", "-keys_seen", "pattern"], 50)


@query("select provider, operation, max(requests) as highest, min(requests) as lowest, arg_max(requests, day) as latest from provider_stat group by 1, 2", "provider_stat")
def series_summary(spark, sf_dir):
    """Highest, lowest and latest reading of each series."""
    return src.provider_stat(spark, sf_dir).groupBy("provider", "operation").agg(F.max("requests").alias("highest"), F.min("requests").alias("lowest"), F.max_by("requests", "day").alias("latest"))


@query("select id, code, severity from findings where resolved is null and severity >= 2", "findings")
def notified_findings(spark, sf_dir):
    """Open findings at a severity that is told."""
    return report(src.findings(spark, sf_dir), ["id", "code", "severity"], [("resolved", "empty"), ("severity", ">=", 2)])


@query("select pack, count(*) as frames, bool_and(dead) as removable from (select o_custkey as pack, o_orderstatus = 'F' as dead from orders) group by 1")
def pack_liveness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("hash"), "o_orderstatus")
    return store.pack_liveness(o, o.where("o_orderstatus = 'F'").select("hash"))


@query("select hash, cast(greatest(sum(refs), 0) as bigint) as refs, min(created) as created from (select o_custkey as hash, case when o_orderstatus = 'F' then -1 else 1 end as refs, epoch_us(o_orderdate) // 1000000 as created from orders) group by 1")
def recorded_references(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hash"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("refs"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("created"))
    return store.record_references(o.where("refs = 1"), o.where("refs = -1"))


@query("select child, parent from (select p_partkey as child, p_partkey + 7 as parent from part) where parent not in (select p_partkey from part)")
def dangling_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return graph.dangling(p.select(F.col("p_partkey").alias("child"), (F.col("p_partkey") + 7).alias("parent")), p.select(F.col("p_partkey").alias("commit_no")))


@query("select provider, day, case when failures < 3 then 'closed' when 1000000000 - day >= 20000000 then 'half-open' else 'open' end as state from provider_stat", "provider_stat")
def circuit_states(spark, sf_dir):
    s = src.provider_stat(spark, sf_dir)
    return s.select("provider", "day", quality.circuit_state(F.col("failures"), F.lit(1_000_000_000) - F.col("day"), cooldown=20_000_000).alias("state"))


@query("""select path, case when b is null then 'removed' when a is null then 'added' else 'changed' end as status from (select coalesce(x.c_name, y.c_name) as path, x.c_name as a, y.c_name as b, x.c_mktsegment as u, y.m as v
 from (select * from customer where c_custkey % 7 != 0) x full join (select *, case when c_custkey % 5 = 0 then '' else c_mktsegment end as m from customer where c_custkey % 11 != 0) y on x.c_name = y.c_name) where a is null or b is null or u is distinct from v""")
def compared_trees(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 7 != 0").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("hash"))
    b = c.where("c_custkey % 11 != 0").select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("hash"))
    return files.compare_trees(a, b)


_STATEMENTS = [("INSERT INTO {node} (a) VALUES (1)", "create", "node"), ("update `users` set a = 1", "update", "users"), ("/* x */ DELETE FROM node WHERE a = 1", "delete", "node"), ("TRUNCATE TABLE cache_x", "truncate", "cache_x"), ("alter table t1 add b int", "ddl", "t1"), ("select 1", None, None)]


@query("select o_orderkey as id, s.verb as verb, s.target as target from orders join (values %s) s(k, verb, target) on o_orderkey %% 6 = s.k" % ", ".join(f"({k}, {'null' if v is None else repr(v)}, {'null' if t is None else repr(t)})" for k, (_, v, t) in enumerate(_STATEMENTS)))
def statement_kinds(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(s) for s, _, _ in _STATEMENTS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return history.statement_kinds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("statement"))).drop("statement")


@query("select c_custkey as id, concat('user=', c_name, case when c_custkey % 2 = 0 then ' password=***' else ' colour=x1' end) as redacted, regexp_matches(lower(c_mktsegment), '^[a-z0-9]') and c_custkey % 4 != 3 as valid, concat('realm', c_custkey % 3) as realm, case c_custkey % 3 when 0 then '45 seconds' when 1 then '3 minutes' else '2 hours' end as width from customer")
def text_functions(spark, sf_dir):
    """Redaction, names, the realm of a path and labels of widths."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = F.concat(F.lit("user="), "c_name", F.when(k % 2 == 0, F.concat(F.lit(" password=s"), k.cast("string"))).otherwise(F.lit(" colour=x1")))
    name = F.concat(F.lower("c_mktsegment"), F.when(k % 4 == 3, F.lit("..x")).otherwise(F.lit(".x")))
    width = F.element_at(F.array(F.lit(45), F.lit(180), F.lit(7200)), (k % 3 + 1).cast("int"))
    return c.select(k.alias("id"), tx.redact(text).alias("redacted"), tx.valid_name(name).alias("valid"), tx.realm_of(F.concat(F.lit("realm"), (k % 3).cast("string"), F.lit("/a/b"))).alias("realm"), tx.width_label(width).alias("width"))


@query("select o_orderkey as id, 'status' as path, o_orderstatus as value from orders union all select o_orderkey, 'who.cust', cast(o_custkey as varchar) from orders union all select o_orderkey, 'who.priority', o_orderpriority from orders")
def flattened_payloads(spark, sf_dir):
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderpriority").alias("priority")).alias("who")))
    return payloads.leaves(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body")), ["id"], "body").drop("kind")


@query("select doc_id, sha256(encode(coalesce(text, ''))) as digest, cast(greatest(octet_length(encode(coalesce(text, ''))) - 1, 0) // 4096 + 1 as bigint) as pieces from documents")
def reassembled_media(spark, sf_dir):
    """Documents cut into blocks and put together again, by digest."""
    return store.reassemble(store.cut(table(spark, sf_dir, "documents"), "doc_id", "text", 4096), "doc_id").select("doc_id", F.sha2("body", 256).alias("digest"), "pieces")


@query("select id, concat('bytes=', pos, '-', pos + size - 1) as header, pos // 4096 as block, greatest(5242880, (size + 9999) // 10000) as part_size from (select o_orderkey as id, o_orderkey * 977 as pos, o_custkey + 1 as size from orders)")
def byte_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 977).alias("at"), (F.col("o_custkey") + 1).alias("size"))
    return o.select("id", tx.range_header(F.col("at"), F.col("size")).alias("header"), F.expr("at div 4096").alias("block"), tx.part_size(F.col("size")).alias("part_size"))


@query("select doc_id, case when length(coalesce(text, '')) > 60 then substr(text, 1, 57) || '...' else coalesce(text, '') end as clipped from documents")
def clipped_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clip(F.col("text"), 60).alias("clipped"))
