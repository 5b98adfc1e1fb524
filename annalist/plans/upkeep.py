"""Queries of keys, settings, records and estimates, with their SQL; importing this adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import keyspace, policy, quality, records, store
from ..sources import history as src
from ..sources.history import table, with_views
from .lineage import ORACLE_SQL, QUERIES
from .queries import HOUR6, query
from .staging import spread

__all__ = ["ORACLE_SQL", "QUERIES"]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


# --- keys -----------------------------------------------------------------------------------------------------------

_NAMES = ("cache:render", "Cache_menu", " session", "queue", "my.queue", "key_value_expire.x", "keyvalue.collection", "x.expire", "flood", "blob", "views", "semaphore", "locks.", "page", "a_cache", "unknown.thing", "PHP_Session", "tempstore.", "reliable_queue.", "customer", "some_expirable", "entity", "data.", "router", "library", "toolbar", "discovery", "config.x")
_DECISIONS = [("blob*", "authoritative", "human"), ("cache*", "authoritative", "human"), ("views*", "derivable", "heuristic"), ("customer*", "derivable", "human"), ("router*", "unclassified", "human")]
_CLASSES = f"""k as (select event_id as id, case when event_id % 5 = 0 then {_sql_list(_NAMES)}[(event_id + user_id * 7) % {len(_NAMES)} + 1] else concat({_sql_list(_NAMES)}[(event_id + user_id * 7) % {len(_NAMES)} + 1], ':', event_type) end as key from events),
 n as (select id, key, lower(trim(key)) as t, regexp_extract(lower(trim(key)), '^[^:.]*') as namespace from k),
 r as (select *, {{rules}} as rule from n), d(pattern, decided, source) as (values {", ".join(repr(x) for x in _DECISIONS)}),
 c as (select id, key, namespace, coalesce(rule.pattern, concat(namespace, '*')) as pattern, rule.classification as ruled from r),
 x as (select c.id, c.key, namespace, c.pattern, coalesce(decided, ruled, 'unclassified') as classification, case when decided is not null then 'human' when ruled is not null then 'heuristic' end as source from c left join (select * from d where source = 'human') h on h.pattern = c.pattern)"""
_RULES_SQL = "case " + " ".join(f"when regexp_matches(t, '{keyspace.glob(p)}') then {{'pattern': '{p}', 'classification': '{c}'}}" for p, c in keyspace.KEY_RULES) + " end"
_CLASSES = "with " + _CLASSES.replace("{rules}", _RULES_SQL)


def _keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = _pick(_NAMES, F.col("event_id") + F.col("user_id") * 7)
    key = F.when(F.col("event_id") % 5 == 0, name).otherwise(F.concat_ws(":", name, "event_type"))
    decisions = spark.createDataFrame(_DECISIONS, "pattern string, classification string, source string")
    return keyspace.classified(e.select(F.col("event_id").alias("id"), key.alias("key")), decisions)


@query(_CLASSES + " select namespace, pattern, classification, source, count(*) as keys from x group by 1, 2, 3, 4")
def classified_keys(spark, sf_dir):
    """Keys of a shared store by pattern, with their class by rules and by what a person decided."""
    return _keys(spark, sf_dir).groupBy("namespace", "pattern", "classification", "source").agg(F.count("*").alias("keys"))


@query(_CLASSES + " select id, key, classification != 'derivable' as captured, classification = 'authoritative' as restored, case when classification = 'unclassified' then 'undecided' else concat(classification, case when source = 'human' then '_decided' else '_matched' end) end as why from x")
def explained_keys(spark, sf_dir):
    """Whether each key is captured and restored, and why."""
    return keyspace.explained(_keys(spark, sf_dir)).select("id", "key", "captured", "restored", "why")


_LOCAL = "select concat('c', c_custkey, '*') as pattern, ['authoritative', 'derivable', 'unclassified'][c_custkey % 3 + 1] as classification, case when c_custkey % 2 = 0 then 'human' else 'heuristic' end as source from customer where c_custkey % 5 != 0"
_TAKEN = "select concat('c', c_custkey, '*') as pattern, ['derivable', 'authoritative', 'lost', 'unclassified'][c_custkey % 4 + 1] as classification, case when c_custkey % 7 = 0 then 2 else 1 end as version from customer where c_custkey % 6 != 0"


@query(f"""select pattern, case when t and (source is null or source != 'human') then theirs else classification end as classification, case when t and (source is null or source != 'human') then 'human' else source end as source, case when t then (source is null or source != 'human') end as applied
 from (select coalesce(l.pattern, p.pattern) as pattern, l.classification, l.source, p.classification as theirs, p.pattern is not null as t from ({_LOCAL}) l full join (select * from ({_TAKEN}) where version = 1 and classification != 'lost') p on l.pattern = p.pattern)""")
def applied_profile(spark, sf_dir):
    """Decisions of a site after another's profile was applied to them."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pattern = F.concat(F.lit("c"), k.cast("string"), F.lit("*")).alias("pattern")
    local = c.where(k % 5 != 0).select(pattern, _pick(("authoritative", "derivable", "unclassified"), k).alias("classification"), F.when(k % 2 == 0, "human").otherwise("heuristic").alias("source"))
    taken = c.where(k % 6 != 0).select(pattern, _pick(("derivable", "authoritative", "lost", "unclassified"), k).alias("classification"), F.when(k % 7 == 0, 2).otherwise(1).alias("version"))
    return keyspace.applied(local, taken)


@query(f"select 1 as version, 'own' as label, pattern, classification from ({_LOCAL}) where source = 'human'")
def shared_profile(spark, sf_dir):
    """The profile that a site's own decisions make."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pattern = F.concat(F.lit("c"), k.cast("string"), F.lit("*")).alias("pattern")
    return keyspace.profile(c.where(k % 5 != 0).select(pattern, _pick(("authoritative", "derivable", "unclassified"), k).alias("classification"), F.when(k % 2 == 0, "human").otherwise("heuristic").alias("source")), "own")


# --- records --------------------------------------------------------------------------------------------------------

_MODES = "case when actor % 3 = 0 then 'physical' else 'logical' end"


@query(f"""select id, started, case outcome when 'succeeded' then started + 60 + id % 900 when 'refused' then started end as finished, actor, concat('commit', id % 97) as target, case when outcome != 'refused' and id % 4 = 0 then concat('before', id) end as pre_snapshot,
 substr(repeat(concat('scope', id, ' '), 30), 1, 255) as scope, {_MODES} as mode, case when outcome = 'succeeded' and id % 5 = 0 then 'partial' else outcome end as outcome, case outcome when 'succeeded' then actor else 0 end as restored, case outcome when 'succeeded' then id % 5 when 'refused' then actor + 2 else id % 9 end as skipped from restores""", "restores")
def restore_audit(spark, sf_dir):
    """The audit trail of restores that were opened, closed (some twice, the later time counting) and refused."""
    r = src.restores(spark, sf_dir)
    id_, scope = F.col("id"), F.repeat(F.concat(F.lit("scope"), F.col("id").cast("string"), F.lit(" ")), 30).alias("scope")
    rows = r.withColumn("target", F.concat(F.lit("commit"), (id_ % 97).cast("string"))).withColumn("mode", F.when(F.col("actor") % 3 == 0, "physical").otherwise("logical"))
    opens = rows.where("outcome != 'refused'").select("id", "started", "actor", "target", F.when(id_ % 4 == 0, F.concat(F.lit("before"), id_.cast("string"))).alias("pre_snapshot"), scope, "mode", (id_ % 9).alias("skipped"))
    done = r.where("outcome = 'succeeded'")
    last = done.select("id", (F.col("started") + 60 + id_ % 900).alias("finished"), F.when(id_ % 5 == 0, "partial").otherwise("succeeded").alias("outcome"), F.col("actor").alias("restored"), (id_ % 5).alias("skipped"))
    early = done.where(id_ % 10 == 0).select("id", (F.col("started") + 1).alias("finished"), F.lit("failed").alias("outcome"), F.lit(0).cast("long").alias("restored"), id_.alias("skipped"))
    refused = rows.where("outcome = 'refused'").select("id", "started", "actor", "target", scope, "mode", (F.col("actor") + 2).alias("subjects"))
    return records.audit(opens, last.union(early), refused)


_DRILLS = "(select o_orderkey as id, epoch_us(o_orderdate) // 1000000 as created, ['passed', 'failed', 'inconclusive', 'refused', 'passed'][o_custkey % 5 + 1] as verdict, o_custkey as sampled from orders)"


def _drills(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("created"), _pick(("passed", "failed", "inconclusive", "refused", "passed"), F.col("o_custkey")).alias("verdict"), F.col("o_custkey").alias("sampled"))


@query(f"select * from {_DRILLS} order by created desc, id desc limit 30")
def recent_drills(spark, sf_dir):
    return records.recent(_drills(spark, sf_dir), "created", 30)


@query(f"select v.verdict, count(d.id) as n from (values ('passed'), ('failed'), ('inconclusive'), ('refused')) v(verdict) left join (select * from {_DRILLS} order by created desc, id desc limit 200) d using (verdict) group by 1")
def drill_verdicts(spark, sf_dir):
    """Verdicts of the newest 200 drills."""
    return records.verdicts(_drills(spark, sf_dir), 200)


_REQUESTS = """q as (select o_orderkey as number, case when o_orderkey % 13 = 5 then null when o_orderstatus = 'F' then 'delete' else 'create' end as action, ['site/a', 'site/b_2', 'Main', 'main', 'x//y', 'draft', 'team/one/two', 'z-9'][o_custkey % 8 + 1] || case when o_custkey % 8 in (2, 3, 4) then '' else cast(o_custkey % 30 as varchar) end as name,
  case when o_orderkey % 11 = 0 then 'short' else sha256(cast(o_orderkey as varchar)) end as "commit", o_custkey as actor, epoch_us(o_orderdate) // 1000000 as at_ from orders),
 f as (select *, regexp_matches(name, '^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$') as fine, regexp_matches("commit", '^[0-9a-f]{64}$') as sound from q),
 g as (select *, case when fine and name != 'main' and ((action = 'create' and sound) or action = 'delete') then action = 'create' end as puts from f),
 h as (select *, coalesce(last_value(puts ignore nulls) over (partition by name order by number rows between unbounded preceding and 1 preceding), false) as there from g),
 res as (select number, action, name, "commit", actor, at_, case when action is null then 'unknown' when not fine then 'bad_name' when name = 'main' then 'trunk' when action = 'create' and not sound then 'bad_commit' when action = 'create' and there then 'exists' when action = 'create' then 'created' when there then 'deleted' else 'absent' end as result from h)"""


def _requests(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    name = F.concat(_pick(("site/a", "site/b_2", "Main", "main", "x//y", "draft", "team/one/two", "z-9"), c), F.when((c % 8).isin(2, 3, 4), "").otherwise((c % 30).cast("string")))
    action = F.when(F.col("o_orderkey") % 13 == 5, F.lit(None)).when(F.col("o_orderstatus") == "F", "delete").otherwise("create")
    commit = F.when(F.col("o_orderkey") % 11 == 0, "short").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256))
    return o.select(F.col("o_orderkey").alias("number"), action.alias("action"), name.alias("name"), commit.alias("commit"), c.alias("actor"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("at"))


@query(f"with {_REQUESTS} select number, action, name, result from res")
def branch_requests(spark, sf_dir):
    """What becomes of each request for a branch."""
    return records.branch_requests(_requests(spark, sf_dir)).select("number", "action", "name", "result")


@query(f"""with {_REQUESTS}, b as (select name, arg_max({{'r': result, 'c': "commit", 'a': actor, 't': at_}}, number) as x from res where result in ('created', 'deleted') group by 1 having arg_max(result, number) = 'created')
 select name, concat('heads/', name) as ref, x.c as forked_from, x.c as tip, x.a as actor, x.t as created, x.c not in (select sha256(cast(o_orderkey as varchar)) from orders where o_orderkey % 3 != 0) as lost from b""")
def branch_index(spark, sf_dir):
    """The branches that there are in the end, and whether a commit is at their tip; a third of the commits is gone."""
    commits = table(spark, sf_dir, "orders").where("o_orderkey % 3 != 0").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit"))
    return records.branch_tips(records.branches(_requests(spark, sf_dir)), commits)


# --- settings, sites, labels ----------------------------------------------------------------------------------------

_KEYS6 = ("password", "host", "hash_salt", "Colour", "API_KEY", "port")
_SETTINGS = f"""select c_custkey as id, concat('$databases[''default''][''', {_sql_list(_KEYS6)}[c_custkey % 6 + 1], '''] = ''', c_name, ''';', chr(10), '  ''smtp_pass'' => ''x', c_custkey, ''', ''next'' => 1,', chr(10), '# password = nothing', chr(10), 'if ($token == 1) {{', chr(10),
 '$config[''', {_sql_list(_KEYS6)}[c_nationkey % 6 + 1], '''] = ''', c_mktsegment, '''', chr(10), '''dsn''=> ''a=b''') as body from customer"""
_AT = "case when instr(x, '=>') > 0 then instr(x, '=>') else instr(x, '=') end"
_SECRET = f"(({_AT}) > 0 and (contains(substr(x, 1, ({_AT}) - 1), '$') or regexp_matches(lower(substr(x, 1, ({_AT}) - 1)), '[''\"][a-z0-9_.\\-]+[''\"]\\s*$')) and regexp_matches(lower(substr(x, 1, ({_AT}) - 1)), '{'|'.join(tx.SECRETS)}'))"
_MADE = f"concat(substr(x, 1, ({_AT}) - 1), case when instr(x, '=>') > 0 then '=>' else '=' end, ' ''{tx.MARKER}''', case when contains(substr(x, {_AT}), ';') then ';' when contains(substr(x, {_AT}), ',') then ',' else '' end)"


@query(f"select id, array_to_string(list_transform(string_split(body, chr(10)), lambda x: case when {_SECRET} then {_MADE} else x end), chr(10)) as redacted, cast(len(list_filter(string_split(body, chr(10)), lambda x: {_SECRET})) as bigint) as secrets from ({_SETTINGS})")
def redacted_settings(spark, sf_dir):
    """Settings files with the values of their secret lines replaced."""
    c = table(spark, sf_dir, "customer")
    lit = F.lit
    body = F.concat(lit("$databases['default']['"), _pick(_KEYS6, F.col("c_custkey")), lit("'] = '"), "c_name", lit("';\n  'smtp_pass' => 'x"), F.col("c_custkey").cast("string"), lit("', 'next' => 1,\n# password = nothing\nif ($token == 1) {\n$config['"), _pick(_KEYS6, F.col("c_nationkey")), lit("'] = '"), "c_mktsegment", lit("'\n'dsn'=> 'a=b'"))
    rows = spread(c.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"), "c_custkey").select(F.col("c_custkey").alias("id"), body.alias("body"))
    return rows.select("id", tx.redact_settings(F.col("body")).alias("redacted"), tx.secret_lines(F.col("body")).alias("secrets"))


_SITE = "case when c_custkey % 4 = 0 then concat('site_', c_nationkey) else substr(sha256(concat(c_name, '|', '', '|', c_mktsegment)), 1, 12) end"


@query(f"select id, site, concat(site, '/', regexp_replace(k, '^/+', '')) as stored, case when id % 3 != 0 then regexp_replace(k, '^/+', '') end as own from (select c_custkey as id, {_SITE} as site, concat(case when c_custkey % 2 = 0 then '//' else '' end, 'frames/', c_custkey) as k from customer)")
def site_keys(spark, sf_dir):
    """Keys under their site's prefix, and what a site reads of keys of which a third is another's."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    given = F.when(k % 4 == 0, F.concat(F.lit(" site_"), F.col("c_nationkey").cast("string"), F.lit("! ")))
    rows = c.select(k.alias("id"), tx.site_id(given, F.col("c_name"), F.lit(None), F.col("c_mktsegment")).alias("site"), F.concat(F.when(k % 2 == 0, "//").otherwise(""), F.lit("frames/"), k.cast("string")).alias("k"))
    rows = rows.withColumn("stored", tx.site_key(F.col("site"), F.col("k")))
    other = F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), "stored")).otherwise(F.col("stored"))
    return rows.select("id", "site", "stored", tx.own_key(F.col("site"), other).alias("own"))


_REALM_NAMES = ("entity", "config", "state", "key_value", "table", "schema", "file", "ephemeral", "code", "other")


@query(f"select o_orderkey as id, case {' '.join(f'''when r = '{k}' then '{v}' ''' for k, v in tx.LABELS['realm'].items())} end as realm, case {' '.join(f'''when v = '{k}' then '{t}' ''' for k, t in tx.LABELS['verb'].items())} end as verb from (select o_orderkey, {_sql_list(_REALM_NAMES)}[o_custkey % 10 + 1] as r, {_sql_list((*tx.LABELS['verb'], 'none'))}[o_orderkey % 7 + 1] as v from orders)")
def labelled_operations(spark, sf_dir):
    """What realms and verbs are called."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), tx.label("realm", _pick(_REALM_NAMES, F.col("o_custkey"))).alias("realm"), tx.label("verb", _pick((*tx.LABELS["verb"], "none"), F.col("o_orderkey"))).alias("verb"))


# --- estimates ------------------------------------------------------------------------------------------------------

_SITES = "select c_custkey as id, c_custkey as subjects, round(c_acctbal) as ops_per_day, 3600 * (1 + c_nationkey % 6) as base_interval, 15 * (1 + c_nationkey % 4) as segment_interval, 30 + c_custkey % 700 as retention_days, c_custkey % 60 as deploys_per_year, case when c_custkey % 3 = 0 then c_custkey % 8 / 2.0 end as measured_ratio from customer"


@query(f"""select id, cast(round(case when subjects < 1 or ops_per_day <= 0 then 0.0 else round(31557600.0 / base_interval) * (retention_days / 365.25) * d * 240.0 end) as bigint) as tree_bytes, cast(round(deploys_per_year * (retention_days / 365.25) * 62772.0) as bigint) as code_bytes,
 cast(round(round(2629800.0 / segment_interval) * 4 * 1.05) as bigint) as writes_per_month, case when measured_ratio is null then 5.86 else greatest(1.0, cast(measured_ratio as double)) end as ratio
 from (select *, case when subjects <= 1 then least(w, subjects) else subjects * (1 - exp(w * ln(1 - 1.0 / subjects))) end as d from (select *, round(ops_per_day * (base_interval / 86400.0)) as w from ({_SITES})))""")
def estimate_parts(spark, sf_dir):
    """The parts of a storage estimate for sites of many sizes."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    n = F.col("c_nationkey")
    sites = c.select(k.alias("id"), k.alias("subjects"), F.round("c_acctbal").alias("ops_per_day"), (3600 * (1 + n % 6)).alias("base_interval"), (15 * (1 + n % 4)).alias("segment_interval"), (30 + k % 700).alias("retention_days"), (k % 60).alias("deploys_per_year"), F.when(k % 3 == 0, (k % 8) / 2.0).alias("measured_ratio"))
    return policy.estimate(sites).select("id", "tree_bytes", "code_bytes", "writes_per_month", "ratio")


@query("select realm, count(*) as operations, cast(sum(case realm when 'config' then 2000 when 'state' then 217 when 'entity' then case when actor % 2 = 0 then 184 else 48 end else 217 end) as bigint) as bytes from ops group by 1", "ops")
def estimated_bytes(spark, sf_dir):
    """What the journal's operations weigh by the model."""
    o = src.ops(spark, sf_dir)
    return o.groupBy("realm").agg(F.count("*").alias("operations"), F.sum(policy.op_bytes(F.col("realm"), F.col("actor") % 2 == 0)).alias("bytes"))


@query("select provider, day, case when requests % 3 != 0 then 'STANDARD_IA' end as storage_class from provider_stat", "provider_stat")
def storage_classes(spark, sf_dir):
    s = src.provider_stat(spark, sf_dir)
    return s.select("provider", "day", policy.storage_class(F.col("requests") % 3 != 0).alias("storage_class"))


# --- tables and wires -----------------------------------------------------------------------------------------------


@query("""select 'customer' as table_name, 5 as columns, count(*) as row_count, 'c_custkey' as order_column, cast(max(c_custkey) as varchar) as max_key, cast(null as varchar) as changed_column, cast(null as varchar) as max_changed from customer
 union all select 'documents', 5, count(*), 'doc_id', cast(max(doc_id) as varchar), null, null from documents union all select 'events', 6, count(*), 'user_id', cast(max(user_id) as varchar), null, null from events
 union all select 'orders', 6, count(*), 'id', cast(max(o_orderkey) as varchar), 'created', cast(max(o_orderdate) as varchar) from orders union all select 'part', (select count(*) from (describe part)), count(*), 'name', max(p_name), null, null from part""")
def introspected_tables(spark, sf_dir):
    """What five tables are, two of them with renamed columns: columns to read in order of and to see changes by, rows and highest values."""
    t = lambda name: table(spark, sf_dir, name)
    return quality.introspected({n: t(n) for n in ("customer", "documents", "events")} | {"orders": t("orders").withColumnsRenamed({"o_orderkey": "id", "o_orderdate": "created"}), "part": t("part").withColumnRenamed("p_name", "name")})


_CODES = {"missing_anchors": "anchor.missing", "broken_anchors": "anchor.unwalkable", "missing_parents": "commit.parent_missing", "deep_chains": "delta.chain_too_deep", "missing_delta_parents": "delta.parent_missing", "missing_dictionaries": "dict.missing",
          "changed_frames": "frame.hash_mismatch", "missing_frames": "frame.missing", "unindexed_frames": "frame.unindexed", "unreadable_frames": "entry.unreadable", "missing_refs": "ref.missing", "unreadable_segments": "segment.unreadable"}


def _wires_sql() -> str:
    found = f"select code, scope::varchar as scope from ({ORACLE_SQL['verify_sweep']}) union all select key, id from ({ORACLE_SQL['archive_objects']}) where part = 'problem' union all select code, kind from ({ORACLE_SQL['reindex_problems']}) where kind = 'pack'"
    lag = with_views("select (max(microtime) - max(case when sequence <= (select max(sequence) // 2 from ops) then microtime end)) // 1000000 as lag_seconds from ops", "ops")
    short = with_views(f"select count(*) as short_packs from (select pack, max(o + payload_length) as used, sum(payload_length) - (case when pack % 37 = 0 then 1 else 0 end) as size from (select microtime // {HOUR6} as pack, payload_length, sum(payload_length) over (partition by microtime // {HOUR6} order by sequence) - payload_length as o from ops) group by 1) where used > size", "ops")
    tiers = with_views("select count(*) as unreachable_tiers from (select provider, arg_max(failures, {'d': day, 'o': operation}) as f from provider_stat group by 1) where f >= 3", "provider_stat")
    shifted = f"select count(*) as shifted_files from ({ORACLE_SQL['block_differences']}) where shifted"
    drifted = f"select count(*) as drifted_tables from ({ORACLE_SQL['table_drift']}) where state = 'drifted'"
    trees = f"select count(*) as drifted_files from ({ORACLE_SQL['compared_trees']})"
    keys = _CLASSES + " select count(*) as total_keys, count(case when classification = 'unclassified' then 1 end) as unclassified from x"
    counts = ", ".join(f"count(case when code = '{c}' then 1 end) as {n}" for n, c in _CODES.items())
    wires = " union all ".join(f"select '{c}' as code, {s} as severity, '{quality.START.get(s, 'observe')}' as rung, ({e}) as fires from seen" for c, s, e in quality.STORE_WIRES)
    return f"with seen as (select * from (select {counts} from ({found})), ({lag}), ({short}), ({tiers}), ({shifted}), ({drifted}), ({trees}), ({keys})) select code, severity, rung, fires from ({wires})"


@query(_wires_sql())
def store_wires(spark, sf_dir):
    """All wires over a store: what a verify sweep, an archive and a rebuild found, packs, tiers, files, tables, keys and the time since a flush."""
    found = QUERIES["verify_sweep"](spark, sf_dir).select("code", F.col("scope").cast("string").alias("scope"))
    found = found.union(QUERIES["archive_objects"](spark, sf_dir).where("part = 'problem'").select("key", "id"))
    found = found.union(QUERIES["reindex_problems"](spark, sf_dir).where("kind = 'pack'").select("code", "kind"))
    o = src.ops(spark, sf_dir)
    half = (o.agg(F.max("sequence")).first()[0] or 0) // 2
    pack = F.expr(f"microtime div {HOUR6}")
    offsets = store.pack_offsets(o.withColumn("pack", pack), "pack", "sequence", "payload_length")
    sizes = o.groupBy(pack.alias("pack")).agg(F.sum("payload_length").alias("size")).withColumn("size", F.col("size") - F.when(F.col("pack") % 37 == 0, 1).otherwise(0))
    used = offsets.groupBy("pack").agg(F.max(F.col("pack_offset") + F.col("payload_length")).alias("used"))
    tiers = src.provider_stat(spark, sf_dir).groupBy("provider").agg(F.max_by("failures", F.struct("day", "operation")).alias("f"))
    seen = quality.store_observation(
        found,
        lag=o.agg(F.expr(f"(max(microtime) - max(microtime) filter (where sequence <= {half})) div 1000000").alias("lag_seconds")),
        packs=used.join(sizes, "pack").agg(F.count_if(F.col("used") > F.col("size")).alias("short_packs")),
        tiers=tiers.agg(F.count_if(F.col("f") >= 3).alias("unreachable_tiers")),
        files=QUERIES["block_differences"](spark, sf_dir).agg(F.count_if("shifted").alias("shifted_files")),
        tables=QUERIES["table_drift"](spark, sf_dir).agg(F.count_if(F.col("state") == "drifted").alias("drifted_tables")),
        trees=QUERIES["compared_trees"](spark, sf_dir).agg(F.count("*").alias("drifted_files")),
        keys=_keys(spark, sf_dir).agg(F.count("*").alias("total_keys"), F.count_if(F.col("classification") == "unclassified").alias("unclassified")),
    )
    return quality.tripwires(seen, quality.STORE_WIRES, whole=True)
