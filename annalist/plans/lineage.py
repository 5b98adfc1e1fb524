"""Queries of long histories, archives and journals, with their SQL; importing this adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import anchors, archive, dictionaries, flush, graph, payloads, repair, walks
from ..operators.store import cut
from ..operators.ranges import numbered
from ..plans.staging import scratch_folder, staged
from ..sources import files, objects
from ..sources import history as src
from ..sources.history import table, with_views
from ..streaming import journal
from .planning import ORACLE_SQL, QUERIES
from .queries import query

__all__ = ["ORACLE_SQL", "QUERIES"]


def recursive(body: str, *views: str) -> str:
    head = with_views("select 1", *views).rsplit("\n", 1)[0]
    return head.replace("with ", "with recursive ", 1) + ",\n" + body


# --- histories ------------------------------------------------------------------------------------------------------

HOUR, MINUTES, MINUTE = 3_600_000_000, 600_000_000, 60_000_000


def _moments(width: int) -> str:
    return f"w as (select m, cast(row_number() over (order by m) - 1 as bigint) as n from (select distinct microtime // {width} as m from ops))"


def moments(spark, sf_dir: str, width: int) -> DataFrame:
    """A history with a commit for each window of the journal that has operations: n, from 0, and the window m."""
    found = src.ops(spark, sf_dir).select(F.expr(f"microtime div {width}").alias("m")).distinct()
    return staged(numbered(found, "m", name="n"))


def _linked(w: DataFrame, loops: bool) -> DataFrame:
    """Each commit has the one before it as parent, each tenth also the one three before; with loops, some also one after them."""
    n = F.col("n")
    edges = w.where("n > 0").select(n.alias("child"), (n - 1).alias("parent")).union(w.where("n % 10 = 0 and n > 2").select(n, n - 3))
    later = w.where("n % 97 = 50").select(n.alias("child"), (n + 4 + n % 3).alias("parent")).join(w.select(n.alias("parent")), "parent", "left_semi")
    return edges.union(later.select("child", "parent")) if loops else edges


_LINKED = "e as (select n as child, n - 1 as parent from w where n > 0 union all select n, n - 3 from w where n % 10 = 0 and n > 2)"
_LOOPED = _LINKED[:-1] + " union all select n, n + 4 + n % 3 from w where n % 97 = 50 and n + 4 + n % 3 <= (select max(n) from w))"


@query(recursive(f"{_moments(HOUR)}, {_LOOPED}, r(a, b) as (select child, parent from e union select a, parent from r join e on child = b)\nselect x.a as node, min(y.b) as loop from (select a from r where a = b) x join r y on y.a = x.a join r z on z.a = y.b and z.b = x.a group by 1", "ops"))
def history_cycles(spark, sf_dir):
    """Commits of the hourly history that are their own ancestors, by the least commit of their loop."""
    return walks.cycles(_linked(moments(spark, sf_dir, HOUR), loops=True))


_GONE = "n % 501 != 77"


@query(recursive(f"""{_moments(MINUTES)}, {_LINKED}, r(node) as (select max(n) - 7 from w union select parent from r join e on child = node where child % 501 != 77),
 c as (select count(*) as reached, count(case when node % 501 = 77 then 1 end) as missing from r)
 select reached, missing as missing_commits, 0 as looping_commits, 0 as unreadable, missing > 0 as refuse, case when missing > 0 then 'commits.missing' end as reason from c""", "ops"))
def gate_of_missing(spark, sf_dir):
    """Whether pruning may go on over the ten-minute history, of which a few commits are missing: their parents aren't known."""
    w = moments(spark, sf_dir, MINUTES)
    tip = w.agg(F.max("n") - 7).first()[0]
    return _gate(spark, _linked(w, loops=False).where("child % 501 != 77"), w.where(_GONE), tip)


@query(recursive(f"""{_moments(HOUR)}, {_LOOPED}, r(a, b) as (select child, parent from e union select a, parent from r join e on child = b),
 t as (select max(n) - 3 as tip from w), seen as (select tip as node from t union select b from r join t on a = tip)
 select (select count(*) from seen) as reached, 0 as missing_commits, count(*) as looping_commits, 0 as unreadable, count(*) > 0 as refuse, case when count(*) > 0 then 'commits.loop' end as reason from r where a = b and a in (select node from seen)""", "ops"))
def gate_of_loops(spark, sf_dir):
    """Whether pruning may go on over the hourly history with its loops."""
    w = moments(spark, sf_dir, HOUR)
    return _gate(spark, _linked(w, loops=True), w, w.agg(F.max("n") - 3).first()[0])


def _gate(spark, edges: DataFrame, w: DataFrame, tip: int) -> DataFrame:
    refs = spark.createDataFrame([(tip,)], "node long")
    return graph.prune_gate(edges, w.select(F.col("n").alias("commit_no")), refs)


@query(with_views(f"select n as node, cast(tip - n - 2 * greatest(0, tip // 10 - (n + 2) // 10) as bigint) as depth from (select cast(row_number() over (order by m) - 1 as bigint) as n, count(*) over () - 1 as tip from (select distinct microtime // {MINUTE} as m from ops))", "ops"))
def reachable_moments(spark, sf_dir):
    """The fewest steps from the newest commit of the minutes' history to all others: each tenth commit that is passed saves two."""
    w = moments(spark, sf_dir, MINUTE)
    tip = w.agg(F.max("n")).first()[0]
    return graph.reachable(_linked(w, loops=False), spark.createDataFrame([(tip,)], "node long"))


# --- archives -------------------------------------------------------------------------------------------------------

#: A main line of the even hours and a branch of the odd ones; each 24th commit of the main line merges the branch's commit before it.
_LINES = """l as (select n, n - 2 as parent, n % 2 = 1 as odd, n not in (12, 31) as present from w)"""
_TAKEN = """evens as (select n, row_number() over (order by n desc) - 1 as number from l where not odd and n > 12 order by 2 limit 350),
 tip as (select max(n) - 1 as t from evens where n % 48 = 0), odds as (select n, (select count(*) from evens) + row_number() over (order by n desc) - 1 as number from l where odd and n <= (select t from tip) and n > 31 qualify (select count(*) from evens) + row_number() over (order by n desc) <= 350),
 taken as (select * from evens union all select * from odds)"""


@query(recursive(f"""{_moments(HOUR)}, {_LINES}, {_TAKEN}
 select number, n as commit_no, false as missing from taken union all select null, 12, true where (select count(*) from l where not odd and n > 12) < 350
 union all select null, 31, true where (select count(*) from evens) < 350 and (select count(*) from evens) + (select count(*) from l where odd and n > 31 and n <= (select t from tip)) < 350 and (select t from tip) >= 31""", "ops"))
def newest_commits(spark, sf_dir):
    """The newest 350 commits of a history of two lines, with a missing commit in each."""
    return _newest(moments(spark, sf_dir, HOUR))


def _newest(w: DataFrame) -> DataFrame:
    n = F.col("n")
    lines = w.select(n.alias("child"), F.when(n > 1, n - 2).alias("parent"), F.lit(0).alias("side"))
    merges = w.where("n % 48 = 0 and n > 0").select(n, n - 1, F.lit(1))
    head = w.where("n % 2 = 0").agg(F.max("n")).first()[0]
    return archive.newest_commits(lines.union(merges).withColumn("present", ~F.col("child").isin(12, 31)), head, 350)


_STORE = """o as (select sequence, n as owner, sequence % 4000 as frame from ops join w on m = microtime // 3600000000),
 names as (select distinct case when sequence % 9 != 0 then 'segment' else 'anchor' end as kind, case when sequence % 9 != 0 then owner else owner - owner % 24 end as owner, frame from o),
 an as (select distinct n - n % 24 as anchor from w), ap as (select anchor as child, case when anchor % 72 != 0 then anchor - 24 end as parent from an where anchor % 1000 != 408),
 fr as (select distinct frame, case when frame % 3 != 0 then frame // 50 end as pack, case when frame % 5 != 0 then frame - 1 end as parent, case when frame % 2 = 0 then frame % 7 end as dictionary from o where frame % 97 != 3),
 seg as (select n as segment, n % 41 != 5 as readable from taken), tips as (select distinct n - n % 24 as anchor from taken),
 ch(tip, node) as (select anchor, anchor from tips union select tip, parent from ch join ap on child = node where parent is not null),
 bad as (select distinct tip from ch where node not in (select child from ap)), good as (select distinct node from ch where tip not in (select tip from bad)),
 ne(frame) as (select frame from names where (kind = 'segment' and owner in (select segment from seg where readable)) or (kind = 'anchor' and owner in (select node from good)) union select parent from ne join fr using (frame) where parent is not null),
 us as (select distinct dictionary from ne join fr using (frame) where dictionary is not null)"""


@query(recursive(f"""{_moments(HOUR)}, {_LINES}, {_TAKEN}, {_STORE}
 select 'object' as part, 'commit' as kind, cast(n as varchar) as id, concat('commits/', n) as key from taken union all select 'object', 'segment', cast(segment as varchar), concat('segments/', segment) from seg
 union all select 'object', 'anchor', cast(node as varchar), concat('anchors/', node) from good union all select distinct 'object', 'pack', cast(pack as varchar), concat('packs/', pack) from ne join fr using (frame) where pack is not null
 union all select 'object', 'frame', cast(frame as varchar), concat('frames/', frame) from ne join fr using (frame) where pack is null union all select 'object', 'dictionary', cast(dictionary as varchar), concat('dictionaries/', dictionary) from us where dictionary != 4
 union all select 'object', 'ref', 'main', 'refs/main' union all select 'problem', 'segment', cast(segment as varchar), 'segment.unreadable' from seg where not readable
 union all select 'problem', 'commit', '12', 'chain.ended' where (select count(*) from l where not odd and n > 12) < 350
 union all select 'problem', 'commit', '31', 'chain.ended' where (select count(*) from evens) < 350 and (select count(*) from evens) + (select count(*) from l where odd and n > 31 and n <= (select t from tip)) < 350 and (select t from tip) >= 31
 union all select 'problem', 'anchor', cast(tip as varchar), 'anchor.unwalkable' from bad union all select 'problem', 'frame', cast(frame as varchar), 'frame.unindexed' from ne where frame not in (select frame from fr)
 union all select 'problem', 'dictionary', cast(dictionary as varchar), 'dictionary.unindexed' from us where dictionary = 4""", "ops"))
def archive_objects(spark, sf_dir):
    """What an archive of the newest 350 commits holds, and what is missing from the store it is made of."""
    w = moments(spark, sf_dir, HOUR)
    commits = staged(_newest(w))
    o = staged(src.ops(spark, sf_dir).select("sequence", F.expr(f"microtime div {HOUR}").alias("m")).join(w, "m").select("sequence", F.col("n").alias("owner"), (F.col("sequence") % 4000).alias("frame")))
    own = F.col("sequence") % 9 != 0
    names = o.select(F.when(own, "segment").otherwise("anchor").alias("kind"), F.when(own, F.col("owner")).otherwise(F.col("owner") - F.col("owner") % 24).alias("owner"), "frame").distinct()
    anchor = F.col("n") - F.col("n") % 24
    parents = w.select(anchor.alias("child")).distinct().where("child % 1000 != 408").select("child", F.when(F.col("child") % 72 != 0, F.col("child") - 24).alias("parent"))
    f = F.col("frame")
    frames = o.select("frame").distinct().where("frame % 97 != 3").select("frame", F.when(f % 3 != 0, F.expr("frame div 50")).alias("pack"), F.when(f % 5 != 0, f - 1).alias("parent"), F.when(f % 2 == 0, f % 7).alias("dictionary"))
    known = spark.range(7).where("id != 4").select(F.col("id").alias("dictionary"))
    n = F.col("n")
    return archive.closure(commits, w.select(n.alias("commit_no"), n.alias("segment"), (n % 41 != 5).alias("readable")), w.select(n.alias("commit_no"), anchor.alias("anchor")), parents, names, frames, known)


# --- journals -------------------------------------------------------------------------------------------------------

AGE, COUNT, SIZE = HOUR, 12, 400


@query(recursive(f"""r as (select *, row_number() over (order by realm, sequence) as n, sum(payload_length) over (partition by realm order by sequence) - payload_length as b, max(microtime) over (partition by realm order by sequence) as t from ops),
 j as (select *, max(n) over (partition by realm) as z, least(min(n) over (partition by realm order by t range between {AGE} following and unbounded following), min(n) over (partition by realm order by b range between {SIZE} following and unbounded following), case when n + {COUNT} <= max(n) over (partition by realm) then n + {COUNT} end) as nx from r),
 s(n, batch) as (select min(n), 0 from j group by realm union all select nx, batch + 1 from s join j using (n) where nx is not null),
 x as (select a.realm, cast(batch as bigint) as batch, a.sequence as first_sequence, e.sequence as last_sequence, e.n - a.n + 1 as operations, cast(e.b + e.payload_length - a.b as bigint) as bytes, a.nx from s join j a using (n) join j e on e.n = coalesce(a.nx - 1, a.z))
 select realm, batch, first_sequence, last_sequence, operations, bytes, case when operations >= {COUNT} then 'count' when bytes >= {SIZE} then 'bytes' when nx is not null then 'age' else 'end' end as reason from x""", "ops"))
def flush_batches(spark, sf_dir):
    """The micro-batches of each realm's journal, with bounds that all fire in it."""
    return flush.flush_batches(src.ops(spark, sf_dir), age=AGE, count=COUNT, size=SIZE)


@query("select batch, microtime, request, subject, label, row_number() over (order by batch, microtime, request) as sequence from (select least(3, sequence * 4 // (select max(sequence) + 1 from ops)) as batch, microtime, sequence as request, subject, substr(repeat(field_json, 30), 1, 255) as label from ops)", "ops")
def appended_journal(spark, sf_dir):
    """The journal that four batches append, two of which come twice."""
    o = src.ops(spark, sf_dir)
    n = o.agg(F.max("sequence") + 1).first()[0]
    rows = o.select(F.least(F.lit(3), F.expr(f"sequence * 4 div {n}")).cast("long").alias("_batch"), "microtime", F.col("sequence").alias("request"), "subject", F.repeat("field_json", 30).alias("label"))
    folder = scratch_folder(spark, "journal")
    for k in (0, 1, 1, 2, 0, 3):
        journal.append(rows.where(F.col("_batch") == k).drop("_batch"), k, folder)
    return journal.appended(spark, folder).select("batch", "microtime", "request", "subject", "label", "sequence")


# --- anchors --------------------------------------------------------------------------------------------------------

ANCHOR, FULL = 14_400_000_000, 6
_ENTRIES = f"""en as (select realm as history, subject, microtime // {ANCHOR} as anchor, case when arg_max(verb, sequence) = 'delete' then null else arg_max(payload_length, sequence) end as size from ops group by 1, 2, 3),
 lim as (select min(anchor) as lo, max(anchor) as hi from en), ks as (select unnest(range(lo, hi + 1)) as k from lim), fulls as (select k from ks, lim where k % {FULL} = 0 or k = lo),
 an as (select history, subject, anchor, false as "full", size from en where anchor not in (select k from fulls)
  union all select history, subject, k, true, size from (select history, subject, k, size, row_number() over (partition by history, subject, k order by anchor desc) as r from fulls join en on anchor <= k) where r = 1 and size is not null)"""


def _anchors(spark, sf_dir):
    found = anchors.entries(src.ops(spark, sf_dir), ANCHOR)
    first, last = found.agg(F.min("anchor"), F.max("anchor")).first()
    return anchors.written(found, first or 0, last or 0, FULL), last or 0


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + f', {_ENTRIES}\nselect history, anchor, "full", count(*) as subjects, count(*) - count(size) as removed, cast(coalesce(sum(size), 0) as bigint) as bytes from an group by 1, 2, 3')
def written_anchors(spark, sf_dir):
    """What the anchors of every four hours list, each sixth in full."""
    listed, _ = _anchors(spark, sf_dir)
    return listed.groupBy("history", "anchor", "full").agg(F.count("*").alias("subjects"), F.count_if(F.col("size").isNull()).alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query("select realm as history, subject, arg_max(payload_length, sequence) as size from ops group by 1, 2 having arg_max(verb, sequence) != 'delete'", "ops")
def anchored_subjects(spark, sf_dir):
    """The newest anchor resolved over its chain: the subjects there are at the end of the journal."""
    listed, last = _anchors(spark, sf_dir)
    chain = anchors.chain_of(listed, last).select("link", F.struct("history", "subject").alias("subject"), "size")
    return graph.resolve_anchor(chain).select("subject.history", "subject.subject", "size")


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + f""", {_ENTRIES}, seg as (select distinct realm as history, subject, microtime // {ANCHOR} as anchor from ops)
 select history, anchor, count(*) as commits_that_name_it, (select count(*) from an where an.history = seg.history and an.anchor = seg.anchor) as members from seg group by 1, 2""")
def anchor_members(spark, sf_dir):
    """How many subjects were written in an anchor's interval, and how many the anchor lists."""
    listed, _ = _anchors(spark, sf_dir)
    members = listed.groupBy("history", "anchor").agg(F.count("*").alias("members"))
    named = src.ops(spark, sf_dir).select(F.col("realm").alias("history"), "subject", F.expr(f"microtime div {ANCHOR}").alias("anchor")).distinct().groupBy("history", "anchor").agg(F.count("*").alias("commits_that_name_it"))
    return named.join(members, ["history", "anchor"], "left").select("history", "anchor", "commits_that_name_it", F.coalesce("members", F.lit(0)).alias("members"))


# --- nested payloads ------------------------------------------------------------------------------------------------


def _body(o: DataFrame) -> DataFrame:
    """The journal with payloads of several levels around its own: lists, empty maps, and texts that look like maps."""
    quoted = F.to_json(F.struct(F.concat(F.lit("{"), "field").alias("brace"), F.col("field_json").alias("text"), F.lit("{}").alias("empty")))
    parts = [F.lit('{"own": '), "field_json", F.lit(', "list": [3, '), "field_json", F.lit('], "none": {}, "text": '), quoted, F.lit(', "deep": {"a": {"b": {"'), "field", F.lit('": '), F.col("actor").cast("string"), F.lit(', "off": null}}}'),
             F.when(F.col("sequence") % 3 == 0, ', "flag": true').otherwise(F.lit("")), F.lit("}")]
    return o.withColumn("body", F.when(F.col("sequence") % 50 == 49, F.lit("{broken")).otherwise(F.concat(*parts)))


_LEAVES = """lv as (select sequence, realm, subject, unnest([{'path': 'own.k', 'kind': 'bigint', 'value': cast(json_extract(field_json, '$.k') as varchar)}, {'path': 'list', 'kind': 'array', 'value': concat('[3,', replace(field_json, ' ', ''), ']')},
  {'path': 'none', 'kind': 'object', 'value': '{}'}, {'path': 'text.brace', 'kind': 'string', 'value': concat('{', field)}, {'path': 'text.text', 'kind': 'string', 'value': field_json}, {'path': 'text.empty', 'kind': 'string', 'value': '{}'},
  {'path': concat('deep.a.b.', field), 'kind': 'bigint', 'value': cast(actor as varchar)}, {'path': 'deep.a.b.off', 'kind': 'void', 'value': null}, case when sequence % 3 = 0 then {'path': 'flag', 'kind': 'boolean', 'value': 'true'} end]) as l from ops where sequence % 50 != 49)"""


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + f", {_LEAVES}\nselect sequence, l.path as path, l.kind as kind, l.value as value from lv where l is not null")
def nested_payloads(spark, sf_dir):
    """The leaves of payloads of several levels; one in fifty can't be read and has none."""
    return payloads.leaves(_body(src.ops(spark, sf_dir)), ["sequence"], "body")


@query(with_views("select 1", "ops").rsplit("\n", 1)[0] + f""", {_LEAVES}, nr as (select sequence, realm, subject, row_number() over (partition by realm, subject order by sequence) as version, count(*) over (partition by realm, subject) as z from ops where realm = 'config'),
 cur as (select realm, subject, version, l.path as path, l.kind as kind, l.value as value, z from lv join nr using (sequence, realm, subject) where l is not null),
 both_ as (select coalesce(a.realm, b.realm) as realm, coalesce(a.subject, b.subject) as subject, coalesce(a.version, b.version + 1) as version, coalesce(a.path, b.path) as path, a.kind as ak, a.value as av, b.kind as bk, b.value as bv
  from cur a full join (select * from cur where version < z) b on a.realm = b.realm and a.subject = b.subject and a.version = b.version + 1 and a.path = b.path)
 select realm, subject, version, path, case when bk is null then 'set' when ak is null then 'removed' else 'changed' end as change, coalesce(ak, bk) as kind, bv as "before", av as value from both_ where ak is distinct from bk or av is distinct from bv""")
def captured_config(spark, sf_dir):
    """What each version of a configuration object changes, leaf by leaf."""
    return payloads.config_changes(_body(src.ops(spark, sf_dir).where("realm = 'config'")), ["realm", "subject"], ["sequence"], "body")


# --- stored objects -------------------------------------------------------------------------------------------------

#: Fifty documents make a commit an hour apart; frames are of 4 KB and lie in packs by the first digits of their address.
_PIECES = """pc as (select doc_id // 50 as number, sha256(b) as hash, octet_length(b) as raw, b from (select doc_id, encode(coalesce(text, ''))[p * 4096 + 1 : (p + 1) * 4096] as b from documents, unnest(range(0, greatest(octet_length(encode(coalesce(text, ''))) - 1, 0) // 4096 + 1)) t(p))),
 fr as (select hash, max(raw) as raw, concat('p', substr(hash, 1, 2)) as pack from pc group by 1), cm as (select distinct number from pc), tip as (select max(number) * 4 // 5 as t from cm), bad as (select hash, pack, concat('0x', substr(hash, 5, 2))::integer % 29 as k from fr)"""


def _pieces(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pieces = cut(d, "doc_id", "text", 4096)
    return staged(pieces.select(F.expr("doc_id div 50").alias("number"), "block", F.sha2("block", 256).alias("hash")))


def _stored(spark, sf_dir, damaged: bool = False):
    """Packs, manifests and commits of all documents in a new folder, and refs to four fifths of the history; damaged: some lines cut or changed, some manifests left out."""
    p = _pieces(spark, sf_dir)
    folder = scratch_folder(spark, "objects")
    frames = p.groupBy("hash").agg(F.first("block").alias("body")).withColumn("pack", F.concat(F.lit("p"), F.substring("hash", 1, 2))).withColumn("parent", F.lit(None).cast("string")).withColumn("dictionary", F.when(F.substring("hash", 3, 1) < "8", F.substring("hash", 3, 1)))
    k = F.conv(F.substring("hash", 5, 2), 16, 10).cast("int") % 29
    if damaged:
        frames = frames.withColumn("body", F.when(k == 3, F.concat("body", F.encode(F.lit("?"), "utf-8"))).otherwise(F.col("body"))).withColumn("hash", F.when(k == 5, F.lit(None)).otherwise(F.col("hash")))
    objects.write_packs(frames, folder)
    second = (F.col("number") * 3600).alias("second")
    manifests = p.groupBy("number").agg(F.array_sort(F.collect_set("hash")).alias("frames")).select("number", second, "frames")
    objects.write_manifests(manifests.where("number % 7 != 4") if damaged else manifests, folder)
    c = p.select("number").distinct().select("number", second.alias("segment"), (F.col("number") * 3_600_000_000).alias("microtime"))
    commits = objects.addressed(c).withColumn("parent", F.lag("id").over(Window.orderBy("number"))).withColumn("merge", F.lit(None).cast("string"))  # a row a commit
    if damaged:
        commits = commits.withColumn("content", F.when(F.col("number") == 2, F.lit("{")).otherwise(F.col("content")))
    objects.write_commits(commits, folder)
    tip = c.agg(F.expr("max(number) * 4 div 5")).first()[0]
    refs = commits.where(F.col("number") <= tip).orderBy(F.desc("number")).limit(1).select(F.lit("main").alias("name"), F.col("id").alias("tip"))
    return folder, staged(refs)


@query(f"with {_PIECES}, rf as (select hash, count(distinct number) as refs from pc where number <= (select t from tip) group by 1) select hash, pack, raw, coalesce(refs, 0) as refs from fr left join rf using (hash)")
def reindexed_frames(spark, sf_dir):
    """The frame index made again from the stored objects, with references from the segments that the ref leads to."""
    folder, refs = _stored(spark, sf_dir)
    return objects.reindex(spark, folder, refs).frames.select("hash", "pack", "raw", "refs")


@query(f"""with {_PIECES}, rf as (select hash, count(distinct number) as refs from pc where number <= (select t from tip) and number > 2 and number % 7 != 4 group by 1)
 select hash, pack, raw, coalesce(refs, 0) as refs from fr join bad using (hash, pack) left join rf using (hash) where k not in (3, 5)""")
def reindexed_damage(spark, sf_dir):
    """The same from a store in which bodies were changed, addresses lost, manifests left out, and a commit of the chain cut."""
    folder, refs = _stored(spark, sf_dir, damaged=True)
    return objects.reindex(spark, folder, refs).frames.select("hash", "pack", "raw", "refs")


@query(f"""with {_PIECES} select 'pack' as kind, case k when 3 then 'frame.hash_mismatch' else 'entry.unreadable' end as code, count(*) as n from bad where k in (3, 5) group by 1, 2
 union all select 'commit', 'commit.unreadable', count(*) from cm where number = 2 having count(*) > 0 union all select 'commit', 'commit.missing', 1 from tip where t >= 2 union all select 'segment', 'segment.missing', count(*) from cm, tip where number > 2 and number <= t and number % 7 = 4 having count(*) > 0""")
def reindex_problems(spark, sf_dir):
    """What a rebuild reports of that store."""
    folder, refs = _stored(spark, sf_dir, damaged=True)
    return objects.reindex(spark, folder, refs).problems.groupBy("kind", "code").agg(F.count("*").alias("n"))


@query("select s.second, cast(count(*) as bigint) as files from (select distinct microtime // 3600000000 * 3600 as second from ops) s where second between 1704067200 + 86400 * 3 and 1704067200 + 86400 * 9 group by 1", "ops")
def segment_keys(spark, sf_dir):
    """The hourly segments of six days, from the listing of a written store alone."""
    folder = scratch_folder(spark, "segments")
    o = src.ops(spark, sf_dir).withColumn("second", F.expr("microtime div 3600000000 * 3600"))
    objects.write_manifests(o.groupBy("second").agg(F.array_sort(F.collect_set(F.sha2("field_json", 256))).alias("frames")), folder)
    start = 1_704_067_200 + 86_400 * 3
    return objects.segment_keys(spark, folder, start, start + 86_400 * 6).groupBy("second").agg(F.count("*").alias("files"))


@query("select realm, microtime // 86400000000 as day, count(*) as operations, min(sequence) as first_sequence, max(sequence) as last_sequence from ops where microtime // 86400000000 * 86400 between 1704067200 + 86400 * 3 and 1704067200 + 86400 * 9 group by 1, 2", "ops")
def segment_rows(spark, sf_dir):
    """Operations read back from the written segments of seven days; the others' files aren't opened."""
    folder, day = scratch_folder(spark, "segments"), 86_400_000_000
    files.write_segments(src.ops(spark, sf_dir), folder, day)
    start = 1_704_067_200_000_000 + 3 * day
    rows = files.read_segments(spark, folder, start, start + 6 * day)
    return rows.groupBy("realm", F.expr(f"microtime div {day}").alias("day")).agg(F.count("*").alias("operations"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


_TREE = "select c_nationkey as nation, string_agg(concat(c_name, ' ', c_mktsegment, chr(10)), '' order by c_custkey) as body from customer where c_custkey % 10 != {skip} group by 1"


@query(f"select nation, octet_length(encode(body)) as length, sha256(encode(body)) as hash from ({_TREE.format(skip=99)})")
def scanned_tree(spark, sf_dir):
    """A tree of text files, one a nation, with the digests of their bytes."""
    found = files.scan_tree(spark, _tree(spark, sf_dir, 99))
    return found.select(F.regexp_extract("path", r"nation=(\d+)/", 1).cast("int").alias("nation"), "length", "hash")


def _tree(spark, sf_dir, skip: int) -> str:
    folder = scratch_folder(spark, "tree")
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != skip)
    c.select("c_custkey", F.col("c_nationkey").alias("nation"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("value")).repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(folder)
    return folder


@query(f"select nation, 'changed' as status from ({_TREE.format(skip=99)}) a join ({_TREE.format(skip=3)}) b using (nation) where a.body != b.body union all select nation, 'removed' from ({_TREE.format(skip=99)}) where nation not in (select nation from ({_TREE.format(skip=3)}))")
def drifted_tree(spark, sf_dir):
    """Files that differ between two trees of customers by nation, the second without a tenth of its lines."""
    name = F.regexp_extract("path", r"nation=(\d+)/", 1)
    a, b = (files.scan_tree(spark, _tree(spark, sf_dir, k)).withColumn("path", name) for k in (99, 3))
    return files.compare_trees(a, b).select(F.col("path").cast("int").alias("nation"), "status")


# --- repair and dictionaries ----------------------------------------------------------------------------------------

_RANK = "case {c} when 'observe' then 0 when 'reindex' then 1 when 'refetch' then 2 when 'rebuild' then 3 when 'quarantine' then 4 else 5 end"
_RUNG = "['observe', 'reindex', 'refetch', 'rebuild', 'quarantine', 'refuse'][{at} + 1]"
#: Two passes, an hour apart, over findings by code and scope; of the rungs only one works, and a code has failed twice before the first.
_PASS = """{n}c as (select code, max({rank}) as pos, count(case when resolved is null then 1 end) as open, max(case when resolved is null then severity end) as worst from {f} group by 1 having count(case when resolved is null then 1 end) > 0),
 {n}s as (select code, {rung} as rung, open, worst, coalesce(failures, 0) as failures, coalesce(opened, 0) as opened from {n}c left join {b} using (code)),
 {n}k as (select *, case when rung = 'observe' then 'watched' when rung not in ('reindex', 'refetch', 'rebuild') then 'held' when failures >= 3 and {now} - opened < 300 then 'waiting' else 'run' end as kind from {n}s),
 {n}t as (select *, row_number() over (partition by rung, kind order by worst desc, open desc, code) as turn from {n}k),
 {n}r as (select code, rung, open, worst, case when kind != 'run' then kind when turn > {budget} then 'postponed' when rung = '{works}' then 'repaired' else 'failed' end as result, failures as was, opened as before from {n}t),
 {n} as (select code, rung, open, worst, result, case when result = 'failed' then ['observe', 'reindex', 'refetch', 'rebuild', 'quarantine', 'refuse'][least({rank} + 2, 6)] else rung end as next_rung,
  cast(case result when 'repaired' then 0 when 'failed' then was + 1 else was end as bigint) as failures, cast(case when result = 'repaired' then 0 when result = 'failed' and was + 1 >= 3 then {now} else before end as bigint) as opened from {n}r)"""
_FOUND = "fi as (select concat(code, ':', id % 40) as code, scope, severity, case when rung in ('quarantine', 'refuse') and id % 40 < 30 then 'reindex' else rung end as rung, resolved from findings where id % 40 < 38 or rung = 'observe')"
_TWO_PASSES = with_views("select 1", "findings").rsplit("\n", 1)[0] + f", {_FOUND}, br as (select distinct code, 2 as failures, 0 as opened from fi where code like '%:7'), " + _PASS.format(n="p1", f="fi", b="br", now=1000, budget=25, works="rebuild", rank=_RANK.format(c="rung"), rung=_RUNG.format(at="pos")) + \
    ", f2 as (select code, scope, severity, case when p1.result = 'failed' then p1.next_rung else fi.rung end as rung, case when p1.result = 'repaired' and resolved is null then 1000 else resolved end as resolved from fi left join p1 using (code)), b2 as (select code, coalesce(p1.failures, br.failures) as failures, coalesce(p1.opened, br.opened) as opened from br full join p1 using (code) where coalesce(p1.failures, br.failures) > 0), " + \
    _PASS.format(n="p2", f="f2", b="b2", now=1100, budget=25, works="refetch", rank=_RANK.format(c="rung"), rung=_RUNG.format(at="pos"))


def _repaired(spark, sf_dir):
    i = F.col("id") % 40
    rung = F.when(F.col("rung").isin("quarantine", "refuse") & (i < 30), "reindex").otherwise(F.col("rung"))
    found = src.findings(spark, sf_dir).where((i < 38) | (F.col("rung") == "observe")).select(F.concat_ws(":", "code", i.cast("string")).alias("code"), "scope", "severity", rung.alias("rung"), "resolved")
    breakers = found.where("code like '%:7'").select("code", F.lit(2).cast("long").alias("failures"), F.lit(0).cast("long").alias("opened")).distinct()
    works = lambda rung: spark.createDataFrame([(rung, True)], "rung string, ok boolean")
    first = staged(repair.repair_pass(found, breakers, works("rebuild"), 1000, 25))
    left = repair.after_pass(found, first, 1000)
    return first, staged(repair.repair_pass(left, repair.breakers_after(breakers, first), works("refetch"), 1100, 25))


@query(_TWO_PASSES + " select 1 as pass, * from p1 union all select 2, * from p2")
def repair_passes(spark, sf_dir):
    """What two repair passes do with each code: the second starts from the rungs, breakers and findings that the first left."""
    first, second = _repaired(spark, sf_dir)
    return first.select(F.lit(1).alias("pass"), "*").union(second.select(F.lit(2), "*"))


@query(_TWO_PASSES + " select count(*) as considered, count(case when result = 'repaired' then 1 end) as repaired, count(case when result = 'failed' then 1 end) as failed, count(case when result in ('held', 'waiting', 'postponed') then 1 end) as held, cast(coalesce(sum(case when result = 'repaired' then open end), 0) as bigint) as cleared from p2")
def repair_totals(spark, sf_dir):
    return repair.totals(_repaired(spark, sf_dir)[1])


@query()
def dictionary_training(spark, sf_dir):
    """Dictionaries of documents by language: what the better candidate gains on samples that it wasn't made from."""
    return dictionaries.training(table(spark, sf_dir, "documents"), "lang", "text").drop("dictionary")


@query("""with s as (select lang as realm, text, sha256(encode(text)) as digest from documents where length(text) > 0), r as (select *, dense_rank() over (partition by realm order by digest) as place from s qualify place <= 400), u as (select distinct realm, place, octet_length(encode(text)) as n from r)
 select realm, count(*) as samples, count(case when place <= greatest(1, z // 2) then 1 end) as build, cast(sum(least(n, 65536)) as bigint) as bytes from (select *, count(*) over (partition by realm) as z from u) group by 1""")
def training_samples(spark, sf_dir):
    """The samples that dictionaries are trained on, by language."""
    rows = dictionaries.sampled(table(spark, sf_dir, "documents"), "lang", "text")
    return rows.groupBy("realm").agg(F.count("*").alias("samples"), F.count_if(F.col("part") == "build").alias("build"), F.sum(F.length("body")).alias("bytes"))
