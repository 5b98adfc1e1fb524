"""The commit graph: ancestors, merge bases, what is reachable, what may be collected and what a removal frees.

Walks over commits and anchors go by the levels of walks; delta chains of frames are short and are walked in plain rounds. What a
level or a round gives is written to the shared folder, so lineage stays short and a lost executor costs one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import shuffled, staged
from . import walks
from .ranges import first_from, numbered


def edges(commits: DataFrame, every: int = 10, back: int = 3) -> DataFrame:
    """(child, parent, side) of a history whose every 10th commit also merges the one 3 before it."""
    rows = commits.select(F.col("commit_no").alias("child"), F.col("parent_no").alias("parent"))
    first = rows.where("parent is not null").select("child", "parent", F.lit(0).alias("side"))
    merges = rows.where(F.col("child") % every == 0).select("child", (F.col("child") - back).alias("parent"))
    known = commits.select(F.col("commit_no").alias("parent"))
    return first.unionByName(merges.join(known, "parent", "left_semi").withColumn("side", F.lit(1)))


def reachable(edges: DataFrame, seeds: DataFrame, found: list[walks.Level] | None = None) -> DataFrame:
    """(node, depth) of all nodes that are reached from seeds (node) along child to parent, with the fewest steps.

    Rounds grow with the logarithm of the history, see walks. Several walks over the same edges share its levels if they are given.
    """
    start = seeds.select(F.lit(0).alias("label"), "node")
    return walks.reached(found or walks.levels(edges), start).select("node", "depth")


def reachable_of(edges: DataFrame, tips: list[int], found: list[walks.Level] | None = None) -> DataFrame:
    """(label, node, depth) of what each tip reaches, all in one walk; label is the tip's place in the list."""
    start = edges.sparkSession.createDataFrame([(k, t) for k, t in enumerate(tips)], "label int, node long")
    return staged(walks.reached(found or walks.levels(edges), start))


def follow(start: DataFrame, jump: DataFrame) -> DataFrame:
    """(node, depth) from start (node, depth) along jump (node, up; one a node), by pointer doubling: log2 of the length in rounds."""
    walked, jump = start.select("node", F.col("depth").cast("long")), staged(jump.select("node", "up"))
    for k in range(62):
        more = walked.join(shuffled(jump), "node").select(F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        walked = staged(walked.union(more))
        jump = staged(jump.join(shuffled(jump.select(F.col("node").alias("up"), F.col("up").alias("up2"))), "up").select("node", F.col("up2").alias("up")))
        if not jump.limit(1).count():
            return walked
    raise ValueError("the pointers run in a circle")


def chain(edges: DataFrame, commits: DataFrame, tip: int) -> DataFrame:
    """(node, depth) along first parents from a tip."""
    return reachable(edges.where("side = 0"), commits.sparkSession.createDataFrame([(tip,)], "node long"))


def common(both: DataFrame) -> DataFrame:
    """Of what labels 0 and 1 reach (label, node, depth), the common node nearest to label 1 (fewest steps, then the largest): node, depth; or no row."""
    left = both.where("label = 0").select("node")
    return both.where("label = 1").join(left, "node", "left_semi").orderBy("depth", F.desc("node")).limit(1).select("node", "depth")


def merge_base(edges: DataFrame, left: int, right: int) -> DataFrame:
    """The nearest commit to right (fewest steps, then the largest number) that left also descends from: commit_no, depth."""
    return common(reachable_of(edges, [left, right])).withColumnRenamed("node", "commit_no")


def touched(ops: DataFrame, edges: DataFrame, tip: int, base: int) -> DataFrame:
    """Subjects that commits reachable from tip but not from base touched: realm, subject, n."""
    both = reachable_of(edges, [tip, base])
    ahead = both.where("label = 0").join(both.where("label = 1").select("node"), "node", "left_anti").select(F.col("node").alias("commit_no"))
    return ops.join(ahead, "commit_no", "left_semi").groupBy("realm", "subject").agg(F.count("*").alias("n"))


def prune_gate(edges: DataFrame, commits: DataFrame, refs: DataFrame, live: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """One row that says whether pruning may go on: reached, missing_commits, looping_commits, unreadable, refuse, reason.

    An incomplete walk reports too little as live, so pruning must refuse where a commit that refs (node) lead to isn't among commits
    (commit_no), where a reached commit is its own ancestor, or where a live object (kind, id) isn't present. reason is the first of
    these, null if there is none.
    """
    found = walks.levels(edges)
    at = staged(reachable(edges, refs, found).select("node"))
    missing = at.join(commits.select(F.col("commit_no").alias("node")), "node", "left_anti")
    looping = walks.cycles(edges, found=found).join(at, "node", "left_semi")
    counts = at.select(F.lit(1).alias("a"), F.lit(0).alias("m"), F.lit(0).alias("l"), F.lit(0).alias("u"))
    counts = counts.union(missing.selectExpr("0", "1", "0", "0")).union(looping.selectExpr("0", "0", "1", "0"))
    if live is not None:
        counts = counts.union(live.where("kind <> 'commit'").join(present, ["kind", "id"], "left_anti").selectExpr("0", "0", "0", "1"))
    row = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip("amlu", ("reached", "missing_commits", "looping_commits", "unreadable"))])
    reason = F.when(F.col("looping_commits") > 0, "commits.loop").when(F.col("missing_commits") > 0, "commits.missing").when(F.col("unreadable") > 0, "objects.unreadable")
    return row.withColumn("refuse", reason.isNotNull()).withColumn("reason", reason)


def collectable(frames: DataFrame, live: DataFrame, parents: DataFrame) -> DataFrame:
    """Frames (hash, refs, stored) that nothing needs: no references, not live, and no live or referenced frame is coded against them."""
    needed = parents.join(frames.where("refs > 0").select("hash").union(live.select("hash")).distinct(), "hash", "left_semi").select(F.col("parent").alias("hash"))
    return frames.where("refs = 0").join(live, "hash", "left_anti").join(needed, "hash", "left_anti")


def removal_cost(members: DataFrame) -> DataFrame:
    """What removing each commit would free, from (commit_no, hash, stored): blocks that no other commit has, their bytes, and the retained ones."""
    owners = members.groupBy("hash").agg(F.count_distinct("commit_no").alias("owners"))
    out = members.select("commit_no", "hash", "stored").distinct().join(owners, "hash")
    own = F.col("owners") == 1
    return out.groupBy("commit_no").agg(F.count_if(own).alias("freed"), F.coalesce(F.sum(F.when(own, F.col("stored"))), F.lit(0)).cast("long").alias("freed_bytes"), F.count_if(~own).alias("retained"))


def resolve_anchor(entries: DataFrame) -> DataFrame:
    """The newest entry of each subject over a chain of anchors (link, subject, size; size null: a tombstone), without tombstones."""
    return entries.groupBy("subject").agg(F.max_by(F.struct("size"), "link").alias("x"), F.max("link").alias("link")).where("x.size is not null").select("subject", "link", "x.size")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to commits that aren't there: a walk over these is incomplete, and pruning must refuse."""
    return edges.join(nodes.select(F.col("commit_no").alias("parent")), "parent", "left_anti").select("child", "parent")


def chain_depths(frames: DataFrame) -> DataFrame:
    """(hash, depth): links from each frame (hash, parent; one row a hash) to the last frame of its chain that is there.

    Pointer doubling, log2 of the deepest chain in rounds. A frame without a parent, or whose parent isn't there, is at 0.
    """
    known = frames.select(F.col("hash").alias("parent"), F.lit(True).alias("_there"))
    at = frames.select("hash", "parent").join(shuffled(known), "parent", "left").select("hash", F.when(F.col("_there"), F.col("parent")).alias("up"))
    at = staged(at.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")))
    for _ in range(62):
        if not at.where("up is not null").limit(1).count():
            return at.select("hash", "depth")
        on = at.select(F.col("hash").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        at = staged(at.join(shuffled(on), "up", "left").select("hash", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
    raise ValueError("the chains run in a circle")


def deepest_chains(depths: DataFrame, least: int, limit: int = 100) -> DataFrame:
    """The deepest delta frames from a depth on: hash, depth; of equal ones the least hash first."""
    return depths.where((F.col("depth") >= least) & (F.col("depth") > 0)).orderBy(F.desc("depth"), "hash").limit(limit)


def reanchor(frames: DataFrame, cap: int = 32, budget: int = 200) -> DataFrame:
    """(hash, before, after) of frames in chains, where the deepest `budget` of those past the cap are written without a parent."""
    before = staged(chain_depths(frames))
    alone = deepest_chains(before, cap + 1, budget).select("hash", F.lit(True).alias("_alone"))
    rewritten = frames.join(alone, "hash", "left").select("hash", F.when(F.col("_alone").isNull(), F.col("parent")).alias("parent"))
    return before.where("depth > 0").withColumnRenamed("depth", "before").join(shuffled(chain_depths(rewritten).withColumnRenamed("depth", "after")), "hash")


def anchors_due(commits: DataFrame, interval: int = 14_400, full_every: int = 24) -> DataFrame:
    """The commits (history, microtime) that write an anchor: history, microtime, number, full.

    The first one does, then each that is `interval` seconds or more after the anchor before; every full_every-th anchor is
    full. Each commit points at the one that would be next after it; the anchors are what these pointers reach.
    """
    at = staged(numbered(commits.select("history", "microtime").distinct(), "history", "microtime"))
    last = at.groupBy("history").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    found = first_from(at, at.select("history", (F.col("microtime") + interval * 1_000_000).alias("microtime"), F.col("number").alias("node")), ["history", "microtime"], name="up")
    jump = found.join(F.broadcast(last), found["history"].eqNullSafe(last["history"])).where("up <= last").select("node", "up")  # a row a history
    start = last.select(F.col("first").alias("node"), F.lit(0).alias("depth"))
    return follow(start, jump).join(at, F.col("node") == F.col("number")).select("history", "microtime", F.col("depth").alias("number"), (F.col("depth") % full_every == 0).alias("full"))


def live_objects(edges: DataFrame, refs: DataFrame, anchors: DataFrame, anchor_parents: DataFrame, names: DataFrame, frame_parents: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """(kind, id) of all that refs (node) need: commits, their anchors back to a full one, the frames both name, delta parents, dictionaries.

    anchors: commit_no, anchor. anchor_parents, frame_parents: child, parent (a full anchor has none). names: kind ("commit" or
    "anchor"), owner, frame. dictionaries: frame, dictionary. Named objects that aren't there are live too: live_counts() and verify() tell.
    """
    commits = staged(reachable(edges, refs).select(F.col("node").alias("owner")))
    tips = anchors.join(commits.withColumnRenamed("owner", "commit_no"), "commit_no", "left_semi").select(F.col("anchor").alias("node"))
    bases = staged(reachable(anchor_parents, tips).select(F.col("node").alias("owner")))
    owners = commits.withColumn("kind", F.lit("commit")).union(bases.withColumn("kind", F.lit("anchor")))
    seeds = names.join(owners, ["kind", "owner"], "left_semi").select(F.col("frame").alias("node")).distinct()
    frames = staged(walks.in_rounds(frame_parents.select("child", "parent", F.lit(1).alias("steps")), seeds.select(F.lit(0).alias("label"), "node", F.lit(0).cast("long").alias("depth"))).select(F.col("node").alias("frame")))
    used = dictionaries.join(frames, "frame", "left_semi").select("dictionary").distinct()
    kinds = {"commit": commits, "anchor": bases, "frame": frames, "dictionary": used}
    out = [df.toDF("id").select(F.lit(kind).alias("kind"), "id") for kind, df in kinds.items()]
    return staged(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]))


def live_counts(live: DataFrame, present: DataFrame) -> DataFrame:
    """One row: live commits, anchors, frames, dictionaries, and the live objects that aren't among the present ones (kind, id)."""
    there = live.join(present.withColumn("_p", F.lit(True)).distinct(), ["kind", "id"], "left")
    return there.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("commit", "anchor", "frame")], F.count_if(F.col("kind") == "dictionary").alias("dictionaries"), F.count_if(F.col("_p").isNull()).alias("unreadable"))


#: Why an object must stay, by its kind.
REASONS = {"commit": "reached from a ref", "anchor": "a reachable commit needs it", "frame": "a live object names it", "dictionary": "a live frame needs it"}


def reasons(present: DataFrame, live: DataFrame, referenced: DataFrame) -> DataFrame:
    """Why each present object (kind, id) must stay, null if nothing needs it. referenced: (id, n) frames with references by dictionary."""
    out = present.join(live.withColumn("_live", F.lit(True)), ["kind", "id"], "left").join(referenced.select("id", F.col("n").alias("_n"), F.lit("dictionary").alias("kind")), ["kind", "id"], "left")
    text = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("kind")]
    return out.select("kind", "id", F.when(F.col("_live"), text).when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" referenced frames need it"))).alias("reason"))


def verify(edges: DataFrame, refs: DataFrame, live: DataFrame, present: DataFrame, frame_parents: DataFrame, contents: DataFrame, cap: int = 32) -> DataFrame:
    """Findings (code, scope) of a sweep over everything live, each an anti join against what is present (kind, id).

    frame_parents also gives the depth of chains; contents: (frame, body, digest) is hashed again.
    """
    there = lambda kind: present.where(F.col("kind") == kind).select("id")
    gone = live.join(present, ["kind", "id"], "left_anti")
    found = gone.where("kind in ('anchor', 'frame')").select(F.concat("kind", F.lit(".missing")).alias("code"), "id")
    found = found.union(gone.where("kind = 'dictionary'").select(F.lit("dict.missing"), "id"))
    found = found.union(refs.select(F.col("node").alias("id")).join(there("commit"), "id", "left_anti").select(F.lit("ref.missing"), "id"))
    mine = edges.join(live.where("kind = 'commit'").select(F.col("id").alias("child")), "child", "left_semi")
    found = found.union(mine.join(there("commit").withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("commit.parent_missing"), F.col("child")).distinct())
    needed = live.where("kind = 'frame'").select(F.col("id").alias("child"))
    links = frame_parents.join(needed, "child", "left_semi")
    found = found.union(links.join(there("frame").withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("delta.parent_missing"), "child"))
    deep = chain_depths(frame_parents.select(F.col("child").alias("hash"), "parent").unionByName(frame_parents.select(F.col("parent").alias("hash")).distinct().join(frame_parents.select(F.col("child").alias("hash")), "hash", "left_anti").withColumn("parent", F.lit(None).cast("long"))))
    found = found.union(deep.where(F.col("depth") > cap).join(needed.withColumnRenamed("child", "hash"), "hash", "left_semi").select(F.lit("delta.chain_too_deep"), "hash"))
    wrong = contents.where(~F.sha2("body", 256).eqNullSafe(F.col("digest"))).select(F.col("frame").alias("id"))
    found = found.union(wrong.join(needed.withColumnRenamed("child", "id"), "id", "left_semi").select(F.lit("frame.hash_mismatch"), "id"))
    return found.select("code", F.col("id").alias("scope"))
