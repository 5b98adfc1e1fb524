"""The closure of an archive: every object that the newest commits of a history need to be restored on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from . import walks
from .ranges import numbered, running

#: A line's rank is held above this many bits of a walk's steps.
RANK_BITS = 40


def newest_commits(edges: DataFrame, head: int, limit: int | None = None) -> DataFrame:
    """(number, commit_no, missing): commits in the order an archive takes them in, up to a limit.

    edges: child, parent, side (0: the first parent, else a merged one), present: whether the child itself is there. First comes the line of
    first parents from the head, then the lines of the merged parents in the order in which their merges came, each up to the first
    commit that an earlier line has. A commit that isn't there ends its line; it is a row with missing true and takes no number.

    All lines that one generation of lines merges are walked at once: a commit belongs to the line of least rank, so the rank is the upper
    part of the steps. Rounds grow with how deep merges of merges go, not with the number of commits or lines.
    """
    spark = edges.sparkSession
    there = edges.where("present").select(F.col("child").alias("node")).distinct()
    first = edges.where("present and side = 0 and parent is not null").select("child", "parent")
    merged = staged(edges.where("present and side > 0 and parent is not null").select("child", "parent", "side"))
    tips = spark.createDataFrame([(0, head)], "rank long, node long")
    taken: DataFrame | None = None
    count = 0
    while limit is None or count < limit:
        open_ = first if taken is None else first.join(taken.select(F.col("node").alias("child")), "child", "left_anti")
        start = tips.select(F.lit(0).alias("label"), "node", (F.col("rank") * (1 << RANK_BITS)).alias("depth"))
        line = walks.reached(walks.levels(open_), start)
        if taken is not None:
            line = line.join(taken.select("node"), "node", "left_anti")
        line = line.join(there.withColumn("_there", F.lit(True)), "node", "left")
        line = staged(line.select("node", "depth", F.col("_there").isNull().alias("missing")))
        at = running(line, ["depth"], {"number": "case when missing then cast(0 as bigint) else cast(1 as bigint) end"})
        if limit is not None:  # a commit takes the place that is left; a missing one is met while there are places left
            at = at.where(F.col("number") <= limit - count - F.col("missing").cast("int"))
        got = staged(at.select("node", "missing", F.when(~F.col("missing"), F.col("number") + (count - 1)).alias("number")))
        here = got.where("not missing")
        taken = staged(got if taken is None else taken.union(got))
        new = here.count()
        count += new
        after = merged.join(here.select(F.col("node").alias("child"), "number"), "child").join(taken.select(F.col("node").alias("parent")), "parent", "left_anti")
        after = after.groupBy(F.col("parent").alias("node")).agg(F.min(F.struct("number", "side")).alias("_at"))
        tips = staged(numbered(after.select("node", "_at.number", "_at.side").withColumnRenamed("number", "_n"), "_n", "side", "node", name="rank").select("rank", "node"))
        if not new or not tips.limit(1).count():
            break
    return taken.select("number", F.col("node").alias("commit_no"), "missing")


def closure(commits: DataFrame, segments: DataFrame, anchors: DataFrame, anchor_parents: DataFrame, names: DataFrame, frames: DataFrame, dictionaries: DataFrame, ref: str = "main") -> DataFrame:
    """(part, kind, id, key): the objects that commits need, and what is wrong with them.

    commits: commit_no, missing, as newest_commits() gives them. segments: commit_no, segment, readable. anchors: commit_no, anchor.
    anchor_parents: child, parent, of the anchors that are there (a full anchor has a null parent). names: kind ("segment", "anchor"),
    owner, frame. frames: frame, pack, parent, dictionary (the index). dictionaries: dictionary (those there). Part "object" has each object
    once: a packed frame is its whole pack; part "problem" names what is missing: the key is a code then.
    """
    here = commits.where("not missing").select("commit_no")
    segment = staged(segments.join(here, "commit_no", "left_semi").where("segment is not null").select("segment", "readable").distinct())
    tips = anchors.join(here, "commit_no", "left_semi").where("anchor is not null").select(F.lit(0).alias("label"), F.col("anchor").alias("node")).distinct()
    known = anchor_parents.select(F.col("child").alias("node")).distinct()
    linked = walks.reached(walks.levels(anchor_parents), tips).select("node").distinct()
    # a chain that leads to an anchor that isn't there is of no use: none of its anchors are taken
    back = anchor_parents.where("parent is not null").select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    broken = staged(walks.reached(walks.levels(back), linked.join(known, "node", "left_anti").select(F.lit(0).alias("label"), "node")).select("node"))
    chain, gone = staged(linked.join(broken, "node", "left_anti")), tips.select("node").join(broken, "node", "left_semi")
    owners = segment.where("readable").select(F.lit("segment").alias("kind"), F.col("segment").alias("owner")).union(chain.select(F.lit("anchor"), F.col("node")))
    seeds = names.join(owners, ["kind", "owner"], "left_semi").select(F.lit(0).alias("label"), F.col("frame").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    links = frames.where("parent is not null").select(F.col("frame").alias("child"), "parent", F.lit(1).cast("long").alias("steps"))
    needed = staged(walks.in_rounds(links, seeds).select(F.col("node").alias("frame")))
    resolved = staged(needed.join(frames.withColumn("_there", F.lit(True)), "frame", "left"))
    used = resolved.where("dictionary is not null").select("dictionary").distinct()
    row = lambda df, part, kind, id_, key: df.select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), key.alias("key"))
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    there = resolved.where("_there")
    parts = [
        row(here, "object", "commit", "commit_no", at("commits/", "commit_no")), row(segment, "object", "segment", "segment", at("segments/", "segment")), row(chain, "object", "anchor", "node", at("anchors/", "node")),
        row(there.where("pack is not null").select("pack").distinct(), "object", "pack", "pack", at("packs/", "pack")), row(there.where("pack is null"), "object", "frame", "frame", at("frames/", "frame")),
        row(used.join(dictionaries, "dictionary", "left_semi"), "object", "dictionary", "dictionary", at("dictionaries/", "dictionary")),
        here.limit(1).select(F.lit("object"), F.lit("ref"), F.lit(ref), F.lit(f"refs/{ref}")),
        row(commits.where("missing"), "problem", "commit", "commit_no", F.lit("chain.ended")), row(segment.where("not readable"), "problem", "segment", "segment", F.lit("segment.unreadable")),
        row(gone, "problem", "anchor", "node", F.lit("anchor.unwalkable")), row(resolved.where("_there is null"), "problem", "frame", "frame", F.lit("frame.unindexed")),
        row(used.join(dictionaries, "dictionary", "left_anti"), "problem", "dictionary", "dictionary", F.lit("dictionary.unindexed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
