"""An index made again from stored objects, whole and after files were removed, cut and changed."""

import hashlib
import json
import shutil
from pathlib import Path

from annalist.sources import objects
from pyspark.sql import functions as F

DAY = 86_400


def digest(b):
    return hashlib.sha256(b).hexdigest()


def store(spark, folder):
    bodies = [bytes([i]) * (i + 1) for i in range(40)]
    frames = [(f"p{i % 5}", digest(b), bytearray(b), digest(bodies[i - 1]) if i % 4 else None, "d" if i % 3 == 0 else None) for i, b in enumerate(bodies)]
    objects.write_packs(spark.createDataFrame(frames, "pack string, hash string, body binary, parent string, dictionary string"), folder)
    segments = {n * DAY: [digest(bodies[(n + j) % 40]) for j in (0, 1, 1, 7)] for n in range(12)}
    objects.write_manifests(spark.createDataFrame(list(segments.items()), "second long, frames array<string>"), folder)
    rows = spark.createDataFrame([(n, n * DAY, n * DAY * 1_000_000) for n in range(12)], "number long, segment long, microtime long")
    ids = {r.number: r.id for r in objects.addressed(rows).collect()}
    links = spark.createDataFrame([(n, ids[n - 1] if n else None, ids[n - 4] if n == 9 else None) for n in range(12)], "number long, parent string, merge string")
    objects.write_commits(objects.addressed(rows).join(links, "number"), folder)
    return frames, segments, ids


def rebuilt(spark, folder, tip):
    out = objects.reindex(spark, folder, spark.createDataFrame([("main", tip)], "name string, tip string"))
    frames = {r.hash: (r.pack, r.raw, r.parent, r.dictionary, r.refs) for r in out.frames.collect()}
    return frames, {(r.kind, r.key, r.code) for r in out.problems.collect()}, out


def expected(frames, segments, numbers):
    refs = {}
    for n in numbers:
        for h in set(segments[n * DAY]):
            refs[h] = refs.get(h, 0) + 1
    return {h: (pack, len(body), parent, dictionary, refs.get(h, 0)) for pack, h, body, parent, dictionary in frames}


def test_the_index_is_what_was_written(spark, tmp_path):
    folder = str(tmp_path / "store")
    frames, segments, ids = store(spark, folder)
    got, problems, out = rebuilt(spark, folder, ids[8])
    assert got == expected(frames, segments, range(9)) and not problems
    assert [r.id for r in out.commits.orderBy("number").collect()] == [ids[n] for n in range(12)]
    place = {r.hash: (r.offset, r.length) for r in out.frames.where("pack = 'p2'").collect()}
    raw = next(Path(folder, "packs", "pack=p2").glob("part-*")).read_bytes()
    for h, (offset, length) in place.items():
        assert json.loads(raw[offset : offset + length])["hash"] == h


def test_removed_cut_and_changed_files(spark, tmp_path):
    folder = str(tmp_path / "store")
    frames, segments, ids = store(spark, folder)
    shutil.rmtree(Path(folder, "packs", "pack=p1"))
    shutil.rmtree(Path(folder, "segments", "level=0", f"second={3 * DAY}"))
    pack = next(Path(folder, "packs", "pack=p0").glob("part-*"))
    lines = pack.read_text().splitlines()
    changed, cut = json.loads(lines[1]), json.loads(lines[2])["hash"]
    lines[1] = json.dumps(changed | {"body": "AAAA"})
    lines[2] = lines[2][:30]
    pack.write_text("\n".join([*lines, "", '{"hash":"x","body":"*"}']) + "\n")
    manifest = next(Path(folder, "segments", "level=0", f"second={5 * DAY}").glob("part-*"))
    manifest.write_text("[]")
    for n, text in ((2, None), (6, "{")):
        for f in Path(folder, "commits", f"day={n}").glob("part-*"):
            f.unlink() if text is None else f.write_text(text)
    for crc in Path(folder).rglob("*.crc"):
        crc.unlink()
    got, problems, _ = rebuilt(spark, folder, ids[11])
    wanted = expected(frames, segments, [11, 10, 9, 8, 7, 4])  # the ninth merges the fifth
    lost = {h for p, h, *_ in frames if p == "p1"} | {changed["hash"], cut}
    assert got == {h: v for h, v in wanted.items() if h not in lost}
    assert {("pack", "p0:1", "frame.hash_mismatch"), ("pack", "p0:2", "entry.unreadable"), ("pack", f"p0:{len(lines) + 1}", "entry.unreadable"), ("commit", "6:0", "commit.unreadable"), ("commit", ids[6], "commit.missing"),
            ("segment", str(3 * DAY), "segment.missing"), ("segment", str(5 * DAY), "segment.unreadable"), ("commit", ids[2], "commit.missing")} == problems
    got, problems, _ = rebuilt(spark, folder, "nowhere")
    assert ("commit", "nowhere", "commit.missing") in problems and not any(v[-1] for v in got.values())


def test_keys_of_a_range_come_from_the_listing(spark, tmp_path):
    folder = str(tmp_path / "store")
    store(spark, folder)
    keys = objects.segment_keys(spark, folder, 3 * DAY, 6 * DAY)
    assert sorted(r.second for r in keys.collect()) == [n * DAY for n in range(3, 7)]
    assert "content" not in keys._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert objects.segment_keys(spark, folder, 3 * DAY, 6 * DAY, level=1).count() == 0
    assert objects.listing(spark, f"{folder}/packs").where(F.col("length") > 0).count() == 5
