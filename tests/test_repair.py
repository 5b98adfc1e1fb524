"""Repair passes and dictionary training against plain versions."""

import random
from collections import Counter

import zstandard
from annalist.operators import dictionaries, repair
from annalist.operators.quality import RUNGS

FINDINGS = "code string, scope string, severity long, rung string, resolved long"


def plain_pass(findings, breakers, ok, now, budget, threshold=3, cooldown=300):
    report = {}
    for code in sorted({c for c, _, _, _, done in findings if done is None}):
        mine = [f for f in findings if f[0] == code]
        rung = RUNGS[max(RUNGS.index(f[3]) for f in mine)]
        failures, opened = breakers.get(code, (0, 0))
        open_ = [f for f in mine if f[4] is None]
        if rung == "observe":
            result = "watched"
        elif rung not in repair.AUTOMATIC:
            result = "held"
        else:
            result = "waiting" if failures >= threshold and now - opened < cooldown else "run"
        report[code] = [rung, len(open_), max(f[2] for f in open_), result, failures, opened]
    for rung in RUNGS:
        turn = sorted((c for c, r in report.items() if r[0] == rung and r[3] == "run"), key=lambda c: (-report[c][2], -report[c][1], c))
        for k, code in enumerate(turn):
            r = report[code]
            r[3] = "postponed" if budget is not None and k >= budget else "repaired" if rung in ok else "failed"
            if r[3] == "repaired":
                r[4:] = 0, 0
            if r[3] == "failed":
                r[4:] = r[4] + 1, now if r[4] + 1 >= threshold else r[5]
                r[0] = (rung, RUNGS[min(RUNGS.index(rung) + 1, 5)])
    after = []
    for code, scope, severity, rung, done in findings:
        r = report.get(code)
        after.append((code, scope, severity, r[0][1] if r and r[3] == "failed" else rung, now if r and r[3] == "repaired" and done is None else done))
    kept = dict(breakers) | {c: (r[4], r[5]) for c, r in report.items()}
    return report, after, {c: v for c, v in kept.items() if v[0]}


def test_passes_follow_each_other(spark):
    rng = random.Random(8)
    codes = [f"c{i}" for i in range(14)]
    findings = [(rng.choice(codes), f"s{i}", rng.randrange(4), rng.choice(RUNGS[:4]), rng.choice([None, None, 5])) for i in range(60)] + [("held", "s", 3, "quarantine", None), ("done", "s", 3, "reindex", 7)]
    breakers = {"c1": (3, 900), "c2": (3, 100), "c3": (1, 0), "unseen": (2, 0)}
    for k, (ok, budget) in enumerate([({"refetch"}, 2), (set(), None), ({"reindex", "rebuild"}, 3), ({"refetch"}, None)]):
        now = 1000 + 250 * k
        f = spark.createDataFrame(findings, FINDINGS)
        b = spark.createDataFrame([(c, *v) for c, v in breakers.items()], "code string, failures long, opened long")
        got = repair.repair_pass(f, b, spark.createDataFrame([(r, True) for r in ok], "rung string, ok boolean"), now, budget)
        report, after, kept = plain_pass(findings, breakers, ok, now, budget)
        rows = {r.code: (r.rung, r.next_rung, r.open, r.worst, r.result, r.failures, r.opened) for r in got.collect()}
        assert rows == {c: (*(r[0] if isinstance(r[0], tuple) else (r[0], r[0])), *r[1:]) for c, r in report.items()}
        assert sorted(map(tuple, repair.after_pass(f, got, now).collect()), key=repr) == sorted(after, key=repr)
        assert {r.code: (r.failures, r.opened) for r in repair.breakers_after(b, got).collect()} == kept
        totals = repair.totals(got).first()
        count = Counter(r[3] for r in report.values())
        assert (totals.considered, totals.repaired, totals.failed, totals.held) == (len(report), count["repaired"], count["failed"], count["held"] + count["waiting"] + count["postponed"])
        findings, breakers = after, kept
    empty = repair.repair_pass(f.limit(0), b, spark.createDataFrame([], "rung string, ok boolean"), 0)
    assert empty.collect() == [] and repair.totals(empty).first().cleared == 0


def test_dictionaries_help_where_payloads_share_bytes(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefghijklmnop") for _ in range(300)) for _ in range(8)]
    alike = [f'{{"title":"{rng.random()}","body":"{rng.choice(common)}{rng.choice(common)}","n":{i}}}' for i in range(120)]
    noise = ["".join(chr(rng.randrange(32, 0x2FF)) for _ in range(200)) for _ in range(60)]
    rows = [("alike", a) for a in alike] * 2 + [("noise", n) for n in noise] + [("few", f"x{i}") for i in range(31)] + [("alike", None), ("alike", ""), (None, "lonely")]
    df = spark.createDataFrame(rows, "realm string, body string")
    got = {r.realm: r for r in dictionaries.training(df, "realm", "body", samples=100).collect()}
    assert got["alike"].samples == 100 and got["alike"].kept and got["alike"].ratio > 2 * got["alike"].baseline
    assert got["few"].samples == 31 and got["few"].baseline is None and not got["few"].kept and got[None].samples == 1
    held = [bytes(r.body) for r in dictionaries.sampled(df, "realm", "body", 100).where("realm = 'alike' and part = 'score'").collect()]
    assert len(held) == 50
    packer = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(bytes(got["alike"].dictionary), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    assert abs(sum(map(len, held)) / sum(len(packer.compress(b)) for b in held) - got["alike"].ratio) < 1e-9
    assert got["noise"].ratio >= got["noise"].baseline
    assert dictionaries.training(df.limit(0), "realm", "body").collect() == []


def test_gram_counts_are_of_samples(spark):
    bodies = [b"abcabcabc", b"xabcx", b"ab", b""]
    df = spark.createDataFrame([("r", bytearray(b)) for b in bodies], "realm string, body binary")
    wanted = Counter(g for b in bodies for g in {b[i : i + 3] for i in range(len(b) - 2)})
    assert {bytes(r.gram): r.n for r in dictionaries.gram_counts(df, 3).collect()} == {g: n for g, n in wanted.items() if n > 1}


def test_a_cover_takes_what_most_samples_share_first():
    bodies = [b"common-part-" + bytes([i]) * 12 + b"other" for i in range(6)]
    counts = Counter(g for b in bodies for g in {b[i : i + 8] for i in range(len(b) - 7)})
    made = dictionaries.cover(bodies, {g: n for g, n in counts.items() if n > 1}, most=24, gram=8, piece=12)
    assert made.endswith(b"common-part-") and len(made) <= 24
    assert dictionaries.cover([], {}) == b""
