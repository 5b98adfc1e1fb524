"""Each corpus operator against a brute-force version on small tables, with the edge cases its docstring names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from annalist.llm import ann, chat, common, digest, html_text, jaccard, mixing, packing, passages, queries, suffix, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=None):
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, a null id and columns with names that the operators use inside."""
    r = random.Random(5)
    long = prose(r, 20_000, 5000)
    texts = [None, "", " ", "one", long, long, "é" * 300, "a" * 1500, prose(r, 60), None, "\n\t x \n"]
    rows = [(i if i != 8 else None, t, None if i == 3 else "en", "s", 1) for i, t in enumerate(texts)] + [(3, "one", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("h", "n", "did", "tkey", "leaf", "part", "length", "score", "bucket", "_w", "key"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 mixing


def test_mixing_reaches_reachable_targets(spark):
    r = random.Random(1)
    rows = [(i, prose(r, 20), r.choice(["en", "de"]), r.choice(["a", "a", "a", "b"]), 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    share = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, _share double")
    out = mixing.mix_documents(docs, {"source": F.col("source"), "lang": F.col("lang")}, mixing.token_count(F.col("text")), F.col("doc_id"), 0.3, 1.0, {"source": share})
    got = {x["source"]: x["n"] for x in out.groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()}
    assert abs(got["a"] / sum(got.values()) - 0.5) < 0.04
    assert abs(sum(got.values()) / (4000 * 20) - 0.3) < 0.03


def test_mixing_same_as_sql(spark, sf_dir):
    from oracle import both, connection

    got, wanted = both(queries.op1_mixing(spark, sf_dir), connection(sf_dir), queries.ORACLE_SQL["op1_mixing"])
    assert got == wanted and got[1]


def test_mixing_is_native(spark, sf_dir):
    plan = queries.op1_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_topics_read_whole_texts(spark):
    of = lambda w: (ord(w[1]) * 7 + ord(w[4])) % 8
    r = random.Random(5)
    texts = [" ".join(r.choice(["planets", "geology", "violins", "harbours", "of", "été"]) for _ in range(r.randrange(0, 9))) for _ in range(60)]
    rows = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    for text, topic in mixing.with_topic(rows, F.col("t")).collect():
        n = Counter(of(w) for w in (text or "").split() if len(w) >= 6)
        assert topic == (min(n, key=lambda k: (-n[k], k)) if n else -1)


def test_mixing_edges(spark, odd, none):
    assert mixing.corpus_mix(none).count() == 0
    out = mixing.corpus_mix(odd, budget=1.0, power=1.0)
    assert set(odd.columns) <= set(out.columns)
    assert {r["text"] for r in out.select("text").collect()} >= {"one"}


def test_mixing_salted_join_gives_the_same(spark, sf_dir, monkeypatch):
    docs = queries.table(spark, sf_dir, "documents")
    want = {r[0] for r in mixing.corpus_mix(docs).select("doc_id").collect()}
    monkeypatch.setattr(mixing, "small", lambda df, rows=0: False)
    assert {r[0] for r in mixing.corpus_mix(docs).select("doc_id").collect()} == want


# --- 2 neighbours


def brute_neighbours(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:k] if d[j] < np.inf]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, x[i].tolist(), 0) for i in range(3000)]
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), search=900).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_neighbours(rows, 100, 10)
    assert set(got) == set(want)
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q in want:
        ranked = sorted(got[q])
        assert [r for r, _, _ in ranked] == list(range(1, 11)) and [(s, v) for _, v, s in ranked] == sorted((s, v) for _, v, s in ranked)


def test_neighbours_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, leaf string, id string"
    same = [1.0, 2.0]
    rows = [(0, same, 0, "", ""), (1, None, 0, "", ""), (2, [0.0, 0.0], 0, "", ""), (3, [float("nan"), 1.0], 0, "", ""), (4, [None, 1.0], 0, "", ""), (None, same, 0, "", "")]
    rows += [(10 + i, same, 0, "", "") for i in range(50)] + [(100, [5.0, 5.0], 0, "", ""), (100, [5.0, 5.0], 0, "", "")]
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == list(range(10, 20)) and got[100] == [0, *range(10, 19)] and set(got) == {0, 100}
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert ann.neighbours(spark.createDataFrame(rows[:1], schema)).count() == 0


# --- 3 packing


def check_packing(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_whole_tables(spark, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = queries.op3_packing(spark, sf_dir).collect()
    used = check_packing(rows)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) * 1.01 + 1
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    ids = {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for k, t in texts.items()}
    total = Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        total[r["doc_id"]] += r["length"]
    assert total == {k: len(v) for k, v in ids.items()}


ODD_TEXTS = ["don't stop 's 't x'll", "é É É", "a b c", "<|endoftext|> <|startoftext|>", "İstanbul ΣΑΣ ß", "x...y.,! 12 3,4 a1.", "漢字 かな 🙂🙂", "\x00\x0b\x0c", "…?! ;: -- a--b", "WORD'S It's", "﻿z ​"]


def test_remembered_words_encode_like_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    r = random.Random(2)
    texts = [*ODD_TEXTS, *("".join(r.choice("abcXYZ '.,!?;:é́ñ 1-—_\n\t ſ") for _ in range(200)) for _ in range(60)), ""]
    words = packing.Words(path)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in words.encode(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_islands_keep_all_items(spark, monkeypatch):
    r = random.Random(4)
    pieces = spark.createDataFrame([(i % 900, r.choice([r.randrange(1, 2049), r.randrange(1, 300), 2048])) for i in range(3000)], "doc_id long, length long")
    rows = packing.pack(pieces, island=400).collect()
    assert Counter((x["doc_id"], x["length"]) for x in rows) == Counter((x["doc_id"], x["length"]) for x in pieces.collect())
    assert check_packing(rows) <= 1.02 * sum(x["length"] for x in rows) / 2048 + 2


def test_islands_with_nothing_to_gain_end(spark):
    pieces = spark.createDataFrame([(i, 1500) for i in range(500)], "doc_id long, length long")
    assert check_packing(packing.pack(pieces, island=50).collect()) == 500


def test_crossover_gains_a_bin():
    """Where best fit of the longest first falls short of the bound, crossover finds groupings of fewer bins."""
    gained = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        lengths = r.integers(120, 500, 120)
        first, last = packing.evolve(lengths, 1000, generations=0, population=1), packing.evolve(lengths, 1000, seed=seed, generations=30)
        assert sorted(n for b in last for n in b) == sorted(lengths.tolist()) and max(map(sum, last)) <= 1000 and len(last) <= len(first)
        gained += len(last) < len(first)
    assert gained


def test_repeated_rows_go_to_many_islands(spark):
    rows = packing.pack(spark.createDataFrame([(1, 700)] * 600, "doc_id long, length long"), island=50).collect()
    assert len(rows) == 600 and check_packing(rows) <= 300 + 12


def test_packing_edges(spark, odd, none):
    path = queries.tokenizer_path()
    rows = packing.pack_documents(odd, path).collect()
    check_packing(rows)
    assert sum(1 for r in rows if r["length"] == 1) >= 4 and len({r["doc_id"] for r in rows}) == 11
    assert packing.pack_documents(none, path).count() == 0
    with pytest.raises(Exception, match="1 to 2048"):
        packing.pack(spark.createDataFrame([(1, 3000)], "doc_id long, length long")).count()


# --- 4 chat


def test_chat_round_trip(spark, sf_dir):
    turns = defaultdict(list)
    for r in queries.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [(x, "<|im_end|><|im_start|>assistant ok") for x in ("user", "assistant")]
    rows = queries.op4_chat(spark, sf_dir).collect()
    assert len(rows) == len(turns)
    for r in rows:
        t = turns[r["conv_id"]]
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes():
    for text in ["<|im_end|>", "\\", "<\\|", "\\\\<|", "\\n", "a<|im_start|>b\n<|im_end|>\n", "", "\\<|im_end|>\\"]:
        for role in ("user", "assistant", "a\nb", "<|im_end|>"):
            out, spans = chat.render([(role, text), ("assistant", text)])
            assert chat.parse(out) == [(role, text), ("assistant", text)]
            assert "".join(chat.unescape(out[a:b]) for a, b in spans) == text * (1 + (role == "assistant"))


def test_chat_layouts(spark):
    import json

    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "dialogue": {"data": {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "assistant", "text": "a"}]}}, "instruction": {"instruction": "q", "output": "a"},
        "instruction_input": {"instruction": "q", "input": "i", "output": "a"}, "prompt_completion": {"completion": "a", "prompt": "q"}, "prompt_response": {"prompt": "q", "response": "a"},
        "system_prompt_response": {"system": "s", "prompt": "q", "response": "a"}, "question_answer": {"question": "q", "answer": "a"}, "unknown": {"x": {"y": 1}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [("null", None), ("broken", "{"), ("empty", '{"messages": []}')], "id string, body string")
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical(df, "id", "body").collect()}
    for name in chat.LAYOUTS:
        if name != "system_messages":
            assert got[name][0] == name and got[name][1][-1] == ("assistant", "a")
    assert got["instruction_input"][1][0] == ("user", "q\n\ni") and got["system_prompt_response"][1][0] == ("system", "s")
    assert got["unknown"] == got["null"] == got["broken"] == (None, []) and got["empty"] == ("messages", [])
    done = chat.read_back(chat.formatted(chat.canonical(df, "id", "body"), "id"), "id").collect()
    assert len(done) == 13 and {r["n_turns"] for r in done if r["id"] in ("null", "unknown")} == {0}


def test_roles_stay_unless_the_layout_names_them():
    record = {"messages": [{"role": "human", "content": "a"}, {"role": "model", "content": "b"}]}
    assert chat.canonical_turns(record, chat.LAYOUTS["messages"]) == [("human", "a"), ("model", "b")]
    record = {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}
    assert chat.canonical_turns(record, chat.LAYOUTS["conversations"]) == [("user", "a"), ("assistant", "b")]


def test_chat_empty_table_and_long_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    run = lambda rows: chat.read_back(chat.formatted(chat.canonical(chat.records_of(spark.createDataFrame(rows, schema)), "conv_id", "body"), "conv_id"), "conv_id").collect()
    assert run([]) == []
    rows = [(1, i, "assistant" if i % 2 else "user", "x" * 1000) for i in range(2000)]
    assert [(r["n_turns"], r["loss_chars"]) for r in run(rows)] == [(2000, 1_000_000)]


def test_chat_null_rows(spark):
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, None, "user", None), (None, 0, "assistant", "y"), (1, 1, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.formatted(chat.canonical(chat.records_of(rows), "conv_id", "body"), "conv_id"), "conv_id").collect()}
    assert got == {1: 3, None: 1}


# --- 5 suffixes


def brute_repeats(texts, length):
    raw = {k: (t or "").encode() for k, t in texts}
    count = Counter(b[i : i + length] for b in [(t or "").encode() for _, t in texts] for i in range(len(b) - length + 1))
    out = []
    for k, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((k, list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return raw, out


def repeats_corpus(seed):
    r = random.Random(seed)
    passage, near = prose(r, 90), prose(r, 200)
    texts = []
    for i in range(60):
        kind = i % 6
        body = prose(r, r.randrange(5, 150))
        if kind == 0:
            body += " " + passage + " " + prose(r, 20)
        elif kind == 1:
            x = near.split(" ")
            x[r.randrange(len(x))] = "edited"
            body = " ".join(x)
        elif kind == 2:
            body = prose(r, 3) + "é" * r.randrange(100, 300)
        elif kind == 3 and i % 12 == 3:
            body = "ab " * r.randrange(100, 300)
        texts.append((i, body))
    texts += [(60, texts[0][1]), (61, None), (62, ""), (63, passage[:399]), (64, passage[:400])]
    return texts


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_removal_is_exact(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = repeats_corpus(seed)
    _, want = brute_repeats(texts, 400)
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["sa_spans"]], bytes(r["sa_kept"])) for r in suffix.remove_repeats(frame(spark, dict(texts))).collect()}
    assert got == {k: (spans, kept) for k, spans, kept in want}


def test_suffix_edges(spark, odd, none):
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == 12 and set(odd.columns) < set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert bytes(by[4]["sa_kept"]) == bytes(by[5]["sa_kept"]) == b"" and bytes(by[0]["sa_kept"]) == b"" and bytes(by[7]["sa_kept"]) == b""
    assert suffix.remove_repeats(none).count() == 0
    cut = suffix.without_repeats(odd).collect()
    assert {r["doc_id"]: r["text"] for r in cut}[0] is None and {r["doc_id"]: r["n_chars"] for r in cut}[4] == 0
    with pytest.raises(ValueError):
        suffix.repeated_ranges(none, 100)


# --- 6 Jaccard


def shingles(text, k=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_links(texts, similarity=0.8):
    sets = [(k, shingles(t)) for k, t in texts]
    links, root = Counter(), {k: k for k, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (find(k), links[k]) for k, _ in texts}


def similar_corpus(n_hot=0):
    r = random.Random(9)
    texts, k = [], 0
    for _ in range(40):
        base = prose(r, r.randrange(3, 120), 3000).split(" ")
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
            texts.append((k, " ".join(t)))
            k += 1
    hot = prose(r, 100, 3000).split(" ")
    for _ in range(n_hot):
        t = list(hot)
        t[r.randrange(100)] = f"y{r.randrange(9999)}"
        texts.append((k, " ".join(t)))
        k += 1
    return [*texts, (k, None), (k + 1, ""), (k + 2, "A b"), (k + 3, "a  B ")]


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_is_exact_for_what_it_finds(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", 8)
    texts = similar_corpus(60)
    want = brute_links(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similar_documents(frame(spark, dict(texts)), recall=0.9999).collect()}
    assert got.keys() == want.keys()
    found, there = sum(v[1] for v in got.values()), sum(v[1] for v in want.values())
    assert all(got[k][1] <= want[k][1] for k in want) and found >= 0.99 * there
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.99 * len(want)


def test_jaccard_edges(spark, odd, none):
    rows = jaccard.similar_documents(odd).collect()
    got = Counter((r["doc_id"], r["n_links"]) for r in rows)
    assert len(rows) == 12 and got[3, 1] == 2 and got[4, 1] == 1 and got[0, 0] == 1 and got[None, 0] == 1
    assert jaccard.similar_documents(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 10


def test_runs_for_recall():
    assert jaccard.runs_needed(0.99, 0.8, 1) < jaccard.runs_needed(0.99, 0.8, 3) < jaccard.runs_needed(0.9999, 0.8, 3)


def test_contained_sets_meet_at_the_last_level():
    """At production parameters: one set is 0.8 of the other and in it."""
    rng, n = np.random.default_rng(7), 4000
    h = [np.sort(rng.integers(0, 1 << 64, 100, dtype=np.uint64)) for _ in range(n)]
    sets = [x for y in h for x in (y, np.sort(rng.permutation(y)[:80]))]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    at, path, _ = jaccard._paths(off, np.concatenate(sets), 0.8, jaccard.runs_needed(0.99, 0.8), jaccard.LEVELS)[-1]
    paths = defaultdict(set)
    for i, p in zip(at.tolist(), path.tolist()):
        paths[i].add(p)
    assert sum(not paths[2 * i].isdisjoint(paths[2 * i + 1]) for i in range(n)) >= 0.987 * n


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(200, 230), 200)}


# --- 7 passages


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for n in (46, 47, 100, 400):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        key = passages._keyed(h, passages._SEEDS[0])
        want = []
        for c in range(n):
            a = b = c
            while a and key[a - 1] > key[c]:
                a -= 1
            while b + 1 < n and key[b + 1] > key[c]:
                b += 1
            if b - a + 1 >= 46:
                want.append((a, c, b))
        assert list(zip(*(x.tolist() for x in passages.compact_windows(h, passages._SEEDS[0], 46)))) == want


def test_passages_found_and_clean_left_alone(spark):
    r = random.Random(3)
    passage, near = prose(r, 70, 9999), prose(r, 80, 9999).split(" ")
    texts = {}
    for i in range(60):
        body = prose(r, r.randrange(60, 200), 9999)
        if i % 5 == 0:
            body = f"{body} {passage} {prose(r, 40, 9999)}"
        if i % 5 == 1:
            t = list(near)
            t[len(t) // 2] = f"z{i}"
            body = f"{prose(r, 30, 9999)} {' '.join(t)} {body}"
        texts[i] = body
    got = defaultdict(list)
    for x in passages.near_passages(frame(spark, texts)).collect():
        got[x["doc_id"]].append((x["start"], x["end"]))
    assert set(got) == {i for i in texts if i % 5 < 2}
    for i in texts:
        if i % 5 == 0:
            at = texts[i].index(passage)
            assert any(s <= at and e >= at + len(passage) for s, e in got[i])


def test_passages_edges(spark, odd, none):
    rows = passages.near_passages(odd).collect()
    assert {r["doc_id"] for r in rows} == {4, 5} and {r["start"] for r in rows} == {0}
    assert passages.near_passages(none).count() == 0
    r = random.Random(8)
    p = prose(r, 60, 9999)
    own = frame(spark, {1: f"{p} {prose(r, 50, 9999)} {p}", 2: prose(r, 100, 9999)})
    assert {(x["doc_id"], x["n_words"]) for x in passages.near_passages(own).collect()} == {(1, 60)}


@pytest.mark.parametrize("gap", [0, 50])
def test_own_repeats_may_differ(gap):
    r = np.random.default_rng(gap)
    for change in ("word", "insert"):
        p = [str(w) for w in r.integers(0, 1 << 40, 60)]
        q = [*p[:30], "other", *p[30 if change == "insert" else 31 :]]
        fill = lambda n: [str(w) for w in r.integers(0, 1 << 40, n)]
        x = common.shingle_hashes(pa.array([" ".join([*fill(20), *p, *fill(gap), *q, *fill(20)])]))[1]
        found = passages.verified_passages(x, x, [(22, 82 + gap)], 46, 0.8)
        assert len(found) == 1 and found[0][0] <= 20 and found[0][1] >= 76 and found[0][1] <= found[0][2] and found[0][4] >= 0.8


def test_passages_as_brute_force(spark):
    """At production parameters: passages made of phrases that many other documents have too, with a word changed."""
    r = random.Random(12)
    phrases = [[f"p{i}x{j}" for j in range(10)] for i in range(12)]
    texts = []
    for i in range(60):
        p = [w for x in r.sample(phrases, 6) for w in x]
        q = list(p)
        q[r.randrange(20, 40)] = f"z{i}"
        texts += [f"{prose(r, 30, 10**6)} {' '.join(x)} {prose(r, 30, 10**6)}" for x in (p, q)]
    texts += [" ".join(f"{prose(r, 20, 10**6)} {' '.join(p)}" for p in r.sample(phrases, 4)) for _ in range(120)]
    order = r.sample(range(len(texts)), len(texts))
    off, h = common.shingle_hashes(pa.array(texts))
    sets = [h[a:z] for a, z in zip(off[:-1], off[1:])]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 41:  # of 46, for a similarity of 0.8
                windows = [np.lib.stride_tricks.sliding_window_view(sets[x], 46) for x in (i, j)]
                if any(passages._jaccard(x, y) >= 0.8 for x in windows[0][::2] for y in windows[1][::2]):
                    want |= {i, j}
    got = {order.index(x["doc_id"]) for x in passages.near_passages(frame(spark, {order[i]: t for i, t in enumerate(texts)})).collect()}
    assert len(want) >= 100 and len(got & want) >= 0.97 * len(want) and max(got) < 120


def test_windows_of_two_functions_overlap():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    rows = sorted((int(c), int(a), int(z), f) for f in range(2) for a, c, z in zip(*passages.compact_windows(h, passages._SEEDS[f], 46)))
    c, left, right, v = (np.array(x) for x in zip(*rows))
    got = {frozenset(((int(c[a]), int(v[a])), (int(c[b]), int(v[b])))) for i, j in passages.overlapping(v, left, c, right, 46) for a, b in zip(i, j)}
    keys = [passages._keyed(h, passages._SEEDS[f]) for f in range(2)]
    want = {frozenset(((s + int(np.argmin(keys[0][s:e])), 0), (s + int(np.argmin(keys[1][s:e])), 1))) for s in range(150) for e in range(s + 46, 151)}
    assert got == want


def test_passages_salted_groups(spark, monkeypatch):
    for name, value in (("SAMPLE", 1), ("HOT", 2), ("PART", 7), ("BLOCK", 20)):
        monkeypatch.setattr(passages, name, value)
    r = random.Random(6)
    p = prose(r, 60, 9999)
    texts = {i: f"{prose(r, 60, 9999)} {p} {prose(r, 30, 9999)}" for i in range(300)} | {999: prose(r, 100, 9999)}
    assert {x["doc_id"] for x in passages.near_passages(frame(spark, texts)).collect()} == set(range(300))


# --- 8 digests


def plain_buckets(b):
    out = []
    for i in range(len(b) - 63):
        total = sum(int(digest._GAIN[c]) for c in Counter(b[i : i + 64]).values())
        out.append((6 * 64 * 65536 - total) * 1000 // (6 * 64 * 65536))
    return out


def test_entropies_are_exact():
    r = random.Random(1)
    for b in (bytes(r.randrange(256) for _ in range(300)), b"a" * 200, prose(r, 40).encode(), b"x" * 64, b"y" * 10):
        assert digest._entropy(np.frombuffer(b, dtype=np.uint8)).tolist() == plain_buckets(b)


def test_digest_does_not_depend_on_neighbours(spark):
    r = random.Random(2)
    texts = [prose(r, n).encode() for n in (1, 5, 12, 14, 20, 60, 500, 3000)] + [b""]
    rank = digest.rarity(np.arange(1001))
    together = digest.digests(texts, rank)
    assert all(np.array_equal(a, digest.digests([t], rank)[0]) for a, t in zip(together, texts))
    assert [digest.likeness(a, a) for a in together] == [1.0] * len(texts)
    assert np.array_equal(digest.from_fingerprint(digest.fingerprint(together[6])), together[6])


def test_compared_documents(spark):
    r = random.Random(4)
    texts = {i: prose(r, 200) for i in range(20)} | {20: None, 21: ""}
    rows = {x["doc_id"]: x for x in digest.compared(frame(spark, texts)).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, y = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + y[:h]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    inner = [rows[i] for i in range(1, 20)]
    assert np.mean([x["near_edited"] for x in inner]) > 0.3 > 0.15 > np.mean([x["near_next"] for x in inner])


def test_digest_edges(spark, odd, none):
    rows = digest.compared(odd).collect()
    assert len(rows) == 12 and len({x["fingerprint"] for x in rows if x["doc_id"] in (4, 5)}) == 1
    assert digest.compared(none).count() == 0 and digest.digest_documents(none).count() == 0
    assert digest.compared(frame(spark, ["only one text"])).first()["near_next"] == 1.0


# --- 9 toxicity


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    step = rng.normal(size=(2, 2))
    for n in (1, 2, 5):
        e = rng.normal(size=n) * 2
        p, pair = toxicity.marginals(np.concatenate([e, e[:1]]), np.array([0, n, n + 1]), step)
        total, one, both = 0.0, np.zeros(n), np.zeros(n)
        for m in range(1 << n):
            y = [m >> i & 1 for i in range(n)]
            w = np.exp(sum(a * b for a, b in zip(e, y)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += w
            one += w * np.array(y)
            both[1:] += w * np.array([a * b for a, b in zip(y, y[1:])])
        assert np.allclose(p[:n], one / total) and np.allclose(pair[:n], both / total)


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        w = prose(r, 60, 2000).split(" ")
        bad = r.random() < 0.3
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["vile", "rotten!", "Scumbag", "nastyword"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 0, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.labelled_sample(docs, lab, toxicity.held_out))
    got = toxicity.score_documents(docs, model).join(lab, "doc_id").withColumn("out", toxicity.held_out(F.col("doc_id"))).where("out").collect()
    assert np.mean([(x["score"] >= 0.3) == bool(x["toxic"]) for x in got]) > 0.97
    texts = {x[0]: x[1] for x in rows}
    marked = [texts[x["doc_id"]][s["start"] : s["end"]] for x in got for s in x["spans"]]
    assert marked and np.mean([w.strip("!") in ("vile", "rotten", "Scumbag", "nastyword") for w in marked]) > 0.95
    clean = toxicity.clean_documents(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(1 for x in toxicity.score_documents(docs, model).collect() if x["score"] < 0.3)


def test_toxicity_edges(spark, odd, none):
    r = random.Random(7)
    texts = [prose(r, 40, 900) for _ in range(150)]
    model = toxicity.fit([f"{t} bad word" if i < 50 else t for i, t in enumerate(texts)], [1] * 50 + [0] * 100)
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == 12 and all(0 <= x["score"] < 0.3 and x["spans"] == [] for x in rows)
    assert toxicity.score_documents(none, model).count() == 0 and toxicity.clean_documents(none, model).count() == 0
    assert toxicity.clean_documents(odd, model).columns == odd.columns
    for few, marks in (([], []), (["a"], [0]), (["a"], [1])):
        toxicity.fit(few, marks)
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(none, labels, toxicity.held_out) == ([], [])
    white = toxicity.score_documents(frame(spark, [" bad word\n", "bad word "]), model, cut=0.2).orderBy("doc_id").collect()
    assert [(s["start"], s["end"]) for s in white[0]["spans"]] == [(1, 4), (5, 9)] and [(s["start"], s["end"]) for s in white[1]["spans"]] == [(0, 3), (4, 8)]


def test_crc_of_ids(spark):
    df = spark.range(50).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in df.collect())


# --- 10 pages

GOOD = "The river is wide and it was known to all who lived on the banks that it would rise in the spring, as it had done for as long as there was a village by the water."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain <b>text</b> of the page that is not in any block", "plain text of the page that is not in any block"),
        (f"<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{GOOD}<p>Short &amp; sweet.<br>x</article><footer>&copy; me</footer>", f"Title\n{GOOD}\nShort & sweet. x"),
        (f"<div class='ad'>{GOOD}</div><article><p>Only.</p></article>", "Only."),
        (f"<div id=sidebar><p>{GOOD}</p></div><div><h2>Head</h2><p>{GOOD}</p><p>{GOOD}</p></div><div class='comments'><p>{GOOD}</p></div>", f"Head\n{GOOD}\n{GOOD}"),
        (f"<script>if (a < b) document.write('<p>{GOOD}</p>')</script><style>p {{}}</style><p>{GOOD}</p><!-- <p>no</p> -->", GOOD),
        (f"<main><p>a&nbsp;b \n\t c &#233;&lt;p&gt; {GOOD}</p></main><form><p>{GOOD}</p></form><aside>{GOOD}</aside>", f"a b c é<p> {GOOD}"),
        (f"<article><p>{GOOD}</p><section class='comments'><p>{GOOD}</p></section></article>", GOOD),
        (f"<article><header><h1>T</h1></header><p>{GOOD}</p><p title='a > b'>{GOOD}</article>", f"T\n{GOOD}\n{GOOD}"),
        ("<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>", ""),
        ("<", "<"), ("<div", ""), (f"<p>{GOOD}</p", GOOD),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG_PART = "This is one of the long parts of the page that we have here and it is not in any article at all. " * 3


def test_a_teaser_is_no_veto():
    page = f"<div id=content><p>{LONG_PART}</p><p>{LONG_PART}</p></div><article><p>Teaser.</p></article>"
    assert html_text.main_text(page).count(LONG_PART.strip()) == 2
    page = f"<article><p>{LONG_PART}</p><p>{LONG_PART}</p></article><div><p>{LONG_PART}</p></div>"
    assert html_text.main_text(page).count(LONG_PART.strip()) == 2


def test_an_unclosed_head_keeps_its_title():
    assert html_text.main_text(f"<html><head><title>Never me</title><meta x><p>{LONG_PART}") == LONG_PART.strip()


def test_long_pages_and_clashing_names(spark):
    page = "".join(f"<p>{LONG_PART}</p>" for _ in range(3000))
    rows = spark.createDataFrame([(None, "u", page, "a"), (1, None, None, "b")], "page_id long, url string, html string, n_chars string")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    assert got[None]["n_chars"] == 3000 * len(LONG_PART) - 1 and got[1]["text"] == ""


def test_pages_table(spark, sf_dir):
    rows = queries.op10_html(spark, sf_dir).collect()
    assert len(rows) == queries.table(spark, sf_dir, "pages").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert not any("&copy" in r["text"] or "<p>" in r["text"] for r in rows)
    empty = spark.createDataFrame([(1, None, None, "x")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract(empty).collect()] == [(1, None, "", 0)] and html_text.extract(empty.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = queries.table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, sf_dir))
        seen[name] = docs.count()
        if name != cp.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "jaccard":
            texts = [(r["doc_id"], r["text"]) for r in before.collect()]
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept == {c for c, _ in brute_links(texts).values()}
        if name == "suffixes":
            texts = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {k: kept.decode("utf-8", "ignore") for k, _, kept in brute_repeats(texts, 400)[1]}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert seen["jaccard"] < seen["toxicity"] <= queries.table(spark, sf_dir, "documents").count() and 0 < seen["mixing"] < seen["suffixes"]
    check_packing(docs.collect())
