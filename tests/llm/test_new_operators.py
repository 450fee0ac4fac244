"""Resampling, filter audit and passage dedup against plain versions, on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cellweave.llm import filter_audit, passage_dedup, resampling

KIND = "doc_id long, text string, source string, n_words long, at string, rank int, `odd name` int, id int, part string"


def say(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def texts():
    passage, base = say(1, 80), say(2, 200)
    words = base.split()
    return [
        (1, base, "a"), (2, base, "a"), (3, " ".join([*words[:90], "changed", *words[91:]]), "b"), (4, None, None), (5, "", ""), (6, " \n\t ", "b"), (7, "One two", "a"), (8, say(3, 60) + "\n" + passage + "  " + say(4, 40), "b"),
        (9, say(5, 45) + "\t" + passage + " " + say(6, 70), None), (10, passage, "a"), (None, base, "a"), (None, None, "b"), (11, say(7, 30000), "a"), (12, say(8, 20) + " " + say(7, 30000), "c"), (13, "ab " * 400, "a"), (13, "ab " * 400, "a"), (14, "ab " * 300, "b"),
        (15, "É\x00 ünï-çode 🎉日本 " * 40, "a"), (16, "SHOUT #1 | " + say(9, 60), "a"), (17, say(9, 60), "b"), (18, say(1, 49), "a"), (19, " ".join(words[:50]), "d"), (20, "x" * 300_000 + " " + say(11, 55), "d"), (21, say(11, 55), "d"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 1, 2, 3, "p") for i, t, s in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# --- passages


def plain_passages(rows, window):
    least, out = {}, []
    split = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            least[w] = min(least.get(w, i), i)
    for i, ws in split:
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if least[tuple(ws[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode()))
    return sorted(out)


def passages(df, **options):
    got = passage_dedup.passage_dedup(df, **options)
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect())


def test_passages(docs, none):
    assert passages(docs) == plain_passages([x[:2] for x in texts()], 50)
    got = passage_dedup.passage_dedup(docs)
    assert got.columns == ["doc_id", "text", "source", "at", "rank", "odd name", "id", "part", "n_words", "n_removed", "starts", "ends"]
    row = got.where("doc_id = 9").first()
    assert (row.starts, row.ends) == ([45], [125])
    assert passage_dedup.passage_dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_a_small_vocabulary(spark, seed):
    """Many anchors with many surroundings: texts spliced from each other."""
    r, rows = random.Random(seed), []
    for i in range(60):
        parts = [say(100 * seed + i, r.randrange(5, 60), 3 if i % 3 else 200).split()]
        for _ in range(r.randrange(4)):
            if rows:
                ws = r.choice(rows)[1].split()
                at = r.randrange(max(len(ws), 1))
                parts.append(ws[at : at + r.randrange(10, 80)])
            parts.append([f"w{r.randrange(200)}"] * r.randrange(2))
        rows.append((r.randrange(50), " ".join(w for p in parts for w in p)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages(df, window=20) == plain_passages(rows, 20)


def test_windows_of_pieces():
    """A text that is cut into pieces has each window in just one place, with the words' hashes of the whole."""
    words = passage_dedup.word_hashes(say(5, 700).encode())
    whole = passage_dedup.places([(0, 0, words)], 50)
    parts = [passage_dedup.places([(0, at, words[at : at + 149])], 50) for at in range(0, 651, 100)]
    windows = lambda p: [(int(a), int(s)) for a, pos, f, e in zip(p["anchor"], p["pos"], p["first"], p["last"], strict=True) for s in range(pos - f, pos - e + 1)]
    assert sorted(windows(whole)) == sorted(w for p in parts for w in windows(p))
    assert [s for _, s in sorted(windows(whole), key=lambda x: x[1])] == list(range(651))


# --- filters


def plain_audit(rows, labels, percent=65):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(ws) < 50, 100 * len(set(ws)) < percent * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least.get(t, i))
        fails[part or ""].append(({c for c, x in zip("ABCDE", tests, strict=True) if x}, i in good, i in toxic))
    out = set()
    for part, found in fails.items():
        shapley, steps = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = found
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                mine = sum(f in x[0] for x in found)
                steps.append((part, order, k + 1, len(left), len(gone), mine - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out |= {(*s, shapley[s[1][s[2] - 1]]) for s in steps}
    return out


def test_filter_audit(spark, docs, none):
    labels = [(1, 1, 0), (2, 1, None), (3, None, 1), (5, 0, 1), (5, 1, 0), (9, 1, 1), (16, 1, 0), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 600 * 5
    assert set(rows) == plain_audit(texts(), labels)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in filter_audit.filter_audit(docs, empty).collect()} == plain_audit(texts(), [])
    assert filter_audit.filter_audit(none, table).count() == 0


def test_shares_of_all_orders_add_up(docs, spark):
    """Over all filters the fair shares are all that is removed, in each order."""
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in filter_audit.filter_audit(docs, table).groupBy("part", "filter_order").agg({"removed": "sum", "shapley": "sum"}).collect():
        assert r["sum(shapley)"] == 120 * r["sum(removed)"]


# --- resampling


def plain_resample(rows, target, percent=25, buckets=10_000):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        ws = word.findall((t or "").encode().lower())
        return len(ws), [zlib.crc32(x) % buckets for x in [*ws, *(a + b" " + b for a, b in itertools.pairwise(ws))]]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {k: math.floor(1000 * math.log((t[k] + 1.0) * float(a) / ((s[k] + 1.0) * float(b)))) for k in range(buckets)}
    out, fit = [], []
    for i, x in rows:
        n, f = features(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            fit.append(len(out) - 1)
    fit.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    for rank, k in enumerate(fit[: percent * len(fit) // 100]):
        out[k][4] = rank + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("long", [1 << 17, 500])
def test_resample(spark, docs, none, monkeypatch, long):
    """Also with nearly every text in chunks of a few words."""
    monkeypatch.setattr(resampling, "LONG_BYTES", long)
    target = [say(9, 60), None, "", say(12, 40), "É ünï"]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = resampling.importance_resample(docs, table)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rows = sorted((tuple(r)[:5] for r in got.collect()), key=str)
    assert rows == plain_resample([x[:2] for x in texts()], target)
    assert resampling.importance_resample(none, table).count() == 0
    assert resampling.importance_resample(docs, table.limit(0)).count() == len(texts())


def test_chunks_own_each_run_once():
    words = say(3, 1000).encode().split()
    whole = resampling._hashes(words, len(words), 3)
    parts = [resampling._hashes(words[i : i + 102], min(100, 1000 - i), 3) for i in range(0, 1000, 100)]
    assert Counter(whole.tolist()) == sum((Counter(p.tolist()) for p in parts), Counter())
    assert len(whole) == 1000 + 999 + 998
    assert zlib.crc32(b" ".join(words[:3])) in set(whole.tolist())


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "(id * 7919) % 50 AS score").repartition(7)
    got = [(r.score, r.doc_id, r["rank"]) for r in resampling._ranked(rows).orderBy("rank").collect()]
    assert [(s, i) for s, i, _ in got] == sorted(((s, i) for s, i, _ in got), key=lambda x: (-x[0], x[1]))
    assert [k for *_, k in got] == list(range(1, 5001))
