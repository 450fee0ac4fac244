"""The operators on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import pathlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import exact_dedup, jaccard_join, langid, line_dedup, mixing, quality, sentencepiece_codec, suffix_dedup, topk, warc
from cellweave.llm.queries import piece_model

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, n_removed string, `key` int, quality_keep string, `odd name` int"
WORDS = [f"w{i}" for i in range(400)]


def say(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    base = say(1, 300)
    parts = base.split()
    near = " ".join([*parts[:100], "changed", *parts[101:]])
    shared = say(2, 60)
    return [
        (1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "One two"), (8, "ONE  TWO"), (9, "one"),
        (10, say(3, 90) + "\n" + shared + "\n" + say(4, 80)), (11, say(5, 70) + "\n" + shared + "\n" + say(6, 75)), (12, shared), (None, base), (None, None),
        (13, say(7, 30000)), (14, "ab " * 400), (14, "ab " * 400), (15, "É\x00 ünï " * 40), (16, "É\x00 ünï " * 40 + "x"), (17, "a\nb\nc\nd\n\na\nb\nc\n"), (18, "🎉日本 " * 50),
    ]


def frame(spark, rows):
    rng = random.Random(5)
    full = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), 7, "x", 1, None, i) for i, t in rows]
    return spark.createDataFrame(full, KIND).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def lower(t):
    return (t or "").encode().lower()


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    assert len(got) == len(texts())
    groups = defaultdict(list)
    for i, t in texts():
        groups[hashlib.sha256(lower(t)).hexdigest()].append(i)
    for sha, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == sha]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in rows} == {(top, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [top]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_sorted_runs_merge():
    rng = random.Random(2)
    entries = [(bytes([rng.randrange(6)]), rng.randrange(2), rng.choice([None, *range(9)]), k, 1) for k in range(300)]
    runs = []
    for k in range(5):
        held = {}
        for e in entries[k::5]:
            held.setdefault(e[:2], []).append(e)
        runs.append(iter([(*key, *max(((x[2], x[3]) for x in v), key=lambda y: (y[0] is not None, y[0] or 0, y[1])), len(v)) for key, v in sorted(held.items())]))
    out = list(exact_dedup.merged(runs))
    assert [e[:2] for e in out] == sorted({e[:2] for e in entries})
    for digest, n_bytes, doc_id, row, n in out:
        same = [e for e in entries if e[:2] == (digest, n_bytes)]
        assert n == len(same)
        assert doc_id == max((e[2] for e in same if e[2] is not None), default=None)
        assert any(e[2:4] == (doc_id, row) for e in same)


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        if i is not None and w:
            sets[i] = frozenset([tuple(w)] if len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) if i in sets else (0, i) for i, _ in rows if i is not None}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, docs, none, n, percent):
    got = jaccard_join.jaccard_components(docs, words=n, percent=percent).collect()
    assert len(got) == len(texts())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == plain_components(texts(), n, percent)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_chains_and_pages(spark, monkeypatch):
    """Variants that drift away step by step share cells without linking directly; small pages make cells meet in pairs."""
    monkeypatch.setattr(jaccard_join, "PAGE", 8)
    rows, words = [], say(11, 200).split()
    for i in range(80):
        rows.append((i, " ".join(words)))
        words[(37 * i) % 200] = f"new{i}"
    rng = random.Random(3)
    for i in range(100, 140):
        w = say(12, 150).split()
        for _ in range(rng.choice([1, 4, 9])):
            w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    for n, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), words=n, percent=percent).collect()}
        assert got == plain_components(rows, n, percent)


def test_jaccard_splits_large_cells(spark, monkeypatch):
    """Texts that share a passage and nothing else, with near copies among them: cells are split by a second and third token."""
    for name, value in (("PAGE", 4), ("PAGES_MET", 1), ("FREQUENT_IN_SAMPLE", 10**6)):
        monkeypatch.setattr(jaccard_join, name, value)
    deepest, plain = [], jaccard_join._open_cells
    monkeypatch.setattr(jaccard_join, "_open_cells", lambda members, *also: deepest.append(also) or plain(members, *also))
    rng, rows = random.Random(9), []
    passage = say(20, 25).split()
    for i in range(220):
        w = [f"own{rng.random()}" for _ in range(60)]
        rows.append((i, " ".join([*w, *passage])))
        if i % 3 == 0:
            w[rng.randrange(60)] = "other"
            rows.append((1000 + i, " ".join([*w, *passage])))
    for n, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), words=n, percent=percent).collect()}
        want = plain_components(rows, n, percent)
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows)
    assert ("parent",) in deepest


@pytest.mark.parametrize("members", [5000, 20000])
def test_unlinked_members_of_a_cell_make_rows_in_proportion(spark, members):
    """One token in all sets, a second one in pairs of them, all others their own; and sets that share all their first tokens."""
    size = 40
    own = F.transform(F.sequence(F.lit(3), F.lit(jaccard_join.DEEPER + size + 1 - 36)), lambda k: F.xxhash64("id", k))
    sets = spark.range(members).select(F.col("id").alias("node"), F.lit(size).cast("long").alias("n"), F.concat(F.array(F.lit(1).cast("long"), F.floor(F.col("id") / 2) + 10), own).alias("keys"))
    placed = sets.select(F.lit(1).cast("long").alias("key"), "node", "n", F.col("node").alias("root"))
    rows = jaccard_join._spread(placed, sets, 90)[0].collect()
    assert len(rows) == members
    cells = defaultdict(list)
    for r in rows:
        cells[r.key, r.level, r.low, r.high].append(r.node)
    assert {tuple(sorted(c)) for c in cells.values()} == {(k, k + 1) for k in range(0, members, 2)}
    same = sets.withColumn("keys", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: k.cast("long")))
    rows = jaccard_join._spread(placed, same, 90)[0]
    pages = -(-(members - 1) // jaccard_join.PAGE)  # one member is the largest component
    assert rows.count() == pages + (members - 1) * (1 + pages)  # a split would make more
    assert rows.select("level").distinct().collect() == [(1,)]


def test_prefix_holds_further_common_tokens():
    assert [jaccard_join.depth(p) for p in (10, 50, 60, 80, 90, 99, 100)] == [1, 1, 2, 3, 3, 3, 1]
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90):
        seen = 0
        for _ in range(400):
            x = np.unique(rng.integers(0, 10**6, rng.integers(2, 60)).astype(np.uint64))
            drop = rng.random(len(x)) < (100 - percent) / 150
            y = np.unique(np.concatenate([x[~drop], rng.integers(0, 10**6, int(drop.sum()) // 2).astype(np.uint64)]))
            both = np.intersect1d(x, y)
            if 100 * len(both) < percent * len(np.union1d(x, y)) or not len(jaccard_join.prefix(x, percent)) or not len(jaccard_join.prefix(y, percent)):
                continue
            for more in range(jaccard_join.depth(percent)):
                seen += 1
                for s in (x, y):
                    assert set(both[: more + 1].tolist()) <= set(jaccard_join.prefix(s, percent, more).tolist())
                assert len(both) > more
        assert seen > 50


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 3000, rng.integers(20, 60)).tolist()) for _ in range(150)]
    sets += [set(list(s)[1:]) | {5000 + i} for i, s in enumerate(sets[:60])]
    points = np.stack([np.bincount([x % 16 for x in s], minlength=16) for s in sets])
    sizes = np.array([len(s) for s in sets])
    x, y = jaccard_join.tree_pairs(points, sizes, np.arange(len(sets)), np.full(len(sets), 2), 80)
    found = {frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)}
    links = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) >= 50
    assert links <= found
    assert len(found) < len(sets) ** 2 / 8


def test_points_bound_the_overlap():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**61, 9000, np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (0, 1, 700, 1000, 1100, 2500, 4000, 8000)]
    points = [jaccard_join.point(s) for s in sets]
    assert [len(p) for p in points] == [16, 16, 256, 256, 512, 1024, 1024, 2048]
    a, b = np.divmod(np.arange(len(sets) ** 2), len(sets))
    got = jaccard_join.overlaps([points[i].tobytes() for i in a], [points[i].tobytes() for i in b])
    exact = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (got >= exact).all()
    assert (got[a == b] == exact[a == b]).all()
    # unrelated large sets are ruled out
    x, y = (np.unique(rng.integers(0, 2**61, 4000, np.uint64)) for _ in range(2))
    assert jaccard_join.overlaps([jaccard_join.point(x).tobytes()], [jaccard_join.point(y).tobytes()])[0] < jaccard_join.needed(len(x), len(y), 80)
    assert len(jaccard_join.overlaps([], [])) == 0


def variants(n, size, changes, seed=3):
    rng, out = np.random.default_rng(seed), []
    base = np.unique(rng.integers(0, 2**61, size, np.uint64))
    for _ in range(n):
        own = base.copy()
        own[rng.choice(len(base), rng.integers(0, changes), replace=False)] = rng.integers(0, 2**61)
        out.append(np.unique(own))
    return out


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_their_first_common_token(percent):
    sets = variants(60, 90, 18) + variants(60, 12, 4) + variants(20, 9, 2)
    for i, x in enumerate(sets):
        for y in sets[:i]:
            both = np.intersect1d(x, y)
            if len(both) < len(np.union1d(x, y)) and 100 * len(both) >= percent * len(np.union1d(x, y)):
                assert both[0] in jaccard_join.prefix(x, percent)
                assert both[0] in jaccard_join.prefix(y, percent)


def test_spanning_links_are_fewer_than_members():
    """A group of variants has thousands of links; a cell returns a forest that connects the same, each pair in its first common cell."""
    sets = variants(150, 200, 24)
    sides = np.full(len(sets), 2)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    assert len(links) > 1000
    found, emitted = [], {}
    for key in np.unique(np.concatenate([jaccard_join.prefix(s, 90) for s in sets])).tolist():
        at = [i for i, s in enumerate(sets) if key in jaccard_join.prefix(s, 90).tolist()]
        got = jaccard_join.spanning_links(key, [sets[i] for i in at], at, sides[: len(at)], 90)
        assert len(got) < len(at)
        emitted[key] = len(got)
        found += [(at[x], at[y]) for x, y in got]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in links}
    assert groups(found, len(sets)) == groups(links, len(sets))
    assert jaccard_join.spanning_links(key, [sets[i] for i in at], [7] * len(at), sides[: len(at)], 90) == []
    whole = jaccard_join.spanning_links(None, sets, list(range(len(sets))), sides, 90)
    assert len(whole) < len(sets)
    assert groups(whole, len(sets)) == groups(links, len(sets))
    x, y = np.array([3, 1, 5]), np.array([1, 0, 6])
    assert jaccard_join.labels(7, x, y).tolist() == [0, 0, 2, 0, 4, 5, 5]


def groups(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_line_dedup(docs, none):
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "key", "quality_keep", "odd name", "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(texts())
    seen, gone = {}, defaultdict(set)
    for i, t in sorted({(-1 if i is None else i, t) for i, t in texts() if t is not None}):
        ls = [(k, x) for k, x in enumerate(t.split("\n")) if x.encode().split()]
        for s in range(len(ls)):
            for n in (1, 2, 3):
                part = ls[s : s + n]
                if len(part) == n and (n == 3 or sum(len(x.encode().split()) for _, x in part) >= 50):
                    if seen.setdefault(tuple(x for _, x in part), (i, s)) != (i, s):
                        gone[i, t] |= {k for k, _ in part}
    for r in got:
        before = next(t for i, t in texts() if i == r.doc_id and (i is not None or (t is None) == (r.text is None)))
        cut = gone[-1 if r.doc_id is None else r.doc_id, before]
        want = before if before is None else "\n".join(x for k, x in enumerate(before.split("\n")) if k not in cut)
        assert (r.text, r.n_removed) == (want, len(cut)), r.doc_id
    assert sum(r.n_removed for r in got) > 5
    assert line_dedup.line_dedup(none).count() == 0
    names = ["__id", "__of", "__gone", "__lines", "a.b"]
    clash = line_dedup.line_dedup(docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in names]))
    assert clash.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    assert {tuple(r[c] for c in names) for r in clash.collect()} == {tuple(names)}
    assert sorted((str(r.doc_id), str(r.text)) for r in clash.collect()) == sorted((str(r.doc_id), str(r.text)) for r in got)


def test_line_dedup_of_long_runs(spark):
    """A passage of many lines, shifted, in several texts: its first place stays whole, later ones go whole."""
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 7)))
    passage = [line() for _ in range(40)]
    rows = [(i, "\n".join([*(line() for _ in range(i)), *passage[i % 5 :], "", *(line() for _ in range(7 - i % 3))])) for i in range(1, 30)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, text in rows:
        own = text.split("\n")
        at = {k for k in range(i, i + 40 - i % 5)} if i > 1 and not (i == 5) else set(range(6, 45)) if i == 5 else set()
        assert got[i].n_removed == len(at), i
        assert got[i].text == "\n".join(x for k, x in enumerate(own) if k not in at)


def plain_substrings(rows, w):
    seen, out = set(), {}
    for i, t in sorted({(-1 if i is None else i, t or "") for i, t in rows}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                gone[k : k + w] = True
            seen.add(b[k : k + w])
        out[i, t] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    """Where the hash says nothing, the bytes alone give the same result."""
    shared = say(40, 30)
    docs = [(say(41 + k, 20) + shared + say(51 + k % 3, 20)).encode() for k in range(12)]
    suffixes = suffix_dedup.Suffixes(100)
    (rows, _, who, spans), *_ = suffixes.of(((k, 0, d) for k, d in enumerate(docs)), 1, np.zeros(0, np.uint64))
    owner = np.column_stack([who, who])
    grams = [r[1 : 1 + suffix_dedup.GRAM].tobytes() for r in rows]
    group = np.array([sorted(set(grams)).index(g) for g in grams])
    want = suffixes.resolve(rows, owner, spans, group)
    assert len(want) >= 11
    _, up, down = suffix_dedup._tables()
    monkeypatch.setattr(suffix_dedup, "_tables", lambda: (np.ones(256, np.uint64), up, down))
    assert (suffixes.resolve(rows, owner, spans, group) == want).all()


def test_suffix_dedup(docs, none, monkeypatch):
    for frequent in (1, 200):  # all anchors by the longer gram, and none
        monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
        got = suffix_dedup.substring_dedup(docs).collect()
        want = plain_substrings(texts(), 100)
        assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted((-1 if i is None else i, *want[-1 if i is None else i, t or ""]) for i, t in texts())
    assert suffix_dedup.substring_dedup(none).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    rows = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(500)]
    runs = [sorted(rows[k::7]) for k in range(7)] + [[]]
    blobs = [suffix_dedup.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 12), np.zeros((len(r), 1))) for r in runs]
    out = list(suffix_dedup.LoserTree([suffix_dedup.front_decode(b, 12, 1) for b in blobs]))
    assert [r for r, _, _ in out] == sorted(rows)
    for (a, _, _), (b, same, _) in zip(out, out[1:], strict=False):
        assert same == next((k for k in range(12) if a[k] != b[k]), 12)


def plain_top(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = min(v for i, v in ok if i == q)
        scored = sorted((-max(-(2**61), min(2**61, sum(a * b for a, b in zip(v, c, strict=True)))), i) for i, c in ok if i != q and len(c) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(450)]
    rows += [(i, rows[7][1]) for i in range(500, 560)]  # ties
    rows += [(600, None), (601, [1.0, None, 0.0, 0.0]), (602, [float("nan"), 0.0, 0.0, 0.0]), (603, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[3][1]), (700, [0.5, 0.25]), (701, [0.125, -3.0]), (800, []), (900, [1e9] * 4), (200, rows[200][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = [tuple(r) for r in topk.exact_top_k(df).orderBy("query_id", "rank").collect()]
    assert got == plain_top(rows)
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(2)).collect()), key=str)
    assert len(got) == len(texts())
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = mixing.targets(list(sizes.items()), (5, 2, 1), 1.5, 2.0)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert {(r.source_size, r.target) for r in got} == {(sizes[s], want[s]) for s in sizes}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "w " * rng.randrange(1, 40)) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in got)


def test_targets_reshare_what_full_sources_leave():
    got = mixing.targets([("a", 10), ("b", 100), (None, 100)], (5, 2, 1), 1.5, 2.0)
    assert got["a"] == 20
    assert got["b"] == pytest.approx(2 * got[None])
    assert sum(got.values()) == pytest.approx(315)


def test_sentencepiece(docs, none):
    codec = sentencepiece_codec.load_codec(piece_model())
    got = sentencepiece_codec.encode_documents(docs, piece_model()).collect()
    assert len(got) == len(texts())
    by_text = {(i, t or "") for i, t in texts()}
    for r in got:
        t = next(t for i, t in by_text if i == r.doc_id and codec.lib.encode(t, add_bos=True, add_eos=True) == r.ids)
        assert codec.lib.decode(r.ids) == r.decoded
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    digests = sentencepiece_codec.encode_documents(docs, piece_model(), digests=True).collect()
    assert sorted(r.ids_sha256 for r in digests) == sorted(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in got)
    flat = lambda r: hashlib.sha256(np.stack([r.starts, r.ends], axis=1).astype("<u4").tobytes() if r.ids else b"").hexdigest()
    assert sorted(r.spans_sha256 for r in digests) == sorted(flat(r) for r in got)
    assert sentencepiece_codec.encode_documents(none, piece_model()).count() == 0


def test_character_map_normalises_as_the_library_does():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        own = sentencepiece_codec.Normalizer(proto.normalizer_spec)
        for t in ["", " ", "ﬁ①㌔ ｶﾞ  x　y ", "각 Ⅷ Straße", "a\tb\n c", *[t for _, t in texts() if t and "\x00" not in t and len(t) < 5000]]:
            norm, source = own(t.encode())
            assert norm.decode() == lib.normalize(t)
            assert len(source) == len(norm) + 1
            assert (np.diff(source) >= 0).all()


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nWARC-Type: x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "y" * 3_000_000), (6, "u", "\x00\r\n\r\nWARC/1.1"), (6, "u", "\x00\r\n\r\nWARC/1.1"), (-7, "u", "z")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    for floor in (0, 5):
        path = f"file://{tmp_path}/{floor}"
        warc.write_archives(pages, path, min_bytes=floor)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == len(rows)
        for i, _, html in rows:
            body = (html or "").encode()
            same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
            revisit = len(body) >= floor and i != max(same)
            match = [r for r in got if r.record_id == f"<urn:page:{i}>"]
            assert len(match) == sum(j == i for j, _, _ in rows)
            for r in match:
                assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
                assert (r.record_type, r.refers_to) == (("revisit", f"<urn:page:{max(same)}>") if revisit else ("response", None))
                assert revisit or bytes(r.payload) == body
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_roll(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(20_000))) for i in range(300)]
    path = f"{tmp_path}/rolled"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{path}", archive_bytes=200_000)
    sizes = [p.stat().st_size for p in pathlib.Path(path).glob("part-*")]
    assert len(sizes) >= 4
    assert max(sizes) < 1_000_000  # an archive holds the records its dictionary is trained on, whatever its size
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read_archives(spark, f"file://{path}").collect()}
    assert got == {f"<urn:page:{i}>": html for i, _, html in rows}


def test_warc_rejects_damage():
    good = warc.make_record(1, "u", b"body", warc.payload_digest(b"body"), False, None, "2024-01-01T00:00:00Z")
    assert warc.parse_http(*warc.parse_record(good)) == (b"body", 4)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"body", b"bodx")):
        with pytest.raises(ValueError):
            warc.parse_http(*warc.parse_record(bad))
    data = b"".join(warc._compress(iter([good] * 50), 3))
    assert list(warc.read_frames(data)) == [good] * 50
    for cut in (5, len(data) - 3):
        with pytest.raises(ValueError):
            list(warc.read_frames(data[:cut]))
    with pytest.raises(ValueError):
        list(warc.read_frames(data + b"junk"))


def test_language_id(spark, sf_dir, docs, none):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = real.join(langid.identify_language(real), "doc_id").where("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.9
    rows = langid.identify_language(docs).collect()
    assert len(rows) == len(texts())
    letterless = {4, 5, 6}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in letterless)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de") for r in rows if r.doc_id is not None and r.doc_id not in letterless)
    assert langid.identify_language(none).count() == 0
    assert {r.lang_pred for r in langid.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 20):
        code = langid.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 5)


def test_quality(spark, sf_dir, docs, none):
    real, labels = (spark.read.parquet(f"{sf_dir[: -len('0.001')]}0.01/{t}.parquet") for t in ("documents", "labels"))
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    everything = quality.quality_classifier(real, labels.where(~aside))
    scored = everything.join(labels.where(aside), "doc_id").collect()
    assert len(scored) > 100
    assert np.mean([r.quality_keep == bool(r.quality) for r in scored]) > 0.9
    model = quality.fit_quality(real.repartition(7), labels.where(~aside), meta_cols=("lang", "source", "n_chars"))
    (a1, a0), (b1, b0), (c1, c2, c0) = model.scale
    for r in everything.orderBy("doc_id").limit(60).collect():
        a, b = (sum(float(w) * float(x) for w, x in zip(weights, [*view, 1.0], strict=True)) for weights, view in ((model.text, quality.text_view(r.text)), (model.meta, quality.meta_view([r.lang, r.source, r.n_chars]))))
        want = [1 / (1 + np.exp(-z)) for z in (a1 * a + a0, b1 * b + b0, c1 * a + c2 * b + c0)]
        assert [r.quality_text, r.quality_meta, r.quality_score] == pytest.approx(want, abs=1e-3)
    odd = docs.withColumns({"__y": F.lit(5), "__id": F.lit("z"), "a.b": F.lit(1)})
    assert {(r["__y"], r["__id"]) for r in quality.quality_classifier(odd, labels).collect()} == {(5, "z")}
    marks = spark.createDataFrame([(1, 1), (1, 1), (3, 1), (7, 0), (8, 0), (9, 0), (10, 1), (11, None), (None, 0), (99, 1), (14, 0)], "doc_id long, quality int")
    out = quality.quality_classifier(docs, marks)
    assert out.columns == [c for c in docs.columns if c != "quality_keep"] + ["quality_text", "quality_meta", "quality_score", "quality_keep"]
    got = out.collect()
    assert len(got) == len(texts())
    assert all(0 <= r.quality_score <= 1 for r in got)
    assert {r.quality_score for r in quality.quality_classifier(docs, marks.limit(0)).collect()} == {0.5}
    assert {r.quality_score for r in quality.quality_classifier(docs, marks.where("quality = 1")).collect()} == {1.0}
    assert quality.quality_classifier(none, marks).count() == 0


def test_views_exchange_confident_labels():
    """One round by hand: a view's confident rows, and only they, are what the other one learns from."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    x = (y[:, None] * 2 - 1) * 1.5 + rng.normal(size=(400, 3))
    z = (y[:, None] * 2 - 1) * 1.0 + rng.normal(size=(400, 2))
    seen = np.where(np.arange(400) < 80, y, -1).astype(float)
    one, none = (quality.co_train(x.astype(np.float32), z.astype(np.float32), seen, rounds=r) for r in (1, 0))
    a, b, _ = none.score(x[80:], z[80:])
    sure = [int(((p >= quality.CONFIDENT) | (p <= 1 - quality.CONFIDENT)).sum()) for p in (a, b)]
    assert one.exchanged == [tuple(sure)]
    assert min(sure) > 0
    train = np.setdiff1d(np.arange(80), np.concatenate([np.flatnonzero(seen == c)[quality.CALIBRATE - 1 :: quality.CALIBRATE] for c in (0, 1)]))
    given = 80 + np.flatnonzero((a >= quality.CONFIDENT) | (a <= 1 - quality.CONFIDENT))
    labels = np.concatenate([seen[train], (a[given - 80] > 0.5).astype(float)])
    want = quality.fit_logistic(z[[*train, *given]].astype(np.float32), labels.astype(np.float32), np.concatenate([np.ones(len(train)), np.full(len(given), 0.5)]).astype(np.float32))
    assert one.meta == pytest.approx(want, abs=1e-4)
    assert np.mean((one.score(x, z)[2] > 0.5) == y) > 0.9


def test_codewords_are_decoded_by_least_weighted_loss():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 300)
    x = np.abs(rng.normal(size=(300, 12)) * 0.05 + np.eye(4)[y].repeat(3, axis=1)).astype(np.float32)
    model = langid.train(x, y, ["a", "b", "c", "d"], steps=60, rate=1.0)
    best, score, unsure = model.predict(x)
    for i in range(40):
        losses = []
        for word in model.code.tolist():
            margins = [sum(float(v) * float(w) for v, w in zip(x[i], model.weights[:, k], strict=True)) + float(model.bias[k]) for k in range(len(word))]
            losses.append(sum(float(u) * np.log1p(np.exp(-m * c)) for u, m, c in zip(model.bit_weight, margins, word, strict=True)))
        p = 1 / sum(np.exp(min(losses) - v) for v in losses)
        assert best[i] == losses.index(min(losses))
        assert score[i] == pytest.approx(p, abs=1e-3)
        assert unsure[i] == (p < 0.75) or abs(p - 0.75) < 1e-3
    assert np.mean(best == y) > 0.95


def test_top_k_is_exact_up_to_long(spark):
    big = [(0, [2.0**30, 0.0]), (100, [-(2.0**30), 0.0])]
    rows = big + [(i, [x / 1024, 0.0]) for i, x in ((1, 2**22 + 1), (2, 2**22 + 2), (3, 2**22 + 3), (4, 2**23 - 1), (5, 5), (6, -(2**23) + 1), (7, -(2**22)))]
    want = []
    for q, v in big:
        whole = lambda u: [int(1024 * x) for x in u]
        scored = sorted((-sum(a * b for a, b in zip(whole(v), whole(u), strict=True)), i) for i, u in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored) if n < 4]
    assert max(s for *_, s in want) > 2**62
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert [tuple(r) for r in topk.exact_top_k(df, k=4).orderBy("query_id", "rank").collect()] == want
    past = spark.createDataFrame([*rows, (8, [2.0**30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range of a long"):
        topk.exact_top_k(past, k=4).collect()
