"""N-gram Jaccard join: count vectors of hashed token groups in packed R-trees."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import discard, materialize
from cellweave.operators.graph import connected_components

#: Tokens that a group of the count vectors holds on average, at most; more would even out unrelated sets.
PER_GROUP, LEAST_GROUPS = 4, 16
#: Members of a cell or cluster, and tokens in them, that one task holds; larger cells are cut into pages, which meet in pairs.
PAGE, PAGE_TOKENS = 1024, 1_000_000
#: A cell with more pages than this outside of its largest component is split by further common tokens, if that makes fewer rows.
PAGES_MET = 4
#: Tokens kept beyond the prefix; cells are keyed by one common token and split by as many more at most.
DEEPER = 2
LEAF = 32
WORDS_CACHED = 400_000
#: Documents from which frequent tokens are learned, how many of them have a frequent token, and how many tokens are told apart at most.
SAMPLE_DOCS, FREQUENT_IN_SAMPLE, FREQUENT_TOKENS = 16_000, 4, 500_000
#: The top bits of a token say how frequent it is, the others are its hash.
CLASS_BITS = 3
HASH_MASK = np.uint64(2 ** (64 - CLASS_BITS) - 1)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[4]
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_CACHED:
            self[word] = h
        return h


@functools.cache
def _words() -> _Words:
    return _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 61-bit hashes of the text's ``n``-word shingles, A-Z lower-cased; fewer words are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and just the six ASCII blanks part words
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _K[0] + h[k : len(h) - size + 1 + k] * _K[1] + _K[2])
    return np.unique(out & HASH_MASK)


def ordered(tokens: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tokens with their class of frequency in the top bits, sorted: rare ones first, by hash within a class."""
    if not len(frequent) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    known = frequent[at] == tokens
    return np.sort(tokens | np.where(known, classes[at], np.uint64(0)) << np.uint64(64 - CLASS_BITS))


def prefix(tokens: np.ndarray, percent: int, more: int = 0) -> np.ndarray:
    """The first tokens, one more than may be missing in a partner: the first common token of two linked sets is in both prefixes.

    With ``more`` tokens beyond these, as many further common tokens are in both as well, if the sets have them (``depth``).
    A set so small that only equal ones link with it needs none.
    """
    size = len(tokens)
    if size * (100 - percent) < percent:
        return tokens[:0]
    return tokens[: size + 1 + more + -percent * size // 100]


def depth(percent: int) -> int:
    """By how many common tokens cells may be keyed: no more than the smallest sets with a prefix share with every partner."""
    if percent >= 100:
        return 1
    least = -(-percent // (100 - percent))
    return max(1, min(1 + DEEPER, -(-percent * least // 100)))


def point(tokens: np.ndarray) -> np.ndarray:
    """The set as a point: how many tokens fall into each of as many groups, a power of two, as its size needs.

    With four tokens a group on average a count above 255 does not occur.
    """
    groups = LEAST_GROUPS
    while groups * PER_GROUP < len(tokens):
        groups *= 2
    counts = np.bincount(((tokens >> np.uint64(8)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points, a row each, in fewer coordinates: a group's number modulo the smaller count is its group there."""
    return points if points.shape[1] == groups else np.minimum(points.reshape(len(points), -1, groups).sum(axis=1), 255).astype(np.uint8)


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Summed minima of points, pair by pair; of two resolutions the finer one is folded to the other."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(sizes), np.int64)
    for a, b in np.unique(sizes, axis=0).tolist():
        at, groups = np.flatnonzero((sizes == [a, b]).all(axis=1)), min(a, b)
        step = max(1, (1 << 22) // max(a, b))
        for k in range(0, len(at), step):
            x, y = (folded(np.frombuffer(b"".join(side[i] for i in at[k : k + step]), np.uint8).reshape(-1, n), groups) for side, n in ((left, a), (right, b)))
            out[at[k : k + step]] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return out


def needed(s: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (s + t) // (100 + percent))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that a packed R-tree over count vectors can't rule out.

    Leaves hold points of one component or of like size; a pair of leaves is dropped if the summed minima of their largest
    coordinates stay below the overlap that their smallest members need, or if it holds one component only, then pairs of points
    likewise. ``side`` 2 belongs to both pages; pairs within one component, or within side 0 or 1 of a pair of pages, are not wanted.
    """
    order = np.lexsort([sizes, comp])
    points, sizes, comp, side = points[order], sizes[order].astype(np.int64), comp[order], side[order]
    starts = np.arange(0, len(points), LEAF)
    if not len(starts):
        return order, order
    top, least = np.maximum.reduceat(points, starts, axis=0), np.minimum.reduceat(sizes, starts)
    low, high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    found = []
    for i, a in enumerate(starts):
        bound = np.minimum(top[i], top[i:]).sum(axis=1, dtype=np.int64)
        ok = (bound >= needed(least[i], least[i:], percent)) & ((low[i] != high[i:]) | (high[i] != low[i:]))
        for j in np.flatnonzero(ok) + i:
            b = starts[j]
            over = np.minimum(points[a : a + LEAF, None], points[None, b : b + LEAF]).sum(axis=2, dtype=np.int64)
            ok = (over >= needed(sizes[a : a + LEAF, None], sizes[None, b : b + LEAF], percent)) & (comp[a : a + LEAF, None] != comp[None, b : b + LEAF])
            ok &= (side[a : a + LEAF, None] == 2) | (side[a : a + LEAF, None] != side[None, b : b + LEAF])
            if i == j:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            found.append(np.stack([order[a + x], order[b + y]]))
    out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return out[0], out[1]


def forest_pairs(points: list[np.ndarray], sizes: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``tree_pairs`` over points of several resolutions: one tree for each resolution and the next finer one folded to it."""
    width = np.array([len(p) for p in points])
    found = [np.zeros((2, 0), np.int64)]
    for groups in np.unique(width):
        at = np.flatnonzero((width == groups) | (width == 2 * groups))
        finer = width[at] > groups
        same = np.empty((len(at), groups), np.uint8)
        for part, n in ((~finer, groups), (finer, 2 * groups)):
            if part.any():
                same[part] = folded(np.stack([points[i] for i in at[part]]).reshape(-1, n), groups)
        x, y = tree_pairs(same, sizes[at], comp[at], side[at], percent)
        fine = finer[x] & finer[y]  # these have a tree of their own
        found.append(np.stack([at[x[~fine]], at[y[~fine]]]))
    out = np.concatenate(found, axis=1)
    return out[0], out[1]


def links_of(x: int, others: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """Those of ``others`` whose sets link with that of ``x``."""
    whole = np.concatenate([sets[y] for y in others])
    sizes = np.array([len(sets[y]) for y in others])
    starts = np.cumsum(sizes) - sizes
    at = np.minimum(np.searchsorted(sets[x], whole), len(sets[x]) - 1)
    same = np.add.reduceat(sets[x][at] == whole, starts, dtype=np.int64)
    ok = 100 * same >= percent * (len(sets[x]) + sizes - same)
    return [y for y, good in zip(others, ok, strict=True) if good]


def spanning_links(key: int | None, sets: list[np.ndarray], comp: list[int], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of a cell or cluster of which none closes a circle, so fewer than members; with a key, pairs that it is the first common token of.

    Pairs come from the R-trees, pairs that are connected by then are skipped, and the others are held against their exact sets.
    """
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sizes = np.array([len(s) for s in sets])
    before = [frozenset(() if key is None else s[: np.searchsorted(s, np.uint64(key))].tolist()) for s in sets]
    a, b = forest_pairs([point(s) for s in sets], sizes, np.array(comp), side, percent)
    order = np.argsort(a, kind="stable")
    out = []
    for x, pairs in itertools.groupby(zip(a[order].tolist(), b[order].tolist(), strict=True), key=lambda p: p[0]):
        rest = [y for _, y in pairs if before[x].isdisjoint(before[y])]
        for at in range(0, len(rest), 256):
            some = [y for y in rest[at : at + 256] if find(comp[y]) != find(comp[x])]
            for y in links_of(x, some, sets, percent) if some else []:
                if find(comp[y]) != find(comp[x]):
                    root[find(comp[y])] = find(comp[x])
                    out.append((x, y))
    return out


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens, and a class for each, from a bounded sample of documents. Any choice gives right results."""
    count = docs.count()
    sample = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) / F.lit(float(2**53)) < F.lit(min(1.0, SAMPLE_DOCS / max(count, 1))))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), n).view(np.int64))], ["token"])

    each = sample.select("text").mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT_IN_SAMPLE)
    rows = each.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toArrow()
    found, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(found)
    classes = np.minimum(np.log2(np.maximum(n[order] / FREQUENT_IN_SAMPLE, 1)).astype(np.uint64) // np.uint64(2) + np.uint64(1), np.uint64(2**CLASS_BITS - 1))
    return found[order], classes


def _signatures(n: int, percent: int, frequent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "set1", "set2", "keys", "point"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, one, two, keys, points = [], [], [], [], []
                for text in batch.column(1):
                    tokens = ordered(shingles(text.as_py(), n), *frequent.value)
                    digest = np.frombuffer(xxhash.xxh128_digest(tokens.tobytes()), "<i8")
                    sizes.append(len(tokens))
                    one.append(digest[0])
                    two.append(digest[1])
                    keys.append(prefix(tokens, percent, DEEPER).view(np.int64))
                    points.append(point(tokens).tobytes())
                long = pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, long), pa.array(one, long), pa.array(two, long), pa.array(keys, pa.list_(long)), pa.array(points, pa.binary())], names)

    return run


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the documents, which is never broadcast."""
    return left.join(right.hint("merge"), on, how)


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose points' summed minima reach the overlap that they need."""
    end = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, pa_, pb = (batch.column(k) for k in range(6))
            if batch.num_rows:
                ok = pa.array(overlaps(pa_.to_pylist(), pb.to_pylist()) >= needed(na.to_numpy(), nb.to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    joined = _met(_met(pairs, end("a"), "a"), end("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
    sized = joined.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return sized.mapInArrow(bound, "a long, b long")


def _tokens(nodes: DataFrame, docs: DataFrame, sets: DataFrame, n: int, frequent: Broadcast) -> DataFrame:
    """``node, tokens`` of the nodes, made again from their texts."""
    wanted = _met(nodes, sets.select("node", F.col("first").alias("doc_id"), "set1", "set2"), "node")
    texts = _met(docs.where("text IS NOT NULL"), wanted, "doc_id").select("node", "text", "set1", "set2")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, found, out = whole.slice(at, 500), [], []
                for node, text, one, two in zip(*batch.columns, strict=True):
                    raw = ordered(shingles(text.as_py(), n), *frequent.value).tobytes()
                    if np.frombuffer(xxhash.xxh128_digest(raw), "<i8").tolist() == [one.as_py(), two.as_py()]:  # ids may repeat with other texts
                        found.append(node.as_py())
                        out.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(out, pa.binary())], ["node", "tokens"])

    return texts.mapInArrow(tokens, "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those whose exact sets link."""
    side = lambda c: tokens.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs merge
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return _met(_met(pairs, side("b"), "b"), side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(link, "a long, b long")


def _prefix_size(percent: int) -> Column:
    """The length of ``prefix`` for sets of ``n`` tokens that have one."""
    return F.expr(f"cast(n + 1 - ({percent} * n + 99) div 100 AS int)")


def _open_cells(members: DataFrame, *also: str) -> DataFrame:
    """The cells ``key, level`` that hold several components, with their numbers of pages and the rows that ``_paged`` makes of them.

    A cell that one task can hold is one page. In larger ones the members of the component with most of them get pages of
    their own, which do not meet each other, so that a group of copies in which most is connected travels about twice at most.
    """
    count = lambda members, tokens: F.greatest(F.ceil(members / PAGE), F.ceil(tokens / PAGE_TOKENS)).cast("int")
    small = (F.col("members") <= PAGE) & (F.col("tokens") <= PAGE_TOKENS)
    each = members.groupBy("key", "level", *also, "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    most = F.max(F.struct("members", "tokens", "root")).alias("top")
    cells = each.groupBy("key", "level", *also).agg(F.sum("members").alias("members"), F.sum("tokens").alias("tokens"), most, F.count(F.lit(1)).alias("roots"))
    rest = F.col("members") - F.col("top.members")
    paged = cells.where("roots > 1").withColumns(
        {
            "tops": F.when(small, 0).otherwise(count(F.col("top.members"), F.col("top.tokens"))),
            "others": F.when(small, 1).otherwise(count(rest, F.col("tokens") - F.col("top.tokens"))),
        }
    )
    rows = F.when(F.col("tops") == 0, F.col("members")).otherwise(F.col("top.members") * F.col("others") + rest * (F.col("tops") + F.col("others")))
    return paged.select("key", "level", *also, F.when(F.col("tops") > 0, F.col("top.root")).alias("top"), "tops", "others", rows.alias("rows"))


def _paged(members: DataFrame, cells: DataFrame) -> DataFrame:
    """Members ``key, level, node, n, root`` of the cells, once for each pair of pages ``low, high`` in which they meet others."""
    in_top = F.coalesce(F.col("root") == F.col("top"), F.lit(False))
    spread = F.xxhash64("node")
    page = F.when(in_top, F.pmod(spread, "tops")).otherwise(F.col("tops") + F.pmod(spread, "others")).cast("int")
    meets = F.sequence(F.when(in_top, F.col("tops")).otherwise(0), F.col("tops") + F.col("others") - 1)
    met = _met(members, cells.select("key", "level", "top", "tops", "others"), ["key", "level"]).withColumn("page", page).withColumn("other", F.explode(meets))
    return met.select(
        "key", "level", F.least("page", "other").alias("low"), F.greatest("page", "other").alias("high"),
        # the page that meets itself is whole; of two pages only pairs across count
        F.when(F.col("page") == F.col("other"), 2).otherwise((F.col("page") > F.col("other")).cast("int")).alias("side"),
        "node", "n", "root",
    )


def _deeper(members: DataFrame, wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of the cells ``wide``, once for each next token that they may have in common with a partner there.

    Sets that link share ``level + 1`` tokens at least (``depth``), and the first of these are in both prefixes with ``level``
    tokens more: a pair whose first common tokens name a cell meets in just one of the cells that come of it.
    """
    held = _met(_met(members, wide.select("key", "level"), ["key", "level"]), sets.select("node", "keys"), "node")
    at = F.array_position("keys", F.col("last")).cast("int")
    following = F.slice("keys", at + 1, F.greatest(F.lit(0), _prefix_size(percent) + F.col("level") - at))
    each = held.select(F.col("key").alias("parent"), "level", "node", "n", "root", F.explode(following).alias("last"))
    return each.select(F.xxhash64("parent", "last").alias("key"), (F.col("level") + 1).alias("level"), "parent", "last", "node", "n", "root")


def _spread(placed: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``_paged`` for members ``key, node, n, root``, and the written tables that they are read from.

    A cell with many unlinked members would make rows with their square over the page's size. It is split by a further common
    token, and what stays large by one more, wherever that halves the rows at least; members that share no further token with
    another one then make no row.
    """
    members = placed.select("key", F.lit(1).alias("level"), F.col("key").alias("last"), "node", "n", "root")
    cells = materialize(_open_cells(members), "open")
    out, used = [], [cells]
    for _ in range(1, depth(percent)):
        wide = cells.where(F.col("others") > PAGES_MET)
        if not wide.take(1):
            break
        deeper = materialize(_deeper(members, wide, sets, percent), "deeper")
        inner = materialize(_open_cells(deeper, "parent"), "inner")
        cost = inner.groupBy(F.col("parent").alias("key")).agg(F.sum("rows").alias("inner_rows"))
        halved = materialize(_met(wide, cost, "key", "left").where(2 * F.coalesce("inner_rows", F.lit(0)) <= F.col("rows")).select("key"), "halved")
        used += [deeper, inner, halved]
        out.append(_paged(members, _met(cells, halved, "key", "left_anti")))
        parents = halved.select(F.col("key").alias("parent"))
        members, cells = _met(deeper, parents, "parent", "left_semi"), _met(inner, parents, "parent", "left_semi")
    out.append(_paged(members, cells))
    return functools.reduce(DataFrame.unionByName, out), used


def _by_cell(rows: DataFrame, columns: list[str]) -> DataFrame:
    place = ["key", "level", "low", "high"]
    return rows.repartition(*place).sortWithinPartitions(*place).select(*place, *columns)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int, int], list[dict]]]:
    rows = (r for batch in batches for r in batch.to_pylist())
    for place, group in itertools.groupby(rows, key=lambda r: (r["key"], r["level"], r["low"], r["high"])):
        yield place, list(group)


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one that the pairs ``x, y`` connect it with."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[x], out[y])
        new = out.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _near(members: DataFrame, percent: int) -> DataFrame:
    """The members that have a partner of another component in their cell which the bound can't rule out: a row or none for each.

    ``label`` is a member that such pairs connect it with, the same one for all that are connected.
    """
    names = ["key", "level", "low", "high", "side", "node", "root", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in _groups(batches):
            column = lambda c: np.array([r[c] for r in held], np.int64)  # noqa: B023, E731
            node = column("node")
            x, y = forest_pairs([np.frombuffer(r["point"], np.uint8) for r in held], column("n"), column("root"), column("side"), percent)
            near = np.unique(np.concatenate([x, y]))
            if len(near):
                fixed = [np.full(len(near), v, t) for v, t in zip(place, (np.int64, np.int32, np.int32, np.int32), strict=True)]
                found = [*fixed, column("side").astype(np.int32)[near], node[near], column("root")[near], node[labels(len(held), x, y)][near]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return _by_cell(members, ["side", "node", "n", "root", "point"]).mapInArrow(run, "key long, level int, low int, high int, side int, node long, root long, label long")


def _gathered(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``near``, with those of clusters that one task can hold once for each node instead of once for each cell.

    A cluster is what possible pairs connect over all cells. Larger clusters stay in their cells; ``level`` is 0 for a cluster.
    """
    clusters = connected_components(near.select(F.col("node").alias("a"), F.col("label").alias("b")))
    named = materialize(_met(clusters.select("node", F.col("root").alias("cluster")), sets.select("node", "n"), "node"), "clusters")
    discard(clusters)
    small = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens")).where((F.col("members") <= PAGE) & (F.col("tokens") <= PAGE_TOKENS))
    held = _met(named, small.select("cluster", F.lit(True).alias("small")), "cluster", "left").select("node", F.when(F.col("small"), F.col("cluster")).alias("cluster"))
    once = F.col("cluster").isNotNull()
    return _met(near, held, "node").select(
        F.when(once, F.col("cluster")).otherwise(F.col("key")).alias("key"),
        *(F.when(once, 0).otherwise(F.col(c)).alias(c) for c in ("level", "low", "high")),
        F.when(once, 2).otherwise(F.col("side")).alias("side"),
        "node",
        "root",
    ).distinct()


def _spanning(near: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links between components, fewer than members in each cluster, cell or pair of pages, that connect all that links there connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, level, _, _), held in _groups(batches):
            sets = [np.frombuffer(r["tokens"], np.uint64) for r in held]
            found = spanning_links(key % 2**64 if level == 1 else None, sets, [r["root"] for r in held], np.array([r["side"] for r in held]), percent)
            yield pa.RecordBatch.from_arrays([pa.array([held[p[k]]["node"] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_cell(_met(near, tokens, "node"), ["side", "node", "root", "tokens"]).mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more, as components.

    Equal sets are one node. A set is a point: its tokens are hashed into groups, as many as its size needs, and the groups'
    counts are the coordinates; the overlap of two sets is at most the sum of the smaller coordinates. A single R-tree over
    all points would prune little, as unrelated sets lie within a few counts of each other in each coordinate, and would have to
    meet itself as a whole; so the trees are built in cells that an exchange brings together: the sets that have one of each
    other's first tokens, in an order with rare tokens first, as many as a partner may lack and one more (``prefix``). No link
    can be missed, whatever the order.

    In a cell each point is first held against that of the smallest node, and pairs that pass the bound are verified on their
    exact sets, made again from the texts: one pair for each node, then those that this leaves unconnected. Cells that still
    hold several components build packed R-trees over the points of all members. Members with a partner in another component
    that the bound can't rule out are gathered by what such pairs connect and get their exact sets once; a task for each such
    cluster (for each cell where a cluster is too large for one task) builds trees again, verifies pairs, skips connected ones,
    and returns links without circles. So no step makes a row for each linking pair, however many pairs link. Cells too large for one task
    are dealt to pages (``_paged``); outside of a cell's largest component all pages meet, so cells with many unlinked members are first
    split by a second and third common token, which linked sets have in common as well, wherever that halves the rows (``_spread``). Nothing is capped.

    Null and empty texts have an empty set and link with nothing; short texts are one shingle; null ids get a null
    component and link with nothing; rows of one id and text are one document; an empty table gives no rows. Other columns
    are ignored. Shingles are compared by 61 bits of hash.

    Returns ``doc_id, n_shingles, component_id`` (the smallest id that links reach).
    """
    docs = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))
    made = materialize(docs.mapInArrow(_signatures(words, percent, frequent), f"doc_id {id_type}, n_shingles long, set1 long, set2 long, keys array<long>, point binary"), "signatures")
    ids = materialize(made.select("doc_id", "n_shingles", "set1", "set2"), "ids")
    by_set = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set1", "set2", F.col("n_shingles").alias("n"))
    sets = materialize(by_set.agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("point").alias("point")).withColumn("node", F.monotonically_increasing_id()), "sets")
    discard(made)

    in_cell = sets.select("node", F.explode(F.slice("keys", F.lit(1), _prefix_size(percent))).alias("key"))
    cells = materialize(in_cell.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("cell")).where("cell > 1"), "cells")
    members = materialize(_met(in_cell, cells, "key").select("key", "cell", "a", "node"), "members")
    discard(cells)
    firsts = members.where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n")).select("a", "b")
    likely = materialize(_bounded(firsts, sets, percent), "likely")
    tokens = materialize(_tokens(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, sets, words, frequent), "tokens")
    links = materialize(_verified(likely.groupBy("b").agg(F.min("a").alias("a")), tokens, percent), "links")

    def rooted() -> DataFrame:
        roots = connected_components(links)
        out = materialize(_met(sets.select("node", "n"), roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")), "rooted")
        discard(roots)
        return out

    now = rooted()
    end = lambda c: now.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = materialize(_met(_met(likely, end("a"), "a"), end("b"), "b").where("ra <> rb").select("a", "b"), "apart")
    discard(likely)
    if apart.take(1):
        links = materialize(links.unionByName(_verified(apart, tokens, percent)), "links")
        discard(now)
        now = rooted()
    discard(apart)

    # Pairs with a cell's smallest node are settled now.
    placed = _met(members.where("cell > 2 AND node <> a").select("key", "node"), now, "node")
    paged, used = _spread(placed, sets, percent)
    near = materialize(_near(_met(paged, sets.select("node", "point"), "node"), percent), "near")
    for table in (members, *used):
        discard(table)
    if near.take(1):
        found, known = near, tokens
        near = materialize(_gathered(found, sets), "near")
        discard(found)
        more = _met(near.select("node").distinct(), known.select("node"), "node", "left_anti")
        tokens = materialize(_tokens(more, docs, sets, words, frequent), "tokens").unionByName(known)
        links = materialize(links.unionByName(_spanning(near, tokens, percent)), "links")
        discard(now)
        now = rooted()
    discard(tokens)
    discard(near)

    smallest = _met(now, sets.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    smallest = materialize(smallest, "smallest")
    of_node = _met(now.select("node", "root"), smallest, "root").select("node", "component_id")
    of_set = materialize(_met(sets.select("node", "set1", "set2", F.col("n").alias("n_shingles")), of_node, "node").drop("node"), "components")
    for table in (sets, now, smallest):
        discard(table)
    joined = ids.join(of_set.hint("merge"), ["set1", "set2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))
