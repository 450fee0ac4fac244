"""Removal of repeated byte strings with a distributed, common-prefix-aware merge of sorted suffix runs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import discard, materialize

#: A suffix is sampled where a gram of so many bytes is the smallest in some window; frequent ones are sampled again by the longer gram.
GRAM, LONG_GRAM = 32, 96
#: Anchors with more occurrences than this are resolved by the longer gram.
FREQUENT = 200
#: Texts are hashed in pieces of so many windows, which keeps positions within the low bits of a sampling key.
PIECE, POSITION_BITS = 1 << 19, 20
#: Suffixes that a map task sorts at once into one run, and the bytes that one merging task should get.
RUN_ENTRIES, MERGE_BYTES = 60_000, 8 << 20
#: Suffixes whose windows are compared at once.
RESOLVE_ENTRIES = 8_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, powers of an odd base and of its inverse (modulo 2^64)."""
    rng = np.random.default_rng(20240229)
    value = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x5851F42D4C957F2D
    n = PIECE + 256
    up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return value, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Rolling hashes of any length over one piece of text."""

    def __init__(self, raw: bytes):
        value, up, self.down = _tables()
        self.n = len(raw)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(value[np.frombuffer(raw, np.uint8)] * up[: self.n], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        h = (self.sums[size:] - self.sums[:-size]) * self.down[: self.n - size + 1]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))

    def anchors(self, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """All grams of ``size``, and for each start of a window the place of its smallest gram, the leftmost of equals."""
        grams = self.grams(size)
        low = np.uint64((1 << POSITION_BITS) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, want = 1, window - size + 1
        while span * 2 <= want:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < want:
            best = np.minimum(best[: len(best) - (want - span)], best[want - span :])
        return grams, (best & low).astype(np.int64)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Pack:
    """Texts side by side in one buffer, so that one pass of array operations serves many short ones.

    ``starts`` are the windows that lie wholly in one text, ``row`` and ``offset`` say whose they are and where in it.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]], window: int):
        self.raw = b"".join(p for _, _, p in pieces)
        size = np.array([len(p) for _, _, p in pieces])
        self.begin = np.cumsum(size) - size
        whole = size - window + 1
        piece = np.repeat(np.arange(len(pieces)), whole)
        first = np.cumsum(whole) - whole
        self.starts = self.begin[piece] + np.arange(len(piece)) - first[piece]
        self.row = np.array([r for r, _, _ in pieces])[piece]
        self.offset = (np.array([o for _, o, _ in pieces]) - self.begin)[piece]

    def runs(self, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of each run of windows, one after the other, with one anchor."""
        if not len(starts):
            return starts, starts
        begin = np.flatnonzero(np.concatenate([[True], (at[starts[1:]] != at[starts[:-1]]) | (np.diff(starts) != 1)]))
        return begin, np.concatenate([begin[1:], [len(starts)]]) - 1


def packs(texts: Iterator[tuple[int, int, bytes]], window: int) -> Iterator[Pack]:
    """Packs of bounded size; a longer text is cut so that each of its windows lies wholly in one piece."""
    held, size = [], 0
    for row, offset, raw in texts:
        for at in range(0, max(len(raw) - window + 1, 0), PIECE):
            piece = raw[at : at + PIECE + window - 1]
            if size + len(piece) > PIECE + window and held:
                yield Pack(held, window)
                held, size = [], 0
            held.append((row, offset + at, piece))
            size += len(piece)
    if held:
        yield Pack(held, window)


def sampled(texts: Iterator[tuple[int, int, bytes]], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the anchors of texts, one for each occurrence, rows in order."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for pack in packs(texts, window):
        grams, at = Hashes(pack.raw).anchors(gram, window)
        first, _ = pack.runs(at, pack.starts)
        rows.append(pack.row[first])
        hashes.append(grams[at[pack.starts[first]]])
    return np.concatenate(rows), np.concatenate(hashes)


def segments(texts: Iterator[tuple[int, int, bytes]], window: int, shared: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Row, level, start and bytes of the stretches whose windows have a shared (level 1) or a frequent anchor (level 2)."""
    for pack in packs(texts, window):
        grams, at = Hashes(pack.raw).anchors(GRAM, window)
        found = grams[at[pack.starts]]
        hot = np.isin(found, frequent)
        for level, wanted in ((1, np.isin(found, shared) & ~hot), (2, hot)):
            pick = np.flatnonzero(wanted)
            starts = pack.starts[pick]
            if len(starts):
                begin = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
                end = np.concatenate([begin[1:], [len(starts)]]) - 1
                who = pick[begin]
                for row, offset, first, last in zip(pack.row[who].tolist(), pack.offset[who].tolist(), starts[begin].tolist(), starts[end].tolist(), strict=True):
                    yield row, level, first + offset, pack.raw[first : last + window]


class Suffixes:
    """Sampled suffixes as rows of bytes, so that byte order is suffix order.

    A row holds: level, text from the anchor on (``window`` bytes, padded), text before it read backwards (padded), and
    the two lengths. Each row stands for the windows of one document that have this anchor.
    """

    def __init__(self, window: int):
        self.window, self.left = window, window - GRAM
        self.width = 1 + window + self.left + 2

    def of(self, texts: Iterator[tuple[int, int, bytes]], level: int, shared_long: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of stretches: rows, hashes that say where they meet, whose they are, and the first and last window start of each."""
        w = self.window
        for pack in packs(texts, w):
            grams, at = Hashes(pack.raw).anchors(GRAM if level == 1 else LONG_GRAM, w)
            pick = np.arange(len(pack.starts)) if level == 1 else np.flatnonzero(np.isin(grams[at[pack.starts]], shared_long))
            if not len(pick):
                continue
            starts = pack.starts[pick]
            begin, end = pack.runs(at, starts)
            first, last = starts[begin], starts[end]
            anchor = at[first]
            right, left = last + w - anchor, anchor - first
            text = np.frombuffer(pack.raw, np.uint8)
            out = np.zeros((len(begin), self.width), np.uint8)
            out[:, 0] = level
            col = np.arange(w)
            out[:, 1 : 1 + w] = np.where(col < right[:, None], text[np.minimum(anchor[:, None] + col, len(text) - 1)], 0)
            col = np.arange(self.left)
            out[:, 1 + w : -2] = np.where(col < left[:, None], text[np.maximum(anchor[:, None] - 1 - col, 0)], 0)
            out[:, -2], out[:, -1] = right, left
            yield out, grams[anchor], pack.row[pick[begin]], np.stack([first, last], axis=1) + pack.offset[pick[begin]][:, None]

    def grouped(self, level: int) -> int:
        """The common prefix from which on two suffixes share their anchor."""
        return 1 + (GRAM if level == 1 else LONG_GRAM)

    def resolve(self, rows: np.ndarray, owner: np.ndarray, span: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Document, start and end of the windows that occur earlier in their group; ``owner`` is (id, hash of text)."""
        w, n = self.window, len(rows)
        right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
        text = np.concatenate([rows[:, 1 + w : -2][:, ::-1], rows[:, 1 : 1 + w]], axis=1)
        value, up, down = _tables()
        sums = np.zeros((n, text.shape[1] + 1), np.uint64)
        np.cumsum(value[text] * up[: text.shape[1]], axis=1, out=sums[:, 1:])
        which, starts, hashes = [], [], []
        for back in range(self.left + 1):  # windows that start so many bytes before the anchor
            mine = np.flatnonzero((back <= left) & (w - back <= right))
            if not len(mine):
                continue
            at = self.left - back
            which.append(mine)
            starts.append(span[mine, 0] + left[mine] - back)
            hashes.append((sums[mine, at + w] - sums[mine, at]) * down[at])
        which, starts, hashes = (np.concatenate(x) for x in (which, starts, hashes))
        order = np.lexsort([starts, owner[which, 1], owner[which, 0], hashes, group[which]])
        h, g = hashes[order], group[which][order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (g[1:] == g[:-1])])
        at = self.left - (span[which, 0] + left[which] - starts)
        now = np.flatnonzero(again)
        wrong = now[~same_bytes(text, which[order[now - 1]], which[order[now]], at[order[now - 1]], at[order[now]], w)]
        if len(wrong):  # different windows with one hash: these are told apart by their bytes
            run = np.cumsum(~again)
            seen = set()
            for k in np.flatnonzero(np.isin(run, run[wrong])).tolist():
                row, first = which[order[k]], at[order[k]]
                key = (int(run[k]), text[row, first : first + w].tobytes())
                again[k] = key in seen
                seen.add(key)
        later = order[again]
        return intervals(owner[which[later]], starts[later], w)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows of rows ``a`` and ``b`` hold the same bytes. Windows of two rows that start at one place share one comparison of the rows."""
    out = np.zeros(len(a), bool)
    level = at_a == at_b
    pairs, which = np.unique(a[level] * len(text) + b[level], return_inverse=True)
    low, high = pairs // max(len(text), 1), pairs % max(len(text), 1)
    sums = np.zeros((len(pairs), text.shape[1] + 1), np.uint8)  # at most 255 columns
    for k in range(0, len(pairs), 4096):
        np.cumsum(text[low[k : k + 4096]] != text[high[k : k + 4096]], axis=1, dtype=np.uint8, out=sums[k : k + 4096, 1:])
    first = at_a[level]
    out[level] = sums[which, first] == sums[which, first + window]
    return out


def intervals(owner: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Rows ``id, hash, start, end`` of the bytes that the windows cover, windows one after the other as one."""
    order = np.lexsort([starts, owner[:, 1], owner[:, 0]])
    owner, starts = owner[order], starts[order]
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]).any(axis=1) | (np.diff(starts) > 1)]))
    end = np.concatenate([new[1:], [len(starts)]]) - 1
    return np.column_stack([owner[new], starts[new], starts[end] + window])


def front_code(rows: np.ndarray, meta: np.ndarray) -> bytes:
    """Sorted rows as common prefix lengths, what follows them, and 64-bit figures."""
    n = len(rows)
    same = np.zeros(n, "<u2")
    if n > 1:
        differ = rows[1:] != rows[:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    rest = rows[np.arange(rows.shape[1]) >= same[:, None]]
    return n.to_bytes(8, "little") + same.tobytes() + meta.astype("<i8").tobytes() + rest.tobytes()


def front_decode(blob: bytes, width: int, fields: int) -> Iterator[tuple[bytes, int, tuple[int, ...]]]:
    """Rows of a run one by one, each with the length that it shares with the one before."""
    n = int.from_bytes(blob[:8], "little")
    shared = np.frombuffer(blob, "<u2", n, 8).tolist()
    meta = np.frombuffer(blob, "<i8", n * fields, 8 + 2 * n).reshape(n, fields)
    at, row = 8 + 2 * n + 8 * n * fields, b""
    for k in range(n):
        s = shared[k]
        row = row[:s] + blob[at : at + width - s]
        at += width - s
        yield row, s, tuple(meta[k].tolist())


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two rows that agree before ``at``."""
    if a == b:
        return len(a)
    x = int.from_bytes(a[at:], "big") ^ int.from_bytes(b[at:], "big")
    return len(a) - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs. Every run knows how long a prefix it shares with the row that went out last.

    Of two runs the one that shares more comes first, without a look at their rows; rows are compared only if both share
    equally much, and only behind that prefix.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, tuple[int, ...]]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.head: list = [None] * self.size  # row, shared prefix, figures; None: the run has ended
        for k, r in enumerate(runs):
            got = next(r, None)
            self.head[k] = got and [got[0], 0, got[2]]
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix is then the one that it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None:
            return b, a
        if y is None or x[1] > y[1]:
            return a, b
        if x[1] < y[1]:
            return b, a
        same = _common(x[0], y[0], x[1])
        if same == len(x[0]) or x[0][same] < y[0][same]:
            y[1] = same
            return a, b
        x[1] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple[int, ...]]]:
        while (top := self.head[self.winner]) is not None:
            yield top[0], top[1], top[2]
            k = self.winner
            got = next(self.runs[k], None)
            self.head[k] = got and [got[0], got[1], got[2]]
            node = (k + self.size) // 2
            while node:
                k, self.loser[node] = self._play(k, self.loser[node])
                node //= 2
            self.winner = k


FIELDS = 4  # id, hash of text, first and last window


def make_runs(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], suffixes: Suffixes, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Sorted front-coded runs by bucket; of equal suffixes the earliest stays, the others' bytes come under a negative bucket."""
    rows, meets, meta = (np.concatenate(x) for x in zip(*entries, strict=True))
    bucket = (meets >> np.uint64(7)) % np.uint64(buckets)
    # ranked as big-endian words, the first word weighs most
    wide = np.zeros((len(rows), -(-suffixes.width // 8) * 8), np.uint8)
    wide[:, : suffixes.width] = rows
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort([meta[:, 2], meta[:, 1], meta[:, 0], *words.T[::-1], bucket])
    rows, meta, bucket = rows[order], meta[order], bucket[order]
    equal = np.concatenate([[False], (rows[1:] == rows[:-1]).all(axis=1) & (bucket[1:] == bucket[:-1])])
    gone = meta[equal]
    if len(gone):
        yield -1 - int(gone[0, 1]) % buckets, np.column_stack([gone[:, :3], gone[:, 3] + suffixes.window]).astype("<i8").tobytes()
    rows, meta, bucket = rows[~equal], meta[~equal], bucket[~equal]
    cuts = np.concatenate([_changes(bucket), [len(bucket)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), front_code(rows[a:b], meta[a:b])


def merge_runs(blobs: list[bytes], suffixes: Suffixes) -> Iterator[np.ndarray]:
    """Rows ``id, hash, start, end`` of repeated bytes, from the runs of one partition."""
    held, gone, group, level = [], [], -1, 0

    def flush() -> np.ndarray:
        count: dict[int, int] = {}
        for g, _, _ in held:
            count[g] = count.get(g, 0) + 1
        several = [x for x in held if count[x[0]] > 1]
        out = [np.array([(m[0], m[1], m[2], m[3] + suffixes.window) for m in gone], np.int64).reshape(-1, 4)]
        if several:
            rows = np.frombuffer(b"".join(x[1] for x in several), np.uint8).reshape(len(several), suffixes.width)
            meta = np.array([x[2] for x in several], np.int64)
            out.append(suffixes.resolve(rows, meta[:, :2], meta[:, 2:], np.array([x[0] for x in several])))
        return np.concatenate(out)

    for row, same, meta in LoserTree([front_decode(b, suffixes.width, FIELDS) for b in blobs]):
        if same == suffixes.width and held:  # the same suffix again: the earlier one stays
            last = held[-1]
            if meta[:3] < last[2][:3]:
                held[-1], meta = (last[0], row, meta), last[2]
            gone.append(meta)
            continue
        if not level or same < suffixes.grouped(level):
            if len(held) >= RESOLVE_ENTRIES or len(gone) >= 10 * RESOLVE_ENTRIES:
                yield flush()
                held, gone = [], []
            group, level = group + 1, row[0]
        held.append((group, row, meta))
    yield flush()


def _triples(spans: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(spans[:, k]) for k in range(4)], ["id", "of", "start", "end"])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """Removes each byte that lies in a ``window``-byte string that also starts earlier: in a smaller id, or before in the same text.

    Whole copies of a text are settled first: all of a later copy goes. For the rest, suffixes are sampled: of the
    grams in each window the smallest by hash is its anchor, so equal windows have equal anchors at equal places, and an
    anchor that occurs once settles its windows. Suffixes at the other anchors are sorted by map tasks into
    runs, front-coded (length of the prefix shared with the row before, and what follows it) and exchanged
    by the hash of their anchor. Merging tasks combine the runs with a loser tree that never compares a known common prefix
    again; equal suffixes end up side by side, where all but the earliest go, and so do suffixes of the same anchor,
    whose windows are compared one by one. A 64-bit hash of their bytes says which windows may be equal; the bytes themselves
    decide, as they do for suffixes.

    Anchors with more than ``FREQUENT`` occurrences (a line in every third document) are sampled again by grams nearly as
    long as the window, which unrelated neighbours of a frequent line don't share, and map tasks send equal suffixes only
    once. Texts travel twice: once to find the stretches at repeated anchors, which alone are sorted, once to be cut.

    Null and empty texts have no bytes; texts shorter than the window stay whole; texts are hashed in pieces, so very
    long ones need no more memory than their bytes and figures; rows of one id and text are one document; ids must be whole numbers, null
    ones count as smallest; an empty table gives no rows. Other columns are ignored, whatever their names.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.
    """
    spark = docs.sparkSession
    text, id_ = F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary"), docs[f"`{id_col}`"]
    own = docs.select(id_.alias("doc_id"), F.coalesce(id_.cast("long"), F.lit(-(2**63))).alias("id"), text.alias("text"))
    own = own.withColumns({"sha": F.sha2("text", 256), "n_bytes": F.octet_length("text").cast("long")}).withColumn("of", F.xxhash64("sha"))
    table = materialize(own.drop("text"), "texts")
    copies = table.groupBy("sha", "n_bytes").agg(F.min("id").alias("first"))
    copies = materialize(copies, "copies")
    whose = materialize(table.join(copies, ["sha", "n_bytes"]), "firsts")
    for done in (table, copies):
        discard(done)
    firsts = whose.where((F.col("id") == F.col("first")) & (F.col("n_bytes") >= window)).select("id", "of").distinct()

    def sampler(gram: int):
        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    row, found = sampled(((k, 0, t.as_py()) for k, t in enumerate(batch.column(2))), window, gram)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))], ["id", "of", "anchors"])

        return sample

    long_texts = own.where(F.col("n_bytes") >= window).select("id", "of", "text")
    anchors = materialize(long_texts.mapInArrow(sampler(GRAM), "id long, of long, anchors array<long>"), "anchors")
    each = anchors.join(firsts, ["id", "of"], "left_semi").select("id", "of", F.explode("anchors").alias("anchor"))
    counts = materialize(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > FREQUENT).alias("frequent"), "n"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    listed = each.join(counts, "anchor").groupBy("id", "of").agg(F.collect_set(F.when(~F.col("frequent"), F.col("anchor"))).alias("shared"), F.collect_set(F.when(F.col("frequent"), F.col("anchor"))).alias("frequent"))

    def hashes(column: pa.ListArray) -> np.ndarray:
        """All hashes in a column of lists; they hold for the whole table, whichever row brought them."""
        return np.unique(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = list(segments(((k, 0, t.as_py()) for k, t in enumerate(batch.column(2))), window, hashes(batch.column(3)), hashes(batch.column(4))))
                if rows:
                    row, level, start, raw = zip(*rows, strict=True)
                    columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(level, pa.int32()), pa.array(start, pa.int64()), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "of", "level", "start", "bytes"])

    listed = materialize(listed, "listed")
    for done in (anchors, counts):
        discard(done)
    listed_texts = own.select("id", "of", "text").join(listed.hint("merge"), ["id", "of"]).dropDuplicates(["id", "of"])
    parts = materialize(listed_texts.select("id", "of", "text", "shared", "frequent").mapInArrow(stretch, "id long, of long, level int, start long, bytes binary"), "stretches")

    discard(listed)
    again = materialize(parts.where("level = 2").select("id", "of", "bytes").mapInArrow(sampler(LONG_GRAM), "id long, of long, anchors array<long>"), "anchors")
    each = again.select("id", "of", F.explode("anchors").alias("anchor"))
    counts = materialize(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "counts")
    listed = materialize(each.join(counts, "anchor").groupBy("id", "of").agg(F.collect_set("anchor").alias("long")), "listed")
    for done in (again, counts):
        discard(done)
    columns = ["id", "of", "level", "start", "bytes", "long"]
    placed = parts.where("level = 1").withColumn("long", F.array().cast("array<bigint>")).select(columns).unionByName(parts.where("level = 2").join(listed, ["id", "of"]).select(columns))

    suffixes = Suffixes(window)
    row_bytes = 2 * window
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * row_bytes // MERGE_BYTES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, n = [], 0

        def sort() -> pa.RecordBatch:
            made = list(make_runs(entries, suffixes, buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "run"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                owner = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                levels, long = batch.column(2).to_numpy(), hashes(batch.column(5))
                for level in (1, 2):
                    texts = ((int(k), batch.column(3)[int(k)].as_py(), batch.column(4)[int(k)].as_py()) for k in np.flatnonzero(levels == level))
                    for rows, meets, who, spans in suffixes.of(texts, level, long):
                        entries.append((rows, meets, np.hstack([owner[who], spans])))
                        n += len(rows)
                        if n >= RUN_ENTRIES:
                            yield sort()
                            entries, n = [], 0
        if entries:
            yield sort()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            for bucket, x in zip(*batch.columns, strict=True):
                if bucket.as_py() < 0:
                    yield _triples(np.frombuffer(x.as_py(), "<i8").reshape(-1, 4))
                else:
                    blobs.append(x.as_py())
        if blobs:
            for spans in merge_runs(blobs, suffixes):
                yield _triples(spans)

    exchanged = placed.mapInArrow(runs, "bucket int, run binary").repartition(buckets, "bucket")
    spans = exchanged.mapInArrow(merge, "id long, of long, start long, end long")
    removed = materialize(spans.groupBy("id", "of").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "removed")
    for done in (parts, listed):
        discard(done)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "of", "n_removed", "n_spans", "kept"]
        for batch in batches:
            n, k, kept = [], [], []
            for raw, starts, ends in zip(*batch.columns[2:], strict=True):
                raw = raw.as_py()
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, starts.values.to_numpy(), 1)
                np.add.at(step, ends.values.to_numpy(), -1)
                gone = np.cumsum(step[:-1]) > 0
                n.append(int(gone.sum()))
                k.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.string())], names)

    results = own.select("id", "of", "text").join(removed.hint("merge"), ["id", "of"]).dropDuplicates(["id", "of"]).select("id", "of", "text", "starts", "ends").mapInArrow(cut, "id long, of long, n_removed long, n_spans long, kept string")
    results = materialize(results, "results")
    discard(removed)
    copy = (F.col("id") != F.col("first")) & (F.col("n_bytes") >= window)
    return whose.join(results, ["id", "of"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
