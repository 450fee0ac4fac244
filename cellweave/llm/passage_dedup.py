"""Removal of passages that documents with smaller ids hold too: winnowed anchors as seeds, extended to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import discard, materialize, unused

#: Words in an anchor; a window of ``window`` words selects the smallest of its ``window - GRAM + 1`` anchors.
GRAM = 10
#: Texts are handled side by side in pieces of about so many words; places in a piece take the low bits of a selection key.
PIECE, LOW = 1 << 18, np.uint64((1 << 20) - 1)
_BASE = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits for each word; bytes split at the six ASCII spaces."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Ranges:
    """Hashes of any range of words in a row of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, self.down = (np.full(n + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
        up[0] = self.down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _smallest(keys: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` neighbours."""
    have = 1
    while have * 2 <= span:
        keys, have = np.minimum(keys[:-have], keys[have:]), have * 2
    return np.minimum(keys[: len(keys) - (span - have)], keys[span - have :]) if have < span else keys


def places(texts: list[tuple[int, int, np.ndarray]], window: int) -> dict[str, np.ndarray]:
    """The selected anchors of texts: row, place, the first and last window that select it (words before it) and hashes of the anchor and of those windows' words."""
    words = np.concatenate([w for _, _, w in texts])
    size = np.array([len(w) for _, _, w in texts])
    begin = np.cumsum(size) - size
    whole = np.maximum(size - window + 1, 0)
    piece = np.repeat(np.arange(len(texts)), whole)
    starts = begin[piece] + np.arange(len(piece)) - (np.cumsum(whole) - whole)[piece]
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "pos", "first", "last", "anchor", "zone")}
    hashed = Ranges(words)
    each = np.arange(len(words) - GRAM + 1)
    grams = hashed(each, each + GRAM)
    at = (_smallest((grams & ~LOW) | each.astype(np.uint64), window - GRAM + 1)[starts] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)]))
    first, last, at, piece = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1], at[new], piece[new]
    zone = hashed(first, last + window) ^ _mixed(((at - first) * 4096 + last - first).astype(np.uint64))
    offset = (np.array([o for _, o, _ in texts]) - begin)[piece]
    return {"row": np.array([r for r, _, _ in texts])[piece], "pos": at + offset, "first": at - first, "last": at - last, "anchor": grams[at].view(np.int64), "zone": zone.view(np.int64)}


def _grouped(batch: pa.RecordBatch, window: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Texts of a batch in groups of bounded size; a longer text is cut so that each window lies wholly in one piece."""
    held, size = [], 0
    for row, text in enumerate(batch.column(2)):
        words = word_hashes(text.as_py())
        for at in range(0, max(len(words) - window + 1, 0), PIECE):
            part = words[at : at + PIECE + window - 1]
            if size + len(part) > PIECE + window and held:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield held


def _seeds(window: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _grouped(batch, window):
                p = places(group, window)
                row = pa.array(p["row"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), *(pa.array(p[k].astype(np.int32)) for k in ("pos", "first", "last")), pa.array(p["anchor"]), pa.array(p["zone"])],
                    ["id", "of", "pos", "first", "last", "anchor", "zone"],
                )

    return seeds


def _contexts(window: int):
    """The words of each listed place's windows, as hashes."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, of, text, at in zip(*batch.columns, strict=True):
                words = word_hashes(text.as_py()).view(np.int64)
                pos, first, last, anchor = (at.values.field(k).to_numpy() for k in ("pos", "first", "last", "anchor"))
                ends = np.cumsum(first - last + window).astype(np.int32)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets)) + np.repeat(pos - first, np.diff(offsets))
                n = len(pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([id_.as_py()] * n, pa.int64()), pa.array([of.as_py()] * n, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (pos, first, last)), pa.array(anchor), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[index]))],
                    ["id", "of", "pos", "first", "last", "anchor", "words"],
                )

    return contexts


def extended(words: np.ndarray, first: int, last: int, other: np.ndarray, other_first: int, other_last: int) -> tuple[int, int]:
    """Words before and from the anchor on that two places share, within the windows that select them."""
    left, right = min(first, other_first), min(len(words) - first, len(other) - other_first)
    a, b = words[first - left : first][::-1], other[other_first - left : other_first][::-1]
    c, d = words[first : first + right], other[other_first : other_first + right]
    before, after = np.flatnonzero(a != b), np.flatnonzero(c != d)
    return int(before[0]) if len(before) else left, int(after[0]) if len(after) else right


def _extend(window: int):
    """Grows each place's match with its anchor's first place both ways.

    Matches of ``window`` words or more come out with a null ``rest`` if the first place's id is smaller, and windows outside of the match with their hash.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            ids, ofs, poss, firsts, lasts, anchors, r_ids, r_firsts, r_lasts = (batch.column(k).to_numpy() for k in ("id", "of", "pos", "first", "last", "anchor", "r_id", "r_first", "r_last"))
            own, other = batch.column("words"), batch.column("r_words")
            for i in range(batch.num_rows):
                words, pos, first, last = own[i].values.to_numpy(), int(poss[i]), int(firsts[i]), int(lasts[i])
                left, right = extended(words, first, last, other[i].values.to_numpy(), int(r_firsts[i]), int(r_lasts[i]))
                starts = np.arange(-first, -last + 1)
                inside = (starts >= -left) & (starts + window <= right)
                rows = []
                if inside.any() and r_ids[i] < ids[i]:
                    rows.append((pos - left, pos + right, None))
                rest = starts[~inside]
                if len(rest):
                    hashed = Ranges(words.view(np.uint64))(rest + first, rest + first + window).view(np.int64)
                    rows += [(pos + s, pos + s + window, h) for s, h in zip(rest.tolist(), hashed.tolist(), strict=True)]
                for start, end, h in rows:
                    for column, v in zip(out, (ids[i], ofs[i], start, end, anchors[i], h), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "of", "start", "end", "anchor", "rest"])

    return extend


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the marked words from each text: what is left, counts, and the maximal runs that went."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch, out = whole.slice(at, 500), []
            for text, marks in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().split()
                if not marks.is_valid:
                    out.append((b" ".join(words).decode(), len(words), 0, [], []))
                    continue
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, marks.values.field("start").to_numpy(), 1)
                np.add.at(change, marks.values.field("end").to_numpy(), -1)
                gone = np.cumsum(change) > 0  # the last is always False
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
                kept = b" ".join(words[i] for i in np.flatnonzero(~gone[:-1]))
                out.append((kept.decode(), len(words), int(gone.sum()), edges[::2].tolist(), edges[1::2].tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], [*batch.schema.names[2:], "kept", "n_words", "n_removed", "starts", "ends"])


def _marks(docs: DataFrame, window: int) -> DataFrame:
    """``id, of, start, end`` of words to remove, for texts of ``id, of, text``. Ranges may overlap."""
    seeds = materialize(docs.where(F.octet_length("text") >= 2 * window - 1).mapInArrow(_seeds(window), "id long, of long, pos int, first int, last int, anchor long, zone long"), "seeds")
    shared = materialize(seeds.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "anchors")
    # None of these sides is broadcast: they grow with the documents. Hot anchors are split by adaptive execution.
    found = materialize(seeds.join(shared.hint("merge"), "anchor"), "places")
    discard(seeds)
    # Places with the same words in all their windows are one class; all but those of its smallest id match whole.
    classes = materialize(found.groupBy("anchor", "zone").agg(F.min("id").alias("low")), "classes")
    mixed = materialize(classes.groupBy("anchor").agg(F.min("low").alias("low"), F.max("low").alias("high")).where("low < high").select("anchor", F.lit(True).alias("mixed")), "mixed")
    classes = classes.join(mixed.hint("merge"), "anchor", "left")
    classed = materialize(found.join(classes.hint("merge"), ["anchor", "zone"]).where("id > low or mixed"), "classed")
    whole = classed.where("id > low").select("id", "of", (F.col("pos") - F.col("first")).alias("start"), (F.col("pos") - F.col("last") + window).alias("end"))

    # The others are extended against the first place of their anchor.
    listed = classed.where("id = low").groupBy("id", "of").agg(F.collect_list(F.struct("pos", "first", "last", "anchor")).alias("at"))
    texts = docs.join(listed.hint("merge"), ["id", "of"]).groupBy("id", "of").agg(F.first("text").alias("text"), F.first("at").alias("at"))
    contexts = materialize(texts.select("id", "of", "text", "at").mapInArrow(_contexts(window), "id long, of long, pos int, first int, last int, anchor long, words array<long>"), "contexts")
    head = contexts.groupBy("anchor").agg(F.min(F.struct("id", "of", "pos")).alias("r")).select("anchor", "r.*")
    head = materialize(contexts.join(head.hint("merge"), ["anchor", "id", "of", "pos"]).select("anchor", *[F.col(c).alias(f"r_{c}") for c in ("id", "first", "last", "words")]), "heads")
    pairs = contexts.join(head.hint("merge"), "anchor").select("id", "of", "pos", "first", "last", "anchor", "words", "r_id", "r_first", "r_last", "r_words")
    grown = materialize(pairs.mapInArrow(_extend(window), "id long, of long, start int, end int, anchor long, rest long"), "grown")
    for table in (contexts, head):
        discard(table)
    # Windows that the first place doesn't hold may still be in two of the others.
    rest = grown.where("rest is not null")
    earlier = materialize(rest.groupBy("anchor", "rest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor", "rest", "low"), "earlier")
    later = rest.join(earlier.hint("merge"), ["anchor", "rest"]).where("id > low")
    span = ["id", "of", "start", "end"]
    return whole.unionByName(grown.where("rest is null").select(*span)).unionByName(later.select(*span))


def passage_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Removes each word in a run of ``window`` words that also stands in a document with a smaller id, judged on the input.

    Words are split at ASCII spaces and compared as they are, by 64-bit hashes. Every window selects the smallest hash of
    ``GRAM`` words in it as its anchor, so equal windows have the same one. Anchors of one document only go; the others are joined,
    and matches grown from them both ways: places whose windows all hold the same words match whole those of the smallest id
    (64 bits of anchor and of words each), the rest are compared word by word with the first place of their anchor, and windows that this
    one doesn't hold among each other, by hash. So no pairs are made within an anchor: a place meets one other.
    Matches of at least ``window`` words count, and overlapping ones make up the maximal repeat.

    An anchor, passage or text in a third of all documents is one row per task and set of surrounding words where they are compared; where
    places meet it, the join is between written tables and split by adaptive execution. A long text is cut into pieces of ``PIECE`` words that overlap by a window.
    Ids must be whole numbers; null ones count as the smallest and as one document. Null and empty texts and those of fewer words
    stay whole. Repeats within a document or between rows of one id stay; rows that repeat id and text get the same result;
    an empty table gives no rows.

    Returns the columns of ``docs``, whatever their names, but ``n_words``, ``n_removed``, ``starts`` and ``ends``, which are replaced, and the text, which becomes the kept
    words joined by one space; ``[starts, ends)`` are the maximal runs of removed words.
    """
    added = ("n_words", "n_removed", "starts", "ends")
    docs = docs.drop(*[c for c in added if c in docs.columns and c not in (id_col, text_col)])
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    id_, of = F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    marks = _marks(docs.select(id_.alias("id"), of.alias("of"), text.cast("binary").alias("text")), window)

    id_name, of_name, at = unused(docs.columns, "id", "of", "at")
    spans = marks.groupBy(F.col("id").alias(id_name), F.col("of").alias(of_name)).agg(F.collect_set(F.struct("start", "end")).alias(at))
    spans = materialize(spans, "spans")
    quoted = lambda c: F.col(f"`{c}`")
    others = [c for c in docs.columns if c != text_col]
    both = docs.withColumns({id_name: id_, of_name: of}).join(spans.hint("merge"), [id_name, of_name], "left")
    both = both.select(F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias(id_name), quoted(at), *[quoted(c).alias(f"_{i}") for i, c in enumerate(others)])
    kinds = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)]
    done = both.mapInArrow(_removed, ", ".join([*kinds, "kept string", "n_words long", "n_removed long", "starts array<int>", "ends array<int>"]))
    named: list[Column] = [F.col("kept").alias(c) if c == text_col else F.col(f"_{others.index(c)}").alias(c) for c in docs.columns]
    return done.select(*named, *added)
