"""Quality classification by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed words and word shapes of the text view, and hashed fields of the metadata view.
TEXT_BUCKETS, META_BUCKETS = 1024, 256
#: Labelled rows to learn from, and unlabelled ones to exchange pseudo-labels on, at most.
LABELLED_ROWS, POOL_ROWS = 6000, 4000
#: Every so many-th labelled row calibrates the views instead of training them.
CALIBRATE = 4
ROUNDS, CONFIDENT = 3, 0.98
#: Bounds what is tokenised at once; texts are read whole, chunk by chunk.
CHUNK = 1 << 20


def _shape(word: str) -> str:
    """Capitals, letters, digits and marks of a word, runs as one character."""
    upper, lower = word.isupper(), word.islower()
    inner = "A" if upper and len(word) > 1 else "a" if lower or word.istitle() else "x"
    tail = word[-1] if not word[-1].isalnum() else ""
    return f"{inner}{tail}{sum(not c.isalnum() for c in word)}{'0' if any(c.isdigit() for c in word) else ''}"


def text_view(text: str | None) -> np.ndarray:
    """Shares of hashed words and shapes in the whole text, then a few figures of repetition and composition."""
    out = np.zeros(TEXT_BUCKETS + 8, np.float32)
    if not text:
        return out
    half, words, seen, shapes, marks = TEXT_BUCKETS // 2, 0, {}, {}, 0
    for at in range(0, len(text), CHUNK):
        for w in text[at : at + CHUNK].split():
            seen[w] = seen.get(w, 0) + 1
    for w, n in seen.items():
        words += n
        out[zlib.crc32(w.lower().encode()) % half] += n
        s = _shape(w)
        shapes[s] = shapes.get(s, 0) + n
        if not w[0].isalnum() and not w[-1].isalnum():
            marks += n
    if not words:
        return out
    for s, n in shapes.items():
        out[half + zlib.crc32(s.encode()) % half] += n
    out[:TEXT_BUCKETS] = np.sqrt(out[:TEXT_BUCKETS] / words)
    log = np.log1p(words)
    out[TEXT_BUCKETS:] = (
        np.log1p(len(seen)) / log,  # how varied the words are
        max(seen.values()) / words,
        marks / words,
        sum(map(str.isupper, text)) / len(text),
        sum(n for s, n in shapes.items() if s[0] == "A") / words,
        min(len(text) / words / 20, 2.0),
        text.count("\n") / words,
        log / 10,
    )
    return out


def meta_view(fields: list[object]) -> np.ndarray:
    """Hashed fields: strings by value, numbers by the size of their logarithm, each with its name's place, and nulls."""
    out = np.zeros(META_BUCKETS, np.float32)
    for k, v in enumerate(fields):
        said = "null" if v is None else f"log{int(2 * np.log1p(abs(v)))}" if isinstance(v, (int, float)) else str(v)
        out[zlib.crc32(f"{k}={said}".encode()) % META_BUCKETS] += 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, steps: int = 250, rate: float = 1.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias, by gradient steps with momentum; both classes count alike."""
    share = weight * np.where(y > 0, 0.5 / max(weight[y > 0].sum(), 1e-9), 0.5 / max(weight[y <= 0].sum(), 1e-9))
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norm = 4 / max((x1**2).sum(axis=1).mean(), 1e-9)
    w, v = np.zeros(x1.shape[1], np.float32), np.zeros(x1.shape[1], np.float32)
    for _ in range(steps):
        slope = x1.T @ (share * (1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30))) - y)) + ridge * w
        v = 0.9 * v - rate * norm * slope
        w = w + v
    return w


def _logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    """Weights of both views and of their calibrated combination; ``share`` answers alone if there was one class only."""

    share: float
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    scale: np.ndarray | None = None
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def score(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the text view, the metadata view and both."""
        if self.text is None:
            p = np.full(len(x), self.share)
            return p, p, p
        a, b = _logit(self.text, x), _logit(self.meta, z)
        (a1, a0), (b1, b0), (c1, c2, c0) = self.scale
        return _sigmoid(a1 * a + a0), _sigmoid(b1 * b + b0), _sigmoid(c1 * a + c2 * b + c0)


def _platt(columns: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression on a few logits by Newton steps, with weak pull to 0 and softened labels."""
    m = np.hstack([columns, np.ones((len(columns), 1))])
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t, w = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.zeros(m.shape[1])
    for _ in range(steps):
        p = _sigmoid(m @ w)
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, m.T @ (p - t) + 1e-3 * w)
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
    return w


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """``y`` is 1, 0 or, where unlabelled, -1. Each round a view labels what it is sure of for the other view."""
    known = np.flatnonzero(y >= 0)
    if len(known) == 0:
        return CoTrained(0.5)
    if len(set(y[known])) == 1:
        return CoTrained(float(y[known][0]))
    kept = np.concatenate([np.flatnonzero(y == c)[CALIBRATE - 1 :: CALIBRATE] for c in (0, 1)])
    if min((y[kept] == c).sum() for c in (0, 1)) < 2:
        kept = known  # too few labels to set any aside
    train = np.setdiff1d(known, kept) if len(kept) < len(known) else known
    pool = np.flatnonzero(y < 0)
    model, given = CoTrained(float(y[known].mean())), {"text": {}, "meta": {}}
    for r in range(rounds + 1):
        for view, m in (("text", x), ("meta", z)):
            rows = np.array([*train, *given[view]], int)
            labels = np.concatenate([y[train], np.array([*given[view].values()], float)])
            weight = np.concatenate([np.ones(len(train)), np.full(len(given[view]), 0.5)]).astype(np.float32)
            setattr(model, view, fit_logistic(m[rows], labels.astype(np.float32), weight))
        ka, kb = _logit(model.text, x[kept]), _logit(model.meta, z[kept])
        model.scale = np.array([_platt(ka[:, None], y[kept]), _platt(kb[:, None], y[kept]), _platt(np.stack([ka, kb], axis=1), y[kept])], dtype=object)
        if r == rounds or not len(pool):
            break
        a, b, _ = model.score(x[pool], z[pool])
        for other, p in (("meta", a), ("text", b)):
            sure = (p >= confident) | (p <= 1 - confident)
            given[other] = dict(zip(pool[sure].tolist(), (p[sure] > 0.5).astype(float), strict=True))
        model.exchanged.append((len(given["meta"]), len(given["text"])))
    return model


def views(texts: list[str | None], fields: list[list[object]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts, and of the metadata fields of each."""
    return np.stack([text_view(t) for t in texts]), np.stack([meta_view(f) for f in fields])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: Sequence[str] = (), labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained:
    """The model of ``quality_classifier``, learned from two bounded samples; the same rows in any order give the same one."""
    docs = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), *[docs[f"`{c}`"].alias(f"m{k}") for k, c in enumerate(meta_cols)])
    of, label = labels[f"`{id_col}`"], labels[f"`{label_col}`"]
    known = labels.where(of.isNotNull() & label.isNotNull()).select(of.alias("id"), label.alias("label")).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("y"))
    ids = docs.select("id").where("id IS NOT NULL")
    n_known, n_ids = known.count(), ids.count()
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) / F.lit(float(2**53))
    # Shares of the two samples; a little under the bound, so that the limits hardly ever cut.
    take = lambda df, n, most: df.withColumn("place", place).where(F.col("place") < F.lit(min(1.0, 0.9 * most / max(n, 1)))).orderBy("place", "id").limit(most).select("id", "y")
    pool = ids.join(known, "id", "left_anti").distinct().withColumn("y", F.lit(-1))
    sample = take(known, n_known, labelled_rows).unionByName(take(pool, n_ids - n_known, pool_rows)).dropDuplicates(["id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                if not batch.num_rows:
                    continue
                fields = [list(row) for row in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)] or [[]] * batch.num_rows
                x, z = (v.astype(np.float16) for v in views(batch.column(2).to_pylist(), fields))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, z))], ["y", "place", "x", "z"])

    meta = [f"m{k}" for k in range(len(meta_cols))]
    chosen = docs.join(F.broadcast(sample), "id").select("y", F.xxhash64("id", "text", F.lit(5)).alias("place"), "text", *meta)
    rows = chosen.mapInArrow(features, "y int, place long, x binary, z binary").orderBy("place", "x", "z").limit(2 * (labelled_rows + pool_rows)).toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    if not len(y):
        return CoTrained(0.5)
    return co_train(*(np.stack([np.frombuffer(v.as_py(), np.float16) for v in rows[c]]).astype(np.float32) for c in ("x", "z")), y)


def quality_classifier(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS
) -> DataFrame:
    """Scores each document's quality from 0 to 1 with two co-trained views.

    One logistic classifier sees the text (hashed words, word shapes, repetition), another the page's metadata
    (``meta_cols`` as far as they exist). Over ``ROUNDS`` rounds each labels the unlabelled rows that it is sure of
    (calibrated probability beyond ``CONFIDENT``) for the other to learn from. Labelled rows set aside calibrate both views and weigh their
    combination. Fitting uses bounded samples: at most ``labelled_rows`` labelled rows and ``pool_rows`` unlabelled ones,
    chosen by a hash of the id, as feature vectors that the tasks compute. Scoring covers all rows and whole texts in one
    narrow pass; only the weights, of fixed size, travel.

    Ids with several labels count by their mean, 0.5 as 1; null labels and labels of unknown ids are ignored. Null and
    empty texts have no text features and are judged by what that and the metadata say. Without labels all scores are 0.5, with
    labels of one class that class. Null ids are scored, not learned from; repeated rows get equal scores; an empty table
    gives no rows. Columns of ``docs`` named like a score are replaced.

    Returns the columns of ``docs`` and ``quality_text, quality_meta, quality_score, quality_keep`` (score of 0.5 or more).
    """
    meta = [c for c in meta_cols if c in docs.columns]
    added = ["quality_text", "quality_meta", "quality_score", "quality_keep"]
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in added])
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, meta_cols=meta, labelled_rows=labelled_rows, pool_rows=pool_rows))

    kinds = docs.schema
    # Columns go through the tasks by place, under names that need no quotes.
    plain = [f"c{k}" for k in range(len(kinds.fields))]
    out_schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, kinds.fields, strict=True)) + ", quality_text double, quality_meta double, quality_score double, quality_keep boolean"
    at_text, at_meta = docs.columns.index(text_col), [docs.columns.index(c) for c in meta]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                if not batch.num_rows:
                    continue
                fields = [list(row) for row in zip(*(batch.column(i).to_pylist() for i in at_meta), strict=True)] or [[]] * batch.num_rows
                a, b, c = model.value.score(*views(batch.column(at_text).to_pylist(), fields))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(c, pa.float64()), pa.array(c >= 0.5)], [*batch.schema.names, *added])

    return docs.toDF(*plain).mapInArrow(score, out_schema).toDF(*docs.columns, *added)
