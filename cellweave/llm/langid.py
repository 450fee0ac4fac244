"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of 1 to 4 bytes.
FEATURES = 1 << 13
ORDERS = (1, 2, 3, 4)
#: Training rows per language, at most, and bits of a codeword beyond the exhaustive codes of up to 5 languages.
SAMPLE_PER_LANGUAGE, CODE_BITS = 600, 63
CHUNK_BYTES = 1 << 20


def codewords(languages: int, bits: int = CODE_BITS, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each language: the exhaustive code for up to 5, else random columns chosen for distance."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        n = 2 ** (languages - 1) - 1
        rows = [np.ones(n, np.int8)]
        for i in range(1, languages):
            run = 2 ** (languages - 1 - i)
            rows.append(np.where(np.arange(n) // run % 2 == 0, -1, 1).astype(np.int8))
        return np.stack(rows)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, max(bits, languages)))
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(languages, dtype=int) * code.shape[1]
        mixed = (np.abs(code.sum(axis=0)) < languages).all()
        if mixed and apart.min() > most:
            best, most = code, apart.min()
    return best


def _features(text: bytes) -> np.ndarray:
    """Hashed n-grams of one piece of text, spaces around it."""
    b = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(b):
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            m = h * np.uint32(0x9E3779B1)
            out.append((m ^ (m >> np.uint32(15))) & np.uint32(FEATURES - 1))
    return np.concatenate(out)


def counts(text: str) -> np.ndarray:
    """The share of each n-gram in the whole text, read in chunks, as the square root, which evens out frequent ones."""
    raw, got = text.lower().encode(), np.zeros(FEATURES)
    for at in range(0, max(len(raw), 1), CHUNK_BYTES):
        # chunks overlap by what an n-gram needs
        got += np.bincount(_features(raw[at : at + CHUNK_BYTES + max(ORDERS) - 1]), minlength=FEATURES)
    return np.sqrt(got / got.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    bit_weight: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score from 0 to 1, and whether a second language is nearly as close."""
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.bit_weight).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return best, score, score < 0.75


def train(x: np.ndarray, y: np.ndarray, languages: Sequence[str], *, steps: int = 300, rate: float = 20.0, ridge: float = 1e-5) -> Model:
    """One logistic classifier per bit, all at once by gradient steps with momentum; a bit weighs as much as it is right."""
    code = codewords(len(languages))
    want = code[y].astype(np.float32)
    share = 1 / np.bincount(y, minlength=len(languages))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]  # languages count alike, however rare
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        slope = -want * share / (1 + np.exp(np.clip(want * (x @ w + b), -60, 60)))
        vw = 0.9 * vw - rate * (x.T @ slope + ridge * w)
        vb = 0.9 * vb - 0.1 * rate * slope.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((want * (x @ w + b) > 0) * share).sum(axis=0)
    return Model(list(languages), code, w, b, np.maximum(2 * right - 1, 0.05))


def held_out_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text is divisible by ``folds``; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Trains on rows outside the held-out fold and predicts the language of every row from its whole text.

    Each language has a codeword, each bit of it a binary n-gram classifier; a text gets the language whose codeword has
    the least weighted logistic loss against the bits' margins, the first one by code point if several have. The score is that language's share after a softmax over
    the losses; ``ambiguous`` marks scores under 0.75. Training uses a bounded sample: for each
    language about ``sample_per_language`` rows with letters (twice that at most), chosen by a hash of the id, with their
    n-gram shares computed by the tasks. The model, whose size depends on the number of languages only, travels to
    the tasks; prediction is one narrow pass.

    Null texts and texts without a letter get ``und`` with score 0, and so does every row if nothing can be learned; with
    a single language that one is given, score 1. Null ids are not held out and not learned from. Repeated rows
    get equal results, an empty table no rows. Other columns are ignored.

    Returns ``doc_id, held_out, lang_pred, score, ambiguous``.
    """
    spark = docs.sparkSession
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), docs[f"`{lang_col}`"].alias("lang"), held_out_fold(docs[f"`{id_col}`"]).alias("held_out"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    usable = base.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & letters)
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = None
    if totals:
        model = _fit(spark, usable, totals, sample_per_language)
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                pred, score, unsure = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                rows = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)) if m else np.zeros(0, int)
                if len(rows):
                    best, s, u = m.predict(np.stack([counts(batch.column(2)[int(i)].as_py()) for i in rows]))
                    score[rows], unsure[rows] = s, u
                    for i, k in zip(rows, best, strict=True):
                        pred[i] = m.languages[k]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return base.select("doc_id", "held_out", "text", letters.alias("letters")).mapInArrow(predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def _fit(spark, usable: DataFrame, totals: dict[str, int], per_language: int) -> Model:
    languages = sorted(totals)
    # A row is taken if a hash of its id falls under its language's share, so no language is sorted or gathered.
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_language / totals[k]))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / F.lit(float(2**53))
    taken = usable.where(unit < F.element_at(share, F.col("lang")))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [counts(t.as_py()).astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["lang", "place", "x"])

    # In an order that doesn't depend on which task ends first: reruns learn the same.
    rows = taken.select("lang", F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(shares, "lang string, place long, x binary").orderBy("place", "lang", "x").limit(2 * per_language * len(languages)).toArrow()
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in rows["x"]]).astype(np.float32)
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[v.as_py()] for v in rows["lang"]])
    have = sorted(set(y.tolist()))  # a language may have got no row of a small sample
    return train(x, np.searchsorted(have, y), [languages[i] for i in have])
