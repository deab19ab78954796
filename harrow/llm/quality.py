"""Quality classifier: random-indexing word vectors pooled per document, and a small numpy network.

Random indexing (Kanerva, Sahlgren): every unit (word or word form, hashed to a bounded table) has a sparse ternary
index vector, made from its number alone; a unit's context vector is the sum of the index vectors of the units next to
it over the training texts.  A document is the mean of the index and context vectors of its units.  A network with one
hidden layer learns the label from these, and a temperature fitted on a held-back part calibrates its probabilities.

The model is fitted on the driver on at most ``max_train`` labelled rows (those with the smallest hash of doc_id), each
whole; its size depends on the table's size only.  Scoring reads every text in full.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

TABLE = 1 << 14
DIMS = 64
NONZERO = 6
#: The unit of a word that follows itself.
AGAIN = b"\x00="
HIDDEN = 32
MAX_TRAIN = 4000
#: Bytes of text that the training rows may bring to the driver; the last by hash of doc_id are left out.
MAX_TRAIN_BYTES = 48 << 20


def index_vectors(table: int = TABLE, dims: int = DIMS, nonzero: int = NONZERO, seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors, the same everywhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((table, dims), dtype=np.float32)
    for i in range(nonzero):
        out[np.arange(table), rng.integers(0, dims, table)] += 1.0 if i % 2 else -1.0
    return out


def word_form(word: bytes) -> bytes:
    """Shape of a word: its classes of characters, runs shortened; the rest of a word's identity is in its own unit."""
    if word.isalpha() and word.islower():
        return b"\x00a"
    out, last, run = bytearray(b"\x00"), 0, 0
    for c in word[:24] + word[-8:] if len(word) > 32 else word:
        kind = 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        run = run + 1 if kind == last else 0
        last = kind
        if run < 2:
            out.append(kind)
    return bytes(out)


class Units:
    """Numbers of a word's units: the word itself and its form; a bounded memo."""

    def __init__(self, table: int = TABLE, memo: int = 400_000):
        self.table, self.most, self.memo = table, memo, {}

    def of(self, word: bytes) -> tuple[int, int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            got = self.memo[word] = (zlib.crc32(word) % self.table, zlib.crc32(word_form(word)) % self.table)
        return got


def counted(text: str, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Units of a text and how often each occurs, as flat arrays with repeats by distinct word."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    counts = Counter(words)
    if again := sum(map(eq, words, words[1:])):
        counts[AGAIN] = again
    of = units.of
    ids = np.array([of(w) for w in counts], dtype=np.int64).ravel()
    return ids, np.repeat(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)), 2)


def pooled(text: str, units: Units, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of a text's units, and its length on a log scale."""
    ids, n = counted(text, units)
    out = np.zeros(vectors.shape[1] + 1, dtype=np.float32)
    if len(ids):
        for at in range(0, len(ids), 1 << 16):
            out[:-1] += n[at : at + (1 << 16)] @ vectors[ids[at : at + (1 << 16)]]
        out[:-1] /= n.sum()
        out[-1] = np.log1p(n.sum()) / 10
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(texts: list[str], labels: list[int], *, epochs: int = 60, seed: int = 3) -> Model:
    """Context vectors, network and temperature from labelled texts; without both labels, a constant score."""
    index, units = index_vectors(), Units()
    context = np.zeros_like(index)
    seen = np.zeros(len(index), dtype=np.float32)
    for text in texts:
        words = text.encode().split()
        of = [units.of(w) for w in words]
        ids = np.array(of, dtype=np.int64).reshape(-1, 2)
        for a, b in ((ids[:-1], ids[1:]), (ids[1:], ids[:-1])):
            for i in range(2):  # the neighbour's form is the context of both units
                np.add.at(context, a[:, i], index[b[:, 1]])
                np.add.at(seen, a[:, i], 1)
    vectors = index + context / np.maximum(seen, 1)[:, None]
    x = np.array([pooled(t, units, vectors) for t in texts], dtype=np.float32).reshape(len(texts), vectors.shape[1] + 1)
    y = np.array(labels, dtype=np.float32)
    d, rng = x.shape[1], np.random.default_rng(seed)
    model = Model(vectors, np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    if len(set(labels)) < 2:
        model.b2 = 0.0 if not labels else 4.0 * (2 * labels[0] - 1)
        return model
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[own])) < 2 or not len(held):
        held = own = order
    model.mean, model.scale = x[own].mean(0), x[own].std(0) + 1e-3
    model.w1 = rng.normal(0, np.sqrt(2 / d), (d, HIDDEN))
    model.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    params = [model.w1, model.b1, model.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(y[own].mean(), 1e-6), 0.5 / max(1 - y[own].mean(), 1e-6))
    z, step = (x - model.mean) / model.scale, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
            h = z[at] @ params[0] + params[1]
            a = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30)))
            g = (p - y[at]) * weight[at] / len(at)
            back = np.outer(g, params[2]) * (h > 0)
            grads = [z[at].T @ back + 1e-3 * params[0], back.sum(0), a.T @ g + 1e-3 * params[2], np.array([g.sum()])]
            step += 1
            for k, (q, gr) in enumerate(zip(params, grads, strict=True)):  # Adam
                first[k] = 0.9 * first[k] + 0.1 * gr
                second[k] = 0.999 * second[k] + 0.001 * gr * gr
                q -= 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, target = model.logits(x[held]), y[held]

    def loss(t: float) -> float:
        s = np.clip(logits / t, -30, 30)
        return float((np.log1p(np.exp(s)) - target * s).mean())

    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[tuple[str, int]]:
    """At most ``max_train`` labelled rows outside the held-out fold, those of the smallest hash of doc_id."""
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    if max_train > 0:
        # A long text brings at most its share, so that what comes to the driver is bounded whatever the texts.
        texts = texts.where(F.octet_length("text") <= max(4096, 64 * MAX_TRAIN_BYTES // max_train))
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_train).collect()
    out, used = [], 0
    for r in rows:
        used += len(r.text.encode())
        if used > MAX_TRAIN_BYTES and out:
            break
        out.append((r.text, int(r.quality)))
    return out


def make(shared):
    units = Units()
    model = shared.value

    def run(cols: dict[str, list]) -> dict[str, list]:
        x = np.array([pooled(t or "", units, model.vectors) for t in cols["text"]], dtype=np.float32)
        p = model.probability(x.reshape(len(cols["text"]), model.vectors.shape[1] + 1))
        return {
            "doc_id": cols["doc_id"],
            "held_out": [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in cols["doc_id"]],
            "score": p.astype(float),
            "predicted": (p >= 0.5).astype("int32"),
            "text_key": cols.get("text_key"),
        }

    return run


def score_documents(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Null text counts as empty and is scored like any other.  Null doc_id gives null held_out.  Labels other than 0 and
    1 are ignored; a document with both labels counts as 1; repeated rows are scored each.  Without usable labels
    every score is 0.5.

    An empty table gives no rows; a very long text is scored whole.
    """
    rows = training_rows(docs, labels, max_train)
    model = fit([t for t, _ in rows], [y for _, y in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by TABLE and DIMS
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return map_columns(docs.select("doc_id", "text"), schema, make, shared)


def make_filter(shared):
    run = make(shared)

    def keep(cols: dict[str, list]) -> dict[str, list]:
        return {"keep": run({"text": cols["text"], "doc_id": [None] * len(cols["text"])})["predicted"]}

    return keep


def filter_documents(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject (score of at least 0.5).

    Null and empty texts are scored like any other, repeated rows go or stay together, an empty table stays empty.
    """
    from pyspark.sql.types import StructField, StructType

    rows = training_rows(docs, labels, max_train)
    model = fit([t for t, _ in rows], [y for _, y in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        from .common import slices

        score = make(shared)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                kept = score({"text": texts, "doc_id": [None] * len(texts)})["predicted"]
                yield part.filter(pa.array(kept == 1))

    return docs.mapInArrow(run, schema)
