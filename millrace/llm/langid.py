"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are all its byte n-grams (2 to 4 bytes of the lower-cased UTF-8, characters of ASCII other than letters
folded to a space), hashed into ``2**bits`` buckets. Each bucket has an embedding; a text is the mean of its n-grams'
embeddings, and a linear layer with softmax gives the languages. Both are trained by stochastic gradient descent in numpy
on a sample of at most ``sample`` labelled texts, drawn by a hash of doc_id and text over all training texts (two thirds in proportion, the rest so that rare
languages have a floor of texts) and sent as bucket counts. A fifth
of the sample is not trained on but calibrates: a temperature that makes scores honest, and the score below
which a prediction is rejected so that the others reach ``precision``.

For prediction, the embeddings times the linear layer are one small table (a row of class scores a bucket, under
1 MB, sent to the executors once), and a text is a sum of its rows; texts are read whole, in runs of a bounded number of n-grams.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows without a label aren't learned from;
with no labelled rows at all, every prediction is ``und``; a null doc_id is not held out and not learned from; ties go to
the first language by code point; repeated rows are predicted alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, hash60, hold

GRAMS = (2, 3, 4)
RUN = 1 << 20
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # 2**bits rows of class scores, and a row of zeros for windows that cross texts
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int


def _windows(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of n-gram buckets with the first place of each text in the run and its row. Bucket 2**bits is none."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(lowered.buffers()[1], np.int64 if pa.types.is_large_string(lowered.type) else np.int32)
    offsets = offsets[lowered.offset : lowered.offset + len(lowered) + 1].astype(np.int64)
    data = lowered.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return
    x = FOLD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    rows = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts, ends = offsets[rows], offsets[rows + 1]
    for n in GRAMS:
        for a in range(0, len(x), RUN):
            b = min(len(x), a + RUN)
            part = np.zeros(b - a + n - 1, np.uint32)
            part[: min(len(x), b + n - 1) - a] = x[a : min(len(x), b + n - 1)]
            h = np.full(b - a, 0x811C9DC5 + n, np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + b - a]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            bucket = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
            lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            crossing = (ends[lo:hi, None] - np.arange(1, n)).ravel() - a
            bucket[crossing[(crossing >= 0) & (crossing < b - a)]] = 1 << bits
            yield bucket, np.maximum(starts[lo:hi] - a, 0), rows[lo:hi]


def bucket_counts(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and how often they occur."""
    out = []
    for k in range(len(texts)):
        total = np.zeros((1 << bits) + 1, np.int64)
        for bucket, _, _ in _windows(texts.slice(k, 1), bits):
            total += np.bincount(bucket, minlength=len(total))
        which = np.flatnonzero(total[:-1])
        out.append((which, total[which]))
    return out


def class_sums(texts: pa.Array, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of class scores and the number of n-grams of each text."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for bucket, first, rows in _windows(texts, bits):
        np.add.at(sums, rows, np.add.reduceat(table[bucket], first, axis=0, dtype=np.float64))
        np.add.at(counts, rows, np.add.reduceat((bucket < (1 << bits)).astype(np.int64), first))
    return sums, counts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], bits: int, dims: int = 8, epochs: int = 6, rate: float = 2.0, batch: int = 32, precision: float = 0.99, seed: int = 5) -> Model:
    """Fit on (buckets, counts, class) rows; every fifth one calibrates."""
    if not languages:
        return Model([], np.zeros(((1 << bits) + 1, 0), np.float32), np.zeros(0), 1.0, 0.0, bits)
    rng = np.random.default_rng(seed)
    fit, held = [r for k, r in enumerate(rows) if k % 5 or len(rows) < 10], [r for k, r in enumerate(rows) if k % 5 == 0]
    e = rng.normal(0, 0.1, (1 << bits, dims))
    w, bias = rng.normal(0, 0.1, (dims, len(languages))), np.zeros(len(languages))
    steps = epochs * -(-len(fit) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), batch):
            some = [fit[k] for k in order[at : at + batch] if len(fit[k][0])]
            if not some:
                continue
            lr = rate * (1 - done / steps)
            done += 1
            sizes = np.array([len(r[0]) for r in some])
            which, share = np.concatenate([r[0] for r in some]), np.concatenate([r[1] / r[1].sum() for r in some])
            row = np.repeat(np.arange(len(some)), sizes)
            hidden = np.add.reduceat(e[which] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            g = _softmax(hidden @ w + bias)
            g[np.arange(len(some)), [r[2] for r in some]] -= 1
            back = g @ w.T
            w -= lr * hidden.T @ g / len(some)
            bias -= 0.1 * lr * g.mean(0)
            # The mean over thousands of n-grams makes an embedding's gradient small: its step is scaled up to match.
            np.subtract.at(e, which, (20 * lr * share)[:, None] * back[row])
    table = np.zeros(((1 << bits) + 1, len(languages)), np.float32)
    table[:-1] = e @ w
    z = np.array([(table[r[0]] * (r[1] / r[1].sum())[:, None]).sum(0) + bias if len(r[0]) else bias for r in held]).reshape(-1, len(languages))
    y = np.array([r[2] for r in held], np.int64)
    temperature, reject = 1.0, 0.0
    if len(held):
        scales = np.geomspace(0.05, 20, 60)
        # Targets as if one more text of each kind had been seen: a faultless sample doesn't make scores certain.
        sure = (len(y) + 1) / (len(y) + 2)
        goal = np.full(z.shape, (1 - sure) / max(len(languages) - 1, 1))
        goal[np.arange(len(y)), y] = sure
        loss = [-(goal * np.log(_softmax(z / t) + 1e-12)).sum(1).mean() for t in scales]
        temperature = float(scales[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        score, right = p.max(1), p.argmax(1) == y
        by = np.argsort(-score)
        good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= precision
        reject = float(score[by[np.flatnonzero(good)[-1]]]) if good.any() else 1.0
    return Model(languages, table, bias, temperature, reject, bits)


def sample_and_train(labelled: DataFrame, sample: int = 2500, bits: int = 14, **options) -> Model:  # noqa: ANN003
    """A model from at most ``sample`` rows of (doc_id, text, lang), drawn by a hash of doc_id and text.

    A language is drawn in proportion to its texts, and as a whole or with ``floor`` of them if that is more.
    """
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    floor = 0.25 * sample / max(totals["kinds"], 1)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.65 * sample / max(totals["n"] or 0, 1)), F.lit(floor) / F.col("n")))
    wanted = sizes.select(F.col("lang").alias("l"), (share * (1 << 60)).cast("long").alias("below"))
    if totals["kinds"] <= 10_000:  # one row a language; a common language would else be one task
        wanted = F.broadcast(wanted)
    placed = labelled.withColumn("h", hash60(F.col("doc_id"), F.xxhash64("text"), seed=5))
    drawn = placed.join(wanted, (F.col("lang") == F.col("l")) & (F.col("h") < F.col("below"))).select("text", "lang", "h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = bucket_counts(b.column(0), bits)
            columns = [pa.array([f.astype("<u4").tobytes() for f in x], pa.binary()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([*columns, b.column(1), b.column(2)], ["which", "counts", "lang", "h"])

    rows = drawn.mapInArrow(count, "which binary, counts binary, lang string, h long").orderBy("h").limit(sample).collect()  # bounded by ``sample``
    rows.sort(key=lambda r: (r["h"], r["lang"], bytes(r["which"])))
    languages = sorted({r["lang"] for r in rows})
    place = {lang: k for k, lang in enumerate(languages)}
    return train([(np.frombuffer(r["which"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float64), place[r["lang"]]) for r in rows], languages, bits, **options)


def predict(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score and rejected for every row, with the columns of ``carry``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of class scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        m = sent.value
        for b in batches:
            letters = np.array([any(map(str.isalpha, t)) if t else False for t in b.column(0).to_pylist()], bool)
            if not m.languages or not b.num_rows:
                best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                letters[:] = False
            else:
                sums, counts = class_sums(b.column(0), m.table, m.bits)
                p = _softmax((sums / np.maximum(counts, 1)[:, None] + m.bias) / m.temperature)
                best, score = p.argmax(1), np.where(letters, p.max(1), 0.0)
            names = pa.array([m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(score), pa.array(~letters | (score < m.reject_below)), *b.columns[1:]], ["lang_pred", "score", "rejected", *carry])

    own = docs.select(F.col(text).cast("string").alias("_text"), *carry)
    types = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"lang_pred string, score double, rejected boolean{types}")


def identify(docs: DataFrame, folds: int = 5, **options) -> DataFrame:  # noqa: ANN003
    """doc_id, held_out, lang_pred, score and rejected; learned from the rows that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    bound_batches(docs)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    learn = own.filter(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = sample_and_train(learn.select("doc_id", "text", "lang"), **options)
    return predict(own, model, carry=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
