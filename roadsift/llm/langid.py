"""Language identification by a byte-level convolutional network trained in numpy.

Texts are cut into windows of ``WINDOW`` bytes.  A window's bytes are embedded; filters of
several widths slide over them, rectified and max-pooled over the window; a softmax layer
gives one probability per language.  A text's probabilities are the mean of its windows'
logarithms, normalised again.

Training uses windows of a bounded sample of labelled rows: about ``sample`` rows a
language, chosen by a hash of id and text, of each at most ``longest`` windows (so the
expected size is bounded whatever the corpus, its ids and its longest text), trained with
Adam on the driver.  The training rows are given by a condition of the caller; a
prediction sees the text alone.

Scale: prediction is one Arrow pass without shuffle; whole texts are read, in groups of
windows of bounded size.  Since an embedded byte times a filter is a table look-up, a
filter of width w costs w look-ups a position.

Edge cases: null texts, and texts without any letter, are ``und`` with score 0; labels
that are null are not learned from; if no labelled row exists, every text is ``und``;
repeated rows are predicted once each and learned from once; an empty table gives an
empty result, columns named as those of the result are not carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_field, others, quoted, slices

RESULT = ("lang_pred", "score")
UNKNOWN = "und"
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16


@dataclass
class ByteCnn:
    """Weights: ``embed`` 256 x E; per width a filter bank (w*E) x F and bias; ``out`` (widths*F) x languages and bias."""

    langs: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> ByteCnn:
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            langs, f32(256, EMBED, scale=0.5), [f32(w * EMBED, FILTERS, scale=1 / np.sqrt(w * EMBED)) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            f32(len(WIDTHS) * FILTERS, len(langs), scale=0.1), np.zeros(len(langs), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.banks, *self.biases, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place in the filter: what each byte adds to the responses."""
        return [[np.ascontiguousarray(self.embed @ bank[k * EMBED : (k + 1) * EMBED]) for k in range(w)] for w, bank in zip(WIDTHS, self.banks, strict=True)]

    def log_probs(self, windows: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """windows: n x WINDOW bytes."""
        tables = tables or self.tables()
        pooled = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        flat = windows.astype(np.intp)
        for a in range(0, len(windows), 64):  # stays in the cache
            part = flat[a : a + 64]
            for i, w in enumerate(WIDTHS):
                n = part.shape[1] - w + 1
                total = tables[i][0].take(part[:, :n], axis=0)
                for k in range(1, w):
                    total += tables[i][k].take(part[:, k : k + n], axis=0)
                pooled[a : a + 64, i * FILTERS : (i + 1) * FILTERS] = np.maximum(total.max(axis=1) + self.biases[i], 0)
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(body: bytes) -> np.ndarray:
    """The whole text (ASCII letters in lower case) as consecutive windows; the last one is padded with spaces, or ends with the text when there is more than one."""
    n, body = len(body), body.lower()
    if n <= WINDOW:
        return np.frombuffer(body.ljust(WINDOW), np.uint8).reshape(1, WINDOW)
    data = np.frombuffer(body, np.uint8)
    full = data[: n // WINDOW * WINDOW].reshape(-1, WINDOW)
    return full if n % WINDOW == 0 else np.concatenate([full, data[-WINDOW:].reshape(1, WINDOW)])


def train(texts: list[bytes], labels: list[str], windows: int = 1600, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteCnn | None:
    """A network fitted to at most ``windows`` windows a language, taken from all over the texts."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for k, lang in enumerate(langs):
        own = np.concatenate([windows_of(t) for t, label in zip(texts, labels, strict=True) if label == lang])
        own = own[rng.permutation(len(own))[:windows]].copy()
        short = rng.random(len(own)) < 0.3  # short texts are mostly padding: learn from such windows too
        for i in np.flatnonzero(short):
            own[i, rng.integers(8, WINDOW) :] = 32
        xs.append(own)
        ys.append(np.full(len(own), k))
    x, y = np.concatenate(xs), np.concatenate(ys)
    net = ByteCnn.fresh(langs, rng)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            at = order[a : a + batch]
            step += 1
            for w, g, (m, v) in zip(net.weights(), _gradients(net, x[at], y[at]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate / (1 + step / 400) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: ByteCnn, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, length = x.shape
    e = net.embed[x]  # n x L x E
    pooled, where = [], []
    for w, bank, bias in zip(WIDTHS, net.banks, net.biases, strict=True):
        stacked = np.concatenate([e[:, k : length - w + 1 + k] for k in range(w)], axis=2)
        response = stacked @ bank + bias
        best = response.argmax(axis=1)  # n x F
        top = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
        pooled.append(np.maximum(top, 0))
        where.append((best, top > 0))
    h = np.concatenate(pooled, axis=1)
    z = h @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    d_out, d_bias, dh = h.T @ p, p.sum(axis=0), p @ net.out.T
    d_embed, d_banks, d_biases = np.zeros_like(net.embed), [], []
    for i, w in enumerate(WIDTHS):
        best, alive = where[i]
        g = dh[:, i * FILTERS : (i + 1) * FILTERS] * alive  # n x F
        d_bank = np.empty_like(net.banks[i])
        for k in range(w):
            bytes_ = x[np.arange(n)[:, None], best + k]  # the byte under place k of each winning filter
            d_bank[k * EMBED : (k + 1) * EMBED] = np.einsum("nfe,nf->ef", net.embed[bytes_], g)
            np.add.at(d_embed, bytes_.ravel(), (g[:, :, None] * net.banks[i][k * EMBED : (k + 1) * EMBED].T[None]).reshape(-1, EMBED))
        d_banks.append(d_bank)
        d_biases.append(g.sum(axis=0))
    return [d_embed, *d_banks, *d_biases, d_out, d_bias]


def has_letter(body: bytes) -> bool:
    if body.lower() != body.upper():
        return True
    return not body.isascii() and any(c.isalpha() for c in body.decode("utf-8", "replace"))


def predict_texts(net: ByteCnn | None, tables: list[list[np.ndarray]] | None, bodies: list[bytes | None], group: int = 4096) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(bodies), [0.0] * len(bodies)
    if net is None:
        return names, scores
    readable = [k for k, b in enumerate(bodies) if b and has_letter(b)]
    sums = np.zeros((len(bodies), len(net.langs)))
    counts = np.zeros(len(bodies))
    queue: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        owner = np.concatenate(owners)
        np.add.at(sums, owner, net.log_probs(np.concatenate(queue), tables))
        np.add.at(counts, owner, 1)
        queue.clear()
        owners.clear()
        held = 0

    for k in readable:
        windows = windows_of(bodies[k])
        for a in range(0, len(windows), group):
            part = windows[a : a + group]
            queue.append(part)
            owners.append(np.full(len(part), k))
            held += len(part)
            if held >= group:
                flush()
    if queue:
        flush()
    for k in readable:
        z = sums[k] / counts[k]
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        names[k], scores[k] = net.langs[best], float(p[best] / p.sum())
    return names, scores


def _cut(body: Column, most: int) -> Column:
    """A text as it is, or ``most`` of its windows, evenly spaced, where it is longer."""
    n = F.floor(F.octet_length(body) / WINDOW)
    piece = lambda i: F.substring(body, (F.floor(i * n / most) * WINDOW + 1).cast("int"), F.lit(WINDOW))
    spaced = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(b"").cast("binary"), lambda joined, i: F.concat(joined, piece(i)))
    return F.when(n > most, spaced).otherwise(body)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 400, longest: int = 256, **options) -> ByteCnn | None:  # type: ignore[no-untyped-def]
    """A network from about ``sample`` rows a language among those that meet ``learn`` and have text and language.

    A row is told by a hash of its id and text, so null or repeated ids leave the sample as
    large as it is; rows equal in both count once.  A text sends at most ``longest`` windows
    to the driver."""
    body = quoted(text).cast("string")
    rows = docs.filter(learn & quoted(lang).isNotNull() & quoted(text).isNotNull()).select(F.xxhash64(F.lit(11), quoted(doc_id), body).alias("row"), body.cast("binary").alias("body"), quoted(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("row", 0.02).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, sample / max(n, 1)))])
    place = F.pmod(F.col("row"), F.lit(1 << 20)) / float(1 << 20)
    found = rows.filter(place < share[F.col("lang")]).groupBy("lang", "row").agg(F.any_value(_cut(F.col("body"), longest)).alias("body")).collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["body"])))
    return train([bytes(r["body"]) for r in found], [r["lang"] for r in found], **options)


def predict(docs: DataFrame, net: ByteCnn | None, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``doc_id`` and ``carry`` of all rows with ``lang_pred`` and ``score``."""
    kept = [doc_id, *[c for c in (carry or []) if c in others(docs, (*RESULT, doc_id))]]
    rows = docs.select(*[quoted(c).alias(f"__c{k}") for k, c in enumerate(kept)], quoted(text).cast("string").cast("binary").alias("__body"))
    types = [ids_field(rows, f"__c{k}") for k in range(len(kept))]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in slices(batches, "__body", 2000, 8 << 20):
            names, scores = predict_texts(net, tables, batch.column("__body").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(t) for k, t in enumerate(types)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(label, schema)
