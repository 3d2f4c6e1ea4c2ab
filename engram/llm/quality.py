"""Quality classifier: a byte-level convolutional network in numpy.

Each byte is a vector of its kind (upper case, digit, ...) and a few random
components.  Learned filters of 8 bytes slide over the whole text in steps of
4; their activations are max-pooled over overlapping chunks of 128 bytes, and
the chunks' maxima are combined, as mean and maximum over all chunks, into one
probability.  Filters and combination are learned together by gradient
descent on the whole texts of a bounded sample of labelled rows (``sample``
rows and ``sample_bytes`` characters of text at most); scoring reads whole
texts in slices.

Scores depend on the text alone.  A null text counts as empty; empty texts
get the network's score for nothing but padding.  Repeated rows score alike,
and count once in the fit; of an id that stands on several texts each text
counts.  The sample is drawn by a hash of id and text, so reruns agree.
Labels of rows whose crc32(id as text) mod 5 is 0, and of null ids, are never
read; a repeated label counts as its largest value.  Without any label of both
kinds every score is 0.5.  Other columns are ignored, whatever their names.
An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from engram.llm._common import prepare
from engram.llm._text import buffers

#: Labelled rows, and characters of their texts in all, that the network is fitted on at most.
SAMPLE, SAMPLE_BYTES = 2000, 24_000_000
WIDTH, STEP, HALF, FILTERS = 12, 4, 64, 24
EPOCHS, BATCH, RATE, SEED = 10, 48, 0.01, 5
THRESHOLD = 0.3
SLICE = 1 << 20


def _byte_vectors() -> np.ndarray:
    b = np.arange(256)
    kinds = [(b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), b == 32, b == 10, (b > 32) & (b < 127) & ~np.char.isalnum(np.array([chr(c) for c in b])), b >= 128]
    drawn = np.random.Generator(np.random.PCG64(SEED)).normal(0, 0.7, (256, WIDTH - len(kinds)))
    out = np.concatenate([np.stack(kinds, axis=1), drawn], axis=1).astype(np.float32)
    out[0] = 0  # padding
    return out


BYTES = _byte_vectors()


def start_network() -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    return {
        "w": rng.normal(0, 0.25, (2 * STEP * WIDTH, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32),
        "mean": np.zeros(FILTERS, np.float32), "top": np.zeros(FILTERS, np.float32), "c": np.zeros(1, np.float32),
    }


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole halves, two at least; offsets in halves."""
    halves = np.maximum(2, -(-np.diff(at) // HALF))
    to = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(to[-1]) * HALF, np.uint8)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        out[to[i] * HALF : to[i] * HALF + b - a] = data[a:b]
    return out, to


def _steps(data: np.ndarray) -> np.ndarray:
    return BYTES[data].reshape(-1, STEP * WIDTH)


def _activations(net: dict, steps: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Filters over each two neighbouring steps; the last of a text sees padding."""
    k = STEP * WIDTH
    out = steps @ net["w"][:k]
    right = steps @ net["w"][k:]
    right[:-1] = right[1:]
    right[to[1:] * (HALF // STEP) - 1] = 0
    return out + right + net["b"]


def half_maxima(net: dict, data: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Max of each filter in each half chunk, for all texts, in slices."""
    out = np.empty((len(data) // HALF, FILTERS), np.float32)
    ends = set((to[1:] * HALF).tolist())
    for s in range(0, len(data), SLICE):
        e = min(len(data), s + SLICE)
        look = STEP if e < len(data) and e not in ends else 0
        inner = to[(to * HALF > s) & (to * HALF <= e)] - s // HALF
        steps = _steps(data[s : e + look])
        a = _activations(net, steps, np.concatenate([[0], inner]))
        out[s // HALF : e // HALF] = a[: (e - s) // STEP].reshape(-1, HALF // STEP, FILTERS).max(axis=1)
    return np.maximum(out, 0)


def _pooled(halves: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, max, chunk maxima, first chunk of each text): chunks are pairs of neighbouring halves."""
    chunks = np.maximum(halves[:-1], halves[1:])
    chunks = np.delete(chunks, to[1:-1] - 1, axis=0)  # no chunk spans two texts
    first = to[:-1] - np.arange(len(to) - 1)
    count = np.diff(to) - 1
    return np.add.reduceat(chunks, first) / count[:, None], np.maximum.reduceat(chunks, first), chunks, first


def scores(net: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    if len(at) < 2:
        return np.zeros(0)
    whole, to = padded(data, at)
    mean, top, _, _ = _pooled(half_maxima(net, whole, to), to)
    z = mean @ net["mean"] + top @ net["top"] + net["c"]
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def _gradients(net: dict, texts: list[bytes], labels: np.ndarray) -> dict:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, to = padded(np.frombuffer(b"".join(texts), np.uint8), at)
    per = HALF // STEP
    steps = _steps(data)
    a = _activations(net, steps, to).reshape(-1, per, FILTERS)
    where = a.argmax(axis=1)
    halves = np.maximum(np.take_along_axis(a, where[:, None], axis=1)[:, 0], 0)
    mean, top, chunks, first = _pooled(halves, to)
    z = mean @ net["mean"] + top @ net["top"] + net["c"]
    dz = ((1 / (1 + np.exp(-z)) - labels) / len(texts)).astype(np.float32)
    g = {"mean": mean.T @ dz, "top": top.T @ dz, "c": dz.sum(keepdims=True)}
    count = np.diff(to) - 1
    doc = np.repeat(np.arange(len(texts)), count)
    d_chunks = (dz / count)[doc][:, None] * net["mean"]
    for i in range(len(texts)):
        best = first[i] + chunks[first[i] : first[i] + count[i]].argmax(axis=0)
        d_chunks[best, np.arange(FILTERS)] += dz[i] * net["top"]
    left = np.arange(len(chunks)) + doc  # first half of each chunk
    d_halves = np.zeros_like(halves)
    from_left = halves[left] >= halves[left + 1]
    d_halves[left] += np.where(from_left, d_chunks, 0)
    d_halves[left + 1] += np.where(from_left, 0, d_chunks)
    d_halves[halves <= 0] = 0
    k = STEP * WIDTH
    nxt = np.zeros_like(steps)
    nxt[:-1] = steps[1:]
    nxt[to[1:] * per - 1] = 0
    g["w"] = np.zeros_like(net["w"])
    base = np.arange(len(halves)) * per
    for f in range(FILTERS):
        spot = base + where[:, f]
        g["w"][:k, f], g["w"][k:, f] = d_halves[:, f] @ steps[spot], d_halves[:, f] @ nxt[spot]
    g["b"] = d_halves.sum(axis=0)
    return g


def train(texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Adam on the log loss; texts in a seeded order."""
    net = start_network()
    if len(set(labels.tolist())) < 2:
        return net
    rng = np.random.Generator(np.random.PCG64(SEED + 2))
    rng_order = np.arange(len(texts))
    m, v, t = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    # start from the share of label 1, and let the filters count from the first step
    net["c"][:] = np.log(labels.mean() / (1 - labels.mean()))
    net["mean"] = rng.normal(0, 0.1, FILTERS).astype(np.float32)
    net["top"] = rng.normal(0, 0.1, FILTERS).astype(np.float32)
    total = EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        rng.shuffle(rng_order)
        for s in range(0, len(texts), BATCH):
            pick = rng_order[s : s + BATCH]
            g = _gradients(net, [texts[i] for i in pick], labels[pick])
            t += 1
            rate = RATE * (1 - t / (total + 1))
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net[k] = (net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
) -> dict[str, np.ndarray]:
    """The network, fitted on labelled rows that are not held out.

    The ``sample`` labels of the smallest hashes are drawn and joined as a table of
    that size; of their texts, each once and in order of a hash, whole ones are taken while
    they fit into ``sample_bytes`` characters.  The driver gets those.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("y"))
    drawn = usable.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("draw"), F.length(text).alias("size"), text.alias("text"))
    # slim rows first: which texts there are, and how long
    slim = rows.join(F.broadcast(drawn), "id").where(F.col("size") <= sample_bytes).groupBy("draw").agg(F.min("size").alias("size"))
    fits, left = [], sample_bytes
    for r in slim.orderBy("draw").limit(sample).collect():
        if r["size"] > left:
            break
        fits.append((r["draw"],))
        left -= r["size"]
    taken = docs.sparkSession.createDataFrame(fits, "draw long")
    whole = rows.join(F.broadcast(taken), "draw").join(F.broadcast(drawn), "id").groupBy("draw").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    whole = whole.toPandas().sort_values("draw")
    return train([t.encode() for t in whole["text"]], whole["y"].to_numpy(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row."""
    prepare(docs.sparkSession)
    net = fit_quality(docs, labels, id_col, text_col, label_col, sample)
    untrained = not np.any(net["mean"])

    def run(column: pa.Array) -> pa.Array:
        data, at = buffers(column)
        return pa.array(np.full(len(at) - 1, 0.5) if untrained else scores(net, data, at), pa.float64())

    score = arrow_udf(run, "double")(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), score.alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
