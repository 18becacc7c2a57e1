"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavekit.llm.common import hash_sample, whole_text

PASSAGE_BYTES = 512
#: Bounds of the training sample; scoring has none.
MAX_TRAIN_DOCS = 6000
#: Bytes of the training texts together, about: 64 MB are 130,000 passages.
MAX_TRAIN_BYTES = 64 << 20
MAX_TRAIN_PASSAGES = 2000  # longer documents are not trained on
_CHUNK = 1 << 19  # bytes of text worked on at a time: some ten arrays of eight bytes each

# Byte classes: fine ones are counted alone, coarse ones also as pairs.
_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c",
    b".,;:?", b"!", b"#&$%*+=~^<>/\\@_", b"|", b"\"'`()[]{}-", bytes(range(0x80, 0x100)),
]
_COARSE = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _COARSE[list(_g)] = _i
_K = len(_GROUPS) + 1
_FINE = np.full(256, 255, np.uint8)
_SINGLES = b".,;:?!#&$%*+=~^<>/\\@_|\"'()[]{}-\n\t"
for _i, _c in enumerate(_SINGLES):
    _FINE[_c] = _i
_C = len(_SINGLES)
N_FEATURES = _K + _C + _K * _K + 4
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _features(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Surface features of consecutive passages: shares of byte classes, of class pairs, of punctuation marks,
    distinct words, words that repeat the one before, word length, word count."""
    n, size = len(starts), len(b)
    lens = np.diff(np.append(starts, size))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not size:
        return out
    pid = np.repeat(np.arange(n), lens)
    coarse = _COARSE[b]
    share = np.maximum(lens, 1)[:, None]
    out[:, :_K] = np.bincount(pid * _K + coarse, minlength=n * _K).reshape(n, _K) / share
    fine = _FINE[b]
    at = np.flatnonzero(fine != 255)
    out[:, _K : _K + _C] = np.bincount(pid[at] * _C + fine[at], minlength=n * _C).reshape(n, _C) / share
    same = pid[1:] == pid[:-1]
    pair = (pid[:-1] * (_K * _K) + coarse[:-1] * np.int64(_K) + coarse[1:])[same]
    out[:, _K + _C : -4] = np.bincount(pair, minlength=n * _K * _K).reshape(n, -1) / share
    word = (coarse != 3) & (coarse != 4)
    begin = word.copy()
    begin[1:] &= ~word[:-1] | ~same
    w = np.flatnonzero(begin)
    if len(w):
        place = np.arange(size) - np.repeat(np.append(0, w), np.diff(np.concatenate(([0], w, [size]))))
        value = np.where(word, _BYTE[b] * _PLACE[place & 63], np.uint64(0))
        sig, wp = np.add.reduceat(value, w), pid[w]
        count = np.bincount(wp, minlength=n)
        order = np.lexsort((sig, wp))
        s, p = sig[order], wp[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
        again = (sig[1:] == sig[:-1]) & (wp[1:] == wp[:-1])
        some = np.maximum(count, 1)
        out[:, -4] = np.bincount(p[new], minlength=n) / some
        out[:, -3] = np.bincount(wp[1:][again], minlength=n) / some
        out[:, -2] = np.bincount(pid[word], minlength=n) / some / 10
        out[:, -1] = np.log1p(count)
    return out


def _bags(texts, passage_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, features of its and the following texts' passages, passages of each), some MB of
    text at a time; the passages of one very long text come in one piece but are computed in several."""
    at, bufs, counts, held = 0, [], [], 0
    for i, text in enumerate(texts):
        t = text.encode("utf-8", "surrogatepass")
        bufs.append(t)
        counts.append(max(1, -(-len(t) // passage_bytes)))
        held += len(t)
        if held >= _CHUNK or i == len(texts) - 1:
            yield at, _all_features(bufs, passage_bytes), np.array(counts)
            at, bufs, counts, held = i + 1, [], [], 0


def _all_features(bufs: list[bytes], passage_bytes: int) -> np.ndarray:
    if len(bufs) == 1 and len(bufs[0]) > _CHUNK:
        step = _CHUNK // passage_bytes * passage_bytes
        return np.concatenate([_all_features([bufs[0][k : k + step]], passage_bytes) for k in range(0, len(bufs[0]), step)])
    starts, base = [], 0
    for t in bufs:
        starts.append(base + np.arange(0, max(1, len(t)), passage_bytes))
        base += len(t)
    return _features(np.frombuffer(b"".join(bufs), np.uint8), np.concatenate(starts))


@dataclass
class AttentionMIL:
    """Gated attention over passage encodings (Ilse et al. 2018), a logistic score of the weighted sum."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float | None = None  # the score of everything when the labels hold one class only

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        q = self.params
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(x @ q["W"] + q["b"])
        t, s = np.tanh(h @ q["V"]), 1 / (1 + np.exp(-(h @ q["U"])))
        e = (t * s) @ q["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ q["c"] + q["c0"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "bag": bag, "starts": starts}

    def scores(self, texts, passage_bytes: int) -> np.ndarray:
        out = np.empty(len(texts))
        for at, x, counts in _bags(texts, passage_bytes):
            out[at : at + len(counts)] = self.forward(x.astype(np.float64), counts)["p"] if self.prior is None else self.prior
        return out.round(9)  # the last digits depend on what else is in the batch

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        q, bag = self.params, f["bag"]
        d = (f["p"] - y) / len(y)
        dz = np.outer(d, q["c"])[bag]
        da = (f["h"] * dz).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[bag])
        dg = np.outer(de, q["w"])
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ q["V"].T + ds @ q["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True),
        }


def fit_mil(x: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 25, rate: float = 0.01) -> AttentionMIL:
    """Adam on the log-loss, minibatches in a seeded order: the same sample gives the same model."""
    if len(y) == 0 or len(set(y.tolist())) < 2:
        prior = float(y.mean()) if len(y) else 0.5
        zero = np.zeros(1)
        return AttentionMIL({}, zero, zero, prior)
    rng = np.random.default_rng(7)
    every = np.concatenate(x)
    scale = (1 / np.maximum(every.std(0), 1e-3)).astype(np.float32)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    f = every.shape[1]
    m = AttentionMIL(
        {"W": draw(f, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate),
         "w": draw(gate), "c": draw(hidden), "c0": np.zeros(1, np.float32)},
        every.mean(0), scale,
    )
    m1 = {k: np.zeros_like(v) for k, v in m.params.items()}
    m2 = {k: np.zeros_like(v) for k, v in m.params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 64):
            part = order[k : k + 64]
            out = m.forward(np.concatenate([x[i] for i in part]), np.array([len(x[i]) for i in part]))
            step += 1
            for name, g in m.gradients(out, y[part]).items():
                g = g + 1e-4 * m.params[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                m.params[name] = (m.params[name] - rate * fix * m1[name] / (np.sqrt(m2[name]) + 1e-8)).astype(np.float32)
    m.params = {k: v.astype(np.float64) for k, v in m.params.items()}
    return m


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_docs: int = MAX_TRAIN_DOCS, max_passages: int = MAX_TRAIN_PASSAGES, passage_bytes: int = PASSAGE_BYTES,
    max_bytes: int = MAX_TRAIN_BYTES,
) -> AttentionMIL:
    """Fit on a bounded sample of the labelled rows: ``max_docs`` documents of at most ``max_passages`` passages and
    about ``max_bytes`` of text together, chosen by a hash of the id among rows whose crc32(id as text) mod 4 is not 2 and
    whose label is 0 or 1 (equal texts of one id count once). Features are made in the texts' own partitions."""
    i = F.col("i")
    usable = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .where("i is not null and y in (0, 1)")
        .where(F.crc32(i.cast("string")) % 4 != 2)
        .groupBy("i").agg(F.max("y").alias("y"))
    )
    sample = hash_sample(usable, F.xxhash64("i"), max_docs, usable.count())
    sample = sample.orderBy(F.pmod(F.xxhash64("i"), F.lit(1 << 40)), "i").limit(max_docs)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, x, counts in _bags(list(b["t"]), passage_bytes):
                ends = np.cumsum(counts)
                yield pd.DataFrame({
                    "i": b["i"].to_numpy()[at : at + len(counts)], "y": b["y"].to_numpy()[at : at + len(counts)],
                    "x": [x[e - c : e].astype("<f4").tobytes() for e, c in zip(ends, counts)],
                })

    # ids, hashes and sizes choose the rows; the texts stay where they are until the features are made
    rows = docs.select(F.col(id_col).alias("i"), whole_text(text_col).alias("t"))
    narrow = rows.select("i", F.xxhash64("t").alias("h"), F.octet_length("t").cast("long").alias("n"))
    narrow = narrow.where(F.col("n") <= max_passages * passage_bytes).join(F.broadcast(sample.select("i")), "i")  # at most max_docs ids
    order = [F.pmod(F.xxhash64("i"), F.lit(1 << 40)), F.col("i"), F.col("h")]
    narrow = narrow.distinct().orderBy(*order).limit(max_docs)
    total = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # at most max_docs rows
    chosen = narrow.withColumn("before", F.coalesce(total, F.lit(0))).where(F.col("before") < max_bytes).select("i", "h").join(sample, "i")
    rows = (
        rows.withColumn("h", F.xxhash64("t"))
        .join(F.broadcast(chosen), ["i", "h"])
        .dropDuplicates(["i", "h"])
        .select("i", "y", "t")
        .mapInPandas(features, sample.schema.add("x", "binary"))
        .toPandas()  # at most about max_bytes of text in passages
        .sort_values(["i", "x"])
    )
    x = [np.frombuffer(v, "<f4").reshape(-1, N_FEATURES) for v in rows["x"]]
    return fit_mil(x, rows["y"].to_numpy(np.float32))


def score_quality(
    docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
    passage_bytes: int = PASSAGE_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: the id), ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` for every row.

    Every passage of the whole text counts. Null text counts as empty; an empty text is one passage without
    bytes and gets the model's score for it. Equal texts get equal scores; repeated rows stay. Columns not named
    in ``keep`` are ignored, so clashing names do no harm. An empty table gives an empty table.
    """

    score = quality_score(model, text_col, passage_bytes).alias("score")
    scored = docs.select(*(F.col(f"`{c}`") for c in keep or [id_col]), score)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_score(model: AttentionMIL, text_col: str = "text", passage_bytes: int = PASSAGE_BYTES) -> Column:
    """The score as a column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts), passage_bytes))

    return score(whole_text(text_col))
