"""Document fingerprints: quartile bucket digests of hashed byte triplets, compared by a bounded difference."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavekit.llm.common import cut, whole_text

BUCKETS = 256
_CHUNK = 1 << 21
#: Cost of a bucket whose quartile codes differ by 0 to 3; two unrelated digests differ by 1.875 on average.
_COST = np.array([0, 1, 3, 6], np.int32)
_UNRELATED = 1.875 * BUCKETS


def _counts(data: Sequence[bytes]) -> np.ndarray:
    """Bucket counts of the triplets of each text."""
    n = len(data)
    if n == 1 and len(data[0]) > 2 * _CHUNK:  # one very long text: piece by piece, two bytes overlapping
        t = data[0]
        return sum(_counts([t[k : k + _CHUNK + 2]]) for k in range(0, len(t) - 2, _CHUNK))
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    lens = np.fromiter(map(len, data), np.int64, n)
    owner = np.repeat(np.arange(n), lens)
    bucket = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(24)
    whole = owner[:-2] == owner[2:]
    return np.bincount((owner[:-2] * BUCKETS + bucket)[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)


def codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile code (0 to 3) of every bucket, and the length code, of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    found, held, size = [], [], 0
    for k, t in enumerate(data):
        held.append(t)
        size += len(t)
        if size >= _CHUNK or k == len(data) - 1:
            found.append(_counts(held))
            held, size = [], 0
    count = np.concatenate(found) if found else np.zeros((0, BUCKETS), np.int64)
    cuts = np.sort(count, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (count[:, :, None] > cuts[:, None, :]).sum(2).astype(np.uint8)
    length = np.minimum(255, 12 * np.log1p(np.fromiter(map(len, data), np.float64, len(data)))).astype(np.uint8)
    return code, length


def to_hex(code: np.ndarray, length: np.ndarray) -> list[str]:
    """128 hex digits of bucket codes (four buckets a byte), then two of the length code."""
    packed = (code.reshape(len(code), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8)
    return [p.tobytes().hex() + f"{n:02x}" for p, n in zip(packed, length.tolist())]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests, falling to 0 at the difference of unrelated ones; a tenth is for the length."""
    body = _COST[np.abs(a[0].astype(np.int8) - b[0].astype(np.int8))].sum(1) / _UNRELATED
    length = np.abs(a[1].astype(int) - b[1].astype(int)) / 64
    return 1 - np.minimum(1, 0.9 * np.minimum(1, body) + 0.1 * np.minimum(1, length))


def edit(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], own, following: list[str], next_) -> pd.DataFrame:
    edited = [edit(a, b) for a, b in zip(texts, following)]
    new = codes(edited)
    return pd.DataFrame({
        "id": pd.Series(ids, dtype=object),
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": to_hex(*own),
        "edited_fingerprint": to_hex(*new),
        "near_edited": likeness(own, new),
        "near_next": likeness(own, next_),
    })


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fingerprint`` of every row: the digest of the whole text (null counts as empty)."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series(to_hex(*codes(list(texts))), dtype=object)

    return docs.select(F.col(id_col), digest(whole_text(text_col)).alias("fingerprint"))


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text, of its edited text (its last half replaced by the start of the next document) and
    their likeness: ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the next id in ascending order (null last; rows of one id by a hash of the text; after
    the last the first). Texts travel once, to range partitions of that order, and stream through sorted; only the
    first and last row of each partition are written with their texts, and each last one is joined to the first
    one of the next partition that has rows. So no task sees more than its range, and a repeated id is spread by
    the hash of its texts.

    Null text counts as empty; texts under three bytes have no triplet and their digest is that of the length
    alone. Equal texts have equal digests. A single row is its own next document. Extra columns are ignored; an
    empty table gives an empty table.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("null_id", F.col("id").isNull())
    kind = rows.schema["id"].dataType.simpleString()
    order = [F.col("null_id"), F.col("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, held = TaskContext.get().partitionId(), True, None
        for b in batches:
            if b.empty:
                continue
            ids, texts = b["id"].astype(object).where(b["id"].notna(), None).tolist(), b["text"].tolist()
            for k in range(0, len(texts), 2000):
                i, t = ids[k : k + 2000], texts[k : k + 2000]
                own = codes(t)
                if first:
                    yield pd.DataFrame({"id": pd.Series(i[:1], dtype=object), "part": part, "role": "head", "text": t[:1]})
                    first = False
                if held:
                    i, t = [held[0], *i], [held[1], *t]
                    own = tuple(np.concatenate([h, o]) for h, o in zip(held[2], own))
                if len(t) > 1:
                    yield _compare(i[:-1], t[:-1], tuple(o[:-1] for o in own), t[1:], tuple(o[1:] for o in own)).assign(part=part, role="done", text=None)
                held = i[-1], t[-1], tuple(o[-1:] for o in own)
        if held:
            yield pd.DataFrame({"id": pd.Series([held[0]], dtype=object), "part": part, "role": "tail", "text": [held[1]]})

    columns = _RESULT.format(id=kind)
    names = [c.split()[0] for c in columns.split(", ")]

    def padded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in stream(batches):
            yield b.reindex(columns=[*names, "part", "role", "text"]).astype({c: object for c in names})

    out = cut(rows.mapInPandas(padded, columns + ", part int, role string, text string"))
    heads = out.where("role = 'head'").select("part", F.col("text").alias("following"))
    low = heads.agg(F.min("part")).first()[0]
    # one small row for each partition of the range exchange
    after = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.lit(low)).alias("next_part"))
    ends = (
        out.where("role = 'tail'").select("id", "part", "text").join(after, "part")
        .join(heads.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "following")
    )

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not b.empty:
                t, f = b["text"].tolist(), b["following"].tolist()
                yield _compare(b["id"].astype(object).where(b["id"].notna(), None).tolist(), t, codes(t), f, codes(f))

    done = out.where("role = 'done'").select(*names).unionByName(ends.mapInPandas(close, columns))
    return done.withColumnRenamed("id", id_col)
