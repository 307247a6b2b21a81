"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import saved, slices

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A character of one of Unicode's letter categories; other numbers and marks are none.
LETTER = regex.compile(r"\p{L}")
#: Units per direction, bytes per window, windows per text and texts per language used in training (the fitted sample's bound).
UNITS, WINDOW, WINDOWS, TEXTS = 8, 48, 6, 400
STEPS, BATCH, RATE = 300, 192, 0.02
UNKNOWN = "und"
FOLDS, HELD = 3, 1


class Network:
    """Two gated recurrent networks, one from each end, and a linear layer on both states at every byte.

    Update and reset gates are written as (1 + tanh) / 2 of half their input. Arrays have the direction first.
    """

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, h = labels, units
        self.w = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype("f4"),
            "u": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)).astype("f4"),
            "o": rng.normal(0, 1 / np.sqrt(2 * h), (2, h, len(labels))).astype("f4"),
            "b": np.zeros(len(labels), "f4"),
        }

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(direction, position, window, unit); the second direction's positions run from the end."""
        n, length = windows.shape
        h = self.w["u"].shape[1]
        both = np.stack([windows.T, windows.T[::-1]])
        out = np.zeros((2, length + 1, n, h), "f4")
        for t in range(length):
            pre = np.stack([self.w["x"][0][both[0, t]], self.w["x"][1][both[1, t]]])
            rec = out[:, t] @ self.w["u"]
            gates = np.tanh(pre[..., : 2 * h] + rec[..., : 2 * h])
            gates += 1
            gates *= 0.5
            z, r = gates[..., :h], gates[..., h:]
            new = np.tanh(pre[..., 2 * h :] + r * rec[..., 2 * h :])
            if keep is not None:
                keep.append((z, r, new, rec[..., 2 * h :]))
            np.multiply(new - out[:, t], z, out=out[:, t + 1])
            out[:, t + 1] += out[:, t]
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(position, window, label)."""
        states = self.states(windows)[:, 1:]
        logits = states[0] @ self.w["o"][0] + states[1][::-1] @ self.w["o"][1] + self.w["b"]
        np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        n, length = windows.shape
        h = self.w["u"].shape[1]
        kept: list = []
        states = self.states(windows, kept)
        ahead, back = states[0, 1:], states[1, 1:][::-1]
        logits = ahead @ self.w["o"][0] + back @ self.w["o"][1] + self.w["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=-1, keepdims=True)
        loss = -float(np.log(np.maximum(prob[:, np.arange(n), truth], 1e-12)).mean())
        prob[:, np.arange(n), truth] -= 1
        prob /= n * length
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["b"] = prob.sum(axis=(0, 1))
        g["o"] = np.stack([np.tensordot(ahead, prob, ((0, 1), (0, 1))), np.tensordot(back, prob, ((0, 1), (0, 1)))])
        arrive = np.stack([prob @ self.w["o"][0].T, (prob @ self.w["o"][1].T)[::-1]])
        both = np.stack([windows.T, windows.T[::-1]])
        dh = np.zeros((2, n, h), "f4")
        for t in reversed(range(length)):
            dh += arrive[:, t]
            z, r, new, rec = kept[t]
            old = states[:, t]
            d_new = dh * z * (1 - new * new)
            d_z = dh * (new - old) * 2 * z * (1 - z)
            d_r = d_new * rec * 2 * r * (1 - r)
            d_pre = np.concatenate([d_z, d_r, d_new], axis=-1)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=-1)
            for d in range(2):
                np.add.at(g["x"][d], both[d, t], d_pre[d])
            g["u"] += old.transpose(0, 2, 1) @ d_rec
            dh = dh * (1 - z) + d_rec @ self.w["u"].transpose(0, 2, 1)
        return loss, g

    def fit(self, windows: np.ndarray, truth: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """Adam on random batches; the last loss."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(windows), min(batch, 4 * len(windows)))
            loss, g = self.gradients(windows[rows], truth[rows])
            now = rate * (1 - (step - 1) / steps)
            for k, v in self.w.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] * g[k] - square[k])
                v -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
        return loss


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes in rows of ``size``; the last row is filled with blanks."""
    return np.frombuffer(data + b" " * (-len(data) % size), np.uint8).reshape(-1, size)


def train(docs: DataFrame, texts: int = TEXTS, windows: int = WINDOWS) -> Network | None:
    """A network from at most ``texts`` labelled texts a language and ``windows`` windows of each; None without any.

    Only rows with text and lang whose crc32(doc_id as text) mod 3 is not 1 are used. Which of them is drawn by a hash, so
    the sample is the same however the table is dealt.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), "lang")
    rows = rows.where(F.crc32(F.col("_id").cast("string")) % FOLDS != HELD).withColumn("_draw", F.xxhash64("_id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))  # as many rows as the network has labels
    few = rows.join(F.broadcast(sizes), "lang").where(F.pmod("_draw", F.lit(1 << 30)) * F.col("_n") < 2 * texts * (1 << 30))
    drawn = few.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_draw", "_id"))).where(F.col("_rank") <= texts)
    drawn = saved(drawn.select("_id").distinct(), "drawn")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and lang and LETTER.search(text):
                    rows = windows_of(text.encode().translate(LOWER))
                    for k in np.linspace(0, len(rows) - 1, min(windows, len(rows))).astype(int):
                        out.append((doc, int(k), lang, rows[k].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "k", "lang", "w"), r, strict=True)) for r in out], schema=pa.schema([("id", pa.int64()), ("k", pa.int32()), ("lang", pa.string()), ("w", pa.binary())]))

    cuts = docs.join(drawn, docs["doc_id"] == drawn["_id"], "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sample = cuts.mapInArrow(cut, "id long, k int, lang string, w binary").toPandas().drop_duplicates(["id", "k", "lang", "w"]).sort_values(["id", "k", "w"])
    if sample.empty:
        return None
    labels = sorted(sample["lang"].unique())
    network = Network(labels)
    truth = sample["lang"].map({x: i for i, x in enumerate(labels)}).to_numpy()
    share = min(np.bincount(truth).max(), texts * windows)
    rng = np.random.default_rng(3)
    even = np.concatenate([rng.choice(np.flatnonzero(truth == i), share) for i in range(len(labels))])
    rows = np.stack([np.frombuffer(w, np.uint8) for w in sample["w"]])
    network.fit(rows[even], truth[even])
    return network


def labelled(docs: DataFrame, network: Network | None) -> DataFrame:
    """(row, lang_pred, score) with each whole row of ``docs`` as one struct: the mean over all bytes of the whole text of each language's probability.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned. Only the text
    is looked at. Of equally probable languages the first in alphabetical order is named. Repeated rows get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            texts = batch.column(0).to_pylist()
            good = [bool(network and t and LETTER.search(t)) for t in texts]
            label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            data = [t.encode().translate(LOWER) for t, ok in zip(texts, good, strict=True) if ok]
            if data:
                sizes = np.array([len(d) for d in data])
                rows = [-(-n // WINDOW) for n in sizes.tolist()]
                windows = np.concatenate([windows_of(d) for d in data])
                sums = np.empty((len(windows), len(network.labels)))
                real = np.full(len(windows), WINDOW)
                real[np.cumsum(rows) - 1] = sizes - (np.array(rows) - 1) * WINDOW
                for k in range(0, len(windows), 1024):
                    prob = network.probabilities(windows[k : k + 1024])
                    prob *= (np.arange(WINDOW)[:, None] < real[k : k + 1024])[..., None]
                    sums[k : k + 1024] = prob.sum(axis=0)
                mean = np.add.reduceat(sums, np.cumsum(rows) - rows) / sizes[:, None]
                places = np.flatnonzero(good)
                best = mean.argmax(axis=1)
                score[places] = np.clip(mean[np.arange(len(best)), best], 0, 1)
                for p, b in zip(places.tolist(), best.tolist(), strict=True):
                    label[p] = network.labels[b]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(label), pa.array(score)], ["row", "lang_pred", "score"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("text", F.struct("*").alias("row")).mapInArrow(run, schema)


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; other columns are ignored."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return labelled(few, network).select("row.doc_id", "lang_pred", "score")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the table's own labelled rows of the other folds."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return predicted(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
