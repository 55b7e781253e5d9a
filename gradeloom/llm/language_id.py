"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of 64 bytes from both ends, labels every position and is trained by
backpropagation through time in numpy, on windows of a documented number of labelled documents of
each language. Every window of a whole text is labelled, and the position probabilities are pooled
into those of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.tokens import LOWER, groups
from gradeloom.plans.columns import packed, unpacked
from gradeloom.plans.session import small_batches

WINDOW = 64
LETTER = re.compile(r"[^\W\d_]")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Weights of both directions are stacked in the first axis: input table, recurrence, biases; then the output layer."""

    def __init__(self, hidden: int, labels: int, seed: int):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.hidden, self.labels = hidden, labels
        self.p = {
            "table": normal(2, 256, 3 * hidden, scale=0.3),
            "gates": normal(2, hidden, 2 * hidden, scale=hidden**-0.5),
            "inner": normal(2, hidden, hidden, scale=hidden**-0.5),
            "bias": np.zeros((2, 1, 3 * hidden), np.float32),
            "out": normal(2 * hidden, labels, scale=hidden**-0.5),
            "shift": np.zeros(labels, np.float32),
        }

    def states(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states ``[time, window, 2 * hidden]`` of windows given as bytes ``[time, window]``."""
        p, k, (steps, size) = self.p, self.hidden, data.shape
        h = np.zeros((2, size, k), np.float32)
        out = np.empty((steps, size, 2 * k), np.float32)
        table = p["table"] + p["bias"]
        given = np.empty((2, size, 3 * k), np.float32)
        for t in range(steps):
            np.take(table[0], data[t], axis=0, out=given[0], mode="clip")
            np.take(table[1], data[steps - 1 - t], axis=0, out=given[1], mode="clip")
            gate = sigmoid(given[:, :, : 2 * k] + h @ p["gates"])
            z, r = gate[:, :, :k], gate[:, :, k:]
            new = np.tanh(given[:, :, 2 * k :] + (r * h) @ p["inner"])
            if keep is not None:
                keep.append((h, z, r, new))
            h = new + z * (h - new)
            out[t, :, :k] = h[0]
            out[steps - 1 - t, :, k:] = h[1]
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        x = self.states(data) @ self.p["out"] + self.p["shift"]
        x = np.exp(x - x.max(axis=2, keepdims=True))
        return x / x.sum(axis=2, keepdims=True)

    def gradient(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all real positions, back through time."""
        p, k, (steps, size) = self.p, self.hidden, data.shape
        kept: list = []
        states = self.states(data, kept)
        x = states @ p["out"] + p["shift"]
        x = np.exp(x - x.max(axis=2, keepdims=True))
        x /= x.sum(axis=2, keepdims=True)
        x[:, np.arange(size), label] -= 1
        x *= (mask / max(mask.sum(), 1)).astype(np.float32)[:, :, None]
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["out"] = np.tensordot(states, x, axes=([0, 1], [0, 1]))
        g["shift"] = x.sum(axis=(0, 1))
        back = x @ p["out"].T
        after = np.zeros((2, size, k), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, new = kept[t]
            d = after + np.stack([back[t, :, :k], back[steps - 1 - t, :, k:]])
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z)
            d_rh = d_new @ p["inner"].transpose(0, 2, 1)
            d_gate = np.concatenate([d_z, d_rh * h * r * (1 - r)], axis=2)
            g["inner"] += (r * h).transpose(0, 2, 1) @ d_new
            g["gates"] += h.transpose(0, 2, 1) @ d_gate
            both = np.concatenate([d_gate, d_new], axis=2)
            np.add.at(g["table"][0], data[t], both[0])
            np.add.at(g["table"][1], data[steps - 1 - t], both[1])
            g["bias"] += both.sum(axis=1, keepdims=True)
            after = d * z + d_rh * r + d_gate @ p["gates"].transpose(0, 2, 1)
        return g

    def train(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> None:
        """Adam over shuffled batches of windows ``[window, time]``."""
        rng, step = np.random.default_rng(seed), 0
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        total = epochs * -(-len(data) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for k in range(0, len(order), batch):
                part, step = order[k : k + batch], step + 1
                pace = rate * (1 - 0.9 * step / total)
                for n, g in self.gradient(data[part].T, mask[part].T, label[part]).items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    self.p[n] = (self.p[n] - pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every window and the number of its text."""
    count = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[owner] + step * WINDOW, owner


def cut(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (capital A-Z made small) and mask of windows, ``[window, time]``."""
    at = start[:, None] + np.arange(WINDOW)
    mask = at < offsets[owner + 1][:, None]
    return np.where(mask, LOWER[data[np.minimum(at, len(data) - 1)]], 0), mask


def held_out(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int = 5, each: int = 500, pieces: int = 6, hidden: int = 8, epochs: int = 8, seed: int = 11) -> tuple[Network | None, list[str]]:
    """Train on at most ``each`` documents of a language, ``pieces`` windows spread over each whole text.

    The documents are those with the least hash of id and text. Those of each language are counted first, so
    that only little more than needed comes to the driver.
    """
    size = F.greatest(F.lit(0), F.length("text") - WINDOW)
    part = [F.substring(F.col("text"), (size * (k / max(1, pieces - 1))).cast("int") + 1, F.lit(WINDOW)) for k in range(pieces)]
    rows = docs.select(held_out(id_col, folds).alias("held"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(~F.col("held") & F.col("lang").isNotNull() & (F.length("text") > 0))
    number = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not number:
        return None, []
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in number.items() for x in (lang, min(1.0, (each + 4 * each**0.5 + 16) / n))]), F.col("lang"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "text"))
    found = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("lang", F.pmod("h", F.lit(1 << 30)).alias("h"), F.array(*part).alias("parts")).collect()
    by_lang: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["parts"])):
        kept = by_lang.setdefault(r["lang"], [])
        if len(kept) < each:
            kept.append(r)
    rows = [r for kept in by_lang.values() for r in kept]
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None, []
    texts = [(x.encode()[:WINDOW], langs.index(r["lang"])) for r in rows for x in r["parts"] if x]
    raw = np.frombuffer(b"".join(x for x, _ in texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x, _ in texts])])
    data, mask = cut(raw, offsets, offsets[:-1], np.arange(len(texts)))
    net = Network(hidden, len(langs), seed)
    net.train(data, mask, np.array([k for _, k in texts]), epochs, 256, 0.02, seed)
    return net, langs


def predict(docs: DataFrame, net: Network | None, langs: list[str], keep: str) -> DataFrame:
    """Column ``keep`` of ``docs`` with ``lang_pred`` and ``score`` of its column ``text``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def label(text: pa.Array) -> tuple[pa.Array, pa.Array]:
        names, scores = [], []
        for a, b, data, offsets in groups(text, 1 << 19):
            total = np.zeros((b - a, max(1, len(langs))))
            start, owner = windows_of(offsets)
            for k in range(0, len(start) if net else 0, 2048):
                part = slice(k, k + 2048)
                raw, mask = cut(data, offsets, start[part], owner[part])
                pooled = (net.probabilities(raw.T) * mask.T[:, :, None]).sum(axis=0)
                np.add.at(total, owner[part], pooled)
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(axis=1)
            letters = np.add.reduceat(np.append((LOWER[data] >= 97) & (LOWER[data] <= 122), False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
            for k in range(b - a):
                known = net is not None and (letters[k] > 0 or bool(LETTER.search(data[offsets[k] : offsets[k + 1]].tobytes().decode())))
                names.append(langs[best[k]] if known else "und")
                scores.append(float(min(1.0, total[k, best[k]])) if known else 0.0)
        return pa.array(names, pa.string()), pa.array(scores, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *label(batch.column(1))], [keep, "lang_pred", "score"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """One row for each document: its id, ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    Learns from rows with a language whose crc32(id as text) mod ``folds`` is not 0; a null id counts as
    the empty text and is held out. ``lang_pred`` is a learned language, or ``und`` with score 0 where
    the text is null or has no letter, or where there is nothing to learn from. Equal probabilities go
    to the first language by name. Very long texts are read whole, window by window. Repeated rows are judged alike.
    An empty table gives an empty result. Other columns are not read.
    """
    net, langs = fit(docs, id_col, text_col, lang_col, folds)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), held_out(id_col, folds).alias("held_out")).alias("row"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, net, langs, "row").select(F.col("row.id").alias(id_col), "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is known with at least this score; all columns stay, whatever their names."""
    net, langs = fit(docs, id_col, text_col, lang_col)
    rows = packed(docs).withColumn("text", F.col("row").getField(text_col).cast("string"))
    return unpacked(predict(rows, net, langs, "row").filter((F.col("lang_pred") != "und") & (F.col("score") >= least)))
