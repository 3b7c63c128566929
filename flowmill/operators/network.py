"""A feed-forward classifier trained on all executors at once: Adam on mini-batches, stopped early.

Training is one barrier stage. Each task holds its share of the rows (beyond `HELD_BYTES` in a file of
its own), all tasks hold the same weights. In a step every task adds up the weighted gradient of its part
of the mini-batch, the tasks exchange these sums, and each makes the same Adam step. A tenth of the rows,
by hash of their id, is for validation: training ends when its accuracy hasn't risen for `patience`
epochs, and the best weights are returned. A lost task restarts the stage.

The barrier tells the tasks the first one's address and a secret word once; a step then costs a message
each way a task, of as many numbers as there are weights. `tasks` bounds what the first task receives.
"""

from __future__ import annotations

import secrets
import socket
import struct
import tempfile
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of rows that a task holds in memory.
HELD_BYTES = 512 << 20


@dataclass
class Network:
    """weights: (matrix, bias) a layer; losses and accuracies: of training and validation rows an epoch."""

    weights: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float]
    accuracies: list[float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return outputs(self.weights, x)[-1]


def initial(sizes: list[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    bound = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    return [(rng.uniform(-s, s, (a, b)), rng.uniform(-s, s, b)) for a, b, s in zip(sizes, sizes[1:], bound, strict=False)]


def outputs(weights, x: np.ndarray) -> list[np.ndarray]:
    """Each layer's output, the input first, the classes' probabilities last."""
    out = [x]
    for i, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        if i + 1 < len(weights):
            out.append(np.maximum(z, 0))
        else:
            e = np.exp(z - z.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
    return out


def gradient(weights, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted sum of the rows' log-losses, and its gradient as one vector."""
    out = outputs(weights, x)
    rows = np.arange(len(x))
    loss = float(-(np.log(np.maximum(out[-1][rows, label], 1e-300)) * weight).sum())
    d = out[-1].copy()
    d[rows, label] -= 1
    d *= weight[:, None]
    parts = []
    for i in range(len(weights) - 1, -1, -1):
        parts += [d.sum(0).ravel(), (out[i].T @ d).ravel()]
        if i:
            d = (d @ weights[i][0].T) * (out[i] > 0)
    return loss, np.concatenate(parts[::-1])


def flat(weights) -> np.ndarray:
    return np.concatenate([v.ravel() for pair in weights for v in pair])


def shaped(v: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((v[at : at + a * b].reshape(a, b), v[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _held(batches, features: int):
    """This task's rows: vectors, labels, weights and which are for validation."""
    xs, rest, size = [], [], 0
    file = None
    for pdf in batches:
        if not len(pdf):
            continue
        x = np.stack(pdf["x"]).astype(float)
        rest.append(pdf[["label", "weight", "held"]])
        size += x.nbytes
        if size > HELD_BYTES and file is None:
            file = tempfile.TemporaryFile()  # only this task reads it
            for v in xs:
                v.tofile(file)
            xs = []
        if file is None:
            xs.append(x)
        else:
            x.tofile(file)
    if not rest:
        return np.zeros((0, features)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    rest = pd.concat(rest)
    if file is None:
        x = np.concatenate(xs)
    else:
        file.flush()
        x = np.memmap(file, float, "r").reshape(-1, features)
    return x, rest["label"].to_numpy(np.int64), rest["weight"].to_numpy(float), rest["held"].to_numpy(bool)


class _Sum:
    """Sums of vectors over all tasks of a barrier stage, in the order of the tasks."""

    def __init__(self, context):
        self.first, self.peers, n = context.partitionId() == 0, [], len(context.getTaskInfos())
        server = socket.create_server(("", 0)) if self.first else None
        told = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if self.first else "")[0]
        port, word = told.split()
        if self.first:
            server.settimeout(120)
            found = {}
            while len(found) < n - 1:
                peer = server.accept()[0]
                peer.settimeout(600)
                if self._read(peer, 32) == word.encode():
                    found[struct.unpack("<q", self._read(peer, 8))[0]] = peer
            self.peers = [found[i] for i in sorted(found)]
            server.close()
        else:
            host = context.getTaskInfos()[0].address.rpartition(":")[0] or context.getTaskInfos()[0].address
            peer = socket.create_connection((host, int(port)), 120)
            peer.settimeout(600)
            peer.sendall(word.encode() + struct.pack("<q", context.partitionId()))
            self.peers = [peer]

    @staticmethod
    def _read(peer, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            got = peer.recv(min(1 << 20, size - len(out)))
            if not got:
                raise ConnectionError("another task is gone")
            out += got
        return bytes(out)

    def __call__(self, v) -> np.ndarray:
        v = np.array(v, float)
        if not self.first:
            self.peers[0].sendall(v.tobytes())
            return np.frombuffer(self._read(self.peers[0], v.nbytes))
        for p in self.peers:
            v += np.frombuffer(self._read(p, v.nbytes))
        for p in self.peers:
            p.sendall(v.tobytes())
        return v


def fit(rows: DataFrame, classes: int, hidden: tuple[int, ...] = (256, 128, 64), rate: float = 1e-3, alpha: float = 1e-4, batch: int = 200, epochs: int = 500, patience: int = 20, tolerance: float = 1e-4, seed: int = 42, tasks: int | None = None) -> Network:
    """A network fitted on rows (row_id, x array<double>, label int from 0, weight double); rows with a
    null in one of these or a component that isn't finite take no part. weight counts in the loss.
    An error without rows. tasks: all slots of the cluster, 64 at most, by default; they must be free at once."""
    spark = rows.sparkSession
    rows = rows.where("row_id is not null and x is not null and label is not null and weight is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    features = len(rows.select("x").first()[0])
    sizes = [features, *hidden, classes]
    tasks = tasks or min(64, spark.sparkContext.defaultParallelism)
    held = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(10)) == 0
    ready = rows.select("x", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), held.alias("held")).repartition(tasks, F.xxhash64(F.lit(seed + 1), "row_id"))

    def train(batches):
        context = BarrierTaskContext.get()
        total = _Sum(context)
        x, label, weight, held = _held(batches, features)
        train_rows, held_rows = np.flatnonzero(~held), np.flatnonzero(held)
        n, n_held = total([len(train_rows), len(held_rows)])
        steps = max(1, int(-(-n // batch)))
        now = flat(initial(sizes, seed))
        # the penalty is on matrices only
        decay = flat([(np.full_like(w, alpha), np.zeros_like(b)) for w, b in shaped(now, sizes)])
        first, second, step = np.zeros_like(now), np.zeros_like(now), 0
        best, best_at, waited, losses, accuracies = -np.inf, now.copy(), 0, [], []
        rng = np.random.default_rng([seed, context.partitionId()])
        for _ in range(epochs):
            order, loss_sum, weight_sum = rng.permutation(train_rows), 0.0, 0.0
            for part in np.array_split(order, steps):
                loss, g = gradient(shaped(now, sizes), x[part], label[part], weight[part]) if len(part) else (0.0, np.zeros_like(now))
                met = total(np.append(g, [loss, weight[part].sum()]))
                if met[-1] <= 0:
                    continue
                step += 1
                loss_sum, weight_sum = loss_sum + met[-2], weight_sum + met[-1]
                g = (met[:-2] + decay * now) / met[-1]
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                now = now - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            losses.append(loss_sum / max(weight_sum, 1e-300))
            right = sum(int((outputs(shaped(now, sizes), x[p])[-1].argmax(1) == label[p]).sum()) for p in np.array_split(held_rows, 1 + len(held_rows) // 10_000) if len(p))
            score = total([right])[0] / n_held if n_held else -losses[-1]
            accuracies.append(float(score))
            waited = 0 if score > best + tolerance else waited + 1
            if score > best:
                best, best_at = score, now.copy()
            if waited >= patience:
                break
        if context.partitionId() == 0:
            yield pd.DataFrame({"weights": [best_at.tobytes()], "losses": [losses], "accuracies": [accuracies]})

    r = ready.mapInPandas(train, "weights binary, losses array<double>, accuracies array<double>", barrier=True).collect()[0]  # one row: the model
    return Network(shaped(np.frombuffer(bytes(r["weights"])), sizes), list(r["losses"]), list(r["accuracies"]))


def predict(model: Network, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, y_pred, probability array of rows (x array<double>); rows without a whole x have nulls."""

    def run(batches):
        for pdf in batches:
            ok = np.array([x is not None and all(v is not None and np.isfinite(v) for v in x) for x in pdf["x"]], bool)
            p, y = [None] * len(pdf), [None] * len(pdf)
            if ok.any():
                for i, v in zip(np.flatnonzero(ok), model.probabilities(np.stack(pdf["x"][ok]).astype(float)), strict=True):
                    p[i], y[i] = v, int(v.argmax())
            yield pdf[keep].assign(y_pred=pd.array(y, dtype="Int32"), probability=p)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "x").mapInPandas(run, f"{kinds}, y_pred int, probability array<double>")
