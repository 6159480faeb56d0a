"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; the probabilities of its letters are pooled for the document. It is
trained in numpy by backpropagation through time on a bounded sample of labelled rows, and runs in the tasks
over whole texts, cut into chunks that stand side by side in a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_names, hash_below, map_texts, with_text_column

#: Labelled rows of each language that the network is fitted on, about; windows of a row; bytes of a window.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 400, 4, 64
HIDDEN, STEPS, BATCH, RATE = 8, 500, 192, 0.02
#: Bytes of a chunk when the network runs, and chunks side by side.
CHUNK, SIDE = 128, 2048

UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights of two directions, each (input table 256 x 3H, recurrent H x 3H), and of the output layer."""

    langs: list[str]
    inputs: list[np.ndarray]
    loops: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(langs, [draw(256, 3 * hidden) for _ in "fb"], [draw(hidden, 3 * hidden) for _ in "fb"], draw(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.loops, self.out, self.bias]

    def states(self, x: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of the bytes x (T, B) in one direction; keep: gets what the gradient needs."""
        table, loop = self.inputs[way], self.loops[way]
        size = loop.shape[0]
        h = np.zeros((x.shape[1], size), np.float32)
        states = np.empty((*x.shape, size), np.float32)
        for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            a, u = table.take(x[t], 0), h @ loop
            gates = _sigmoid(a[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            n = np.tanh(a[:, 2 * size :] + r * u[:, 2 * size :])
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * size :]))
            h = n + z * (h - n)
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, languages) of every position."""
        logits = np.concatenate([self.states(x, 0), self.states(x, 1)], 2) @ self.out + self.bias
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of the windows x (T, B) with labels y (B), and its gradients."""
        kept: list[list] = [[], []]
        size = self.loops[0].shape[0]
        both = np.concatenate([self.states(x, w, kept[w]) for w in (0, 1)], 2)
        logits = both @ self.out + self.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        at = np.arange(x.shape[1])
        loss = float(-np.log(p[:, at, y] + 1e-9).mean())
        d = p
        d[:, at, y] -= 1
        d /= x.size
        d_out, d_bias = np.einsum("tbi,tbk->ik", both, d), d.sum((0, 1))
        d_both = d @ self.out.T
        d_inputs, d_loops = [], []
        for w in (0, 1):
            d_table, d_loop = np.zeros_like(self.inputs[w]), np.zeros_like(self.loops[w])
            dh = np.zeros((x.shape[1], size), np.float32)
            for t, h, z, r, n, un in reversed(kept[w]):
                dh = dh + d_both[t, :, w * size : (w + 1) * size]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                du = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(d_table, x[t], da)
                d_loop += h.T @ du
                dh = dh * z + du @ self.loops[w].T
            d_inputs.append(d_table)
            d_loops.append(d_loop)
        return loss, [*d_inputs, *d_loops, d_out, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Fit a network to byte windows (N, T) with label indexes; each step draws as many of each language."""
    net = Network.fresh(langs, seed)
    rng = np.random.default_rng(seed)
    by_lang = [np.flatnonzero(labels == i) for i in range(len(langs))]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, max(1, BATCH // len(langs))) for rows in by_lang])
        _, grads = net.gradients(windows[pick].T, labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def normal_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


def sample_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, window) for a bounded sample of the labelled rows: ``rows`` of each language, or all that it has, the same on each run.

    Rows stand in the order of a hash; from each come windows at places spread over its whole text."""
    known = docs.where("lang is not null and text is not null and length(text) > 0")
    counts = known.groupBy("lang").count().collect()  # a row for each language
    part = F.xxhash64(F.lit("sample"), "doc_id", F.length("text"))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], 2.0 * rows / r["count"])]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    near = known.where(hash_below(part, share[F.col("lang")])).select("lang", "text", part.alias("_part"))

    def make():
        def call(texts):
            at, out = [], []
            for i, text in enumerate(texts):
                raw = normal_bytes(text)
                rng = np.random.default_rng(len(raw))
                for start in rng.integers(0, max(1, len(raw) - WINDOW + 1), SAMPLE_WINDOWS):
                    at.append(i)
                    out.append(raw[start : start + WINDOW].tobytes().ljust(WINDOW, b" "))
            return at, {"window": out}

        return call

    windows = map_texts(near, ["lang", "_part"], make, "window binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_part", "window"))  # some 2 * rows * SAMPLE_WINDOWS narrow rows a language
    return windows.withColumn("_nth", nth).where(F.col("_nth") <= rows * SAMPLE_WINDOWS).select("lang", "window").orderBy("lang", "window")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """Train on the labelled rows of ``docs`` (columns doc_id, text, lang); None if there are none."""
    found = sample_windows(docs, rows).collect()  # at most rows x languages x SAMPLE_WINDOWS windows of WINDOW bytes
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return None
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in found), np.uint8).reshape(len(found), WINDOW)
    return train(windows, np.array([langs.index(r["lang"]) for r in found]), langs)


def label_texts(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text; ``und`` and 0 if it is null or has no letter."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
    if not at:
        return langs, scores
    raws = [normal_bytes(texts[i]) for i in at]
    sizes = np.array([-(-len(r) // CHUNK) for r in raws])
    ends = np.cumsum(sizes)
    flat = np.zeros((int(ends[-1]), CHUNK), np.uint8)
    for r, e, n in zip(raws, ends, sizes):
        flat[e - n : e].reshape(-1)[: len(r)] = r
    pooled = np.zeros((len(flat), len(net.langs)))
    for i in range(0, len(flat), SIDE):
        x = np.ascontiguousarray(flat[i : i + SIDE].T)
        p = net.probabilities(x)
        p *= _LETTER[x][:, :, None]
        pooled[i : i + SIDE] = p.sum(0)
    docs = np.add.reduceat(pooled, ends - sizes, 0)
    docs /= np.maximum(docs.sum(1, keepdims=True), 1e-9)
    for i, p in zip(at, docs):
        k = int(p.argmax())
        langs[i], scores[i] = net.langs[k], float(min(1.0, p[k]))
    return langs, scores


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id of each row, lang_pred and score (pooled probability, 0 to 1) of its whole text.

    ``und`` and 0 for texts that are null, empty or without a letter, and for all if nothing could be learned.
    Repeated rows are judged each; further columns, of whatever names, are no input."""

    def make():
        def call(texts):
            langs, scores = label_texts(net, texts)
            return None, {"lang_pred": langs, "score": scores}

        return call

    return map_texts(docs, ["doc_id"], make, "lang_pred string, score double")


def keep_identified(docs: DataFrame, train_on: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` in a language that the network knows: not ``und``, pooled probability ``least`` or more.

    Null and empty texts, and those without a letter, go, and all rows if nothing could be learned; repeated rows
    are judged each; all columns are kept, whatever their names."""
    net = fit(train_on)
    (known,) = free_names(docs, "known")
    call = lambda texts: [lang != UNKNOWN and score >= least for lang, score in zip(*label_texts(net, texts))]
    return with_text_column(docs, known, lambda: call, "boolean").where(F.col(known)).select(*docs.columns)
