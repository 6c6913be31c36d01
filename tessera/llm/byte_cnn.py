"""A byte-level convolutional network in numpy.

Bytes are embedded, filters of ``WIDTH`` bytes run over the whole text, and their
responses are max-pooled in chunks of ``CHUNK`` bytes that overlap by half. A small hidden
layer looks at each chunk; its outputs are combined over the chunks (mean and
max) into one probability. Backward passes touch only the positions that won a
maximum, so training costs little more than scoring.

A text is followed by ``WIDTH`` zero bytes, so that the windows reach its last byte and a short
text has one too. Filters run over ``SLICE`` blocks at a time: beyond a copy of the text,
memory grows by about two bytes for each byte of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessera.llm import kernel as K

WIDTH = 8
STRIDE = 2
EMBED = 6
FILTERS = 24
HIDDEN = 16
CHUNK = 256
THRESHOLD = 0.3
_STEP = CHUNK // 2


#: Blocks (half chunks) whose windows are convolved at a time.
SLICE = 1024


def _layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the padded bytes) and number of windows of each block, row of each block, first block of each row.

    An empty text has one block without windows.
    """
    length = np.diff(offsets)
    n = np.where(length > 0, np.maximum(1, -(-(length - WIDTH) // STRIDE) + 1), 0)
    per = _STEP // STRIDE
    blocks = np.maximum(1, -(-n // per))
    base = np.cumsum(blocks) - blocks
    row = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(row)) - base[row]
    starts = (offsets[:-1] + WIDTH * np.arange(len(n)))[row] + nth * _STEP
    return starts, np.clip(n[row] - nth * per, 0, per), row, base


def _padded(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with WIDTH zeros after each text."""
    out = np.zeros(len(a) + WIDTH * (len(offsets) - 1), np.uint8)
    for r, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[lo + WIDTH * r : hi + WIDTH * r] = a[lo:hi]
    return out


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = np.float32
        return Network(
            {
                "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f),
                "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
                "filter_bias": np.zeros(FILTERS, f),
                "hidden": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f),
                "hidden_bias": np.full(HIDDEN, 0.1, f),
                "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(f),
                "out_bias": np.zeros(1, f),
            }
        )

    def pool(self, padded: np.ndarray, starts: np.ndarray, count: np.ndarray, peaks: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest response of each filter in each block, and if asked for where the window of it begins."""
        p = self.p
        out = np.zeros((len(count), FILTERS), p["filters"].dtype)
        peak = np.zeros(out.shape, np.int64) if peaks else None
        for lo in range(0, len(count), SLICE):
            own = count[lo : lo + SLICE]
            filled = np.flatnonzero(own)
            if not len(filled):
                continue
            block = lo + np.repeat(np.arange(len(own)), own)
            inside = K.concat(own)
            at = starts[block] + STRIDE * inside
            first, end = int(at[0]), int(at[-1]) + WIDTH
            e = p["embed"][padded[first:end]]
            flat = np.lib.stride_tricks.as_strided(e, (end - first - WIDTH + 1, WIDTH * EMBED), (e.strides[0], e.strides[1]), writeable=False)
            response = flat[at - first] @ p["filters"]
            cut = (np.cumsum(own) - own)[filled]
            out[lo + filled] = np.maximum(np.maximum.reduceat(response, cut, axis=0) + p["filter_bias"], 0)
            if peaks:
                w, f = np.nonzero(np.maximum(response + p["filter_bias"], 0) == out[block])
                peak[block[w], f] = at[w]
        return out, peak

    def forward(self, a: np.ndarray, offsets: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logit of every text of a run; with keep, also what a backward pass needs."""
        p = self.p
        starts, count, row_of_block, base = _layout(offsets)
        n_blocks = len(row_of_block)
        padded = _padded(a, offsets)
        pooled, peak = self.pool(padded, starts, count, keep)
        chunk = pooled.copy()
        same = np.flatnonzero(row_of_block[1:] == row_of_block[:-1])
        chunk[same] = np.maximum(pooled[same], pooled[same + 1])
        hidden = np.maximum(chunk @ p["hidden"] + p["hidden_bias"], 0)
        n = np.diff(np.append(base, n_blocks))
        mean = np.add.reduceat(hidden, base, axis=0) / n[:, None]
        most = np.maximum.reduceat(hidden, base, axis=0)
        logit = np.concatenate([mean, most], 1) @ p["out"] + p["out_bias"]
        if not keep:
            return logit, {}
        return logit, {"padded": padded, "peak": peak, "row": row_of_block, "n": n, "pooled": pooled, "chunk": chunk, "same": same, "hidden": hidden, "mean": mean, "most": most}

    def backward(self, c: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, row = self.p, c["row"]
        g = {"out": np.concatenate([c["mean"], c["most"]], 1).T @ slope, "out_bias": slope.sum(keepdims=True)}
        d_hidden = (slope / c["n"])[row, None] * p["out"][:HIDDEN]
        won = c["hidden"] == c["most"][row]
        first = np.zeros_like(won)
        r, h = np.nonzero(won)
        _, at = np.unique(row[r].astype(np.int64) * HIDDEN + h, return_index=True)
        first[r[at], h[at]] = True
        d_hidden += first * (slope[row, None] * p["out"][HIDDEN:])
        d_hidden *= c["hidden"] > 0
        g["hidden"], g["hidden_bias"] = c["chunk"].T @ d_hidden, d_hidden.sum(0)
        d_chunk = d_hidden @ p["hidden"].T
        d_block = d_chunk.copy()
        same = c["same"]
        from_next = c["pooled"][same + 1] > c["pooled"][same]
        moved = np.where(from_next, d_chunk[same], 0)
        d_block[same] -= moved
        np.add.at(d_block, same + 1, moved)
        d_block *= c["pooled"] > 0
        g["filter_bias"] = d_block.sum(0)
        g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        block, f = np.nonzero(d_block)
        windows = c["padded"][c["peak"][block, f][:, None] + np.arange(WIDTH)]
        d = d_block[block, f]
        inputs = p["embed"][windows].reshape(len(d), -1)
        order = np.argsort(f, kind="stable")
        cuts = np.searchsorted(f[order], np.arange(FILTERS + 1))
        for k in range(FILTERS):
            own = order[cuts[k] : cuts[k + 1]]
            g["filters"][:, k] = d[own] @ inputs[own]
        d_inputs = (d[:, None] * p["filters"].T[f]).reshape(-1, EMBED)
        for j in range(EMBED):
            g["embed"][:, j] = np.bincount(windows.ravel(), d_inputs[:, j], 256)
        return g

    def scores(self, a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.forward(a, offsets)[0].astype(np.float64) + self.shift, -40, 40)))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, rate: float = 4e-3, batch: int = 32, seed: int = 5) -> Network:
    """Fits a network by Adam, the labels weighing equally. Without both labels, the score is the constant share of label 1."""
    net = Network.fresh(seed)
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.5
        net.scale, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    rng = np.random.default_rng(seed)
    test = rng.random(len(texts)) < 0.2
    own = np.flatnonzero(~test)
    weight = np.where(labels > 0, 0.5 / max(1, labels[own].sum()), 0.5 / max(1, (1 - labels[own]).sum())) * len(own)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            logit, kept = net.forward(*joined([texts[k] for k in part]), keep=True)
            slope = ((1 / (1 + np.exp(-logit)) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in net.backward(kept, slope).items():
                g = g.astype(np.float32) + 1e-5 * net.p[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] = net.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    left = np.flatnonzero(test)
    if len(left) and labels[left].min() != labels[left].max():
        logit = np.concatenate([net.forward(*joined([texts[k] for k in part]))[0] for part in np.array_split(left, max(1, len(left) // 64))])
        _calibrate(net, logit.astype(np.float64), labels[left], weight[left])
    return net


def _calibrate(net: Network, logit: np.ndarray, labels: np.ndarray, weight: np.ndarray, at: float = THRESHOLD) -> None:
    """Shifts the scores so that the cut of least error on rows left out of training, a lost good text counting three times, scores ``at``."""
    order = np.argsort(logit, kind="stable")
    ranked, good = logit[order], labels[order] > 0
    w = weight[order]
    loss = np.concatenate([[0.0], np.cumsum(np.where(good, 3 * w, 0))]) + np.concatenate([np.cumsum(np.where(good, 0, w)[::-1])[::-1], [0.0]])
    best = np.flatnonzero(loss == loss.min())
    best = int(best[len(best) // 2])
    cut = ranked[0] - 1e-3 if best == 0 else ranked[-1] + 1e-3 if best == len(ranked) else (ranked[best - 1] + ranked[best]) / 2
    net.shift = float(np.log(at / (1 - at)) - net.scale * cut)
