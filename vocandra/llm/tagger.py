"""A character-level bidirectional LSTM with CRF transitions, in numpy: decoding and training."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "identity", "address", "name")
#: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Codes of characters: printable ASCII, then classes of other letters, digits, signs and the padding.
CODES = 101


def encode(text: str) -> np.ndarray:
    out = np.empty(len(text), np.int16)
    for i, c in enumerate(text):
        o = ord(c)
        out[i] = o - 31 if 32 <= o < 127 else 96 if c.islower() else 97 if c.isupper() else 98 if c.isdigit() else 99 if c.isspace() else 100
    return out


def init(embed: int = 16, hidden: int = 32, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.3, (CODES, embed))}
    for side in ("f", "b"):
        w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden))
        w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0
        w[f"c{side}"] = bias
    w["out"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, LABELS))
    w["bias"] = np.zeros(LABELS)
    w["move"] = np.zeros((LABELS, LABELS))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict[str, np.ndarray], x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
    """x: (time, batch) codes. Hidden states (time, batch, hidden), and what the backward pass needs."""
    steps, batch = x.shape
    size = w[f"h{side}"].shape[0]
    half = np.ones(4 * size, w["embed"].dtype)
    half[: 3 * size] = 0.5
    table = (w["embed"] @ w[f"x{side}"] + w[f"c{side}"]) * half
    recurrent = w[f"h{side}"] * half
    h = c = np.zeros((batch, size), np.float32)
    out = np.empty((steps, batch, size), np.float32)
    kept = []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = h @ recurrent
        z += table[x[t]]
        np.tanh(z, out=z)  # the gates' columns were halved: sigmoid(2a) = (tanh(a) + 1) / 2
        gates = z[:, : 3 * size]
        gates += 1.0
        gates *= 0.5
        g = z[:, 3 * size :]
        before_h, before_c = h, c
        c = gates[:, size : 2 * size] * c + gates[:, :size] * g
        tc = np.tanh(c)
        h = gates[:, 2 * size :] * tc
        out[t] = h
        if keep:
            kept.append((t, gates, g, before_h, before_c, tc))
    return out, kept


def emissions(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    f, _ = _run(w, x, "f", False)
    b, _ = _run(w, x, "b", False)
    return np.concatenate([f, b], axis=2) @ w["out"] + w["bias"]


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """scores: (time, batch, labels). Best labels, (time, batch)."""
    steps, batch, _ = scores.shape
    best = scores[0]
    back = np.empty((steps, batch, LABELS), np.int8)
    into = np.ascontiguousarray(move.T)[None]  # (to, from): the maximum runs along memory
    rows, to = np.arange(batch)[:, None], np.arange(LABELS)[None]
    for t in range(1, steps):
        options = best[:, None, :] + into
        at = options.argmax(2)
        back[t] = at
        best = options[rows, to, at] + scores[t]
    out = np.empty((steps, batch), np.int8)
    out[-1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][rows, out[t]]
    return out


def _crf(scores: np.ndarray, move: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and its gradients by emissions and transitions."""
    steps, batch, n = scores.shape
    alpha = np.empty_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        m = alpha[t - 1][:, :, None] + move[None]
        top = m.max(1)
        alpha[t] = scores[t] + top + np.log(np.exp(m - top[:, None]).sum(1))
    top = alpha[-1].max(1, keepdims=True)
    total = (top + np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True)))[:, 0]
    beta = np.zeros_like(scores[0])
    d_scores = np.empty_like(scores)
    d_move = np.zeros_like(move)
    d_scores[-1] = np.exp(alpha[-1] - total[:, None])
    for t in range(steps - 1, 0, -1):
        joint = alpha[t - 1][:, :, None] + move[None] + (scores[t] + beta)[:, None, :] - total[:, None, None]
        p = np.exp(joint)
        d_move += p.sum(0)
        d_scores[t - 1] = p.sum(2)
        m = move[None] + (scores[t] + beta)[:, None, :]
        top = m.max(2)
        beta = top + np.log(np.exp(m - top[:, :, None]).sum(2))
    rows = np.arange(batch)
    loss = total.sum()
    for t in range(steps):
        loss -= scores[t][rows, gold[t]].sum()
        d_scores[t][rows, gold[t]] -= 1
        if t:
            loss -= move[gold[t - 1], gold[t]].sum()
            np.add.at(d_move, (gold[t - 1], gold[t]), -1)
    return float(loss) / batch, d_scores / batch, d_move / batch


def gradients(w: dict[str, np.ndarray], x: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    steps, batch = x.shape
    runs = {side: _run(w, x, side, True) for side in ("f", "b")}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    loss, d_scores, d_move = _crf(both @ w["out"] + w["bias"], w["move"], gold)
    size = w["hf"].shape[0]
    grad = {"move": d_move, "bias": d_scores.sum((0, 1)), "out": both.reshape(-1, 2 * size).T @ d_scores.reshape(-1, LABELS)}
    d_both = d_scores @ w["out"].T
    grad["embed"] = np.zeros_like(w["embed"])
    for k, side in enumerate(("f", "b")):
        d_h = np.zeros((batch, size), np.float32)
        d_c = np.zeros((batch, size), np.float32)
        d_rec = np.zeros_like(w[f"h{side}"])
        d_table = np.zeros((CODES, 4 * size), np.float32)
        for t, gates, g, before_h, before_c, tc in reversed(runs[side][1]):
            d_h = d_h + d_both[t][:, k * size : (k + 1) * size]
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before_c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
            d_rec += before_h.T @ d_z
            np.add.at(d_table, x[t], d_z)
            d_h = d_z @ w[f"h{side}"].T
            d_c = d_c * f
        grad[f"h{side}"] = d_rec
        grad[f"c{side}"] = d_table.sum(0)
        grad[f"x{side}"] = w["embed"].T @ d_table
        grad["embed"] += d_table @ w[f"x{side}"].T
    return loss, grad


def train(w: dict[str, np.ndarray], batches, rate: float = 0.004, report=None) -> dict[str, np.ndarray]:
    """Adam over batches of (codes, gold), both (time, batch)."""
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    for step, (x, gold) in enumerate(batches, 1):
        loss, grad = gradients(w, x, gold)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        lr = rate / (1 + step / 400)
        for k, g in grad.items():
            g = g * clip
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = (w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if report and step % 50 == 0:
            report(step, loss)
    return w


def spans(labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a label sequence; an inside without a begin opens a span as well."""
    out: list[tuple[int, int, str]] = []
    start, kind = -1, -1
    for i, label in enumerate([*labels.tolist(), 0]):
        here = (label - 1) // 2 if label else -1
        if start >= 0 and (here != kind or (label and label % 2 == 1)):
            out.append((start, i, KINDS[kind]))
            start = -1
        if label and start < 0:
            start, kind = i, here
    return out
