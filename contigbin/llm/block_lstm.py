"""A bidirectional LSTM in numpy that labels every block of a sequence, and its training.

Vectors go through a dense layer, then through one LSTM in page order and one
against it; the label's logit is linear in both states and the layer's output. Sequences of a batch are
padded to the right; for the second LSTM each is turned around within its length.
"""

from __future__ import annotations

import numpy as np

EMBEDDED, HIDDEN = 32, 24


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def initial(size: int, seed: int, embedded: int = EMBEDDED, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    out = {"embed": draw(size, embedded) * np.float32((size / 40) ** 0.5), "embed_bias": zeros(embedded), "out": draw(2 * hidden + embedded, 1), "out_bias": zeros(1)}
    for side in ("there", "back"):
        bias = zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1  # remember at first
        out |= {f"{side}_in": draw(embedded, 4 * hidden), f"{side}_state": draw(hidden, 4 * hidden), f"{side}_bias": bias}
    return out


def turned(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Places that turn each sequence around within its length."""
    at = np.arange(steps)[None, :]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def _scan(given: np.ndarray, state: np.ndarray, keep: bool):
    """States over time from gate inputs (rows, steps, 4 * hidden); with ``keep`` what the way back needs."""
    rows, steps, wide = given.shape
    n = wide // 4
    h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    states, kept = np.zeros((rows, steps, n), np.float32), []
    for t in range(steps):
        g = given[:, t] + h @ state
        s = sigmoid(g[:, : 3 * n])
        i, f, o, new = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
        before, c = c, f * c + i * new
        out = np.tanh(c)
        if keep:
            kept.append((i, f, o, new, before, out, h))
        h = o * out
        states[:, t] = h
    return states, kept


def _scan_back(upward: np.ndarray, kept: list, state: np.ndarray):
    """Gradients of gate inputs and of the state matrix."""
    rows, steps, n = upward.shape
    to_given, to_state = np.zeros((rows, steps, 4 * n), np.float32), np.zeros_like(state)
    dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, new, before, out, h = kept[t]
        dh = dh + upward[:, t]
        dc = dc + dh * o * (1 - out * out)
        d = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * out * o * (1 - o), dc * i * (1 - new * new)], 1)
        to_given[:, t] = d
        to_state += h.T @ d
        dh, dc = d @ state.T, dc * f
    return to_given, to_state


def logits(model: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """x: (rows, steps, size) padded to the right. The logit of each block."""
    turn = turned(lengths, x.shape[1])[:, :, None]
    z = np.tanh(x @ model["embed"] + model["embed_bias"])
    back = np.take_along_axis(z, turn, 1)
    there, kept_there = _scan(z @ model["there_in"] + model["there_bias"], model["there_state"], keep)
    other, kept_back = _scan(back @ model["back_in"] + model["back_bias"], model["back_state"], keep)
    both = np.concatenate([there, np.take_along_axis(other, turn, 1), z], 2)
    out = (both @ model["out"] + model["out_bias"])[:, :, 0]
    return (out, (z, back, turn, both, kept_there, kept_back)) if keep else out


def gradients(model: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over all blocks and its gradients."""
    out, (z, back, turn, both, kept_there, kept_back) = logits(model, x, lengths, True)
    mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
    p, n = sigmoid(out), mask.sum()
    loss = -(np.log(np.where(labels > 0, p, 1 - p) + 1e-7) * mask).sum() / n
    d = ((p - labels) * mask / n).astype(np.float32)[:, :, None]
    grads, half = {}, model["there_state"].shape[0]
    flat = lambda a: a.reshape(-1, a.shape[-1])
    grads["out"], grads["out_bias"] = flat(both).T @ flat(d), d.sum((0, 1))
    to_both = d @ model["out"].T
    to_there, grads["there_state"] = _scan_back(to_both[:, :, :half], kept_there, model["there_state"])
    to_back, grads["back_state"] = _scan_back(np.take_along_axis(to_both[:, :, half : 2 * half], turn, 1), kept_back, model["back_state"])
    grads["there_in"], grads["there_bias"] = flat(z).T @ flat(to_there), to_there.sum((0, 1))
    grads["back_in"], grads["back_bias"] = flat(back).T @ flat(to_back), to_back.sum((0, 1))
    to_z = to_there @ model["there_in"].T + np.take_along_axis(to_back @ model["back_in"].T, turn, 1) + to_both[:, :, 2 * half :]
    to_z *= 1 - z * z
    grads["embed"], grads["embed_bias"] = flat(x).T @ flat(to_z), to_z.sum((0, 1))
    return float(loss), grads


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all sequences (steps, size), and their lengths."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), int(lengths.max(initial=0)), *sequences[0].shape[1:]), np.float32)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = s
    return out, lengths


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int, batch: int = 32, rate: float = 0.008, dropped: float = 0.1) -> dict[str, np.ndarray]:
    """A model from pages of (vectors, labels) by Adam; a share of the vectors' fields is left out at random in each step."""
    rng = np.random.default_rng(seed)
    model = initial(pages[0][0].shape[1], seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(pages) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        near = sorted(np.array_split(order, -(-len(order) // (batch * 8))), key=len)
        chunks = [c for group in near for c in np.array_split(group[np.argsort([len(pages[k][1]) for k in group])], -(-len(group) // batch))]
        for at in rng.permutation(len(chunks)):
            x, lengths = padded([pages[k][0] for k in chunks[at]])
            x *= rng.random((len(x), 1, x.shape[2]), dtype=np.float32) >= dropped
            labels, _ = padded([pages[k][1] for k in chunks[at]])
            _, grads = gradients(model, x, lengths, labels)
            size = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))))
            step += 1
            slow = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in grads.items():
                g = g / size
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.005 * (g * g - second[k])
                model[k] -= (slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return model
