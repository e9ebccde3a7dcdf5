"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, emissions and joint decoding."""

from __future__ import annotations

import numpy as np

#: What the tagger knows: the four kinds that have a pattern, and secrets (keys and tokens), which have none.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Tag 0 is outside; 2k + 1 begins kind k and 2k + 2 goes on with it.
N_TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 32
EMBEDDING, HIDDEN = 12, 16
_OWN_CLASS = "@.-_+%()/:,#=\n '\"$*[]!?;&|<>{}\\~"
N_CLASSES = 6 + len(_OWN_CLASS)


def character_classes(text: str) -> np.ndarray:
    """0 padding, 1 lower, 2 upper, 3 digit, 4 other ASCII, 5 beyond ASCII, then one class for each mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(128, 4, np.int8)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    for i, c in enumerate(_OWN_CLASS):
        table[ord(c)] = 6 + i
    return np.where(codes < 128, table[np.minimum(codes, 127)], np.int8(5))


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"E": rng.normal(0, 0.3, (N_CLASSES, EMBEDDING)), "O": rng.normal(0, 0.2, (2 * HIDDEN, N_TAGS)), "c": np.zeros(N_TAGS), "A": np.zeros((N_TAGS, N_TAGS)), "S": np.zeros(N_TAGS)}
    for d in "fb":
        p[f"X{d}"] = rng.normal(0, EMBEDDING**-0.5, (EMBEDDING, 4 * HIDDEN))
        p[f"H{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p[f"B{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(p: dict, chars: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, 2 * HIDDEN) of both directions over chars (time, batch), and what backward needs.

    Both directions advance in one loop: the second reads the characters from the end.
    """
    drive = np.stack([(p["E"] @ p["Xf"] + p["Bf"])[chars], (p["E"] @ p["Xb"] + p["Bb"])[chars[::-1]]], axis=1)
    inner = np.stack([p["Hf"], p["Hb"]])
    h = c = np.zeros((2, chars.shape[1], HIDDEN), drive.dtype)
    states, saved = np.empty((len(chars), *h.shape), drive.dtype), []
    for t in range(len(chars)):
        z = drive[t] + h @ inner
        gates = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        c_before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[t] = h
        saved.append((gates, g, c_before, h_before, tc))
    return np.concatenate([states[:, 0], states[::-1, 1]], axis=2), saved


def _run_back(p: dict, grads: dict, chars: np.ndarray, d_states: np.ndarray, saved: list) -> None:
    inner = np.stack([p["Hf"], p["Hb"]])
    d_both = np.stack([d_states[:, :, :HIDDEN], d_states[::-1, :, HIDDEN:]], axis=1)
    dh = dc = np.zeros_like(saved[0][2])
    d_drive = np.empty((len(chars), 2, chars.shape[1], 4 * HIDDEN), dh.dtype)
    d_inner = np.zeros_like(inner)
    for t in range(len(chars) - 1, -1, -1):
        gates, g, c_before, h_before, tc = saved[t]
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        dh = dh + d_both[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = d_drive[t]
        dz[..., : 3 * HIDDEN] = np.concatenate([dc * g, dc * c_before, dh * tc], axis=2) * gates * (1 - gates)
        dz[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
        d_inner += h_before.transpose(0, 2, 1) @ dz
        dh, dc = dz @ inner.transpose(0, 2, 1), dc * f
    for k, (d, seen) in enumerate((("f", chars), ("b", chars[::-1]))):
        one_hot = (seen.reshape(-1, 1) == np.arange(N_CLASSES)).astype(d_drive.dtype)
        table = one_hot.T @ d_drive[:, k].reshape(-1, 4 * HIDDEN)
        grads[f"H{d}"], grads[f"B{d}"] = d_inner[k], table.sum(axis=0)
        grads[f"X{d}"] = p["E"].T @ table
        grads["E"] += table @ p[f"X{d}"].T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(p: dict, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of tags (time, batch) given chars (time, batch)."""
    steps, batch = chars.shape
    states, saved = _run(p, chars)
    e = states @ p["O"] + p["c"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = p["S"] + e[0]
    for t in range(1, steps):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + p["A"], 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(p["A"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _logsum(alpha[-1], 1)
    rows = np.arange(batch)
    gold = p["S"][tags[0]] + p["A"][tags[:-1], tags[1:]].sum(axis=0) + np.take_along_axis(e, tags[:, :, None], 2).squeeze(2).sum(axis=0)
    de = np.exp(alpha + beta - log_z[None, :, None])
    grads = {"S": de[0].sum(axis=0) - np.bincount(tags[0], minlength=N_TAGS), "E": np.zeros_like(p["E"])}
    pairs = np.zeros_like(p["A"])
    for t in range(1, steps):
        pairs += np.exp(alpha[t - 1][:, :, None] + p["A"] + (e[t] + beta[t] - log_z[:, None])[:, None, :]).sum(axis=0)
    pairs -= np.bincount((tags[:-1].astype(int) * N_TAGS + tags[1:]).ravel(), minlength=N_TAGS * N_TAGS).reshape(N_TAGS, N_TAGS)
    grads["A"] = pairs
    for t in range(steps):
        de[t, rows, tags[t]] -= 1
    grads["c"], grads["O"] = de.sum(axis=(0, 1)), np.tensordot(states, de, ([0, 1], [0, 1]))
    _run_back(p, grads, chars, de @ p["O"].T, saved)
    return float((log_z - gold).sum() / batch), {k: g / batch for k, g in grads.items()}


def train(chars: np.ndarray, tags: np.ndarray, epochs: int, seed: int, batch: int = 64, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam over windows (count, WINDOW); the seed fixes the result."""
    rng = np.random.default_rng(seed)
    p = {k: x.astype(np.float32) for k, x in new_parameters(rng).items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    n_steps, step = epochs * (len(chars) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(chars))
        for s in range(0, len(order) - batch + 1, batch):
            rows = order[s : s + batch]
            _, grads = loss_and_gradients(p, chars[rows].T, tags[rows].T)
            size = np.sqrt(sum((g * g).sum() for g in grads.values()))
            step += 1
            now = rate * (1 - 0.9 * step / n_steps)
            for k in p:
                g = (grads[k] * min(1.0, 5.0 / (size + 1e-9))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def emissions(p: dict, windows: np.ndarray, batch: int = 512) -> np.ndarray:
    """(count, WINDOW, N_TAGS) for windows of character classes (count, WINDOW)."""
    out = np.empty((*windows.shape, N_TAGS), np.float32)
    for s in range(0, len(windows), batch):
        chars = windows[s : s + batch].T
        states = _run(p, chars)[0]
        out[s : s + batch] = (states @ p["O"] + p["c"]).transpose(1, 0, 2)
    return out


def best_tags(p: dict, scores: np.ndarray) -> np.ndarray:
    """The best joint tag sequence for scores (length, N_TAGS); going on without a begin is forbidden."""
    allowed = p["A"].copy()
    for k in range(len(KINDS)):
        go_on = 2 * k + 2
        others = [t for t in range(N_TAGS) if t not in (go_on, go_on - 1)]
        allowed[others, go_on] = -1e6
    first = p["S"].copy()
    first[2::2] = -1e6
    best, back = first + scores[0], np.empty((len(scores), N_TAGS), np.int8)
    for t in range(1, len(scores)):
        ways = best[:, None] + allowed
        back[t] = ways.argmax(axis=0)
        best = ways[back[t], np.arange(N_TAGS)] + scores[t]
    out = np.empty(len(scores), np.int8)
    out[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out
