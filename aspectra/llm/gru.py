"""A gated recurrent language model in numpy with a class-factored output softmax.

Tokens are numbered: words 0..W-1 have output vectors of their own, in classes
of like frequency; numbers from W on are groups of rarer words, each a class by
itself. The model gives log p(class | state) and, for words, log p(word | class,
state); what a rare word's share of its group is, the caller knows from counts.
"""

from __future__ import annotations

import io

import numpy as np

HIDDEN, WINDOW = 16, 32
LANES, FLUSH = 2048, 1 << 14


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    np.multiply(x, np.float32(0.5), out=x)
    np.add(x, np.float32(0.5), out=x)
    return x


def _log_share(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax of each column of logits at its target; the logits are used up."""
    x -= x.max(axis=0)
    picked = x[target, np.arange(len(target))]
    np.exp(x, out=x)
    return picked - np.log(np.ones(len(x), x.dtype) @ x)


def _minus_target(x: np.ndarray, target: np.ndarray) -> float:
    """Turns each column of logits into probabilities less one at the target; returns the targets' log-likelihood."""
    columns = np.arange(len(target))
    x -= x.max(axis=0)
    picked = x[target, columns]
    np.exp(x, out=x)
    total = np.ones(len(x), x.dtype) @ x
    x /= total
    x[target, columns] -= 1
    return float((picked - np.log(total)).sum())


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """Places in rising order of the numbers, equal ones as they stand; small numbers are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


class GruModel:
    """Parameters: inputs (tokens and a start mark by 3H), recurrent (H by 3H), classes, words."""

    NAMES = ("inputs", "recurrent", "class_out", "class_bias", "word_out", "word_bias")

    def __init__(self, word_counts: np.ndarray, group_counts: np.ndarray, classes: int, hidden: int = HIDDEN, seed: int = 9):
        rng = np.random.default_rng(seed)
        words, groups = len(word_counts), len(group_counts)
        mass = np.cumsum(np.sqrt(word_counts)) if words else np.zeros(0)
        bins = np.minimum((mass - 1e-9) / mass[-1] * classes, classes - 1).astype(np.int64) if words else np.zeros(0, np.int64)
        used, word_class = np.unique(bins, return_inverse=True)
        self.first = np.searchsorted(word_class, np.arange(len(used) + 1))  # word_counts fall, so classes are runs
        self.word_class, self.words, self.hidden = word_class, words, hidden
        self.token_class = np.concatenate([word_class, len(used) + np.arange(groups)]).astype(np.int64)
        by_class = np.concatenate([np.bincount(word_class, word_counts, len(used)) if words else np.zeros(0), group_counts])
        small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        self.inputs, self.recurrent = small(words + groups + 1, 3 * hidden), small(hidden, 3 * hidden)
        self.class_out, self.word_out = np.zeros((hidden, len(by_class)), np.float32), np.zeros((words, hidden), np.float32)
        self.class_bias = np.log((by_class + 0.5) / (by_class + 0.5).sum()).astype(np.float32)
        self.word_bias = np.log(word_counts + 0.5).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what backpropagation needs: update and reset gates, candidate, recurrent part."""
        d, x, m = self.hidden, self.inputs[tokens], h @ self.recurrent
        gates = _sigmoid(x[:, : 2 * d] + m[:, : 2 * d])
        z, r, inner = gates[:, :d], gates[:, d:], m[:, 2 * d :]
        n = np.tanh(x[:, 2 * d :] + r * inner)
        return n + z * (h - n), z, r, n, inner

    def run(self, h: np.ndarray, fed: np.ndarray) -> tuple[np.ndarray, ...]:
        """States (the given one first), gates (update, reset), candidates and recurrent parts of all steps, from the tokens fed (steps x lanes).

        Lanes are the last axis, so that each gate of a step is one run of memory.
        """
        (steps, lanes), d = fed.shape, self.hidden
        x = np.ascontiguousarray(self.inputs[fed].transpose(0, 2, 1))
        states, gates, c, inner = (np.empty((n, k, lanes), x.dtype) for n, k in ((steps + 1, d), (steps, 2 * d), (steps, d), (steps, d)))
        states[0] = h.T
        recurrent = np.ascontiguousarray(self.recurrent.T)
        for t in range(steps):
            before, after, gate, new = states[t], states[t + 1], gates[t], c[t]
            m = recurrent @ before
            inner[t] = m[2 * d :]
            np.add(x[t, : 2 * d], m[: 2 * d], out=gate)
            _sigmoid(gate)
            np.multiply(gate[d:], m[2 * d :], out=new)
            new += x[t, 2 * d :]
            np.tanh(new, out=new)
            np.subtract(before, new, out=after)
            after *= gate[:d]
            after += new
        return states, gates, c, inner

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of p(class) and, for words, p(word | class) after each state."""
        logits = self.class_out.T @ states.T
        logits += self.class_bias[:, None]
        out = _log_share(logits, self.token_class[targets]).astype(np.float64)
        for rows, a, b in self._by_class(targets):
            if b - a > 1:
                inner = self.word_out[a:b] @ states[rows].T
                inner += self.word_bias[a:b, None]
                out[rows] += _log_share(inner, targets[rows] - a)
        return out

    def _by_class(self, targets: np.ndarray):
        words = np.flatnonzero(targets < self.words)
        if not len(words):
            return
        kind = self.word_class[targets[words]]
        order = _order(kind, len(self.class_bias))
        words, kind = words[order], kind[order]
        edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            c = kind[s]
            yield words[s:e], int(self.first[c]), int(self.first[c + 1])

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Log-likelihood of whole documents; the state goes on from window to window to the end."""
        total = np.zeros(len(documents))
        lengths = np.array([len(d) for d in documents], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), LANES):
            lane = order[a : a + LANES]
            self._score_lanes([documents[i] for i in lane], lengths[lane], lane, total)
        return total

    def _score_lanes(self, documents: list[np.ndarray], lengths: np.ndarray, lane: np.ndarray, total: np.ndarray) -> None:
        flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        start = np.cumsum(lengths) - lengths
        h = np.zeros((len(documents), self.hidden), np.float32)
        before = np.full(len(documents), len(self.inputs) - 1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> None:
            states, targets, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            for s in range(0, len(targets), FLUSH):
                part = slice(s, s + FLUSH)
                np.add.at(total, rows[part], self.log_likelihood(states[part], targets[part]))
            held.clear()

        alive = len(documents)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            while alive and lengths[alive - 1] <= t:
                alive -= 1
            h = self.step(h[:alive], before[:alive])[0]
            target = flat[start[:alive] + t]
            held.append((h, target, lane[:alive]))
            before = target
            size += alive
            if size >= FLUSH:
                settle()
                size = 0
        if held:
            settle()


class Trainer:
    """Truncated backpropagation over windows with Adam; the state before a window is handed in, or made of the tokens before it."""

    def __init__(self, model: GruModel, rate: float = 0.01):
        self.model, self.rate, self.updates = model, rate, 0
        self.mean = [np.zeros_like(p) for p in model.parameters()]
        self.square = [np.zeros_like(p) for p in model.parameters()]
        self.grads = [np.zeros_like(p) for p in model.parameters()]
        self.held = 0

    def start(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """State and last token before a document begins."""
        return np.zeros((lanes, self.model.hidden), np.float32), np.full(lanes, len(self.model.inputs) - 1)

    def update(self, warm: np.ndarray, window: np.ndarray) -> float:
        """warm, window: tokens by lane, padded with -1 (warm at its start, window at its end)."""
        h, before = self.start(len(window))
        for t in range(warm.shape[1]):
            token = warm[:, t]
            on = token >= 0
            if on.any():
                new = self.model.step(h, before)[0]
                h = np.where(on[:, None], new, h)
                before = np.where(on, token, before)
        return self.carry(h, before, window)[0]

    def carry(self, h: np.ndarray, before: np.ndarray, window: np.ndarray, least: int = 1) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss by token, and state and last token after the window, of use where it has no padding.

        Gradients wait until they come from `least` tokens, so that a few lanes do not make updates of their own.
        """
        m, d = self.model, self.model.hidden
        lanes, steps = window.shape
        fed = np.concatenate([before[:, None], window[:, :-1]], axis=1).T.copy()
        fed[fed < 0] = len(m.inputs) - 1
        states, gates, c, inner = m.run(h, fed)
        z, r = gates[:, :d], gates[:, d:]
        flat = window.T.ravel()
        on = np.flatnonzero(flat >= 0)
        targets = flat[on]
        after = states[1:].transpose(0, 2, 1).reshape(-1, d)[on]
        d_inputs, d_recurrent, d_class, d_class_bias, d_word, d_word_bias = self.grads
        d_logits = m.class_out.T @ after.T
        d_logits += m.class_bias[:, None]
        loss = _minus_target(d_logits, m.token_class[targets])
        d_class += after.T @ d_logits.T
        d_class_bias += d_logits.sum(axis=1)
        d_states = d_logits.T @ m.class_out.T
        order = _order(m.token_class[targets], len(m.class_bias))
        order = order[: np.searchsorted(targets[order] >= m.words, True)]  # groups come after all classes of words
        own, word = after[order], targets[order]
        d_own = np.zeros_like(own)
        edges = np.searchsorted(m.word_class[word], np.arange(len(m.first))).tolist() if m.words else []
        for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            a, b = int(m.first[k]), int(m.first[k + 1])
            if s < e and b - a > 1:
                d_inner = m.word_out[a:b] @ own[s:e].T
                d_inner += m.word_bias[a:b, None]
                loss += _minus_target(d_inner, word[s:e] - a)
                d_word[a:b] += d_inner @ own[s:e]
                d_word_bias[a:b] += d_inner.sum(axis=1)
                np.matmul(d_inner.T, m.word_out[a:b], out=d_own[s:e])
        d_states[order] += d_own
        spread = np.zeros((steps * lanes, d), d_states.dtype)
        spread[on] = d_states
        spread = np.ascontiguousarray(spread.reshape(steps, lanes, d).transpose(0, 2, 1))
        rest = 1 - z
        by_c, by_z, by_r = rest * (1 - c * c), (states[:-1] - c) * z * rest, inner * r * (1 - r)
        d_x = np.empty((steps, 3 * d, lanes), d_states.dtype)
        d_m = np.empty((3 * d, lanes), d_states.dtype)
        d_h = np.zeros((d, lanes), d_states.dtype)
        for t in range(steps - 1, -1, -1):
            d_h += spread[t]
            row = d_x[t]
            d_c = row[2 * d :]
            np.multiply(d_h, by_c[t], out=d_c)
            np.multiply(d_h, by_z[t], out=row[:d])
            np.multiply(d_c, by_r[t], out=row[d : 2 * d])
            d_m[: 2 * d] = row[: 2 * d]
            np.multiply(d_c, r[t], out=d_m[2 * d :])
            d_recurrent += states[t] @ d_m.T
            d_h *= z[t]
            d_h += m.recurrent @ d_m
        d_x = d_x.transpose(0, 2, 1).reshape(-1, 3 * d)
        order = _order(fed.ravel(), len(m.inputs))
        token = fed.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        d_inputs[token[first]] += np.add.reduceat(d_x[order], first, axis=0)
        self.held += len(on)
        if self.held >= least:
            self.settle()
        return -loss / max(len(on), 1), states[-1].T.copy(), window[:, -1]

    def settle(self) -> None:
        """An update by the mean of the gradients that wait."""
        if self.held:
            for g in self.grads:
                g /= self.held
            self._adam(self.grads)
            for g in self.grads:
                g[...] = 0
            self.held = 0

    def _adam(self, grads: list[np.ndarray]) -> None:
        self.updates += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        scale = min(1.0, 1.0 / (norm + 1e-12))
        a, b = 0.9, 0.98
        rate = self.rate * np.sqrt(1 - b**self.updates) / (1 - a**self.updates)
        for p, g, m, v in zip(self.model.parameters(), grads, self.mean, self.square, strict=True):
            g *= scale
            m *= a
            m += (1 - a) * g
            g *= g
            v *= b
            v += (1 - b) * g
            np.sqrt(v, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate
            p -= g


def to_bytes(flat: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, flat.astype(np.float32))
    return out.getvalue()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw))
