"""A causal self-attention language model over words spelled in subword ids, in numpy.

A word's vector is the sum of its subwords' rows over the root of their number.  One head attends over the words before, by content
and by distance.  What it gathers, with the vector of the last word, gives weights of `mix` softmaxes over the whole
vocabulary.  The logit of a word in one of them is the logarithm of its frequency and the sum of its subwords' rows of `tilt`, so that a
word's probability is its frequency times the weighted sum of exp(tilt) over each softmax's normaliser.  Long sequences are cut into
overlapping windows: each token is scored once, by the window whose last `step` places hold it, and sees up to `back` tokens more
before those.
"""

from __future__ import annotations

import numpy as np


class Lexicon:
    """Words as runs of rows: `rows` end to end, `lens` of them for each word (one at least)."""

    def __init__(self, rows: np.ndarray, lens: np.ndarray):
        self.rows, self.lens = rows, np.asarray(lens, np.int64)
        self.at = np.cumsum(self.lens) - self.lens

    def used(self, *numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct words of some arrays, the longest first, and the arrays by their places among them."""
        seen = np.zeros(len(self.lens), bool)
        for x in numbers:
            seen[x] = True
        words = np.flatnonzero(seen)
        words = words[np.argsort(-self.lens[words], kind="stable")]
        place = np.zeros(len(seen), np.int32)
        place[words] = np.arange(len(words))
        return words, [place[x] for x in numbers]

    def rows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of some words end to end, how many each has)."""
        lens = self.lens[words]
        begin = np.cumsum(lens) - lens
        return self.rows[np.repeat(self.at[words] - begin, lens) + np.arange(int(lens.sum()))], lens

    def summed(self, table: np.ndarray, words: np.ndarray, loops: int = 16) -> np.ndarray:
        """The sum of the rows of `table` of each word; words in the order of `used`."""
        at, lens = self.at[words], self.lens[words]
        out = table[self.rows[at]]
        for k in range(1, loops):
            n = int(np.searchsorted(-lens, -k))  # those with more than k
            if not n:
                return out
            out[:n] += table[self.rows[at[:n] + k]]
        for j in range(int(np.searchsorted(-lens, -loops))):
            out[j] += table[self.rows[at[j] + loops : at[j] + lens[j]]].sum(0)
        return out


class Attention:
    """Weights by row (subword), spell (n, d + mix): `d` for its vector, `mix` for the logits; and shared ones: query, key, value (d, h), bias by distance, out (h, mix), last (d, mix), prior (mix)."""

    NAMES = ("spell", "query", "key", "value", "bias", "out", "last", "prior")

    def __init__(self, n: int, d: int = 16, h: int = 8, mix: int = 16, back: int = 32, step: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.d, self.back, self.step = d, back, step
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.spell = np.concatenate((draw(n, d, scale=0.5), draw(n, mix, scale=0.2)), 1)
        self.query, self.key, self.value = (draw(d, h, scale=d**-0.5) for _ in range(3))
        self.bias = (-0.05 * np.arange(back + step)).astype(np.float32)
        self.out, self.last, self.prior = draw(h, mix, scale=0.5), draw(d, mix, scale=0.1), np.zeros(mix, np.float32)

    def count(self) -> int:
        return sum(getattr(self, k).size for k in self.NAMES)

    def windows(self, first: np.ndarray, size: np.ndarray):
        """(start of each window, start of its text, end of its text) for texts at `first` with `size` tokens."""
        n = -(-size // self.step)
        text = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return first[text] + k * self.step, first[text], first[text] + size[text]

    def spelled(self, lexicon: Lexicon, words: np.ndarray):
        """(vectors, tilts, roots of the numbers of subwords) of words in the order of `Lexicon.used`."""
        both = lexicon.summed(self.spell, words)
        root = np.sqrt(lexicon.lens[words]).astype(both.dtype)[:, None]
        return both[:, : self.d] / root, np.clip(both[:, self.d :], -30, 30), root

    def _masked(self, start, low, n):
        """Key places of windows, and which of them each may see; the distance bias with its mask; distances."""
        at = start[:, None] + np.arange(-self.back, self.step)
        gap = (self.back + np.arange(self.step))[:, None] - np.arange(self.back + self.step)[None, :]
        add = np.where(gap >= 0, self.bias[np.maximum(gap, 0)], self.bias.dtype.type(-1e9))
        return np.clip(at, 0, n - 1), at, at >= low[:, None], add, gap

    def _weights(self, q, k, add, visible):
        """What each place of a window attends to."""
        w = q @ k.transpose(0, 2, 1)
        w += add
        np.exp(np.minimum(w, 60, out=w), out=w)
        if not visible.all():
            w *= visible[:, None, :]
        w /= np.maximum(np.einsum("bst->bs", w), 1e-30)[:, :, None]
        return w

    def score(self, lexicon: Lexicon, last: np.ndarray, target: np.ndarray, first: np.ndarray, size: np.ndarray, log_z: np.ndarray, batch: int = 96) -> np.ndarray:
        """How many times its frequency each target's probability is, given what is before it.

        last[i] is the word before target[i]; texts lie end to end.  log_z: logarithm of each softmax's normaliser, the mean of exp(tilt) over the vocabulary by frequency.
        """
        n = len(last)
        ratio = np.ones(n, np.float32)
        if not n:
            return ratio
        words, (last, target) = lexicon.used(last, target)
        x, f, _ = self.spelled(lexicon, words)
        scale = np.float32(1 / np.sqrt(self.query.shape[1]))
        q, k, v, own_z = x @ self.query * scale, x @ self.key, x @ (self.value @ self.out), x @ self.last + self.prior
        e = np.exp(f - log_z.astype(np.float32))
        start, low, high = self.windows(first, size)
        for a in range(0, len(start), batch):
            at, raw, visible, add, _ = self._masked(start[a : a + batch], low[a : a + batch], n)
            ids = last[at]
            own = ids[:, self.back :]
            w = self._weights(q[own], k[ids], add, visible)
            z = w @ v[ids]
            z += own_z[own]
            on = raw[:, self.back :] < high[a : a + batch, None]
            place, z = raw[:, self.back :][on], z[on]
            np.exp(np.clip(z, -40, 40, out=z), out=z)
            ratio[place] = np.einsum("ij,ij->i", z, e[target[place]]) / z.sum(1)
        return ratio

    def gradient(self, lexicon: Lexicon, last: np.ndarray, target: np.ndarray, start, low, high):
        """Mean log-loss of some windows beside the words' frequencies, its gradient by each weight, and how often each row was used.

        Normalisers are taken over the windows' own targets, which are words drawn by frequency.
        """
        n, scale = len(last), self.spell.dtype.type(1 / np.sqrt(self.query.shape[1]))
        at, raw, visible, add, gap = self._masked(start, low, n)
        ids, place = last[at], raw[:, self.back :]
        on = place < high[:, None]
        words, (ids, y) = lexicon.used(ids, target[place[on]])
        own = ids[:, self.back :]
        x, f, root = self.spelled(lexicon, words)
        q, k, v = x @ self.query * scale, x @ self.key, x @ self.value
        own_z = x @ self.last + self.prior
        qo, ki, vi = q[own], k[ids], v[ids]
        w = self._weights(qo, ki, add, visible)
        c = (w @ vi)[on]
        mine = own[on]
        z = c @ self.out + own_z[mine]
        np.exp(np.clip(z, -40, 40, out=z), out=z)
        z /= z.sum(1, keepdims=True)
        times = np.bincount(y, minlength=len(words)).astype(f.dtype)
        e = np.exp(f)
        e *= len(y) / (times @ e)  # over the targets
        joint = z * e[y]
        p = joint.sum(1)
        loss = -float(np.log(np.maximum(p, 1e-30)).mean())
        post = joint / np.maximum(p, 1e-30)[:, None]
        weight = post.dtype.type(1 / len(y))
        dz = (z - post) * weight
        grad = {}
        by_m = post.sum(0) * weight
        df = (times[:, None] * e) * (by_m / len(y)) - _summed(y, post, len(words)) * weight
        grad["out"] = c.T @ dz
        dc = np.zeros((*on.shape, self.out.shape[0]), dz.dtype)
        dc[on] = dz @ self.out.T
        ds = dc @ vi.transpose(0, 2, 1)
        dv = w.transpose(0, 2, 1) @ dc
        ds -= np.einsum("bst,bst->bs", ds, w)[:, :, None]
        ds *= w
        grad["bias"] = np.bincount(np.maximum(gap, 0).ravel(), (ds.sum(0) * (gap >= 0)).ravel(), len(self.bias)).astype(dz.dtype)
        h = k.shape[1]
        mine = _summed(mine, np.concatenate(((ds @ ki)[on], dz), 1), len(words))
        dq, d_own = mine[:, :h] * scale, mine[:, h:]
        grad["last"], grad["prior"] = x.T @ d_own, d_own.sum(0)
        both = _summed(ids.ravel(), np.concatenate((ds.transpose(0, 2, 1) @ qo, dv), 2).reshape(-1, 2 * h), len(words))
        dk, dv = both[:, :h], both[:, h:]
        grad["query"], grad["key"], grad["value"] = x.T @ dq, x.T @ dk, x.T @ dv
        dx = (dq @ self.query.T + dk @ self.key.T + dv @ self.value.T + d_own @ self.last.T) / root
        rows, lens = lexicon.rows_of(words)
        word = np.repeat(np.arange(len(words)), lens)
        grad["spell"] = _summed(rows, np.concatenate((dx, df), 1), len(self.spell), word)
        often = times + np.bincount(ids.ravel(), minlength=len(words))
        return loss, grad, np.bincount(rows, often[word], len(self.spell)).astype(np.float32)


class Adam:
    """Adam over a model's weights."""

    def __init__(self, model: Attention, decay: float = 1e-6):
        self.model, self.decay, self.t = model, decay, 0
        self.m, self.v = ({k: np.zeros_like(getattr(model, k)) for k in model.NAMES} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        one, two = 1 - 0.9**self.t, 1 - 0.98**self.t
        for k in self.model.NAMES:
            w, m, v, g = getattr(self.model, k), self.m[k], self.v[k], grad[k]
            g = g + w.dtype.type(self.decay) * w if k == "spell" else g
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            w -= w.dtype.type(rate / one) * m / (np.sqrt(v / two) + w.dtype.type(1e-6))


def _summed(rows: np.ndarray, values: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """For each of n rows the sum of its values; at: which value each row takes, where it is not its own."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
        rows = rows[order]
        cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[cuts]] = np.add.reduceat(values[order if at is None else at[order]], cuts)
    return out
