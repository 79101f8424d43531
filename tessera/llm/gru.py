"""A gated recurrent language model in numpy: one GRU layer, class-factored softmax, truncated backpropagation.

P(word | state) = P(class | state) P(word | class, state), with classes by frequency rank: the SINGLE most frequent words are
classes of their own, then come small classes (word_w, word_b) and large ones (tail_w, tail_b), sized by the square root
of the vocabulary (CLASS at least) so that few logits are needed where words are frequent: of 2^14 words, 24 classes of 48
and 68 of 224. The input table holds each word's contribution to the three gates. Output biases start at the unigram distribution, so training begins from it.
"""

from __future__ import annotations

import math

import numpy as np

CLASS, SINGLE = 32, 4
BLOCK = 1 << 17  # logits at once: they stay in a core's cache
LAYERS = 16  # runs of at most so many rows are summed side by side
CHUNK = 1 << 15  # parameters updated at once
NAMES = ("inputs", "recur", "class_w", "class_b", "word_w", "word_b", "tail_w", "tail_b")


def _exp_sums(logits: np.ndarray, calm: bool) -> np.ndarray:
    """Overwrites logits by their exponentials and gives the sums by row; unless calm, both are divided by the row's largest.
    What is known of the row's sum then is its log, so only ratios to it are right in both cases."""
    if not calm:
        logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[-1], dtype=logits.dtype)


def _residual(own: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray, live: np.ndarray | None, n: int, calm: bool, want: bool) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Softmaxes over own @ w + b side by side: (summed loss, if wanted, and gradients of w, b and own, averaged over n tokens). own is
    softmaxes x rows x states, target softmaxes x rows; rows that are not live count for nothing. Rows are divided by their sums where
    they are as wide as a state."""
    loss, logits = 0.0, own @ w
    logits += b[:, None]
    cells = np.arange(target.size).reshape(target.shape) * b.shape[1] + target
    cell = logits.reshape(-1)
    whole = _exp_sums(logits, calm)
    hit = cell[cells]
    cell[cells] = hit - whole
    if want:
        loss = -np.log(np.maximum(hit / whole, np.finfo(hit.dtype).tiny))
        loss = float((loss if live is None else loss * live).sum(dtype=np.float64))
    whole *= n
    np.reciprocal(whole, out=whole)
    if live is not None:
        whole *= live
    g_own = logits @ w.transpose(0, 2, 1)
    g_own *= whole[:, :, None]
    return loss, (own * whole[:, :, None]).transpose(0, 2, 1) @ logits, (whole[:, None] @ logits)[:, 0], g_own


def _sums(values: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the rows of values[order] from each head to the next: short runs a row of each at a time, long ones singly."""
    sizes = np.diff(heads, append=len(order))
    short = np.where(sizes > LAYERS, 0, sizes)
    by_size = np.argsort(-short, kind="stable")
    first, short = heads[by_size], -short[by_size]
    sums = values.take(order[first], axis=0)
    for k in range(1, LAYERS):
        runs = int(np.searchsorted(short, -k))  # those of more than k rows
        sums[:runs] += values.take(order[first[:runs] + k], axis=0)
    out = np.empty_like(sums)
    out[by_size] = sums
    ones = np.ones(sizes.max(), dtype=values.dtype)
    for i in np.flatnonzero(sizes > LAYERS).tolist():
        out[i] = ones[: sizes[i]] @ values.take(order[heads[i] : heads[i] + sizes[i]], axis=0)
    return out


def _beside(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts of neighbours into runs that are padded to their largest: at most so many rows then, or one alone."""
    cuts, high = [0], 0
    for i, size in enumerate(sizes.tolist()):
        high = max(high, size)
        if i > cuts[-1] and high * (i + 1 - cuts[-1]) > most:
            cuts.append(i)
            high = size
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True)) if len(sizes) else []


def _calm(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the logits of each of some classes can be exponentiated as they are: a state lies within -1 and 1, so a logit lies
    as far from its bias as its weights sum up to at most."""

    def fits(reach: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (reach.max(axis=-1) < 75) & ((b + reach).max(axis=-1) < 75) & ((b - reach).max(axis=-1) > -55)

    flat = w.reshape(len(w), -1)
    most = np.maximum(flat.max(axis=1), -flat.min(axis=1)) * w.shape[1]  # a wider bound, at once
    good = fits(most[:, None], b)
    for i in np.flatnonzero(~good):
        good[i] = fits(np.abs(w[i]).sum(axis=0), b[i])
    return good


class GatedLm:
    """Parameters as float32 arrays; words are ranks from 0."""

    def __init__(self, counts: np.ndarray, hidden: int = 32, seed: int | None = 1) -> None:
        rnd = None if seed is None else np.random.default_rng(seed)  # none: parameters are to be loaded
        words, self.hidden = len(counts), hidden
        root = max(CLASS, math.isqrt(max(words, 1) - 1) + 1)
        small, large = 3 * root // 8, 7 * root // 4
        near = max(1, min(3 * root // 16, -(-(words - SINGLE) // small)))
        far = max(1, -(-(words - SINGLE - near * small) // large))
        self.firsts = SINGLE, SINGLE + near  # first classes of word_w and of tail_w
        group = np.r_[np.arange(SINGLE), SINGLE + np.arange(near * small) // small, SINGLE + near + np.arange(far * large) // large]
        cell = np.r_[np.zeros(SINGLE, np.int64), np.arange(near * small) % small, np.arange(far * large) % large]
        self.group, self.cell = group[:words].astype(np.uint16 if near + far < 1 << 15 else np.int64), cell[:words]
        shape = lambda *s, scale=0.1: (rnd.standard_normal(s) * scale if rnd else np.zeros(s)).astype(np.float32)
        self.inputs, self.recur = shape(words, 3 * hidden), shape(hidden, 3 * hidden, scale=hidden**-0.5)
        self.class_w = shape(hidden, SINGLE + near + far, scale=0.02)
        self.word_w, self.tail_w = shape(near, hidden, small, scale=0.02), shape(far, hidden, large, scale=0.02)
        mass = np.full(len(group), 1e-30)
        mass[:words] = np.maximum(counts, 0.1)
        self.class_b = np.log(np.bincount(group, weights=mass) / mass.sum()).astype(np.float32)
        parts = mass[SINGLE : SINGLE + near * small].reshape(near, small), mass[SINGLE + near * small :].reshape(far, large)
        self.word_b, self.tail_b = (np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32) for x in parts)

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def load(self, flat: np.ndarray) -> GatedLm:
        at = 0
        for name, a in zip(NAMES, self.arrays(), strict=True):
            setattr(self, name, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return self

    def thirds(self, of: np.ndarray) -> np.ndarray:
        """Columns of the three gates as three arrays, those of the two that pass a logistic function halved for tanh."""
        three = np.ascontiguousarray(of.reshape(len(of), 3, self.hidden).transpose(1, 0, 2))
        three[:2] *= 0.5
        return three

    def gates(self, x: np.ndarray, h: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, ...]:
        """(update gate, reset gate, candidate, recurrent part of the candidate) from thirds of the inputs, which are
        overwritten, and of the recurrent weights."""
        u, gates, c = h @ recur, x[:2], x[2]
        gates += u[:2]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        c += gates[1] * u[2]
        np.tanh(c, out=c)
        return gates[0], gates[1], c, u[2]

    def step(self, word: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(next state, update gate, reset gate, candidate, recurrent part of the candidate)."""
        z, r, c, un = self.gates(self.thirds(self.inputs[word]), h, self.thirds(self.recur))
        return (h - c) * z + c, z, r, c, un

    def layers(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(first class, weights, biases) of the classes of several words."""
        return [(self.firsts[0], self.word_w, self.word_b), (self.firsts[1], self.tail_w, self.tail_b)]

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows in order of their target's class, where each class begins in that order and the last ends)."""
        group = self.group[target]
        return np.argsort(group, kind="stable"), np.r_[0, np.bincount(group, minlength=len(self.class_b)).cumsum()]

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after its state."""
        order, cuts = self.by_class(target)
        own, goal = h.take(order, axis=0), target[order]
        got = np.zeros(len(goal), dtype=h.dtype)

        def add(a: int, b: int, w: np.ndarray, bias: np.ndarray, cell: np.ndarray, calm: bool) -> None:
            rows, odds = max(1, BLOCK // len(bias)), np.exp(bias)
            for at in range(a, b, rows):
                to = min(at + rows, b)
                logits, goals = own[at:to] @ w, cell[at:to]
                if not calm:
                    logits += bias
                hit = logits.reshape(-1)[np.arange(to - at) * len(bias) + goals]
                if calm:  # the biases as factors of the exponentials
                    np.exp(logits, out=logits)
                    hit += bias[goals]
                    hit -= np.log(logits @ odds)
                else:
                    hit -= logits.max(axis=1)
                    hit -= np.log(_exp_sums(logits, calm))
                got[at:to] += hit

        add(0, len(goal), self.class_w, self.class_b, self.group[goal].astype(np.int64), bool(_calm(self.class_w[None], self.class_b[None])[0]))
        cell = self.cell[goal]
        for first, w, b in self.layers():
            for k, calm in enumerate(_calm(w, b)):
                add(cuts[first + k], cuts[first + k + 1], w[k], b[k], cell, calm)
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, words: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
        """(loss a token, gradients, last state) of one window: arrays steps x streams; fresh marks a text's first word."""
        loss, parts, grads, h = self.window(words, targets, fresh, h, want=True)
        for i, (a, part) in enumerate(zip(self.arrays(), parts, strict=True)):
            if part is not None:
                whole = np.zeros_like(a)
                whole[part] = grads[i]
                grads[i] = whole
        return loss, grads, h

    def window(self, words: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, want: bool = False) -> tuple[float, list[np.ndarray | None], list[np.ndarray], np.ndarray]:
        """(loss a token, if wanted, rows, gradients, last state): a parameter's gradients are those of its rows, and of all for None; those
        of other rows are 0. h lies within -1 and 1."""
        steps, streams = words.shape
        n, m, kind = steps * streams, self.hidden, self.recur.dtype
        short = words.ravel().astype(np.uint16) if len(self.inputs) <= 1 << 16 else words.ravel()  # 16 bits sort by counting
        by_word = np.argsort(short, kind="stable")
        ranked = short[by_word]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        heads = np.flatnonzero(first)
        near = ranked[heads].astype(np.int64)
        place = np.empty(n, dtype=np.int64)
        place[by_word] = np.cumsum(first) - 1
        place = place.reshape(steps, streams)
        table, recur = self.thirds(self.inputs.take(near, axis=0)), self.thirds(self.recur)
        new = [np.flatnonzero(row) if any_new else None for row, any_new in zip(fresh, fresh.any(axis=1), strict=True)]

        # Forward; beside the states what a state's gradient is multiplied by to give its gates'.
        befores, states, keeps, to_c = (np.empty((steps, streams, m), dtype=kind) for _ in range(4))
        to_u = np.empty((3, steps, streams, m), dtype=kind)  # for the recurrent parts of the three gates
        for t in range(steps):
            before, after, z, a = befores[t], states[t], keeps[t], to_c[t]
            before[:] = h
            if new[t] is not None:
                before[new[t]] = 0
            z[:], r, c, un = self.gates(np.take(table, place[t], axis=1), before, recur)
            np.subtract(before, c, out=after)
            after *= z
            rest = 1 - z
            np.multiply(after, rest, out=to_u[0, t])
            after += c
            np.multiply(c, c, out=a)
            np.subtract(1, a, out=a)
            a *= rest
            e = np.multiply(a, r, out=to_u[2, t])
            d = np.multiply(e, un, out=to_u[1, t])
            d *= np.subtract(1, r, out=r)
            h = after

        # Softmax layers, over the tokens in order of their targets' classes.
        target = targets.ravel()
        order, cuts = self.by_class(target)
        own, goal = states.reshape(n, m).take(order, axis=0), target[order]
        group, cell = self.group[goal].astype(np.int64), self.cell[goal]
        g_class_w, g_class_b, g_own, loss = np.zeros_like(self.class_w), np.zeros_like(self.class_b), np.empty_like(own), 0.0
        calm, rows = bool(_calm(self.class_w[None], self.class_b[None])[0]), max(1, BLOCK // len(self.class_b))
        for at in range(0, n, rows):
            to = at + rows
            part, g_w, g_b, g = _residual(own[None, at:to], self.class_w[None], self.class_b[None], group[None, at:to], None, n, calm, want)
            loss += part
            g_class_w += g_w[0]
            g_class_b += g_b[0]
            g_own[at:to] = g[0]
        parts, g_layers = [near, None, None, None], []
        for first, w, bias in self.layers():
            begin, end = cuts[first : first + len(w)], cuts[first + 1 : first + len(w) + 1]
            far = np.flatnonzero(begin < end)
            begin, end, calm, most = begin[far], end[far], _calm(w, bias), max(1, BLOCK // bias.shape[1])
            g_w, g_b = (np.empty((len(far), *x.shape[1:]), dtype=kind) for x in (w, bias))
            by_size = np.argsort(end - begin, kind="stable")
            for a, b in _beside((end - begin)[by_size], most):  # classes of like size side by side
                few = by_size[a:b]
                which, place_of = far[few], begin[few, None] + np.arange((end - begin)[few[-1]])
                live = place_of < end[few, None]
                place_of = np.minimum(place_of, end[few, None] - 1)
                w_few, b_few, calm_few = w[which], bias[which], bool(calm[which].all())
                for at in range(0, place_of.shape[1], most):
                    here, now = place_of[:, at : at + most], live[:, at : at + most]
                    part, more_w, more_b, g = _residual(own.take(here, axis=0), w_few, b_few, cell[here], now, n, calm_few, want)
                    loss += part
                    if at:
                        more_w, more_b = more_w + g_w[few], more_b + g_b[few]
                    g_w[few], g_b[few] = more_w, more_b
                    cells = np.flatnonzero(now)
                    g_own[here.reshape(-1)[cells]] += g.reshape(-1, m).take(cells, axis=0)
            parts += [None if len(far) == len(w) else far] * 2
            g_layers += [g_w, g_b]
        back_to = np.empty_like(order)
        back_to[order] = np.arange(n)
        g_states = g_own.take(back_to, axis=0).reshape(steps, streams, m)

        # Backward through the window.
        turned = np.ascontiguousarray(self.recur.reshape(m, 3, m).transpose(1, 2, 0))
        back = np.zeros((streams, m), dtype=kind)
        for t in range(steps - 1, -1, -1):
            g = g_states[t]
            g += back
            g_u = to_u[:, t]
            g_u *= g
            back = g * keeps[t]
            for part in g_u @ turned:
                back += part
            if new[t] is not None:
                back[new[t]] = 0
        g_recur = (befores.reshape(n, m).T @ to_u.reshape(3, n, m)).transpose(1, 0, 2).reshape(m, 3 * m)
        to_c *= g_states
        g_gates = np.empty((n, 3, m), dtype=kind)
        for k, part in enumerate((to_u[0], to_u[1], to_c)):
            g_gates[:, k] = part.reshape(n, m)
        g_inputs = _sums(g_gates.reshape(n, -1), by_word, heads)
        return loss / n, parts, [g_inputs, g_recur, g_class_w, g_class_b, *g_layers], h

    def fit(self, texts: list[np.ndarray], streams: int = 256, steps: int = 32, rate: float = 1.2e-2, end: int = 0) -> int:
        """One pass over whole texts (word ranks) with Adam; tokens trained on. Texts are laid end to end and cut into
        parallel streams; the state is carried from window to window and starts anew at each text."""
        if not texts:
            return 0
        after = np.cumsum([len(t) + 1 for t in texts])
        last = np.zeros(after[-1], dtype=bool)
        last[after - 1] = True
        targets = np.full(len(last), end, dtype=np.uint16 if len(self.inputs) <= 1 << 16 else np.int64)
        targets[~last] = np.concatenate(texts)
        words, fresh = np.roll(targets, 1), np.roll(last, 1)  # a text follows the end of the one before
        # Few texts run in few streams, so that they too make some dozens of updates.
        streams = int(max(1, min(streams, max(4, len(words) // (64 * steps)), len(words) // steps)))
        whole = -(-len(words) // streams)
        pad = streams * whole - len(words)  # the last stream goes on with the first texts
        words, targets, fresh = (np.ascontiguousarray(np.r_[a, np.resize(a, pad)].reshape(streams, whole).T) for a in (words, targets, fresh))
        h = np.zeros((streams, self.hidden), dtype=np.float32)
        first, second = ([np.zeros_like(a) for a in self.arrays()] for _ in range(2))  # moments, divided by 0.1 and by 0.01
        for k, at in enumerate(range(0, whole, steps), start=1):
            _, parts, grads, h = self.window(words[at : at + steps], targets[at : at + steps], fresh[at : at + steps], h)
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
            scale, warm = min(1.0, 1.0 / max(norm, 1e-6)), min(1.0, k / 20)
            lift, drop = 1 / (1 - 0.9**k), np.sqrt(0.01 / (1 - 0.99**k))
            speed, least = np.float32(rate * warm * lift * 0.1 / drop), np.float32(1e-6 / drop)
            for rows, a, g, m, v in zip(parts, self.arrays(), grads, first, second, strict=True):
                # Only words and classes of the window have gradients; the moments of the others wait, whatever the vocabulary.
                chunk = max(1, CHUNK // max(1, a[0].size))
                for i in range(0, len(g), chunk):
                    which = slice(i, i + chunk) if rows is None else rows[i : i + chunk]
                    g_part = g[i : i + chunk]
                    a_part, m_part, v_part = (x[which] if rows is None else x.take(which, axis=0) for x in (a, m, v))
                    if scale < 1:
                        g_part *= np.float32(scale)
                    m_part *= np.float32(0.9)
                    m_part += g_part
                    g_part *= g_part
                    v_part *= np.float32(0.99)
                    v_part += g_part
                    root = np.sqrt(v_part, out=g_part)
                    root += least
                    np.divide(m_part, root, out=root)
                    root *= speed
                    a_part -= root
                    if rows is not None:
                        a[which], m[which], v[which] = a_part, m_part, v_part
        return words.size

    def score(self, texts: list[np.ndarray], width: int = 256, window: int = 64, end: int = 0, block_tokens: int = 1 << 16) -> np.ndarray:
        """Natural log-probability of each whole text and its end. Texts of like length run side by side; a text's state is
        carried from window to window until its end. States wait until about block_tokens of them are scored at once."""
        out, waiting, held = np.zeros(len(texts)), [], 0

        def flush() -> None:
            nonlocal waiting, held
            if waiting:
                which, state, target = (np.concatenate(x) for x in zip(*waiting, strict=True))
                out[:] += np.bincount(which, weights=self.log_probs(state, target), minlength=len(out))
            waiting, held = [], 0

        order = np.argsort([-len(t) for t in texts], kind="stable")
        table, recur = self.thirds(self.inputs), self.thirds(self.recur)
        for at in range(0, len(order), width):
            group = order[at : at + width]
            sizes = np.array([len(texts[i]) + 1 for i in group])
            h = np.zeros((len(group), self.hidden), dtype=np.float32)
            for begin in range(0, int(sizes[0]), window):
                live = int(np.searchsorted(-sizes, -begin, side="left"))
                span = min(window, int(sizes[0]) - begin)
                block = np.full((live, span + 1), end, dtype=np.int64)  # the word before the window, then the window
                for row, i in enumerate(group[:live]):
                    part = texts[i][max(0, begin - 1) : begin + span]
                    block[row, (begin == 0) : (begin == 0) + len(part)] = part
                h = h[:live]
                counts = np.searchsorted(-sizes, -(begin + np.arange(span)), side="left")
                for t, n in enumerate(counts.tolist()):
                    z, _, c, _ = self.gates(np.take(table, block[:n, t], axis=1), h[:n], recur)
                    moved = h[:n] - c
                    moved *= z
                    moved += c
                    h = moved
                    waiting.append((group[:n], moved, block[:n, t + 1]))
                    held += n
                if held >= block_tokens:
                    flush()
        flush()
        return out
