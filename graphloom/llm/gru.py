"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried over windows.

Symbols have an input row and a class. The output is a softmax over classes,
then, for classes with members, a softmax over the class's members; symbols of a
class without members end at the class (their share within it is counted
elsewhere). Texts lie end to end in lanes; the state goes on from window to window
and starts anew where a text begins. Gradients stop at a window's edge.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Members of a class of the output.
WIDTH = 64
#: Rows of one name that are added one at a time.
ROUNDS = 4


class Shape:
    """members: symbols with an output of their own, in classes of WIDTH; open_classes: classes after those, without members. The last input row begins texts."""

    def __init__(self, members: int, open_classes: int, hidden: int):
        self.members, self.hidden = members, hidden
        self.own = -(-members // WIDTH)
        self.classes = self.own + open_classes
        self.inputs = members + open_classes + 1
        self.sizes = {"x": (self.inputs, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, self.classes), "bc": (self.classes,), "wo": (self.own, hidden, WIDTH), "bo": (self.own, WIDTH)}

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.sizes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    @property
    def total(self) -> int:
        return sum(int(np.prod(s)) for s in self.sizes.values())

    def start(self, member_counts: np.ndarray, open_counts: np.ndarray, seed: int = 5) -> np.ndarray:
        """Parameters whose output without a state is that of the counts."""
        rng = np.random.default_rng(seed)
        flat = rng.normal(0, 0.08, self.total).astype(np.float32)
        p = self.unpack(flat)
        p["u"][:] = rng.normal(0, self.hidden**-0.5, p["u"].shape)
        padded = np.zeros(self.own * WIDTH)
        padded[: self.members] = member_counts + 0.5
        by_class = padded.reshape(self.own, WIDTH)
        with np.errstate(divide="ignore"):
            p["bo"][:] = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9) / by_class.sum(1, keepdims=True)), -30)
        sums = np.concatenate([by_class.sum(1), open_counts + 0.5])
        p["bc"][:] = np.log(sums / sums.sum())
        return flat


class Lanes:
    """Texts (arrays of symbols) in lanes of near equal length, longest lane first.

    symbol, begins: (time, lane); text, place: which text a cell is of; alive: lanes that still run at a time."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        lanes = max(1, min(lanes, len(texts)))
        load = [(0, i) for i in range(lanes)]
        dealt: list[list[int]] = [[] for _ in range(lanes)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            n, lane = heapq.heappop(load)
            dealt[lane].append(i)
            heapq.heappush(load, (n + len(texts[i]), lane))
        length = np.array([sum(len(texts[i]) for i in d) for d in dealt])
        order = np.argsort(-length, kind="stable")
        steps = int(length.max()) if len(texts) else 0
        self.symbol = np.zeros((steps, lanes), np.int32)
        self.text = np.zeros((steps, lanes), np.int32)
        self.begins = np.zeros((steps, lanes), bool)
        for j, lane in enumerate(order):
            at = 0
            for i in dealt[lane]:
                n = len(texts[i])
                self.symbol[at : at + n, j], self.text[at : at + n, j] = texts[i], i
                self.begins[at, j] = True
                at += n
        self.alive = np.searchsorted(-length[order], -np.arange(steps), side="left")


def apart(make: Callable, features: int, steps: int, lanes: int, kind: np.dtype) -> np.ndarray:
    """An array (feature, time, lane) whose features don't lie a multiple of a page apart, as they would evict each other from a cache."""
    return make((features, steps * lanes + 16), kind)[:, :-16].reshape(features, steps, lanes)


def add_rows(out: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """Adds each row of x to the row of out that rows names."""
    order = np.argsort(rows.astype(np.int16) if len(out) < 1 << 15 else rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    times = np.diff(np.append(first, len(rows)))
    # sums of long runs alone are worth a call of their own each
    for k in range(ROUNDS):
        own = first[times > k] + k
        out[rows[own]] += x.take(order[own], 0)
    later = np.arange(len(rows)) - np.repeat(first, times) >= ROUNDS
    if later.any():
        order, rows = order[later], rows[later]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[first]] += np.add.reduceat(x.take(order, 0), first)


class Net:
    """Within a window arrays are (feature, time, lane) or (feature, cell), so that each feature's cells lie side by side."""

    def __init__(self, shape: Shape, flat: np.ndarray, row_of: np.ndarray, class_of: np.ndarray):
        """row_of, class_of: by symbol, its input row and its class. Symbols below shape.members are members."""
        self.shape, self.flat, self.p = shape, flat, shape.unpack(flat)
        self.row_of, self.class_of = row_of.astype(np.int32), class_of.astype(np.int16)

    def run(self, lanes: Lanes, a: int, b: int, h: np.ndarray) -> tuple[np.ndarray, dict]:
        """The state (lane, feature) after times a to b, and what outputs and backpropagation need of the window."""
        p, k, kind = self.p, self.shape.hidden, self.flat.dtype
        alive = lanes.alive[a:b]
        most, steps = int(alive[0]), b - a
        whole = int(alive[-1]) == most
        new = lanes.begins[a:b, :most]
        last = lanes.symbol[a - 1 : b - 1, :most] if a else np.concatenate([np.zeros((1, most), np.int32), lanes.symbol[: b - 1, :most]])
        rows = np.where(new, self.shape.inputs - 1, self.row_of[last])
        x = p["x"].take(rows, 0)
        u = p["u"].T.copy()
        u[: 2 * k] *= -1
        make = np.empty if whole else np.zeros
        before, gates, drive, c, state = (apart(make, m, steps, most, kind) for m in (k, 2 * k, k, k, k))
        some = new.any(1)
        now = np.ascontiguousarray(h[:most].T)
        with np.errstate(over="ignore"):  # the gate is 0 there
            for t, n in enumerate(alive.tolist()):
                was, g, cand, out, given = before[:, t, :n], gates[:, t, :n], c[:, t, :n], state[:, t, :n], x[t, :n].T
                was[:] = now[:, :n]
                if some[t]:
                    was[:, new[t, :n]] = 0
                d = u @ was
                np.subtract(d[: 2 * k], given[: 2 * k], out=g)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                drive[:, t, :n] = d[2 * k :]
                np.multiply(g[k:], d[2 * k :], out=cand)
                cand += given[2 * k :]
                np.tanh(cand, out=cand)
                np.subtract(was, cand, out=out)
                out *= g[:k]
                out += cand
                now = out
        cells = None if whole else np.flatnonzero((np.arange(most) < alive[:, None]).ravel())
        return now.T, {"rows": rows, "new": new, "some": some, "alive": alive, "before": before, "gates": gates, "drive": drive, "c": c, "state": state, "cells": cells}

    @staticmethod
    def by_cell(window: dict, x: np.ndarray) -> np.ndarray:
        """x (feature, time, lane) by cell, time after time; only cells where a lane still runs."""
        flat = x.reshape(len(x), -1)
        return flat if window["cells"] is None else flat.take(window["cells"], axis=1)

    @staticmethod
    def of_cells(window: dict, x: np.ndarray) -> np.ndarray:
        """The same for x (time, lane)."""
        flat = x[: len(window["alive"]), : window["new"].shape[1]].ravel()
        return flat if window["cells"] is None else flat[window["cells"]]

    @staticmethod
    def exponents(logits: np.ndarray, own: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray]:
        """exp(logits) by row up to a factor of the row, in place, and the logits at own before; steep: rows are lowered first where some would over- or underflow."""
        if steep and len(logits) and (logits.max() > 40 or logits.min() < -40):
            logits -= logits.max(1, keepdims=True)
        at = logits.ravel().take(own)
        return np.exp(logits, out=logits), at

    def outputs(self, states: np.ndarray, symbols: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probability of symbols given states (feature, cell); with slopes, also adds the parameters' gradients of the mean loss to it and gives the states'."""
        p, k, kind, n = self.p, self.shape.hidden, self.class_of[symbols], len(symbols)
        order = np.argsort(kind, kind="stable")
        kind, symbols = kind[order], symbols[order]
        # a last feature of 1 stands for the biases
        s = np.ones((k + 1, n), states.dtype)
        s[:k] = states.take(order, axis=1)
        wc, wo = np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wo"], p["bo"][:, None]], 1)
        # states lie between -1 and 1
        steep = max(np.abs(wc).sum(0).max(), np.abs(wo).sum(1).max()) > 39
        own = np.arange(n) * self.shape.classes + kind
        e, at = self.exponents(s.T @ wc, own, steep)
        total = e @ np.ones(self.shape.classes, e.dtype)
        lp = at - np.log(total)
        edges = np.searchsorted(kind, np.arange(self.shape.own + 1)).tolist()
        spans = [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        m = edges[-1]
        within = np.empty((m, WIDTH), s.dtype)
        for c, a, b in spans:
            np.matmul(s[:, a:b].T, wo[c], out=within[a:b])
        member = np.arange(m) * WIDTH + symbols[:m] - kind[:m].astype(np.int64) * WIDTH
        within, at = self.exponents(within, member, steep)
        sums = within @ np.ones(WIDTH, s.dtype)
        lp[:m] += at - np.log(sums)
        back = None
        if slopes is not None:
            # e and within become the totals times the slopes by logits
            e.ravel()[own] -= total
            within.ravel()[member] -= sums
            total, sums = total * n, sums * n
            g = (s / total) @ e
            slopes["wc"] += g[:k]
            slopes["bc"] += g[k]
            back = p["wc"] @ e.T
            back /= total
            part, more = s[:, :m] / sums, np.empty((k, m), s.dtype)
            for c, a, b in spans:
                g = part[:, a:b] @ within[a:b]
                slopes["wo"][c] += g[:k]
                slopes["bo"][c] += g[k]
                np.matmul(p["wo"][c], within[a:b].T, out=more[:, a:b])
            more /= sums
            back[:, :m] += more
        out = np.empty_like(lp)
        out[order] = lp
        if back is not None:
            place = np.empty_like(order)
            place[order] = np.arange(n)
            back = back.take(place, axis=1)
        return out, back

    def score(self, texts: list[np.ndarray], lanes: int = 128, window: int = 32) -> np.ndarray:
        """ln probability of each text, summed over its symbols that count: member softmax or class."""
        out = np.zeros(len(texts))
        deal = Lanes(texts, lanes)
        h = np.zeros((deal.symbol.shape[1], self.shape.hidden), self.flat.dtype)
        for a in range(0, len(deal.alive), window):
            b = min(a + window, len(deal.alive))
            h, kept = self.run(deal, a, b, h)
            symbols, text = self.of_cells(kept, deal.symbol[a:b]), self.of_cells(kept, deal.text[a:b])
            out += np.bincount(text, self.outputs(self.by_cell(kept, kept["state"]), symbols)[0], len(texts))
        return out

    def slope(self, lanes: Lanes, a: int, b: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The state after a window, the gradient of the mean loss in it, and that loss; nothing flows back past the window's begin."""
        shape, p, k = self.shape, self.p, self.shape.hidden
        flat = np.zeros(shape.total, self.flat.dtype)
        g = shape.unpack(flat)
        h, kept = self.run(lanes, a, b, h)
        symbols = self.of_cells(kept, lanes.symbol[a:b])
        lp, back = self.outputs(self.by_cell(kept, kept["state"]), symbols, g)
        alive, new, before, c = kept["alive"], kept["new"], kept["before"], kept["c"]
        z, r = kept["gates"][:k], kept["gates"][k:]
        if kept["cells"] is not None:
            every = np.zeros((k, new.size), back.dtype)
            every[:, kept["cells"]] = back
            back = every
        back = back.reshape(k, *new.shape)
        rest = 1 - z
        to_c = c * c
        np.subtract(1, to_c, out=to_c)
        to_c *= rest
        to_z = before - c
        to_z *= z
        to_z *= rest
        to_r = 1 - r
        to_r *= r
        to_r *= kept["drive"]
        du, dc = apart(np.zeros, 3 * k, *new.shape, flat.dtype), apart(np.zeros, k, *new.shape, flat.dtype)
        later = np.zeros((k, new.shape[1]), flat.dtype)
        for t in range(len(alive) - 1, -1, -1):
            n = int(alive[t])
            dh, d, cand = back[:, t, :n], du[:, t, :n], dc[:, t, :n]
            dh += later[:, :n]
            np.multiply(dh, to_c[:, t, :n], out=cand)
            np.multiply(dh, to_z[:, t, :n], out=d[:k])
            np.multiply(cand, to_r[:, t, :n], out=d[k : 2 * k])
            np.multiply(cand, r[:, t, :n], out=d[2 * k :])
            flow = p["u"] @ d
            dh *= z[:, t, :n]
            flow += dh
            if kept["some"][t]:
                flow[:, new[t, :n]] = 0
            later[:, :n] = flow
            later[:, n:] = 0
        g["u"] += before.reshape(k, -1) @ du.reshape(3 * k, -1).T
        # the candidate's own input is not led through a gate
        du[2 * k :] = dc
        dx = np.ascontiguousarray(du.reshape(3 * k, -1).T)
        add_rows(g["x"], self.of_cells(kept, kept["rows"]), dx if kept["cells"] is None else dx[kept["cells"]])
        return h, flat, -float(lp.mean())

    def train(self, texts: list[np.ndarray], squares: np.ndarray, lanes: int = 128, window: int = 24, rate: float = 0.15) -> float:
        """One pass over texts in place (Adagrad; squares: its sums so far). The mean loss met."""
        deal = Lanes(texts, lanes)
        h = np.zeros((deal.symbol.shape[1], self.shape.hidden), self.flat.dtype)
        total = count = 0.0
        root = np.empty_like(self.flat)
        for a in range(0, len(deal.alive), window):
            b = min(a + window, len(deal.alive))
            n = int(deal.alive[a:b].sum())
            h, g, loss = self.slope(deal, a, b, h)
            squares += np.multiply(g, g, out=root)
            np.sqrt(np.add(squares, 1e-10, out=root), out=root)
            g *= rate * min(1.0, n / (lanes * window / 4))
            g /= root
            self.flat -= g
            total, count = total + loss * n, count + n
        return total / max(1.0, count)
