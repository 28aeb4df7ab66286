"""A gated recurrent language model with a class-factored output, in numpy.

A word's probability is that of its class times that of the word within its
class, so a token costs two short softmaxes. Words are numbered by frequency and
dealt to classes of ``MEMBERS`` consecutive numbers. The biases start at the
words' relative frequencies, so an untrained model is the unigram model.
"""

from __future__ import annotations

from math import prod

import numpy as np

MEMBERS = 64
HIDDEN = 32
WINDOW = 16  # steps of truncated backpropagation; the state is carried on
NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "ww", "bw")


def fresh(probability: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters for words with the given probabilities; their number is a multiple of ``MEMBERS``."""
    random = np.random.default_rng(seed)
    classes = len(probability) // MEMBERS

    def normal(*shape, scale):
        return random.normal(0, scale, shape).astype(np.float32)

    p = np.maximum(probability, 1e-12).reshape(classes, MEMBERS)
    return {
        "emb": normal(len(probability), HIDDEN, scale=0.1),
        "wx": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "wh": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": np.zeros((HIDDEN, classes), np.float32),
        "bc": np.log(p.sum(axis=1)).astype(np.float32),
        "ww": np.zeros((classes, HIDDEN, MEMBERS), np.float32),
        "bw": np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def packed(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in NAMES])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in NAMES:
        out[name] = flat[at : at + like[name].size].reshape(like[name].shape).astype(np.float32)
        at += like[name].size
    return out


class Room:
    """Arrays that every window needs again: fresh ones cost more, in page faults, than what is done with them."""

    def __init__(self, kind):
        self.kind, self.arrays = np.dtype(kind), {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size, found = prod(shape), self.arrays.get(name)
        if found is None or len(found) < size:
            found = self.arrays[name] = np.empty(size, self.kind)
        return found[:size].reshape(shape)


def _bounded(params: dict[str, np.ndarray]) -> bool:
    """Whether no output can overflow ``exp``: states lie within -1 and 1."""
    top = np.abs(params["wc"]).sum(axis=0) + np.abs(params["bc"])
    inner = np.abs(params["ww"]).sum(axis=1) + np.abs(params["bw"])
    return float(top.max()) < 80 and float(inner.max()) < 80


def _grouped(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts equal numbers side by side, where each of them starts in it, and the numbers."""
    order = np.argsort(numbers, kind="stable")
    numbers = numbers[order]
    starts = np.flatnonzero(np.concatenate([[len(numbers) > 0], numbers[1:] != numbers[:-1]]))
    return order, starts, numbers[starts]


def _own_logs(x: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """Logarithms of the softmax of outputs ``x`` at the targets; ``x`` is written over."""
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(at)), at]
    return own - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def log_probabilities(hs: np.ndarray, targets: np.ndarray, params: dict[str, np.ndarray], bounded: bool = False, piece: int = 1 << 13) -> np.ndarray:
    """Natural logarithms of the probabilities of the targets after the states ``hs``; in pieces that stay in cache."""
    out, room = np.empty(len(targets), hs.dtype), Room(hs.dtype)
    for at in range(0, len(targets), piece):
        part = slice(at, at + piece)
        order, starts, classes = _grouped(targets[part] // MEMBERS)
        states, goal = hs[part][order], targets[part][order]
        x = np.matmul(states, params["wc"], out=room("top", len(goal), len(params["bc"])))
        x += params["bc"]
        logs = _own_logs(x, goal // MEMBERS, bounded)
        x = room("inner", len(goal), MEMBERS)
        for c, i, j in zip(classes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(goal)]):
            np.dot(states[i:j], params["ww"][c], out=x[i:j])
            x[i:j] += params["bw"][c]
        logs += _own_logs(x, goal % MEMBERS, bounded)
        out[part][order] = logs
    return out


def score_documents(documents: list[np.ndarray], params: dict[str, np.ndarray], start: int, window: int = 64) -> np.ndarray:
    """The natural logarithm of every whole document's probability.

    All documents are read side by side from their first word on. After a window
    of steps their outputs are computed together and the states carried on.
    """
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths)
    every = np.concatenate(documents) if documents else np.empty(0, np.int64)
    first, left = (ends - lengths)[order], lengths[order]
    # a sigmoid is a hyperbolic tangent: 2 * sigmoid(2 * x) = tanh(x) + 1, so gates of updates and resets are halved
    of_word = np.split((params["emb"] @ params["wx"] + params["b"]) * np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN), 3, axis=1)
    of_word = [np.ascontiguousarray(each) for each in of_word]
    by_state = [np.ascontiguousarray(each) for each in np.split(params["wh"] * np.float32(0.5), 3, axis=1)]
    bounded = _bounded(params)
    totals = np.zeros(len(documents))
    h = np.zeros((len(documents), HIDDEN), np.float32)
    before = np.full(len(documents), start, every.dtype)
    spare = [np.empty_like(h) for _ in range(4)]
    for at in range(0, int(left[0]) if len(left) else 0, window):
        stop = min(at + window, int(left[0]))
        live = np.searchsorted(-left, -np.arange(at, stop), side="left").tolist()  # those longer than t
        hs, targets, owners = np.empty((sum(live), HIDDEN), np.float32), [], []
        filled = 0
        for t, n in zip(range(at, stop), live):
            h, before = h[:n], before[:n]
            z, r, c, word = (each[:n] for each in spare)
            for gate, weights, table in zip((z, r), by_state, of_word):
                np.matmul(h, weights, out=gate)
                gate += np.take(table, before, axis=0, out=word, mode="clip")
                np.tanh(gate, out=gate)
                gate += 1
            np.matmul(h, by_state[2], out=c)
            c *= r
            c += np.take(of_word[2], before, axis=0, out=word, mode="clip")
            np.tanh(c, out=c)
            after = np.subtract(h, c, out=hs[filled : filled + n])
            z *= 0.5
            after *= z
            after += c
            h, before = after, every[first[:n] + t]
            filled += n
            targets.append(before)
            owners.append(order[:n])
        logs = log_probabilities(hs, np.concatenate(targets), params, bounded)
        totals += np.bincount(np.concatenate(owners), logs, len(documents))
    return totals


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Parameters that lie in ``flat``, and those of the words within their classes with the biases as last row."""
    out, at = {}, 0
    for name in NAMES[:-2]:
        out[name] = flat[at : at + like[name].size].reshape(like[name].shape)
        at += like[name].size
    inner = flat[at:].reshape(-1, HIDDEN + 1, MEMBERS)
    return {**out, "ww": inner[:, :HIDDEN], "bw": inner[:, HIDDEN]}, inner


def _size(params: dict[str, np.ndarray]) -> int:
    return sum(params[name].size for name in NAMES)


def _softmax_loss(x: np.ndarray, at: np.ndarray, weight: np.ndarray, scale) -> float:
    """The weighted loss of outputs ``x`` for the targets; ``x`` becomes its scaled gradient."""
    rows = np.arange(len(at))
    if x.max() > 80 or x.min() < -80:  # else no exponential overflows, and no sum vanishes
        x -= x.max(axis=1, keepdims=True)
    own = x[rows, at]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    loss = float(((np.log(sums) - own) * weight).sum())
    x *= (weight * scale / sums)[:, None]
    x[rows, at] -= weight * scale
    return loss


def _adam(flat: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, turn: int, rate: float, piece: int = 1 << 14) -> None:
    """A step along the gradient ``g``, whose norm is at most 1; in place, in pieces that stay in cache.

    ``first`` holds 10 times and ``second`` 100 times the usual means, so that a gradient is added as it is.
    """
    shrink = np.float32(min(1.0, 1.0 / max(float(np.sqrt(np.dot(g, g))), 1e-9)))
    pace, level = 0.1 * rate / (1 - 0.9**turn), 0.1 * (1 - 0.99**turn) ** -0.5
    level, least = np.float32(level / pace), np.float32(1e-6 / pace)
    keep_first, keep_second = np.float32(0.9), np.float32(0.99)
    for at in range(0, len(flat), piece):
        part = slice(at, at + piece)
        t, m, v = g[part], first[part], second[part]
        m *= keep_first
        if shrink < 1:
            t *= shrink
        m += t
        v *= keep_second
        np.multiply(t, t, out=t)
        v += t
        np.sqrt(v, out=t)
        t *= level
        t += least
        np.divide(m, t, out=t)
        flat[part] -= t


def gradients(params, inputs, targets, resets, live, h, room=None):
    """Loss, gradients and last state of a window; arrays are steps x lanes.

    Inside, a column is a token: the units of a step's gates lie one below the
    other, so that each part is one block. Gates of updates and resets are halved, as a
    sigmoid is a hyperbolic tangent of half its input. With a ``room``, which is of the
    parameters' kind, gradients and state stay valid until the next window only.
    """
    steps, lanes = inputs.shape
    kind = params["emb"].dtype
    room = room or Room(kind)
    flat = room("flat", _size(params))
    flat.fill(0)
    grads, inner_grads = _views(flat, params)
    halves = np.repeat(np.array([0.5, 0.5, 1], kind), HIDDEN)
    wh = np.ascontiguousarray((params["wh"] * halves).T)
    restart, kept = resets.any(axis=1).tolist(), (~resets).astype(kind)
    x = np.take(params["emb"], inputs, axis=0, out=room("x", steps, lanes, HIDDEN), mode="clip")
    gates = np.matmul((params["wx"] * halves).T, x.transpose(0, 2, 1), out=room("gates", steps, 3 * HIDDEN, lanes))
    gates += (params["b"] * halves)[:, None]
    zr, n = gates[:, : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    by_state, spare = room("by_state", steps, 3 * HIDDEN, lanes), room("spare", HIDDEN, lanes)
    before, over, after = (room(name, steps, HIDDEN, lanes) for name in ("before", "over", "after"))
    state = h.T
    for t in range(steps):
        if restart[t]:
            np.multiply(state, kept[t], out=before[t])
        else:
            before[t] = state
        gate, now = zr[t], n[t]
        of_state = np.matmul(wh, before[t], out=by_state[t])
        gate += of_state[: 2 * HIDDEN]
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        np.multiply(r[t], of_state[2 * HIDDEN :], out=spare)
        now += spare
        np.tanh(now, out=now)
        np.subtract(before[t], now, out=over[t])
        state = np.multiply(z[t], over[t], out=after[t])
        state += now
    hs = room("hs", steps * lanes, HIDDEN + 1)
    hs[:, :HIDDEN].reshape(steps, lanes, HIDDEN)[...] = after.transpose(0, 2, 1)
    hs[:, HIDDEN] = 1
    weight = live.reshape(-1).astype(kind)
    goal = targets.reshape(-1)
    of, member = goal // MEMBERS, goal % MEMBERS
    scale = kind.type(1.0 / max(1.0, float(weight.sum())))
    d = np.matmul(hs, np.concatenate([params["wc"], params["bc"][None]]), out=room("top", len(goal), len(params["bc"])))
    loss = _softmax_loss(d, of, weight, scale)
    np.matmul(hs[:, :HIDDEN].T, d, out=grads["wc"])
    np.sum(d, axis=0, out=grads["bc"])
    dhs = np.matmul(params["wc"], d.reshape(steps, lanes, -1).transpose(0, 2, 1), out=room("dhs", steps, HIDDEN, lanes))
    order, starts, classes = _grouped(of)
    own_hs = np.take(hs, order, axis=0, out=room("own_hs", len(goal), HIDDEN + 1), mode="clip")
    d, back = room("inner", len(goal), MEMBERS), room("back", len(goal), HIDDEN)
    weights = np.concatenate([params["ww"], params["bw"][:, None]], axis=1, out=room("weights", *inner_grads.shape))
    groups = [(c, slice(i, j)) for c, i, j in zip(classes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(goal)])]
    for c, own in groups:
        np.dot(own_hs[own], weights[c], out=d[own])
    loss += _softmax_loss(d, member[order], weight[order], scale)
    for c, own in groups:
        own_d = d[own]
        np.dot(own_hs[own].T, own_d, out=inner_grads[c])
        np.dot(own_d, weights[c, :HIDDEN].T, out=back[own])
    places = np.empty_like(order)
    places[order] = np.arange(len(order))
    by_token = np.take(back, places, axis=0, out=room("by_token", len(goal), HIDDEN), mode="clip")
    dhs += by_token.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
    # what a step's state passes to: the state's part of n, z, r, and n again, so that 1: are the gates in their order
    share = room("share", steps, 4, HIDDEN, lanes)
    of_h, of_z, of_r, of_n = (share[:, i] for i in range(4))
    np.multiply(n, n, out=of_n)
    np.subtract(1, of_n, out=of_n)
    np.subtract(1, z, out=of_z)
    of_n *= of_z
    of_z *= z
    of_z *= over
    np.multiply(of_n, r, out=of_h)
    np.subtract(1, r, out=of_r)
    of_r *= by_state[:, 2 * HIDDEN :]
    of_r *= of_h
    into = np.concatenate([params["wh"][:, 2 * HIDDEN :], params["wh"][:, : 2 * HIDDEN]], axis=1)
    dh = np.zeros((HIDDEN, lanes), kind)
    for t in range(steps - 1, -1, -1):
        dh += dhs[t]
        passed = np.multiply(share[t], dh, out=share[t])
        dh *= z[t]
        dh += np.matmul(into, passed[:3].reshape(3 * HIDDEN, lanes), out=spare)
        if restart[t]:
            dh *= kept[t]
    passed = room("passed", 4 * HIDDEN, len(goal))
    passed.reshape(4 * HIDDEN, steps, lanes)[...] = share.reshape(steps, 4 * HIDDEN, lanes).transpose(1, 0, 2)
    read_states = dhs.reshape(HIDDEN, -1)
    read_states.reshape(HIDDEN, steps, lanes)[...] = before.transpose(1, 0, 2)
    by_gate = passed[HIDDEN:]
    of_wh = read_states @ passed[: 3 * HIDDEN].T
    grads["wh"][:, : 2 * HIDDEN], grads["wh"][:, 2 * HIDDEN :] = of_wh[:, HIDDEN:], of_wh[:, :HIDDEN]
    np.matmul(x.reshape(-1, HIDDEN).T, by_gate.T, out=grads["wx"])
    np.sum(by_gate, axis=1, out=grads["b"])
    order, starts, words = _grouped(inputs.reshape(-1))
    by_word = np.matmul(by_gate.T, params["wx"].T, out=by_token)
    by_word = np.take(by_word, order, axis=0, out=back, mode="clip")
    grads["emb"][words] = np.add.reduceat(by_word, starts, axis=0)
    return loss, grads, state.T


def train(documents: list[np.ndarray], params: dict[str, np.ndarray], start: int, lanes: int = 64, rate: float = 0.003) -> tuple[dict[str, np.ndarray], float]:
    """Parameters after one pass over the documents, and the mean loss on the way.

    Documents are laid end to end in lanes of about the same length; the state is
    carried from window to window and cleared where a document begins. Lanes that
    have ended are left out, as a long document may keep one lane going alone.
    """
    lanes = max(1, min(lanes, len(documents)))
    streams: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    filled = [0] * lanes
    for document in sorted(documents, key=len, reverse=True):
        lane = filled.index(min(filled))
        streams[lane].append(document)
        filled[lane] += len(document)
    longest_first = sorted(range(lanes), key=lambda lane: -filled[lane])
    streams, filled = [streams[lane] for lane in longest_first], [filled[lane] for lane in longest_first]
    length = max(filled, default=0)
    targets = np.full((length, lanes), start, np.min_scalar_type(len(params["emb"])))  # small numbers are sorted faster
    inputs, resets, live = targets.copy(), np.zeros((length, lanes), bool), np.zeros((length, lanes), bool)
    for lane, stream in enumerate(streams):
        at = 0
        for document in stream:
            targets[at : at + len(document), lane] = document
            inputs[at + 1 : at + len(document), lane] = document[:-1]
            resets[at, lane] = True
            live[at : at + len(document), lane] = True
            at += len(document)
    room, flat = Room(np.float32), np.empty(_size(params), np.float32)
    own, _ = _views(flat, params)
    for name in NAMES:
        own[name][...] = params[name]
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    h, total, turn = np.zeros((lanes, HIDDEN), np.float32), 0.0, 0
    for at in range(0, length, WINDOW):
        going = sum(n > at for n in filled)
        part = slice(at, at + WINDOW), slice(going)
        loss, _, h = gradients(own, inputs[part], targets[part], resets[part], live[part], h[:going], room)
        total += loss
        turn += 1
        _adam(flat, room("flat", len(flat)), first, second, turn, rate)
    return own, total / max(1, int(live.sum()))
