"""A gated recurrent language model in numpy with a class-factored output softmax.

A token's probability is P(class | state) * P(token | class, state). The first CLASSES * PER_CLASS tokens by frequency have
an output vector inside their class; every other class (a tail class) leaves the choice inside it to the caller.
Sequences are read in lanes, window by window, and the state is carried from window to window, so the log-likelihood
of a document is complete whatever its length; training cuts the gradient at the window's start (truncated backpropagation).
"""

from __future__ import annotations

import heapq

import numpy as np

CLASSES, PER_CLASS, TAILS = 32, 32, 32
LEARNED = CLASSES * PER_CLASS
INPUTS = LEARNED + TAILS
OUTPUTS = CLASSES + TAILS
HIDDEN = 16
LANES, WINDOW = 512, 32
#: Rows whose logits are made at once, so that they stay in a core's cache.
BLOCK = 2048
TRAIN_LANES, TRAIN_WINDOW, RATE, CLIP = 256, 32, 0.01, 1.0
#: Bound of an output weight, so that logits of states in (-1, 1) stay in the range of exp.
LARGEST = 3.0
NAMES = ("embed", "wx", "bx", "uzr", "uc", "wc", "bc", "wt", "bt")


def initial(counts: np.ndarray, tails: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the frequencies: counts of the learned tokens, masses of the tail classes."""
    rng = np.random.default_rng(11)
    share = np.concatenate([counts.reshape(CLASSES, PER_CLASS).sum(axis=1), tails]) + 1e-3
    scale = 1 / np.sqrt(HIDDEN)
    shapes = {"embed": (INPUTS, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "uzr": (HIDDEN, 2 * HIDDEN), "uc": (HIDDEN, HIDDEN), "wc": (HIDDEN, OUTPUTS), "wt": (CLASSES, HIDDEN, PER_CLASS)}
    out = {name: rng.normal(0, scale if name[0] != "w" or name == "wx" else 0.01, shape).astype(np.float32) for name, shape in shapes.items()}
    out["bx"] = np.zeros(3 * HIDDEN, np.float32)
    out["bc"] = np.log(share / share.sum()).astype(np.float32)
    inside = counts.reshape(CLASSES, PER_CLASS) + 1e-3
    out["bt"] = np.log(inside / inside.sum(axis=1, keepdims=True)).astype(np.float32)
    return out


def pack(params: dict) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in NAMES]).astype(np.float32)


def unpack(flat: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    return _views(flat.astype(np.float32), like)


def _views(flat: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in NAMES:
        size = like[name].size
        out[name] = flat[at : at + size].reshape(like[name].shape)
        at += size
    return out


def lanes(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Sequences dealt to lanes, longest first, each to the shortest lane."""
    count = max(1, min(count, len(lengths)))
    heap = [(0, lane) for lane in range(count)]
    out = [[] for _ in range(count)]
    for n in np.argsort(-lengths, kind="stable"):
        load, lane = heapq.heappop(heap)
        out[lane].append(int(n))
        heapq.heappush(heap, (load + int(lengths[n]), lane))
    return out


class Lanes:
    """Sequences of ids in lanes, each lane in one piece, so that a long sequence takes no room in the other lanes.

    A sequence is predicted token by token; its first input is the end token 0. ends are the lengths of the lanes that are left.
    """

    def __init__(self, sequences: list[np.ndarray], count: int):
        lengths = np.array([len(s) for s in sequences])
        dealt = lanes(lengths, count)
        order = np.array([n for lane in dealt for n in lane])
        self.targets = np.concatenate([sequences[n] for n in order], dtype=np.int32, casting="same_kind")
        self.owner = np.repeat(order.astype(np.int32), lengths[order])
        self.fresh = np.r_[True, self.owner[1:] != self.owner[:-1]]
        self.inputs = np.where(self.fresh, np.int32(0), np.r_[np.int32(0), self.targets[:-1]])
        self.ends = np.array([lengths[lane].sum() for lane in dealt])
        self.starts = np.cumsum(self.ends) - self.ends

    def left(self, at: int) -> np.ndarray | None:
        """Which lanes go on at a step, if some do not; the others are dropped."""
        on = self.ends > at
        if on.all():
            return None
        self.ends, self.starts = self.ends[on], self.starts[on]
        return on

    def window(self, at: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, owner, fresh) of a window, as steps x lanes; owner is the sequence's number, -1 where a lane has ended."""
        step = np.arange(at, min(at + steps, self.ends.max()))[:, None]
        places = np.minimum(self.starts + step, len(self.targets) - 1)
        return self.inputs.take(places), self.targets.take(places), np.where(step < self.ends, self.owner.take(places), -1), self.fresh.take(places)


def output_class(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < LEARNED, ids // PER_CLASS, ids - (LEARNED - CLASSES))


def states(params: dict, table: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(states after every step, last state) of a window; fresh marks steps that start a sequence.

    keep receives, as arrays of steps x lanes, the states before, the update and reset gates, the reset states and the candidates.
    """
    lanes_, steps = inputs.shape
    # The logistic function by way of tanh; halved weights are exact. Both gates lie apart, each in one piece.
    halved = np.concatenate([table[:, :HIDDEN], table[:, HIDDEN : 2 * HIDDEN]]) * np.float32(0.5)
    turned = np.stack([params["uzr"][:, :HIDDEN], params["uzr"][:, HIDDEN:]]) * np.float32(0.5)
    used = np.ascontiguousarray(inputs.T)
    gates = halved.take(np.stack([used, used + len(table)], axis=1), axis=0, mode="clip")
    candidates = np.ascontiguousarray(table[:, 2 * HIDDEN :]).take(used, axis=0, mode="clip")
    out, befores, resets = (np.empty((steps, lanes_, HIDDEN), np.float32) for _ in range(3))
    both, one = np.empty((2, lanes_, HIDDEN), np.float32), np.empty((lanes_, HIDDEN), np.float32)
    starts = _starts(fresh)
    for t in range(steps):
        before, gate, c, reset = befores[t], gates[t], candidates[t], resets[t]
        before[:] = state
        if t in starts:
            before[starts[t]] = 0
        np.matmul(before, turned, out=both)
        gate += both
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        np.multiply(gate[1], before, out=reset)
        np.matmul(reset, params["uc"], out=one)
        c += one
        np.tanh(c, out=c)
        state = out[t]
        np.subtract(c, before, out=state)
        state *= gate[0]
        state += before
    if keep is not None:
        keep += [befores, gates[:, 0], gates[:, 1], resets, candidates]
    return out, state


def _starts(fresh: np.ndarray) -> dict[int, np.ndarray]:
    """The lanes in which a sequence starts, by the steps that have any."""
    step, lane = np.divmod(np.flatnonzero(fresh.T), len(fresh))
    edges = np.searchsorted(step, np.arange(fresh.shape[1] + 1)).tolist()
    return {t: lane[edges[t] : edges[t + 1]] for t in range(fresh.shape[1]) if edges[t] < edges[t + 1]}


def by_class(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): the rows in order of their class, and where each learned class starts and ends."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


_ONES = np.ones(max(OUTPUTS, PER_CLASS), np.float32)


def _with_one(hidden: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows of hidden with a last column of ones, which meets the offsets of the output weights."""
    out = np.empty((len(rows), HIDDEN + 1), np.float32)
    hidden.take(rows, axis=0, out=out[:, :HIDDEN], mode="clip")
    out[:, HIDDEN] = 1
    return out


def _shares(logits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The log share of each row's id; the weights are bounded, so nothing overflows."""
    picked = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + ids)
    np.exp(logits, out=logits)
    return picked - np.log(logits @ _ONES[: logits.shape[1]])


def _inside(hidden: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The logits inside its class of each row up to the last edge."""
    out = np.empty((edges[-1], PER_CLASS), np.float32)
    at = edges.tolist()
    for k in range(CLASSES):
        if at[k] < at[k + 1]:
            np.matmul(hidden[at[k] : at[k + 1]], weights[k], out=out[at[k] : at[k + 1]])
    return out


def _outputs(params: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the classes, and of the tokens inside each, with their offsets as a last row."""
    return np.concatenate([params["wc"], params["bc"][None]]), np.concatenate([params["wt"], params["bt"][:, None]], axis=1)


def log_likelihoods(params: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each sequence: classes, and tokens inside learned classes.

    Windows grow as lanes end, up to as many rows as those of all lanes, so a long sequence is not read by itself in short windows.
    """
    total = np.zeros(len(sequences))
    if not sequences:
        return total
    held, at = Lanes(sequences, LANES), 0
    table = (params["embed"] @ params["wx"] + params["bx"]).astype(np.float32)
    state, longest = np.zeros((len(held.ends), HIDDEN), np.float32), held.ends.max()
    to_class, inside = _outputs(params)
    while at < longest:
        on = held.left(at)
        state = state if on is None else state[on]
        steps = max(WINDOW, min(LANES * WINDOW // len(state), int(np.median(held.ends)) - at))
        inputs, targets, owner, fresh = held.window(at, steps)
        at += steps
        found, state = states(params, table, inputs.T, fresh.T, state)
        seen = np.flatnonzero(owner.ravel() >= 0)
        ids, who = targets.ravel()[seen], owner.ravel()[seen]
        order, edges = by_class(output_class(ids))
        ids, who = ids[order], who[order]
        classes = output_class(ids)
        hidden = _with_one(found.reshape(-1, HIDDEN), seen[order])
        value = np.empty(len(ids), np.float32)
        for first in range(0, len(ids), BLOCK):
            rows = slice(first, first + BLOCK)
            value[rows] = _shares(hidden[rows] @ to_class, classes[rows])
        learned = ids[: edges[-1]] % PER_CLASS
        logits = _inside(hidden, inside, edges)
        for first in range(0, len(learned), BLOCK):
            rows = slice(first, min(first + BLOCK, len(learned)))
            value[rows] += _shares(logits[rows], learned[rows])
        total += np.bincount(who, weights=value, minlength=len(total))
    return total


def gradients(params: dict, inputs: np.ndarray, targets: np.ndarray, alive: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradient of a window's mean negative log-likelihood, cut at its start, and the state after it."""
    kept: list = []
    table = (params["embed"] @ params["wx"] + params["bx"]).astype(np.float32)
    found, last = states(params, table, inputs, fresh, state, kept)
    steps, rows = inputs.shape[1], inputs.shape[0]
    seen = np.flatnonzero(alive.T.ravel())
    n = max(1, len(seen))
    ids = targets.T.ravel()[seen]
    order = np.argsort(ids.astype(np.int16), kind="stable")  # by class, and by token inside the learned ones
    seen, ids = seen[order], ids[order]
    edges = np.searchsorted(ids, np.arange(0, LEARNED + 1, PER_CLASS))
    hidden = _with_one(found.reshape(-1, HIDDEN), seen)
    to_class, inside = _outputs(params)

    by_id = _summed_by(ids, hidden, INPUTS) / np.float32(n)  # the rows of each target, added up
    by_learned = by_id[:LEARNED].reshape(CLASSES, PER_CLASS, HIDDEN + 1)
    by_output = np.concatenate([by_learned.sum(axis=1), by_id[LEARNED:]])

    def shares(powers: np.ndarray, rows_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Makes logits powers; (the scale of each row's shares in the mean loss, the rows by it)."""
        np.exp(powers, out=powers)
        scale = 1 / (n * (powers @ _ONES[: powers.shape[1]]))[:, None]
        return scale, rows_ * scale

    # The gradient of the weights and of the rows: shares, less 1 at the ids.
    powers = hidden @ to_class
    scale, scaled = shares(powers, hidden)
    towards = scaled.T @ powers - by_output.T
    grads = {"wc": towards[:HIDDEN], "bc": towards[HIDDEN]}
    back = powers @ np.ascontiguousarray(params["wc"].T)
    back *= scale
    powers = _inside(hidden, inside, edges)
    scale, scaled = shares(powers, hidden[: edges[-1]])
    further, towards, turned = np.empty((edges[-1], HIDDEN), np.float32), np.zeros((CLASSES, HIDDEN + 1, PER_CLASS), np.float32), np.ascontiguousarray(params["wt"].transpose(0, 2, 1))
    at = edges.tolist()
    for k in range(CLASSES):
        if at[k] < at[k + 1]:
            power = powers[at[k] : at[k + 1]]
            np.matmul(scaled[at[k] : at[k + 1]].T, power, out=towards[k])
            np.matmul(power, turned[k], out=further[at[k] : at[k + 1]])
    towards -= by_learned.transpose(0, 2, 1)
    grads["wt"], grads["bt"] = towards[:, :HIDDEN], towards[:, HIDDEN]
    further *= scale
    back[: edges[-1]] += further
    own = params["wc"].T[output_class(np.arange(INPUTS))]
    own[:LEARNED] += turned.reshape(LEARNED, HIDDEN)
    back -= (own / np.float32(n)).take(ids, axis=0, mode="clip")
    onto = np.zeros((steps * rows, HIDDEN), np.float32)
    onto[seen] = back
    onto = onto.reshape(steps, rows, HIDDEN)
    befores, z_all, r_all, resets, candidates = kept
    given = np.empty((steps, rows, 3 * HIDDEN), np.float32)
    rest = 1 - z_all
    by_update = candidates - befores
    by_update *= z_all
    by_update *= rest
    by_candidate = np.multiply(candidates, candidates, out=candidates)
    np.subtract(1, by_candidate, out=by_candidate)
    by_candidate *= z_all
    by_reset = 1 - r_all
    by_reset *= resets
    uc_back, uzr_back = np.ascontiguousarray(params["uc"].T), np.ascontiguousarray(params["uzr"].T)
    flow, d_c, d_reset, d_gates = (np.zeros((rows, HIDDEN), np.float32) for _ in range(4))
    starts = _starts(fresh)
    for t in reversed(range(steps)):
        d = given[t]
        flow += onto[t]
        np.multiply(flow, by_candidate[t], out=d_c)
        d[:, 2 * HIDDEN :] = d_c
        np.multiply(flow, by_update[t], out=d[:, :HIDDEN])
        np.matmul(d_c, uc_back, out=d_reset)
        np.multiply(d_reset, by_reset[t], out=d[:, HIDDEN : 2 * HIDDEN])
        flow *= rest[t]
        d_reset *= r_all[t]
        flow += d_reset
        np.matmul(d[:, : 2 * HIDDEN], uzr_back, out=d_gates)
        flow += d_gates
        if t in starts:
            flow[starts[t]] = 0
    given = given.reshape(-1, 3 * HIDDEN)
    grads["uc"] = resets.reshape(-1, HIDDEN).T @ given[:, 2 * HIDDEN :]
    grads["uzr"] = befores.reshape(-1, HIDDEN).T @ given[:, : 2 * HIDDEN]
    used = inputs.T.ravel().astype(np.int16)
    order = np.argsort(used, kind="stable")
    by_input = _summed_by(used[order], given.take(order, axis=0, mode="clip"), INPUTS)
    grads["embed"], grads["wx"], grads["bx"] = by_input @ params["wx"].T, params["embed"].T @ by_input, by_input.sum(axis=0)
    return grads, last


def _summed_by(ids: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """The sum of the rows of each id; ids ascend."""
    out = np.zeros((count, rows.shape[1]), np.float32)
    if len(ids):
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out[ids[first]] = np.add.reduceat(rows, first, axis=0)
    return out


class Trainer:
    """Adam over windows of sequences; the state is carried between the windows of a sequence.

    The parameters are views of one vector, in which they are moved together.
    """

    def __init__(self, params: dict):
        self.flat = pack(params)
        self.params = _views(self.flat, params)
        self.first, self.second, self.spare = (np.zeros_like(self.flat) for _ in range(3))
        self.step = 0

    def read(self, sequences: list[np.ndarray]) -> None:
        """One pass over the sequences."""
        held = Lanes(sequences, TRAIN_LANES)
        state = np.zeros((len(held.ends), HIDDEN), np.float32)
        for at in range(0, held.ends.max(), TRAIN_WINDOW):
            on = held.left(at)
            state = state if on is None else state[on]
            inputs, targets, owner, fresh = held.window(at, TRAIN_WINDOW)
            grads, state = gradients(self.params, inputs.T, targets.T, owner.T >= 0, fresh.T, state)
            self._update(grads)

    def _update(self, grads: dict) -> None:
        self.step += 1
        g, spare = pack(grads), self.spare
        norm = float(np.sqrt(g @ g))
        rate = np.float32(RATE / np.sqrt(1 + self.step / 400) / (1 - 0.9**self.step))
        scale = np.float32(1 / (1 - 0.99**self.step))
        g *= np.float32(min(1.0, CLIP / max(norm, 1e-9)))
        self.first *= np.float32(0.9)
        self.first += np.multiply(g, np.float32(0.1), out=spare)
        g *= g
        g *= np.float32(0.01)
        self.second *= np.float32(0.99)
        self.second += g
        np.sqrt(np.multiply(self.second, scale, out=spare), out=spare)
        spare += np.float32(1e-6)
        np.divide(np.multiply(self.first, rate, out=g), spare, out=g)
        self.flat -= g
        for name in ("wc", "wt"):
            np.clip(self.params[name], -LARGEST, LARGEST, out=self.params[name])


def trained(params: dict, sequences: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Parameters after one pass over the sequences."""
    if not sequences:
        return params
    trainer = Trainer(params)
    trainer.read(sequences)
    return trainer.params
