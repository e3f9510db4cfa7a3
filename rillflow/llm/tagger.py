"""Character-level bidirectional LSTM with CRF transitions, in numpy: inference for many windows at once, and training.

Embedding and input weights are one table (a row a character), so the only product a step needs is the recurrent one.
Both directions run as one stacked product. Gate order: input, forget, output, candidate. The squashing function is
x / (1 + |x|), which numpy computes many times faster than tanh.
"""

from __future__ import annotations

import unicodedata

import numpy as np

TYPES = ("email", "phone", "id_number", "street_address", "name")
#: O, then B and I of each type.
TAGS = 1 + 2 * len(TYPES)
_MARKS = " \n.,:;-–'\"()[]{}|/\\@+#&=_<>!?*%$§°º“”’"
_LOWER, _UPPER, _DIGIT, _MARK = 1, 27, 53, 63
OTHER_LOWER, OTHER_UPPER, OTHER = _MARK + len(_MARKS), _MARK + len(_MARKS) + 1, _MARK + len(_MARKS) + 2
SYMBOLS = OTHER + 1
#: Stretches of which the paths are searched at once.
STRETCHES = 512


def _table(size: int = 0x2200) -> np.ndarray:
    """Symbol of each code point: letters by their base letter and case, digits, common marks."""
    out = np.full(size, OTHER, np.int16)
    for i in range(size):
        ch = chr(i)
        base = unicodedata.normalize("NFD", ch)[0]
        if "a" <= base <= "z":
            out[i] = _LOWER + ord(base) - 97
        elif "A" <= base <= "Z":
            out[i] = _UPPER + ord(base) - 65
        elif "0" <= base <= "9":
            out[i] = _DIGIT + ord(base) - 48
        elif ch in _MARKS:
            out[i] = _MARK + _MARKS.index(ch)
        elif ch.isspace():
            out[i] = _MARK
        elif ch.islower():
            out[i] = OTHER_LOWER
        elif ch.isupper():
            out[i] = OTHER_UPPER
    return out


_CODES = _table()


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER).astype(np.int16)


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (batch, length), 0 where padded, and the mask."""
    n = max(map(len, rows))
    out = np.zeros((len(rows), n), np.int16)
    mask = np.zeros((len(rows), n), bool)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
        mask[i, : len(r)] = True
    return out, mask


class Tagger:
    NAMES = ("table", "recur", "out", "bias", "trans", "start", "end")

    def __init__(self, hidden: int = 32, seed: int = 0):
        r = np.random.default_rng(seed)
        f = np.float32
        self.hidden = hidden
        self.table = (r.normal(0, 0.3, (2, SYMBOLS, 4 * hidden))).astype(f)
        self.table[:, :, hidden : 2 * hidden] += 0.5
        self.recur = (r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden))).astype(f)
        self.out = (r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS))).astype(f)
        self.bias = np.zeros(TAGS, f)
        self.trans, self.start, self.end = np.zeros((TAGS, TAGS), f), np.zeros(TAGS, f), np.zeros(TAGS, f)

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{n: getattr(self, n).astype(np.float16) for n in self.NAMES})

    @classmethod
    def load(cls, path) -> "Tagger":
        with np.load(path) as z:
            t = cls(z["recur"].shape[1])
            for n in cls.NAMES:
                setattr(t, n, z[n].astype(np.float32))
        return t

    def emissions(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Tag scores (length, batch, tags). keep: gets what the backward pass needs."""
        b, t = x.shape
        h4 = self.hidden
        both = np.stack([x, x[:, ::-1]])  # direction, batch, length
        live = np.stack([mask, mask[:, ::-1]]).astype(np.float32)
        h, c = np.zeros((2, b, h4), np.float32), np.zeros((2, b, h4), np.float32)
        hs = np.empty((t, 2, b, h4), np.float32)
        side, one, half = np.arange(2)[:, None], np.float32(1), np.float32(0.5)
        for s in range(t):
            z = self.table[side, both[:, :, s]] + h @ self.recur
            z /= np.abs(z) + one
            gates = z[..., : 3 * h4]
            gates *= half
            gates += half
            m = live[:, :, s, None]
            prev_c, prev_h = c, h
            c = (z[..., h4 : 2 * h4] * c + z[..., :h4] * z[..., 3 * h4 :]) * m
            tc = c / (np.abs(c) + one)
            h = z[..., 2 * h4 : 3 * h4] * tc * m
            hs[s] = h
            if keep is not None:
                keep.append((z, prev_c, prev_h, tc, m))
        features = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)
        if keep is not None:
            keep.append((features, both))
        return features @ self.out + self.bias

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The same as `emissions` (but for the rounding of the last sums), for decoding alone: gates lie one after the other and are
        computed in place; their halves are taken out of them and into the weights behind. What a step works on stays in the cache, as
        only the scores of the tags are kept of it. Padding has no candidate, so a state of zero stays zero there and needs no mask."""
        b, t = x.shape
        h4 = self.hidden
        one, half = np.float32(1), np.float32(0.5)
        table = self.table.reshape(2 * SYMBOLS, 4, h4).transpose(1, 0, 2).reshape(-1, h4)
        table.reshape(4, 2, SYMBOLS, h4)[3, :, 0] = 0
        recur = np.ascontiguousarray((self.recur * half).reshape(2, h4, 4, h4).transpose(2, 0, 1, 3))
        out = np.ascontiguousarray((self.out * half).reshape(2, h4, TAGS).transpose(0, 2, 1))
        x = np.where(mask, x, 0)
        rows = np.ascontiguousarray(np.stack([x, x[:, ::-1] + SYMBOLS]).transpose(2, 0, 1)).astype(np.intp)
        gate = 2 * SYMBOLS * np.arange(4)[:, None, None]
        z, h, c = np.empty((4, 2, b, h4), np.float32), np.zeros((2, b, h4), np.float32), np.zeros((2, b, h4), np.float32)
        size, at, part = np.empty_like(z), np.empty((4, 2, b), np.intp), np.empty((2, TAGS, b), np.float32)
        e = np.empty((t, TAGS, b), np.float32)
        e[:] = self.bias[:, None]
        for s in range(t):
            np.take(table, np.add(rows[s], gate, out=at), axis=0, out=z, mode="clip")
            np.matmul(h, recur, out=size)
            z += size
            np.abs(z, out=size)
            size += one
            z /= size
            z[:3] += one
            c *= z[1]
            c += np.multiply(z[0], z[3], out=z[0])
            c *= half
            np.abs(c, out=size[0])
            size[0] += one
            np.divide(c, size[0], out=h)
            h *= z[2]
            np.matmul(out, h.transpose(0, 2, 1), out=part)
            e[s] += part[0]
            e[t - 1 - s] += part[1]
        return e.transpose(0, 2, 1)

    def _hopeful(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Positions (length, batch) that the best path may give to an entity. No stretch of entity tags over one of the others can score as
        much as none there, even if it changes between the first tags of all types, and between the others, at the best transition of
        any: the best path has no entity there."""
        t, b, _ = e.shape
        tags = (np.arange(1, TAGS, 2), np.arange(2, TAGS, 2))
        none = self.trans[0, 0]
        by_tag = e.transpose(0, 2, 1)
        over = np.stack([by_tag[:, 1::2].max(1), by_tag[:, 2::2].max(1)], 1)
        over -= by_tag[:, :1]
        over[~np.broadcast_to(mask.T[:, None], over.shape)] = -1e9
        column = lambda values: np.array(values, np.float32)[:, None]
        step = [[self.trans[np.ix_(p, q)].max() - none for q in tags] for p in tags]
        into, onto = [column(x) for x in step], [column(x) for x in zip(*step)]
        enter, leave = column([self.trans[0, q].max() - none for q in tags]), column([self.trans[p, 0].max() - none for p in tags])
        starts, ends = column([self.start[q].max() - self.start[0] for q in tags]), column([self.end[p].max() - self.end[0] for p in tags])
        last = mask.sum(1) - 1
        # The most that a stretch scores up to each position, with it; and from there on, without it.
        before, after, other = np.empty_like(over), np.empty_like(over), np.empty((2, b), np.float32)
        np.add(over[0], starts, out=before[0])
        for s in range(1, t):
            np.add(before[s - 1, 0], into[0], out=before[s])
            np.maximum(before[s], np.add(before[s - 1, 1], into[1], out=other), out=before[s])
            np.maximum(before[s], enter, out=before[s])
            before[s] += over[s]
        after[:] = leave
        after[last, :, np.arange(b)] = ends[:, 0]
        for s in range(t - 2, -1, -1):
            then = over[s + 1]
            then += after[s + 1]
            np.maximum(after[s], np.add(then[0], onto[0], out=other), out=after[s])
            np.maximum(after[s], np.add(then[1], onto[1], out=other), out=after[s])
        before += after
        return before.max(1) > -1e-2

    def decode(self, rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best tag path of each row of symbols, and for each position how far the best tag's score lies above that of no entity. The path
        is searched in each hopeful stretch alone, between the positions without entity beside it."""
        x, mask = pad(rows)
        e = self.scores(x, mask)
        out = [(np.zeros(len(r), np.int8), np.zeros(len(r), np.float32)) for r in rows]
        edges = np.diff(np.pad(self._hopeful(e, mask).T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, first), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
        a, z = np.maximum(first - 1, 0), np.minimum(end + 1, mask.sum(1)[row])
        order = np.argsort(z - a, kind="stable")
        for k in range(0, len(order), STRETCHES):
            some = order[k : k + STRETCHES]
            at = a[some] + np.arange((z - a)[some].max())[:, None]
            part = e[np.minimum(at, len(e) - 1), row[some]]
            part[(at < first[some]) | (at >= end[some]), 1:] = -1e9
            for i, (path, gain) in zip(some, self._paths(part, (at < z[some]).T)):
                n = z[i] - a[i]
                out[row[i]][0][a[i] : z[i]], out[row[i]][1][a[i] : z[i]] = path[:n], gain[:n]
        return out

    def _paths(self, e: np.ndarray, mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        t, b, k = e.shape
        lens = mask.sum(1)
        # Longest rows first: those that go on at a position are the first `on` of them.
        order = np.argsort(-lens, kind="stable")
        e, on = e[:, order], [*(lens > np.arange(t)[:, None]).sum(1).tolist(), 0]
        score, step = np.empty((t, b, k), np.float32), np.empty((k, b, k), np.float32)
        score[0] = self.start + e[0]
        for s in range(1, t):
            n = on[s]
            np.add(score[s - 1, :n].T[:, :, None], self.trans[:, None], out=step[:, :n])
            np.add(step[:, :n].max(0), e[s, :n], out=score[s, :n])
        path = np.zeros((t, b), np.int8)
        for s in range(t - 1, -1, -1):
            n, m = on[s], on[s + 1]
            if m:
                path[s, :m] = (score[s, :m] + self.trans.T[path[s + 1, :m]]).argmax(1)
            if n > m:
                path[s, m:n] = (score[s, m:n] + self.end).argmax(1)
        gain = np.take_along_axis(e, path[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]
        place = np.argsort(order)
        return [(path[:, i], gain[:, i]) for i in place]

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths y (batch, length) and its gradients."""
        keep: list = []
        e = self.emissions(x, mask, keep).astype(np.float64)
        features, both = keep.pop()
        t, b, k = e.shape
        tr, at = self.trans.astype(np.float64), np.arange(b)
        live = mask.T
        alpha = np.empty((t, b, k))
        alpha[0] = self.start + e[0]
        for s in range(1, t):
            z = alpha[s - 1][:, :, None] + tr
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[s]
            alpha[s] = np.where(live[s][:, None], new, alpha[s - 1])
        z = alpha[-1] + self.end
        top = z.max(1)
        whole = top + np.log(np.exp(z - top[:, None]).sum(1))
        beta = np.empty((t, b, k))
        beta[-1] = self.end
        d_trans = np.zeros((k, k))
        for s in range(t - 2, -1, -1):
            z = tr + (e[s + 1] + beta[s + 1])[:, None, :]
            top = z.max(2)
            new = top + np.log(np.exp(z - top[:, :, None]).sum(2))
            on = live[s + 1][:, None]
            beta[s] = np.where(on, new, beta[s + 1])
            pair = np.exp(alpha[s][:, :, None] + z - whole[:, None, None]) * on[:, :, None]
            d_trans += pair.sum(0)
        marginal = np.exp(alpha + beta - whole[:, None]) * live[:, :, None]
        yt = y.T
        d_e = marginal.copy()
        lens = mask.sum(1)
        for s in range(t):
            on = live[s]
            d_e[s, at[on], yt[s, on]] -= 1
        gold = (self.start[yt[0]] + self.end[yt[lens - 1, at]]).astype(np.float64)
        gold += (np.take_along_axis(e, yt[:, :, None].astype(np.int64), 2)[:, :, 0] * live).sum(0)
        for s in range(1, t):
            on = live[s]
            gold[on] += tr[yt[s - 1, on], yt[s, on]]
            np.add.at(d_trans, (yt[s - 1, on], yt[s, on]), -1)
        d_start = marginal[0].sum(0)
        np.add.at(d_start, yt[0], -1)
        d_end = marginal[lens - 1, at].sum(0)
        np.add.at(d_end, yt[lens - 1, at], -1)
        d_e = (d_e / b).astype(np.float32)
        g = {"trans": d_trans / b, "start": d_start / b, "end": d_end / b, "bias": d_e.sum((0, 1)), "out": np.einsum("tbf,tbk->fk", features, d_e, optimize=True)}
        d_f = d_e @ self.out.T
        h4 = self.hidden
        d_hs = np.stack([d_f[:, :, :h4], d_f[::-1, :, h4:]], 1)
        d_h, d_c = np.zeros((2, b, h4), np.float32), np.zeros((2, b, h4), np.float32)
        d_table, d_recur = np.zeros_like(self.table), np.zeros_like(self.recur)
        all_d = np.empty((t, 2, b, 4 * h4), np.float32)
        for s in range(t - 1, -1, -1):
            z, prev_c, prev_h, tc, m = keep[s]
            i, f, o, c_ = (z[..., q * h4 : (q + 1) * h4] for q in range(4))
            d_z = all_d[s]
            d_h = (d_h + d_hs[s]) * m
            d_c = (d_c + d_h * o * (1 - np.abs(tc)) ** 2) * m
            d_z[..., :h4] = d_c * c_
            d_z[..., h4 : 2 * h4] = d_c * prev_c
            d_z[..., 2 * h4 : 3 * h4] = d_h * tc
            d_z[..., 3 * h4 :] = d_c * i * (1 - np.abs(c_)) ** 2
            gates = z[..., : 3 * h4]
            d_z[..., : 3 * h4] *= 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            d_recur += prev_h.transpose(0, 2, 1) @ d_z
            d_h = d_z @ self.recur.transpose(0, 2, 1)
            d_c = d_c * f
        for d in range(2):
            symbols = both[d].T.ravel()
            order = np.argsort(symbols, kind="stable")
            found, first = np.unique(symbols[order], return_index=True)
            d_table[d, found] = np.add.reduceat(all_d[:, d].reshape(-1, 4 * h4)[order], first, axis=0)
        g |= {"table": d_table, "recur": d_recur}
        return float((whole - gold).mean()), g

    def fit(self, draw, steps: int, rate: float = 4e-3, clip: float = 5.0, say=None, workers: int = 1) -> None:
        """Adam over `steps` batches of draw(step, part) -> (rows of symbols, rows of tags), drawn and computed in `workers` parts by as
        many processes; the rate falls to a twentieth along a cosine."""
        import multiprocessing

        first = {n: np.zeros_like(getattr(self, n), np.float64) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n), np.float64) for n in self.NAMES}
        _Part.tagger, _Part.draw = self, draw
        pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
        for s in range(1, steps + 1):
            now = {n: getattr(self, n) for n in self.NAMES}
            jobs = [(s, k, now) for k in range(workers)]
            parts = pool.map(_Part.gradients, jobs, 1) if pool else [_Part.gradients(jobs[0])]
            value = sum(v for v, _ in parts) / workers
            g = {n: sum(x[n] for _, x in parts) / workers for n in self.NAMES}
            norm = np.sqrt(sum(float((v.astype(np.float64) ** 2).sum()) for v in g.values()))
            scale = min(1.0, clip / (norm + 1e-9))
            lr = rate * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * s / steps)))
            for n in self.NAMES:
                v = g[n] * scale
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.99 * second[n] + 0.01 * v * v
                getattr(self, n)[...] -= (lr * (first[n] / (1 - 0.9**s)) / (np.sqrt(second[n] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
            if say and s % 50 == 0:
                say(s, value)
        if pool:
            pool.close()
            pool.join()


class _Part:
    """One process's part of a batch."""

    tagger: Tagger
    draw = None

    @staticmethod
    def gradients(job) -> tuple[float, dict[str, np.ndarray]]:
        step, part, now = job
        for n, v in now.items():
            setattr(_Part.tagger, n, v)
        rows, tags = _Part.draw(step, part)
        x, mask = pad(rows)
        y = np.zeros(x.shape, np.int64)
        for i, r in enumerate(tags):
            y[i, : len(r)] = r
        return _Part.tagger.loss(x, mask, y)
