"""A small causal self-attention model of subword ids, in numpy.

A token is a word or the end of a text, given by its subword ids; its embedding is the sum of theirs.
An id either begins a token or goes on with one. The probability of a token is a product over its ids:
each is drawn among the ids of its sort, and after each the token goes on or ends. One attention layer over
the tokens before gives the weights of ``KINDS`` distributions over ids, and an id has, among its sort,

    follow * P(id | id before) + (1 - follow + follow * left) * sum of weight * part(id) / that of the sort

with the discounted counts of all pairs of ids in the first term and what the discount leaves in the
second. Whether a token goes on is counted after each id. So all words and the end add up to at most 1
after any text, a probability costs a few products and no softmax over the vocabulary, and the parts
are estimated by expectation maximisation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDTH = 16
KINDS = 32
WINDOW = 32
CONTEXT = 8
STRIDE = WINDOW - CONTEXT
DISCOUNT = 0.75
NAMES = ("embed", "query", "key", "value", "gate", "recency")


def looked_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts by sorted keys, 0 for keys that are not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def told_apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys (numbers from 0) in order, the first place of each, which of them stands at each
    place, and how often each occurs. Key and place are sorted as one number where they fit into one."""
    shift = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + shift > 63:
        return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    both = np.sort(keys << shift | np.arange(len(keys)))
    place, both = both & ((1 << shift) - 1), both >> shift
    new = np.ones(len(keys), bool)
    new[1:] = both[1:] != both[:-1]
    first = np.flatnonzero(new)
    same = np.empty(len(keys), np.int64)
    same[place] = np.cumsum(new) - 1
    return both[first], place[first], same, np.diff(first, append=len(keys))


def of_own_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each key (numbers from 0) occurs in its own row."""
    _, _, same, n = told_apart(rows * (keys.max(initial=0) + 1) + keys)
    return n[same]


def _no_keys() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Pairs:
    """Counts of neighbouring ids: sorted keys (id before << 32 | id) of common pairs, their counts, and by
    sort (0: begins a token, 1: goes on) how often each id stands ``before`` one, and before how many
    ``different`` ones. ``more`` and ``more_counts`` are those of the rarer pairs of the texts at hand; a
    pair in neither stands nowhere."""

    keys: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    different: np.ndarray
    more: np.ndarray = field(default_factory=_no_keys)
    more_counts: np.ndarray = field(default_factory=_no_keys)

    def probability(self, before: np.ndarray, ids: np.ndarray, later: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(id | id before) of discounted counts among the ids of its sort, and what the discount leaves to
        others of the sort: 1 after an id that never stands before any. ``rows`` are the texts of ids that
        were counted themselves: each is then met by the counts of the other texts only, as a text to be
        scored is."""
        if not self.before.any():
            return np.zeros(len(ids), np.float32), np.ones(len(ids), np.float32)
        wanted, first, same, _ = told_apart(before * len(self.before) + ids)  # in order, so found fast
        of = before[first]
        wanted = of << 32 | ids[first]
        n = looked_up(self.keys, self.counts, wanted) + looked_up(self.more, self.more_counts, wanted)
        all_after, different = self.before[of, later[first]], self.different[of, later[first]]
        if rows is not None:
            n, all_after = n[same] - of_own_row(same, rows), all_after[same] - of_own_row(2 * before + later, rows)
            different, same = np.minimum(different[same], all_after), slice(None)
        p = np.maximum(n - DISCOUNT, 0) / np.maximum(all_after, 1)
        left = np.where(all_after > 0, DISCOUNT * different / np.maximum(all_after, 1), 1.0)
        return p.astype(np.float32)[same], left.astype(np.float32)[same]

    def sort(self, before: np.ndarray, later: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The probability that what follows an id is of the given sort. One count is shared out as both
        sorts are over all; ``rows`` as above."""
        every = self.before.sum(0)
        n, all_after = self.before[before, later], (self.before[:, 0] + self.before[:, 1])[before]
        if rows is not None:
            n, all_after = np.maximum(n - of_own_row(2 * before + later, rows), 0), np.maximum(all_after - of_own_row(before, rows), 0)
        return (n + ((every + 1) / (every.sum() + 2))[later]) / (all_after + 1)


@dataclass
class Attention:
    """Parameters. ``parts`` has a column for each kind that sums to 1; ``follow`` is the weight of the
    pair for the first id of a token and for later ones."""

    embed: np.ndarray
    parts: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    gate: np.ndarray  # the last row is the bias
    recency: np.ndarray
    follow: np.ndarray
    leads: np.ndarray  # whether an id begins a token
    seen: dict[str, np.ndarray] = field(default_factory=dict)
    _mass: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)  # of which parts, and their mass

    @classmethod
    def fresh(cls, n_ids: int, seed: int, leads: np.ndarray | None = None) -> "Attention":
        random = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        square = (WIDTH, WIDTH)
        return cls(
            embed=normal(n_ids, WIDTH, scale=0.3),
            parts=np.full((n_ids, KINDS), 1.0 / n_ids, np.float32),
            query=normal(*square, scale=0.25),
            key=normal(*square, scale=0.25),
            value=normal(*square, scale=0.25),
            gate=normal(WIDTH + 1, KINDS, scale=0.3),
            recency=np.zeros(WINDOW, np.float32),
            follow=np.full(2, 0.5, np.float32),
            leads=np.ones(n_ids, bool) if leads is None else leads,
        )

    @property
    def mass(self) -> np.ndarray:
        """What each kind gives to the ids of either sort, a row for each sort; added up once for the same parts."""
        if self._mass is None or self._mass[0] is not self.parts:
            lead = self.parts[self.leads].sum(0, dtype=np.float64)
            self._mass = self.parts, np.stack([lead, self.parts.sum(0, dtype=np.float64) - lead]).clip(1e-30)
        return self._mass[1]


@dataclass
class Tokens:
    """Subword ids of some texts end to end: where tokens end among them, and where texts end among the
    tokens. ``start`` is the id that stands before a text. If known, ``which`` tells equal tokens: the
    place of each among the different ones, whose ids are ``word_ids`` and begin at ``word_begins``."""

    ids: np.ndarray
    ends: np.ndarray
    texts: np.ndarray
    start: int
    which: np.ndarray | None = None
    word_ids: np.ndarray | None = None
    word_begins: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.first = np.concatenate([[0], self.texts[:-1]])  # the first token of every text
        self.row = np.repeat(np.arange(len(self.texts)), self.texts - self.first)
        self.owner = np.repeat(np.arange(len(self.ends)), self.ends - self.begins)
        self.before = np.concatenate([[self.start], self.ids[:-1]])
        self.before[self.begins[self.first]] = self.start
        self.later = np.ones(len(self.ids), np.int64)
        self.later[self.begins] = 0

    @property
    def goes_on(self) -> np.ndarray:
        return np.flatnonzero(self.later)

    @property
    def is_word(self) -> np.ndarray:
        """Tokens that end as words do, unlike the end of a text."""
        return np.flatnonzero(self.ids[self.ends - 1] != self.start)


def windows(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every window (-1: none), and of those the ones that it scores.

    A window scores 24 tokens and sees the 8 before them and, of its own, those before each; so every
    token is scored in one window.
    """
    starts = np.concatenate([[0], texts[:-1]])
    count = -(-(texts - starts) // STRIDE)
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (starts[text] + number * STRIDE - CONTEXT)[:, None] + np.arange(WINDOW)
    inside = (at >= starts[text][:, None]) & (at < texts[text][:, None])
    at = np.where(inside, at, -1)
    return at, at[:, CONTEXT:]


_BEHIND = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)
_CAUSAL = (_BEHIND >= 0).astype(np.float32)
_ONES = np.ones((WINDOW, 1), np.float32)
_BACK = np.maximum(_BEHIND, 0)


def _sums(values: np.ndarray, which: np.ndarray, different: int) -> np.ndarray:
    """Rows added up by which of ``different`` sums they belong to."""
    wide = values.shape[1]
    at = (which[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(at, values.ravel(), different * wide).reshape(different, wide).astype(np.float32)


def _inputs(model: Attention, tokens: Tokens) -> np.ndarray:
    """What stands at the place of each token: the embedding of the token before it."""
    known = tokens.which is not None
    ids, begins = (tokens.word_ids, tokens.word_begins) if known else (tokens.ids, tokens.begins)
    sums = np.empty((len(begins), WIDTH), np.float32)
    bounds = np.append(begins, len(ids))
    for a in range(0, len(begins), 2048):  # small enough to stay in the cache
        part = bounds[a : a + 2049]
        of = np.repeat(np.arange(len(part) - 1), np.diff(part))
        sums[a : a + 2048] = _sums(model.embed.take(ids[part[0] : part[-1]], axis=0), of, len(part) - 1)
    if known:
        sums = sums.take(tokens.which, axis=0)
    x = np.empty_like(sums)
    x[1:] = sums[:-1]
    x[tokens.first] = model.embed[tokens.start]
    return x


def project(model: Attention, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and values of all places, once for all windows."""
    return x @ (model.query * np.float32(WIDTH**-0.5)), x @ model.key, x @ model.value


def forward(model: Attention, x: np.ndarray, projected: tuple[np.ndarray, ...], places: np.ndarray) -> tuple[np.ndarray, dict]:
    """Weights of the kinds for every scored token: attention over a batch of windows, masked to what is
    there (-1: nothing) and not ahead."""
    at = np.maximum(places, 0)
    own = at[:, CONTEXT:]
    late, q = x.take(own, axis=0), projected[0].take(own, axis=0)
    k, v = projected[1].take(at, axis=0), projected[2].take(at, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += model.recency[_BACK]
    np.clip(s, np.float32(-30), np.float32(30), out=s)
    np.exp(s, out=s)
    s *= _CAUSAL
    some = np.flatnonzero((places < 0).any(1))
    if len(some):
        s[some] *= (places[some] >= 0).astype(np.float32)[:, None, :]
    total = np.maximum((s.reshape(-1, WINDOW) @ _ONES).reshape(*s.shape[:2], 1), np.float32(1e-30))
    h = s @ v
    h /= total
    h += late
    z = h.reshape(-1, WIDTH) @ model.gate[:-1]
    z += model.gate[-1]
    np.clip(z, np.float32(-50), np.float32(30), out=z)
    np.exp(z, out=z)
    z *= 1 / (z @ np.ones((KINDS, 1), np.float32))
    z = z.reshape(*h.shape[:2], KINDS)
    return z, {"late": late, "q": q, "k": k, "v": v, "s": s, "total": total, "h": h}


def _borders(pairs: Pairs, tokens: Tokens, rows: bool = False) -> np.ndarray:
    """For every token the log probability of going on after all of its ids but the last, and of ending there."""
    on, last = tokens.goes_on, tokens.ends[tokens.is_word] - 1
    every = np.zeros(len(tokens.ids))
    at = np.concatenate([tokens.before[on], tokens.ids[last]])
    sort = np.concatenate([np.ones(len(on), np.int64), np.zeros(len(last), np.int64)])
    if rows:
        of = tokens.row[tokens.owner]
        p = np.log(pairs.sort(at, sort, np.concatenate([of[on], of[last]])))
    else:  # the same after every occurrence of an id
        ids, _, same, _ = told_apart(2 * at + sort)
        p = np.log(pairs.sort(ids >> 1, ids & 1))[same]
    every[on] = p[: len(on)]
    every[last] += p[len(on) :]
    return np.add.reduceat(every, tokens.begins)


def log_probabilities(model: Attention, pairs: Pairs, tokens: Tokens, step: int = 64) -> np.ndarray:
    """The natural log probability of every token; each is scored once."""
    x = _inputs(model, tokens)
    at, scored = windows(tokens.texts)
    projected = project(model, x)
    mass, sort = model.mass.astype(np.float32), 2 * tokens.owner + tokens.later
    mixed = np.empty(len(tokens.ids), np.float32)
    for a in range(0, len(at), step):
        places, mine = at[a : a + step], scored[a : a + step]
        real = np.flatnonzero(mine >= 0)  # tokens that follow each other
        w, _ = forward(model, x, projected, places)
        w, t0 = w.reshape(-1, KINDS).take(real, axis=0), mine[0, 0]
        own = slice(tokens.begins[t0], tokens.ends[t0 + len(real) - 1])
        part = model.parts.take(tokens.ids[own], axis=0)
        mixed[own] = np.einsum("ik,ik->i", w.take(tokens.owner[own] - t0, axis=0), part)
        mixed[own] /= (w @ mass.T).ravel().take(sort[own] - 2 * t0)
    follow = model.follow[tokens.later]
    paired, left = pairs.probability(tokens.before, tokens.ids, tokens.later)
    p = follow * paired + (1 - follow + follow * left) * mixed.astype(np.float64)
    return np.add.reduceat(np.log(np.maximum(p, 1e-30)), tokens.begins) + _borders(pairs, tokens)


def learn(
    model: Attention, pairs: Pairs, tokens: Tokens, soft: np.ndarray, follow: np.ndarray, rate: float, step: int = 128
) -> np.ndarray:
    """One pass over the windows of some texts: Adagrad steps on the attention, in place; expected counts
    of (id, kind) are added to ``soft``, and the slope of the log likelihood by ``follow`` and its fall to ``follow``. The texts are among
    the counted ones, so every pair is counted in the other texts only. The log probability of every token,
    before the step that learns from it, is returned."""
    at, scored = windows(tokens.texts)
    paired, left = pairs.probability(tokens.before, tokens.ids, tokens.later, tokens.row[tokens.owner])
    mass = model.mass.astype(np.float32)
    f = model.follow[tokens.later]
    rest, lost, paired_share = 1 - f + f * left, 1 - left, f * paired + np.float32(1e-30)
    sort = 2 * tokens.owner + tokens.later  # of each id, among the two sorts of its token
    logs = np.zeros(len(tokens.ends))
    for a in range(0, len(at), step):
        places, mine = at[a : a + step], scored[a : a + step]
        real = np.flatnonzero(mine >= 0)
        lo, hi = places[places >= 0].min(), places.max() + 1  # windows follow each other
        t0 = mine[0, 0]  # and so do the tokens that they score: t0 to hi
        i0, i1 = tokens.begins[lo], tokens.ends[hi - 1]
        heads = tokens.first[(tokens.first >= lo) & (tokens.first < hi)] - lo
        x_all = np.empty((hi - lo, WIDTH), np.float32)
        of = tokens.owner[i0:i1] - lo
        x_all[1:] = _sums(model.embed.take(tokens.ids[i0:i1], axis=0), of, hi - lo)[:-1]
        x_all[0] = model.embed[tokens.start]
        x_all[heads] = model.embed[tokens.start]
        inner = np.where(places >= 0, places - lo, -1)
        weights, c = forward(model, x_all, project(model, x_all), inner)

        # For every id its weights by kind, times its part of each kind, is what attention gives it.
        own = slice(tokens.begins[t0], i1)
        ids, begins, which = tokens.ids[own], tokens.begins[t0:hi] - tokens.begins[t0], tokens.owner[own] - t0
        of_token = weights.reshape(-1, KINDS).take(real, axis=0)
        w, part = of_token.take(which, axis=0), model.parts.take(ids, axis=0)
        of_sort = (of_token @ mass.T).ravel().take(sort[own] - 2 * t0)
        mixed = np.einsum("ik,ik->i", w, part) / of_sort
        total = paired_share[own] + rest[own] * mixed
        slope = (paired[own] - lost[own] * mixed) / total
        logs[t0:hi] = np.add.reduceat(np.log(total.astype(np.float64)), begins)
        follow += np.column_stack([np.bincount(tokens.later[own], x, 2) for x in (slope, slope * slope)])
        pull = rest[own] / (total * of_sort)
        w *= pull[:, None]
        part *= pull[:, None]
        known, same = _grouped(tokens.ids[i0:i1], len(model.parts))
        soft[known] += model.parts[known] * _sums(w, same[tokens.begins[t0] - i0 :], len(known))
        back = np.bincount(sort[own] - 2 * t0, pull * mixed, 2 * (hi - t0)).astype(np.float32).reshape(-1, 2) @ mass
        flat = np.zeros((weights.shape[0] * weights.shape[1], KINDS), np.float32)
        flat[real] = of_token * (_sums(part, which, hi - t0) - back) / np.float32(max(hi - t0, 1))

        c["a"] = c["s"]
        c["a"] *= 1 / c["total"]
        dh = (flat @ model.gate[:-1].T).reshape(c["h"].shape)
        ds = dh @ c["v"].transpose(0, 2, 1)
        ds -= np.einsum("nij,nij->ni", ds, c["a"])[..., None]
        ds *= c["a"]
        dq = ds @ c["k"] * np.float32(WIDTH**-0.5)
        dk = ds.transpose(0, 2, 1) @ c["q"]  # q is scaled already
        dv = c["a"].transpose(0, 2, 1) @ dh
        dx = dk.reshape(-1, WIDTH) @ model.key.T
        dx += dv.reshape(-1, WIDTH) @ model.value.T
        dx = dx.reshape(dk.shape)
        dx[:, CONTEXT:] += dh + (dq.reshape(-1, WIDTH) @ model.query.T).reshape(dq.shape)
        x = x_all.take(np.maximum(inner, 0), axis=0).reshape(-1, WIDTH)
        steps = {
            "query": c["late"].reshape(-1, WIDTH).T @ dq.reshape(-1, WIDTH),
            "key": x.T @ dk.reshape(-1, WIDTH),
            "value": x.T @ dv.reshape(-1, WIDTH),
            "gate": np.vstack([c["h"].reshape(-1, WIDTH).T @ flat, flat.sum(0)]),
            "recency": np.bincount(_BACK.ravel(), (ds.sum(0) * _CAUSAL).ravel(), WINDOW).astype(np.float32),
        }
        for name, gradient in steps.items():
            _adagrad(model, name, slice(None), gradient, rate)
        # The gradient at a token's place goes to the ids of the token before, or to the start id.
        at_place = np.zeros((hi - lo, WIDTH), np.float32)
        at_place[t0 - lo :] = dx[:, CONTEXT:].reshape(-1, WIDTH).take(real, axis=0)
        before = inner[:, :CONTEXT].ravel()
        seen = np.flatnonzero(before >= 0)  # no token twice
        at_place[before[seen]] += dx[:, :CONTEXT].reshape(-1, WIDTH).take(seen, axis=0)
        start = np.zeros(hi - lo, bool)
        start[heads] = True
        start[0] = True
        to_token = np.zeros_like(at_place)
        to_token[:-1] = at_place[1:]
        to_token[np.flatnonzero(start[1:])] = 0
        _adagrad(model, "embed", known, _sums(to_token.take(of, axis=0), same, len(known)), rate)
        _adagrad(model, "embed", np.array([tokens.start]), at_place[start].sum(0)[None], rate)
    return logs + _borders(pairs, tokens, rows=True)


def _grouped(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and which of them stands at each place. Keys of 16 bits are sorted digit by digit."""
    order = np.argsort(keys.astype(np.uint16) if below <= 1 << 16 else keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    same = np.empty(len(keys), np.int64)
    same[order] = np.cumsum(new) - 1
    return sorted_keys[new], same


def _adagrad(model: Attention, name: str, rows, gradient: np.ndarray, rate: float) -> None:
    held = getattr(model, name)
    if name not in model.seen:
        model.seen[name] = np.full(held.shape, 1e-8, np.float32)
    model.seen[name][rows] += gradient * gradient
    held[rows] += np.float32(rate) * gradient / np.sqrt(model.seen[name][rows])
