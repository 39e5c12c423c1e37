"""Personal data: rules, and a bidirectional LSTM with CRF transitions that adds to them.

Rules (base spans) are exact patterns per kind. The network reads characters; it is trained in numpy
by backpropagation through time from labelled spans: those that the rules find in a bounded sample of
windows (WINDOWS, by least hash), each also shown in written variants the rules miss (a phone without
+, blanks or brackets around an @ or the dots). A span of any kind holds a digit or an @, so windows
cover every place within REACH characters of one, wherever in the text; characters elsewhere are
outside by construction. Windows of SIZE characters overlap by half. Their emissions are averaged by
distance from the window's edge and decoded once per connected region, by one Viterbi pass over all of
it, so a span that crosses windows is found whole.

Added spans never overlap a base span, and hold what their kind needs (number of digits, an @). Spans
are kind:start:end in code points, end exclusive.

Cases: a null or empty text has no span; texts of any length are read whole; with no labelled span the
network adds nothing; repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

KINDS = ("email", "ip", "card", "phone")
SIZE, REACH = 64, 24
#: Windows learned from.
WINDOWS = 1200
EMBED, HIDDEN, EPOCHS = 12, 20, 10
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Least mean probability of an added span's tags by the emissions alone (transitions add to that).
SURE = 0.3

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by rule, in time linear in the text, by kind and then start."""
    out = []
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in _LOCAL_SET:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((0, start, m.end()))
                last = m.end()
            else:
                last = max(last, at + 1)
            at = text.find("@", max(at + 1, last))
    for m in _CHAIN.finditer(text):
        parts = m[0].split(".")
        if len(parts) >= 4:
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((1, at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def line_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# The network -----------------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """Character classes: 0 padding, printable ASCII by itself, then space, letter, other."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((c >= 33) & (c < 127), c - 32, np.where((c <= 32), 95, np.where(c > 127, 96, 97)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN
    p = {"E": rng.normal(0, 0.3, (98, EMBED)), "V": rng.normal(0, 0.2, (2 * h, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, 0.25, (EMBED, 4 * h)), f"U{d}": rng.normal(0, 0.2, (h, 4 * h)), f"b{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
    return {k: v.astype(np.float32) for k, v in p.items()}


#: Transitions that no span has: an inside tag follows its own kind's begin or inside only.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a == b or a == b - 1 for b in range(TAGS)] for a in range(TAGS)])
STARTS = np.array([b == 0 or b % 2 == 1 for b in range(TAGS)])


def forward(p: dict, x: np.ndarray, keep: bool = False):
    """Emissions (n, t, tags) of windows x (n, t) of character classes."""
    n, t = x.shape
    h, emb, outs, caches = HIDDEN, p["E"][x], [], []
    for d in "fb":
        e = emb if d == "f" else emb[:, ::-1]
        z = e @ p[f"W{d}"] + p[f"b{d}"]
        hs, cs, gates = np.zeros((t + 1, n, h), np.float32), np.zeros((t + 1, n, h), np.float32), np.zeros((t, n, 4 * h), np.float32)
        for k in range(t):
            g = z[:, k] + hs[k] @ p[f"U{d}"]
            g[:, : 3 * h] = _sigmoid(g[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(g[:, 3 * h :])
            cs[k + 1] = g[:, h : 2 * h] * cs[k] + g[:, :h] * g[:, 3 * h :]
            hs[k + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[k + 1])
            gates[k] = g
        o = hs[1:].transpose(1, 0, 2)
        outs.append(o if d == "f" else o[:, ::-1])
        caches.append((hs, cs, gates))
    both = np.concatenate(outs, 2)
    em = both @ p["V"] + p["c"]
    return (em, emb, both, caches) if keep else em


def _lse(a, axis):
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_marginals(em: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag marginals, transition expectations summed over time, and log partition."""
    n, t, k = em.shape
    tr = np.where(ALLOWED, p["T"], -30).astype(np.float32)
    st = np.where(STARTS, p["S"], -30).astype(np.float32)
    a, b = np.zeros_like(em), np.zeros_like(em)
    a[:, 0] = em[:, 0] + st
    for i in range(1, t):
        a[:, i] = em[:, i] + _lse(a[:, i - 1, :, None] + tr, 1)
    for i in range(t - 2, -1, -1):
        b[:, i] = _lse(tr + (em[:, i + 1] + b[:, i + 1])[:, None, :], 2)
    z = _lse(a[:, -1], 1)
    marg = np.exp(a + b - z[:, None, None])
    pair = np.zeros((k, k), np.float32)
    for i in range(1, t):
        pair += np.exp(a[:, i - 1, :, None] + tr + (em[:, i] + b[:, i])[:, None, :] - z[:, None, None]).sum(0)
    return marg, pair, z


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of tags y."""
    em, emb, both, caches = forward(p, x, True)
    n, t, h = *x.shape, HIDDEN
    marg, pair, _ = crf_marginals(em, p)
    one = np.eye(TAGS, dtype=np.float32)
    seen = np.zeros((TAGS, TAGS), np.float32)
    np.add.at(seen, (y[:, :-1], y[:, 1:]), 1)
    de = (marg - one[y]) / n
    g = {"T": (pair - seen) / n, "S": de[:, 0].sum(0), "V": both.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS), "c": de.sum((0, 1))}
    dh_all, demb = de @ p["V"].T, np.zeros_like(emb)
    for q, d in enumerate("fb"):
        hs, cs, gates = caches[q]
        dout = dh_all[:, :, q * h : (q + 1) * h]
        dout = dout if d == "f" else dout[:, ::-1]
        dz, dh, dc = np.zeros((n, t, 4 * h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for k in range(t - 1, -1, -1):
            i, f, o, c = (gates[k][:, j * h : (j + 1) * h] for j in range(4))
            tc = np.tanh(cs[k + 1])
            dh = dh + dout[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, k] = np.concatenate([dc * c * i * (1 - i), dc * cs[k] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c * c)], 1)
            dh, dc = dz[:, k] @ p[f"U{d}"].T, dc * f
        g[f"U{d}"] = np.einsum("tnh,ntg->hg", hs[:-1], dz, optimize=True)
        g[f"b{d}"] = dz.sum((0, 1))
        e = emb if d == "f" else emb[:, ::-1]
        g[f"W{d}"] = e.reshape(-1, EMBED).T @ dz.reshape(-1, 4 * h)
        back = dz @ p[f"W{d}"].T
        demb += back if d == "f" else back[:, ::-1]
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], x, demb)
    return g


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on windows x and tags y."""
    p, rng = new_weights(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            rows = order[s : s + batch]
            g = gradients(p, x[rows], y[rows])
            norm = float(np.sqrt(sum(float((w * w).sum()) for w in g.values())))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, w in g.items():
                w = w * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * w
                v[k] = 0.99 * v[k] + 0.01 * w * w
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


# Windows ---------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within REACH of a digit or an @, and on to the ends of words and addresses cut there; merged."""
    at = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * REACH)
    start, end = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    out: list[tuple[int, int]] = []
    for s, e in zip(start, end, strict=True):
        done = out[-1][1] if out else 0  # what regions before hold is not walked again
        s, e = max(0, int(s) - REACH), max(done, min(len(text), int(e) + 1 + REACH))
        while s > done and (text[s - 1].isalnum() or text[s - 1] in "._%+-"):
            s -= 1
        while e < len(text) and (text[e].isalnum() or text[e] in "._%+-"):
            e += 1
        if out and s <= done:
            s = out.pop()[0]
        out.append((s, e))
    return out


def starts(s: int, e: int) -> range:
    return range(s, max(s + 1, e - SIZE // 2), SIZE // 2)


def tags_of(spans: list[tuple[int, int, int]], s: int, e: int) -> np.ndarray:
    y = np.zeros(e - s, np.int64)
    for k, a, b in sorted(spans, key=lambda x: (x[1] - x[2], x)):  # longest first; no overlap
        a, b = a - s, b - s
        if b > 0 and a < e - s and not y[max(a, 0) : b].any():
            y[max(a, 0) : b] = 2 * k + 2
            if a >= 0:
                y[a] = 2 * k + 1
    return y


def variants(text: str, spans: list[tuple[int, int, int]], pick: int) -> tuple[str, list[tuple[int, int, int]]]:
    """text with its spans written as the rules would miss them, and where they are then."""
    out, moved, last = [], [], 0
    for k, a, b in sorted(spans, key=lambda x: x[1]):
        if a < last:
            continue
        s = text[a:b]
        if k == 0:
            s = s.replace("@", (" @ ", "[@]", " [@] ", "(@)")[pick % 4])
        elif k == 1:
            s = s.replace(".", ("[.]", " . ", "(.)", "[.]")[pick % 4])
        elif k == 2:
            s = ("." if pick % 2 else "_").join(digits_of(s)[i : i + 4] for i in range(0, len(digits_of(s)), 4))
        else:
            d = digits_of(s)
            s = (f"({d[:-7][-3:]}) {d[-7:-4]}-{d[-4:]}", f"{d[:-7][-3:]}-{d[-7:-4]}-{d[-4:]}", f"00{d[:-10]} {d[:-7][-3:]} {d[-7:]}", f"{d[:-7][-3:]}.{d[-7:-4]}.{d[-4:]}")[pick % 4]
        out += [text[last:a], s]
        n = sum(map(len, out))
        moved.append((k, n - len(s), n))
        last = b
    return "".join([*out, text[last:]]), moved


def padded(text: str, s: int) -> np.ndarray:
    x = np.zeros(SIZE, np.int64)
    c = codes(text[s : s + SIZE])
    x[: len(c)] = c
    return x


def train(docs: DataFrame, windows: int = WINDOWS) -> dict | None:
    """Weights from the spans that the rules find around a sample of windows; None without any.

    Regions of up to 4 SIZE characters are learned from, windows of them in all, of least hash; longer
    ones are decoded all the same. Each task hands over no more than that, so nothing else is exchanged.
    """

    most = {True: windows * 3 // 4, False: windows // 4}

    def gather(batches):
        import pyarrow as pa

        kept: dict[bool, dict[str, tuple]] = {True: {}, False: {}}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text or not _TRIGGER.search(text):
                    continue
                spans = base_spans(text)
                for s, e in regions(text):
                    own = [(k, a - s, b - s) for k, a, b in spans if a >= s and b <= e and b - a <= SIZE]
                    part = text[s:e]
                    h = hashlib.md5(part.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
                    if e - s <= 4 * SIZE:
                        kept[bool(own)][h] = h, part, ",".join(f"{k}:{a}:{b}" for k, a, b in own), bool(own)
            for some, n in most.items():
                if len(kept[some]) > 4 * n:
                    kept[some] = {h: kept[some][h] for h in sorted(kept[some])[:n]}
        rows = [kept[some][h] for some, n in most.items() for h in sorted(kept[some])[:n]]
        if rows:
            yield pa.record_batch(list(map(pa.array, ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]), [pa.string()] * 3)) + [pa.array([r[3] for r in rows], pa.bool_())], names=["h", "part", "spans", "some"])

    found = docs.select("text").mapInArrow(tidy(gather), "h string, part string, spans string, some boolean")
    found = stored(found.distinct(), "windows")
    got = [r for some, n in most.items() for r in found.where(F.col("some") == some).orderBy("h", "part").limit(n).collect()]  # windows rows at most
    xs, ys = [], []
    for i, r in enumerate(got):
        own = [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x]
        for text, spans in ((r["part"], own), variants(r["part"], own, i)) if own else ((r["part"], own),):
            s = max(0, (min(a for _, a, _ in spans) - i % 30) if spans else 0)
            y = np.zeros(SIZE, np.int64)
            t = tags_of(spans, s, s + SIZE)[:SIZE]
            y[: len(t)] = t
            if not STARTS[y[0]]:
                y[:] = np.where(np.cumsum(STARTS[y]) == 0, 0, y)
            xs.append(padded(text, s))
            ys.append(y)
    if not any(y.any() for y in ys):
        return None
    return fit(np.stack(xs), np.stack(ys))


_EDGE = (np.minimum(np.arange(SIZE), np.arange(SIZE)[::-1]) + 1).astype(np.float32)


def decode(em: np.ndarray, p: dict) -> np.ndarray:
    """The best tags of one region's emissions (t, tags)."""
    tr, st = np.where(ALLOWED, p["T"], -1e4), np.where(STARTS, p["S"], -1e4)
    back, a = np.zeros(em.shape, np.int8), em[0] + st
    for i in range(1, len(em)):
        m = a[:, None] + tr
        back[i] = m.argmax(0)
        a = em[i] + m.max(0)
    y = np.zeros(len(em), np.int64)
    y[-1] = a.argmax()
    for i in range(len(em) - 1, 0, -1):
        y[i - 1] = back[i][y[i]]
    return y


def decode_many(ems: list[np.ndarray], p: dict) -> list[np.ndarray]:
    """decode() of each, those of like lengths together."""
    tr, st = np.where(ALLOWED, p["T"], -1e4).astype(np.float32), np.where(STARTS, p["S"], -1e4).astype(np.float32)
    order = sorted(range(len(ems)), key=lambda i: -len(ems[i]))
    out: list = [None] * len(ems)
    at = 0
    while at < len(order):
        longest = len(ems[order[at]])
        some = order[at : at + max(1, (1 << 16) // longest)]
        at += len(some)
        sizes = np.array([len(ems[i]) for i in some])
        live = np.searchsorted(-sizes, -np.arange(longest), "left")  # those longer than a position come first
        em = np.zeros((longest, len(some), TAGS), np.float32)
        for r, i in enumerate(some):
            em[: sizes[r], r] = ems[i]
        back, a = np.zeros(em.shape, np.int8), em[0] + st
        for t in range(1, longest):
            n = live[t]
            m = a[:n, :, None] + tr
            back[t, :n] = m.argmax(1)
            a[:n] = em[t, :n] + m.max(1)
        y = np.zeros((longest, len(some)), np.int64)
        tag = a.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            y[t, :n] = tag[:n]
            if t:
                tag[:n] = back[t, np.arange(n), tag[:n]]
        for r, i in enumerate(some):
            out[i] = y[: sizes[r], r]
    return out


def fits(kind: int, s: str) -> bool:
    """What a span of a kind needs, however it is written."""
    n = len(digits_of(s))
    return [("@" in s and sum(c.isalnum() for c in s) >= 5), (4 <= n <= 12 and s.count(".") == 3), 13 <= n <= 19, 9 <= n <= 15][kind]


def model_spans(texts: list[str], p: dict) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places = [(i, s, e) for i, t in enumerate(texts) for s, e in regions(t)]

    def run(group: list[tuple[int, int, int]]) -> None:
        sums = [(np.zeros((e - s, TAGS), np.float32), np.zeros((e - s, 1), np.float32)) for _, s, e in group]
        todo = [(r, w) for r, (_, s, e) in enumerate(group) for w in starts(s, e)]
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            em = forward(p, np.stack([padded(texts[group[r][0]][w : min(w + SIZE, group[r][2])], 0) for r, w in part]))
            for (r, w), x in zip(part, em, strict=True):
                _, s, e = group[r]
                n = min(SIZE, e - w)
                sums[r][0][w - s : w - s + n] += x[:n] * _EDGE[:n, None]
                sums[r][1][w - s : w - s + n] += _EDGE[:n, None]
        ems = [em / weight for em, weight in sums]
        for (i, s, _), em, y in zip(group, ems, decode_many(ems, p), strict=True):
            if not y.any():
                continue
            prob = np.exp(em - _lse(em, 1)[:, None])
            a = 0
            while a < len(y):
                if y[a] % 2 == 1:
                    k, b = y[a] // 2, a + 1
                    while b < len(y) and y[b] == y[a] + 1:
                        b += 1
                    sure = (prob[a:b, y[a]] + prob[a:b, y[a] + 1]).mean()
                    if sure >= SURE and fits(int(k), texts[i][s + a : s + b]):
                        out[i].append((int(k), s + a, s + b))
                    a = b
                else:
                    a += 1

    group: list[tuple[int, int, int]] = []
    size = 0
    for place in places:
        group.append(place)
        size += place[2] - place[1]
        if size > 1 << 16:
            run(group)
            group, size = [], 0
    if group:
        run(group)
    return out


def all_spans(texts: list[str | None], p: dict | None) -> tuple[list[list], list[list]]:
    """For each text the rules' spans, and those with what the network adds where it overlaps none of them."""
    at = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
    base: list[list] = [[] for _ in texts]
    full: list[list] = [[] for _ in texts]
    more = model_spans([texts[i] for i in at], p) if p else [[]] * len(at)
    for i, added in zip(at, more, strict=True):
        base[i] = sorted(base_spans(texts[i]))
        taken = np.array(sorted((s, e) for _, s, e in base[i]), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
        free = []
        for k, s, e in added:
            j = int(np.searchsorted(taken[:, 0], e))  # spans that start before its end
            if not j or reach[j - 1] <= s:
                free.append((k, s, e))
        full[i] = sorted([*base[i], *free])
    return base, full


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with base_spans and spans: arrays of (kind, start, end), kind as a number of KINDS; columns of these names are replaced."""
    from pyspark.sql import types as T

    docs = docs.drop("base_spans", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")]))
    schema = T.StructType([*docs.schema.fields, T.StructField("base_spans", kind), T.StructField("spans", kind)])

    def run(batches):
        import pyarrow as pa

        arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, full = all_spans(batch.column("text").to_pylist(), shared.value)
            as_dicts = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in r] for r in rows], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, as_dicts(base), as_dicts(full)], names=[*batch.schema.names, "base_spans", "spans"])

    return docs.mapInArrow(tidy(run), schema)


def _is(kind: int):
    return lambda x: x["kind"] == kind  # of one argument: filter() hands a second one the position


def joined(spans: str):
    names = F.array(*(F.lit(k) for k in KINDS))
    one = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the rules' spans), spans (all), n_added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(docs)).select("doc_id", "base_spans", "spans")
    counts = [F.size(F.filter("base_spans", _is(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span, found by rule or network, replaced by its kind in angle brackets; n_chars follows the text."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(all_spans(texts, shared.value)[1]):
                if spans:
                    out, last = [], 0
                    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if s >= last:
                            out += [texts[i][last:s], f"<{KINDS[k]}>"]
                        last = max(last, e)
                    texts[i] = "".join([*out, texts[i][last:]])
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    clean = docs.mapInArrow(tidy(run), docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
