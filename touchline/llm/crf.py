"""Skip-chain conditional random field over the tokens that can belong to personal data.

Nodes are the white-space tokens with a digit or an `@`; every other token is
outside by a hard potential, so it cuts the chain. Neighbouring nodes share a
chain potential; nodes of one document with the same or a similar content, however far
apart, share a skip potential (each node with the first and the last one before it of the same
key, and with the first that is sure; so edges grow with the nodes). Sum-product messages are passed over the loopy
graph until each document has settled; what is found in one does not depend on the others of its batch.

Labels are certain where a fixed pattern matched, and where the chain alone is sure of a kind: such nodes
are evidence, held fixed while the skip edges carry their label to every other occurrence. Without evidence an occurrence
is pulled by its likes only, so repeated numbers that are nobody's stay outside.

Unary and chain weights are fitted by pseudo-likelihood to the labels that the patterns give, occurrences of a pattern's
content in other forms left out: the patterns cannot tell about them. The skip potential is attractive, with the
weight at which one sure occurrence outweighs what any masked occurrence - a number of the sample in a shorter form in its
own place - has against it. The field then labels what the patterns could not see: numbers run together with their neighbours, and
repeats in shorter or other forms, however many.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

# The four kinds and their patterns, as the contract lists them.
KINDS = ("email", "ip", "card", "phone")
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LETTER = re.compile(r"[^\W\d_]")

OUT = 0
LABELS = 1 + len(KINDS)
DIMS = 1 << 12
CHAIN, SKIP = 0, 1
LEAST_SKIP = 4.0  # of the skip weight, less 2, where the sample has no phone number

_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGE_LEFT = "\"'([{<*#$%&!,;:."
_EDGE_RIGHT = "\"')]}>*#$%&!,;:.?"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns: leftmost, not overlapping within a kind; matches that fail their
    kind's check are used up and dropped. Linear in the text."""
    if _ANY.search(text) is None:
        return []
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        # a local part is the run of its characters before an @; it holds no @, so it starts after the last one
        run = _EMAIL_LOCAL.match(text[last:at][::-1])
        after = _EMAIL_DOMAIN.match(text, at + 1) if run else None
        if after:
            out.append((at - run.end(), 0, after.end()))
        last = after.end() if after else at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Graph:
    """Nodes and edges of one document."""

    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    core: list[str] = field(default_factory=list)
    feats: list[list[int]] = field(default_factory=list)
    keys: list[list[str]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)


def _shape(core: str) -> str:
    if "@" in core:
        return "mail" if _EMAIL_DOMAIN.search(core, core.index("@") + 1) and core.index("@") else "at"
    s = re.sub(r"[0-9]+", lambda m: f"9{{{min(len(m.group()), 20)}}}", core)
    return re.sub(r"[^\W\d_]+(?![^{]*\})", "a", s)


def _facts(core: str) -> list[str]:
    digits = _NOT_DIGIT.sub("", core)
    out = [f"n{len(digits)}"]
    if 14 <= len(digits) <= 19:
        out.append(f"luhn{luhn(digits)}{len(core) == len(digits)}")
    quad = core.split(".")
    if len(quad) == 4 and all(q.isascii() and q.isdigit() for q in quad):
        out.append(f"octets{all(len(q) <= 3 and int(q) <= 255 for q in quad)}")
    out += ["plus"] * core.startswith("+") + ["paren"] * (core[:1] == "(" and core[-1:] == ")")
    out += ["letters"] * bool(_LETTER.search(core))
    return out


def _keys(core: str) -> list[str]:
    """Contents under which distant tokens count as the same or similar."""
    if "@" in core:
        return ["m" + core.lower()]
    digits = _NOT_DIGIT.sub("", core)
    if len(digits) < 7 or _LETTER.search(core):
        return []
    if core.count(".") == 3:
        return ["i" + core]
    return ["d" + digits] + (["s" + digits[-7:]] if len(digits) <= 15 else [])


def graph(text: str) -> Graph:
    g = Graph()
    for m in _NODE.finditer(text):
        raw = m.group()
        right = raw.rstrip(_EDGE_RIGHT)
        core = right.lstrip(_EDGE_LEFT)
        a = m.start() + len(right) - len(core)
        if a > m.start() and raw[a - m.start() - 1] == "(" and m.start() + len(right) < m.end() \
                and raw[len(right)] == ")":
            a, core = a - 1, "(" + core + ")"
        if not core or _ANY.search(core) is None:
            continue
        g.start.append(a)
        g.end.append(a + len(core))
        g.core.append(core)
    n = len(g.core)
    shapes = [_shape(c) for c in g.core]
    beside = [False] * (n + 1)  # beside[k]: nodes k - 1 and k stand side by side
    for k in range(1, n):
        gap = text[g.end[k - 1]:g.start[k]] if g.start[k] - g.end[k - 1] <= 8 else "x"
        beside[k] = gap.isspace() or gap == ""
        if beside[k]:
            g.edges.append((k - 1, k, CHAIN))
    for k in range(n):
        before = text[max(0, g.start[k] - 24):g.start[k]].split()
        word = before[-1] if before else "^"
        word = word if not word.isalpha() else "word"
        names = [f"s{shapes[k]}", f"w{word[:12]}",
                 f"l{shapes[k - 1]}" if beside[k] else "l-", f"r{shapes[k + 1]}" if beside[k + 1] else "r-",
                 *_facts(g.core[k])]
        g.feats.append([zlib.crc32(x.encode()) % DIMS for x in names])
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for k in range(n):
        g.keys.append(_keys(g.core[k]))
        linked = {at[key] for key in g.keys[k] for at in (first, last) if key in at}
        g.edges += [(j, k, SKIP) for j in sorted(linked)]
        for key in g.keys[k]:
            first.setdefault(key, k)
            last[key] = k
    return g


def labels(g: Graph, spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each node by the given spans (the first that it lies in)."""
    out, k = [OUT] * len(g.core), 0
    for a, kind, z in sorted(spans):
        while k and g.end[k - 1] > a:
            k -= 1
        while k < len(g.core) and g.start[k] < z:
            if g.end[k] > a and out[k] == OUT:
                out[k] = 1 + kind
            k += 1
    return out


def known_labels(g: Graph, spans: list[tuple[int, int, int]]) -> list[int]:
    """`labels` to learn from: -1 (not known) for a node outside the spans whose content stands in one."""
    own = labels(g, spans)
    sure = {key for y, keys in zip(own, g.keys) if y != OUT for key in keys}
    return [-1 if y == OUT and not sure.isdisjoint(keys) else y for y, keys in zip(own, g.keys)]


def masked(text: str, spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Features of the phone numbers of a text in shorter forms, each in the place of the number."""
    out = []
    for a, kind, z in spans:
        digits = _NOT_DIGIT.sub("", text[a:z])
        if KINDS[kind] == "phone":
            d = digits[-10:]
            for form in (f"{d[-7:-4]}-{d[-4:]}", f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", d[-7:], d):
                before = text[max(0, a - 40):a]
                g = graph(before + form + text[z:z + 40])
                out += [g.feats[k] for k in range(len(g.core)) if g.start[k] == len(before)]
    return out


def join(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, their node, edges) of several documents as one graph."""
    ids, node, edges, base = [], [], [], 0
    for g in graphs:
        for k, f in enumerate(g.feats):
            ids += f
            node += [base + k] * len(f)
        edges += [(base + a, base + b, t) for a, b, t in g.edges]
        base += len(g.feats)
    return np.array(ids, np.int64), np.array(node, np.int64), np.array(edges, np.int64).reshape(-1, 3)


@dataclass
class Model:
    unary: np.ndarray  # DIMS x LABELS
    pair: np.ndarray   # (chain, skip) x LABELS x LABELS

    def scores(self, ids: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(node, self.unary[ids, y], n) for y in range(LABELS)], axis=1)

    def settled(self, local: np.ndarray, edges: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Beliefs of all nodes after loopy sum-product messages; doc: the document of each node.

        Every document is passed over until its own messages have settled, whatever the others need. Each hundred rounds
        halve the step, so a document whose messages swing settles too."""
        n = len(local)
        if len(edges):
            src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
            back = np.r_[len(edges):2 * len(edges), 0:len(edges)]
            kind = np.r_[edges[:, 2], edges[:, 2]]
            flip = np.arange(len(src)) >= len(edges)
            msg = np.zeros((len(src), LABELS))
            live = np.arange(len(src))
            rounds = 0
            while len(live):
                belief = local + self._sums(dst[live], msg[live], n)
                pot = np.where(flip[live, None, None], self.pair[kind[live]].transpose(0, 2, 1), self.pair[kind[live]])
                out = (belief[src[live]] - msg[back[live]])[:, :, None] + pot
                top = out.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0, :]
                new -= new.max(axis=1, keepdims=True)
                change = np.zeros(int(doc.max()) + 1)
                np.maximum.at(change, doc[src[live]], np.abs(new - msg[live]).max(axis=1))
                step = 0.5 ** (1 + rounds // 100)
                msg[live] += step * (new - msg[live])
                live = live[step * change[doc[src[live]]] >= 5e-4]
                rounds += 1
            local = local + self._sums(dst, msg, n)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    @staticmethod
    def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, y], n) for y in range(LABELS)], axis=1)

    def marginals(self, graphs: list[Graph], given: list[list[int]], sure: float = 0.9) -> np.ndarray:
        """Beliefs of all nodes of several documents; given: each node's label by the patterns (OUT: none)."""
        ids, node, edges = join(graphs)
        sizes = [len(g.feats) for g in graphs]
        n, doc = sum(sizes), np.repeat(np.arange(len(graphs)), sizes)
        local = self.scores(ids, node, n)
        label = np.array([y for own in given for y in own], np.int64)
        alone = self.settled(self._held(local, label), edges[edges[:, 2] == CHAIN], doc)
        label = np.where((label == OUT) & (alone.max(axis=1) >= sure), alone.argmax(axis=1), label)
        base = 0
        for g in graphs:
            first: dict[str, int] = {}
            for k, keys in enumerate(g.keys):
                if label[base + k] != OUT:
                    for key in keys:
                        first.setdefault(key, base + k)
            for k, keys in enumerate(g.keys):
                # an edge to a node that is held fixed is a constant
                for j in {first[key] for key in keys if key in first} - {base + k}:
                    local[base + k] += self.pair[SKIP, label[j]]
            base += len(g.keys)
        return self.settled(self._held(local, label), edges, doc)

    @staticmethod
    def _held(local: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The scores with the nodes of a label other than OUT held to it."""
        out = local.copy()
        held = label != OUT
        out[held] = -60.0
        out[held, label[held]] = 0.0
        return out


def fit(graphs: list[Graph], target: list[list[int]], hidden: list[list[int]] = (), rounds: int = 250, rate: float = 0.1,
        decay: float = 1e-3) -> Model:
    """Unary and chain weights by maximum pseudo-likelihood (Adam): each node's label given its neighbours'; nodes of an unknown label (-1)
    are not learned from. The skip weight by `hidden`, the features of masked phone numbers."""
    model = Model(np.zeros((DIMS, LABELS)), np.zeros((2, LABELS, LABELS)))
    y = np.array([v for t in target for v in t], np.int64)
    if not len(y):
        return model
    ids, node, edges = join(graphs)
    n, known = len(y), y >= 0
    edges = edges[(edges[:, 2] == CHAIN) & known[edges[:, 0]] & known[edges[:, 1]]]
    one = np.eye(LABELS)[np.maximum(y, 0)]
    params = [model.unary, model.pair]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    a, b, kind = edges.T
    for step in range(1, rounds + 1):
        s = model.scores(ids, node, n)
        if len(edges):
            to_b, to_a = model.pair[kind, y[a], :], model.pair[kind, :, y[b]]
            s = s + np.stack([np.bincount(b, to_b[:, v], n) + np.bincount(a, to_a[:, v], n)
                              for v in range(LABELS)], axis=1)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        d = (one - p / p.sum(axis=1, keepdims=True)) / n * known[:, None]
        grads = [np.stack([np.bincount(ids, d[node, v], DIMS) for v in range(LABELS)], axis=1),
                 np.zeros_like(model.pair)]
        np.add.at(grads[1], (kind, y[a]), d[b])
        np.add.at(grads[1].transpose(0, 2, 1), (kind, y[b]), d[a])
        for q, g, m1, m2 in zip(params, grads, first, second):
            g = g - decay / 10 * q
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            q += rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    phone = 1 + KINDS.index("phone")
    against = [s.max() - s[phone] for s in (model.unary[f].sum(axis=0) for f in hidden)]
    model.pair[SKIP] = np.eye(LABELS) * (max([LEAST_SKIP, *against]) + 2.0)
    return model


def _plausible(kind: int, core: str) -> bool:
    digits = sum(c in "0123456789" for c in core)
    return (("@" in core) if kind == 0 else (core.count(".") == 3 and 4 <= digits <= 12) if kind == 1
            else 14 <= digits <= 19 if kind == 2 else 7 <= digits <= 15)


def added_spans(text: str, g: Graph, belief: np.ndarray, base: list[tuple[int, int, int]],
                sure: float = 0.5) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span: runs of side-by-side nodes of one label."""
    label = np.where(belief.max(axis=1) >= sure, belief.argmax(axis=1), OUT)
    beside = {b for a, b, t in g.edges if t == CHAIN}
    most = {2: 19, 3: 15}  # digits that one card or phone may hold
    runs: list[list[int]] = []  # label, first node, last node, digits
    for k, y in enumerate(label):
        if y == OUT:
            continue
        kind = int(y) - 1
        digits = sum(c in "0123456789" for c in g.core[k])
        if runs and runs[-1][0] == kind and runs[-1][2] == k - 1 and k in beside and kind in most \
                and not g.core[k].startswith("+") and runs[-1][3] + digits <= most[kind]:
            runs[-1][2:] = [k, runs[-1][3] + digits]
        else:
            runs.append([kind, k, k, digits])
    out = []
    for kind, i, j, _ in runs:
        a, z = g.start[i], g.end[j]
        if _plausible(kind, text[a:z]):
            out.append((a, kind, z))
    taken = sorted((a, z) for a, _, z in base)
    kept, k = [], 0
    for a, kind, z in out:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= z:
            kept.append((a, kind, z))
    return kept
