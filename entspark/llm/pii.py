"""Personal data by a skip-chain conditional random field.

Nodes are tokens with a digit or an ``@``: runs of letters, digits and ``._%+-@``
between whatever else there is, so brackets, quotes, commas, ``=`` and ``:`` part
what is glued together, and so do scripts that set no blanks; IPv6 addresses are
one token.  A chain joins neighbours; skip edges join a token to the next place
in the document with the same text, or with the same account name or digits, so
that far-apart mentions share potentials.  Loopy message passing over chain and
skip edges gives every token's label marginals; the best label of each counts.
Groups of digits that make a card's or a phone number's shape together have a
feature of it, and those of them that get the same label are one entity.

Most tokens are plain words: no digit, no ``@``, no skip edge.  A run of g of
them between two other tokens is summed out exactly: it becomes one edge with
the g-th power of (transition x plain emission).  So only the tokens that can
carry a label are nodes, and what the rest contributes isn't lost.

Weights come from pseudo-likelihood training on generated documents (TRAINING
of them, from a fixed seed), never on the corpus.  Out of scope: names, postal
addresses, dates of birth, and numbers that are spelt out.

Defined results: a null or empty text has no entities.  A text is read whole,
whatever its length, and so is a token.  A document's messages end by its own
changes, so its result doesn't hang on other documents.  Of equal marginals the
first of LABELS counts.  Repeated rows repeat their entities; a null doc_id
stays null.  Empty input gives no rows; other columns are ignored.  Offsets
count code points.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN")
TRAINING, SEED = 1_000, 11
#: A document's messages are passed until none changes by more than TOLERANCE; loops that swing for so many rounds are read as they are then.
TOLERANCE, MOST_ROUNDS = 1e-4, 5_000

_L = len(LABELS)
_WORDS = "A-Za-z_\u00aa-\u024f\u0370-\u052f\u0531-\u0587\u05d0-\u05ea\u0620-\u064a\u1e00-\u1fff"
_LETTERS = "0-9" + _WORDS
_TOKEN = re.compile(
    r"(?:(?<![0-9A-Za-z:.])|(?<=[G-Zg-z]:))(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?:(?:\.[0-9]{1,3}){3})?(?![0-9A-Za-z:])"
    rf"|(?<![{_LETTERS}.%+\-@])(?=[{_WORDS}.%+\-]*[0-9@])[{_LETTERS}.%+\-@]+"
)
_SIGN, _INNER, _RUN = re.compile("[0-9@]"), re.compile(rf"[{_LETTERS}.%+\-@:]"), re.compile(rf"[{_LETTERS}.%+\-@:]+")
_EMAIL = re.compile(rf"[{_LETTERS}.%+\-]{{1,64}}@(?:[{_LETTERS}\-]{{1,63}}\.){{1,9}}[A-Za-z\u00aa-\u1fff]{{2,24}}")
_PLAIN = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r"\)?[ \u00a0.\-/]{0,2}\(?")
_CUES = {
    "email": 0, "e-mail": 0, "mail": 0, "mailto": 0, "contact": 0, "phone": 1, "tel": 1, "call": 1, "mobile": 1, "fax": 1, "ip": 2, "host": 2, "address": 2, "server": 2, "addr": 2,
    "card": 3, "visa": 3, "credit": 3, "ssn": 4, "social": 4, "order": 5, "version": 5, "isbn": 5, "id": 5, "no": 5, "ref": 5, "page": 5,
}
_FEATURES = 44
#: Features of the shapes that groups of digits make: a card's, a phone number's with a country, one with an area.
_CARD_SHAPE, _COUNTRY_SHAPE, _AREA_SHAPE = 34, 35, 36
_SHAPE_LABEL = {_CARD_SHAPE: 4, _COUNTRY_SHAPE: 2, _AREA_SHAPE: 2}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


class Node:
    """A token: its place without the marks at its ends, and the features it has."""

    __slots__ = ("begin", "end", "text", "gap", "features", "shape", "group", "inside", "pure", "digits")

    def __init__(self, begin: int, end: int, text: str, gap: int):
        self.begin, self.end, self.text, self.gap = begin, end, text, gap
        self.shape, self.group = 0, -1
        self.digits = _digits(text)
        self.pure = bool(self.digits) and all(c in "0123456789-." for c in text.removeprefix("+"))


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """The runs of token characters and colons that hold a digit or an ``@``."""
    end = 0
    while m := _SIGN.search(text, end):
        begin = m.start()
        while begin > end and _INNER.match(text, begin - 1):
            begin -= 1
        end = _RUN.match(text, m.start()).end()
        yield begin, end


def nodes(text: str) -> tuple[list[Node], int]:
    """The nodes of a text, each with the number of plain words before it, and the number after the last."""
    out: list[Node] = []
    cues: list[list[str]] = []
    last, before = 0, []
    for first, stop in _regions(text):
        for m in _TOKEN.finditer(text, first, stop):
            begin, end = m.span()
            s = m.group()
            if ":" not in s:
                token, s = s, s.lstrip("._%-")
                begin += len(token) - len(s)
                s = s.rstrip("._%+-")
                end = begin + len(s)
                if not _SIGN.search(s):
                    continue
            words = _PLAIN.findall(text, last, begin)
            before = [*before, *words[-2:]][-2:]
            out.append(Node(begin, end, s, len(words)))
            cues.append(before)
            last = m.end()
    _shapes(text, out)
    for n, words in zip(out, cues):
        n.features = _node_features(text, n, words)
    return out, len(_PLAIN.findall(text, last))


def _shapes(text: str, every: list[Node]) -> None:
    """Mark the groups of digits that make a number's shape together; none has more than 15 groups, as a phone number has 15 digits."""
    joined = [a.gap >= 0 and b.gap == 0 and b.begin - a.end < 5 and bool(_BETWEEN.fullmatch(text, a.end, b.begin)) for a, b in zip(every, every[1:])] + [False]
    for n in every:
        n.inside = text[n.begin - 1 : n.begin] == "(" and text[n.end : n.end + 1] == ")"
    k = 0
    while k < len(every):
        n = every[k]
        found, stop = 0, k + 1
        if n.pure and joined[k]:
            many = k
            while many - k < 15 and joined[many] and every[many + 1].pure and not every[many + 1].text.startswith("+"):
                many += 1
            run = every[k : many + 1]
            sizes = [len(x.text) if x.text.isdigit() else 0 for x in run]
            if n.text.startswith("+") and len(n.digits) <= 4:
                total, j = len(n.digits), 1
                while j < len(run) and len(run[j].digits) <= 8 and total + len(run[j].digits) <= 15:
                    total += len(run[j].digits)
                    j += 1
                if total >= 8:
                    found, stop = _COUNTRY_SHAPE, k + j
            elif sizes[:4] == [4, 4, 4, 4] or sizes[:3] == [4, 6, 5]:
                j = 4 if sizes[:4] == [4, 4, 4, 4] else 3
                whole = "".join(x.digits for x in run[:j])
                if luhn(whole) and whole[0] in "3456":
                    found, stop = _CARD_SHAPE, k + j
            elif n.inside and 2 <= len(n.digits) <= 5:
                total, j = len(n.digits), 1
                while j < len(run) and j < 4 and total + len(run[j].digits) <= 11:
                    total += len(run[j].digits)
                    j += 1
                if total >= 9:
                    found, stop = _AREA_SHAPE, k + j
            elif sizes[:3] == [3, 3, 4] or sizes[0] == 3 and len(run) > 1 and re.fullmatch(r"[0-9]{3}-[0-9]{4}", run[1].text):
                found, stop = _AREA_SHAPE, k + (3 if sizes[:3] == [3, 3, 4] else 2)
        if found:
            for x in every[k:stop]:
                x.shape, x.group = found, k
        k = stop


def _node_features(text: str, node: Node, before: list[str]) -> list[int]:
    """The numbers of the features that a node has; features 0 and 1 are a plain word's."""
    s, digits = node.text, node.digits
    others = {c for c in s if c not in "0123456789"}
    n = len(digits)
    out = [2]
    if ":" in s:
        try:
            ipaddress.IPv6Address(s)
            out.append(37)
        except ValueError:
            out.append(38)
    elif "@" in s:
        out.append(4 if _EMAIL.fullmatch(s) and ".." not in s else 5)
    elif any(c.isalpha() for c in s):
        out.append(6)
    else:
        parts = s.split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 for p in parts):
            out.append(8 if all(int(p) < 256 for p in parts) else 9)
        elif not others - {"-"} and 13 <= n <= 19:
            out.append(10 if luhn(digits) and digits[0] in "3456" else 11)
            out.append(12 if n == 16 else 13)
        elif re.fullmatch(r"\+[0-9]{1,3}", s):
            out.append(14)
        elif node.inside and re.fullmatch(r"[0-9]{2,5}", s):
            out.append(15)
        elif re.fullmatch(r"[0-9]{3}-[0-9]{4}", s):
            out.append(16)
        elif re.fullmatch(r"(\+?[0-9]{1,3}[\-.])?[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}", s):
            out.append(17)
        elif re.fullmatch(r"\+[0-9\-.]{8,20}", s) and 8 <= n <= 15:
            out.append(18)
        elif re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
            out.append(19 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else 20)
        elif not others:
            out += [21, 22 if n <= 2 else 23 if n <= 4 else 24 if n <= 8 else 25]
        elif others <= {"."}:
            out.append(26)
        else:
            out.append(27)
    for w in before:
        cue = _CUES.get(w.lower())
        if cue is not None:
            out.append(28 + cue)
    if node.shape:
        out.append(node.shape)
    left, right = text[node.begin - 1 : node.begin] if node.begin else "", text[node.end : node.end + 1]
    if left == ":" and node.begin > 1 and text[node.begin - 2] in "0123456789":
        out.append(43)  # a port, a time
    elif left in ("=", ":", '"', "'", "<"):
        out.append(39)
    if left == "/" or right == "/":
        out.append(40)
    if left in ("$", "\u20ac", "#") or right in ("%", "\u20ac"):
        out.append(41)
    if left == "," or right == "," and text[node.end + 1 : node.end + 2].isdigit():
        out.append(42)
    return out


def links(cores: list[str]) -> Iterator[tuple[int, int, int]]:
    """Skip edges (i, j, kind): the next token of equal text (0), else of the same account name or digits (1)."""
    seen: dict[str, int] = {}
    alike: dict[str, int] = {}
    for j, s in enumerate(cores):
        if len(s) < 4:
            continue
        low = s.lower()
        digits = _digits(low)
        key = low.split("@")[0] if "@" in low else digits if len(digits) > 6 else ""
        if low in seen:
            yield seen[low], j, 0
        elif key and key in alike:
            yield alike[key], j, 1
        seen[low] = j
        if key:
            alike[key] = j


# --- training ---------------------------------------------------------------


def _document(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up document and its entities: begin, end, label."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abdehilmnorstu") for _ in range(rng.randint(2, 8)))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            s = rng.choice("3456") + d(15)
            if luhn(s) == valid:
                return s if rng.random() < 0.6 else rng.choice("- ").join(s[i : i + 4] for i in range(0, 16, 4))

    email = lambda: f"{w()}{rng.choice(('.', '_', '+', ''))}{rng.choice((d(2), w()))}@{w()}{rng.choice(('', d(1)))}.{rng.choice(('example.com', 'example.org', 'mail.net', 'com', 'm\u00fcller.de', 'co.uk'))}"

    def phone() -> str:
        a, b = d(3), f"{d(3)}-{d(4)}"
        return rng.choice((f"+{d(rng.randint(1, 2))} ({a}) {b}", f"({a}) {b}", f"{a}-{b}", f"+1-{a}-{b}", f"+{d(11)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+1 {a} {d(3)} {d(4)}", f"{a} {d(3)} {d(4)}", f"{a} {b}", f"{a}.{d(3)}.{d(4)}", f"({a}) {d(3)} {d(4)}", f"({a}){b}"))

    def address() -> str:
        four = ".".join(str(rng.randrange(256)) for _ in range(4))
        return rng.choice((four, four, four, ":".join(h(4) for _ in range(8)), f"{h(4)}:{h(3)}::{rng.randrange(1, 99)}", f"fe80::{h(4)}:{d(2)}"))

    def one() -> tuple[str, int]:
        kind = rng.randrange(24)
        if kind < 3:
            return email(), 1
        if kind < 6:
            return phone(), 2
        if kind < 8:
            return address(), 3
        if kind < 10:
            return card(True), 4
        if kind == 10:
            return f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", 5
        odd = (
            lambda: card(False), lambda: d(rng.randint(1, 10)), lambda: f"{d(3)}-{d(4)}", lambda: f"{rng.randint(256, 999)}.{d(2)}.{d(3)}.{rng.randint(300, 999)}",
            lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: "@" + w(), lambda: w() + "@", lambda: w() + "@" + w(), lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}",
            lambda: f'"{w()}{d(3)}{w()}{d(2)}"', lambda: f"password={w()}{d(4)}", lambda: f"({d(rng.randint(1, 4))})", lambda: f"{d(2)}-{d(3)}-{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: d(13), lambda: "000-" + d(2) + "-" + d(4),
            lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(2, 8))), lambda: f"{d(1)},{d(3)},{d(3)}", lambda: " ".join(d(4) for _ in range(rng.randint(2, 3))), lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: ":".join(h(2) for _ in range(6)), lambda: f"{w()}{d(2)}.{w()}", lambda: f"v{d(1)}.{d(1)}.{d(1)}.{d(1)}",
        )
        return rng.choice(odd)(), 0

    text, spans = "", []
    known: list[tuple[str, int]] = []
    for _ in range(rng.randint(2, 9)):
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            text += (rng.choice(list(_CUES)) if rng.random() < 0.1 else w()) + rng.choice((" ", " ", " ", ", ", ": "))
        if known and rng.random() < 0.4:  # again, or the last part of it alone
            own, label = rng.choice(known)
            if " " in own and label == 2 and rng.random() < 0.6 and re.search(r" [0-9]{3}-[0-9]{4}$", own):
                own = own.split()[-1]
        else:
            own, label = one()
            known.append((own, label))
        text += rng.choice(("", "", "", "", "", "(", "<", '"', f"{w()}=", f"{w()}:", "email:", "tel:", "ip=", f"{w()},"))
        if label:
            spans.append((len(text), len(text) + len(own), label))
        text += own + rng.choice((" ", " ", " ", " ", ". ", ", ", "!! ", "### ", ") ", "> ", '" ', ",", ";", ":8080 " if label == 3 and ":" not in own else " "))
    return text, spans


def _truth(every: list[Node], spans: list[tuple[int, int, int]]) -> list[int]:
    return [next((label for a, b, label in spans if a < n.end and n.begin < b), 0) for n in every]


class Weights:
    """Log potentials: of features, of neighbours, of the two kinds of skip edges; and plain runs' matrices by length."""

    def __init__(self, emit: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.emit, self.chain, self.skip = emit, chain, skip
        step = np.exp(emit[0] + emit[1])[:, None] * np.exp(chain)
        self._powers = [step / step.max()]
        self.run = lru_cache(65_536)(self._run)

    def __getstate__(self) -> tuple:
        return self.emit, self.chain, self.skip

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _run(self, gap: int) -> np.ndarray:
        """The log potential of two nodes with ``gap`` plain words between them."""
        now, k = np.exp(self.chain), 0
        while gap >> k:
            while k >= len(self._powers):
                square = self._powers[-1] @ self._powers[-1]
                self._powers.append(square / square.max())
            if gap >> k & 1:
                now = now @ self._powers[k]
                now = now / now.max()
            k += 1
        return np.log(now / now.max())


@cache
def weights() -> Weights:
    """Pseudo-likelihood: each label given the true ones around it is a multinomial regression."""
    rng = random.Random(SEED)
    x, left, right, skips, y = [], [], [], [], []
    for _ in range(TRAINING):
        text, spans = _document(rng)
        every, after = nodes(text)
        truth = _truth(every, spans)
        at, labels, own = [], [], []
        for n, label in zip(every, truth):
            own += [[0, 1]] * n.gap + [n.features]
            labels += [0] * n.gap + [label]
            at.append(len(y) + len(labels) - 1)
        own += [[0, 1]] * after
        labels += [0] * after
        x += own
        left += [-1, *labels[:-1]] if labels else []
        right += [*labels[1:], -1] if labels else []
        y += labels
        for i, j, kind in links([n.text for n in every]):
            skips += [(at[i], kind, truth[j]), (at[j], kind, truth[i])]
    n = len(y)
    design = np.zeros((n, _FEATURES + 4 * _L), np.float32)
    for k, own in enumerate(x):
        design[k, own] = 1
    for k in range(n):
        if left[k] >= 0:
            design[k, _FEATURES + left[k]] = 1
        if right[k] >= 0:
            design[k, _FEATURES + _L + right[k]] = 1
    for k, kind, other in skips:
        design[k, _FEATURES + (2 + kind) * _L + other] += 1
    target = np.eye(_L, dtype=np.float32)[y]
    w = np.zeros((design.shape[1], _L), np.float32)
    ahead, rate = w, np.float32(1.0)
    blocks = slice(_FEATURES, _FEATURES + _L), slice(_FEATURES + _L, _FEATURES + 2 * _L)
    for k in range(200):
        z = design @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = design.T @ (p - target) / np.float32(n) + np.float32(2e-5) * ahead
        # one matrix for both directions of an edge
        g[blocks[0]], g[blocks[1]] = (g[blocks[0]] + g[blocks[1]].T) / 2, (g[blocks[1]] + g[blocks[0]].T) / 2
        for b in (2, 3):
            s = slice(_FEATURES + b * _L, _FEATURES + (b + 1) * _L)
            g[s] = (g[s] + g[s].T) / 2
        after = ahead - rate * g
        ahead, w = after + np.float32(k / (k + 3)) * (after - w), after
    w = w.astype(float)
    skip = np.array([w[_FEATURES + b * _L : _FEATURES + (b + 1) * _L] for b in (2, 3)])
    return Weights(w[:_FEATURES], w[blocks[0]], skip)


# --- inference --------------------------------------------------------------


def marginals(local: np.ndarray, edges: np.ndarray, pair: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Label marginals by loopy message passing: log potentials of nodes, (i, j) of edges and their log potentials, the document of each node.

    A document's messages stay as they are once none of them changes any more.
    """
    message = np.zeros((2 * len(edges), local.shape[1]))
    if len(edges):
        many = len(edges)
        source, sink = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        both = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(many) + many, np.arange(many)])
        doc = np.zeros(2 * many, np.int64) if owner is None else np.unique(owner[source], return_inverse=True)[1]
        open_, place, now = np.ones(doc.max() + 1, bool), np.arange(2 * many), message.copy()
        for k in range(MOST_ROUNDS):
            belief = local.copy() if len(place) * 4 > len(local) else None
            if belief is None:
                touched, sinks = np.unique(sink, return_inverse=True)
                part = local[touched]
                np.add.at(part, sinks, now)
                at = np.searchsorted(touched, source)
                inner = part[at] - now[back]
            else:
                np.add.at(belief, sink, now)
                inner = belief[source] - now[back]
            inner = inner[:, :, None] + both
            top = inner.max(1)
            new = top + np.log(np.exp(inner - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            if k > 10:  # loops may swing
                new = (new + now) / 2
            change = np.zeros(len(open_))
            np.maximum.at(change, doc, np.abs(np.exp(new) - np.exp(now)).max(1))
            now = np.where(open_[doc][:, None], new, now)
            open_ &= change >= TOLERANCE
            left = open_[doc]
            if not left.any():
                break
            if 2 * left.sum() < len(left):  # go on with the open documents alone
                message[place] = now
                number = np.cumsum(left) - 1
                back = number[back[left]]
                place, source, sink, both, doc, now = place[left], source[left], sink[left], both[left], doc[left], now[left]
        message[place] = now
    belief = local.copy()
    if len(edges):
        np.add.at(belief, np.concatenate([edges[:, 1], edges[:, 0]]), message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def entities(texts: list[str | None], model: Weights | None = None) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, label, probability) of all texts' entities."""
    model = model or weights()
    owner, every, local, edges, pair = [], [], [], [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        base = len(every)
        own, after = nodes(text)
        for n, node in enumerate(own):
            local.append(model.emit[node.features].sum(0))
            if n:
                edges.append((base + n - 1, base + n))
                pair.append(model.run(node.gap))
        owner += [k] * len(own)
        every += own
        for i, j, kind in links([n.text for n in own]):
            edges.append((base + i, base + j))
            pair.append(model.skip[kind])
    if not owner:
        return []
    p = marginals(np.array(local), np.array(edges, np.int64).reshape(-1, 2), np.array(pair).reshape(-1, _L, _L), np.array(owner))
    best = p.argmax(1)
    out: list[tuple[int, int, int, str, float]] = []
    for n, label in enumerate(best.tolist()):
        if not label:
            continue
        node, q = every[n], float(p[n, label])
        joins = n and owner[n] == owner[n - 1] and node.group >= 0 and node.group == every[n - 1].group and best[n - 1] == label == _SHAPE_LABEL[node.shape]
        if joins:
            k, begin, _, name, least = out[-1]
            out[-1] = (k, begin, node.end, name, min(least, q))
        else:
            begin = node.begin - 1 if node.inside and node.group >= 0 and label == 2 else node.begin
            out.append((owner[n], begin, node.end, LABELS[label], q))
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, label, probability) of every entity."""
    model = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 1_000):
                rows = [(ids[a + k], s, e, label, round(q, 4)) for k, s, e, label, q in entities(texts[a : a + 1_000], model)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "start", "stop", "label", "probability"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, start long, stop long, label string, probability double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(K.table(spark, sf_dir, "documents"))
