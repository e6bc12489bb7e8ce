"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers; their spans always stay. The
network adds spans of the same kinds in forms that the patterns do not take (obfuscated addresses, other
separators, phones without a country code). It is trained here, in numpy, on a bounded sample of text
windows of the corpus whose labels are the pattern spans, and on rewritten copies of those spans.

Decoding looks at every place that can hold personal data: each digit, ``@`` or written-out "at" opens a
region of the text around it; regions that touch are one. A region is covered by overlapping windows; the
windows' emission scores are blended, those near a window's edge counting less, and one CRF path and its
marginals over the region decide; a region of over 2,304 characters is decoded in pieces of 2,048 that see 256
more on either side, and a span counts for the piece in which it starts. A path's span is added if every character is sure enough, it has
the digits of its kind, and it overlaps neither a pattern span nor a match that a pattern rejected.

Edge cases. A null text counts as empty and has no spans. A corpus without any pattern span trains on
nothing, and then nothing is added. Repeated rows get the same spans; rows without an id are searched like
any other; an empty table gives an empty result. Further columns are not read. All matching takes time in
proportion to the text, also for very long runs of digits or address characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from settlelens.llm.common import materialize, null_safe_text

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUE = r"[0-9@]|[(\[] ?at ?[)\]]"
_CUE = re.compile(CUE)

# Training: the sample bound, and settings.
SAMPLE = 600  # windows of the corpus, at most
REWRITES = 2  # rewritten copies of a span in the sample
HIDDEN = 16
EPOCHS = 14
BATCH = 32
RATE = 0.03
SEED = 11
# Decoding.
WINDOW = 64
STRIDE = 32
MARGIN = 32
PIECE = 2_048  # characters of a region that are decoded together
OVERLAP = 256  # seen beyond them on either side
PIECES = 1_024  # pieces whose emissions are held at a time
SURE = 0.8

Span = tuple[str, int, int]


# ---- patterns


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def pattern_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans that pass, by start and then kind as listed; places of matches that fail their test."""
    good: list[Span] = []
    failed: list[tuple[int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            good.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        place = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = place + sum(map(len, four)) + 3
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            (good.append(("ip", place, end)) if fits else failed.append((place, end)))
            place = end + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() > 37:  # over 19 digits, whatever the separators
            failed.append(m.span())
            continue
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19:
            (good.append(("card", *m.span())) if _luhn(digits) else failed.append(m.span()))
    for m in _PHONE.finditer(text):
        n = sum(c.isdigit() for c in m.group())
        (good.append(("phone", *m.span())) if 10 <= n <= 15 else failed.append(m.span()))
    good.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return good, failed


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- characters and tags

_PUNCTUATION = "@.-+() \n_%[]:/\"'=,|#"
N_CHARS = 26 + 1 + len(_PUNCTUATION) + 3
_TABLE = np.full(129, 26 + 1 + len(_PUNCTUATION), dtype=np.int64)  # any other ASCII character
for _i in range(26):
    _TABLE[ord("a") + _i] = _TABLE[ord("A") + _i] = _i
for _i in range(10):
    _TABLE[ord("0") + _i] = 26
for _i, _c in enumerate(_PUNCTUATION):
    _TABLE[ord(_c)] = 27 + _i
_TABLE[128] = N_CHARS - 2  # beyond ASCII
_PAD = N_CHARS - 1

N_TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k goes on
_BLOCKED = np.zeros((N_TAGS, N_TAGS))
for _k in range(len(KINDS)):
    for _t in range(N_TAGS):
        if _t not in (1 + 2 * _k, 2 + 2 * _k):
            _BLOCKED[_t, 2 + 2 * _k] = -1e4
_START = np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(N_TAGS)])


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, 128)]


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


# ---- network


@dataclass
class Tagger:
    """Weights: per direction input (chars x 4h), recurrent (h x 4h) and bias; output and transitions."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int = HIDDEN) -> Tagger:
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.2, (N_CHARS, 4 * hidden))
            w[f"h{d}"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            w[f"c{d}"] = np.concatenate((np.ones(hidden), np.zeros(3 * hidden)))  # gates start out remembering
        w["out"] = rng.normal(0, 0.2, (2 * hidden, N_TAGS))
        w["bias"] = np.zeros(N_TAGS)
        w["trans"] = np.zeros((N_TAGS, N_TAGS))
        return Tagger(w)

    def _lstm(self, chars: np.ndarray, d: str, keep: bool):
        """Hidden states over (batch, time); order of gates: forget, input, output, candidate."""
        n, steps = chars.shape
        u = self.w[f"h{d}"]
        size = u.shape[0]
        inputs = self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, size), u.dtype), np.zeros((n, size), u.dtype)
        hidden = np.empty((steps, n, size), u.dtype)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[chars[:, t]] + h @ u
            gates = 1 / (1 + np.exp(-z[:, : 3 * size]))
            f, i, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            before_c, before_h = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            hidden[t] = h
            if keep:
                saved.append((t, f, i, o, g, before_c, before_h, squashed))
        return hidden, saved

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """(batch, time, tags)"""
        both = np.concatenate((self._lstm(chars, "f", False)[0], self._lstm(chars, "b", False)[0]), axis=2)
        return (both @ self.w["out"] + self.w["bias"]).transpose(1, 0, 2)

    @property
    def transitions(self) -> np.ndarray:
        return self.w["trans"] + _BLOCKED

    def gradients(self, chars: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss per sequence (negative log likelihood of the tags) and its gradients; padding is masked."""
        n, steps = chars.shape
        hf, saved_f = self._lstm(chars, "f", True)
        hb, saved_b = self._lstm(chars, "b", True)
        both = np.concatenate((hf, hb), axis=2)
        emit = both @ self.w["out"] + self.w["bias"]
        log_z, unary, pair = crf_marginals(emit, self.transitions, mask.T)
        gold = np.eye(N_TAGS)[tags.T] * mask.T[..., None]
        score = (emit * gold).sum()
        steps_in = (mask[:, 1:] & mask[:, :-1]).T[..., None, None]
        seen = np.einsum("tni,tnj->ij", gold[:-1] * steps_in[..., 0], gold[1:])
        score += (seen * self.transitions).sum() + (gold[0] * _START).sum()
        g = {"trans": (pair - seen) / n}
        back = (unary * mask.T[..., None] - gold) / n
        g["out"] = np.einsum("tnh,tnk->hk", both, back)
        g["bias"] = back.sum((0, 1))
        flow = back @ self.w["out"].T
        size, eye = hf.shape[2], np.eye(N_CHARS, dtype=back.dtype)
        for d, saved, part in (("f", saved_f, flow[..., :size]), ("b", saved_b, flow[..., size:])):
            u = self.w[f"h{d}"]
            gu, gx = np.zeros_like(u), np.zeros_like(self.w[f"x{d}"])
            dh, dc = np.zeros((n, size), u.dtype), np.zeros((n, size), u.dtype)
            part = part.astype(u.dtype)
            for t, f, i, o, cand, before_c, before_h, squashed in reversed(saved):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate(
                    (dc * before_c * f * (1 - f), dc * cand * i * (1 - i), dh * squashed * o * (1 - o), dc * i * (1 - cand**2)), axis=1
                )
                gx += eye[chars[:, t]].T @ dz
                gu += before_h.T @ dz
                dh, dc = dz @ u.T, dc * f
            g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = gu, gx, gx.sum(0)
        return (log_z.sum() - score) / n, g


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def crf_marginals(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray, counts: bool = True):
    """Of emissions (time, batch, tags): log partition, tag marginals, and, if asked, expected transition counts."""
    steps, n, k = emit.shape
    ahead = np.empty_like(emit)
    ahead[0] = emit[0] + _START
    for t in range(1, steps):
        step = _log_sum(ahead[t - 1][:, :, None] + trans, 1) + emit[t]
        ahead[t] = np.where(mask[t][:, None], step, ahead[t - 1])
    log_z = _log_sum(ahead[-1], 1)
    behind = np.zeros_like(emit)
    for t in range(steps - 2, -1, -1):
        step = _log_sum(trans + (emit[t + 1] + behind[t + 1])[:, None, :], 2)
        behind[t] = np.where(mask[t + 1][:, None], step, behind[t + 1])
    unary = np.exp(ahead + behind - log_z[None, :, None])
    if not counts:
        return log_z, unary, None
    later = (emit[1:] + behind[1:] - log_z[None, :, None])[:, :, None, :]
    joint = np.exp(ahead[:-1][..., None] + trans + later) * mask[1:][..., None, None]
    return log_z, unary, joint.sum((0, 1))


def crf_path(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Best tags (time, batch); padding stands at the end and repeats the last tag."""
    steps, n, k = emit.shape
    best = emit[0] + _START
    came = np.tile(np.arange(k), (steps, n, 1))
    for t in range(1, steps):
        through = best[:, :, None] + trans
        came[t] = np.where(mask[t][:, None], through.argmax(1), came[t])
        best = np.where(mask[t][:, None], through.max(1) + emit[t], best)
    path = np.empty((steps, n), dtype=np.int64)
    path[-1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = came[t, rows, path[t]]
    return path


# ---- training


def _rewritten(kind: str, value: str, rng: np.random.Generator) -> str:
    """A labelled value in another form of its kind."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        name, _, host = value.partition("@")
        at, dot = [("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", ".")][rng.integers(5)]
        return name + at + host.replace(".", dot)
    if kind == "ip":
        dot = [".", "[.]", " . ", "(.)"][rng.integers(4)]
        return dot.join(str(x) for x in rng.integers(1, 256, 4))
    if kind == "card":
        mark = ["", " ", "-", ".", "  "][rng.integers(5)]
        return mark.join(digits(4) for _ in range(4))
    a, b, c = digits(3), digits(3), digits(4)
    forms = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"+1 ({a}) {b}-{c}")
    return forms[rng.integers(len(forms))]


def _harmless(rng: np.random.Generator) -> str:
    """A number or code that is no personal data: date, time, version, amount, short number, token."""
    n = lambda lo, hi: str(rng.integers(lo, hi))
    forms = (
        f"20{rng.integers(10, 40)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{n(0, 24)}:{rng.integers(0, 60):02d}",
        f"{n(1, 20)}.{n(0, 20)}", f"{n(1, 20)}.{n(0, 20)} {n(1990, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        f"{n(1, 20)}.{n(0, 20)}.{n(0, 99)}", f"{n(1, 999)},{rng.integers(0, 1000):03d}.{rng.integers(0, 100):02d}", n(0, 10**8),
        f"{n(1, 99)} {n(1, 999)} {n(1, 9999)}", rng.bytes(int(rng.integers(4, 20))).hex(), f"@{_WORDS[rng.integers(len(_WORDS))]}",
    )
    return forms[rng.integers(len(forms))]


_WORDS = ("home", "work", "noon", "user", "todo")


def trains(spans: list[Span], failed: list[tuple[int, int]]) -> bool:
    """False for a form of a kind without its label, or two readings of one place."""
    return not failed and not any(p[2] > q[1] for p, q in zip(spans, spans[1:], strict=False))


def training_set(windows: list[str], seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Windows with their labelled spans: as they are, with their spans rewritten, and with harmless numbers instead."""
    rng = np.random.default_rng(seed)
    out = []
    for text in windows:
        spans, failed = pattern_spans(text)
        if not trains(spans, failed):
            continue
        out.append((text, spans))
        for copy in range(REWRITES + 1 if spans else 0):
            built, moved, at = "", [], 0
            for kind, a, b in spans:
                value = _rewritten(kind, text[a:b], rng) if copy < REWRITES else _harmless(rng)
                built += text[at:a]
                if copy < REWRITES:
                    moved.append((kind, len(built), len(built) + len(value)))
                built += value
                at = b
            out.append((built + text[at:], moved))
    return out


def train(windows: list[str], seed: int = SEED, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger from sampled windows; None if they hold no span at all."""
    examples = training_set(windows, seed)
    if not any(spans for _, spans in examples):
        return None
    rng = np.random.default_rng(seed)
    model = Tagger({k: v.astype(np.float32) for k, v in Tagger.fresh(rng).w.items()})
    chars = [char_classes(t) for t, _ in examples]
    tags = [tags_of(len(c), s) for c, (_, s) in zip(chars, examples, strict=True)]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(chars))
        # Neighbours of about one length make a batch with little padding.
        order = np.concatenate([sorted(order[i : i + 8 * BATCH], key=lambda e: len(chars[e])) for i in range(0, len(order), 8 * BATCH)])
        for at in range(0, len(order), BATCH):
            use = order[at : at + BATCH]
            steps = max(len(chars[i]) for i in use)
            x = np.full((len(use), steps), _PAD)
            y, mask = np.zeros((len(use), steps), np.int64), np.zeros((len(use), steps), bool)
            for row, i in enumerate(use):
                x[row, : len(chars[i])], y[row, : len(tags[i])], mask[row, : len(tags[i])] = chars[i], tags[i], True
            _, grads = model.gradients(x, y, mask)
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            step += 1
            rate = np.float32(RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for k, g in grads.items():
                g = (g * min(1.0, 5.0 / (norm + 1e-12))).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = model.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


# ---- decoding


def regions(text: str, margin: int = MARGIN) -> list[tuple[int, int]]:
    """Stretches of text around cues, joined where they touch."""
    out: list[tuple[int, int]] = []
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def region_emissions(model: Tagger, classes: list[np.ndarray], batch: int = 1024) -> list[np.ndarray]:
    """Blended emission scores (length, tags) of each region from its overlapping windows."""
    where = [(r, s) for r, c in enumerate(classes) for s in range(0, max(1, len(c) - STRIDE), STRIDE)]
    edge = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)
    total = [np.zeros((len(c), N_TAGS)) for c in classes]
    weight = [np.zeros(len(c)) for c in classes]
    for at in range(0, len(where), batch):
        part = where[at : at + batch]
        x = np.full((len(part), WINDOW), _PAD)
        for row, (r, s) in enumerate(part):
            piece = classes[r][s : s + WINDOW]
            x[row, : len(piece)] = piece
        scores = model.emissions(x)
        for row, (r, s) in enumerate(part):
            n = min(WINDOW, len(classes[r]) - s)
            total[r][s : s + n] += scores[row, :n] * edge[:n, None]
            weight[r][s : s + n] += edge[:n]
    return [t / w[:, None] for t, w in zip(total, weight, strict=True)]


def model_spans(model: Tagger, texts: list[str], sure: float = SURE) -> list[list[Span]]:
    """Spans of the best global path of each region of each text, with every character sure enough.

    Long regions are decoded in overlapping pieces, so memory is bounded whatever the length of a text.
    """
    whole = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    places = [(i, *piece) for i, a, b in whole for piece in pieces_of(a, b)]
    found: list[list[Span]] = [[] for _ in texts]
    for lo in range(0, len(places), PIECES):
        _decode(model, texts, places[lo : lo + PIECES], found, sure)
    return [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in found]


def pieces_of(start: int, end: int) -> list[tuple[int, int, int, int]]:
    """(start, end, own start, own end) of the pieces in which a region is decoded; neighbours overlap.

    A span counts for the piece in whose own part it starts, so a piece sees at least ``OVERLAP`` characters
    before and after each of its spans, as far as the region goes, and no span is found twice.
    """
    if end - start <= PIECE + OVERLAP:
        return [(start, end, start, end)]
    return [(max(start, at - OVERLAP), min(end, at + PIECE + OVERLAP), at, min(end, at + PIECE)) for at in range(start, end, PIECE)]


def _decode(model: Tagger, texts: list[str], places: list[tuple], found: list[list[Span]], sure: float) -> None:
    emissions = region_emissions(model, [char_classes(texts[i][a:b]) for i, a, b, _, _ in places])
    trans = model.transitions
    order = sorted(range(len(places)), key=lambda r: len(emissions[r]))
    at = 0
    while at < len(order):
        size = max(1, 65_536 // max(1, len(emissions[order[at]])))
        group = order[at : at + min(size, 256)]
        at += len(group)
        steps = max(len(emissions[r]) for r in group)
        emit, mask = np.zeros((steps, len(group), N_TAGS)), np.zeros((steps, len(group)), bool)
        for col, r in enumerate(group):
            emit[: len(emissions[r]), col], mask[: len(emissions[r]), col] = emissions[r], True
        path = crf_path(emit, trans, mask)
        _, unary, _ = crf_marginals(emit, trans, mask, counts=False)
        for col, r in enumerate(group):
            i, start, end, own, own_end = places[r]
            tags = path[: end - start, col]
            for a in np.flatnonzero(tags % 2 == 1):
                b = a + 1
                while b < len(tags) and tags[b] == tags[a] + 1:
                    b += 1
                k = int(tags[a] // 2)
                both = unary[a:b, col, 1 + 2 * k] + unary[a:b, col, 2 + 2 * k]
                if both.min() >= sure and own <= start + int(a) < own_end:
                    found[i].append((KINDS[k], start + int(a), start + int(b)))


def _fits(kind: str, value: str) -> bool:
    digits = sum("0" <= c <= "9" for c in value)
    if kind == "email":
        return bool(re.search(r"@|[(\[] ?at ?[)\]]", value)) and len(value) >= 6
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= digits <= 19 and _luhn("".join(re.findall("[0-9]", value)))
    return 9 <= digits <= 15


def all_spans(model: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, pattern and added spans) of each text."""
    based = [pattern_spans(t) for t in texts]
    added = model_spans(model, texts) if model is not None else [[] for _ in texts]
    out = []
    for text, (good, failed), more in zip(texts, based, added, strict=True):
        taken = [(a, b) for _, a, b in good] + failed
        new = [s for s in more if _fits(s[0], text[s[1] : s[2]]) and not any(s[1] < b and a < s[2] for a, b in taken)]
        out.append((good, sorted(good + new, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


# ---- jobs


def windows_of(text: str, longest: int = 3 * WINDOW // 2) -> list[str]:
    """The regions of a text, long ones in several windows cut outside of pattern matches."""
    out = []
    for a, b in regions(text):
        part = text[a:b]
        good, failed = pattern_spans(part) if b - a > longest else ([], [])
        merged: list[list[int]] = []
        for lo, hi in sorted([(lo, hi) for _, lo, hi in good] + failed):
            if merged and lo < merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        starts, at = [m[0] for m in merged], 0
        while len(part) - at > longest:
            end = at + longest
            k = bisect_left(starts, end) - 1
            if k >= 0 and merged[k][1] > end:
                end = merged[k][0] if merged[k][0] > at else merged[k][1]
            out.append(part[at:end])
            at = end
        out.append(part[at:])
    return [w for w in out if 0 < len(w) <= 2 * longest]  # a longer one is a single match


def window_kinds(window: str) -> list[str]:
    """Kinds of the pattern spans of a window, "none" without any; empty if it cannot train."""
    spans, failed = pattern_spans(window)
    return sorted({k for k, _, _ in spans}) or ["none"] if trains(spans, failed) else []


def sample_windows(docs: DataFrame, text_col: str = "text", limit: int = SAMPLE) -> list[str]:
    """At most ``limit`` distinct windows of the corpus, those with the smallest digests: the same in every run.

    A fifth is drawn from the windows with a span of each kind and from those without span; what a rare kind
    leaves is filled from all.
    """
    text = null_safe_text(text_col)

    @pandas_udf("array<struct<w:string,kinds:array<string>>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [[(w, window_kinds(w)) for w in dict.fromkeys(windows_of(t))] for t in texts]
            yield pd.Series([[{"w": w, "kinds": kinds} for w, kinds in ws if kinds] for ws in found])

    rows = docs.where(text.rlike(CUE)).select(F.inline(cut(text)))
    found = materialize(rows.groupBy("w").agg(F.first("kinds").alias("kinds")), "pii-windows")  # kinds follow from w
    first = lambda rows, n: [r["w"] for r in rows.orderBy(F.md5("w"), "w").limit(n).collect()]
    drawn = [w for k in (*KINDS, "none") for w in first(found.where(F.array_contains("kinds", k)), limit // (len(KINDS) + 1))]
    return list(dict.fromkeys(drawn + first(found, limit)))[:limit]


def find_personal_data(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, base and spans (arrays of kind, start, end; code points, end exclusive)."""
    kind = "array<struct<kind:string,start:int,stop:int>>"

    @pandas_udf(f"base {kind}, spans {kind}")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list = [([], [])] * len(texts)
            some = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                for i, pair in zip(part, all_spans(model, [texts.iloc[i] for i in part]), strict=True):
                    rows[i] = pair
            as_rows = [[[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in pair] for pair in rows]
            yield pd.DataFrame({"base": [r[0] for r in as_rows], "spans": [r[1] for r in as_rows]})

    text = null_safe_text(text_col)
    # A text without a cue has no span; it is not sent to Python.
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), search(F.when(text.rlike(CUE), text)).alias("found"))
    return found.select("doc_id", "found.base", "found.spans")


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the pattern spans, and all spans as text."""
    found = find_personal_data(docs, train(sample_windows(docs)))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *[number(k) for k in KINDS],
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )
