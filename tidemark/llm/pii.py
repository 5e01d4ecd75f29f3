"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The rules give the base spans. The model is trained in numpy from labelled spans (generated here from fixed templates:
spellings that the rules know, spellings that they do not, and look-alikes without labels), by Adam on the CRF's negative
log-likelihood. A text is read in overlapping windows; every window runs through both LSTMs and is decoded by Viterbi, all
windows of a block at once. The windows' spans are then reconciled over the whole text: a span that a window's border cuts
is left to the next window (which has it whole, if it is shorter than the overlap), and of spans that overlap the set with
the greatest sum of scores stays. A span is added if it has its kind's form (see plausible) and overlaps no base span.
That form needs an at sign or four digits, so a window with neither cannot add a span and is not run, at any size.
Spans of the overlap's length or longer are the rules' alone.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; rows that repeat an id
are read one by one; a null id stays null; extra columns are kept by redact and not read by report; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import small_batches, trim

KINDS = ("email", "ip", "card", "phone")
# The rules' patterns (email without its first part, which find_emails reads backwards from the at sign; ip only
# from the first of a run of digits, since from the others it fails alike, so that long runs take linear time).
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_BEFORE_AT = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end: sorts by start, then kind


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := ord(text[start - 1])) < 128 and c in _BEFORE_AT:
            start -= 1
        m = _AFTER_AT.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(end, at + 1))
    return out


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind."""
    out = find_emails(text)
    if _ANY.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out)


# ---- the model

#: Code points of a training window; of a reading window, and how far apart these start; hidden units of a direction.
WINDOW, READ, STRIDE, HIDDEN = 64, 192, 128, 14
VOCABULARY = 130  # ASCII, one code for all beyond, one for places outside the text
TAGS = 1 + 2 * len(KINDS)  # none; then begin and inside of each kind
EXAMPLES, STEPS, BATCH, RATE = 5000, 450, 64, 0.02
#: Windows that run at once; code points of texts read together (a longer text is read alone).
BLOCK, PART_CHARS = 512, 1_000_000


def codes(cp: np.ndarray) -> np.ndarray:
    return np.minimum(cp, 128).astype(np.int64)


def _forbidden() -> np.ndarray:
    """Transitions into the inside of a kind from anything but its begin or inside."""
    bad = np.zeros((TAGS + 1, TAGS), bool)  # the last row: from the start
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = True
        bad[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return bad


@dataclass
class Tagger:
    """x: (2, VOCABULARY, 4 H) input weights, u: (2, H, 4 H) recurrent weights, w: (2 H, TAGS) and b: output, t: transitions."""

    x: np.ndarray
    u: np.ndarray
    w: np.ndarray
    b: np.ndarray
    t: np.ndarray

    def transitions(self) -> np.ndarray:
        return np.where(_forbidden(), np.float32(-1e4), self.t)

    def states(self, c: np.ndarray, keep: bool = False):
        """c: (B, T) codes. Hidden states (T, 2, B, H) of both directions, each in its own reading order; keep: and what
        the gradients need of each step."""
        n, steps = c.shape
        both = np.stack((c, c[:, ::-1])).transpose(2, 0, 1)  # (T, 2, B)
        # a sigmoid is a tangent of half its argument, so one tangent serves all gates
        half = np.repeat(np.array([0.5, 1], np.float32), (3 * HIDDEN, HIDDEN))
        x, u = self.x * half, self.u * half
        h = np.zeros((2, n, HIDDEN), np.float32)
        s = np.zeros_like(h)
        out = np.empty((steps, 2, n, HIDDEN), np.float32)
        tape = np.empty((3 * keep, steps, 2, n, HIDDEN), np.float32), np.empty((keep * steps, 2, n, 4 * HIDDEN), np.float32)
        d = np.arange(2)[:, None]
        for k in range(steps):
            z = x[d, both[k]]
            z += h @ u
            np.tanh(z, out=z)
            gates = z[..., : 3 * HIDDEN]
            gates *= 0.5
            gates += 0.5
            i, f, o, g = (z[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            if keep:
                tape[0][0, k], tape[0][1, k], tape[1][k] = h, s, z
            s = f * s + i * g
            e = np.tanh(s)
            if keep:
                tape[0][2, k] = e
            h = np.multiply(o, e, out=out[k])
        return (out, tape, both) if keep else out

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """(B, T, TAGS) scores."""
        h = self.states(c)
        joined = np.concatenate((h[:, 0], h[::-1, 1]), axis=2)
        return (joined @ self.w + self.b).transpose(1, 0, 2)

    def loss(self, c: np.ndarray, y: np.ndarray):
        """Negative log-likelihood per window of tags y (B, T), and the gradients of x, u, w, b, t."""
        n, steps = c.shape
        h, tape, both = self.states(c, keep=True)
        joined = np.concatenate((h[:, 0], h[::-1, 1]), axis=2)  # (T, B, 2 H)
        em = joined @ self.w + self.b  # (T, B, TAGS)
        tr = self.transitions()
        move, start = np.exp(tr[:-1]), np.exp(tr[-1])
        # forward and backward sums in one loop, as shares of their total (each step's total only enters the loss)
        top = em.max(2, keepdims=True)
        e = np.exp(em - top)
        step, both_e = np.stack((move, move.T)), np.stack((e, e[::-1]), 1)
        sums = np.empty((steps, 2, n, TAGS), np.float32)
        scale = np.empty((steps, n), np.float32)
        now = both_e[0] * np.stack((start, np.ones(TAGS, np.float32)))[:, None]
        for k in range(steps):
            if k:
                now = (now @ step) * both_e[k]
            part = now.sum(2, keepdims=True)
            now = sums[k] = now / part
            scale[k] = part[0, :, 0]
        ahead, behind = sums[:, 0], sums[::-1, 1]
        rows, at = np.arange(n)[None, :], np.arange(steps)[:, None]
        yt = y.T
        d_em = ahead.copy()
        d_em[:-1] *= behind[1:] @ move.T
        d_em /= d_em.sum(2, keepdims=True)
        d_t = np.zeros_like(self.t)
        d_t[-1] = d_em[0].sum(0)
        np.subtract.at(d_t[-1], yt[0], 1)
        weight = ((ahead[:-1] @ move) * behind[1:]).sum(2, keepdims=True)
        d_t[:-1] = move * np.tensordot(ahead[:-1] / weight, behind[1:], ((0, 1), (0, 1)))
        np.subtract.at(d_t, (yt[:-1], yt[1:]), 1)
        d_t[_forbidden()] = 0
        gold = em[at, rows, yt].sum(0) + tr[-1][yt[0]] + tr[yt[:-1], yt[1:]].sum(0)
        total = (np.log(scale) + top[:, :, 0]).sum(0)
        d_em[at, rows, yt] -= 1
        d_em /= n
        d_w = np.tensordot(joined, d_em, ((0, 1), (0, 1)))
        d_joined = d_em @ self.w.T
        d_h = np.stack((d_joined[..., :HIDDEN], d_joined[::-1, :, HIDDEN:]), axis=1)  # (T, 2, B, H) in reading order
        (before, held, e), gates = tape
        i, f, o, g = (gates[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
        slope = np.concatenate((g * i * (1 - i), held * f * (1 - f), e * o * (1 - o), i * (1 - g * g)), axis=3)
        through = o * (1 - e * e)
        dz = np.empty_like(slope)
        four = dz.reshape(steps, 2, n, 4, HIDDEN)
        slope = slope.reshape(four.shape)
        back_h = np.zeros((2, n, HIDDEN), np.float32)
        back_s = np.zeros_like(back_h)
        turned = self.u.transpose(0, 2, 1)
        for k in range(steps - 1, -1, -1):
            dh = d_h[k] + back_h
            ds = back_s + dh * through[k]
            np.multiply(slope[k], ds[:, :, None], out=four[k])
            np.multiply(slope[k, :, :, 2], dh, out=four[k, :, :, 2])
            back_s = ds * f[k]
            back_h = dz[k] @ turned
        d_u = before.transpose(1, 3, 0, 2).reshape(2, HIDDEN, -1) @ dz.transpose(1, 0, 2, 3).reshape(2, -1, 4 * HIDDEN)
        d_x = np.zeros_like(self.x)
        for d in (0, 1):
            code, by = np.unique(both[:, d].ravel(), return_inverse=True)
            order = np.argsort(by, kind="stable")
            d_x[d, code] = np.add.reduceat(dz[:, d].reshape(-1, 4 * HIDDEN)[order], np.searchsorted(by[order], np.arange(len(code))))
        return float((total - gold).mean()), (d_x, d_u, d_w, d_em.sum((0, 1)), d_t / n)

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """The best tags (B, T) of scores (B, T, TAGS), all sequences at once."""
        tr = self.transitions()
        move = tr[:-1, :, None]  # from, to
        em = np.ascontiguousarray(em.transpose(1, 2, 0))  # (T, TAGS, B)
        score = np.empty_like(em)
        score[0] = em[0] + tr[-1][:, None]
        for k in range(1, len(em)):
            np.max(score[k - 1][:, None] + move, axis=0, out=score[k])
            score[k] += em[k]
        out = np.empty((em.shape[2], len(em)), np.int8)
        out[:, -1] = score[-1].argmax(0)
        for k in range(len(em) - 1, 0, -1):
            out[:, k - 1] = (score[k - 1] + tr[:-1, out[:, k]]).argmax(0)
        return out


def labelled_examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with labelled spans: the operator's training set unless another is given."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghilmnoprstuvé") for _ in range(rng.integers(1, 10)))

    def card() -> str:
        body = digits(int(rng.integers(12, 18)))
        d = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        step = pick((20, 4))
        return pick((" ", "-", ".", " - ", "/")).join(d[i : i + step] for i in range(0, len(d), step))

    def email() -> str:
        name, host, top = word() + pick(("", ".", "_", "-", "+")) + pick((word(), digits(2))), word() + pick(("", digits(1))), pick(("com", "org", "net", "de", "io"))
        return pick((f"{name}@{host}.{top}", f"{name}@{word()}.{host}.{top}", f"{name} @ {host}.{top}", f"{name}@{host} . {top}", f"{name}@{host} dot {top}"))

    def ip() -> str:
        return pick((".", ".", " . ", "[.]")).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"+{digits(2)}/{a}/{b}{c}"))

    def other() -> str:
        return pick((digits(4), digits(2) + "%", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", "@" + word(), f"v{digits(1)}.{digits(1)}", f'"{"".join(pick("0123456789abcdef") for _ in range(40))}"', f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", digits(int(rng.integers(5, 9))), f"{digits(3)},{digits(3)}", f"{digits(2)} {digits(2)} {digits(1)}"))

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.integers(0, 8))), []
        for _ in range(rng.integers(1, 3)):
            kind = int(rng.integers(0, 7))
            text += pick((" ", " ", ", ", ": ", "\n")) if text else ""
            piece = makers[kind]() if kind < 4 else other()
            if kind < 4:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + pick((" ", " ", ", ", ". ", ".\n")) + " ".join(word() for _ in range(rng.integers(0, 5)))
        out.append((text, spans))
    return out


def _training_windows(examples, rng) -> tuple[np.ndarray, np.ndarray]:
    c = np.full((len(examples), WINDOW), 129, np.int64)
    y = np.zeros((len(examples), WINDOW), np.int64)
    for row, (text, spans) in enumerate(examples):
        cp = codes(np.frombuffer(text.encode("utf-32-le"), "<u4"))
        tags = np.zeros(len(cp), np.int64)
        for start, kind, end in spans:
            tags[start], tags[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
        at = int(rng.integers(0, max(1, len(cp) - WINDOW + 1)))
        part, t = cp[at : at + WINDOW], tags[at : at + WINDOW].copy()
        if len(t) and t[0] and t[0] % 2 == 0:
            t[0] -= 1  # a window that starts inside a span
        c[row, : len(part)], y[row, : len(t)] = part, t
    return c, y


def train(examples: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 3) -> Tagger:
    """Fit a tagger on labelled texts (start, kind, end)."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.normal(size=s) * 0.2).astype(np.float32)
    model = Tagger(init(2, VOCABULARY, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), init(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS + 1, TAGS), np.float32))
    model.x[..., HIDDEN : 2 * HIDDEN] += 1  # remember at first
    params = [model.x, model.u, model.w, model.b, model.t]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        chosen = [examples[i] for i in rng.integers(0, len(examples), BATCH)]
        _, grads = model.loss(*_training_windows(chosen, rng))
        rate = RATE * (1 - 0.9 * k / steps)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return model


@functools.lru_cache(1)
def default_tagger() -> Tagger:
    return train(labelled_examples())


def plausible(kind: int, s: str) -> bool:
    """Whether a string has its kind's form: an at sign between others (email), four numbers up to 255 (ip), 12 to 19
    digits that pass Luhn (card), 9 to 15 digits with a sign or separators (phone)."""
    d = _only_digits(s)
    if kind == 0:
        a, _, b = s.partition("@")
        return bool(a.strip()) and len(b.strip()) >= 4 and s.count("@") == 1 and "\n" not in s
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(s) <= 27
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d) and len(s) <= 2.5 * len(d)
    return 9 <= len(d) <= 15 and len(d) < len(s) <= 2.5 * len(d) and "\n" not in s


def _windows(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of a text that hold an at sign or four digits, and the text's codes with room for the last."""
    count = max(1, -(-(len(cp) - (READ - STRIDE)) // STRIDE))
    padded = np.full((count - 1) * STRIDE + READ, VOCABULARY - 1, np.uint8)
    padded[: len(cp)] = np.minimum(cp, 128)
    total = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(((padded >= 48) & (padded <= 57)).view(np.uint8) + (padded == 64).view(np.uint8) * np.uint8(4), out=total[1:])
    start = np.arange(count) * STRIDE
    return start[total[start + READ] - total[start] >= 4], padded


def _block_spans(model: Tagger, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window, start, kind, end, score) of the spans of windows of codes; the score is how far their tags beat none."""
    em = model.emissions(c)
    tags = model.viterbi(em)
    n, steps = tags.shape
    gain = np.take_along_axis(em, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - em[:, :, 0]
    gain = np.concatenate((np.zeros((n, 1), np.float32), np.cumsum(gain, 1)), 1)
    edge = (tags == 0) | (tags % 2 == 1)
    following = np.full((n, steps + 1), steps, np.int64)
    following[:, :steps] = np.where(edge, np.arange(steps), steps)
    following = np.minimum.accumulate(following[:, ::-1], 1)[:, ::-1]
    row, start = np.nonzero(tags % 2 == 1)
    end = following[row, start + 1]
    return row, start, (tags[row, start].astype(np.int64) - 1) // 2, end, gain[row, end] - gain[row, start]


def reconciled(found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Of spans (start, kind, end, score) the disjoint ones with the greatest sum of scores (repeats count once)."""
    best: dict[Span, float] = {}
    for start, kind, end, score in found:
        key = (start, kind, end)
        best[key] = max(score, best.get(key, 1e-6))
    order = sorted(best, key=lambda x: (x[2], x[0], x[1]))
    ends = [x[2] for x in order]
    value, take = [0.0], []
    for k, x in enumerate(order):
        before = bisect.bisect_right(ends, x[0], 0, k)
        with_it = value[before] + best[x]
        take.append((with_it > value[k], before))
        value.append(max(with_it, value[k]))
    out, k = [], len(order)
    while k:
        taken, before = take[k - 1]
        if taken:
            out.append(order[k - 1])
        k = before if taken else k - 1
    return out[::-1]


def model_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """The model's spans that have their kind's form in each text, before they are held against the rules'. BLOCK windows
    are in memory at once."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    held: list[tuple[int, int, int]] = []  # text, start of the window, length of the text
    rows: list[np.ndarray] = []

    def run() -> None:
        for window, start, kind, end, score in zip(*(x.tolist() for x in _block_spans(model, np.stack(rows))), strict=True):
            n, begin, size = held[window]
            if (start == 0 and begin > 0) or begin + end > size or (end == READ and begin + end < size):
                continue  # cut by the window's border, or beyond the text
            while end > start and texts[n][begin + end - 1] in " .,;:-":
                end -= 1
            if plausible(kind, texts[n][begin + start : begin + end]):
                found[n].append((begin + start, kind, begin + end, score))
        held.clear()
        rows.clear()

    for n, text in enumerate(texts):
        if not ("@" in text or _ANY.search(text)):
            continue
        start, padded = _windows(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        for a in start.tolist():
            held.append((n, a, len(text)))
            rows.append(padded[a : a + READ])
            if len(held) == BLOCK:
                run()
    if held:
        run()
    return [reconciled(x) for x in found]


def spans(model: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    added = model_spans(model, texts) if model is not None else [[] for _ in texts]
    out = []
    for text, extra in zip(texts, added, strict=True):
        base = base_spans(text)
        every = list(base)
        # base spans of one kind are disjoint, those of different kinds may overlap: what they cover, merged
        begins, ends = [], []
        for a, _, b in base:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
        for start, kind, end in extra:
            k = bisect.bisect_right(ends, start)  # the first covered stretch that ends behind start
            if k == len(begins) or end <= begins[k]:
                every.append((start, kind, end))
        out.append((base, sorted(every)))
    return out


def _in_parts(model: Tagger, texts: list[str]):
    """spans() of the texts, PART_CHARS code points at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PART_CHARS):
            size += len(texts[end])
            end += 1
        yield from zip(texts[at:end], spans(model, texts[at:end]), strict=True)
        at = end


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_REPORT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def _report(model: Tagger):
    @F.pandas_udf(_REPORT)
    def report(text: pd.Series) -> pd.DataFrame:
        rows = []
        for _, (base, every) in _in_parts(model, [t if isinstance(t, str) else "" for t in text]):
            count = [0] * len(KINDS)
            for _, k, _ in base:
                count[k] += 1
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        trim()
        return pd.DataFrame(rows, columns=_REPORT.names)

    return report


def report(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (all) and n_added of every row."""
    model = model or default_tagger()
    small_batches(docs.sparkSession)
    got = docs.select(F.col(id_col).alias("_id"), _report(model)(F.col(text_col).cast("string")).alias("_r"))
    return got.select(F.col("_id").alias(id_col), "_r.*")


def redacted(text: str, found: list[Span]) -> str:
    """text with every span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    out, end = [], 0
    for a, k, b in found:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """docs, all columns, with personal data in text_col replaced (null stays null)."""
    model = model or default_tagger()
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series) -> pd.Series:
        plain = [t if isinstance(t, str) else "" for t in text]
        out = [redacted(t, every) if isinstance(t0, str) else None for t0, (t, (_, every)) in zip(text, _in_parts(model, plain), strict=True)]
        trim()
        return pd.Series(out, dtype=object)

    return docs.select(*[clean(F.col(f"`{c}`").cast("string")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
