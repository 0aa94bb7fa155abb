"""Personal data: fixed patterns plus a character BiLSTM with a CRF, trained in numpy."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, c, map_batches

# Kinds in the order of the report, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Signs written out in brackets, and what a span has at least: a digit, an @ or one of those.
SPELLED = re.compile(r"[\[(] ?(at|dot|@|\.) ?[\])]", re.IGNORECASE)
TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:at|dot) ?[\])]", re.IGNORECASE)

# Reach of a region around a trigger, window length and step, size of each LSTM.
REACH, WINDOW, STEP, HIDDEN = 32, 64, 32, 16
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
# Bounds of the fit.
TRAIN_DOCS, TRAIN_WINDOWS, DRAWN_WINDOWS, EPOCHS, BATCH = 4_000, 960, 2_000, 12, 32
SURE, SHORTEST = 0.75, 6


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each @ is looked at with the characters before it that an address may have."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) by kind and start, and the matches that were dropped because they fail the kind's test."""
    spans, dropped = [], []
    if "@" in text:
        spans += [(0, a, b) for a, b in _emails(text)]
    if re.search(r"[0-9]", text):
        def sort(kind, matches, test):
            for m in matches:
                if test(m):
                    spans.append((kind, m.start(), m.end()))
                else:
                    dropped.append((m.start(), m.end()))

        if "." in text:
            sort(1, IP.finditer(text), lambda m: all(map(_small, m.group().split("."))))
        sort(2, CARD.finditer(text), lambda m: 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and _luhn(d))
        if "+" in text:
            sort(3, PHONE.finditer(text), lambda m: 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15)
    return spans, dropped


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span can be of its kind whatever its separators are: the test of what the tagger adds.

    A span stands alone, without a letter or digit before or after it. Spelled-out and spaced signs
    are read as the signs; then the tests of the fixed patterns hold.
    """
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    span = text[start:end]
    if kind in (0, 1):
        span = SPELLED.sub(lambda m: {"at": "@", "dot": "."}.get(m.group(1).lower(), m.group(1)), span)
        span = re.sub(" ?([@.]) ?", r"\1", span)
        if kind == 0:
            return EMAIL.fullmatch(span) is not None
        return IP.fullmatch(span) is not None and all(map(_small, span.split(".")))
    digits = re.sub("[^0-9]", "", span)
    if re.search("[^0-9 +()./_-]", span) or span[0] not in "+(0123456789" or not span[-1].isdecimal():
        return False
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def drawn_span(kind: int, r: np.random.Generator) -> str:
    """A made-up span of a kind, in a usual or an unusual writing."""
    def pick(*of):
        return of[r.integers(len(of))]

    def word(low, high):
        return "".join(chr(97 + k) for k in r.integers(0, 26, r.integers(low, high)))

    def number(size):
        return "".join(map(str, r.integers(0, 10, size)))

    if kind == 0:
        name = pick(word(2, 9), word(1, 7).title(), word(1, 6) + pick(".", "_", "-", "+") + pick(word(2, 8), number(2)))
        dot = pick(".", ".", " . ", "(dot)", "[dot]", " (dot) ", " [dot] ", "[.]")
        host = [word(2, 9) + pick("", number(1)), *[word(2, 8)] * int(r.integers(0, 2)), pick("com", "org", "net", word(2, 4))]
        return name + pick("@", "@", " @ ", "(at)", "[at]", " (at) ", " [at] ", "[@]") + dot.join(host)
    if kind == 1:
        return pick(".", " . ", "[.]", "(.)", "[dot]", " [dot] ", "(dot)", " (dot) ").join(map(str, r.integers(0, 256, 4)))
    if kind == 2:
        digits = pick("4", "5", "3") + number(pick(14, 14, 14, 13))
        digits += next(d for d in "0123456789" if _luhn(digits + d))
        cuts = (4, 8, 12) if len(digits) == 16 else (4, 10)
        parts = [digits[a:b] for a, b in zip((0, *cuts), (*cuts, None))]
        return pick("", " ", "-", ".", "/", "_", " - ", "  ", " / ").join(parts)
    parts = [number(k) for k in pick((3, 3, 4), (3, 4, 4), (2, 4, 4), (4, 6), (3, 2, 2, 2), (5, 5))]
    if r.random() < 0.3:
        parts[0] = f"({parts[0]})"
    code = pick("+1", "+49", "+351", "001", "0044", "", "", "")
    between = pick(" ", "-", ".", "/", " - ")
    return (code + pick(" ", between) if code else "") + between.join(parts)


def drawn_other(r: np.random.Generator) -> str:
    """Made-up text with digits or brackets that is no personal data: dates, times, amounts, versions, hex numbers, words."""
    n = [int(k) for k in r.integers(0, 60, 6)]
    return (
        f"20{n[0]:02}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02}", f"{n[0] % 24}:{n[1]:02}:{n[2]:02}",
        f"20{n[0]:02}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02} {n[3] % 24:02}:{n[4]:02}",
        f"{n[0] + 1},{n[1]:03},{n[2]:03}", f"{n[0]}.{n[1]}{n[2]}", f"v{n[0]}.{n[1]}.{n[2]}", f"19{n[0]:02}-20{n[1]:02}",
        r.bytes(int(r.integers(8, 20))).hex(), "978-" + "-".join(f"{k:02}" for k in n), f"({n[0]})", f"[{n[1]}]",
        f"{n[0]}/{n[1]}", f"({'is in of an'.split()[n[0] % 4]})", f"#{n[0]}{n[1]}{n[2]}{n[3]}", f"{n[0]} x {n[1]} x {n[2]}",
    )[r.integers(15)]


def drawn_windows(contexts: list[str], count: int, seed: int = 7) -> tuple[list[str], list[list[int]]]:
    """*count* windows of made-up spans and other numbers between words of the *contexts*, with their labels.

    Four in five hold a span, cut by the window's edge now and then.
    """
    r = np.random.default_rng(seed)
    texts, labels = [], []
    for k in range(count):
        left, right = (contexts[i] for i in r.integers(0, len(contexts), 2))
        kind = k % 5
        middle = drawn_span(kind, r) if kind < len(KINDS) else drawn_other(r)
        left = left[:int(r.integers(0, WINDOW))] + (" ", " ", "\n", ": ", " \"")[r.integers(5)]
        text = left + middle + (" ", " ", ", ", ". ", "\n", "")[r.integers(6)]
        text += (" " if middle and text.endswith(middle) and right[:1].isalnum() else "") + right
        spans = [(kind, len(left), len(left) + len(middle))] if kind < len(KINDS) else []
        # base spans of the contexts keep their labels
        spans += [s for s in base_spans(text)[0] if not any(a < s[2] and s[1] < b for _, a, b in spans)]
        a = int(r.integers(0, max(1, min(len(left) + 8, len(text) - WINDOW + 1))))
        texts.append(text[a:a + WINDOW])
        labels.append(_labels(text, a, min(len(text), a + WINDOW), spans))
    return texts, labels


def _classes() -> dict[str, int]:
    """Digits, small and capital letters share a class each; other ASCII signs have their own."""
    table = {ch: 1 for ch in "0123456789"}
    table |= {chr(k): 2 for k in range(97, 123)} | {chr(k): 3 for k in range(65, 91)}
    signs = [chr(k) for k in [9, 10, 13, *range(32, 127)] if chr(k) not in table]
    return table | {ch: 6 + k for k, ch in enumerate(signs)}


CLASS = _classes()
CLASSES = 6 + len(set(CLASS.values())) - 3


def char_classes(text: str) -> list[int]:
    """Class of each character: 0 is padding, 4 another letter, 5 anything else."""
    return [CLASS.get(ch) or (4 if ch.isalpha() else 5) for ch in text]


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches within REACH characters of a trigger; no span lies elsewhere."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(region: tuple[int, int]) -> list[tuple[int, int]]:
    """Overlapping windows that cover a region."""
    a, b = region
    starts = range(a, max(a + 1, b - WINDOW + STEP), STEP)
    return [(s, min(b, s + WINDOW)) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _lstm(wx, wh, x):
    """Hidden states (time, batch, HIDDEN) and what the backward pass needs; x: class numbers (time, batch)."""
    h = s = np.zeros((x.shape[1], wh.shape[0]), np.float32)
    kept = []
    for xt in x:
        g = wx[xt] + h @ wh
        i, f, o = _sigmoid(g[:, :3 * HIDDEN]).reshape(len(g), 3, HIDDEN).transpose(1, 0, 2)
        u = np.tanh(g[:, 3 * HIDDEN:])
        before, s = s, f * s + i * u
        t = np.tanh(s)
        kept.append((h, before, i, f, o, u, t))
        h = o * t
    return np.stack([k[4] * k[6] for k in kept]), kept


def _lstm_back(wx, wh, x, kept, dh_all):
    dwx, dwh = np.zeros_like(wx), np.zeros_like(wh)
    dh = ds = np.zeros_like(kept[0][0])
    for xt, (h, before, i, f, o, u, t), d in zip(x[::-1], kept[::-1], dh_all[::-1]):
        dh = dh + d
        ds = ds + dh * o * (1 - t * t)
        g = np.concatenate((ds * u * i * (1 - i), ds * before * f * (1 - f), dh * t * o * (1 - o), ds * i * (1 - u * u)), 1)
        np.add.at(dwx, xt, g)
        dwh += h.T @ g
        dh, ds = g @ wh.T, ds * f
    return dwx, dwh


@dataclass
class SpanTagger:
    """Bidirectional character LSTM whose scores go through CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> "SpanTagger":
        r = np.random.default_rng(seed)
        def mat(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        p = {}
        for d in "fb":
            p["x" + d] = mat(CLASSES, 4 * HIDDEN, scale=0.3)
            p["x" + d][:, HIDDEN:2 * HIDDEN] += 1.0  # remember at first
            p["h" + d] = mat(HIDDEN, 4 * HIDDEN, scale=0.2)
        p["out"], p["bias"] = mat(2 * HIDDEN, LABELS, scale=0.2), np.zeros(LABELS, np.float32)
        p["step"], p["first"] = np.zeros((LABELS, LABELS), np.float32), np.zeros(LABELS, np.float32)
        return cls(p)

    def scores(self, x: np.ndarray):
        """Label scores (time, batch, label) of class numbers (batch, time)."""
        xt = np.ascontiguousarray(x.T)
        hf, kf = _lstm(self.p["xf"], self.p["hf"], xt)
        hb, kb = _lstm(self.p["xb"], self.p["hb"], xt[::-1])
        h = np.concatenate((hf, hb[::-1]), axis=2)
        return h @ self.p["out"] + self.p["bias"], (xt, h, kf, kb)

    def marginals(self, e: np.ndarray):
        """Log partition, label probabilities and the sums of pair probabilities."""
        step, n = self.p["step"], len(e)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + self.p["first"]
        for t in range(1, n):
            a[t] = e[t] + _logsumexp(a[t - 1][:, :, None] + step, 1)
        for t in range(n - 2, -1, -1):
            b[t] = _logsumexp(step[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _logsumexp(a[-1], 1)
        pair = np.exp(a[:-1, :, :, None] + step + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        return z, np.exp(a + b - z[None, :, None]), pair

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> "SpanTagger":
        """Maximise the likelihood of the labels y (batch, time) by Adam."""
        r = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        n = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for part in range(0, len(x), BATCH):
                n += 1
                grad = self.gradient(x[order[part:part + BATCH]], y[order[part:part + BATCH]])
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(
                        np.float32)
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, (xt, h, kf, kb) = self.scores(x)
        _, probs, pair = self.marginals(e)
        yt, size = y.T, x.shape[0]
        de = probs.copy()
        np.subtract.at(de, (np.arange(len(yt))[:, None], np.arange(size)[None, :], yt), 1)
        de /= size
        seen = np.zeros((LABELS, LABELS), np.float32)
        np.add.at(seen, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        dh = de @ self.p["out"].T
        xf, hf = _lstm_back(self.p["xf"], self.p["hf"], xt, kf, dh[:, :, :HIDDEN])
        xb, hb = _lstm_back(self.p["xb"], self.p["hb"], xt[::-1], kb, dh[::-1, :, HIDDEN:])
        return {
            "xf": xf, "hf": hf, "xb": xb, "hb": hb, "out": np.tensordot(h, de, ((0, 1), (0, 1))),
            "bias": de.sum((0, 1)), "step": (pair - seen) / size, "first": de[0].sum(0)}

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label sequence of each window (Viterbi) and the probability of each of its labels."""
        e, _ = self.scores(x)
        _, probs, _ = self.marginals(e)
        best, back = e[0] + self.p["first"], []
        for t in range(1, len(e)):
            move = best[:, :, None] + self.p["step"]
            back.append(move.argmax(1))
            best = move.max(1) + e[t]
        path = [best.argmax(1)]
        for choice in reversed(back):
            path.append(choice[np.arange(len(choice)), path[-1]])
        labels = np.array(path[::-1]).T
        sure = np.take_along_axis(probs.transpose(1, 0, 2), labels[:, :, None], 2)[:, :, 0]
        return labels, sure


def _labels(text: str, a: int, b: int, spans: list[tuple[int, int, int]]) -> list[int]:
    out = [0] * (b - a)
    for kind, s, t in spans:
        for i in range(max(a, s), min(b, t)):
            out[i - a] = 1 + 2 * kind + (i > s)
    return out


def _padded(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), WINDOW), np.int64)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


def find_spans(texts: list[str], tagger: SpanTagger | None) -> list[tuple[list, list]]:
    """For each text its base spans and all spans: the base ones and those the tagger adds.

    The windows of all texts are decoded together. Each character takes its label from
    the window in whose middle it is; runs of labels are then spans of the whole text,
    whatever windows they cross. Spans are added if every label in them is sure, if they
    are :func:`plausible` and if no base span touches them; matches that a pattern's test
    dropped may be part of them.
    """
    based = [base_spans(t) for t in texts]
    if tagger is None:
        return [(sorted(s), sorted(s)) for s, _ in based]
    spots = [(k, r, w) for k, t in enumerate(texts) for r in regions(t) for w in windows(r)]
    added: list[list] = [[] for _ in texts]
    labels: dict[int, dict[int, tuple[int, float]]] = {}
    for part in range(0, len(spots), 1024):
        chunk = spots[part:part + 1024]
        found, sure = tagger.decode(_padded([char_classes(texts[k][a:b]) for k, _, (a, b) in chunk]))
        edge = (WINDOW - STEP) // 2
        for (k, (ra, rb), (a, b)), row, p in zip(chunk, found, sure):
            own = labels.setdefault(k, {})
            for i in range(a if a == ra else a + edge, b if b == rb else a + edge + STEP):
                if row[i - a]:
                    own[i] = (int(row[i - a]), float(p[i - a]))
    for k, own in labels.items():
        taken = [(s, e) for _, s, e in based[k][0]]
        run: list[int] = []
        for i in [*sorted(own), None]:
            kind = None if i is None else (own[i][0] - 1) // 2
            if run and (i is None or i != run[-1] + 1 or own[i][0] % 2 == 1 or kind != (own[run[0]][0] - 1) // 2):
                s, e, of = run[0], run[-1] + 1, (own[run[0]][0] - 1) // 2
                fine = (
                    e - s >= SHORTEST and min(own[j][1] for j in run) >= SURE and plausible(of, texts[k], s, e)
                    and not any(x < e and s < y for x, y in taken))
                if fine:
                    added[k].append((of, s, e))
                run = []
            if i is not None:
                run.append(i)
    return [(sorted(s), sorted(s + more)) for (s, _), more in zip(based, added)]


def fit_tagger(
    docs: DataFrame, *, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS, drawn: int = DRAWN_WINDOWS,
) -> SpanTagger | None:
    """Train on windows of the *train_docs* documents that come first by a hash of the id.

    Up to *train_windows* windows are labelled by the base patterns, two thirds of them
    with a span if there are as many. Between their words *drawn* more windows hold made-up
    spans, also in writings that the patterns do not know, and numbers that are no personal
    data. None if no document has a window.
    """
    chosen = bounded_sample(docs.filter(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", train_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "at": [], "w": [], "y": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            spans, _ = base_spans(text)
            for r in regions(text):
                for a, b in windows(r):
                    for k, v in zip(out, (doc_id, a, text[a:b], _labels(text, a, b, spans))):
                        out[k].append(v)
        return out

    cut = map_batches(sample, run, "doc_id bigint, at int, w string, y array<int>").withColumn(
        "some", F.exists("y", lambda v: v > 0))
    order = [F.xxhash64("doc_id", "at"), "doc_id", "at", F.col("y").cast("string"), "w"]
    some = cut.filter("some").orderBy(*order).limit(train_windows * 2 // 3)
    none = cut.filter("not some").orderBy(*order).limit(train_windows // 3)
    rows = some.unionAll(none).select("w", "y").collect()
    if not rows:
        return None
    texts, labels = drawn_windows([r.w for r in rows], drawn)
    x = _padded([char_classes(t) for t in [r.w for r in rows] + texts])
    return SpanTagger.new().fit(x, _padded([r.y for r in rows] + labels))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_documents(docs: DataFrame, tagger: SpanTagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; NULL texts are empty.

    The counts and the digest are those of the base spans; ``spans`` lists all of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = find_spans([t or "" for t in batch.column(1).to_pylist()], tagger)
        return {
            "doc_id": batch.column(0),
            **{f"n_{name}": [sum(s[0] == k for s in base) for base, _ in found] for k, name in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(_named(base).encode()).hexdigest() for base, _ in found],
            "spans": [_named(every) for _, every in found]}

    schema = ", ".join([f"doc_id {kind}", *[f"n_{n} bigint" for n in KINDS], "base_sha256 string", "spans string"])
    return map_batches(docs.select("doc_id", "text"), run, schema, rows=256)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, tagger: SpanTagger | None) -> DataFrame:
    """All columns of *docs* with personal data in ``text`` masked; a NULL text stays NULL."""
    names = docs.columns
    text = names.index("text")

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text).to_pylist()
        found = find_spans([t or "" for t in texts], tagger)
        return {
            **{n: batch.column(i) for i, n in enumerate(names)},
            "text": [None if t is None else masked(t, every) for t, (_, every) in zip(texts, found)]}

    return map_batches(docs.select(*[c(n) for n in names]), run, docs.schema.toDDL(), rows=256)


def private_documents(docs: DataFrame) -> DataFrame:
    return personal_documents(docs, fit_tagger(docs))
