"""Personal data: fixed patterns, and a character tagger that adds spans to them.

The tagger is a bidirectional LSTM over characters with conditional-random-field transitions, written in numpy. It
learns from labelled spans: the pattern matches in a bounded sample of windows (``SAMPLE``, by hash of the window), with
windows that hold digits but no match as counter-examples. For tagging, windows of ``WINDOW`` characters overlap by
half; where two windows cover a character their scores are averaged by distance from the window's rim, and one Viterbi
pass decodes each whole region, so that no span depends on where a window was cut.

Every kind needs a digit or an ``@``. Windows without one are not scored: a span in them would be refused anyway, as a
span must look like its kind (``plausible``). Offsets are code points, ends are exclusive.

NULL and empty texts have no spans. With no labelled sample the patterns alone decide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
#: Windows that training sees at most, half of them with a label.
SAMPLE = 600
HIDDEN, STEPS, BATCH, RATE = 12, 240, 32, 0.02

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CLUE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start. Each pattern is tried only where a match can begin, so that long runs of
    one character take linear time."""
    out: list[tuple[int, int, int]] = []
    if not CLUE.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append((0, start, found.end()))
        end = found.end() if found else at + 1
        at = text.find("@", end)
    run = DIGITS.search(text)
    while run:
        found, end = IP.match(text, run.start()), run.end()
        if found:
            end = found.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.groups()):
                out.append((1, found.start(), end))
        run = DIGITS.search(text, end)
    for found in CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, found.start(), found.end()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
                out.append((3, found.start(), found.end()))
    return out


def plausible(kind: int, piece: str) -> bool:
    """What a span of the tagger must look like, besides the tagger's own decision."""
    digits = sum("0" <= c <= "9" for c in piece)
    if any(c.isspace() and c != " " for c in piece) or piece != piece.strip():
        return False
    letters = any(c.isalpha() for c in piece)
    if kind == 0:
        return piece.count("@") == 1 and "." in piece.partition("@")[2] and " " not in piece
    if kind == 1:
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[:4]) <= 255 and len(p) <= 3 for p in parts)
    if kind == 2:
        joined = piece.replace(" ", "").replace("-", "")
        return not letters and 13 <= digits <= 19 and joined.isascii() and joined.isdigit() and luhn(joined)
    return not letters and 10 <= digits <= 15 and (piece[0] in "+(") and len(piece) <= 2 * digits


# -- tagger ------------------------------------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SYMBOLS = 98


def symbols(text: str) -> np.ndarray:
    """Printable ASCII one by one, other letters as one symbol, all else as another."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out = np.where((points >= 32) & (points < 127), points - 31, 96)
    out[points >= 0xAA] = 97
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {"trans": np.zeros((LABELS, LABELS)), "out": rng.normal(0, 0.2, (2 * HIDDEN, LABELS)), "bias": np.zeros(LABELS)}
    for side in "fb":
        model[f"{side}in"] = rng.normal(0, 0.2, (SYMBOLS, 4 * HIDDEN))
        model[f"{side}in"][:, HIDDEN : 2 * HIDDEN] += 1  # remember by default
        model[f"{side}rec"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    return model


def lstm(model: dict, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) over symbols (time, batch)."""
    h = c = np.zeros((x.shape[1], HIDDEN))
    out = np.empty((len(x), x.shape[1], HIDDEN))
    for t in range(len(x)):
        gates = model[f"{side}in"][x[t]] + h @ model[f"{side}rec"]
        i, f, o = np.split(sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
        g = np.tanh(gates[:, 3 * HIDDEN :])
        if keep is not None:
            keep.append((i, f, o, g, c, h))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    return out


def lstm_back(model: dict, side: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, c0, h0 = kept[t]
        tc = np.tanh(f * c0 + i * g)
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        gates = np.concatenate(
            [dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        np.add.at(grad[f"{side}in"], x[t], gates)
        grad[f"{side}rec"] += h0.T @ gates
        dh, dc = gates @ model[f"{side}rec"].T, dc * f


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Label scores (time, batch, LABELS) of windows x (time, batch)."""
    both = np.concatenate([lstm(model, "f", x), lstm(model, "b", x[::-1])[::-1]], axis=2)
    return both @ model["out"] + model["bias"]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def learn_step(model: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss and gradient of the conditional log-likelihood of labels y (time, batch)."""
    keep: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([lstm(model, "f", x, keep["f"]), lstm(model, "b", x[::-1], keep["b"])[::-1]], axis=2)
    e = both @ model["out"] + model["bias"]
    n, size = y.shape
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0]
    for t in range(1, n):
        ahead[t] = e[t] + log_sum(ahead[t - 1][:, :, None] + model["trans"], 1)
    for t in range(n - 2, -1, -1):
        behind[t] = log_sum(model["trans"] + (e[t + 1] + behind[t + 1])[:, None, :], 2)
    z = log_sum(ahead[-1], 1)
    cols = np.arange(size)
    de = np.exp(ahead + behind - z[None, :, None])
    dtrans = np.zeros_like(model["trans"])
    gold = e[np.arange(n)[:, None], cols, y].sum() + model["trans"][y[:-1], y[1:]].sum()
    for t in range(1, n):
        both_t = ahead[t - 1][:, :, None] + model["trans"] + (e[t] + behind[t])[:, None, :] - z[:, None, None]
        dtrans += np.exp(both_t).sum(axis=0)
    np.add.at(dtrans, (y[:-1], y[1:]), -1)
    de[np.arange(n)[:, None], cols, y] -= 1
    grad = {k: np.zeros_like(v) for k, v in model.items()}
    grad["trans"], grad["bias"] = dtrans, de.sum(axis=(0, 1))
    grad["out"] = np.tensordot(both, de, axes=([0, 1], [0, 1]))
    dh = de @ model["out"].T
    lstm_back(model, "f", x, keep["f"], dh[:, :, :HIDDEN], grad)
    lstm_back(model, "b", x[::-1], keep["b"], dh[::-1, :, HIDDEN:], grad)
    return (z.sum() - gold) / size, {k: v / size for k, v in grad.items()}


def train(windows: list[tuple[str, list[tuple[int, int, int]]]]) -> dict[str, np.ndarray]:
    """Fit by Adam on windows of WINDOW characters and their spans."""
    x, y = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), np.int64)
    for j, (text, spans) in enumerate(windows):
        x[: len(text), j] = symbols(text)
        for kind, start, end in reversed(spans):
            y[start, j], y[start + 1 : end, j] = 1 + 2 * kind, 2 + 2 * kind
    model, rng = start_model(), np.random.default_rng(11)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, STEPS + 1):
        take = rng.integers(0, len(windows), BATCH)
        _, grad = learn_step(model, x[:, take], y[:, take])
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def viterbi(trans: np.ndarray, e: np.ndarray) -> np.ndarray:
    back = np.empty(e.shape, np.int64)
    score = e[0]
    for t in range(1, len(e)):
        through = score[:, None] + trans
        back[t] = through.argmax(axis=0)
        score = through.max(axis=0) + e[t]
    path = np.empty(len(e), np.int64)
    path[-1] = score.argmax()
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def regions(text: str) -> list[list[int]]:
    """Starts of the half-overlapping windows that hold a digit or ``@``, in groups that touch."""
    half, out = WINDOW // 2, []
    cells = sorted({m.start() // half for m in CLUE.finditer(text)})
    for cell in sorted({max(0, c - 1) for c in cells} | set(cells)):
        if out and cell == out[-1][-1] + 1:
            out[-1].append(cell)
        else:
            out.append([cell])
    return out


RIM = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)


def tagged_spans(model: dict, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger gives to each text, before they are merged with those of the patterns."""
    half = WINDOW // 2
    places, rows = [], []
    for n, text in enumerate(texts):
        if not CLUE.search(text):
            continue
        for cells in regions(text):
            places.append((n, cells))
            rows += [symbols(text[c * half : c * half + WINDOW]) for c in cells]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    x = np.zeros((WINDOW, len(rows)), np.int64)
    for j, row in enumerate(rows):
        x[: len(row), j] = row
    scores = [emissions(model, x[:, j : j + 512]) for j in range(0, len(rows), 512)]
    e = np.concatenate(scores, axis=1) if scores else None
    j = 0
    for n, cells in places:
        size = min(len(texts[n]) - cells[0] * half, (len(cells) + 1) * half)
        total, weight = np.zeros(((len(cells) + 1) * half, LABELS)), np.zeros((len(cells) + 1) * half)
        for k in range(len(cells)):
            total[k * half : k * half + WINDOW] += e[:, j] * RIM[:, None]
            weight[k * half : k * half + WINDOW] += RIM
            j += 1
        path = viterbi(model["trans"], (total / weight[:, None])[:size])
        at = 0
        while at < size:
            label = int(path[at])
            end = at + 1
            if label % 2 == 1:
                while end < size and path[end] == label + 1:
                    end += 1
                out[n].append(((label - 1) // 2, cells[0] * half + at, cells[0] * half + end))
            at = end
    return out


def merged(text: str, base: list, extra: list) -> list[tuple[int, int, int]]:
    """The pattern spans, and those of the tagger that overlap none of them and look like their kind."""
    out = list(base)
    taken = sorted((s, e) for _, s, e in base)
    for kind, start, end in extra:
        if plausible(kind, text[start:end]) and all(e <= start or s >= end for s, e in taken):
            out.append((kind, start, end))
            taken.append((start, end))
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def sample_windows(docs: DataFrame, text: str = "text") -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most SAMPLE windows around digits and ``@``, with their labels, drawn by hash from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, labelled = [], []
            for t in batch.column("t").to_pylist():
                if not t or not CLUE.search(t):
                    continue
                spans, edge = base_spans(t), 0
                for clue in CLUE.finditer(t):
                    if clue.start() < edge:
                        continue
                    start = max(0, clue.start() - WINDOW // 2 + int.from_bytes(hashlib.md5(t[clue.start() :][:20].encode()).digest()[:1], "big") % 16)
                    start = min(start, clue.start())
                    edge = start + WINDOW
                    if any(s < start < e or s < edge < e for _, s, e in spans):
                        continue
                    pieces.append(t[start:edge])
                    labelled.append(any(start <= s and e <= edge for _, s, e in spans))
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(labelled, pa.bool_())], names=["piece", "labelled"])

    found = docs.select(F.col(text).alias("t")).filter(F.col("t").rlike("[0-9@]")).mapInArrow(run, "piece string, labelled boolean")
    from vitrine.llm.common import cut

    found = cut(found.groupBy("piece").agg(F.first("labelled").alias("labelled")), "windows")
    half = SAMPLE // 2
    out = []
    for wanted in (True, False):
        rows = found.filter(F.col("labelled") == wanted).orderBy(F.xxhash64("piece"), "piece").limit(half).collect()
        out += [(r.piece, base_spans(r.piece)) for r in rows]
    return out


def fit(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray] | None:
    windows = sample_windows(docs, text)
    return train(windows) if any(spans for _, spans in windows) else None


def spans_of(model: dict | None, texts: list[str]) -> Iterator[tuple[list, list]]:
    """(pattern spans, all spans) of each text."""
    extra = tagged_spans(model, texts) if model else [[] for _ in texts]
    for t, more in zip(texts, extra):
        base = base_spans(t)
        yield base, merged(t, base, more)


def find(docs: DataFrame, model: dict | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the pattern counts by kind, the digest of the pattern spans and all spans of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            number, digest, spans = [[] for _ in KINDS], [], []
            for base, every in spans_of(shared.value, texts):
                for k, column in enumerate(number):
                    column.append(sum(s[0] == k for s in base))
                digest.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(every))
            columns = [batch.column("d"), *(pa.array(c, pa.int64()) for c in number), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_sha256", "spans"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, then the longest, names the gap."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; NULL stays NULL, other columns are untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = spans_of(shared.value, [t or "" for t in texts])
            out = [None if t is None else masked(t, every) for t, (_, every) in zip(texts, spans)]
            columns = [pa.array(out, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
