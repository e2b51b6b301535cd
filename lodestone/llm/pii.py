"""Personal data: exact patterns, and a character-level tagger for what they miss.

The tagger is a bidirectional LSTM with CRF transitions, written and trained in numpy from labelled spans.
It reads overlapping windows; each window is decoded by Viterbi, each character takes the tag of the
window in whose middle it lies, and spans are read off the tags of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches

#: Kinds that have an exact pattern, and those that the tagger knows.
KINDS = ("email", "ip", "card", "phone")
TAG_KINDS = (*KINDS, "secret")

# --- exact patterns; each scan is linear in the text -------------------------------------------------

LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
PART = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping. The local part ends at an @, so its longest run to the left is the
    leftmost start; looking from each @ avoids trying every start of a long run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_TAIL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots: consecutive fours of each longest dotted chain."""
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = list(PART.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or "0") <= 255 for p in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = only_digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m.group())) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}
TRIGGER = re.compile(r"[0-9@]")


def base_spans(text: str) -> list[Span]:
    """By start, then kind in the order of KINDS."""
    if not TRIGGER.search(text):
        return []
    found = [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the tagger ---------------------------------------------------------------------------------------

#: Window and its step in code points, hidden units of each direction, training examples and passes.
WINDOW, STEP, HIDDEN, EXAMPLES, PASSES = 64, 32, 16, 1600, 9
TAGS = 1 + 2 * len(TAG_KINDS)  # nothing; begin and inside of each kind
SYMBOLS = 100  # printable ASCII, then: other letters, white space, the rest


def encode(text: str) -> np.ndarray:
    """A symbol for each code point."""
    return _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


@lru_cache(1)
def _symbols() -> np.ndarray:
    out = np.full(0x110000, 97, np.uint8)
    out[32:127] = np.arange(1, 96)
    for k in range(128, 0x3000):
        if chr(k).isalpha():
            out[k] = 96
    out[[9, 10, 13]] = 98
    return out


def allowed() -> np.ndarray:
    """What may follow what: an inside tag only its own kind's begin or inside tag."""
    ok = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(TAG_KINDS)):
        ok[:, 2 + 2 * k] = -1e4
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = 0
    return ok


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps x rows x units) over symbols (rows x steps)."""
    n, steps = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out = np.zeros((steps, n, size), np.float32)
    for t in range(steps):
        z = table[x[:, t]] + h @ u
        gates, new = sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        before, old = c, h
        c = gates[:, size : 2 * size] * c + gates[:, :size] * new
        tc = np.tanh(c)
        h = gates[:, 2 * size :] * tc
        out[t] = h
        if keep is not None:
            keep.append((gates, new, before, tc, old))
    return out


def lstm_back(x: np.ndarray, u: np.ndarray, keep: list, dh_out: np.ndarray, d_table: np.ndarray, d_u: np.ndarray) -> None:
    size = u.shape[0]
    dh_next = np.zeros_like(dh_out[0])
    dc = np.zeros_like(dh_next)
    for t in range(len(keep) - 1, -1, -1):
        gates, new, before, tc, old = keep[t]
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        dh = dh_out[t] + dh_next
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        np.add.at(d_table, x[:, t], dz)
        d_u += old.T @ dz
        dh_next = dz @ u.T
        dc = dc * f


class Tagger:
    """BiLSTM-CRF; ``fit`` once, then ``tag``."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = {"t1": small(SYMBOLS, 4 * HIDDEN), "u1": small(HIDDEN, 4 * HIDDEN), "t2": small(SYMBOLS, 4 * HIDDEN), "u2": small(HIDDEN, 4 * HIDDEN), "w": small(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "a": np.zeros((TAGS, TAGS), np.float32)}
        for t in ("t1", "t2"):
            self.p[t][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
        self.mask = allowed()

    def emissions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        p, k = self.p, keep or (None, None)
        h = np.concatenate([lstm(x, p["t1"], p["u1"], k[0]), lstm(x[:, ::-1], p["t2"], p["u2"], k[1])[::-1]], axis=2)
        return h @ p["w"] + p["b"], h

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the CRF's negative log-likelihood, a row's mean."""
        p, keep = self.p, ([], [])
        e, h = self.emissions(x, keep)
        steps, n, _ = e.shape
        trans = p["a"] + self.mask
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.mask[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        da = np.zeros_like(p["a"])
        for t in range(1, steps):
            da += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(da, (y[:, t - 1], y[:, t]), -1)
        de[np.arange(steps)[:, None], np.arange(n)[None, :], y.T] -= 1
        de, da = de / n, da / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["a"], g["b"] = da, de.sum((0, 1))
        g["w"] = h.reshape(-1, h.shape[2]).T @ de.reshape(-1, TAGS)
        dh = de @ p["w"].T
        lstm_back(x, p["u1"], keep[0], dh[:, :, :HIDDEN], g["t1"], g["u1"])
        lstm_back(x[:, ::-1], p["u2"], keep[1], dh[::-1, :, HIDDEN:], g["t2"], g["u2"])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, batch: int = 32, rate: float = 0.02, seed: int = 4) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, total = 0, passes * -(-len(x) // batch)
        for _ in range(passes):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                pick = order[k : k + batch]
                step += 1
                for name, g in self.gradients(x[pick], y[pick]).items():
                    g = np.clip(g, -1, 1)
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    self.p[name] -= rate * (1 - step / (total + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
        return self

    def tag(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """Viterbi tags (rows x steps)."""
        out = np.zeros(x.shape, np.int8)
        trans = self.p["a"] + self.mask
        for k in range(0, len(x), block):
            e, _ = self.emissions(x[k : k + block])
            score = e[0] + self.mask[0]
            back = np.zeros(e.shape, np.int8)
            for t in range(1, len(e)):
                ways = score[:, :, None] + trans
                back[t] = ways.argmax(1)
                score = ways.max(1) + e[t]
            best = score.argmax(1)
            rows = np.arange(len(best))
            for t in range(len(e) - 1, -1, -1):
                out[k : k + block, t] = best
                best = back[t, rows, best]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def labelled_examples(n: int = EXAMPLES, seed: int = 9) -> list[tuple[str, list[Span]]]:
    """Windows of made-up prose with labelled spans in usual and unusual spellings, and with numbers,
    dates, versions, keys and prices that are not personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = "etaoinshrdlucmfwypvbgkqjxzéüñ"
    word = lambda: "".join(letters[int(k)] for k in rng.geometric(0.12, int(rng.integers(1, 10))) % len(letters))

    def email():
        local = pick([word, lambda: word() + "." + word(), lambda: word() + digits(2), lambda: word() + "." + digits(2)])()
        host = pick([word, lambda: "mail" + digits(1) + "." + word(), lambda: word() + "." + word()])()
        return local + pick(["@", "@", "@", " @ ", "(@)", "[@]"]) + host + pick([".com", ".org", ".net", ".fr", ".co.uk"])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"+{digits(2)}-{a}-{b}-{c}", f"+{digits(2)}{a}{b}{c}"])

    def card():
        body = pick("3456") + digits(14)
        body += next(k for k in "0123456789" if luhn(body + k))
        gap = pick(["", "", " ", "-", ".", "  ", "_"])
        return gap.join(body[k : k + 4] for k in range(0, 16, 4))

    def ip():
        return pick([".", ".", ".", ". ", " . "]).join(str(int(k)) for k in rng.integers(0, 256, 4))

    def secret():
        of = pick(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"])
        return "".join(pick(of) for _ in range(int(rng.integers(20, 49))))

    makers = dict(zip(TAG_KINDS, (email, ip, card, phone, secret), strict=True))
    before_secret = ['token = "', 'api_key: ', "secret='", 'TOKEN = "', "password ", 'key="', "bearer ", "token "]
    others = [
        lambda: digits(int(rng.integers(1, 13))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"version {digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: 'token = "' + word() + '"', lambda: digits(16), lambda: digits(int(rng.integers(24, 48))), lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}",
        lambda: f"{digits(3)} {digits(3)}", lambda: "CC BY-NC 4.0", lambda: f"{digits(2)}% | {digits(3)} |", lambda: digits(20), lambda: f"{word()}{digits(3)}", lambda: f"({digits(4)})",
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 12)))), []
        for _ in range(int(rng.integers(1, 3))):
            text += pick([" ", " ", ", ", ": ", "\n", " ("])
            if rng.random() < 0.6:
                kind = pick(TAG_KINDS)
                body = makers[kind]()
                if kind == "secret":
                    text += pick(before_secret)
                spans.append((kind, len(text), len(text) + len(body)))
            else:
                body = pick(others)()
            text += body + pick([" ", " ", ". ", ", ", ") ", "\n"]) + " ".join(word() for _ in range(int(rng.integers(0, 6))))
        out.append((text, spans))
    return out


def windows_of(examples: list[tuple[str, list[Span]]], seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of one window of each example, cut anywhere."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((len(examples), WINDOW), np.uint8), np.zeros((len(examples), WINDOW), np.int64)
    for row, (text, spans) in enumerate(examples):
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * TAG_KINDS.index(kind)
            tags[a] -= 1
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        part = tags[cut : cut + WINDOW].copy()
        if len(part) and part[0] and part[0] % 2 == 0:
            part[0] -= 1  # a span cut at the window's edge begins there
        x[row, : len(part)] = encode(text)[cut : cut + WINDOW]
        y[row, : len(part)] = part
    return x, y


@lru_cache(1)
def trained() -> bytes:
    """Parameters of the fitted tagger. Fitted once in the driver; seeds and sizes are fixed."""
    tagger = Tagger().fit(*windows_of(labelled_examples()))
    return b"".join(tagger.p[k].tobytes() for k in sorted(tagger.p))


@lru_cache(2)
def restored(data: bytes) -> Tagger:
    tagger, at = Tagger(), 0
    for k in sorted(tagger.p):
        size = tagger.p[k].nbytes
        tagger.p[k] = np.frombuffer(data[at : at + size], np.float32).reshape(tagger.p[k].shape)
        at += size
    return tagger


SECRET = re.compile(r"[A-Za-z0-9_+/=.-]+")


def plausible(kind: str, body: str) -> bool:
    """What a tagged span must hold to be reported; every kind holds a digit or an @."""
    digits = only_digits(body)
    if kind == "email":
        return body.count("@") == 1 and "." in body.partition("@")[2].strip(" .)]") and len(body.partition("@")[0].strip(" ([")) > 0
    if kind == "ip":
        parts = PART.findall(body)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "secret":
        return len(body) >= 16 and SECRET.fullmatch(body) is not None and len(digits) >= 3 and len(digits) < len(body) - 2
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(digits) < len(body)


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans that the tagger finds in each text, as if it read all windows.

    Every plausible span holds a digit or an @, so reading begins with the windows around those. Where
    the tags known end inside a span, further windows are read, each time twice as many, until the ends
    of all spans are seen."""
    codes: dict[int, np.ndarray] = {}
    known: dict[int, dict[int, np.ndarray]] = {}  # of each text the tags in the middle of each window
    todo: list[tuple[int, int]] = []
    ends = [max(0, -(-len(text) // STEP) - 2) for text in texts]  # the windows that reach the texts' ends
    ahead = 1
    for k, text in enumerate(texts):
        hot = {min(max(i, 0), ends[k]) for m in TRIGGER.finditer(text) for i in (m.start() // STEP - 1, m.start() // STEP)}
        todo += [(k, i) for i in sorted(hot)]
    quarter = (WINDOW - STEP) // 2
    while todo:
        rows = np.zeros((len(todo), WINDOW), np.uint8)
        for row, (k, i) in zip(rows, todo, strict=True):
            if k not in codes:
                codes[k] = encode(texts[k])
            part = codes[k][i * STEP : i * STEP + WINDOW]
            row[: len(part)] = part
        for row, (k, i) in zip(tagger.tag(rows), todo, strict=True):
            size = min(len(texts[k]) - i * STEP, WINDOW)
            known.setdefault(k, {})[i] = row[0 if i == 0 else quarter : size if i == ends[k] else WINDOW - quarter]
        more: set[tuple[int, int]] = set()
        for k, i in todo:
            if known[k][i][0]:
                more.update((k, j) for j in range(max(0, i - ahead), i) if j not in known[k])
            if known[k][i][-1]:
                more.update((k, j) for j in range(i + 1, min(ends[k], i + ahead) + 1) if j not in known[k])
        todo, ahead = sorted(more), 2 * ahead
    out: list[list[Span]] = [[] for _ in texts]
    at = {k: [(i * STEP + (quarter if i else 0), part) for i, part in of.items()] for k, of in known.items()}
    for k, parts in at.items():
        found: list[Span] = []
        begun: tuple[int, int] | None = None  # kind, start
        end = -1
        for start, part in sorted(parts, key=lambda p: p[0]):
            for i, tag in enumerate(part.tolist(), start):
                if i < end:
                    continue
                kind = (tag - 1) // 2 if tag else -1
                if begun and (i != end or kind != begun[0] or tag % 2 == 1):
                    found.append((TAG_KINDS[begun[0]], begun[1], end))
                    begun = None
                if tag and begun is None:
                    begun = (kind, i)
                end = i + 1
        if begun:
            found.append((TAG_KINDS[begun[0]], begun[1], end))
        for kind, a, b in found:
            while a < b and texts[k][a] in " \t\r\n,;:\"'":
                a += 1
            while a < b and texts[k][b - 1] in " \t\r\n,;:.\"'":
                b -= 1
            if plausible(kind, texts[k][a:b]):
                out[k].append((kind, a, b))
    return out


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    """All base spans, and those of ``more`` that touch none of them."""
    ends = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in ends]
    reach = np.maximum.accumulate([b for _, b in ends]).tolist() if ends else []
    out = list(base)
    for kind, a, b in more:
        k = bisect_left(starts, b)
        if not k or reach[k - 1] <= a:
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], TAG_KINDS.index(s[0]), s[2]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): two arrays of (kind, start, end), code points, end exclusive.

    ``base`` are the matches of the exact patterns, ``spans`` those and what the tagger adds: unusual
    spellings of the four kinds, and of kind ``secret`` keys and tokens, which no pattern tells. Null and
    empty texts have none. Rows are independent: repeated rows get equal answers, null ids are carried
    through, other columns are not read, an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    rows_of = lambda found: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = restored(shared.value)
        for part in parts:
            texts = [x or "" for x in part.column("text").to_pylist()]
            base = [base_spans(x) for x in texts]
            found = [merged(b, m) for b, m in zip(base, tagged_spans(tagger, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), rows_of(base), rows_of(found)], [id_col, "base", "spans"])

    batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, base {span}, spans {span}")


def _is(value: str):
    return lambda x: x == value


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; counts and digest are those of the exact patterns."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def brute_force(text: str) -> str:
    """Digest of the base spans by plain regular expressions, for small inputs."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 14 <= len(only_digits(s)) <= 19 and luhn(only_digits(s)),
        "phone": lambda s: 10 <= len(only_digits(s)) <= 15,
    }
    found = [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(patterns[k], text) if keep[k](m.group())]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
