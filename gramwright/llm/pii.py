"""Personal data: exact patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field labels the words of every line by
their shapes and those of their neighbours; its weights are trained from the
small labelled table that `examples` makes, and lines are decoded together by
Viterbi, a step of numpy for all lines' n-th words at once. Its spans are added
where they touch no base span: credentials, which no pattern covers, and
numbers or addresses written in ways that the patterns miss.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BYTE_VALUE, WHITE, mix, slices, word_table

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# The patterns of the base spans.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits: looking there only would cost the square of the run's length
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in found.split("."))


def is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Walks from @ to @, so that long runs of letters cost nothing extra."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in EMAIL_NAME:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m.group())]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m.group())]
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -------------------------------------------------------------

FEATURES = 1 << 13
_TRIM = "\"'()[]{}<>,;:.!?"
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("d")
_CLASS[0x41:0x5B] = ord("X")
_CLASS[0x61:0x7B] = ord("x")
_CLASS[0x80:] = ord("x")


def words_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Features of every word (5 hashed columns), the text it is in, its first
    and end byte there, and the line it is in (numbered over all texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashed, owner, start, end = word_table(texts, WHITE)
    if not len(owner):
        return np.zeros((0, 5), np.int32), owner, start, end, owner
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[owner]
    first, last = begin + start, begin + end
    line = np.cumsum(buf == 10)[first]
    # shape: classes of bytes, runs of a class once; mixed hex is told by its runs' length
    kind = _CLASS[buf]
    kept = np.ones(len(buf), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[first] = True
    inside = ~WHITE[buf]
    at = np.flatnonzero(kept & inside)
    word = np.searchsorted(first, at, side="right") - 1
    lead = np.searchsorted(at, first)
    place = np.arange(len(at)) - lead[word]
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    count = np.bincount(word, minlength=len(first))
    shape = mix(np.add.reduceat(BYTE_VALUE[kind[at]] * power[place], lead) + count.astype(np.uint64))
    size = np.searchsorted([2, 4, 7, 10, 14, 20, 32], last - first, side="right").astype(np.uint64)
    digits = np.add.reduceat(((buf >= 0x30) & (buf < 0x3A)).astype(np.int64), first)
    whole = np.searchsorted([1, 2, 4, 7, 10, 14], digits, side="right").astype(np.uint64)
    same = line[1:] == line[:-1]
    none = np.uint64(0)
    before = np.concatenate([[none], np.where(same, shape[:-1], none)])
    after = np.concatenate([np.where(same, shape[1:], none), [none]])
    name = np.concatenate([[none], np.where(same, hashed[:-1], none)])
    columns = (shape, mix(size * np.uint64(31) + whole + np.uint64(5)), mix(before + np.uint64(1)) ^ shape, mix(after + np.uint64(2)) ^ shape, mix(name + np.uint64(3)))
    salted = [(mix(c + np.uint64(k)) >> np.uint64(51)).astype(np.int32) for k, c in enumerate(columns)]
    return np.stack(salted, 1), owner, start, end, line


@dataclass
class Field:
    weight: np.ndarray  # features x labels
    move: np.ndarray  # from label x to label
    start: np.ndarray

    def decode(self, feature: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Best label of each word, by Viterbi over all lines at once."""
        n = len(line)
        if not n:
            return np.zeros(0, np.int8)
        emit = self.weight[feature[:, 0]]
        for k in range(1, feature.shape[1]):
            emit = emit + self.weight[feature[:, k]]
        first = np.flatnonzero(np.diff(line, prepend=line[0] - 1))
        length = np.diff(first, append=n)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros((n, len(LABELS)), np.int8)
        score = emit[first] + self.start
        final = np.zeros((len(first), len(LABELS)), np.float32)
        going = len(first)
        for t in range(1, int(length[0]) + 1):
            still = int(np.searchsorted(-length, -t, side="left"))  # lines with more than t words
            final[still:going] = score[still:going]
            going = still
            if not going:
                break
            step = score[:going, :, None] + self.move
            at = first[:going] + t
            back[at] = step.argmax(1)
            score = step.max(1) + emit[at]
        label = np.zeros(n, np.int8)
        now = final.argmax(1).astype(np.int8)
        for t in range(int(length[0]) - 1, -1, -1):
            here = int(np.searchsorted(-length, -t, side="left"))
            at = first[:here] + t
            label[at] = now[:here]
            now[:here] = back[at, now[:here]]
        return label


def _valid(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def _grouped(digits: str, sign: str) -> str:
    return sign.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def examples(n: int = 400, seed: int = 11) -> list[tuple[str, list[tuple[str, str]]]]:
    """The labelled table: lines of made-up words with values of each kind among
    them, and look-alikes that are none (prices, dates, versions, hashes of few
    signs). Returns (line, [(kind, value)])."""
    r = random.Random(seed)
    syllables = "re ti on er an st ed lo ma vi ça né schö ung ción que ñe".split()

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return w.capitalize() + r.choice(["", ",", "."]) if r.random() < 0.2 else w + r.choice(["", "", "", ",", ".", "|", "!!", "%%%", "***", "###", "&&&", "$$$"])

    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    plain = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    make = {
        "email": lambda: f"{plain(r.randint(3, 9))}{r.choice(['.', '_', ''])}{num(2)}@{plain(5)}{num(1)}.{plain(7)}.com",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: _grouped(_valid(num(15)), r.choice(["", " ", "-"])),
        "phone": lambda: r.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}"]),
        "secret": lambda: r.choice(['token = "{}"', "token = {}", "password = {}", 'key = "{}"']).format(hexa(r.choice([32, 40, 64]))),
    }
    other = [lambda: num(r.randint(1, 4)), lambda: f"{num(2)}.{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"${num(3)}", lambda: f"v{num(1)}.{num(1)}", lambda: f"{num(2)}%", lambda: "|", lambda: "=", lambda: '"' + word() + '"', lambda: f"{num(1)},{num(3)}"]
    out = []
    for _ in range(n):
        words: list[str] = []
        values: list[tuple[str, str]] = []
        for _ in range(r.randint(3, 14)):
            x = r.random()
            if x < 0.12:
                kind = r.choice(KINDS)
                value = make[kind]()
                words.append(value)
                values.append((kind, value.rpartition(" = ")[2] if kind == "secret" else value))
            else:
                words.append(r.choice(other)() if x < 0.2 else word())
        out.append((" ".join(words), values))
    return out


def train(rows: list[tuple[str, list[tuple[str, str]]]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximises the likelihood of the table's labels: gradients by forward and
    backward sums over lines padded to one length, steps by adaptive moments."""
    feature, owner, start, end, _ = words_of([t.encode() for t, _ in rows])
    gold = np.zeros(len(owner), np.int64)
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    for k, (text, values) in enumerate(rows):
        at = 0
        for kind, value in values:
            a = text.index(value, at)
            at = a + len(value)
            lo, hi = len(text[:a].encode()), len(text[:at].encode())
            inside = (start[first[k] : first[k + 1]] < hi) & (end[first[k] : first[k + 1]] > lo)
            gold[first[k] : first[k + 1]][inside] = LABELS.index(kind)
    n, length, m = len(rows), np.diff(first), len(LABELS)
    longest = int(length.max(initial=1))
    mask = np.arange(longest) < length[:, None]
    pad = np.zeros((n, longest, feature.shape[1]), np.int64)
    want = np.zeros((n, longest), np.int64)
    pad[mask], want[mask] = feature, gold
    one = np.eye(m)[want] * mask[..., None]
    pairs = np.einsum("ntu,ntv->uv", one[:, :-1], one[:, 1:])
    params = [np.zeros((FEATURES, m)), np.zeros((m, m)), np.zeros(m)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    add = lambda x: np.logaddexp.reduce(x, axis=1)
    for t in range(1, rounds + 1):
        weight, move, begin = params
        emit = weight[pad].sum(2)
        ahead, behind = np.zeros((n, longest, m)), np.zeros((n, longest, m))
        ahead[:, 0] = emit[:, 0] + begin
        for k in range(1, longest):
            step = add(ahead[:, k - 1, :, None] + move) + emit[:, k]
            ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move + (emit[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            behind[:, k] = np.where(mask[:, k + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        prob = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        over = one - prob
        g = [np.zeros((FEATURES, m)), pairs.copy(), over[:, 0].sum(0)]
        for k in range(pad.shape[2]):
            np.add.at(g[0], pad[..., k][mask], over[mask])
        for k in range(1, longest):
            both = np.exp(ahead[:, k - 1, :, None] + move + (emit[:, k] + behind[:, k])[:, None, :] - total[:, None, None])
            g[1] -= (both * mask[:, k, None, None]).sum(0)
        for k, p in enumerate(params):
            grad = g[k] / n - decay * p
            mean[k] = 0.9 * mean[k] + 0.1 * grad
            square[k] = 0.99 * square[k] + 0.01 * grad * grad
            params[k] = p + rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    return Field(*(p.astype(np.float32) for p in params))


@lru_cache(1)
def default_field() -> Field:
    return train(examples())


def _values(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Where the values are in a run of words with one label, without the signs
    around them. Cards and addresses are held to their kind's own rule, and words
    side by side may be several of them: the shortest that fit, from the left."""
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    trimmed = []
    for a, b in words:
        inner = text[a:b].lstrip(_TRIM)
        a = b - len(inner)
        trimmed.append((a, a + len(inner.rstrip(_TRIM))))
    if kind not in ("ip", "card"):
        if trimmed[0][0] < trimmed[-1][1]:
            yield trimmed[0][0], trimmed[-1][1]
        return
    shape, holds = (IP, is_ip) if kind == "ip" else (CARD, is_card)
    k = 0
    while k < len(trimmed):
        a, step = trimmed[k][0], 1
        for j in range(k, min(k + 19, len(trimmed))):  # a card has 19 digits at most, a word one at least
            found = text[a : trimmed[j][1]]
            if shape.fullmatch(found) and holds(found):
                yield a, trimmed[j][1]
                step = j - k + 1
                break
            if kind == "ip" or len(found) > 40:
                break
        k += step


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds in each text: values (_values) in words of one
    label in a row, in one line."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, hi in slices(raw):
        feature, owner, start, end, line = words_of(raw[lo:hi])
        label = field.decode(feature, line)
        found = np.flatnonzero(label)
        if not len(found):
            continue
        new = np.ones(len(found), bool)
        new[1:] = (np.diff(found) != 1) | (label[found[1:]] != label[found[:-1]]) | (line[found[1:]] != line[found[:-1]])
        group = np.flatnonzero(new)
        text, done, left = -1, 0, 0
        for a, b in zip(found[group], found[np.append(group[1:], len(found)) - 1], strict=True):
            k = lo + int(owner[a])
            if k != text:
                text, done, left = k, 0, 0
            # code points up to here, counted from the run before
            left += len(raw[k][done : start[a]].decode("utf-8", "surrogatepass"))
            done = start[a]
            kind = int(label[a]) - 1
            out[k] += [(left + x, kind, left + y) for x, y in _values(raw[k][start[a] : end[b]].decode("utf-8", "surrogatepass"), KINDS[kind])]
    return out


def merge(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All base spans, and those others that touch none of them."""
    out, k = list(base), 0
    reach = []
    for a, _, b in base:
        reach.append((a, max(b, reach[-1][1] if reach else 0)))
    for a, kind, b in sorted(more):
        while k < len(reach) and reach[k][1] <= a:
            k += 1
        if k == len(reach) or reach[k][0] >= b:
            out.append((a, kind, b))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts of base spans, their digest, and all spans, a row per document.

    Null and empty texts have no spans. A null doc_id stays null; rows with the
    same doc_id are judged one by one. Offsets count code points. Other columns
    are ignored. Nothing is shuffled.
    """
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [merge(b, m) for b, m in zip(base, field_spans(texts, model), strict=True)]
            counts = [[sum(1 for s in b if s[1] == k) for b in base] for k in range(4)]
            digest = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array([written(e) for e in every], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return common.map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def op4(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
