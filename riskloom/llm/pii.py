"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

The field scores a segmentation of a token sequence: each entity segment of at most ``MOST_TOKENS`` tokens gets the weights
of its type's whole-span features (the shape of all its characters, digit groups, checksums, what stands around it), each
token outside scores 0. Dynamic programming over segment ends picks boundaries and types jointly. Weights maximise the
conditional likelihood of labelled sentences, made by rule with a fixed seed: spans of every type in running words, next to
look-alikes (versions, dates, prices, identifiers) that are no personal data.

An entity holds a digit, an @ or a bracketed "at", so a text is decoded in windows of tokens around those, each with all the
characters an entity can have there and the tokens before it that count as cues; windows that touch are one. Outside them every
token is outside any entity, which makes the windows' decodings that of the whole text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices

TYPES = ("email", "ip", "card", "phone", "id", "iban")
MOST_TOKENS, MOST_CHARS = 16, 64
#: Tokens before a segment whose words count as its cues.
CUE_TOKENS = 4
SEED = 11
SENTENCES = 500
ROUNDS = 10

# The base patterns and their kinds in order.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


_DOUBLED = {str(d): d * 2 - 9 * (d > 4) for d in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(_DOUBLED.__getitem__, digits[-2::-2]))) % 10 == 0


_NO_DIGITS = re.compile(r"[^0-9]+")


def _digits(text: str) -> str:
    return _NO_DIGITS.sub("", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of kind, end) of the base matches, in order. Each pattern runs in time linear in the text: e-mail
    matches are sought from their @, as the leftmost start is that of the run before it."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0") or "0") <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- tokens, candidates and features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]", re.ASCII)
#: What stands between the two sides of an address; an entity holds one at most.
_AT = re.compile(r"@|\[[Aa][Tt]\]|\([Aa][Tt]\)")
_TRIGGER = re.compile(r"[0-9@]|[\[(][Aa][Tt][\])]")
_CUES = {
    "email": "mail email contact write reach",
    "ip": "ip host server address login",
    "card": "card visa mastercard credit payment pay",
    "phone": "phone tel telephone call mobile fax cell",
    "id": "ssn social security passport national id",
    "iban": "iban account bank transfer wire",
}
_CUE_OF = {w: kind for kind, words in _CUES.items() for w in words.split()}


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def _shape(text: str) -> str:
    """Digits as 9, letters as a, each run with its length up to 5, blanks as one, the rest as it is."""
    out = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", re.sub(r"[^\W\d_]+", lambda m: f"a{min(len(m[0]), 5)}", text))
    return re.sub(r"\s+", " ", out)[:40]


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Features of the segment of tokens i to j - 1; None if it can't be an entity: without enough digits or an @, or
    with ends that an entity never has, in the middle of a word or number among them."""
    a, b = tokens[i][0], tokens[j - 1][1]
    span = text[a:b]
    at = "@" in span or "[at]" in span.lower() or "(at)" in span.lower()
    digits = _digits(span)
    if not at and len(digits) < 7 or b - a > MOST_CHARS or "\n" in span:
        return None
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        return None
    before, after = text[a - 1 : a], text[b : b + 1]
    words = [text[x:y].lower() for x, y in tokens[max(0, i - CUE_TOKENS) : i]]
    groups = re.findall(r"[0-9]+", span)
    if before.isalnum() or after.isalnum():
        return None
    out = ["bias", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 6)}", f"shape={_shape(span)}"]
    out += [f"cue={kind}" for kind in sorted({_CUE_OF[w] for w in words if w in _CUE_OF})]
    out += [f"first={'9' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}", f"signs={''.join(sorted(set(re.sub(r'[\w\s]', '', span))))[:6]}"]
    if before in "-./,:#$€£%_" and before or after in "-/%_$€£" and after:
        out.append("sign beside")
    if after in (".", "-", "@") and after and text[b + 1 : b + 2].isalnum():
        out.append(f"goes on {after}")
    if before in (".", "-", "@") and before and text[a - 2 : a - 1].isalnum():
        out.append(f"goes before {before}")
    if at:
        parts = re.split(r"@|\s*[\[(]at[\])]\s*", span, flags=re.I)
        out += ["at", f"at parts={len(parts)}", f"words left={len(parts[0].split())}", f"dot after={bool(re.search(r'\.|[\[(]dot[\])]', parts[-1], re.I))}", f"blank in={' ' in span and '[' not in span and '(' not in span}"]
    else:
        letters = sum(map(str.isalpha, span))
        out += [f"luhn={len(digits) >= 13 and luhn(digits)}", f"letters={min(letters, 6)}"]
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}", span):
            out.append(f"iban={_iban(span)}")
        if len(groups) == 4 and span.count(".") == 3:
            out.append(f"octets={all(int(g) <= 255 for g in groups if len(g) < 5)}")
    return out


def _iban(span: str) -> bool:
    plain = span.replace(" ", "").upper()
    if not plain.isascii() or not plain.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """Segments that may be an entity, with their features. Which tokens may begin or end one, and how many digits and at-signs a
    stretch of them holds, is known beforehand, so that features are made only for segments with both ends and something inside."""
    n = len(tokens)
    begins = [(text[a].isalnum() or text[a] in "+(") and not text[a - 1 : a].isalnum() for a, _ in tokens]
    ends = [text[b - 1].isalnum() and not text[b : b + 1].isalnum() for _, b in tokens]
    digits = [0]
    for a, b in tokens:
        digits.append(digits[-1] + (b - a if "0" <= text[a] <= "9" else 0))
    # At-signs that lie in a segment: those that end by its end, less those that begin before its start.
    signs = [m.span() for m in _AT.finditer(text, tokens[0][0], tokens[-1][1])] if tokens else []
    ended = np.searchsorted([e for _, e in signs], [b for _, b in tokens], "right").tolist()
    begun = np.searchsorted([s for s, _ in signs], [a for a, _ in tokens], "left").tolist()
    out = []
    for i in range(n):
        if not begins[i]:
            continue
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if tokens[j - 1][1] - tokens[i][0] > MOST_CHARS or ended[j - 1] - begun[i] > 1 or j > i + 1 and "\n" in text[tokens[j - 2][1] : tokens[j - 1][0]]:
                break
            if ends[j - 1] and (ended[j - 1] > begun[i] or digits[j] - digits[i] >= 7) and (f := features(text, tokens, i, j)):
                out.append((i, j, f))
    return out


# -- training

_WORDS = "the of and to in on for with that from this was are it by at be as is an order report meeting when where about after please team project city garden window paper green light river call number version total page since until".split()


def _luhn_number(rng: random.Random, n: int) -> str:
    body = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _example(rng: random.Random) -> tuple[str, str | None]:
    """A span and its type, or a look-alike and None."""
    d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    kind = rng.choice([*TYPES, *[None] * 6])
    if kind == "email":
        user, host = rng.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}.{d(2)}"]), f"{word()}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        host = rng.choice([host, f"{word()}{d(1)}.{host}"])
        return rng.choice([f"{user}@{host}", f"{user}@{host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} (at) {host}", f"{user}[at]{host}"]), kind
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4)), kind
    if kind == "card":
        n = _luhn_number(rng, rng.choice([14, 15, 16, 16, 16, 19]))
        return rng.choice([n, " ".join(n[k : k + 4] for k in range(0, len(n), 4)), "-".join(n[k : k + 4] for k in range(0, len(n), 4)), ".".join(n[k : k + 4] for k in range(0, len(n), 4))]), kind
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 99)} {d(3)} {d(7)}", f"+{rng.randint(20, 99)}{d(9)}", f"1-{a}-{b}-{c}", f"+1-{a}-{b}-{c}"]), kind
    if kind == "id":
        return rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}"]), kind
    if kind == "iban":
        country, body = rng.choice(["DE", "FR", "ES", "NL", "GB"]), d(rng.choice([14, 18, 20]))
        letter = lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        body = rng.choice([body, body, "".join(letter() for _ in range(4)) + d(rng.choice([10, 14])), d(15) + letter() + d(7)])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        plain = f"{country}{check:02d}{body}"
        return rng.choice([plain, " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))]), kind
    return rng.choice([
        f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(3)}",
        f"${rng.randint(1, 999)},{d(3)}.{d(2)}", f"#{d(8)}", f"{d(7)}", f"{d(8)}", f"{d(9)}", f"{d(10)}", f"{d(12)}", f"{d(5)}.{d(6)}", f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.{d(2)}.{d(2)}", f"{word()}@{word()}", f"@{word()}{d(4)}", f"{d(16)}", f"{word()}{d(9)}{word()}", f"{d(4)} {d(4)}", f"{d(3)} {d(4)}",
        f"{rng.randint(1990, 2030)}-{rng.randint(1990, 2030)}", f"{d(4)}/{d(4)}/{d(4)}", f"{d(1)},{d(3)},{d(3)}", f"{d(6)}-{d(6)}", f"{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(3)}.{d(4)}.{d(1)}",
    ]), None


def labelled_sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans (start, end, type)), the same for a seed."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(rng.choice(_WORDS) for _ in range(rng.randint(0, 5))) + " "
            span, kind = _example(rng)
            if rng.random() < 0.4:
                text += rng.choice((_CUES[kind] if kind else "version date price total order page").split()) + rng.choice([" ", ": "])
            if kind:
                spans.append((len(text), len(text) + len(span), kind))
            text += span + rng.choice([" ", ". ", ", ", "; ", " "])
        out.append((text + rng.choice(_WORDS), spans))
    return out


class SemiCrf:
    """Weights by feature and type; ``fit`` and ``decode`` share the candidates above."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def _scores(self, found: list[tuple[int, int, list[str]]]) -> list[np.ndarray]:
        return [self.weights[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for *_, fs in found]

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities, (start, end, type) in characters."""
        found = candidates(text, tokens)
        if not found:
            return []
        ends: dict[int, list[tuple[int, float, int]]] = {}
        for (i, j, _), s in zip(found, self._scores(found), strict=True):
            k = int(np.argmax(s))
            if s[k] > 0:
                ends.setdefault(j, []).append((i, float(s[k]), k))
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for i, s, k in ends.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((tokens[i][0], tokens[j - 1][1], TYPES[k]))
                j = i
            else:
                j -= 1
        return out[::-1]


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top if len(logs) == 1 else top + math.log(sum(math.exp(x - top) for x in logs))


@lru_cache(maxsize=4)
def fit(sentences: int = SENTENCES, seed: int = SEED, rounds: int = ROUNDS, rate: float = 0.5, ridge: float = 1e-3) -> SemiCrf:
    """Stochastic gradient ascent (adaptive steps) on the conditional log-likelihood, by forward and backward sums over
    segments. The same weights for the same parameters."""
    data, names = [], {}
    for text, spans in labelled_sentences(sentences, seed):
        tokens = tokens_of(text, 0, len(text))
        gold = {(a, b): TYPES.index(k) for a, b, k in spans}
        found = [(i, j, np.array([names.setdefault(f, len(names)) for f in fs])) for i, j, fs in candidates(text, tokens)]
        data.append((len(tokens), found, [gold.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j, _ in found]))
    firsts = [np.cumsum([0, *(len(f) for *_, f in found)])[:-1] for _, found, _ in data]
    weights = np.zeros((len(names), len(TYPES)))
    squares = np.full_like(weights, 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            n, found, gold = data[k]
            if not found:
                continue
            scores = np.add.reduceat(weights[np.concatenate([f for *_, f in found])], firsts[k], axis=0)
            forward, backward = [-np.inf] * (n + 1), [-np.inf] * (n + 1)
            forward[0] = backward[n] = 0.0
            whole = np.logaddexp.reduce(scores, axis=1).tolist()
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for c, (i, j, _) in enumerate(found):
                by_end.setdefault(j, []).append(c)
                by_start.setdefault(i, []).append(c)
            for j in range(1, n + 1):
                forward[j] = _log_sum([forward[j - 1], *(forward[found[c][0]] + whole[c] for c in by_end.get(j, ()))])
            for i in range(n - 1, -1, -1):
                backward[i] = _log_sum([backward[i + 1], *(backward[found[c][1]] + whole[c] for c in by_start.get(i, ()))])
            around = np.array([forward[i] + backward[j] - forward[n] for i, j, _ in found])
            slopes = -np.exp(np.minimum(0.0, scores + around[:, None]))
            marked = np.flatnonzero(np.array(gold) >= 0)
            slopes[marked, np.array(gold)[marked]] += 1.0
            for c in np.flatnonzero(np.abs(slopes).max(axis=1) > 1e-4).tolist():
                f = found[c][2]
                step = slopes[c] - ridge * weights[f]
                squares[f] += step * step
                weights[f] += rate * step / np.sqrt(squares[f])
    return SemiCrf(names, weights)


def _context(text: str, a: int, last: int) -> int:
    """The start of what an entity from ``a`` on needs to its left: the rest of its first word and CUE_TOKENS tokens before
    it. At ``last`` or below the search ends, as the window before goes on there."""
    least = max(last, 0)
    for _ in range(CUE_TOKENS + 1):
        while a > least and text[a - 1].isspace():
            a -= 1
        if a > least and not text[a - 1].isalnum():
            a -= 1
            continue
        while a > least and text[a - 1].isalnum():
            a -= 1
    return a


def crf_spans(text: str, model: SemiCrf) -> list[tuple[int, int, str]]:
    """Entities of a whole text, decoded in windows of tokens around what every entity holds."""
    windows: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        high = min(m.start() + MOST_CHARS, len(text))
        last = windows[-1][1] if windows else -1
        low = _context(text, max(m.start() - MOST_CHARS, 0), last)
        if low <= last:
            windows[-1] = (windows[-1][0], high)
        else:
            windows.append((low, high))
    out = []
    for a, b in windows:
        out += model.decode(text, tokens_of(text, a, b))
    return out


def find(text: str | None, model: SemiCrf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """Base spans, and all spans (start, place of kind, end, kind) with those of the model that overlap no base span."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    every = [(a, k, b, KINDS[k]) for a, k, b in base]
    starts = np.array([a for a, _, _ in base])
    tops = np.maximum.accumulate([b for *_, b in base]) if base else np.zeros(0)
    for a, b, kind in crf_spans(text, model):
        before = int(np.searchsorted(starts, b, "left"))
        if not before or tops[before - 1] <= a:
            every.append((a, TYPES.index(kind), b, kind))
    return base, sorted(every)


def scan(docs: DataFrame, model: SemiCrf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end of
    base and added spans by start, then kind), n_added.

    Null texts count as empty. Positions are code points, ends exclusive. Repeated rows are each scanned; null ids pass
    through; other columns are ignored; an empty table gives no rows.
    """
    model = model or fit()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            found = [find(t, model) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            shas = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest() for base, _ in found]
            spans = [",".join(f"{name}:{a}:{b}" for a, _, b, name in every) for _, every in found]
            added = [len(every) - len(base) for base, every in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(shas), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
