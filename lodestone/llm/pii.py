"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans.  The field is trained here from a small labelled table (EXAMPLES) by gradient ascent on
the exact conditional log-likelihood, and decoded by Viterbi over numpy batches of token windows.  It adds spans that the
patterns miss (local phone numbers, spelled-out addresses, split addresses); base spans always stay.  Only tokens within
WINDOW tokens of a digit or an at sign are decoded: the field never labels others, since each of its spans has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Tokens decoded on each side of a trigger, windows decoded at once, and tokens of each that are scored at once.
WINDOW, BATCH, BLOCK = 6, 512, 256

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Addresses, leftmost first.  A local part is the whole run of its characters before an at sign, so time stays linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = _LOCAL.match(text[free:at][::-1])
        tail = _DOMAIN.match(text, at + 1)
        free = at + 1
        if run and tail:
            yield "email", at - run.end(), tail.end()
            free = tail.end()
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    """Groups of four dotted numbers, each at most 255."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        if len(parts) < 4:
            continue
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield "ip", start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by kind and then start."""
    out = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += ips(text)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# The labelled table: {kind:span} marks a span, all else is outside.
EXAMPLES = (
    "call me at {phone:(415) 555-0199} after six", "phone {phone:415-555-0123} or write", "tel {phone:020 7946 0958} office hours", "my number is {phone:030 901820 44} thanks",
    "ring {phone:(212) 555 0147} today .", "fax : {phone:415.555.0188} and mail", "mobile {phone:07700 900 123} , please", "cell {phone:555-867-5309} evenings", "reach us : {phone:+44 20 7946 0958} now",
    "dial {phone:+1 (415) 555-0100} at once", "und {phone:+49 30 901820} der", "et {phone:+33 1 23 45 67 89} la", "write to {email:jane.doe@example.com} soon", "mail {email:bob_77@mail.example.org} and wait",
    "und {email:k.meier@post.example.de} für", "contact {email:jane . doe @ example . com} soon", "mail {email:jane (at) example (dot) com} today", "write {email:bob [at] example [dot] org} please",
    "email {email:kim [at] mail . example . net} .", "address {email:sam @ example . com} , thanks", "the host {ip:192.168.10.24} was down", "from {ip:10.0.0.1} to {ip:172.16.4.200} it went", "la {ip:83.12.240.9} de",
    "card {card:4111 1111 1111 1111} expires soon", "visa {card:5500-0055-5555-5559} was used", "pay with {card:4012888888881881} today", "und {card:4111111111111111} die",
    "version 3.12.4 of the tool", "in 1998 there were 250 of them", "page 12 of 340 and 7 more", "order 448201 shipped on 12-05-2021", "chapter 4 , section 12.3 says", "token = 6fdca1d4cb3f1879a57e084032f799cd and",
    "key AKIAQ5YWJ3YKBCSQ7T2 was found", "sha a9f3b2c4d5 at 10:45 today", "from 10 to 20 percent", "the year 2024 - 2025 budget", "room 101 at the end", "it cost 1,299.00 for 3", "on 2021-12-05 at 09:30:15 utc",
    "isbn 978-3-16-148410-0 of the book", "id 4435377173219881 in the log", "1. first 2. second 3. third", "score 3 - 2 after 90 minutes", "a1 b2 c3 d4 in a row", "look @ this and that", "he is at work ( at home )", "line 12345678901234567890 ends",
    "ou {phone:+1 (269) 555-3296} {card:4524132264652876} an", "erntou {phone:+1 (578) 555-6437} {card:4918187128635271} er", "la {card:4111111111111111} {phone:+1 (415) 555-0100} de", "x {card:4012888888881881} {card:4111111111111111} y",
    "of {phone:+1 (415) 555-0100} {phone:+1 (212) 555-0147} re", "in {ip:10.20.30.40} {phone:+1 (415) 555-0100} {ip:10.20.30.40} st", "with {phone:+1 (415) 555-0100} {email:ab.12@mail3.example.com} an", "th {email:ab.12@mail3.example.com} {card:4524132264652876} ha",
    "reach {email:joe [at] corp [dot] com} now", "and {email:ann (at) site (dot) org} the", "mail {email:joe.smith (at) corp (dot) com} now", "de {email:x.y [at] mail [dot] net} la", "tel . {phone:0171 2345678} or", "und {phone:0171 2345678} der", "tel {phone:06 12 34 56 78} ok",
    "the and of it at on", "part 7 . then 8 . then 9", "http example 8080 port open", "sum 12 345 678 in total", "42", "12.5 and 13.75 were read",
)

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_CUES = frozenset("at dot call phone tel telephone mobile cell fax ring dial mail email e contact write card visa pay number host ip version order id isbn key token sha page year".split())


def shape(token: str) -> str:
    """A token's shape: letters and digits as classes (digits with their number), signs as they are."""
    c = token[0]
    if c.isdigit():
        return f"9{min(len(token), 17)}"
    if c.isalpha():
        return "a" if token.islower() else "A" if token.isupper() else "Aa"
    return c


def features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    """The feature names of each of a window's tokens (text, start, end)."""
    shapes = ["<", "<", *(shape(t) for t, _, _ in tokens), ">", ">"]
    glued = [False, *(a[2] == b[1] for a, b in zip(tokens, tokens[1:], strict=False)), False]
    out = []
    for k, (text, _, _) in enumerate(tokens):
        s = shapes[k : k + 5]
        names = ["bias", f"s={s[2]}", f"p={s[1]}", f"n={s[3]}", f"ps={s[1]}|{s[2]}|{glued[k]}", f"sn={s[2]}|{s[3]}|{glued[k + 1]}", f"pp={s[0]}|{s[1]}", f"nn={s[3]}|{s[4]}", f"psn={s[1]}|{s[2]}|{s[3]}", f"g={glued[k]}|{glued[k + 1]}"]
        for at, tag in ((k, "w"), (k - 1, "pw"), (k + 1, "nw")):
            if 0 <= at < len(tokens) and (w := tokens[at][0].lower()) in _CUES:
                names.append(f"{tag}={w}")
        out.append(names)
    return out


def tokens_of(text: str, offset: int = 0) -> list[tuple[str, int, int]]:
    return [(m[0], m.start() + offset, m.end() + offset) for m in _TOKEN.finditer(text)]


def _labelled(example: str) -> tuple[list[tuple[str, int, int]], list[int]]:
    text, marks = "", []
    for part in re.split(r"(\{\w+:[^}]*\})", example):
        if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
            marks.append((m[1], len(text), len(text) + len(m[2])))
            part = m[2]
        text += part
    tokens = tokens_of(text)
    tags = []
    for _, start, end in tokens:
        hit = next((x for x in marks if x[1] <= start and end <= x[2]), None)
        tags.append(LABELS.index(f"{'B' if hit[1] == start else 'I'}-{hit[0]}") if hit else 0)
    return tokens, tags


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Field:
    """A linear-chain conditional random field: emission weights by feature and label, transition weights by label pair."""

    def __init__(self, vocabulary: dict[str, int], emission: np.ndarray, transition: np.ndarray) -> None:
        self.vocabulary, self.emission, self.transition = vocabulary, emission, transition

    @classmethod
    def train(cls, examples: tuple[str, ...] = EXAMPLES, rounds: int = 160, rate: float = 0.1, ridge: float = 0.003) -> Field:
        """Adam on the regularised log-likelihood; forward and backward sums run over all examples at once."""
        data = [_labelled(x) for x in examples]
        names = [features(t) for t, _ in data]
        vocabulary = {n: k for k, n in enumerate(sorted({n for row in names for token in row for n in token}))}
        size, n, longest, width = len(LABELS), len(data), max(len(t) for t, _ in data), len(vocabulary)
        x, y, live = np.zeros((n, longest, width)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (row, (_, tags)) in enumerate(zip(names, data, strict=True)):
            live[i, : len(tags)], y[i, : len(tags)] = True, tags
            for k, token in enumerate(row):
                x[i, k, [vocabulary[v] for v in token]] = 1
        truth = np.eye(size)[y] * live[..., None]
        pairs = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
        w, a = np.zeros((width, size)), np.zeros((size, size))
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, a)]
        for step in range(1, rounds + 1):
            e = x @ w
            alpha, beta = np.zeros((n, longest, size)), np.zeros((n, longest, size))
            alpha[:, 0] = e[:, 0]
            for t in range(1, longest):
                alpha[:, t] = np.where(live[:, t, None], e[:, t] + _sum_exp(alpha[:, t - 1, :, None] + a, 1), alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                beta[:, t] = np.where(live[:, t + 1, None], _sum_exp(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            z = _sum_exp(alpha[:, -1], 1)[:, None, None]
            node = np.exp(alpha + beta - z) * live[..., None]
            edge = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None]) * live[:, 1:, None, None]
            grads = (np.einsum("ntf,ntl->fl", x, truth - node) - ridge * n * w, pairs - edge.sum((0, 1)) - ridge * n * a)
            for v, g, (m, s) in zip((w, a), grads, state, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        a[:, [k for k, v in enumerate(LABELS) if v[0] == "I"]] += np.array([[0 if LABELS[i][2:] == LABELS[j][2:] and i else -1e4 for j in range(size) if LABELS[j][0] == "I"] for i in range(size)])
        return cls(vocabulary, w, a)

    def _emissions(self, windows: list[list[tuple[str, int, int]]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens ``low`` to ``high`` of each window, and which of them it has; features see two tokens further."""
        e, live = np.zeros((len(windows), high - low, len(LABELS))), np.zeros((len(windows), high - low), bool)
        begin = max(0, low - 2)
        for i, window in enumerate(windows):
            count = max(0, min(high, len(window)) - low)
            live[i, :count] = True
            for k, token in enumerate(features(window[begin : high + 2])[low - begin : low - begin + count]):
                e[i, k] = self.emission[[j for v in token if (j := self.vocabulary.get(v)) is not None]].sum(0)
        return e, live

    def decode(self, windows: list[list[tuple[str, int, int]]]) -> list[list[int]]:
        """The likeliest labels of each window, by Viterbi over all of them at once; of long ones only the way back is held."""
        n, longest, size = len(windows), max(map(len, windows)), len(LABELS)
        best, back = np.array([[-1e4 if v[0] == "I" else 0.0 for v in LABELS]] * n), np.zeros((n, longest, size), np.int8)
        for low in range(0, longest, BLOCK):
            e, live = self._emissions(windows, low, min(longest, low + BLOCK))
            for t in range(e.shape[1]):
                if low + t == 0:
                    best = e[:, 0] + best
                    continue
                paths = best[:, :, None] + self.transition
                back[:, low + t] = np.where(live[:, t, None], paths.argmax(1), np.arange(size))
                best = np.where(live[:, t, None], paths.max(1) + e[:, t], best)
        at, out = best.argmax(1), np.zeros((n, longest), int)
        for t in range(longest - 1, -1, -1):
            out[:, t] = at
            at = back[np.arange(n), t, at]
        return [row[: len(w)].tolist() for row, w in zip(out, windows, strict=True)]


@cache
def trained() -> Field:
    """The field of EXAMPLES; training is exact and takes about a second."""
    return Field.train()


_TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]")


def windows_of(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of tokens that hold all triggers, with WINDOW tokens on each side; a run is never cut, however long."""
    out, lines_from = [], 0
    triggers = [m.start() for m in _TRIGGER.finditer(text)]
    k = 0
    while k < len(triggers):
        # text around a cluster of triggers: 120 characters reach WINDOW tokens unless they are very long ones
        first = last = triggers[k]
        while k < len(triggers) and triggers[k] - last <= 240:
            last = triggers[k]
            k += 1
        low, high = max(lines_from, first - 120), min(len(text), last + 120)
        tokens = tokens_of(text[low:high], low)
        near = np.zeros(len(tokens) + 1, int)
        for n, (token, _, _) in enumerate(tokens):
            if token == "@" or token[0].isdigit() or (token == "at" and n and tokens[n - 1][0] in "[("):
                near[max(0, n - WINDOW)] += 1
                near[min(len(tokens), n + WINDOW + 1)] -= 1
        inside = np.cumsum(near)[:-1] > 0
        run: list[tuple[str, int, int]] = []
        for token, keep in zip(tokens, inside.tolist(), strict=True):
            if keep:
                run.append(token)
            elif run:
                out.append(run)
                run = []
        if run:
            out.append(run)
        lines_from = high
    return out


def _plausible(kind: str, text: str) -> bool:
    """What a span needs beyond its labels to be of its kind."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "phone":
        return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+0-9 ().-]*[ ().-][+0-9 ().-]*", text)) and "\n" not in text and not re.search(r"\d[.:/]\d\d[.:/]", text)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return False  # whatever is an address is a base span
    return bool(re.fullmatch(r"[\w.%+-]+(?:\s?\.\s?[\w%+-]+)*\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]+)+", text)) and "\n" not in text


def spans_of(labels: list[int], window: list[tuple[str, int, int]], text: str) -> Iterator[Span]:
    """The labelled spans of a window that are plausible."""
    k = 0
    while k < len(labels):
        name = LABELS[labels[k]]
        if name[0] != "B":
            k += 1
            continue
        end = k + 1
        while end < len(labels) and LABELS[labels[end]] == f"I-{name[2:]}":
            end += 1
        start, stop = window[k][1], window[end - 1][2]
        if _plausible(name[2:], text[start:stop]):
            yield name[2:], start, stop
        k = end


def _batches(windows: list[tuple[int, list[tuple[str, int, int]]]]) -> Iterator[list[tuple[int, list[tuple[str, int, int]]]]]:
    """The windows, shorter ones first, by at most BATCH and at most BATCH * BLOCK tokens with padding, or one longer window."""
    part: list[tuple[int, list[tuple[str, int, int]]]] = []
    for item in sorted(windows, key=lambda x: len(x[1])):
        if part and (len(part) == BATCH or (len(part) + 1) * len(item[1]) > BATCH * BLOCK):
            yield part
            part = []
        part.append(item)
    if part:
        yield part


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; added ones overlap no base span and none of their own kind."""
    base = [base_spans(t) for t in texts]
    windows = [(i, w) for i, t in enumerate(texts) for w in windows_of(t)]
    added: list[list[Span]] = [[] for _ in texts]
    for part in _batches(windows):
        for (i, w), labels in zip(part, field.decode([w for _, w in part]), strict=True):
            for span in spans_of(labels, w, texts[i]):
                if all(span[2] <= a or z <= span[1] for _, a, z in base[i]):
                    added[i].append(span)
    return list(zip(base, added, strict=True))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_email, n_ip, n_card, n_phone, base_spans, spans.

    Counts are of all spans, spans are ``kind:start:end`` in code points, by kind and then start.  Null texts count as
    empty; other columns are ignored.
    """
    common.prepare(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column("text").to_pylist()], field.value)
            both = [b + a for b, a in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in both], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), *counts, pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(s) for s in both], pa.string())],
                names=["k", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
            )

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return source.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, {counts}, base_spans string, spans string").withColumnRenamed("k", key)
