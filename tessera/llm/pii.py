"""Personal data by rules and a semi-Markov conditional random field.

The rules give the base spans. Beside them a semi-Markov field reads the regions of a
text that hold a digit, ``@`` or ``+``: every candidate segment of at most
``MOST_TOKENS`` tokens is scored as a whole (its shape, digits, checksum, borders),
and dynamic programming over ends and segment lengths chooses borders and types
together, so its cost is linear in the region. A region is read whole, however long:
the programme goes from left to right and keeps the last ``MOST_TOKENS`` places only. Its weights are fitted by conditional
likelihood on generated examples (a fixed seed), never on the corpus. Spans of the
field that touch no base span are added.

Edge cases: null text is an empty one; texts of any length are read whole; spans are
in code points, end exclusive; repeated rows are scanned each by itself.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeing, table

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@+]")
_NUMBERS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the rules' spans, ordered."""
    out = []
    at, taken = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > taken and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            taken = domain.end()
            out.append((begin, 0, taken))
        at = text.find("@", max(at + 1, taken))
    if _NUMBERS.search(text):
        for run in _DOTTED.finditer(text):
            if run.group().count(".") >= 3:
                for m in _IP.finditer(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field ----------------------------------------------------------------

_WORD, _NEXT = re.compile(r"[^\s]*"), re.compile(r"\x20[^\s]*[0-9][^\s]*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_EDGE = frozenset("(+")


def regions(text: str) -> Iterator[Iterator[tuple[int, int]]]:
    """Tokens (start, end) of each of a text's parts that may hold an entity, one after another."""
    at = 0
    while True:
        hit = _TRIGGER.search(text, at)
        if not hit:
            return
        begin = hit.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        at = _WORD.match(text, hit.end()).end()
        while more := _NEXT.match(text, at):
            at = more.end()
        yield ((t.start(), t.end()) for t in _TOKEN.finditer(text, begin, at))


def _shape(part: str) -> str:
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", part))
    return shape if len(shape) <= 12 else shape[:11] + "~"


def features(text: str, start: int, end: int) -> tuple[str, ...]:
    """Features of a whole candidate segment."""
    part = text[start:end]
    digits = _digits(part)
    n = len(digits)
    left, right = text[start - 1 : start], text[end : end + 1]
    border = lambda c: "" if not c or c.isspace() else "9" if c.isdigit() else "a" if c.isalpha() else c
    out = [f"s={_shape(part)}", f"n={n if n < 20 else 20}", f"l={border(left)}", f"r={border(right)}"]
    letters = sum(c.isalpha() for c in part)
    out.append("letters" if letters else "plain")
    if "@" in part:
        out.append(f"@={part.count('@')}" + ("." if "." in part.rpartition("@")[2] else ""))
    if 14 <= n <= 19 and not letters:
        out.append("luhn" if luhn(digits) else "noluhn")
    if part.count(".") == 3 and n and not letters:
        good = all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in part.split("."))
        out.append("quad" if good else "noquad")
    if part[0] in _EDGE:
        out.append("edge=" + part[0])
    return tuple(out)


def candidates(text: str, tokens: Iterable[tuple[int, int]]):
    """(first token, end token, start, end, features) of segments that may be an entity, by their first tokens."""
    rest = iter(tokens)
    ahead, i = deque(islice(rest, MOST_TOKENS)), 0
    while ahead:
        a = ahead[0][0]
        if (text[a].isalnum() or text[a] in _EDGE) and not text[a - 1 : a].isalnum():
            kinds = 0
            for j, (begin, end) in enumerate(ahead, i + 1):
                kinds |= text[begin].isdigit() | (text[begin] == "@") << 1
                if text[begin].isalnum() and kinds and not text[end : end + 1].isalnum():
                    yield i, j, a, end, features(text, a, end)
        ahead.popleft()
        ahead.extend(islice(rest, 1))
        i += 1


class Field:
    """Weights by (kind, feature); label 0 is a single token outside any entity."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def score(self, kind: int, found: tuple[str, ...]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in found) + w.get((kind, ""), 0.0)

    def best(self, text: str, tokens: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the entities of the best segmentation.

        Ways to the tokens ahead wait in ``ending``; a way is its last entity and the way before it.
        """
        value, way = 0.0, None
        ending: dict[int, tuple] = {}

        def settle(upto: int) -> None:
            nonlocal value, way
            for j in sorted(j for j in ending if j <= upto):
                reached = ending.pop(j)
                if reached[0] > value:
                    value, way = reached

        for i, j, start, end, found in candidates(text, tokens):
            top, kind = max((self.score(k, found), -k) for k in range(len(KINDS)))
            if top > 0:
                settle(i)
                if j not in ending or value + top > ending[j][0]:
                    ending[j] = value + top, ((start, -kind, end), way)
        settle(max(ending, default=0))
        out = []
        while way:
            out.append(way[0])
            way = way[1]
        return out[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], truth: set, rate: float) -> None:
        """One step up the conditional log-likelihood: observed minus expected segment features."""
        n, segments = len(tokens), []
        for i, j, _, _, found in candidates(text, tokens):
            segments += [(i, j, k, found, self.score(k, found)) for k in range(len(KINDS))]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for s in segments:
            by_end.setdefault(s[1], []).append(s)
            by_start.setdefault(s[0], []).append(s)
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[s[0]] + s[4] for s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[s[1]] + s[4] for s in by_start.get(i, ()))])
        for i, j, k, found, own in segments:
            gap = float((tokens[i][0], k, tokens[j - 1][1]) in truth) - float(np.exp(alpha[i] + own + beta[j] - alpha[n]))
            if abs(gap) > 1e-4:
                for f in (*found, ""):
                    self.weights[k, f] = self.weights.get((k, f), 0.0) * (1 - rate * 1e-3) + rate * gap


def _with_check(prefix: str) -> str:
    return next(prefix + str(c) for c in range(10) if luhn(prefix + str(c)))


def examples(n: int, seed: int = 11) -> list[tuple[str, set]]:
    """Generated texts with their entities, in more forms than the rules know, and look-alikes without."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustnrldm") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def email():
        return word() + r.choice(["", "." + word(), num(2), "_" + word()]) + "@" + word() + r.choice(["", num(1)]) + "." + r.choice(["com", "org", "example.com", "de"])

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        d, gap = _with_check(r.choice("3456") + num(r.choice([13, 14, 14, 14, 15]))), r.choice(["", "", " ", "-", "."])
        return gap.join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(11)}"])

    def other():
        code = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40])))
        return r.choice([num(r.randint(1, 19)), code, f'"{code}"', f'{word()} = "{code}"', f"{num(1)}.{num(1)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{word()}{num(2)}", "@" + word(), f"{num(2)}:{num(2)}", f"{num(3)},{num(3)}", f"{num(2)}%", f"{r.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(3)}.{num(2)}", f"{num(40)}", f"{num(2)}{word()}{num(3)}{word()}"])

    made = [email, ip, card, phone, other, other]
    out = []
    for _ in range(n):
        text, truth = word() + " ", set()
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(made))
            part = made[k]()
            if k < 4:
                truth.add((len(text), k, len(text) + len(part)))
            elif 14 <= len(part) <= 19 and part.isdigit() and luhn(part):
                truth.add((len(text), 2, len(text) + len(part)))
            text += part + r.choice([" ", ". ", ", "]) + word() + " "
        out.append((text, truth))
    return out


@cache
def field(n: int = 500, rounds: int = 4) -> Field:
    """The field fitted on generated examples; the same weights on every machine."""
    own = Field()
    rows = examples(n)
    for k in range(rounds):
        for text, truth in rows:
            for tokens in regions(text):
                own.learn(text, list(tokens), truth, 0.3 / (1 + k))
    return own


def spans(text: str | None, model: Field) -> tuple[list, list]:
    """Base spans, and all spans: (start, kind number, end) in order."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added = []
    for tokens in regions(text):
        added += model.best(text, tokens)
    base_ends = np.array([(a, b) for a, _, b in base], np.int64).reshape(-1, 2)
    added = [s for s in added if not ((base_ends[:, 0] < s[2]) & (base_ends[:, 1] > s[0])).any()]
    return base, sorted(base + added)


def joined(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field().weights)

    def run(batches):
        model = Field(shared.value)
        for batch in batches:
            rows = [spans(t, model) for t in batch.column("text").to_pylist()]
            count = lambda k: pa.array([sum(s[1] == k for s in base) for base, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[count(k) for k in range(4)],
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]),
                    pa.array([joined(every) for _, every in rows], pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(run), _SCHEMA)


def masked(text: str | None, model: Field) -> str | None:
    """The text with every span replaced by its kind, until none is found.

    Names of kinds hold no digit, ``@`` or ``+`` and a span holds one at least, so this ends.
    """
    while every := spans(text, model)[1]:
        parts, at = [], 0
        for a, k, b in every:
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        text = "".join(parts) + text[at:]
    return text


def mask(docs: DataFrame) -> DataFrame:
    """Documents with their personal data masked; n_chars follows the text where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(field().weights)

    def run(texts: pd.Series) -> pd.Series:
        model = Field(shared.value)
        return pd.Series([masked(t, model) if isinstance(t, str) else None for t in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
