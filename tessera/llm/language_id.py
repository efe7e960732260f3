"""Language identification: scripts narrow the candidates, Viterbi labels the words.

Byte n-grams of words (with their borders) are hashed into ``BUCKETS`` and counted by
language over a bounded sample of rows that may be learnt from; so are the letters'
scripts. A word's score in a language is the sum of its n-grams' log probabilities; a
language that hardly ever uses the word's script is out, where another one does use it.

Viterbi with a switching penalty then labels every word of a text. Where the best
single language can't lose to any mixture - no run of words gains more than half a switch in
another language - it is the best path already, and only the other
texts are run through the recursion, all of a batch in step. The prediction is the
language of most letters on the path; the score is their share, less the chance of
the language that comes second in the whole text.

Edge cases: null text and text without a letter are ``und`` with score 1; without rows
to learn from every text with a letter is ``und`` with score 0; a text whose letters all
are among signs (``ℝ``) is the first language with score 0; texts are read whole;
repeated rows are predicted each by itself; rows without doc_id count as held out; of
languages that tie the first in order is taken; only doc_id, text and lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, freeing, held_out, run_spans, slices, table, text_plane, word_hashes

#: Documents of a language fitted on at most (about), hash buckets, n-gram lengths.
MOST_ROWS, BUCKETS, GRAMS = 5_000, 1 << 15, (1, 2, 3, 4)
#: Cost of a switch (in nats), weight of an n-gram's evidence, least share of a script a language uses.
PENALTY, TEMPER, LEAST_SCRIPT = 12.0, 0.3, 0.005

#: Scripts by the first and last character of their blocks (Unicode's layout; fixed values); blocks not named are ``other``.
BLOCKS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0x8A0, 0x8FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("burmese", 0x1000, 0x107F),
    ("georgian", 0x1080, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x13BF), ("khmer", 0x1780, 0x17FF),
    ("mongolian", 0x1800, 0x18BF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("cjk", 0x3100, 0x9FFF), ("hangul", 0xA980, 0xA9BF), ("hangul", 0xAC00, 0xD7FF), ("cjk", 0xF900, 0xFAFF), ("cjk", 0x20000, 0x3FFFF),
)
SCRIPTS = (*dict.fromkeys(name for name, _, _ in BLOCKS), "other")


def _script_table() -> np.ndarray:
    """The script by a character's first two UTF-8 bytes (an ASCII one: its byte alone); -1 for bytes that begin none."""
    out = np.full((256, 256), -1, np.int8)
    out[0xC2:0xF5] = SCRIPTS.index("other")
    for name, first, last in BLOCKS:
        # two bytes tell 64 characters of two or three bytes apart, 4096 of four
        for c in range(first, last + 1, 1 if last < 0x800 else 0x40 if last < 0x10000 else 0x1000):
            lead = chr(c).encode("utf-8", "surrogatepass")
            out[lead[0], lead[1] if len(lead) > 1 else slice(None)] = SCRIPTS.index(name)
    return out.ravel()


_SCRIPT_OF = _script_table()


def scripts_at(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The script of the characters that begin at the bytes ``at``; -1 where none begins."""
    return _SCRIPT_OF[plane[at].astype(np.int32) * 256 + plane[np.minimum(at + 1, len(plane) - 1)]]


_IS_WORD = np.zeros(256, bool)
_IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


#: Bytes that begin a mark, not a letter, with the second bytes they do so with: Latin-1 signs, punctuation and
#: symbols from U+2000 to U+2BFF, ideographic punctuation, variation selectors, pictographs (fixed values).
_MARKS = (
    (0xC2, 2, frozenset(range(0x80, 0xC0)) - {0xAA, 0xB5, 0xBA}),
    (0xC3, 2, frozenset((0x97, 0xB7))),
    (0xE2, 3, frozenset(range(0x80, 0xB0))),
    (0xE3, 3, frozenset((0x80,))),
    (0xEF, 3, frozenset((0xB8,))),
    (0xF0, 4, frozenset((0x9F,))),
)


def letter_bytes(plane: np.ndarray) -> np.ndarray:
    """Whether each byte is part of a letter."""
    inside = _IS_WORD[plane]
    for lead, size, seconds in _MARKS:
        at = np.flatnonzero(plane[:-1] == lead)
        if len(at):
            at = at[np.isin(plane[at + 1], list(seconds))]
            for k in range(size):
                inside[np.minimum(at + k, len(plane) - 1)] = False
    return inside


def _lowered(plane: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin capitals in lower case."""
    out = ascii_lower(plane)
    if len(plane) > 1:
        capital = np.flatnonzero((plane[:-1] == 0xC3) & (plane[1:] >= 0x80) & (plane[1:] <= 0x9E) & (plane[1:] != 0x97)) + 1
        out[capital] += 0x20
    return out


def grams(plane: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each n: hashed n-grams at the bytes of the words (with a border before and after) and their words."""
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    word = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    place = np.arange(total) - np.repeat(first, sizes)
    at = place + np.repeat(starts - 1, sizes)
    padded = np.full(total, 32, np.uint32)
    inner = (place > 0) & (place < np.repeat(sizes - 1, sizes))
    padded[inner] = plane[at[inner]]
    for n in GRAMS:
        if total < n:
            return
        code = padded[: total - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(257) + padded[k : total - n + 1 + k]
        code = code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(13)
        same = word[: total - n + 1] == word[n - 1 :]
        yield (code % np.uint32(BUCKETS))[same].astype(np.int32), word[: total - n + 1][same]


def word_scripts(plane: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script of most of each word's characters (the first in order where two tie)."""
    out, n = scripts_at(plane, starts), len(SCRIPTS)
    high = np.concatenate(([0], np.cumsum(plane >= 128)))
    some = np.flatnonzero(high[ends] > high[starts])  # words of ASCII letters are Latin
    starts, ends = starts[some], ends[some]
    sizes = ends - starts
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    script = scripts_at(plane, at)
    first = script >= 0  # first bytes of characters
    joint = np.repeat(np.arange(len(starts)), sizes)[first] * n + script[first]
    counts = np.bincount(joint, minlength=len(starts) * n).reshape(-1, n)
    out[some] = np.where(counts.any(axis=1), counts.argmax(axis=1), -1)
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages, tempered log probabilities
    uses: np.ndarray  # scripts x languages, whether the language uses the script


def _counts(batches):
    """Partial counts of n-grams (row numbers from 0) and scripts (below 0) by language."""
    by: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            plane, offsets = text_plane(batch.column("text"))
            plane = _lowered(plane)
            starts, ends, first = run_spans(letter_bytes(plane), offsets)
            doc = np.repeat(np.arange(len(langs)), np.diff(first))
            script = word_scripts(plane, starts, ends)
            names, number = np.unique(langs.astype(str), return_inverse=True)
            of_word = number[doc]
            for code, word in grams(plane, starts, ends):
                joint = np.bincount(of_word[word].astype(np.int64) * BUCKETS + code, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    by[name] = by.get(name, 0) + joint[k * BUCKETS : (k + 1) * BUCKETS]
            for k, name in enumerate(names):
                own = script[(of_word == k) & (script >= 0)]
                scripts[name] = scripts.get(name, 0) + np.bincount(own, minlength=len(SCRIPTS))
    for name, counts in by.items():
        some = np.flatnonzero(counts)
        used = scripts[name]
        yield pa.RecordBatch.from_pandas(
            pd.DataFrame(
                {
                    "lang": pd.Series([name] * (len(some) + len(SCRIPTS)), dtype=object),
                    "bucket": np.concatenate((some, -1 - np.arange(len(SCRIPTS)))).astype(np.int32),
                    "n": np.concatenate((counts[some], used)).astype(np.int64),
                }
            ),
            schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]),
            preserve_index=False,
        )


def fit(docs: DataFrame) -> Model:
    """Counts by language over rows that may be learnt from: all of rare languages, about ``MOST_ROWS`` of the others."""
    text, lang = F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", text, lang)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    many = {x: int(MOST_ROWS / n * (1 << 30)) for x, n in sizes.items() if n > MOST_ROWS}
    if many:
        share = F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("lang"))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.coalesce(share, F.lit(1 << 30)))
    known = known.select("text", "lang")
    rows = known.mapInArrow(freeing(_counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    number = {x: k for k, x in enumerate(langs)}
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    column = rows["lang"].map(number).to_numpy(int) if len(rows) else np.zeros(0, int)
    bucket, n = rows["bucket"].to_numpy(int), rows["n"].to_numpy(float)
    gram = bucket >= 0
    counts[bucket[gram], column[gram]] = n[gram]
    scripts[-1 - bucket[~gram], column[~gram]] = n[~gram]
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)
    weights = TEMPER * np.log(share)
    weights -= weights.mean(axis=1, keepdims=True) if langs else 0
    uses = scripts >= LEAST_SCRIPT * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, np.clip(weights, -2, 2).astype(np.float32), uses)


def word_scores(model: Model, plane: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x languages, each different word scored once."""
    _, at, number = np.unique(word_hashes(plane, starts, ends), return_index=True, return_inverse=True)
    return _scores(model, plane, starts[at], ends[at])[number]


def _scores(model: Model, plane: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x languages: summed evidence; languages without the word's script are out."""
    n, m = len(starts), len(model.langs)
    out = np.zeros((n, m))
    columns = [np.ascontiguousarray(model.weights[:, k]).astype(np.float64) for k in range(m)]
    for code, word in grams(plane, starts, ends):
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), bool), word[1:] != word[:-1])))  # grams lie word by word
        own = word[first]
        for k in range(m):
            if len(own):
                out[own, k] += np.add.reduceat(columns[k][code], first)
    script = word_scripts(plane, starts, ends)
    allowed = np.where(script[:, None] >= 0, model.uses[script], True)
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return np.where(allowed, out, out.min(axis=1, keepdims=True) - PENALTY)


def _steady(scores: np.ndarray, first: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Texts whose best single language surely is the best path (see above)."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    steady = np.ones(len(counts), bool)
    own = scores[np.arange(len(scores)), best[doc]]
    for k in range(scores.shape[1]):
        gain = np.concatenate(([0.0], np.cumsum(scores[:, k] - own)))
        span = gain.max() - gain.min() + 1
        # the least sum before each word of its text: a running minimum that falls from text to text
        low = np.minimum.accumulate(gain[:-1] - doc * span) + doc * span
        top = np.full(len(counts), -np.inf)
        some = counts > 0
        if some.any():
            top[some] = np.maximum.reduceat(gain[1:] - low, first[:-1][some])
        steady &= top <= PENALTY / 2  # two runs side by side share one switch
    return steady


def viterbi(scores: np.ndarray, first: np.ndarray, docs: np.ndarray) -> dict[int, np.ndarray]:
    """Labels of the words of each of ``docs``, all texts advanced in step."""
    counts = np.diff(first)[docs]
    order = np.argsort(-counts, kind="stable")
    docs, counts = docs[order], counts[order]
    begin, m = first[docs], scores.shape[1]
    longest = int(counts[0]) if len(counts) else 0
    going = np.searchsorted(-counts, -np.arange(longest), "left")  # texts with more than t words
    base = np.concatenate(([0], np.cumsum(going)))
    value = np.zeros((len(docs), m))
    kind = np.min_scalar_type(m)  # as wide as the number of languages needs
    back = np.zeros((int(base[-1]), m), kind)
    keep = np.arange(m, dtype=kind)
    for t in range(longest):
        k = going[t]
        now = value[:k]
        if t:
            best = now.argmax(axis=1)
            switch = now[np.arange(k), best] - PENALTY
            jump = switch[:, None] > now
            back[base[t] : base[t + 1]] = np.where(jump, best[:, None], keep)
            now = np.where(jump, switch[:, None], now)
        value[:k] = now + scores[begin[:k] + t]
    state = value.argmax(axis=1)
    labels = [np.zeros(c, kind) for c in counts]
    flat = np.zeros(int(base[-1]), kind)
    for t in range(longest - 1, -1, -1):
        k = going[t]
        flat[base[t] : base[t + 1]] = state[:k]
        if t:
            state[:k] = back[base[t] : base[t + 1]][np.arange(k), state[:k]]
    for d, c in enumerate(counts):
        labels[d] = flat[base[:c] + d]
    return dict(zip(docs.tolist(), labels))


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, list[list[tuple]]]:
    """Language, score and labelled spans (word, end word, language) of each text."""
    plane, offsets = text_plane(column)
    plane = _lowered(plane)
    inside = letter_bytes(plane)
    starts, ends, first = run_spans(inside, offsets)
    n = len(column)
    counts = np.diff(first)
    lettered = counts > 0
    plain = np.concatenate(([0], np.cumsum((plane < 128) & inside)))
    unsure = lettered & (plain[offsets[1:]] == plain[offsets[:-1]])  # no ASCII letter: look at the characters
    for d in np.flatnonzero(unsure):
        lettered[d] = any(c.isalpha() for c in column[int(d)].as_py())
    langs, share = ["und"] * n, np.where(lettered, 0.0, 1.0)
    spans: list[list[tuple]] = [[] for _ in range(n)]
    # letters among signs only (as in letterlike symbols) make no word to score
    wide = np.concatenate(([0], np.cumsum(plane >= 128)))
    for d in np.flatnonzero((counts == 0) & (wide[offsets[1:]] > wide[offsets[:-1]])):
        if any(c.isalpha() for c in column[int(d)].as_py()):
            share[d] = 0.0
            langs[d] = model.langs[0] if model.langs else "und"
    if not len(starts) or not model.langs:
        return langs, share, spans
    scores = word_scores(model, plane, starts, ends)
    m = len(model.langs)
    doc = np.repeat(np.arange(n), counts)
    totals = np.stack([np.bincount(doc, scores[:, k], n) for k in range(m)], axis=1)
    best = totals.argmax(axis=1)
    label = best[doc]
    for d, own in viterbi(scores, first, np.flatnonzero(~_steady(scores, first, best) & lettered)).items():
        label[first[d] : first[d + 1]] = own
    chars = np.concatenate(([0], np.cumsum((plane & 0xC0) != 0x80)))  # bytes that begin a character
    letters = np.bincount(doc * m + label, chars[ends] - chars[starts], n * m).reshape(n, m)
    winner = letters.argmax(axis=1)
    second = np.sort(totals, axis=1)[:, -2] if m > 1 else np.full(n, -np.inf)
    doubt = np.exp(-np.clip(totals.max(axis=1) - second, 0, 50)) / 2
    part = letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1)
    new = np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(new)
    for a, b in zip(at, np.concatenate((at[1:], [len(label)]))):
        d = doc[a]
        spans[d].append((int(a - first[d]), int(b - first[d]), model.langs[label[a]]))
    for d in np.flatnonzero(lettered):
        langs[d] = model.langs[winner[d]]
        share[d] = part[d] * (1 - doubt[d])
    return langs, share, spans


def identified(docs: DataFrame) -> DataFrame:
    """Contract rows, and the spans of each text as ``first word:end word:language``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                langs, score, spans = predict(shared.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(langs, pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                        pa.array([",".join(f"{a}:{b}:{x}" for a, b, x in own) for own in spans], pa.string()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
