"""Public tokenizers, and edit-aware token counts over pre-token segment trees.

Edge cases: null text is an empty one with no leaf and no token; texts without a space
are one leaf; edits of a document lie apart (insertions have start = end): of edits that
overlap the one that starts first counts, and edits without a place or with an end before
their start are left out; places behind the text are its end; documents without edits are
not read again; rows of one doc_id get the edits of that id, each row once.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeing, slices, table


#: Blanks in a row from which a text is encoded by ``tokenizers``: the rank encoder's pattern fails at 10^6.
LONG_BLANK = 100_000
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)


@cache
def byte_bpe(path: str | None = None) -> Callable[[str], list[int]]:
    """Encode a text with the byte-level vocabulary; its added tokens are found in the text, as by ``tokenizers``.

    ``path`` names a file of ranks, which has no added tokens; the public ``byte_bpe_50k`` one where not given.
    Texts with ``LONG_BLANK`` blanks in a row are encoded by ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added = {}
    if not path:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    plain = cache(lambda: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_BLANK and _LONG_BLANK.search(text):
            return plain().encode(text, add_special_tokens=False).ids
        if any(t in text for t in added):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode


def n_tokens():
    """A column function: the number of byte-level tokens of a text (null: none)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = byte_bpe()
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


# ---- edit-aware counts -----------------------------------------------------------
#
# A text is cut into leaves at sure pre-token borders: before a single space that
# stands between two other characters. No pre-token spans such a place, so the
# leaves' counts add up to the text's. A segment tree over the leaves holds the sums
# of characters and tokens. An edit touches some leaves; those are encoded again, and
# their neighbours where the edit reaches the characters that make a border sure;
# the sums on the paths to the root follow. Nothing else is read. What was encoded again
# is cut to leaves anew, so leaves stay small however often a text is edited; where they
# are more than the leaves that they replace, the tree is built again from the sums.

LEAF = 512
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def leaf_ends(text: str, size: int = LEAF) -> list[int]:
    """Ends of the leaves: the first sure border after every ``size`` characters, and the text's end."""
    out, at = [], 0
    while len(text) - at > size:
        m = _BORDER.search(text, at + size)
        if not m:
            break
        at = m.start()
        out.append(at)
    if at < len(text):
        out.append(len(text))
    return out


class SegmentTree:
    """Sums over leaves in heap order: node k has the children 2k and 2k + 1, node 1 is the root."""

    def __init__(self, leaves: list[int]):
        self.n = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [0] * (2 * self.n)
        self.sums[self.n : self.n + len(leaves)] = leaves
        for k in range(self.n - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @classmethod
    def stored(cls, sums: list[int]) -> SegmentTree:
        own = cls.__new__(cls)
        own.sums, own.n = list(sums), len(sums) // 2
        return own

    @property
    def total(self) -> int:
        return self.sums[1]

    def put(self, leaf: int, value: int) -> None:
        k = self.n + leaf
        step = value - self.sums[k]
        while k:
            self.sums[k] += step
            k >>= 1

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and where it begins (the last leaf for places behind)."""
        k, begin = 1, 0
        while k < self.n:
            left = self.sums[2 * k]
            if place - begin < left or not self.sums[2 * k + 1]:
                k = 2 * k
            else:
                begin += left
                k = 2 * k + 1
        return k - self.n, begin


def trees_of(text: str, encode: Callable[[str], list[int]], size: int = LEAF) -> tuple[SegmentTree, SegmentTree]:
    """Trees of characters and of tokens over a text's leaves."""
    ends = leaf_ends(text, size)
    begins = [0, *ends[:-1]]
    chars = [b - a for a, b in zip(begins, ends)]
    tokens = [len(encode(text[a:b])) for a, b in zip(begins, ends)]
    return SegmentTree(chars), SegmentTree(tokens)


def edit(text: str, chars: SegmentTree, tokens: SegmentTree, edits: list[tuple[int, int, str]], encode) -> int:
    """Update the trees of ``text`` by edits (start, end, replacement), in order and apart; characters encoded again."""
    begins, at = [], 0
    for size in chars.sums[chars.n :]:
        begins.append(at)
        at += size
    regions: list[list[int]] = []
    for start, end, _ in edits:
        first = chars.leaf_at(max(start - 2, 0))[0]  # a border's two characters belong to the leaf they open
        last = chars.leaf_at(max(end, start))[0]  # an edit that ends at a border can undo it
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(last, regions[-1][1])
        else:
            regions.append([first, last])
    k, read, changed = 0, 0, []
    for first, last in regions:
        low, high = begins[first], begins[last] + chars.sums[chars.n + last]
        parts, at = [], low
        while k < len(edits) and edits[k][0] <= high and (edits[k][0] < high or last == len(begins) - 1 or edits[k][1] <= high):
            start, end, new = edits[k]
            parts += [text[at:start], new]
            at, k = end, k + 1
        new = "".join(parts) + text[at:high]
        ends = leaf_ends(new)
        parts = [new[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        changed.append((first, last, [len(p) for p in parts], [len(encode(p)) for p in parts]))
        read += len(new)
    if all(len(sizes) <= last - first + 1 for first, last, sizes, _ in changed):
        for first, last, *columns in changed:
            for tree, own in zip((chars, tokens), columns):
                for leaf in range(first, last + 1):
                    tree.put(leaf, own[leaf - first] if leaf - first < len(own) else 0)
        return read
    leaves = list(zip(chars.sums[chars.n :], tokens.sums[tokens.n :]))
    for first, last, *columns in reversed(changed):
        leaves[first : last + 1] = zip(*columns)
    leaves = [x for x in leaves if x[0]]
    for k, tree in enumerate((chars, tokens)):
        tree.__init__([x[k] for x in leaves])
    return read


def apart(edits: list[tuple], size: int) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) in order, within a text of ``size`` characters, without those that make no sense."""
    out, at = [], 0
    for start, end, new in sorted((e for e in edits if e[0] is not None and e[1] is not None and 0 <= e[0] <= e[1]), key=lambda e: e[:2]):
        if start >= at:
            out.append((min(start, size), min(end, size), new or ""))
            at = end
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join(parts) + text[at:]


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))


def count_trees(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The stored form: doc_id, a hash of the text, sums of characters and of tokens in heap order."""

    def run(batches):
        encode = byte_bpe()
        for batch in batches:
            trees = [trees_of(t or "", encode, leaf) for t in batch.column("text").to_pylist()]
            lists = [pa.array([t[k].sums for t in trees], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *lists], names=["doc_id", "t", "chars", "tokens"])

    return _hashed(docs).mapInArrow(freeing(run), "doc_id long, t long, chars array<long>, tokens array<long>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame) -> DataFrame:
    """New sums of the documents that ``edits`` (doc_id, start, end, replacement) touches.

    Edits of a document lie apart (see above) and refer to its text before; only edited
    documents are read. A document's edits are gathered, as its text is. Rows without id have no edits.
    """
    own = edits.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "end", "replacement")
    own = own.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    stored = trees.dropDuplicates(["doc_id", "t"])  # equal rows have equal trees
    rows = _hashed(docs).join(own, "doc_id").join(stored, ["doc_id", "t"])

    def run(batches):
        encode = byte_bpe()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                chars, tokens = SegmentTree.stored(r["chars"]), SegmentTree.stored(r["tokens"])
                steps = apart([(e["start"], e["end"], e["replacement"]) for e in r["edits"]], len(r["text"] or ""))
                read = edit(r["text"] or "", chars, tokens, steps, encode)
                out.append((r["doc_id"], tokens.total, read, chars.sums, tokens.sums))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_tokens", "n_read", "chars", "tokens"]
            )

    return rows.select("doc_id", "text", "edits", "chars", "tokens").mapInArrow(freeing(run), "doc_id long, n_tokens long, n_read long, chars array<long>, tokens array<long>"
    )


#: The cleaning whose effect the query counts: runs of marks between words go.
MARKS = re.compile(r"[#$%&*!]{2,}")


def counted(docs: DataFrame, marks: re.Pattern = MARKS) -> DataFrame:
    """Token counts of every document before and after its runs of marks are deleted, without a second full encoding."""

    def run(batches):
        encode = byte_bpe()
        for whole in batches:
            for batch in slices(whole):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    text = text or ""
                    chars, tokens = trees_of(text, encode)
                    before = tokens.total
                    steps = [(m.start(), m.end(), "") for m in marks.finditer(text)]
                    read = edit(text, chars, tokens, steps, encode) if steps else 0
                    out.append((doc_id, len(text), before, len(steps), tokens.total, read))
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_COUNTED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(freeing(run), ", ".join(f"{c} long" for c in _COUNTED))


_COUNTED = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_tokens_edited", "n_read"]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
