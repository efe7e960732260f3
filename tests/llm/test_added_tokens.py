"""Added tokens of the vocabulary's file that stand in a text."""

import random

from tessera.llm import packing, tokens
from tests.llm.test_training_data import check_packing

TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "<|endoftext| >", None]


def test_ids_like_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    coder, encode, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.byte_bpe(), random.Random(41)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "word", "'s", "12", "é", "!"]
    for text in [t for t in TEXTS if t] + ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(2000)]:
        assert encode(text) == coder.encode(text, add_special_tokens=False).ids
        chars, counts = tokens.trees_of(text, encode, r.choice([2, 5, 20]))
        assert counts.total == len(encode(text))
        a, b = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
        edits = [(a, b, r.choice(["", " ", "<|endoftext|>", "|"]))]
        tokens.edit(text, chars, counts, edits, encode)
        assert counts.total == len(encode(tokens.edited(text, edits)))


def test_packing_and_counts_of_added_tokens(spark):
    rows = list(enumerate(TEXTS)) + [(9, "word <|endoftext|> " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(spark, rows, packing.packed(docs).collect())
    counts = {r.doc_id: r.n_tokens for r in tokens.counted(docs).collect()}
    assert counts[0] == 4 and counts[1] == 1
