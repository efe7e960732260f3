"""Decontamination of repeated and null ids does not depend on the number of blocks."""

import pytest

from tessera.llm import decontaminate


@pytest.mark.parametrize("block", [40, 60])
def test_many_blocks_return_the_rows_of_one(spark, odd_docs, block):
    more = spark.createDataFrame([(5, "word1 word2 word3 other"), (None, "word7 word8 word9"), (None, None)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    items = [(1, "WORD3 word4, word5"), (1, "WORD3 word4, word5"), (2, "word7 word8"), (3, "word30 word31 word32"), (4, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    one = decontaminate.verdicts(docs, bench)
    many = decontaminate.verdicts(docs, bench, block_words=block)
    assert many.columns == one.columns and rows(many) == rows(one) and len(rows(one)) == 14
