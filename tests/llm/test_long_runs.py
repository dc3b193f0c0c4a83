"""Packing of texts with long runs of one kind of character."""

from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
RUNS = [" ", "\n", "\t", " ", " ", "a", "!", "7", " \t\n", "é", "\x00"]


@pytest.mark.parametrize("run", RUNS)
def test_ids_are_the_tokenizers(run):
    encode, slow = packing.encoder(PATH), Tokenizer.from_file(PATH)
    for text in (run * 60_000, "a" + run * 30_000 + "b", "word " * 3000 + run * (packing.RUN - 1) + " end."):
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_texts_of_ten_million_characters_are_packed(spark):
    texts = [" " * 10_000_000, "\n" * 10_000_000, "a" * 3_000_000, "!" * 3_000_000, "one short text."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = packing.packed_digest(packing.pack(docs, PATH)).collect()
    slow = Tokenizer.from_file(PATH)
    for k, text in enumerate(texts):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 0], np.uint32)
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(r["ids_crc32"] == crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own[:50])
