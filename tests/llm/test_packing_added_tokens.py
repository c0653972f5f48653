"""Ids of texts that hold an added token are those of the named tokenizer."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from ballotlake.llm import packing


def test_added_tokens_in_texts(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|>\n\n y", "<|endoftext", "plain  text"]
    coder = Tokenizer.from_file(packing.default_tokenizer())
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))
    assert 50256 in coder.encode(texts[0], add_special_tokens=False).ids
