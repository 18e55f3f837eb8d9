"""Packing of texts that hold an added token's content."""

import zlib
from array import array

from palimpsest.llm import packing


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["<|endoftext|>", "one, two <|endoftext|> three. Four", "no<|endoftext|>space, and more", "a <|endoftext| > b, c", "plain, words"]
    assert 50256 in t.encode(texts[1], add_special_tokens=False).ids
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.tokenizer_path()).collect()
    ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == [(i, len(x), zlib.crc32(array("I", x).tobytes())) for i, x in enumerate(ids)]
