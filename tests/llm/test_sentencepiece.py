import hashlib
import random

import pytest

from narrata.llm import sentencepiece_bpe as P
from narrata.llm.queries import piece_model

ODD = ["", "a", "  a  b ", "héllo\nx\t y", "▁x▁", "日本語 ☃ 𝄞", "\xa0x", "\u0000a", "ﬁ①", "<s> <0x41>", "\r\n", "     ", "a" * 300, " " * 100, "abab" * 200]


@pytest.fixture(scope="module")
def tool():
    return P.tokenizer(piece_model())


def test_merges_equal_the_library(tool):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("abcde  \n▁é日𝄞.,") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        segments = [P.SPACE + w for w in tool.words(t)]
        ids = [i for s in segments for i in tool.merge(s)]
        assert ids == tool.library.encode(t), t
        assert ids == [i for x in tool.merge_all(segments) for i in x]
        assert tool.decode(ids) == tool.library.decode(ids)


def test_whole_documents(spark, sf, tool, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        got = sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded) for r in P.encode_decode(docs, piece_model()).collect())
        want = []
        for i, t in texts:
            ids = tool.library.encode(t)
            back = tool.library.decode(ids)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
        assert got == sorted(want)
    assert P.encode_decode(no_docs, piece_model()).count() == 0
