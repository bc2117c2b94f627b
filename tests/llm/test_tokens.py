import os

import pytest

from lectern.llm import tokens as K

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(K.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)
TEXTS = ["", None, "Hello world", "<|endoftext|> is text", "don't  \n\n tabs\t x", "日本語のテキスト", "😀👩‍🏫 e\u0301", "a" * 30_000, "ก" * 5000, "  ", "\u00a0\u200b", "x" * 50 + " " * 70, "1234567890" * 40, "MiXeD_case-snake/slash"]


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.read_ranks(K.VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(K.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_librarys(encoder, reference):
    v, o = encoder.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert v[o[i] : o[i + 1]].tolist() == reference(t), t


def test_round_trip(encoder):
    words = {i: w for w, i in encoder.ranks.items()}
    v, o = encoder.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert b"".join(words[x] for x in v[o[i] : o[i + 1]].tolist()).decode() == (t or "")


def test_hash_is_minimal_and_perfect(encoder):
    keys = list(encoder.ranks)
    assert sorted(encoder.mph.places(keys).tolist()) == list(range(len(keys)))
    assert all(encoder.merge(w).tolist() == [i] for w, i in list(encoder.ranks.items())[::37])


def test_rows(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "q", "x"), (2, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = K.encode(df).collect()
    assert len(got) == len(TEXTS) + 2
    assert all(r["ids"] == reference(TEXTS[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    assert K.encode(df.limit(0)).count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, "doc_id").collect()}
    assert n[0] == n[1] == 0 and n[2] == 2
