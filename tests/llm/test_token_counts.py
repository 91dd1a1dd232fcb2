import pytest

from tessera.llm.token_counts import UnigramCounter, load_vocabulary, token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
FILE = public.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "  a  b", "a\nb\t", " x", "日本語 テスト 梦", "\U0001f600\U0001f600 a\U0001f600", "▁a ▁▁b", "aaaa" * 50, "The quick brown fox, über naïve co-operation.", "x" * 5000, "<0x41> <unk> </s>"]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(FILE)


@pytest.mark.parametrize("fallback", [False, True])
def test_against_the_library(vocabulary, fallback):
    pieces, has_bytes = vocabulary
    assert has_bytes
    full = [("<unk>", 0.0), *pieces] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] * fallback
    # byte pieces need a score that leaves the smallest one, and so the unknown edge, as it is
    low = min(s for _, s in pieces)
    full = [(p, low if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else s) for p, s in full]
    model = tokenizers.models.Unigram(full, 0, fallback)
    reference = tokenizers.Tokenizer(model)
    reference.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace()
    counter = UnigramCounter(pieces, fallback)
    for text in TEXTS[:-1]:
        assert counter.count(text) == len(reference.encode(text).ids), text


def test_ties_keep_the_longer_last_piece():
    counter = UnigramCounter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -9.0)], False)
    assert counter.count("aa") == 2  # ▁ aa and ▁ a a are equal; the longer last piece is met first
    assert counter.count(None) == 0
    small = UnigramCounter(counter.vocabulary, False, remembered=1)
    assert [small.count(t) for t in ("a b aa", "b b b", "zz")] == [counter.count(t) for t in ("a b aa", "b b b", "zz")]


def test_table(frame, vocabulary):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (99, None), (0, "again")]
    counter = UnigramCounter(*vocabulary)
    got = token_counts(frame(rows), FILE).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(repr, ((i, counter.count(t)) for i, t in rows)))
    assert token_counts(frame(rows).limit(0), FILE).count() == 0


def test_segments_far_longer_than_any_piece(vocabulary):
    import random

    r = random.Random(4)
    letters = "etaoinshrdlu" * 3 + "qx日é😀"
    full = [("<unk>", 0.0), *vocabulary[0]]
    reference = tokenizers.Tokenizer(tokenizers.models.Unigram(full, 0, False))
    reference.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace()
    counter = UnigramCounter(vocabulary[0], False)
    for n in (1, counter.longest - 1, counter.longest, counter.longest + 1, 20_000):
        text = "".join(r.choice(letters) for _ in range(n))
        assert counter.count(text) == len(reference.encode(text).ids)


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b")], "`a.id` long, `a.text` string")
    assert token_counts(docs, FILE, "a.id", "a.text").collect()[0].doc_id == 1
