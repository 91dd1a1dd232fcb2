"""Plans and packed documents against a packing piece by piece, and ids against the tokenizers library."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.encoding import Encoder
from tessera.llm.packing import pack, plan, sequences

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


def plainly(items, capacity):
    """Sequences that the same method needs, one piece at a time."""
    large, gaps = sorted(x for x in items if 3 * x > capacity), []
    n = 0
    while large:
        a = large.pop()
        i = bisect.bisect_right(large, capacity - a) - 1
        gaps.append(capacity - a - (large.pop(i) if i >= 0 else 0))
        n += 1
    gaps.sort()
    for x in sorted((x for x in items if 3 * x <= capacity), reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            n += 1
            gap = capacity
        else:
            gap = gaps.pop(i)
        bisect.insort(gaps, gap - x)
    return n


def check(places, capacity):
    """Sequences are numbered without holes, their pieces lie side by side from 0."""
    inside = defaultdict(list)
    for sequence, offset, length in places:
        inside[sequence].append((offset, length))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(inside) == list(range(len(inside)))
    return len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.sampled_from([60, 61, 64, 90]))
def test_plan(items, capacity):
    runs, n = plan(Counter(items), capacity)
    ranks, places = Counter(), []
    for length, rank, rows, sequence, each, offset in runs.tolist():
        assert rank == ranks[length]
        ranks[length] += rows
        places += [(sequence + i // each, offset + i % each * length, length) for i in range(rows)]
    assert ranks == Counter(items)
    assert check(places, capacity) == n == plainly(items, capacity)


def test_large_pieces_are_matched_as_well_as_can_be():
    r = random.Random(3)
    for _ in range(40):
        items = sorted(r.randint(34, 100) for _ in range(9))

        def best(rest):
            if not rest:
                return 0
            first, others = rest[-1], rest[:-1]
            return 1 + min([best(others), *(best([*others[:i], *others[i + 1 :]]) for i, x in enumerate(others) if x + first <= 100)])

        assert plan(Counter(items), 100)[1] == best(items)


def test_plan_of_a_large_corpus_is_small():
    runs, n = plan({length: 10**9 + length * 7919 % 1000 for length in range(1, 4097)}, 4096)
    assert len(runs) < 20_000
    assert n < 1.001 * sum(length * (10**9 + length * 7919 % 1000) for length in range(1, 4097)) / 4096


ODD = [*"aAbz .,'<>|\n\t#09", "é", "É", "́", "İ", "ß", "€", " ", " ", "日本", "😀", "'s", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "≠", "̸", "\x1c", "\x85", "ﬁ", "\x00", "Σ", "K"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(ODD), max_size=30).map("".join), st.text(max_size=30)), min_size=1, max_size=6))
def test_ids(encoder, texts):
    assert encoder.by_units
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [i.tolist() for i in encoder.documents(pa.array(texts))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_and_other_files(encoder):
    texts = [None, "", "ab, Cd" * 200_000, "x" * 600_000, "é ü <|endoftext|>" * 30_000, "one two"]
    assert [i.tolist() for i in encoder.documents(pa.array(texts))] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_units
    assert [i.tolist() for i in other.documents(pa.array(["a  bc, d", None]))] == [other.tokenizer.encode("a  bc, d", add_special_tokens=False).ids, []]


def test_table_that_is_too_small(encoder, monkeypatch):
    monkeypatch.setattr("tessera.llm.encoding.MOST_KEPT", 50)
    monkeypatch.setattr("tessera.llm.encoding.TABLE_BITS", 4)
    small = Encoder(FILE)
    r = random.Random(1)
    texts = [" ".join(f"w{r.randint(0, 99)}x" for _ in range(40)) for _ in range(50)]
    for text in texts:
        assert next(small.documents(pa.array([text]))).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pack(spark, encoder):
    r = random.Random(2)
    texts = [" ".join("word" for _ in range(r.choice([0, 1, 3, 20, 31, 32, 33, 40, 63, 64, 65, 200]))) for _ in range(300)]
    texts += ["same text"] * 200 + [None, "", "long " * 3000]  # one length has a good part of all pieces
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, length int, rank string").repartition(6)
    packed = pack(docs, FILE, capacity=64, end=1, keep_ids=True)
    got = packed.collect()
    want = Counter()
    for i, t, *_ in [*rows, rows[5], rows[5]]:
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want[i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids)) for x in got) == want
    n = check([(x.sequence_id, x.offset, x.length) for x in got], 64)
    assert n == plainly([x.length for x in got], 64)
    made = {x.sequence_id: x for x in sequences(packed).collect()}
    assert len(made) == n
    for x in got:
        assert made[x.sequence_id].ids[x.offset : x.offset + x.length] == x.ids
    assert all(len(x.ids) == sum(x.lengths) <= 64 for x in made.values())


def test_empty(spark):
    packed = pack(spark.createDataFrame([], "doc_id string, text string"), FILE)
    assert packed.count() == 0
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "tag"]
