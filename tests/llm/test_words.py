import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\t\n\x0bé.", max_size=40)), max_size=12)


def split(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


@given(texts, st.integers(1, 4))
def test_words_and_shingles(rows, size):
    want = [split(t) for t in rows]
    got = [[] for _ in rows]
    sets = [set() for _ in rows]
    for s in words.slices(pa.array(rows, pa.string())):
        for i, j, d in zip(s.start, s.end, s.doc):
            got[s.first + d].append(bytes(s.data[i:j]))
        doc, h = words.distinct_shingles(s, size)
        for d, x in zip(doc.tolist(), h.tolist()):
            sets[s.first + d].add(x)
    assert got == want
    grams = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for w in want]
    assert [len(x) for x in sets] == [len(x) for x in grams]
    assert [[len(a & b) for b in sets] for a in sets] == [[len(a & b) for b in grams] for a in grams]


def test_slices_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    rows = ["aaa bbb ccc ddd eee", "f", "", None, "g h"]
    found = [(s.first, s.n_docs, s.counts().tolist()) for s in words.slices(pa.array(rows))]
    assert sum(n for _, n, _ in found) == 5
    assert sum((c for _, _, c in found), []) == [5, 1, 0, 0, 2]
