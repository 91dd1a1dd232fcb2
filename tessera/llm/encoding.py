"""Token ids of whole texts under a word-level BPE file of the ``tokenizers`` library, by units that are encoded once.

The file's own splitter never joins what ASCII white space parts, nor an ASCII letter and ASCII punctuation (but the apostrophe), so
a text's ids are those of its units in order. Units are hashed a slice of texts at a time and looked up in a table of
bounded size; the library encodes the rest, all of a slice in one call. A text with ``<|``, which may hold the name of a special token,
is encoded by its words as they stand. Files with another splitter, or texts that aren't split, are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.words import SLICE_BYTES, Slice, mix, slices

# The splitter and normaliser that the rule of units holds for.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]

TABLE_BITS = 20
LONGEST_KEPT = 64  # ids of a unit that is kept
MOST_KEPT = 1 << 24  # ids in the table, after which it is begun anew
CALL = 1 << 14  # words or units given to the library at once

_KIND = np.zeros(256, np.uint8)  # 1: letters, 2: punctuation but the apostrophe
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2


def split_further(s: Slice) -> Slice:
    """Words cut between ASCII letters and ASCII punctuation."""
    kind = _KIND[s.data]
    cut = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    begins = np.zeros(len(s.data) + 1, bool)
    begins[s.start] = True
    cut = cut[~begins[cut]]
    if not len(cut):
        return s
    start, end = np.sort(np.concatenate([s.start, cut])), np.sort(np.concatenate([s.end, cut]))
    return Slice(s.first, s.n_docs, s.data, start, end, s.doc[np.cumsum(begins[start]) - 1])


class Encoder:
    def __init__(self, model_file: str):
        from tokenizers import Tokenizer

        with open(model_file, encoding="utf-8") as f:
            self.content = f.read()
        self.tokenizer = Tokenizer.from_str(self.content)
        rules = json.loads(self.content)
        normal = rules.get("normalizer") or {}
        splitters = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_words = bool(splitters) and splitters[0].get("pattern", {}).get("Regex") == SPLITTER and splitters[0].get("invert") and splitters[0].get("behavior") == "Removed"
        special = [t["content"] for t in rules.get("added_tokens", [])]
        self.by_units = bool(by_words) and [n.get("type") for n in normal.get("normalizers", [])] == NORMALISERS and all(t.startswith("<|") and not t.split()[1:] for t in special)
        self._clear()

    @classmethod
    def of(cls, content: str) -> Encoder:
        """From the file's content, as it travels to the tasks; one for each worker and content, so that its table serves all its tasks."""
        key = hash(content)
        if key not in _encoders:
            import tempfile

            with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as f:
                f.write(content)
                f.flush()
                _encoders[key] = cls(f.name)
        return _encoders[key]

    def _clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.at = np.zeros(1 << TABLE_BITS, np.int64)
        self.size = np.zeros(1 << TABLE_BITS, np.int64)
        self.kept = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _asked(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(parts), CALL):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(parts[i : i + CALL], add_special_tokens=False)]
        return out

    def _keep(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Appends ids to those kept: their places and sizes."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        if self.used > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(max(self.used, 2 * len(self.kept)) - len(self.kept), np.uint32)])
        if len(ids):
            self.kept[at[0] : self.used] = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        return at, size

    def _units(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's documents one after the other, and how many are of each document."""
        if self.used > MOST_KEPT:
            self._clear()
        s = split_further(s)
        h = s.hashes()
        h[h == 0] = 1
        shift = np.uint64(64 - TABLE_BITS)
        one, two = (h >> shift).astype(np.int64), (mix(h) >> shift).astype(np.int64)
        slot = np.where(self.keys[one] == h, one, two)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(self.keys[slot] != h)
        if len(new):
            fresh, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            which = new[first]
            raw = s.data.tobytes()
            got = self._asked([raw[a:b].decode("utf-8", "replace") for a, b in zip(s.start[which].tolist(), s.end[which].tolist(), strict=True)])
            found_at, found_size = self._keep(got)
            at[new], size[new] = found_at[back], found_size[back]
            short = found_size <= LONGEST_KEPT
            one, two = one[which], two[which]
            place = np.where((self.keys[one] == 0) | (self.keys[two] != 0), one, two)[short]
            for table, values in ((self.keys, fresh), (self.at, found_at), (self.size, found_size)):
                table[place] = values[short]
        begins = np.cumsum(size) - size
        ids = self.kept[np.repeat(at - begins, size) + np.arange(int(size.sum()))]
        return ids, np.bincount(s.doc, weights=size, minlength=s.n_docs).astype(np.int64)

    def _words(self, text: str) -> np.ndarray:
        """Ids of one text by its words as they stand."""
        words = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()] if self.by_units else [text]
        parts = (self._asked(words[i : i + CALL]) for i in range(0, len(words), CALL))
        return np.concatenate([np.zeros(0, np.uint32), *(np.fromiter((x for i in p for x in i), np.uint32) for p in parts)])

    def _long(self, text: str) -> np.ndarray:
        """Ids of a long text by parts that end at white space."""
        raw, parts, lo = text.encode("utf-8", "replace"), [np.zeros(0, np.uint32)], 0
        while lo < len(raw):
            hi = lo + SLICE_BYTES
            if hi < len(raw):
                space = max(raw.rfind(c, lo, hi) for c in (b" ", b"\n", b"\t"))
                if space <= lo:
                    space = min([x for c in (b" ", b"\n", b"\t") if (x := raw.find(c, hi)) >= 0], default=len(raw))
                hi = max(space, lo + 1)
            parts += [self._units(s)[0] for s in slices(pa.array([raw[lo:hi].decode("utf-8", "replace")], pa.large_string()))]
            lo = hi
        return np.concatenate(parts)

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; of a null text none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        long = np.asarray(pc.greater(pc.binary_length(texts), SLICE_BYTES).to_numpy(zero_copy_only=False), bool)
        whole = np.asarray(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False), bool) if self.by_units else np.ones(len(texts), bool)
        odd = np.flatnonzero(long | whole).tolist()
        lo = 0
        for row in [*odd, len(texts)]:
            if lo < row:
                for s in slices(texts[lo:row]):
                    ids, counts = self._units(s)
                    ends = np.cumsum(counts)
                    yield from (ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True))
            if row < len(texts):
                text = texts[row].as_py()
                yield self._words(text) if whole[row] else self._long(text)
            lo = row + 1


_encoders: dict[int, Encoder] = {}
