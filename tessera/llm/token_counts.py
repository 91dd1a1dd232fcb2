"""Token counts under a unigram vocabulary, by a Viterbi search that keeps only scores and counts.

An Aho-Corasick automaton over the vocabulary reports every piece ending at each character, longest
first; for each end the best score and its piece count are kept, nothing else. The rules are those of
the unigram model of the ``tokenizers`` library behind a Metaspace splitter:

* spaces become U+2581, one is put before a text that doesn't start with one, and a text is cut before each of them;
* a longer last piece is met first, and a later one wins only with a strictly higher score;
* where no piece of one character covers a character, an unknown edge of ``min score - 10`` does,
  considered after the pieces that end there; runs of unknown characters are fused, and count as
  their UTF-8 bytes (byte fallback) or, without byte pieces, as one token.

Segments recur, so their counts are remembered, in a table of bounded size per task; a segment that isn't in it
is counted anew. A null or empty text has 0 tokens. Texts are read whole; of a segment without spaces, however long, only as many positions are held as the longest piece spans.
Rows that repeat each get their row, a null id stays null, an empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 1 << 19


def load_vocabulary(model_file: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and unigram log-probabilities of a sentencepiece file, and whether it has byte pieces.

    The file at hand stores merge ranks, not probabilities; a piece of rank r gets Zipf's
    -ln((r + 1) * H), H being the harmonic sum. Pieces without a rank (runs of spaces) aren't used.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    ranked = [(sp.id_to_piece(i), -sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and sp.get_score(i) > -1e8]
    harmonic = math.fsum(1 / (r + 1) for _, r in ranked)
    return [(p, -math.log((r + 1) * harmonic)) for p, r in ranked if MARK not in p[1:]], any(sp.is_byte(i) for i in ids)


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool, remembered: int = REMEMBERED):
        self.vocabulary, self.byte_fallback, self.remembered = vocabulary, byte_fallback, remembered
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.memory: dict[str, int] = {}

    def __getstate__(self) -> tuple:
        return self.vocabulary, self.byte_fallback, self.remembered

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def segment(self, text: str) -> int:
        """Tokens of one segment (no cut inside). As many positions are held as the longest piece spans, and matches as they come."""
        n = len(text)
        ring = min(n, self.longest) + 1
        best = [-math.inf] * ring
        count = [0] * ring
        fused = [False] * ring  # does the best path to here end in an unknown character?
        best[0] = 0.0
        matches = self.automaton.iter(text) if self.vocabulary else iter(())
        match = next(matches, None)
        for end in range(1, n + 1):
            top, tokens, unknown = -math.inf, 0, False
            while match is not None and match[0] == end - 1:
                length, score = match[1]
                at = (end - length) % ring
                here = best[at] + score
                if here > top:
                    top, tokens = here, count[at] + 1
                match = next(matches, None)
            char, at = text[end - 1], (end - 1) % ring
            if char not in self.single and best[at] + self.unknown > top:
                top, unknown = best[at] + self.unknown, True
                tokens = count[at] + (len(char.encode("utf-8", "replace")) if self.byte_fallback else not fused[at])
            at = end % ring
            best[at], count[at], fused[at] = top, tokens, unknown
        return count[n % ring]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.replace(" ", MARK).split(MARK) if MARK in text else text.split(" ")
        if not parts[0]:
            del parts[0]  # the text starts with a mark of its own
        total, memory = 0, self.memory
        for part in parts:
            n = memory.get(part)
            if n is None:
                n = self.segment(MARK + part)
                if len(memory) < self.remembered and len(part) < 64:
                    memory[part] = n
            total += n
        return total


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(UnigramCounter(*load_vocabulary(model_file)))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for b in batches:
            counts = np.fromiter((counter.count(t.as_py()) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
