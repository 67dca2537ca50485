"""Operator 1: how many tokens a unigram vocabulary makes of each document.

Method: an Aho-Corasick automaton enumerates the vocabulary's pieces in a word; dynamic programming keeps, for each
position, the best score and how many pieces it has. No piece reaches over a word's beginning, so words are counted one
by one and their counts kept. Ties follow the tokenizers library's unigram model: of equal scores, the piece that
starts first wins, which is the longest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import common, worker
from loomline.llm.wordbpe import Memo

#: The mark of a word's beginning, and by how much an unknown character scores below the worst piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
_WORDS = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], room: int = 64 << 20):
        """room: bytes of the cache of words' counts; it bounds memory only."""
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} has a mark behind other characters, so it could join words")
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.counts = Memo(lambda word: self.count_word(word)[0], room)
        self.edges = Memo(self.count_word, room)

    def count_word(self, word: str) -> tuple[int, bool, bool]:
        """Pieces of the best segmentation of a word with its mark, and whether the first and the last of them are unknown.

        An unknown character falls back to its bytes; without pieces for bytes, unknown characters side by side are one.
        """
        n = len(word)
        score, count, starts = [0.0] + [None] * n, [0] * (n + 1), [[] for _ in range(n)]
        unknown = [False] * (n + 1)  # whether the best way to a place ends with an unknown character
        opening = [False] * (n + 1)  # whether it begins with one
        for end, (length, value) in self.automaton.iter(word) if len(self.automaton) else ():
            starts[end + 1 - length].append((end + 1, value))
        for at in range(n):
            here, so_far, opened = score[at], count[at], opening[at]
            single = False
            for end, value in starts[at]:
                single |= end == at + 1
                if score[end] is None or here + value > score[end]:
                    score[end], count[end], unknown[end], opening[end] = here + value, so_far + 1, False, opened
            if not single and (score[at + 1] is None or here + self.unknown > score[at + 1]):
                more = len(word[at].encode()) if self.bytes else int(not unknown[at])
                score[at + 1], count[at + 1], unknown[at + 1], opening[at + 1] = here + self.unknown, so_far + more, True, opened or at == 0
        return count[n], opening[n], unknown[n]

    def count(self, text: str) -> int:
        """A piece may be a run of marks and may begin with one, so words end before marks. A newline is no piece."""
        words = _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if self.bytes:
            return sum(map(self.counts.__getitem__, words))
        total, last = 0, False
        for n, first, end in map(self.edges.__getitem__, words):  # unknown characters join across words as well
            total, last = total + n - (last and first), end
        return total


def load(path: str) -> UnigramCounter:
    return worker.keep("pieces", path, lambda: UnigramCounter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row of docs, whole texts; one narrow pass.

    Blanks count as word marks, one at the beginning added; a null or empty text has 0 tokens. Repeated rows and null
    ids stay; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            n = [counter.count(t or "") for part in common.slices(batch, 1) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
