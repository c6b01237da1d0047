"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton gives, for each place where pieces end, those pieces, longest first. The best score and piece
count up to every place are carried along; a later candidate replaces an earlier one only if its score is greater, so of
equal paths the one with the longer last piece stays, as in the tokenizers library's Unigram model. A character that is no
piece is unknown, at 10 below the least score: it counts as its UTF-8 bytes with byte fallback, else a run of them as one.

Where no piece holds a space mark after another character and all scores are whole numbers (so sums don't depend on their
order), best paths never cross such marks and a text's words are counted one by one, each distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from chronofold.llm.common import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers; more begin a new memory.
MEMORY = 200_000


class Counter(dict):
    """chunk -> (score, pieces)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.byte_fallback = byte_fallback
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {piece for piece, _ in pieces if len(piece) == 1}
        self.by_word = all(float(score).is_integer() and abs(score) < 1 << 30 for _, score in pieces) and not any(MARK in piece.lstrip(MARK) for piece, _ in pieces)

    def __missing__(self, chunk: str) -> tuple[float, int]:
        if len(self) >= MEMORY:
            self.clear()
        self[chunk] = found = self.count(chunk)
        return found

    def count(self, text: str) -> tuple[float, int]:
        n = len(text)
        score, pieces, low = [0.0] + [float("-inf")] * n, [0] * (n + 1), float("-inf")
        if self.singles.issuperset(text):
            for end, (length, gain) in self.automaton.iter(text):
                now = score[end + 1 - length] + gain
                if now > score[end + 1]:
                    score[end + 1], pieces[end + 1] = now, pieces[end + 1 - length] + 1
            return score[n], pieces[n]
        unknown_at, done = [False] * (n + 1), 0

        def settle(upto: int) -> None:
            """Places done+1..upto have all their pieces: unknown characters come last, as the shortest candidates."""
            nonlocal done
            while done < upto:
                done += 1
                char = text[done - 1]
                now = score[done - 1] + self.unknown
                if char not in self.singles and (score[done] == low or now > score[done]):
                    score[done], unknown_at[done] = now, True
                    pieces[done] = pieces[done - 1] + (len(char.encode()) if self.byte_fallback else not unknown_at[done - 1])

        for end, (length, gain) in self.automaton.iter(text):
            settle(end)
            now = score[end + 1 - length] + gain
            if score[end + 1] == low or now > score[end + 1]:
                score[end + 1], pieces[end + 1], unknown_at[end + 1] = now, pieces[end + 1 - length] + 1, False
        settle(n)
        return score[n], int(pieces[n])

    def total(self, text: str) -> tuple[float, int]:
        """Of a whole text: spaces become marks, with one more in front; an empty text has no pieces."""
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.count(marked)
        words, score, pieces = marked.split(MARK), 0.0, 0
        chunk = ""
        for word in words[1:]:
            chunk += MARK  # marks in a row stay with the word after them
            if word:
                gained, more = self[chunk + word] if len(word) < 64 else self.count(chunk + word)
                score, pieces, chunk = score + gained, pieces + more, ""
        if chunk:
            gained, more = self[chunk] if len(chunk) < 64 else self.count(chunk)
            score, pieces = score + gained, pieces + more
        return score, pieces


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, score). Null and empty texts have no tokens and score 0. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model_file))
        for batch in slices(batches):
            found = [counter.total(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
