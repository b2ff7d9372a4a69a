"""Token counts of a unigram vocabulary without segmenting: Aho-Corasick matches and a best path that carries only a score and a count.

Texts are cut as the tokenizer does it: blanks become U+2581, one is put in front, and a new word begins at each U+2581 (Metaspace with
prefix ``always``). For every end inside a word the automaton names the pieces that end there. The best path to a place keeps the highest
sum of scores and the number of its pieces; on equal sums the earlier start stays, as in the tokenizer, which goes through starts in
order and replaces a path only by a better one. A character that no one-character piece covers may be taken as unknown, at 10 less than
the lowest score; neighbouring unknown characters count as one piece, or as their UTF-8 bytes with ``byte_fallback``.

The vocabulary is a list of (piece, score). ``ranked_pieces`` reads the pieces of a public SentencePiece file in the order of their ids and
gives them the scores of Zipf's law, -log(rank + 1), because the file's own scores are merge ranks. Counts of words are remembered per
Python worker in a table of fixed size, so a frequent word is solved once.

Null and empty texts have no tokens. Whole texts are counted, also a single word of any length. Rows stay row by row: repeated rows and
null ids are counted as they are. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
CACHE_WORDS = 400_000
UNKNOWN_PENALTY = 10.0
_WORST = -math.inf


def ranked_pieces(model_file: str) -> list[tuple[str, float]]:
    """Normal pieces of a SentencePiece model by id, without control, byte and unknown entries, and without runs of blanks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [p for p in pieces if BLANK not in p.lstrip(BLANK) and not p.startswith(2 * BLANK)]
    return [(p, -math.log(rank + 2)) for rank, p in enumerate(pieces)]


class Counter:
    """Piece counts of words by one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.filled = bool(pieces)
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        self.byte_fallback = byte_fallback
        self.known: dict[str, tuple[int, float]] = {}

    def solve(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path through one word. Matches come by rising end, the earliest start first."""
        if not self.single.issuperset(word):
            return self._solve_unknown(word)
        best, count = [_WORST] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for end, (length, score) in self.automaton.iter(word):
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        return count[-1], best[-1]

    def _solve_unknown(self, word: str) -> tuple[int, float]:
        """The same where some character has no piece of its own."""
        size = len(word)
        best, count, unknown = [_WORST] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        best[0] = 0.0
        matches = self.automaton.iter(word) if self.filled else iter(())
        held = next(matches, None)
        for end in range(1, size + 1):
            while held is not None and held[0] == end - 1:
                length, score = held[1]
                total = best[end - length] + score
                if total > best[end]:
                    best[end], count[end] = total, count[end - length] + 1
                held = next(matches, None)
            if word[end - 1] not in self.single:
                total = best[end - 1] + self.unknown
                if total > best[end]:
                    more = len(word[end - 1].encode()) if self.byte_fallback else int(not unknown[end - 1])
                    best[end], count[end], unknown[end] = total, count[end - 1] + more, True
        return count[size], best[size]

    def text(self, text: str) -> tuple[int, float, int]:
        """Pieces, score and words of a text."""
        if not text:
            return 0, 0.0, 0
        text = text.replace(" ", BLANK)
        if text[0] != BLANK:
            text = BLANK + text
        words = text[1:].split(BLANK)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.solve(BLANK + w)
        found = [known[w] for w in words]
        return sum(x[0] for x in found), math.fsum(x[1] for x in found), len(words)


_made: dict[tuple, Counter] = {}


def _counter(model_file: str, byte_fallback: bool) -> Counter:
    key = (model_file, byte_fallback)
    if key not in _made:
        _made[key] = Counter(ranked_pieces(model_file), byte_fallback)
    return _made[key]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_file: str | None = None, pieces: list[tuple[str, float]] | None = None,
                 byte_fallback: bool = False) -> DataFrame:
    """id_col, n_tokens, score, n_words for every row, by the pieces of a file that all executors have, or by a list of them."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        counter = _counter(model_file, byte_fallback) if pieces is None else Counter(pieces, byte_fallback)
        for batch in batches:
            found = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
                                   pa.array([f[2] for f in found], pa.int64())], names=[id_col, "n_tokens", "score", "n_words"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, score double, n_words long")
