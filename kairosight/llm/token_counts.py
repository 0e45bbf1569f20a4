"""Token counts by count-only Viterbi.

A unigram vocabulary gives each piece a score, and a text is cut into pieces of the greatest total.  An
Aho-Corasick automaton reports, end by end, every piece that ends there, longest first; the state of an
end carries the best score and the number of pieces, and nothing is traced back.  Only the states of the
last few places are held, so one very long word needs no more memory than a short one.

Ties follow the `tokenizers` library's unigram model: among equal totals the piece that starts first wins;
a character without a piece of its own may be unknown, at the lowest score less ten, tried last; unknown
neighbours fuse, and what has no piece counts one token for each of its bytes.

The text is prefixed with the word mark, and spaces become word marks.  When no piece has a mark after
another character, words are independent and a memo of words serves.  The default vocabulary is the pieces and
scores of a public sentencepiece file.

Defined cases: a null or empty text has no tokens; repeated rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, words

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words kept with their counts in a worker; beyond it the memo starts anew, results stay the same.
MEMO = 500_000


def load(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece file; by default the public one of this machine."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Best score and number of tokens of texts; unk: the id of the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], unk: int = 0):
        import ahocorasick

        self.pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.longest = max(map(len, self.pieces))
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk))
        self.automaton.make_automaton()
        self.independent = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(tokens, score) of one stretch of text.

        The state at an end: score, tokens before a run of unknowns, where that run starts (-1: none), its bytes.
        """
        ring, pieces = self.longest + 1, self.pieces
        states: list[tuple[float, int, int, int]] = [(0.0, 0, -1, 0)] * ring
        if not text:
            return 0, 0.0

        def tokens(state, end):
            _, n, run, size = state
            if run < 0:
                return n
            return n + (1 if end - run <= self.longest and text[run:end] in pieces else size)

        matches = self.automaton.iter(text)
        at, found = next(matches, (-1, None))
        for last, char in enumerate(text):
            end, best, single = last + 1, None, False
            while at == last:
                length, score, is_unknown = found
                before = states[(end - length) % ring]
                single |= length == 1
                if best is None or before[0] + score > best[0]:
                    if is_unknown:
                        run = before[2]
                        size = len(text[end - length : end].encode())
                        best = (before[0] + score, before[1], run if run >= 0 else end - length, (before[3] if run >= 0 else 0) + size)
                    else:
                        best = (before[0] + score, tokens(before, end - length) + 1, -1, 0)
                at, found = next(matches, (-1, None))
            if not single:
                before = states[last % ring]
                if best is None or before[0] + self.unknown > best[0]:
                    run = before[2]
                    best = (before[0] + self.unknown, before[1], run if run >= 0 else last, (before[3] if run >= 0 else 0) + len(char.encode()))
            states[end % ring] = best
        return tokens(states[len(text) % ring], len(text)), states[len(text) % ring][0]

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        split = [self._words(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set().union(*split):
            if w not in memo:
                memo[w] = self.word(w)
        get = memo.__getitem__
        out = []
        for s in split:
            found = list(map(get, s))
            out.append((sum(n for n, _ in found), sum((x for _, x in found), 0.0)))
        return out

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _WORD.findall(marked) if self.independent else [marked]


_WORD = re.compile(f"{MARK}+[^{MARK}]*", re.DOTALL)
_counters: dict[str | None, Counter] = {}
runtime.remembers(_counters.clear)


def counter(path: str | None = None) -> Counter:
    """This process's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(load(path))
    return _counters[path]


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and score (of the best cut) of each row of docs; one narrow pass."""

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text", words.PIECE):
            found = counter(path).count([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return runtime.map_batches(read, run, "doc_id bigint, n_tokens bigint, score double")


def query(docs: DataFrame) -> DataFrame:
    """Counts of all rows with the public vocabulary."""
    return count(docs)
