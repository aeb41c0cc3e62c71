"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

Pre-tokens are the words of a text (runs of anything but ASCII white space), each with the mark of a word
start before it. A unigram tokenizer takes the segmentation into pieces with the highest sum of scores. Its
forward pass (best score, and number of pieces, up to each position) depends on the prefix only, so the
distinct pre-tokens of a task go into a trie whose nodes keep them: a prefix that many pre-tokens share is
computed once, and the count at a terminal is the pre-token's. A character that no piece covers costs
UNKNOWN less than the worst piece and counts as its UTF-8 bytes (byte fallback).

Tries live in tasks, so nothing is shuffled; one that passes MAX_NODES is begun anew, and what lies deeper
than MAX_DEPTH in a pre-token is computed without being kept. Neither changes a count.

Scores: a sentencepiece model file gives pieces and scores. Files of BPE kind hold merge ranks in place of
log probabilities; for these, rank r is scored as ln(1 / (r + 2)) (Zipf's law).

Edge cases: null and blank texts have 0 tokens; repeated rows are counted each; other columns are ignored; of segmentations
with equal scores that with the longest last piece counts; a very long word takes memory in proportion to its length, as
a text does; empty tables give empty results.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
UNKNOWN = 10.0
MAX_NODES, MAX_DEPTH, GROUP_BYTES = 1_000_000, 64, 1 << 20


def load_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
    ranks = all(float(s).is_integer() for s in scores.values())
    return {p: log(1 / (2 - s)) for p, s in scores.items()} if ranks else scores


class Pieces:
    """The vocabulary as an automaton: a state is the longest end of what was read that begins a piece."""

    def __init__(self, vocabulary: dict[str, float]):
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN
        goto: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, float]] = {}
        for piece, score in vocabulary.items():
            state = 0
            for c in piece:
                after = goto[state].get(c)
                if after is None:
                    after = goto[state][c] = len(goto)
                    goto.append({})
                state = after
            if piece:
                ends[state] = (len(piece), score)
        self.goto, self.fail = goto, [0] * len(goto)
        #: by state, length and score of every piece that ends there, the longest first
        self.found: list[tuple[tuple[int, float], ...]] = [()] * len(goto)
        level = [*goto[0].values()]
        while level:
            for state in level:
                own = ends.get(state)
                self.found[state] = ((own,) if own else ()) + self.found[self.fail[state]]
                for c, after in goto[state].items():
                    self.fail[after] = self.step(self.fail[state], c)
            level = [after for state in level for after in goto[state].values()]

    def step(self, state: int, c: str) -> int:
        while state and c not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(c, 0)


class PrefixTrie:
    """Forward scores by prefix; counts by pre-token. Nodes are numbers; edges have one table, values one array each."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.counts: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.state, self.score, self.count = array("I", [0]), array("d", [0.0]), array("I", [0])
        self.counts.clear()

    def _forward(self, state: int, c: str, i: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score of the first i characters, of which c is the last, and its number of pieces."""
        best, n, single = -1e300, 0, False
        for length, s in self.pieces.found[state]:
            v = scores[i - length] + s
            if v > best:
                best, n = v, counts[i - length] + 1
            single = length == 1
        if not single and scores[i - 1] + self.pieces.unknown > best:
            best, n = scores[i - 1] + self.pieces.unknown, counts[i - 1] + len(c.encode())
        return best, n

    def insert(self, pre_tokens: list[bytes]) -> dict[bytes, int]:
        """Count the pieces of sorted new pre-tokens; what a pre-token shares with the one before is not walked again.

        Counts are kept, but for very long pre-tokens, whose counts are returned.
        """
        edges, step, long = self.edges, self.pieces.step, {}
        last, nodes, states, scores, counts = "", [0], [0], [0.0], [0]
        for raw in pre_tokens:
            word = MARK + raw.decode()
            i = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                i += 1
            del nodes[i + 1 :], states[i + 1 :], scores[i + 1 :], counts[i + 1 :]
            last = word
            while i < len(word):
                c = word[i]
                i += 1
                after = edges.get(nodes[-1] << 21 | ord(c)) if i <= MAX_DEPTH else None
                if after is None:
                    state = step(states[-1], c)
                    s, n = self._forward(state, c, i, scores, counts)
                    if i <= MAX_DEPTH:
                        after = edges[nodes[-1] << 21 | ord(c)] = len(self.score)
                        self.state.append(state)
                        self.score.append(s)
                        self.count.append(n)
                else:
                    state, s, n = self.state[after], self.score[after], self.count[after]
                nodes.append(after)
                states.append(state)
                scores.append(s)
                counts.append(n)
            (self.counts if len(raw) <= 4 * MAX_DEPTH else long)[raw] = counts[-1]
        return long

    def totals(self, texts: list[list[bytes]]) -> list[int]:
        """The number of pieces of each text, given as its pre-tokens."""
        if len(self.score) > MAX_NODES:
            self.clear()
        known = self.counts
        long = self.insert(sorted(w for w in set().union(*texts) if w not in known))
        if not long:
            return [sum(map(known.__getitem__, t)) for t in texts]
        return [sum(known[w] if w in known else long[w] for w in t) for t in texts]


def _count(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(Pieces(pieces.value))
        for batch in batches:
            words: list[int] = []
            tokens: list[int] = []
            group: list[list[bytes]] = []
            size = 0
            for x in batch.column(1):
                text = x.as_py() or b""
                group.append(text.split())
                words.append(len(group[-1]))
                size += len(text)
                if size >= GROUP_BYTES:
                    tokens += trie.totals(group)
                    group, size = [], 0
            tokens += trie.totals(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: dict[str, float]) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens), one per row of docs(doc_id, text). The vocabulary is broadcast; it is bounded
    by its file."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_count(shared), "doc_id long, n_words long, n_tokens long")
