"""Greedy longest-match token counts by an automaton that never builds a piece.

The vocabulary is a trie over bytes.  Every node knows how many pieces are
popped when no child fits (`pops`) and the node where matching then goes on
(`fail`), as in the linear longest-match algorithm for word pieces.  A word is
read once, byte by byte, and only numbers are added up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagetide.llm.shared import batches

#: Words whose counts a worker remembers before it starts afresh.
REMEMBERED = 1 << 19


def pieces_of_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 piece, rank)."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Automaton:
    """Trie with failure links; `count(word)` is the number of pieces greedy longest match takes.

    All pieces may stand anywhere in a word.  A word that cannot be cut into
    pieces counts as one unknown token.
    """

    def __init__(self, pieces: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in set(pieces):
            node = 0
            for byte in piece:
                after = child[node].get(byte)
                if after is None:
                    after = child[node][byte] = len(child)
                    child.append({})
                    whole.append(False)
                node = after
            whole[node] = True
        whole[0] = False
        fail, pops = [-1] * len(child), [0] * len(child)
        level = [0]
        while level:
            following = []
            for node in level:
                for byte, after in child[node].items():
                    following.append(after)
                    if whole[after]:
                        fail[after], pops[after] = 0, 1
                        continue
                    at, popped = fail[node], pops[node]
                    while at >= 0 and byte not in child[at]:
                        popped += pops[at]
                        at = fail[at]
                    if at >= 0:
                        fail[after], pops[after] = child[at][byte], popped
            level = following
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for byte in word:
            while byte not in child[node]:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = child[node][byte]
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


class _Counts(dict):
    """Counts of the words met so far."""

    def __init__(self, automaton: Automaton, mark: bytes):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count(self.mark + word)
        return n


def token_counts(docs: DataFrame, vocabulary: str, mark: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of words and greedy pieces of every text.

    `vocabulary` is the path of a rank file that the driver can read; its
    pieces (a fixed set, about 50,000) go to the executors once.  `mark` stands
    before each word, as pieces that begin a word carry a blank.

    Returns one row per input row: id, n_words, n_tokens, n_bytes (long).  A
    null or empty text has zero of each.  Rows with a null id are counted like
    others.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces_of_ranks(vocabulary))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(shared.value), mark)
        for batch in batches(parts, text_col):
            n_words, n_tokens, n_bytes = [], [], []
            for data in pc.cast(batch.column(text_col), pa.binary()):
                data = data.as_py() or b""
                # bytes.split() parts at exactly the blanks of `shared.BLANKS`
                found = data.split()
                n_words.append(len(found))
                n_tokens.append(sum(map(counts.__getitem__, found)))
                n_bytes.append(len(data))
            yield pa.record_batch([batch.column(id_col), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_bytes))],
                                  names=[id_col, "n_words", "n_tokens", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, n_bytes long")
