"""Counts of greedy longest-match word pieces, in time linear in the text.

The vocabulary is a byte trie.  Each node keeps, for the case that the text leaves the trie there, how
many pieces are then settled (the precomputed popped-token count) and the node where matching goes on
(the failure link).  No piece is ever built: a word's length in pieces is a sum of popped counts.

Vocabularies: with blank marks (a piece that starts a word begins with a blank; all bytes are pieces, so
nothing is unknown) or with continuation marks ("##"; a word that cannot be cut counts as one unknown).

Defined results: null and empty texts have 0 words and 0 tokens; rows with equal or null doc_id stay rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import as_text, rows_with_id
from larkspur.llm.tokens import _byte_table, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Distinct words whose counts a task keeps; beyond, it starts anew (results do not depend on it).
CACHE = 500_000
SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long, max_word_tokens long"


class Automaton:
    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes] | None = None):
        """continuing: the pieces that go on inside a word; None: the same as the initial ones."""
        self.goto: dict[int, int] = {}
        self.final = [False]
        self._insert(0, initial)
        self.again = 0
        if continuing is not None:
            self.again = len(self.final)
            self.final.append(False)
            self._insert(self.again, continuing)
        self._link()

    def _insert(self, root: int, pieces: Iterable[bytes]) -> None:
        goto, final = self.goto, self.final
        for p in pieces:
            u = root
            for c in p:
                v = goto.get(u << 8 | c)
                if v is None:
                    v = goto[u << 8 | c] = len(final)
                    final.append(False)
                u = v
            final[u] = u != root or final[u]

    def _link(self) -> None:
        """Failure links (-1: no cut exists) and popped counts, nearest nodes first."""
        n = len(self.final)
        self.fail, self.popped = [-1] * n, [0] * n
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, v in self.goto.items():
            children[key >> 8].append((key & 255, v))
        layer = [0] if self.again == 0 else [0, self.again]
        while layer:
            after = []
            for u in layer:
                for c, v in children[u]:
                    after.append(v)
                    if self.final[v]:
                        self.fail[v], self.popped[v] = self.again, 1
                        continue
                    z, settled = self.fail[u], self.popped[u]
                    while z >= 0 and (z << 8 | c) not in self.goto:
                        z, settled = self.fail[z], settled + self.popped[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.goto[z << 8 | c], settled
            layer = after

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 of an empty one, 1 of one that cannot be cut."""
        goto, fail, popped = self.goto, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := goto.get(u << 8 | c)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = v
        while u != self.again and word:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


def load_vocabulary(name_or_path: str) -> tuple[Automaton, bytes]:
    """(automaton, mark that goes before each word)."""
    path = vocabulary_path(name_or_path)
    with open(path, encoding="utf-8") as f:
        if not path.endswith(".json"):  # one piece a line, continuation mark "##"
            pieces = [line.rstrip("\n") for line in f]
            return Automaton([p.encode() for p in pieces if p and not p.startswith("##")], [p[2:].encode() for p in pieces if len(p) > 2 and p.startswith("##")]), b""
        spec = json.load(f)
    byte = {c: b for b, c in _byte_table().items()}
    special = {t["content"] for t in spec["added_tokens"]}
    return Automaton([bytes(byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special]), b" "


_LOADED: dict[str, tuple[Automaton, bytes]] = {}


class _Counts(dict):
    def __init__(self, vocabulary: str):
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = load_vocabulary(vocabulary)
        self.automaton, self.mark = _LOADED[vocabulary]

    def __missing__(self, word: str) -> int:
        n = self[word] = self.automaton.count(self.mark + word.encode())
        return n


def token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document (SCHEMA): bytes, words (runs without white space), their pieces, and the most pieces of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        counts = _Counts(vocabulary)
        for b in batches:
            if len(counts) > CACHE:
                counts.clear()
            out = []
            for t in as_text(b.column(1)):
                found = [counts[w] for w in t.split()]
                out.append((len(t.encode()), len(found), sum(found), max(found, default=0)))
            cols = np.asarray(out, np.int64).reshape(-1, 4)
            yield pa.record_batch([b.column(0), *[pa.array(cols[:, k]) for k in range(4)]], names=["doc_id", "n_bytes", "n_words", "n_tokens", "max_word_tokens"])

    return rows_with_id(docs, id_col, text_col).mapInArrow(run, SCHEMA)
