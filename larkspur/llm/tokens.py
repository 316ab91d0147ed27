"""Exact, cached encoding of whole texts with the public byte-pair vocabularies.

A text is cut at ASCII blanks that are certain pre-token boundaries; each distinct chunk is encoded
once per task and its ids are gathered for all its occurrences.  Chunks with characters beyond Latin
letters, and texts with runs of white space, go to the tokenizers library as they are.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-token patterns that the two vocabulary files state.
_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FOLDED = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Marks of a chunk that starts a line or text, and of a whole text; private-use characters, which plain chunks can't hold otherwise.
_MARK, _WHOLE = "\ue000", "\ue001"
_PLAIN_FOLDED = re.compile("[!-~\xa1-ɏ]+")
_PLAIN_BLANKS = re.compile(f"{_MARK}?[!-~\xa1-ɏ]+")
#: Texts with white space that isn't a single inner blank or line end, or with the marks.
_ODD = r"[ \n][ \n]|[ \n]\z|\A[ \n]|[\t\r\x0b\x0c\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{e000}\x{e001}]"
#: Texts where a comma or full stop may be part of a longer piece.
_JOINED_STOP = r"(?:\A|[^\pL\pN])[,.]|[,.][^\s\pL\pN]"
#: Texts whose folding may turn a letter into a letter and a mark; whether stops are joined is told after it.
_UNFOLDED = r"[\x{130}\x{250}-\x{10ffff}]"
#: Distinct chunks kept per task; beyond, the cache starts anew (results do not depend on it).
CACHE = 600_000


def _byte_table() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def vocabulary_path(name_or_path: str) -> str:
    """A path as it is, or the place of a file of the installed public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class _Codes(dict):
    """chunk -> code; unknown chunks get the next code and are noted."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, chunk):
        code = self[chunk] = len(self)
        self.pending.append(chunk)
        return code


class Encoder:
    """encode(texts) -> (flat uint32 ids, offsets), equal to the library's encode(add_special_tokens=False).

    Chunks not seen before are encoded together, in one call over their concatenation: by the merge
    ranks of the same vocabulary file, which the tests hold against the library on whole texts.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # two families: blanks belong to the following word, or blanks are dropped, case is folded and words carry an end mark
        self.keeps_blanks = spec["normalizer"] is None
        byte = {c: b for b, c in _byte_table().items()}
        end = spec["model"]["end_of_word_suffix"] or ""
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                marked = end and token.endswith(end)
                ranks[bytes(byte[c] for c in (token[: -len(end)] if marked else token)) + b"\x00" * bool(marked)] = i
        self.pieces = regex.compile(_BLANKS if self.keeps_blanks else _FOLDED)
        self.core = tiktoken.Encoding("own", pat_str=_BLANKS if self.keeps_blanks else "[^\\x00\n]+\\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self.line_id = ranks[b"\n"]
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.flat = np.zeros(0, np.uint32)
        self.lens = np.zeros(0, np.int64)

    def _add_pending(self) -> None:
        chunks = self.codes.pending
        if not chunks:
            return
        plain, odd = [], []
        is_plain = (_PLAIN_BLANKS if self.keeps_blanks else _PLAIN_FOLDED).fullmatch
        for k, c in enumerate(chunks):
            (plain if is_plain(c) else odd).append(k)
        if self.keeps_blanks:
            joined = "\n".join([c[1:] if c[0] == _MARK else " " + c for c in [chunks[k] for k in plain]])
        else:
            joined = "\n".join([chunks[k] for k in plain])
            joined = "\n".join(["\x00".join([*self.pieces.findall(line), ""]) for line in joined.lower().split("\n")])
        ids = np.asarray(self.core.encode_ordinary(joined), np.uint32)
        seps = np.flatnonzero(ids == self.line_id)
        lens = np.zeros(len(chunks), np.int64)
        if plain:
            lens[plain] = np.diff(np.concatenate([[-1], seps, [len(ids)]])) - 1
        ids = np.delete(ids, seps)
        if odd:
            upto = np.concatenate([[0], np.cumsum(lens)])
            parts, at = [], 0
            for k in odd:
                text = chunks[k]
                if self.keeps_blanks and text != "\n":
                    text = text[1:] if text[0] in (_MARK, _WHOLE) else " " + text
                got = self.library.encode(text, add_special_tokens=False).ids
                parts += [ids[at : upto[k]], np.asarray(got, np.uint32)]
                at = upto[k]
                lens[k] = len(got)
            ids = np.concatenate([*parts, ids[at:]])
        self.flat = np.concatenate([self.flat, ids])
        self.lens = np.concatenate([self.lens, lens])
        chunks.clear()

    def _text_codes(self, text: str, odd: bool, joined: bool) -> list[int]:
        """Codes of a text's chunks; where commas and full stops stand alone, they are chunks of their own."""
        codes = self.codes
        if not self.keeps_blanks:
            text = text.replace("\n", " ")
            if not joined:
                text = text.replace(",", " ,").replace(".", " .")
            return [codes[c] for c in text.split(" ") if c]
        if not text:
            return []
        if odd:  # the whole text is one chunk
            return [codes[_WHOLE + text]]
        if not joined:
            text = text.replace(",", " " + _MARK + ",").replace(".", " " + _MARK + ".")
        # marked: no blank before it; a line end stands for itself; else the chunk follows a blank
        return [codes[c] for c in (_MARK + text.replace("\n", " \n " + _MARK)).split(" ")]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > CACHE:
            self._reset()
        parts: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, _ODD).to_pylist() if self.keeps_blanks else [False] * len(texts)
        if not self.keeps_blanks:
            fold = self.library.normalizer.normalize_str
            unfolded = pc.match_substring_regex(column, _UNFOLDED).to_pylist()
            if any(unfolded):
                column = pa.array([fold(t) if u else t for t, u in zip(texts, unfolded, strict=True)], pa.string())
        joined = pc.match_substring_regex(column, _JOINED_STOP).to_pylist()
        for k, t in enumerate(texts):
            parts += self._text_codes(t, odd[k], joined[k])
            ends[k + 1] = len(parts)
        self._add_pending()
        code = np.asarray(parts, np.int64)
        starts = np.cumsum(self.lens) - self.lens
        n = self.lens[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.repeat(starts[code] - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[ends]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def forget() -> None:
    """Lets go of this worker's encoders and what they have cached."""
    _ENCODERS.clear()
