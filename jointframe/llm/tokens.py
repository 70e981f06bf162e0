"""Word-wise encoding of whole texts by a public tokenizer.

The tokenizer drops white space and never merges across it, so a text's ids are
those of its words one after the other. Each distinct word of a slice of texts
is encoded once and kept; texts are put together by array indexing.
"""

from __future__ import annotations

import re
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from jointframe.llm.common import ranges, split_words

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Pieces kept by a worker; beyond it the store starts anew.
KEPT_PIECES = 400_000
_PLAIN = re.compile(r"[!-~\t\n\r]*")
#: Fixed value: the pre-tokenizer's pattern, for printable ASCII after lower-casing.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Marks that end words; as letters are no part of such a piece, they can be cut off.
_MARKS = ".,;:!?"
#: Letters of ASCII and Latin-1, each composed and with a lower case of its own or none, and marks behind them.
_LETTERS_MARKS = "^(?P<head>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[.,;:!?]*)$"
_EXTENDED, _DOTTED = "\u0250", "\u0130"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves, the others as letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _letters(word: str, low: str) -> bool:
    """True for letters only whose lower case and composed form are beyond doubt."""
    return low.isalpha() and (word.isascii() or (max(word) < _EXTENDED and _DOTTED not in word and is_normalized("NFC", word)))


def _listed(values: pa.Array) -> list:
    """The values of an array without nulls; quicker than ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.others: dict[str, tuple[int, ...]] = {}
        sample = ["Ab, c", "Ab,", "c", "Ñé. ü", "Ñé.", "ü"]
        got = self.plain(sample)
        if got[0] != got[1] + got[2] or got[3] != got[4] + got[5] or [self.word(w) for w in ("Ab,", "Ñé.")] != [got[1], got[4]]:
            raise ValueError("this tokenizer keeps white space; it can't be used by word")

    def plain(self, texts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> tuple[int, ...]:
        if (ids := self.pieces.get(piece)) is None:
            form = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = self.pieces[piece] = tuple([t.id for t in self.model.tokenize(form)])
        return ids

    def word(self, word: str) -> tuple[int, ...] | None:
        """Ids of a word by its pieces; None if it takes the whole tokenizer."""
        low = word.lower()
        if _letters(word, low):
            return self.piece(low)
        head = low.rstrip(_MARKS)
        if _letters(word.rstrip(_MARKS), head):
            return self.piece(head) + self.piece(low[len(head) :])
        if "\n" in word:
            parts = [self.word(p) for p in word.split("\n")]
            return None if None in parts else tuple(chain.from_iterable(parts))
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return tuple(chain.from_iterable(map(self.piece, _PIECES.findall(low))))
        return self.others.get(word)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words one after the other, how many each has)."""
        for kept in (self.pieces, self.others):
            if len(kept) > KEPT_PIECES:
                kept.clear()
        # Most words are letters with marks behind: they are cut side by side, and each distinct run of letters is looked up once.
        cut = pc.extract_regex(words, _LETTERS_MARKS)
        heads = pc.utf8_lower(pc.struct_field(cut, "head")).dictionary_encode()
        tails = pc.struct_field(cut, "tail").dictionary_encode()
        others = np.flatnonzero(cut.is_null().to_numpy(zero_copy_only=False))
        rest, texts, whole = [], _listed(words.take(pa.array(others, pa.int64()))), []
        for i, w in enumerate(texts):
            whole.append(self.pieces.get(w) or self.word(w))
            if whole[i] is None:
                rest.append((i, w))
        for (i, w), ids in zip(rest, self.plain([w for _, w in rest]), strict=True):
            whole[i] = self.others[w] = ids
        # A word is two of these, a run of letters and marks, or one and nothing.
        runs = _listed(heads.dictionary)
        known = [ids or self.piece(p) for ids, p in zip(map(self.pieces.get, runs), runs, strict=True)]
        parts = [*known, *(self.piece(t) if t else () for t in _listed(tails.dictionary)), *whole, ()]
        first, of_heads, of_tails = len(parts) - 1, len(heads.dictionary), len(tails.dictionary)
        pairs = np.full((len(words), 2), first, np.int64)
        for column, (x, base) in enumerate(((heads, 0), (tails, of_heads))):
            pairs[:, column] = pc.fill_null(x.indices, first - base).to_numpy(zero_copy_only=False).astype(np.int64) + base
        pairs[others, 0] = of_heads + of_tails + np.arange(len(others))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.uint32, int(sizes.sum()))
        own = sizes[pairs]
        return flat[ranges((np.cumsum(sizes) - sizes)[pairs].ravel(), own.ravel())], own.sum(1).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, place of each text's first id and the total at the end)."""
        # Line ends are white space like any other; words on both sides of one are seldom met again as a pair.
        words, which, first = split_words(pc.replace_substring(texts, "\n", " "))
        flat, sizes = self.lookup(words)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        lengths = sizes[which] if len(sizes) else np.zeros(0, np.int32)
        bounds = np.zeros(len(which) + 1, np.int32)
        np.cumsum(lengths, out=bounds[1:])
        ids = flat[np.repeat(starts[which] - bounds[:-1], lengths) + np.arange(bounds[-1], dtype=np.int32)] if len(sizes) else flat
        return ids, bounds[first].astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
