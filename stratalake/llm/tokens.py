"""Token ids of a public tokenizer, word by word with bounded caches.

The pre-tokenizer of ``word_bpe_49k.json`` never joins characters across white space, and its normaliser turns white space
into blanks and lower-cases; so the ids of a text are those of its space-separated words in order, and a word that ends
in a letter followed by ASCII punctuation is two pre-tokens.  Most words repeat, all the more without case and
punctuation, which makes tables of ids much cheaper than merging again.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

CACHE_WORDS = 100_000
CACHE_CORES = 200_000
#: A core that ends in an ASCII letter, digit or Latin-1 letter, then one run of punctuation.  Other words are looked up whole.
_MARKS = b".,!?*#$%&;:|"
_CORE_END = re.compile(rb"(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: Words of lower-case ASCII and Latin-1 letters are one pre-token as they are; the model takes them without the other steps.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others the code points from 256 on in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def _raw(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """One table holds words and their pre-tokens, ``cache_words + cache_cores`` at most.

    It has two generations: what is used again moves to the young one, and when that is half the bound, the old one goes
    and the young one becomes old; so what goes hasn't been used for a while.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_cores: int = CACHE_CORES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._encode, self._model = self._tokenizer.encode_batch, self._tokenizer.model.tokenize
        self._symbols = _byte_symbols()
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._most = cache_words + cache_cores

    def _learn(self, words: list[bytes]) -> None:
        """Put ``words``, and the pre-tokens of those that are two, into the young table."""
        known, old, parts = self._young, self._old, []
        for w in words:
            low = w.lower()
            core = low.rstrip(_MARKS)
            if b"<|" in w or b"|>" in w:  # maybe a special token, which is cut out before anything else
                parts.append((w, b""))
            elif len(core) == len(low) or not _CORE_END.search(core):
                parts.append((w if low == w else low, b""))
            else:
                parts.append((core, low[len(core) :]))
        new = []
        for p in {p for pair in parts for p in pair if p and p not in known}:
            ids = old.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        if new:
            model, symbols = self._model, self._symbols
            rest = []
            for x in new:
                if _LETTERS.fullmatch(x):
                    known[x] = _raw([t.id for t in model(x.decode() if x.isascii() else x.decode("latin-1").translate(symbols))])
                else:
                    rest.append(x)
            if rest:
                known.update(zip(rest, (_raw(e.ids) for e in self._encode([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False))))
        for w, (a, b) in zip(words, parts):
            known[w] = known[a] + known[b] if b else known[a]

    def ids(self, text: bytes) -> bytes:
        """The ids of UTF-8 ``text`` as little-endian 32-bit numbers, without special tokens added."""
        words = text.split()  # bytes.split() cuts at [\x20\x09-\x0D] only
        known = self._young
        new = set(words).difference(known)
        if new:
            if 2 * (len(known) + len(new)) > self._most:
                self._old, self._young = known, {}
                known, new = self._young, set(words)
            old = self._old
            again = [w for w in new if w in old]
            known.update((w, old[w]) for w in again)
            new.difference_update(again)
            if new:
                self._learn(list(new))
        return b"".join(map(known.__getitem__, words))


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: the tasks that it runs one after another share its tables."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def forget() -> None:
    """Free the tables; a worker process that turns to other work calls it."""
    _OPEN.clear()
    gc.collect()
