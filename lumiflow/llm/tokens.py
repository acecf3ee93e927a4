"""Token ids by a public tokenizer file, whole texts, with a bounded cache of pieces."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .shared import held

#: Bounds of the cache: entries of each of two generations, and characters of a piece that is kept. Pieces in one call.
GENERATION, LONG_PIECE, AT_ONCE = 700_000, 48, 2000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_white_space(spec: dict) -> bool:
    """True if text can be cut at blanks and line ends without a change of ids.

    That holds where the first pre-tokenizer keeps only matches of a pattern whose every
    alternative is free of white space, after normalizers that never join two characters
    across a blank (NFC, white space folding, lower case).
    """
    def parts(x, key):
        return x[key] if x and x.get("type") == "Sequence" else [x] if x else []

    norms = parts(spec.get("normalizer"), "normalizers")
    pres = parts(spec.get("pre_tokenizer"), "pretokenizers")
    fine = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in norms)
    first = pres[0] if pres else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    own = pattern.replace(r"[^\s\p{L}\p{N}]+", "").replace(r"[\p{L}]+", "").replace(r"[\p{N}]", "")
    bare = all(c not in own for c in "\\[]. ")
    added = all(" " not in t["content"] and "\n" not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return fine and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and bare and bool(pattern) and added


#: A point or comma at the end of a run whose last character before it isn't a letter.
_TAIL = re.compile(r"(?<![a-zß-öø-ÿ])[.,] ")


def _runs(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """Runs between blanks. In Latin-1 texts (their own normal form) they are lower-cased, and where
    every point or comma before a blank follows a letter it is a run of its own, as it is a pre-token.
    Texts that lower case would give more ``special`` tokens, which are matched before it, stay as they are."""
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    low = text.lower()
    if any(low.count(t) != text.count(t) for t in special):
        return text.split(" ")
    text = low
    if not _TAIL.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


def encoder(path: str) -> Encoder:
    return held(f"tokens {path}", lambda: Encoder(path))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the library's ``encode(text, add_special_tokens=False)``.

    Words recur, so each distinct run between blanks is encoded once and kept.  New runs shed
    a tail of punctuation (a pre-token of its own after a letter) and ASCII capitals, and words
    of letters alone are encoded together: each ends in the one token with the end-of-word
    suffix, by which the ids are parted.  Two generations bound the cache: the older is
    dropped when the younger is full.  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = drops_white_space(spec)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.final = np.zeros(self.vocabulary, dtype=bool)
        suffix = self.tokenizer.model.end_of_word_suffix if self.by_piece else None
        if suffix:
            self.final[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """As ``_raw``, by one call for all words; only for words of letters."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(words) or not len(ids) or ends[-1] != len(ids):
            return self._raw(words)
        raw = ids.tobytes()
        hi = (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *hi[:-1]], hi, strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Put ids of pieces into the cache."""
        cut = {}
        words, odd = set(), []
        for p in new:
            old = self.older.get(p)
            if old is not None:
                self.cache[p] = old
                continue
            word = p.rstrip(".,;:!?")
            if word.isascii():
                word = word.lower()
            if word.isalpha() and len(p) <= LONG_PIECE:
                cut[p] = word, p[len(word) :] if word.isascii() or len(word) < len(p) else ""
                words.add(word)
            else:
                odd.append(p)
        words.difference_update(self.cache)
        fresh = list(words)
        for call, pieces in ((self._words, fresh), (self._raw, odd)):
            for i in range(0, len(pieces), AT_ONCE):
                part = pieces[i : i + AT_ONCE]
                self.cache.update(zip(part, call(part), strict=True))
        tails = list({t for _, t in cut.values()}.difference(self.cache))
        self.cache.update(zip(tails, self._raw(tails), strict=True))
        for p, (word, tail) in cut.items():
            self.cache[p] = self.cache[word] + self.cache[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [t or "" for t in texts]
        if not self.by_piece:
            return self._raw(whole)
        if len(self.cache) > GENERATION:
            self.cache, self.older = {"": b""}, self.cache
        cut = [_runs(t, self.special) for t in whole]
        new = set().union(*cut).difference(self.cache) if cut else set()
        self._learn(new)
        get = self.cache.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONG_PIECE:
                del self.cache[p]
        return out
