"""Byte-level BPE of the ``tokenizers`` library, as small per-worker helpers.

The merges run in ``tiktoken``, from ranks that are read out of the same JSON
file. Both orders of merging agree wherever a whole pre-token either is no
vocabulary string or encodes alone as one token; `unreachable` lists the strings
for which that can't be proved, and texts go to the ``tokenizers`` library if the
file has any. The tests hold the results against that library.
"""

from __future__ import annotations

import json
import logging
from functools import lru_cache

import numpy as np

#: The pre-token pattern of byte-level BPE files, with white space
#: written out, because the engines differ in what \s covers.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_TIKTOKEN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of the library itself."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes of each ordinary token with its id, and the special strings with theirs."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    special = {t["content"]: t["id"] for t in doc["added_tokens"]}
    chars = _byte_chars()
    ranks = {bytes(chars[c] for c in token): i for token, i in doc["model"]["vocab"].items() if token not in special}
    return ranks, special


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """Proof by encoding: strings that encode alone as their one token, and the others with their number of tokens.

    Only vocabulary strings that are valid UTF-8 can ever be a whole pre-token.
    """
    ranks, _ = vocabulary(path)
    texts: list[tuple[str, int]] = []
    for raw, i in ranks.items():
        try:
            texts.append((raw.decode("utf-8"), i))
        except UnicodeDecodeError:
            continue
    proved, other = {}, {}
    for (text, i), enc in zip(texts, library(path).encode_batch([t for t, _ in texts], add_special_tokens=False), strict=True):
        if enc.ids == [i]:
            proved[text] = i
        else:
            other[text] = len(enc.ids)
    return proved, other


@lru_cache(maxsize=4)
def merger(path: str):
    """A ``tiktoken`` encoding with the file's ranks and special strings."""
    import tiktoken

    ranks, special = vocabulary(path)
    return tiktoken.Encoding("from-file", pat_str=_TIKTOKEN_PIECES, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def unreachable(path: str) -> bool:
    """Whether some single pre-token is a vocabulary string that the merges don't reach."""
    import regex

    piece = regex.compile(PIECES)
    return any(piece.fullmatch(t) for t in whole_tokens(path)[1])


def encode(path: str, text: str | None) -> np.ndarray:
    """The ids of a whole text (null: empty) without begin or end ids, as the library gives them."""
    if not text:
        return np.empty(0, np.uint32)
    if not unreachable(path):
        try:
            return merger(path).encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the pattern engine gives up on some extreme texts with a panic, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            logging.getLogger(__name__).warning("a text of %d characters is encoded by the slower library: %s", len(text), e)
    return np.asarray(library(path).encode(text, add_special_tokens=False).ids, np.uint32)


class PieceCounts(dict):
    """Tokens by pre-token: one for each proved whole token, merged and kept for the rest."""

    def __init__(self, path: str, keep: int = 400_000):
        proved, other = whole_tokens(path)
        super().__init__(dict.fromkeys(proved, 1) | other)
        self._merge, self._most = merger(path)._core_bpe.encode_single_piece, keep + len(self)

    def __missing__(self, piece: str) -> int:
        n = len(self._merge(piece.encode("utf-8")))
        if len(self) < self._most:
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def _counting(path: str):
    import regex

    special = vocabulary(path)[1]
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)")
    return regex.compile(PIECES).findall, PieceCounts(path).__getitem__, cut, tuple(special)


def count(path: str, text: str | None) -> int:
    """Number of tokens of a whole text (null: 0): pre-tokens that are proved whole tokens count one each, the rest is merged."""
    if not text:
        return 0
    pieces, of, cut, special = _counting(path)
    if any(s in text for s in special):
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(of, pieces(p))) for p in parts)
    return sum(map(of, pieces(text)))
