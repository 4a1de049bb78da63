"""Token ids of whole texts, each distinct word encoded once and remembered."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import tiktoken

from .token_counts import Splitter, tokenizer

#: Remembered words of one worker; beyond it the memory starts anew.
CACHE = 1_000_000
SPACE = "▁"
#: A space that doesn't stand alone before a word.
ODD = re.compile(r" (?:\s|$)")


class Known(dict):
    """What ``make`` gives for a word, made once."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        self[word] = got = self.make(word)
        return got


def byte_level_twin(tok):
    """A faster twin of a byte-level BPE tokenizer for single pre-tokens in UTF-8, or None.

    Merges by rank need ids that grow with the merges.
    """
    model = json.loads(tok.to_str())["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    byte = byte_letters()
    if made != sorted(made) or any(c not in byte for t in vocab for c in t) or len(vocab) - len(made) != 256:
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelIds:
    """ids of texts by a byte-level tokenizers file, as little-endian 32-bit bytes.

    With ``special`` the strings of special tokens inside a text become those tokens, the
    library's default; without it they are plain text. A space before a word belongs to
    that word's pre-token, so a text whose spaces all stand alone is cut there, and each word
    is encoded once; other texts are cut into pre-tokens as a whole.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tok = tokenizer(path) if special else Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        splitter = Splitter(path)
        self.split = splitter if special else splitter.part
        self.marks = set(splitter.names) if special else set()
        self.whole = not splitter.plain or any(" " in m for m in self.marks)
        self.twin = byte_level_twin(self.tok)
        self.tails = {m: self.piece(m) for m in ".,;:!?"} if not self.whole else {}
        self.known = Known(self.word)

    def piece(self, piece: str) -> bytes:
        if self.twin is None or piece in self.marks:
            return array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()
        return array("I", self.twin(piece.encode())).tobytes()

    def text(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def word(self, word: str) -> bytes:
        """ids of space + word; letters, and one mark behind them, are pre-tokens as they stand."""
        if word.isalpha():
            return self.piece(" " + word)
        if word[-1] in self.tails and (body := word[:-1]).isalpha():
            return self.known[body] + self.tails[word[-1]]
        first, *rest = self.split(" " + word)
        return (self.known[first[1:]] if first[1:].isalpha() else self.piece(first)) + b"".join(map(self.piece, rest))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = Known(self.word)
        text, get, out = self.text, self.known.__getitem__, []
        for t in texts:
            words = None if self.whole or ODD.search(t) else t.split(" ")
            out.append(text(t) if words is None else text(words.pop(0)) + b"".join(map(get, words)))
        return out

    def widths(self) -> np.ndarray:
        """The number of bytes of each id: the vocabulary spells each byte as one letter."""
        out = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)
        return out


class PieceIds:
    """ids of space + text by a sentencepiece model that adds the space itself, as little-endian 32-bit bytes.

    Where no piece has a space behind another character, no merge crosses the place before
    a space, so a text is cut there and each part is encoded once. Other models encode
    whole texts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p in names)
        self.single = array("I", [self.model.piece_to_id(SPACE)]).tobytes()
        self.known: dict[str, bytes] = {}
        self.bad: set[str] = set()

    def parts(self, text: str) -> list[str]:
        """Parts without the space before each."""
        if self.whole:
            return [text]
        parts = text.split(" ")
        return parts if "" not in parts else [p[1:] for p in re.findall(" *[^ ]+| +", " " + text)]

    def joined(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def __call__(self, texts: list[str]) -> list[bytes | None]:
        """None for a text whose tokens don't spell space + text."""
        if len(self.known) > CACHE:
            self.known, self.bad = {}, set()
        known, bad = self.known, self.bad
        parts = [self.parts(t) if t else [] for t in texts]
        new = list(set().union(*parts).difference(known))
        for part, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            known[part] = got = array("I", ids).tobytes() if part else self.single
            if self.joined(got) != (" " + part).encode():
                bad.add(part)
        get, out = known.__getitem__, []
        for text, p in zip(texts, parts, strict=True):
            ids = b"".join(map(get, p))
            out.append(None if bad and not bad.isdisjoint(p) and self.joined(ids) != (" " + text).encode() else ids)
        return out

    def widths(self) -> np.ndarray:
        return np.array([len(b) for b in self.bytes], np.int64)
