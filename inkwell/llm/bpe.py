"""Byte-level BPE tokenizer files (``.json`` of the tokenizers library) used piece by piece.

A text falls into added-token strings and the stretches between them, a stretch into pre-tokens by
the library's fixed pattern, and each pre-token is merged on its own. So the tokens of a text are
those of its pre-tokens in order, whatever stands around them, and a long text can be read in
blocks cut before a blank between two visible ASCII characters, where a pre-token always ends.

``prove`` runs once, before the job: it finds the vocabulary strings that encode alone as one token,
and the code points that ``regex`` and the library put in different classes (their Unicode versions
differ). What it finds is bounded by the vocabulary and by Unicode, and goes to the tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import regex
from tokenizers import Tokenizer

#: The fixed pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block of a long text, about.
BLOCK = 1 << 20
CUT = re.compile(r"[!-~](?= [!-~])")
#: Pre-tokens remembered by a task, and their greatest length in characters.
REMEMBERED, SHORT = 1 << 18, 64


class Proof(NamedTuple):
    """What tasks need of a tokenizer file. ``whole``: pre-token to the id that it is alone;
    ``odd``: pattern of the code points that need the library's own pre-tokenizer."""

    spec: str
    whole: dict[str, int]
    odd: str


def alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in vocabulary entries."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of every vocabulary entry; an entry outside the alphabet is no byte-level one."""
    byte = {c: b for b, c in alphabet().items()}
    return {i: bytes(byte[c] for c in entry) for entry, i in spec["model"]["vocab"].items() if set(entry) <= set(byte)}


def blocks(text: str, most: int = BLOCK) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut where every pre-token ends."""
    at = 0
    while len(text) - at > most and (cut := CUT.search(text, at + most)):
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def _supported(spec: dict) -> None:
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if (spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix") or model.get("ignore_merges")):
        raise ValueError("the whole-token shortcut is for byte-level BPE files without a normalizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or match by word are not supported")


def _ranges(points: list[int]) -> str:
    """A character class of the code points; one that never matches for none."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]" if out else "(?!)"


def _odd_points(pre) -> list[int]:
    """Code points whose class differs between ``regex`` and the library. All code points of a class
    are laid end to end: where the library cuts such a stretch, its pieces are looked at alone."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd = []
    for sample, kind in (("a", r"\p{L}+"), ("1", r"\p{N}+"), ("", r"\s+"), ("!", r"[^\s\p{L}\p{N}]+")):
        alike = "".join(regex.findall(kind, every))
        for _, (i, j) in pre.pre_tokenize_str(alike):
            part = alike[i:j]
            one = sample + part if sample else f"\n{part}\n"     # joined to one of its class, it stays one piece
            if j - i < len(alike) and [x[1] for x in pre.pre_tokenize_str(one)] != [(0, len(one))]:
                odd += map(ord, part)
    if odd and min(odd) < 256:
        raise ValueError("the library's classes of Latin-1 characters differ from the pattern's")
    return sorted(odd)


def prove(path: str) -> Proof:
    """Read a tokenizer file and prove what the shortcut rests on. Runs on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec, tok = json.loads(text), Tokenizer.from_str(text)
    _supported(spec)
    added = {t["content"] for t in spec["added_tokens"]}
    strings: dict[str, int] = {}
    for i, raw in token_bytes(spec).items():
        try:
            s = raw.decode()
        except UnicodeDecodeError:      # part of a character: never a pre-token
            continue
        if s and not any(a in s for a in added):
            strings[s] = i
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    got = tok.encode_batch(list(strings), add_special_tokens=False)
    whole = {s: i for (s, i), e in zip(strings.items(), got, strict=True) if e.ids == [i]}
    return Proof(text, whole, _ranges(_odd_points(tok.pre_tokenizer)))


def _latin(text: str) -> bool:
    """Whether all code points are below 256, where no class differs (``prove`` checks it)."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _latin_pattern() -> str:
    """``PATTERN`` for texts of code points below 256, its classes spelt out: the plain engine is
    faster on them."""
    def spelt(kind: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(kind, chr(c)))

    letter, number, space = spelt(r"\p{L}"), spelt(r"\p{N}"), spelt(r"\s")
    return (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


class Pieces:
    """The tokenizer inside a task."""

    def __init__(self, proof: Proof, plain_special: bool = False) -> None:
        """``plain_special``: strings of added tokens are ordinary text."""
        spec = json.loads(proof.spec)
        tok = Tokenizer.from_str(proof.spec)
        self._pre, self._model = tok.pre_tokenizer, tok.model
        self._letters = alphabet()
        self._find = regex.compile(PATTERN).findall
        self._find_latin = re.compile(_latin_pattern()).findall
        self._odd = re.compile(proof.odd)
        added = {} if plain_special else {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self._special = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token, by the merges."""
        return [t.id for t in self._model.tokenize("".join(map(self._letters.__getitem__, piece.encode())))]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a stretch without added tokens."""
        if _latin(text):
            return self._find_latin(text)
        if not self._odd.search(text):
            return self._find(text)
        return [text[i:j] for _, (i, j) in self._pre.pre_tokenize_str(text)]

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """(stretch, whether it is an added token's string) in blocks."""
        parts = self._special.split(text) if self._special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part, True
            elif part:
                yield from ((b, False) for b in blocks(part))


class Remembered(dict):
    """A bounded memory of a function of short strings; others are computed each time."""

    def __init__(self, known: dict, function: Callable) -> None:
        super().__init__(known)
        self._room, self._function = len(known) + REMEMBERED, function

    def __missing__(self, key: str):
        value = self._function(key)
        if len(key) <= SHORT and len(self) < self._room:
            self[key] = value
        return value
