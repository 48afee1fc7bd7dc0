"""Public tokenizers over units cut at safe boundaries, with a bounded cache of units.

A boundary is safe where the tokenizer never forms a token across it, so that the ids of a text are those of its units,
one after the other. Both vocabulary kinds used here cut at white space: the word kind drops it, the byte kind begins a
token at a lone space or line end between two other characters. Texts that have other white space, or white space in a
row, keep the stretch around it as one unit for the library. Special tokens contain no white space, so none is cut. Units
of more than `LONG` characters are cut again where an ASCII letter meets an ASCII digit: both kinds part them there. A run
of letters without such a place is one unit at any length, since a token may begin anywhere in it.

Caches are bounded in number and, as units of more than `LONG` characters are not kept, in bytes.
"""

import json
import os
import re
import sys
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A word of letters with marks behind it: two runs that the pre-tokenizers of both kinds never join. Other words go to the library whole.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|()\-]*)")


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()
#: Characters of a unit up to which it is cached and never cut.
LONG = 256
SAFE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def spelled(word: str) -> str:
    return word if word.isascii() and word.isalpha() else "".join(map(LETTERS.__getitem__, word.encode()))


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


BOUNDARY = re.compile(r"(?<=[!-~])(?= [!-~])")
#: In an ASCII text: white space in a row, and white space that is neither a space nor a line end.
ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")


def lone_spaces(text: str) -> bool:
    """Whether lone spaces and line ends between other characters are all the white space of a text with any character."""
    if text.isascii():
        return text[:1] not in " \n" and text[-1:] not in " \n" and not any(x in text for x in ODD)
    return text.split() == text.replace("\n", " ").split(" ")


class Units(dict):
    """Ids of units, as little-endian unsigned 32-bit bytes, by unit. Two generations of at most `most` units bound its memory."""

    def __init__(self, encoder, prefix: str = "", most: int = 100_000):
        self.encoder, self.prefix, self.most, self.old = encoder, prefix, most, {}

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit)
        if out is None:
            out = self.encoder.ids_of(self.prefix, unit)
        if len(unit) > LONG:
            return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = out
        return out


class Lengths:
    """Numbers of tokens of units, encoded in batches. Two generations of at most `most` units bound its memory."""

    def __init__(self, encoder, most: int = 200_000):
        self.encoder, self.most, self.known, self.old = encoder, most, {}, {}

    def of(self, units: list[str]) -> list[int]:
        """The length of each unit; what isn't known yet goes to the library as one batch."""
        out = list(map(self.known.get, units))
        if None in out:
            found = {}
            fresh = {u for u, n in zip(units, out) if n is None}
            for u in fresh & self.old.keys():
                found[u] = self.old[u]
            new = list(fresh - found.keys())
            found.update(zip(new, self.encoder.lengths(new)))
            out = [found[u] if n is None else n for u, n in zip(units, out)]
            if len(self.known) + len(found) > self.most:
                self.old, self.known = self.known, {}
            self.known.update((u, n) for u, n in found.items() if len(u) <= LONG)
        return out


class Encoder:
    """Ids of whole texts by a tokenizers file, equal to `Tokenizer.encode(text, add_special_tokens=False).ids`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the steps before the model, as the library states them; the file itself, with its vocabulary, is not parsed here
        state = lambda step: json.loads(step.__getstate__()) if step is not None else None
        before, pre = state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer)
        steps = json.dumps([before, pre])
        #: word: white space is dropped; byte: a space opens the next token.
        self.word = '"Removed"' in steps and '"Lowercase"' in steps
        self.byte = before is None and (pre or {}).get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added):
            self.word = self.byte = False
        self.cuts = (self.word or self.byte) and not any(SAFE.search(t.content) for t in added)
        self.model = self.tokenizer.model
        self.first, self.next, self.sizes = Units(self), Units(self, " "), Lengths(self)
        self.lines = self.whole("\n") if self.byte else b""

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def lengths(self, units: list[str]) -> list[int]:
        """The number of tokens of each unit by one call of the library's batch encoder."""
        if not any(len(u) > LONG for u in units) or not self.cuts:
            return [len(e) for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]
        parts = [SAFE.split(u) if len(u) > LONG else [u] for u in units]
        sizes = iter([len(e) for e in self.tokenizer.encode_batch([x for p in parts for x in p], add_special_tokens=False)])
        return [sum(next(sizes) for _ in p) for p in parts]

    def ids_of(self, prefix: str, unit: str) -> bytes:
        if len(unit) > LONG and self.cuts and len(parts := SAFE.split(unit)) > 1:
            return self.ids_of(prefix, parts[0]) + b"".join(self.ids_of("", x) for x in parts[1:])
        if unit.isascii() and unit.isalpha():
            letters = unit
        else:
            plain = PLAIN.fullmatch(unit)
            if not plain:
                return self.whole(prefix + unit)
            letters, marks = plain.groups()
            if marks:
                return (self.next if prefix else self.first)[letters] + self.first[marks]
        letters = (LETTERS[32] if prefix else "") + spelled(letters.lower() if self.word else letters)
        return packed([t.id for t in self.model.tokenize(letters)])

    def pieces(self, text: str) -> list[bytes]:
        """The ids of a text, in stretches."""
        if self.word:
            return list(map(self.first.__getitem__, ascii_words(text)))
        if not self.byte:
            return [self.whole(text)] if text else []
        if lone_spaces(text):
            out: list[bytes] = []
            first, then, end = self.first.__getitem__, self.next.__getitem__, self.lines
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(first(words[0]))
                out.extend(map(then, words[1:]))
                out.append(end)
            out.pop()
            return out
        return [self.whole(part) for part in re.split(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)", text) if part]

    def ids(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def counts(self, texts: list[str], chunk: int = 1 << 20) -> list[int]:
        """The number of tokens of each text. Units of all texts go through one batch; a text of more than `chunk` characters
        is taken in stretches that end at safe boundaries."""
        out = []
        if not self.word:
            for text in texts:
                out.append(sum(len(self.ids(part)) // 4 for part in stretches(text, chunk, self.byte)))
            return out
        for text in texts:
            if len(text) > chunk:
                out.append(sum(sum(self.sizes.of(ascii_words(part))) for part in stretches(text, chunk, True)))
            else:
                out.append(None)
        words = [ascii_words(text) if n is None else [] for text, n in zip(texts, out)]
        sizes = iter(self.sizes.of([w for own in words for w in own]))
        return [sum(next(sizes) for _ in own) if n is None else n for own, n in zip(words, out)]


def stretches(text: str, size: int, cuts: bool):
    """Parts of a text that end at a safe boundary after about `size` characters: a lone space between other characters."""
    at = 0
    while cuts and len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def ascii_words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
