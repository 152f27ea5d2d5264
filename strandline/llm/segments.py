"""Whole texts through the tokenizers library, each different stretch between safe cuts only once."""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Stretches of more characters are met again too seldom to be remembered.
LONG = 64
#: Marks of one character that are a pre-token by themselves after a letter.
MARKS = ".,;:!?"
#: Byte-level vocabularies write bytes as printable characters: fixed values of the format.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[int, str]:
    others = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


def latin(word: str) -> bool:
    """Only characters below U+0100, where case and normal forms go character by character."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 text that byte-level pre-tokens never cross: before a space or line end with other than white space after it.

    A space goes with what follows it; a line end is a pre-token by itself, as is all white space before either.
    """
    places = np.flatnonzero(((data[:-1] == 0x20) | (data[:-1] == 0x0A)) & (data[1:] > 0x20))
    wide = np.flatnonzero(data[places + 1] >= 0x80)
    a, b, c = (data[np.minimum(places[wide] + i, len(data) - 1)] for i in (1, 2, 3))
    # U+0085, U+00A0; U+1680, U+3000; U+2000 to 200A, 2028, 2029, 202F; U+205F.
    white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | ((a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80)) & (c == 0x80)
    white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.delete(places, wide[white])


class Vocabulary:
    """A tokenizer of the library, and ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: A text that holds a special or added token in whatever case is the library's own, as a whole.
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.letters = byte_letters()

    def packed(self, ids: list[int]) -> bytes:
        numbers = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, core: str, lead: str = "") -> bytes:
        """A word of Latin letters, as one pre-token."""
        spelt = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        return self.packed([token.id for token in self.model.tokenize(lead + spelt)])


class ColumnEncoder(Vocabulary):
    """For byte-level vocabularies, where a pre-token takes the space before it along.

    All texts are cut at once where no pre-token crosses, and each different stretch, with the space or
    line end it begins with, is looked up once. Latin words, marks after them or not, go to the library's
    model, other stretches through its whole pipeline. ``room`` bounds the stretches remembered.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        super().__init__(path)
        self.known: dict[str, bytes] = {"": b""}
        self.line_end = self.whole("\n")
        #: Runs of ASCII marks between a word and white space: a pre-token each.
        self.runs: dict[str, bytes] = {"": b""}
        self.room = room

    def run(self, marks: str) -> bytes:
        found = self.runs.get(marks)
        if found is None:
            found = self.whole(marks)
            if len(marks) < 8 and len(self.runs) < 10_000:
                self.runs[marks] = found
        return found

    def learn(self, stretches: list[str]) -> None:
        known, space, rest = self.known, self.letters[0x20], []
        for stretch in stretches:
            first = stretch[0]
            word = stretch[1:] if first == " " or first == "\n" else stretch
            core, marks = word, ""
            if not word.isalpha():
                core = word.rstrip(string.punctuation)
                marks = word[len(core) :]
                if not marks or not core.isalpha():
                    rest.append(stretch)
                    continue
            if not (core.isascii() or latin(core)):
                rest.append(stretch)
                continue
            found = known.get(stretch[: -len(marks)]) if marks else None
            if found is None:
                found = self.word(core, space) if first == " " else self.line_end + self.word(core) if first == "\n" else self.word(core)
            known[stretch] = found + self.run(marks) if marks else found
        if rest:
            for stretch, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                known[stretch] = self.packed(found.ids)

    def encode(self, texts: pa.StringArray, end: bytes = b"") -> tuple[bytes, np.ndarray]:
        """The texts' ids one after another, ``end`` behind each text's, and the bytes where each text's begin, and the last's end."""
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if at[0] == at[-1]:
            return end * len(texts), np.arange(len(texts) + 1) * len(end)
        places, last = cuts(np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]), np.zeros(at[-1] - at[0], bool)
        # What follows a text's last character is the next text.
        last[at[1:] - 1 - at[0]] = True
        places = places[~last[places]].astype(np.int32) + at[0]
        if self.added is not None and (odd := [i for i, text in enumerate(texts.to_pylist()) if self.added.search(text)]):
            places = places[~np.isin(np.searchsorted(at, places, "right") - 1, odd)]
        # After each text an empty stretch, for the end.
        offsets = np.sort(np.concatenate([at[:-1], at[1:], places, at[-1:]]), kind="stable")
        begins = np.searchsorted(places, at) + 2 * np.arange(len(at))
        coded = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), texts.buffers()[2]).dictionary_encode()
        stretches, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        codes[begins[1:] - 1] = len(stretches)

        known = self.known
        found = list(map(known.get, stretches))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        new = [stretches[i] for i in gaps]
        self.learn(new)
        for i, stretch in zip(gaps, new):
            found[i] = known[stretch]
        full = len(known) > self.room
        for stretch in new:
            if full or len(stretch) > LONG:
                del known[stretch]
        joined = pa.array([*found, end], pa.binary()).take(pa.array(codes))
        return joined.buffers()[2].to_pybytes(), np.frombuffer(joined.buffers()[1], np.int32)[begins].astype(np.int64)


class SegmentEncoder(Vocabulary):
    """For vocabularies that drop white space and case: every space is a cut.

    Plain Latin words go to the library's model at once, other stretches through its whole pipeline.
    ``room`` bounds the stretches remembered.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        super().__init__(path)
        self.known: dict[str, bytes] = {"": b""}
        self.marks = {mark: self.whole(mark) for mark in MARKS}
        self.room = room

    def learn(self, words) -> None:
        """Add the ids of the words to the known ones."""
        known, rest = self.known, []
        for word in words:
            mark = word[-1:] if word[-1:] in self.marks else ""
            core = word[:-1] if mark else word
            if core.isalpha() and (core.isascii() or latin(core)):
                found = known.get(core) if mark else None
                known[word] = (self.word(core.lower()) if found is None else found) + (self.marks[mark] if mark else b"")
            else:
                rest.append(word)
        if rest:
            for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                known[word] = self.packed(found.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        known, get, out, added = self.known, self.known.get, [], []
        for text in texts:
            if self.added is not None and self.added.search(text):
                out.append(self.whole(text))
                continue
            part = (text.lower().replace("\n", " ") if latin(text) else text).split(" ")
            found = list(map(get, part))
            if None in found:
                gaps = [i for i, f in enumerate(found) if f is None]
                new = dict.fromkeys(map(part.__getitem__, gaps))
                self.learn(new)
                added += new
                for i in gaps:
                    found[i] = known[part[i]]
            out.append(b"".join(found))
            if len(known) > self.room:
                for word in added:
                    known.pop(word, None)
                added = []
        return out


@lru_cache(maxsize=2)
def segment_encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(path)


@lru_cache(maxsize=2)
def column_encoder(path: str) -> ColumnEncoder:
    return ColumnEncoder(path)
