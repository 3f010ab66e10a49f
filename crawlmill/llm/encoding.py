"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once while a worker remembers it.

A byte-level vocabulary's pre-tokens never run from a character that is not white space into a blank, and a blank
between two others belongs to what follows. So a text may be cut before every blank that follows a character which is
not white space, around single line feeds, and before a full stop or comma after a letter or digit; its ids are the ids
of the pieces in order.
"""

from __future__ import annotations

import re
from array import array

import regex

from crawlmill.llm.common import Memory, hold_alone

#: Fixed by the vocabulary: where a byte-level tokenizer cuts before its merges.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a worker remembers of pieces and their ids, and of those without special tokens; characters cut at a time.
MEMORY_BYTES, PLAIN_MEMORY_BYTES, STEP = 48 << 20, 128 << 20, 1 << 18
#: Words looked up between two turns of what a worker remembers of words.
STEP_WORDS = 1 << 16
#: Texts with characters from here on are cut by the library's own pattern, whose version of Unicode differs.
_OLD = "\u0220"
#: Where the cuts below would part what belongs together: neighbouring white space, odd white space, and a full stop or
#: comma after other than a letter or digit. Each is looked for by what is quick to find.
_WHITE_PAIRS = ("  ", " \n", "\n ", "\n\n", "\x01")
_ODD_WHITE, _ODD_STOP = re.compile(r"[^\S \n]"), re.compile(r"[.,](?<=[\W_].)")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for the letters from U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def segments(text: str, size: int = STEP) -> list[str]:
    """The text in parts of about `size` characters, each cut before a blank that follows no white space."""
    out, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class Inseparable(Exception):
    """A word ends in white space, which may run on into the blank after it."""


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit integers, from the file of a byte-level BPE tokenizer.

    With `plain`, special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added and not plain else None
        self.split = regex.compile(BYTE_LEVEL_SPLIT).findall
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[ord(" ")]
        self.merge = self.tokenizer.model.tokenize
        self.stored = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.pieces = Memory(self._piece, PLAIN_MEMORY_BYTES if plain else MEMORY_BYTES)
        self.words = Memory(self._word, PLAIN_MEMORY_BYTES if plain else MEMORY_BYTES)

    def _merged(self, spelt: str) -> bytes:
        """Ids of one pre-token, spelt in the vocabulary's letters, by the library's own model."""
        return b"".join([self.stored[t.id] for t in self.merge(spelt)])

    def _spelt(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        core = piece[1:] if piece[:1] == " " else piece
        if core.isascii() and core.isalpha():
            return self._merged(piece.replace(" ", self.blank))
        if max(piece, default="") < _OLD:  # letters and digits up to here are the same in every version of Unicode
            if core.isalpha():
                return self._merged(self._spelt(piece))
            if not (self.special and self.special.search(piece)):
                return b"".join([self._merged(self._spelt(w)) for w in self.split(piece)])
        return array("I", self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # of ASCII letters
            return self._merged(self.blank + word.decode())
        text = word.decode()
        if text.isalpha():
            return self._piece(" " + text)
        if text[-1] in ".," and text[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[text[-1]]
        if text[-1].isspace():
            raise Inseparable
        return b"".join(map(self._piece, self._cut(" " + text)))

    def forget(self) -> None:
        self.pieces.forget()
        self.words.forget()

    @staticmethod
    def _cut(text: str) -> list[str]:
        if any(map(text.__contains__, _WHITE_PAIRS)) or _ODD_WHITE.search(text) or _ODD_STOP.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").replace(",", "\x01,").replace(".", "\x01.").split("\x01")

    def _segment(self, text: str) -> bytes:
        self.pieces.turn()
        return b"".join(map(self.pieces.__getitem__, self._cut(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self._segment, segments(t))) for t in texts]

    def _joined(self, words: list[bytes]) -> bytes:
        parts = []
        for i in range(0, len(words), STEP_WORDS):
            self.words.turn()
            parts.append(b"".join(map(self.words.__getitem__, words[i : i + STEP_WORDS])))
        return b"".join(parts)

    def encode_words(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts given by their words in UTF-8 (none empty, none with a blank), each after a blank."""
        out = []
        for words in texts:
            try:
                out.append(self._joined(words))
            except Inseparable:
                out += self.encode([" " + b" ".join(words).decode()])
        return out


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, until another stage takes the worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = PieceEncoder(path, plain)
    hold_alone(_encoders, _encoders.clear)
    return _encoders[path, plain]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
