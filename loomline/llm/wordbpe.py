"""A word-level byte-pair vocabulary: pre-tokens of a text, exact merges by backtracking, and decoding.

The encoder enumerates the tokens in a word with an Aho-Corasick automaton and walks over the longest ones. A token
may follow another only if merging their concatenation gives back just these two, which a table of pairs answers; where
no token may follow, the walk steps back. Every position is closed at most once, so a word takes linear time.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import regex
from tokenizers import Tokenizer

from loomline.llm import worker

#: The vocabulary's pre-token pattern, its end-of-word mark, and its special tokens' ids come from its file.
WORD_END = "</w>"
#: ASCII white space, at which both the normaliser and the pre-tokenizer always end a pre-token.
#: Below it every character is in composed form, and lower case doesn't depend on its neighbours.
_LATIN_END = "\u0250"
_BEYOND_LATIN = re.compile(f"[{_LATIN_END}-\U0010ffff]")
_BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def _latin(name: str) -> str:
    """The characters below _LATIN_END that a regular expression names, for use inside of brackets."""
    known = regex.compile(name)
    return "".join(re.escape(c) for c in map(chr, range(ord(_LATIN_END))) if known.match(c))


def chunks(text: str) -> list[str]:
    """Parts of text between ASCII white space, some of them empty. No pre-token and no composed character crosses one."""
    return text.translate(_BLANKS).split(" ") if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text else text.replace("\n", " ").split(" ")


class Memo(dict):
    """Results of a function by its argument (a str), in about room bytes: what was asked for since the last time that half
    of it was full, and before. Arguments of more than LONGEST characters aren't kept. It bounds memory and nothing else."""

    #: Characters of the longest argument kept, and bytes of an entry beside its argument and value, as measured.
    LONGEST, ENTRY = 64, 110

    def __init__(self, function, room: int):
        super().__init__()
        self.function, self.half = function, room // 2
        self.left, self.before = self.half, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.function(key)
            if len(key) > self.LONGEST:
                return value
        self.left -= self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.left < 0:
            self.before, self.left = dict(self), self.half
            self.clear()
        self[key] = value
        return value


class Offsets:
    """Pieces in one buffer, each with a blank behind it, and the places where they begin: ids become text by copying."""

    def __init__(self, pieces: list[str]):
        raw = [p.encode() + b" " for p in pieces]
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)
        self.start = np.cumsum([0] + [len(r) for r in raw])

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """UTF-8 of each run of ids (which end at ends), one blank between pieces."""
        first = self.start[ids]
        length = self.start[ids.astype(np.int64) + 1] - first
        upto = np.cumsum(length)
        at = np.arange(upto[-1] if len(upto) else 0)
        at += np.repeat(first - (upto - length), length)
        out = memoryview(self.buffer[at].tobytes())
        edges = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(edges, edges[1:])]


class WordBpe:
    """Encodes and decodes with a vocabulary file of the tokenizers library's format whose tokens carry word ends."""

    def __init__(self, path: str, room: int = 80 << 20):
        """room: bytes of the caches of words, parts and pairs together; it bounds memory only."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max(max(vocab.values()), *self.special.values())
        pieces = [""] * n
        for piece, i in chain(vocab.items(), self.special.items()):
            pieces[i] = piece
        self.size, self.pieces, self.decimals = n, Offsets(pieces), Offsets([str(i) for i in range(n)])
        parts = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            pattern = pattern.replace(name, _latin(name))
        self.pattern = (regex if r"\p" in pattern else re).compile(pattern)
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.most_pairs = room // 8 // 100
        self._load(vocab, spec["model"]["merges"])
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.library = Tokenizer.from_file(path)
        self.letter_byte = {c: b for b, c in enumerate(_byte_letters())}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokens = Memo(lambda word: array(self.code, self.encode_word(word)).tobytes(), room * 3 // 4)
        self.parts = Memo(self.encode_chunk, room // 8)

    def _load(self, vocab: dict[str, int], merges: list) -> None:
        base = len(vocab) - len(merges)
        letters = sorted(vocab, key=vocab.get)[:base]
        # One private character for each base symbol, with and without the end of a word.
        symbol = {s: chr(0xE000 + k) for k, s in enumerate(letters)}
        byte_letter = _byte_letters()
        self.inner = [symbol[byte_letter[b]] for b in range(256)]
        self.last = [symbol[byte_letter[b] + WORD_END] for b in range(256)]
        spelled: list[str] = [""] * len(vocab)
        for s in letters:
            spelled[vocab[s]] = symbol[s]
        self.left, self.right = list(range(len(vocab))), list(range(len(vocab)))
        self.joined: dict[int, int] = {}  # left * base + right
        self.base = len(vocab)
        for merge in merges:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.left[k], self.right[k], self.joined[i * self.base + j] = i, j, k
            spelled[k] = spelled[i] + spelled[j]
        self.length = [len(s) for s in spelled]
        ids = {s: k for k, s in enumerate(spelled)}
        #: The longest token that is a proper prefix of each token.
        self.shorter = [next((ids[s[:m]] for m in range(len(s) - 1, 0, -1) if s[:m] in ids), -1) for s in spelled]
        self.automaton = ahocorasick.Automaton()
        for s, k in ids.items():
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's spelling end in a and b. Token ids rise in the order of the merges."""
        key = a * self.base + b
        known = self.fits.get(key)
        if known is not None:
            return known
        bound, good, joined, base = self.base, True, self.joined, self.base
        while True:
            # A merge across the border that comes before those still undone would have taken place.
            if joined.get(a * base + b, bound) < bound:
                good = False
                break
            undo_left = a > b
            for _ in range(2):
                whole = a if undo_left else b
                part = self.right[a] if undo_left else self.left[b]
                if part != whole:
                    break
                undo_left = not undo_left
            else:
                break
            if undo_left:
                bound, a = a, part
            else:
                bound, b = b + 1, part
        if len(self.fits) >= self.most_pairs:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The merges of one pre-token, which isn't empty."""
        raw = word.encode(errors="surrogateescape")
        inner = self.inner
        s = "".join([inner[b] for b in raw[:-1]]) + self.last[raw[-1]]
        n = len(s)
        longest = [-1] * n
        length, shorter = self.length, self.shorter
        for end, k in self.automaton.iter(s):  # ends rise, so a longer match overwrites a shorter one
            longest[end + 1 - length[k]] = k
        open_at, out, at, token = [True] * (n + 1), [], 0, longest[0]
        while True:
            end = at + length[token]
            if open_at[end] and (not out or self._may_follow(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing may start here: step back to the token before and shorten it
                open_at[at] = False
                before = out.pop()
                at -= length[before]
                token = shorter[before]

    def _pre_tokens(self, part: str) -> list[str]:
        if part.isascii() or not _BEYOND_LATIN.search(part):
            return self.pattern.findall(part.lower())
        # Beyond Latin letters, Unicode's version matters: ask the library itself.
        got = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.letter_byte.__getitem__, word)).decode(errors="surrogateescape") for word, _ in got]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text without ASCII white space, as bytes of self.dtype."""
        out = []
        for k, part in enumerate(self.at_special.split(chunk) if "<" in chunk else (chunk,)):
            if k % 2:
                out.append(array(self.code, [self.special[part]]).tobytes())
            else:
                out += [self.tokens[word] for word in self._pre_tokens(part)]
        return b"".join(out)

    def _words(self, text: str) -> list[str] | None:
        """The pre-tokens of a text that is all Latin and has no special token; None of any other."""
        if not text.isascii() and _BEYOND_LATIN.search(text) or "<" in text and self.at_special.search(text):
            return None
        return self.pattern.findall(text.lower())

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the tokenizers library gives them without special tokens added."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for text in texts:
            words = self._words(text)
            known = map(self.parts.__getitem__, chunks(text)) if words is None else map(self.tokens.__getitem__, words)
            out.append(np.frombuffer(b"".join(known), self.dtype))
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids for a vocabulary without a decoder: its pieces, one space between them."""
        return bytes(self.pieces.joined(np.asarray(ids, self.dtype), np.array([len(ids)]))[0]).decode()


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself where Latin-1 prints it, the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class LibraryWords(WordBpe):
    """The same ids, with each distinct pre-token encoded by the tokenizers library's model."""

    def encode_word(self, word: str) -> tuple[int, ...]:
        spelled = word.encode(errors="surrogateescape").decode("latin-1").translate(self.letters)
        return tuple([token.id for token in self.library.model.tokenize(spelled)])

    def _load(self, vocab: dict[str, int], merges: list) -> None:
        """The library has its own tables."""
        self.letters = dict(enumerate(_byte_letters()))


def load(path: str, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """One vocabulary for each worker process."""
    return worker.keep("words", (kind, path), lambda: kind(path))
