"""Byte-level BPE over whitespace-led chunks, for the token counter and the token files.

The pattern of the tokenizer never joins a character that is not white space with
white space after it.  A text cut before each run of white space therefore has the
tokens of its chunks, one after the other, and a chunk needs encoding only once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters with the Unicode property White_Space, for a character class.
WHITE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.compile(f"[{WHITE_CLASS}]")
CHUNK = re.compile(f"[{WHITE_CLASS}]*[^{WHITE_CLASS}]+|[{WHITE_CLASS}]+")
#: White space other than the space and the line end.
RARE = re.compile(r"[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Punctuation that is a pre-token by itself after a letter.
STOPS = ".,;:!?"
#: Letters, then marks that are neither letters, numbers, underscores nor white space.
MARKED = re.compile(r"([^\W\d_]+)([^\w\s]+)\Z")
#: A longer chunk is encoded each time it is met.
LONGEST = 256

_loaded: dict[str, Any] = {}


def tokenizer_path(path: str | None) -> str:
    """``path``, or the place of the public byte-level vocabulary on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str | None):
    """The tokenizer, loaded once in a process."""
    path = tokenizer_path(path)
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def chunkable(path: str | None) -> bool:
    """Whether the tokenizer is of the kind for which chunks are independent."""
    import json

    t = json.loads(load(path).to_str())
    pre = t.get("pre_tokenizer") or {}
    return t["model"]["type"] == "BPE" and t.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not t["model"].get("dropout")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


def plain(text: str) -> bool:
    """Whether the only white space is single spaces and single line ends between words.

    Searches for single characters run at the speed of memory, which a pattern does not.
    """
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not RARE.search(text)
    return "\x85" not in text and "\xa0" not in text


class Misses(dict):
    """A worker's cache of what chunks encode to, in two generations.

    When the young one is full it becomes the old one; what is met again moves back.
    """

    def __init__(self, encode: Callable[[str], Any], most: int) -> None:
        self.encode, self.most = encode, most
        self.old: dict[str, Any] = {}

    def __missing__(self, chunk: str) -> Any:
        value = self.old.get(chunk)
        if value is None:
            value = self.encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value


class Spaced(Misses):
    """Values of words that follow a space: the broadcast tier, and over it the worker's cache.

    The frequent words stay; others age as in ``Misses``.  A word with a line end inside, or
    with a stop after a letter, is the sum of its parts; one of letters alone goes straight
    to the merges.
    """

    def __init__(self, frequent: dict[str, Any], misses: Misses, letters: Callable[[str], Any], stops: dict[str, Any], most: int) -> None:
        super().__init__(letters, most + len(frequent))
        self.frequent = {k[1:]: v for k, v in frequent.items() if k[:1] == " "}
        self.update(self.frequent)
        self.misses, self.stops = misses, stops

    def __missing__(self, word: str) -> Any:
        if "\n" in word:
            first, *rest = word.split("\n")
            value = self[first]
            for x in rest:
                value += self.misses["\n" + x]
            return value
        value = self.old.get(word)
        if value is None:
            if word.isalpha():
                value = self.encode(word)
            elif word[-1:] in self.stops and word[-2:-1].isalpha():
                value = self[word[:-1]] + self.stops[word[-1]]
            else:
                return self.misses[" " + word]
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.old = {k: v for k, v in self.items() if k not in self.frequent}
                self.clear()
                self.update(self.frequent)
            self[word] = value
        return value


class Encoder:
    """Values of whole texts added up from those of their chunks.

    ``of(ids)`` makes a value from token ids; values must add up with ``+``.  A space and
    letters are one pre-token, so such a chunk goes straight to the library's merges.
    """

    def __init__(self, path: str | None, of: Callable[[list[int]], Any], frequent: dict[str, Any], join: Callable[[Any], Any], most: int = 500_000) -> None:
        t = load(path)
        self.whole = lambda s: of(t.encode(s, add_special_tokens=False).ids)
        self.join = join
        self.special = tuple(x.content for x in t.get_added_tokens_decoder().values())
        self.chunks = chunkable(path)
        table, model = byte_letters(), t.model
        space = table[32]

        def letters(word: str) -> Any:
            return of([x.id for x in model.tokenize(space + word.encode().decode("latin-1").translate(table))])

        self.misses = Misses(self.whole, most // 4)
        self.spaced = Spaced(frequent, self.misses, letters, {x: self.whole(x) for x in STOPS}, most)

    def __call__(self, text: str) -> Any:
        if not self.chunks or any(x in text for x in self.special):
            return self.whole(text)
        if not plain(text):
            return self.join(map(self.misses.__getitem__, CHUNK.findall(text)))
        first, *rest = text.split(" ")
        head = first.split("\n")
        return self.join([self.misses[head[0]], *(self.misses["\n" + x] for x in head[1:])]) + self.join(map(self.spaced.__getitem__, rest))


def keeps_apart(tokenizer: Any, space: str) -> bool:
    """Whether no merge has the sign for a space after a letter."""
    import json

    model = json.loads(tokenizer.to_str())["model"]
    if any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    of_letter = {c: b for b, c in byte_letters().items()}
    for pair in model["merges"]:
        merged = "".join(pair) if isinstance(pair, list) else pair.replace(" ", "")
        if space in merged.lstrip(space):
            try:
                text = bytes(of_letter[c] for c in merged).decode()
            except UnicodeDecodeError:
                return False
            if any(b == " " and a.isalpha() for a, b in zip(text, text[1:], strict=False)):
                return False
    return True


class Chunks(dict):
    """Numbers of chunks and, as arrays, the ids of each; a chunk that is new is encoded once.

    A key is a word that follows a space, a line end and the word after it, or a tab and the
    first word of a text, which has neither.  When there are too many chunks, those met least
    often are forgotten; very long ones are encoded in each batch anew.
    """

    def __init__(self, path: str | None, code: str, most: int = 700_000) -> None:
        t = load(path)
        self.code, self.most = code, most
        self.whole = lambda s: t.encode(s, add_special_tokens=False).ids
        self.special = tuple(x.content for x in t.get_added_tokens_decoder().values())
        self.chunks = chunkable(path)
        self.model, self.table = t.model, byte_letters()
        self.line = self.whole("\n")
        self.marks: dict[str, array] = {}
        #: Tokens that start with a space, and whether a space only ever starts a merge of letters.
        space = self.table[32]
        self.leads = np.zeros(t.get_vocab_size(), bool)
        self.leads[[k for w, k in t.get_vocab().items() if w[0] == space]] = True
        self.apart = self.chunks and keeps_apart(t, space)
        self.ids, self.starts = array(code), array("q", [0])
        self.used = np.zeros(1 << 16, np.int64)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each of some distinct chunks."""
        found = list(map(self.get, chunks))
        words, ended, rest = [], [], []
        for k in [k for k, x in enumerate(found) if x is None] if None in found else ():
            chunk = chunks[k]
            if not self.apart or len(chunk) > LONGEST:
                rest.append(k)
            elif chunk.isalpha():
                words.append(k)
            elif (m := MARKED.match(chunk)) and m[1].isalpha():
                ended.append((k, m[1], m[2]))
            else:
                rest.append(k)
        if words or ended:
            known = self.__contains__
            self.learn([w for w in dict.fromkeys([chunks[k] for k in words] + [stem for _, stem, _ in ended]) if not known(w)])
        for k in words:
            found[k] = self[chunks[k]]
        ids, starts = self.ids, self.starts
        for k, stem, marks in ended:  # letters, then marks alone, are two pre-tokens
            number = self[stem]
            ids.extend(ids[starts[number] : starts[number + 1]])
            ids.extend(self.mark(marks))
            starts.append(len(ids))
            found[k] = self[chunks[k]] = len(starts) - 2
        for k in rest:
            ids.extend(self.encode(chunks[k]))
            starts.append(len(ids))
            found[k] = len(starts) - 2
            if len(chunks[k]) <= LONGEST:
                self[chunks[k]] = len(starts) - 2
        return np.array(found, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encodes words of letters that follow a space, many in one call of the library's merges.

        No merge of the vocabulary joins a letter to a space after it, so the words stay apart.
        """
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            joined = (" " + " ".join(some)).encode().decode("latin-1").translate(self.table)
            ids = np.array([x.id for x in self.model.tokenize(joined)], np.int64)
            first = np.flatnonzero(self.leads[ids])
            if len(first) != len(some):
                raise ValueError("the merges of the tokenizer do not keep words apart")
            base = len(self.ids)
            self.ids.frombytes(ids.astype(f"<u{self.ids.itemsize}").tobytes())
            number = len(self.starts) - 1
            self.starts.extend((first[1:] + base).tolist())
            self.starts.append(len(self.ids))
            self.update(zip(some, range(number, number + len(some)), strict=True))

    def encode(self, chunk: str) -> Iterable[int]:
        lead = chunk[0]
        word = chunk[1:] if lead in "\t\n" else chunk
        if word.isalpha():
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
            own = [x.id for x in self.model.tokenize(letters if lead in "\t\n" else self.table[32] + letters)]
            return self.line + own if lead == "\n" else own
        m = MARKED.match(word)
        if m and m[1].isalpha():
            return [*self.encode(chunk[: len(chunk) - len(m[2])]), *self.mark(m[2])]
        return self.whole(chunk[1:] if lead == "\t" else chunk if lead == "\n" else " " + chunk)

    def mark(self, marks: str) -> array:
        """Ids of marks that follow a letter; the common ones are kept."""
        own = self.marks.get(marks)
        if own is None:
            own = array(self.code, self.whole(marks))
            if len(marks) <= 8 and len(self.marks) < 1 << 14:
                self.marks[marks] = own
        return own

    def forget(self) -> None:
        names, numbers = list(self), np.fromiter(self.values(), np.int64, len(self))
        place = np.sort(np.argsort(-self.used[numbers], kind="stable")[: self.most // 2])
        keep = numbers[place]
        used, starts, ids = self.used[keep], np.array(self.starts), np.array(self.ids)
        own = [ids[a:b] for a, b in zip(starts[keep].tolist(), starts[keep + 1].tolist(), strict=True)]
        self.clear()
        self.update((names[k], j) for j, k in enumerate(place.tolist()))
        self.ids, self.starts = array(self.code), array("q", [0])
        if own:
            self.ids.frombytes(np.concatenate(own).tobytes())
            self.starts.frombytes(np.cumsum([len(x) for x in own]).astype(np.int64).tobytes())
        self.used[: len(keep)] = used // 2
        self.used[len(keep) :] = 0

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out = [b""] * len(texts)
        easy = []
        for k, text in enumerate(texts):
            if self.chunks and plain(text) and not any(x in text for x in self.special):
                easy.append(k)
            elif text:
                out[k] = array(self.code, self.whole(text)).tobytes()
        if not easy:
            return out
        if len(self.starts) > self.most or len(self.ids) > 16 * self.most:
            self.forget()
        cut = pc.split_pattern(pa.array(["\t" + texts[k].replace("\n", " \n") for k in easy], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        numbers = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.starts) > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(len(self.starts), np.int64)])
        self.used[numbers] += np.bincount(which, minlength=len(numbers))
        ids, starts = np.array(self.ids), np.array(self.starts)
        size = (starts[numbers + 1] - starts[numbers])[which]
        ends = np.cumsum(size)
        shift = (starts[numbers][which] - ends + size).astype(np.int32)
        found = ids[np.arange(int(ends[-1]), dtype=np.int32) + np.repeat(shift, size)]
        stop = np.append(0, ends)[cut.offsets.to_numpy()].tolist()
        for k, a, b in zip(easy, stop[:-1], stop[1:], strict=True):
            out[k] = found[a:b].tobytes()
        return out
