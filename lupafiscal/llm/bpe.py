"""BPE encoding and decoding by a prefix-sharing trie.

The vocabulary lower-cases, drops white space and marks word ends, so a text is
encoded word by word.  Distinct words of a run of texts are sorted, which is the
depth-first order of their trie, and each trie node gets one state: the last
token of its prefix's encoding.  The encoding of a shared prefix is thereby
worked out once, and a word's tokens are read off by stepping back from its end.
The state of a node follows from earlier ones because a row of tokens is the
encoding of its text exactly if every two neighbours are the encoding of theirs.

Work is per partition: nothing is shuffled, and a task holds one slice of texts
and a word memory of bounded size.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lupafiscal.llm import words
from lupafiscal.llm.tables import keeping, map_arrow

# What the vocabulary file must say for the splitting below to hold.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# Characters split here; texts with any other are split by the tokenizers library.
PLAIN = 0x180
# Keeps the keys of words split by the library apart from those of words split here.
ODD = 0x0DD5EED
BLANK, LETTER, NUMBER, OTHER = range(4)
WORD_MEMORY = 1_500_000
PAIR_MEMORY = 2_000_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds, lower = np.full(PLAIN, OTHER, np.uint8), np.arange(PLAIN, dtype=np.uint16)
    for point in range(PLAIN):
        char = chr(point)
        category = unicodedata.category(char)
        if category[0] == "L":
            kinds[point] = LETTER
        elif category[0] == "N":
            kinds[point] = NUMBER
        elif point == 0x20 or 0x09 <= point <= 0x0D:
            kinds[point] = BLANK
        if len(char.lower()) == 1 and ord(char.lower()) < PLAIN:
            lower[point] = ord(char.lower())
    return kinds, lower


KINDS, LOWER = _tables()


@functools.cache
def library(path: str):
    """The tokenizers library's own object for the file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def checked(path: str) -> dict:
    """The file's BPE model; raises where its texts are split in another way than here."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    steps = [x["type"] for x in (content["normalizer"] or {}).get("normalizers", [])]
    split = [x.get("pattern", {}).get("Regex") for x in content["pre_tokenizer"].get("pretokenizers", [])]
    if model["type"] != "BPE" or steps != NORMALIZERS or split[:1] != [PATTERN]:
        raise ValueError(f"{path}: not a word-end BPE file with the known splitting")
    return model


class Trie:
    """Encodes distinct words with the merges of a vocabulary file."""

    def __init__(self, path: str):
        model = checked(path)
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = (tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.inner = {t for t in self.vocab if not t.endswith(self.suffix)}
        self.final = {t.removesuffix(self.suffix) for t in self.vocab if t.endswith(self.suffix)}
        self.longest = max(map(len, self.inner | self.final))
        self.bytes = _byte_characters()
        self._follows: dict[tuple[str, str, bool], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the neighbours of lowest rank, leftmost first, while there are any."""
        while len(symbols) > 1:
            pairs = zip(symbols, symbols[1:], strict=False)
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(pairs))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def follows(self, left: str, right: str, ends: bool) -> bool:
        """Whether the two tokens are the encoding of what they spell, at a word's end or within."""
        key = (left, right, ends)
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= PAIR_MEMORY:
                self._follows.clear()
            symbols, mark = [*left, *right], self.suffix if ends else ""
            symbols[-1] += mark
            want = [left, right + mark] if left else [right + mark]
            known = self._follows[key] = self.merged(symbols) == want
        return known

    def last(self, text: str, states: list[str], ends: bool) -> str:
        """The last token of the prefix ``text``; states[i] is that of its first i symbols."""
        tokens, size = (self.final if ends else self.inner), len(text)
        for begin in range(max(0, size - self.longest), size):
            token = text[begin:]
            if token in tokens and self.follows(states[begin], token, ends):
                return token
        raise ValueError(f"no encoding for {text!r}")

    def encode(self, plain_words: list[str]) -> list[list[int]]:
        """Ids of each word, in the order given."""
        spelled = ["".join(map(self.bytes.__getitem__, w.encode())) for w in plain_words]
        out: list[list[int]] = [[]] * len(spelled)
        states, previous = [""], ""
        for i in sorted(range(len(spelled)), key=spelled.__getitem__):
            word = spelled[i]
            known = min(len(states) - 1, len(word) - 1)
            shared = 0
            while shared < known and word[shared] == previous[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word)):
                states.append(self.last(word[:end], states, ends=False))
            token = self.last(word, states, ends=True)
            ids, at = [self.vocab[token + self.suffix]], len(word) - len(token)
            while at:
                token = states[at]
                ids.append(self.vocab[token])
                at -= len(token)
            out[i], previous = ids[::-1], word
        return out


@functools.cache
def trie_encoder(path: str) -> Encoder:
    return Encoder(path, Trie(path).encode)


@functools.cache
def library_encoder(path: str) -> Encoder:
    """As ``trie_encoder``, but each distinct word goes to the library's BPE model."""
    checked(path)
    model, spelling = library(path).model, _byte_characters()

    def encode(plain_words: list[str]) -> list[list[int]]:
        spelled = ("".join(map(spelling.__getitem__, w.encode())) for w in plain_words)
        return [[token.id for token in model.tokenize(w)] for w in spelled]

    return Encoder(path, encode)


def _byte_characters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of whole texts: a distinct word is encoded once in a worker and remembered, within a bound.

    Words are told apart by 64-bit hashes.  Only texts that hold special tokens are
    encoded by the library as a whole.
    """

    def __init__(self, path: str, encode_words: Callable[[list[str]], list[list[int]]]):
        self.whole_texts = library(path)
        self.special = [x.content for x in self.whole_texts.get_added_tokens_decoder().values()]
        self.byte_of = {ord(c): b for b, c in enumerate(_byte_characters())}
        self.encode_words = encode_words
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, plain_words: list[str]) -> None:
        if len(self.keys) + len(keys) > WORD_MEMORY:
            self._forget()
        ids = self.encode_words(plain_words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        flat = np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.keys, keys)  # the new ones come in order
        self.keys = np.insert(self.keys, at, keys)
        self.begins = np.insert(self.begins, at, begins)
        self.sizes = np.insert(self.sizes, at, sizes)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def _encoded(self, hashes: np.ndarray, word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin (one more than words)."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~self._known(keys)
        if new.any():
            if len(self.keys) + int(new.sum()) > WORD_MEMORY:
                new[:] = True  # the memory starts anew
            self._learn(keys[new], [word(i) for i in first[new]])
        at = np.searchsorted(self.keys, keys)[inverse]
        sizes, begins = self.sizes[at], self.begins[at]
        total = np.cumsum(sizes)
        place = np.arange(total[-1]) + np.repeat(begins - (total - sizes), sizes)
        return self.flat[place], np.concatenate([[0], total])

    def _plain(self, texts: words.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and tokens per row, for texts of plain characters only."""
        points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offsets = words.char_positions(texts.data)[texts.offsets]
        starts, ends = split(points, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(texts.rows, np.int64)
        symbols = LOWER[points]
        flat, total = self._encoded(
            words.hashes(symbols, starts, ends, PLAIN),
            lambda i: symbols[starts[i] : ends[i]].astype("<u4").tobytes().decode("utf-32-le"),
        )
        return flat, np.diff(total[np.searchsorted(starts, offsets)])

    def _odd(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, for texts of any characters without special tokens: the library splits them."""
        normalizer, pre_tokenizer = self.whole_texts.normalizer, self.whole_texts.pre_tokenizer
        rows = [[x for x, _ in pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(t))] for t in texts]
        # Words come spelled in the byte-level alphabet, one character a byte.
        spelled = [x for row in rows for x in row]
        if not spelled:
            return [np.zeros(0, np.uint32) for _ in rows]
        data = np.frombuffer("".join(spelled).translate(self.byte_of).encode("latin-1"), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        starts = np.concatenate([[0], ends[:-1]])
        keys = words.mix(words.hashes(data, starts, ends) ^ np.uint64(ODD))
        flat, total = self._encoded(keys, lambda i: data[starts[i] : ends[i]].tobytes().decode())
        return np.split(flat, total[np.cumsum([len(row) for row in rows])[:-1]])

    def ids(self, texts: words.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row's begin (one more than rows)."""
        plain = plain_rows(texts)
        lengths = np.diff(texts.offsets)
        if plain.all():
            flat, sizes = self._plain(texts)
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        kept = np.repeat(plain, lengths)
        flat, sizes = self._plain(words.Texts(
            texts.first, texts.data[kept], np.concatenate([[0], np.cumsum(lengths[plain])])
        ))
        rest = [
            texts.data[texts.offsets[r] : texts.offsets[r + 1]].tobytes().decode(errors="replace")
            for r in np.flatnonzero(~plain)
        ]
        special = [any(x in t for x in self.special) for t in rest]
        whole = self.whole_texts.encode_batch_fast(
            [t for t, x in zip(rest, special, strict=True) if x], add_special_tokens=False
        )
        whole_parts = iter([np.array(x.ids, np.uint32) for x in whole])
        odd_parts = iter(self._odd([t for t, x in zip(rest, special, strict=True) if not x]))
        parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        own_parts = iter([next(whole_parts if x else odd_parts) for x in special])
        rows = [next(parts) if p else next(own_parts) for p in plain]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def plain_rows(texts: words.Texts) -> np.ndarray:
    """Rows made of ASCII and Latin letters that split and lower-case one by one, without special tokens."""
    data = texts.data
    if not len(data):
        return np.ones(texts.rows, dtype=bool)
    after = np.append(data[1:], 0)
    odd = (data > 0xC5) | (data == 0xC0) | (data == 0xC1)
    odd |= (data == 0xC2) & ((after == 0x85) | (after == 0xA0))  # blanks beyond ASCII
    odd |= (data == 0xC4) & (after == 0xB0)  # its lower case is two characters
    odd |= (data == ord("<")) & (after == ord("|"))  # may begin a special token
    odd |= (data >= 0xC2) & (after & 0xC0 != 0x80)  # not UTF-8
    odd |= (data & 0xC0 == 0x80) & (np.append(0, data[:-1]) < 0xC2)
    return np.diff(np.concatenate([[0], np.cumsum(odd)])[texts.offsets]) == 0


def split(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the vocabulary's pattern matches in plain characters."""
    kinds = KINDS[points]
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.zeros(n + 1, dtype=bool)
    starts[offsets] = True
    starts = starts[:n]
    starts[0] = True
    starts[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    quotes = np.flatnonzero(starts[:-1] & starts[1:] & (points[:-1] == ord("'")) & (kinds[1:] == LETTER))
    ends_of_rows = offsets[np.minimum(np.searchsorted(offsets, quotes, "right"), len(offsets) - 1)]
    inside = quotes + 1 < ends_of_rows
    quotes, ends_of_rows = quotes[inside], ends_of_rows[inside]
    lower = LOWER[points]
    for short in CONTRACTIONS:
        after = quotes + 1 + len(short)
        hit = after <= ends_of_rows
        for j, char in enumerate(short):
            hit &= lower[np.minimum(quotes + 1 + j, n - 1)] == ord(char)
        at, rest = quotes[hit], after[hit]
        starts[at + 1] = False
        starts[rest[rest < n]] = True
    used = kinds != BLANK
    begins = np.flatnonzero(starts & used)
    stop = np.ones(n, dtype=bool)
    stop[:-1] = starts[1:]
    return begins, np.flatnonzero(stop & used) + 1


@functools.cache
def token_texts(path: str) -> list[str]:
    """What each id is written as, added tokens included."""
    tokenizer = library(path)
    size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    return [tokenizer.id_to_token(i) or "" for i in range(size)]


def decoded(flat: np.ndarray, offsets: np.ndarray, path: str) -> list[str]:
    """Texts of rows of ids: the file names no decoder, so tokens are joined by blanks."""
    tokens = list(map(token_texts(path).__getitem__, flat.tolist()))
    at = offsets.tolist()
    return [" ".join(tokens[a:b]) for a, b in zip(at, at[1:], strict=False)]


RESULTS = "n_tokens long, ids binary, decoded string"


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``keep`` columns, ``n_tokens``, ``ids`` (little-endian 32-bit) and ``decoded``.

    A null or empty text has no tokens and decodes to the empty text.  Rows are
    independent: repeated rows come out repeatedly, an empty table stays empty,
    other columns are left out and may have any name; a kept one named as a result
    gives way.
    """
    names, columns, fields = keeping(df, keep, RESULTS)
    source = df.select(*columns, F.col(text).cast("string").alias("t"))

    results = StructType.fromDDL(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(path)
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                flat, at = encoder.ids(texts)
                content, limits = flat.astype("<u4").tobytes(), (at * 4).tolist()
                found = [batch.column(i).slice(texts.first, texts.rows) for i in range(len(names))]
                found += [
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([content[a:b] for a, b in zip(limits, limits[1:], strict=False)], pa.binary()),
                    pa.array(decoded(flat, at, path), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(found, [*(f"k{i}" for i in range(len(names))), *results.fieldNames()])

    out = map_arrow(source, run, StructType([*fields, *results.fields]))
    return out.toDF(*names, *results.fieldNames())
