"""Token counts at every prefix of a text, by dynamic programming over a byte-pair vocabulary.

A byte-pair encoding is valid exactly if each of its tokens is its own encoding and each two neighbours are the encoding
of what they spell together. So every prefix of a word has one last token, and

    last(i)  = the token t that ends at byte i and is a valid neighbour of last(i - |t|)
    count(i) = count(i - |t|) + 1

give the exact count of all prefixes of a word from left to right, without encoding any of them. The tokens that end at a
byte come from an Aho-Corasick automaton of the vocabulary. Two tokens are valid neighbours if no merge joins what stands
at their border before each side has been merged on: on the left the last parts of the left token, on the right the first
parts of the right one, each from when it is made until the merge that takes it up. Words are the pieces of the
tokenizer's split pattern; the steps of a word's counts, one for each character, are made once per worker and kept in a
table bounded in bytes.

A text's counts are the running total of its words' steps. A prefix may end inside what the whole text splits otherwise:

* in white space before a word: the run's last character begins the next word (or stands alone) in the whole text, but
  belongs to the run where the text ends there. That one place is put right for every such run.
* in a contraction of two letters ('re): its first letter is a word of its own as long as the second is missing.
* in a special string (<|endoftext|>): it is plain text until it is complete, then one token.

The stored counts answer how many tokens the first k characters have (counts[k]) and how many characters a budget of
tokens allows (the last k with counts[k] <= budget, whatever the ups and downs before it).
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.llm import texts as T

LIMIT = 512
TABLE_BYTES = 128 << 20  # of the words that a worker keeps, about
PAIRS = 500_000  # token pairs whose validity a worker keeps
SLICE = 1 << 16  # characters split at once, if the text has a single space to part at

#: White space and byte letters of the tokenizer (fixed values).
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS_END = 0x40000  # planes beyond hold no letters and no numbers
_PRINTED = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def _letters() -> dict[int, str]:
    unprinted = [b for b in range(256) if b not in _PRINTED]
    return {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(unprinted)}


def _ranges(inside: np.ndarray) -> str:
    """The code points that are marked, as ranges of a character class."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def _classes(pre_tokenizer, most: int) -> tuple[str, str]:
    """(letters, numbers) up to a code point, as the tokenizer has them: which stay with a letter, which with a digit."""
    end = min(most + 1, _LETTERS_END)
    letter, number = np.zeros(end, bool), np.zeros(end, bool)
    spaces = {ord(c) for c in re.findall(f"[{_SPACES}]", "".join(map(chr, range(0x4000))))}
    for lo in range(0, end, 1 << 14):
        points = [c for c in range(lo, min(end, lo + (1 << 14))) if not 0xD800 <= c < 0xE000 and c not in spaces]
        begins = np.zeros(3 * len(points) + 1, bool)
        begins[[a for _, (a, _) in pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}1" for c in points))]] = True
        letter[points] = ~begins[1:-1:3]
        number[points] = begins[1:-1:3] & ~begins[2:-1:3]
    return _ranges(letter), _ranges(number)


def splitter(pre_tokenizer, most: int):
    """Words of a text whose code points are at most `most`, by the tokenizer's pattern."""
    (letter, number), space = _classes(pre_tokenizer, most), _SPACES
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall


_BELOW = bytes(range(0xCC))  # bytes of characters below U+0300
_RUN = re.compile(f"[{_SPACES}]{{2,}}(?=[^{_SPACES}])").finditer
_PART = re.compile(f"(?<=[^{_SPACES}]) (?=[^{_SPACES}])").search


class Prefixes(dict):
    """The steps of a word's counts (int16, one for each character), made when first asked for."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.split = functools.cache(functools.partial(splitter, tokenizer.pre_tokenizer))
        self.letters = _letters()
        special = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
        ids = {word: i for word, i in tokenizer.get_vocab().items() if word not in special}
        self.word = {i: word for word, i in ids.items()}
        self.ending = ahocorasick.Automaton()
        for word, i in ids.items():
            self.ending.add_word(word, (i, len(word)))
        self.ending.make_automaton()
        # Merges by rank: (left, right) joined, and what each token is made of.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[left], ids[right]
            self.rank[a << 32 | b] = rank
            self.parts[ids[left + right]] = (a, b, rank)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.size = 0
        self.valid: dict[int, bool] = {}
        self.gaps: dict[str, int] = {}
        self._edge = functools.cache(self._edge)
        self._whole = functools.cache(self._whole)

    def _whole(self, token: int) -> bool:
        """Whether a token is the encoding of what it spells."""
        return [t.id for t in self.model.tokenize(self.word[token])] == [token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that takes it up) of what stands at a token's end (side 1) or begin (0)."""
        out = [(token, len(self.rank))]
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, rank))
        return out

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether a token, itself whole, and the next one are the encoding of what they spell; left is -1 at a begin."""
        if not self._whole(right):
            return False
        if left < 0:
            return True
        for a, taken in self._edge(left, 1):
            for b, used in self._edge(right, 0):
                # Of equal merges the leftmost comes first.
                rank = self.rank.get(a << 32 | b)
                if rank is not None and rank < taken and rank <= used:
                    return False
        return True

    def counts(self, word: str) -> list[int]:
        """Tokens of the first k characters of a word, for k from 0."""
        plain = word.isascii() and word.lstrip(" ").isprintable()
        data = word.replace(" ", self.letters[32]) if plain else "".join(map(self.letters.__getitem__, word.encode()))
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (token, size) in self.ending.iter(data):
            at = end + 1
            if not count[at]:
                left = last[at - size]
                pair = left << 32 | token
                known = self.valid.get(pair)
                if known is None:
                    if len(self.valid) >= PAIRS:
                        self.valid.clear()
                    known = self.valid[pair] = self._neighbours(left, token)
                if known:
                    last[at], count[at] = token, count[at - size] + 1
        if not all(count[1:]):
            raise ValueError("a byte of a word ends no token: the vocabulary lacks bytes or is no byte-pair encoding")
        if len(word) == len(data):
            return count
        ends = itertools.accumulate((len(c.encode()) for c in word), initial=0)
        return [count[i] for i in ends]

    def __missing__(self, word: str) -> bytes:
        counts = self.counts(word)
        steps = [b - a for a, b in itertools.pairwise(counts)]
        if word in ("'re", "'ve", "'ll"):
            steps = [1, 1, counts[-1] - 2]
        made = array("h", steps).tobytes()
        if len(word) <= 100:
            self.size += 200 + 4 * len(word)
            if self.size > TABLE_BYTES:
                self.clear()
                self.size = 0
            self[word] = made
        return made

    def _total(self, word: str) -> int:
        return int(np.frombuffer(self[word], np.int16).sum()) if word else 0

    def _gap(self, run: str) -> int:
        """What white space at the end of a text has more than its parts before a word."""
        if len(run) > 100:
            return self._total(run) - self._total(run[:-1]) - self._total(run[-1])
        if run not in self.gaps:
            if len(self.gaps) >= 10_000:
                self.gaps.clear()
            self.gaps[run] = self._total(run) - self._total(run[:-1]) - self._total(run[-1])
        return self.gaps[run]

    def _plain(self, text: str, split) -> np.ndarray:
        """Counts of a text without special strings; element k is that of the first k characters."""
        out = np.zeros(len(text) + 1, np.int32)
        at = 0
        while at < len(text):
            cut = _PART(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            steps = b"".join(map(self.__getitem__, split(text[at:end] if at or cut else text)))
            out[at + 1 : end + 1] = np.frombuffer(steps, np.int16)
            at = end
        np.cumsum(out, out=out)
        for run in _RUN(text):
            out[run.end()] += self._gap(run.group())
        return out

    def of(self, data: bytes) -> np.ndarray:
        """Tokens of the first k characters of a text in UTF-8, for k from 0."""
        text = data.decode()
        most = 0 if data.isascii() else max(data.translate(None, _BELOW), default=0)
        split = self.split(0x10FFFF if most >= 0xF0 else 0xFFFF if most >= 0xCC else 0x2FF)
        parts = []
        at = base = 0
        for found in self.special.finditer(text) if self.special else ():
            # Up to the special string's last character it is text like any other.
            own = self._plain(text[at : found.end() - 1], split) + base
            base = int(own[found.start() - at]) + 1
            parts.append(own)
            at = found.end()
        parts.append(self._plain(text[at:], split) + base)
        return np.concatenate(parts)


@functools.cache
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The most characters whose tokens number at most `budget`."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def counted(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, limit_chars), a row for each row of docs (doc_id, text).

    n_tokens is the count at the whole text, limit_chars the most characters that keep within `limit` tokens. Both are
    read off the text's prefix counts, which stay in the task. Null texts count as empty: no bytes, no tokens. Repeated
    rows get equal results; an empty table gives no rows. Other columns of docs are ignored.
    """

    def answer(chunk: list[bytes]) -> dict[str, pa.Array]:
        known = prefixes(tokenizer)
        total, fits = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64)
        for i, data in enumerate(chunk):
            counts = known.of(data)
            total[i] = counts[-1]
            fits[i] = len(counts) - 1 if counts[-1] <= limit else longest_within(counts, limit)
        return {"n_bytes": pa.array([len(data) for data in chunk], pa.int64()), "n_tokens": pa.array(total), "limit_chars": pa.array(fits)}

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return T.over_texts(source, "text", answer, "n_bytes long, n_tokens long, limit_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, counts): each text's token counts, element k + 1 of the array for its first k characters.

    To be stored once and asked often, with `tokens_in` and `chars_within`. Nulls and repeats as in `counted`.
    """

    def table(chunk: list[bytes]) -> dict[str, pa.Array]:
        known = prefixes(tokenizer)
        own = [known.of(data) for data in chunk]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        values = np.concatenate(own) if own else np.zeros(0, np.int32)
        counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        return {"n_bytes": pa.array([len(data) for data in chunk], pa.int64()), "counts": counts}

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return T.over_texts(source, "text", table, "n_bytes long, counts array<int>")


def tokens_in(counts: Column | str, chars: Column) -> Column:
    """Tokens of the first `chars` characters (of all, if the text has fewer) by stored counts."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def chars_within(counts: Column | str, budget: Column) -> Column:
    """The most characters whose tokens number at most `budget`, by stored counts."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    return F.array_max(F.transform(counts, lambda n, k: F.when(n <= budget, k)))
