"""Texts cut into units that public tokenizers encode independently, so that a worker encodes each distinct unit once.

A cut goes before a single space between two characters that are no white space. The byte-level pattern always begins a piece there
(` ?` takes the space, `\\s+` cannot, as the space is neither longer than one nor last), and no sentencepiece piece may hold its space mark behind
another character (checked when a model is loaded; otherwise texts are not cut). A text without such places is one unit.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already

_UNSAFE = re.compile(r" \s|\s |^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


def units(text: str) -> list[str]:
    """The units of a text; all but the first stand behind a space that belongs to them. Python's white space includes all of Unicode's."""
    return text.split(" ") if _UNSAFE.search(text) is None else _CUT.split(text)


def byte_letters() -> dict[str, int]:
    """The bytes by the letters that byte-level vocabularies write for them: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Units that are encoded at a time.
TOGETHER = 8192


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library. `plain` reads the names of special tokens in a text as text."""

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        letters, self.tokens = byte_letters(), [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.divisible = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts behind a space."""
        return self.encode([f" {t}" for t in texts])


class Pieces:
    """A sentencepiece model, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.divisible = not any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    spaced = encode


def spaced_units(vocabulary: ByteLevel | Pieces, new: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of units that each stand behind a space, and how many each has; `ends` are the units' ends in the bytes of all. None where the tokens' bytes are of other lengths.

    The tokenizers library is given one text of them all, which is fastest there, sentencepiece a list."""
    if isinstance(vocabulary, Pieces):
        each = vocabulary.spaced(new)
        counts = np.fromiter(map(len, each), dtype=np.int64, count=len(new))
        ids = np.fromiter(itertools.chain.from_iterable(each), dtype=np.int64, count=int(counts.sum()))
    else:
        ids = np.array(vocabulary.spaced([" ".join(new)])[0], dtype=np.int64)
        counts = np.diff(np.searchsorted(np.cumsum(vocabulary.lengths[ids]), ends, side="right"), prepend=0)
    until = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])
    at = np.cumsum(counts)
    return (ids, counts) if at[-1] == len(ids) and np.array_equal(until[at], ends) else None


def byte_ends(new: list[str]) -> np.ndarray:
    """Where each unit ends in the bytes of all of them, each behind a space."""
    return np.cumsum(np.fromiter((len(u.encode("utf-8", "surrogatepass")) + 1 for u in new), dtype=np.int64, count=len(new)))


class Words:
    """Ids of texts by one vocabulary, as arrays; `remembered` units at most stay in memory."""

    def __init__(self, vocabulary: ByteLevel, remembered: int = 400_000, longest: int = 200):
        self.vocabulary, self.remembered, self.longest = vocabulary, remembered, longest
        self.first: dict[str, bytes] = {}  # units at the begin of a text
        self.spaced: dict[str, bytes] = {}  # units behind their space

    def _learn_first(self, new: set[str]) -> None:
        todo = [u for u in new if u not in self.first]
        for u, ids in zip(todo, self.vocabulary.encode(todo), strict=True):
            self.first[u] = np.array(ids, dtype="<u4").tobytes()

    def _learn_spaced(self, new: set[str]) -> None:
        todo = [u for u in new if u not in self.spaced]
        together = [u for u in todo if u == u.strip()]
        alone = [u for u in todo if u != u.strip()]
        for a in range(0, len(together), TOGETHER):
            part = together[a : a + TOGETHER]
            if (got := spaced_units(self.vocabulary, part, byte_ends(part))) is None:
                alone += part
                continue
            raw, at = got[0].astype("<u4").tobytes(), [0, *(np.cumsum(got[1]) * 4).tolist()]
            self.spaced.update(zip(part, [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], strict=True))
        for u, ids in zip(alone, self.vocabulary.spaced(alone), strict=True):
            self.spaced[u] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (little-endian, unsigned, 32 bits) of each text."""
        if len(self.first) + len(self.spaced) > self.remembered:
            self.first.clear()
            self.spaced.clear()
        split = [units(t) if t else [] for t in texts]
        self._learn_first({s[0] for s in split if s})
        self._learn_spaced(set().union(*(s[1:] for s in split)))
        first, spaced = self.first, self.spaced
        out = [np.frombuffer(first[s[0]] + b"".join([spaced[u] for u in s[1:]]), dtype="<u4") if s else np.zeros(0, dtype="<u4") for s in split]
        for known in (first, spaced):  # long units seldom come again
            for u in [u for u in known if len(u) > self.longest]:
                del known[u]
        return out


#: White space beside a space or at a text's end, as Python sees it (Arrow's own classes are ASCII only).
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE_ARROW = f"(?: {_SPACE}|{_SPACE} |^ | $)"
#: Letters, then nothing or an ASCII character that is none: the byte-level pattern ends a piece between the two, whatever follows.
_HEAD = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[\x00-@\[-`{-\x7f](?s:.*))?$"


def ragged(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[begin : begin + count] of all one after the other."""
    ends = np.cumsum(counts)
    return values.take(np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0))


def strings_of(texts: pa.Array) -> list[str]:
    """As to_pylist, without an Arrow object for each text."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Memory:
    """What `learn` (ids and how many each, of a list of strings) gave for strings. Beyond `remembered` strings, or 16 times as many characters, only those of the last call stay that are no longer than `longest`."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int, longest: int):
        self.learn, self.remembered, self.longest = learn, remembered, longest
        self.known: dict[str, int] = {}
        self.size = 0
        self.ids, (self.begins, self.counts, self.last) = np.zeros(0, dtype="<u4"), (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _forget(self) -> None:
        strings = list(self.known)
        keep = np.sort(self.last)
        keep = keep[np.fromiter((len(strings[k]) <= self.longest for k in keep.tolist()), dtype=bool, count=len(keep))]  # long strings seldom come again
        self.ids, self.counts = ragged(self.ids, self.begins[keep], self.counts[keep]), self.counts[keep]
        self.begins, self.known = np.cumsum(self.counts) - self.counts, {strings[k]: i for i, k in enumerate(keep.tolist())}
        self.size = sum(map(len, self.known))

    def find(self, wanted: pa.Array) -> np.ndarray:
        """The places in `begins` and `counts` of distinct strings; they hold until the next call."""
        if len(self.known) > self.remembered or self.size > 16 * self.remembered:
            self._forget()
        strings = strings_of(wanted)
        at = np.fromiter(map(self.known.get, strings, itertools.repeat(-1)), dtype=np.int64, count=len(strings))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [strings[k] for k in fresh.tolist()]
            ids, counts = self.learn(new)
            self.size += sum(map(len, new))
            at[fresh] = len(self.known) + np.arange(len(fresh))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(counts) - counts])
            self.known.update(zip(new, at[fresh].tolist(), strict=True))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.last = at
        return at


def _flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    return np.fromiter(itertools.chain.from_iterable(each), dtype="<u4", count=int(counts.sum())), counts


class ArrowWords:
    """Ids of an Arrow array of texts by a byte-level vocabulary. Units are split and told apart by Arrow, ids of the distinct ones are gathered by numpy.

    A unit's letters up to a character that is none are a piece of their own, so they are encoded and remembered without what follows; units of other kinds are so whole.
    """

    def __init__(self, vocabulary: ByteLevel, remembered: int = 1_000_000, longest: int = 200):
        self.vocabulary = vocabulary
        about = json.loads(vocabulary.library.to_str())
        before = about["pre_tokenizer"] or {}
        plain = about["model"]["type"] == "BPE" and not about["normalizer"] and not about["truncation"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before["add_prefix_space"]
        self.divisible = bool(plain) and not any(t["normalized"] or t["lstrip"] or t["single_word"] or t["content"][:1].isalnum() for t in about["added_tokens"])
        self.whole, self.heads, self.rests = (Memory(learn, remembered, longest) for learn in (self._whole, self._whole, self._rests))

    def _rests(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encoded behind a letter, which is left out again: units of a kind go to the library in one text."""
        ids, counts = self._whole([f"a{u}" for u in new])
        lead = len(self.vocabulary.encode([" a"])[0])
        return ragged(ids, np.cumsum(counts) - counts + lead, counts - lead), counts - lead

    def _whole(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of any kind, each behind its space."""
        bare = np.fromiter(map(str.__eq__, new, map(str.strip, new)), dtype=bool, count=len(new))
        together, alone = ([new[k] for k in np.flatnonzero(own).tolist()] for own in (bare, ~bare))
        parts = []
        for a in range(0, len(together), TOGETHER):
            part = together[a : a + TOGETHER]
            parts.append(spaced_units(self.vocabulary, part, byte_ends(part)) or _flat(self.vocabulary.spaced(part)))
        parts.append(_flat(self.vocabulary.spaced(alone)))
        ids, each, counts = np.concatenate([p[0] for p in parts]).astype("<u4"), np.concatenate([p[1] for p in parts]), np.zeros(len(new), dtype=np.int64)
        counts[bare], counts[~bare] = each[: len(together)], each[len(together) :]
        if not alone:
            return ids, counts
        begins = np.zeros(len(new), dtype=np.int64)
        begins[bare], begins[~bare] = np.split(np.cumsum(each) - each, [len(together)])
        return ragged(ids, begins, counts), counts

    def _units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.extract_regex(distinct, _HEAD) if self.divisible else pa.nulls(len(distinct))
        divided = cut.is_valid().to_numpy(zero_copy_only=False)
        at = self.whole.find(distinct.filter(pa.array(~divided)))
        values, begins, counts = [self.whole.ids], np.zeros((len(distinct), 2), dtype=np.int64), np.zeros((len(distinct), 2), dtype=np.int64)
        begins[~divided, 0], counts[~divided, 0] = self.whole.begins[at], self.whole.counts[at]
        if divided.any():
            cut = cut.filter(pa.array(divided))
            for k, (name, memory) in enumerate((("head", self.heads), ("rest", self.rests))):
                told = cut.field(name).dictionary_encode()
                at = memory.find(told.dictionary)[told.indices.to_numpy()]
                begins[divided, k], counts[divided, k] = memory.begins[at] + sum(map(len, values)), memory.counts[at]
                values.append(memory.ids)
        return ragged(np.concatenate(values), begins.ravel(), counts.ravel()), counts.sum(axis=1)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (little-endian, unsigned, 32 bits) of each text; null: none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE_ARROW).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~unsafe), np.flatnonzero(unsafe)])
        split = [pc.split_pattern(texts.filter(pa.array(~unsafe)), " "), pa.array([units(t) for t in strings_of(texts.filter(pa.array(unsafe)))], pa.list_(pa.string()))]
        sizes, flat = np.concatenate([pc.list_value_length(s).to_numpy(zero_copy_only=False) for s in split]), pa.concat_arrays([s.flatten() for s in split])
        leads = np.zeros(len(flat), dtype=bool)  # no space stands before a text's first unit
        leads[np.cumsum(sizes) - sizes] = True
        lead_ids, lead_counts = _flat(self.vocabulary.encode(strings_of(flat.filter(pa.array(leads)))))
        told = flat.filter(pa.array(~leads)).dictionary_encode()
        unit_ids, unit_counts = self._units(told.dictionary)
        at = told.indices.to_numpy()
        begins, counts = np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
        begins[~leads], counts[~leads] = (np.cumsum(unit_counts) - unit_counts)[at], unit_counts[at]
        begins[leads], counts[leads] = len(unit_ids) + np.cumsum(lead_counts) - lead_counts, lead_counts
        ids = ragged(np.concatenate([unit_ids, lead_ids]), begins, counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        out: list[np.ndarray] = [ids[:0]] * len(texts)
        for k, a, b in zip(order.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out
