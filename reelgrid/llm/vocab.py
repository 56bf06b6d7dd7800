"""Encoding of texts by public vocabularies, with a bounded cache of pieces.

A text is cut at places where both libraries' pre-tokenisers always have a boundary, so that each
piece can be encoded alone; pieces seen before come from a cache. Encoded ids are held as bytes of
little-endian unsigned 32-bit numbers.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

from .textscan import word_hashes, words, xxh64

#: Pieces that a generation of a cache holds, and the longest piece that is kept there.
CACHED, LONGEST = 300_000, 64
#: White space beyond ASCII that the patterns know (fixed values of Unicode's White_Space), and the
#: ASCII separators that Python alone takes for white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


#: Marks that are one pre-token as a run, and part a word from what follows.
MARKS = ".,;:!?|%*&$#()[]{}<>+=/\\\"-"


class Pieces:
    """Two generations of pieces with their ids: what is used stays, what is not goes when the young
    generation is full. Memory is bounded by the numbers above and one batch of texts."""

    def __init__(self, encode: Callable[[list], list[bytes]]):
        self.encode = encode
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list = []

    def forget(self) -> None:
        """Give up all pieces; the worker lives on while other stages run."""
        self.young, self.old, self.passing = {}, {}, []

    def of(self, texts: list[list]) -> list[list[bytes]]:
        """The ids of the pieces of each text."""
        for w in self.passing:
            del self.young[w]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        out = [list(map(known.get, pieces)) for pieces in texts]
        lacking = [k for k, ids in enumerate(out) if None in ids]
        need = {w for k in lacking for w, i in zip(texts[k], out[k]) if i is None}
        known.update({w: old[w] for w in need if w in old})
        new = [w for w in need if w not in known]
        for at in range(0, len(new), 4096):
            known.update(zip(new[at : at + 4096], self.encode(new[at : at + 4096])))
        self.passing = [w for w in new if len(w) > LONGEST]
        for k in lacking:
            out[k] = [known[w] if i is None else i for w, i in zip(texts[k], out[k])]
        return out


def spread(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions place, place + 1, ... of size each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(place - ends + size, size)


class Store:
    """Ids of words by 128-bit hash, in arrays: about 30 bytes a word, and at most so many bytes in each of
    two generations. What is used stays; what is not goes when the young generation is full."""

    def __init__(self, most: int = 12 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.young, self.old = self._none(), self._none()

    @staticmethod
    def _none() -> tuple[np.ndarray, ...]:
        """keys (ascending), checks, places, sizes, ids."""
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def _found(part: tuple[np.ndarray, ...], keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and where."""
        if not len(part[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(part[0], keys), len(part[0]) - 1)
        return (part[0][at] == keys) & (part[1][at] == checks), at

    def get(self, keys: np.ndarray, checks: np.ndarray, encode: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; encode gives those of the words at some positions. Keys ascend."""
        sizes = np.zeros(len(keys), np.int64)
        young, at = self._found(self.young, keys, checks)
        old, at_old = self._found(self.old, keys, checks)
        old &= ~young
        new = np.flatnonzero(~young & ~old)
        fresh = [ids for i in range(0, len(new), 4096) for ids in encode(new[i : i + 4096])]
        sizes[young], sizes[old] = self.young[3][at[young]], self.old[3][at_old[old]]
        sizes[new] = [len(x) // 4 for x in fresh]
        ends = np.cumsum(sizes)
        place = ends - sizes
        ids = np.empty(ends[-1] if len(ends) else 0, "<u4")
        for which, part, where in ((young, self.young, at), (old, self.old, at_old)):
            ids[spread(place[which], sizes[which])] = part[4][spread(part[2][where[which]], part[3][where[which]])]
        ids[spread(place[new], sizes[new])] = np.frombuffer(b"".join(fresh), "<u4")
        self._add(~young & (sizes <= LONGEST), keys, checks, place, sizes, ids)
        return ids, sizes

    def _add(self, some: np.ndarray, keys: np.ndarray, checks: np.ndarray, place: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words whose ids are few join the young generation; of one key with two checks the later stays."""
        if sum(x.nbytes for x in self.young) > self.most:
            self.old, self.young = self.young, self._none()
        own = ids[spread(place[some], sizes[some])]
        starts = np.cumsum(sizes[some]) - sizes[some] + len(self.young[4])
        merged = [np.concatenate(x) for x in zip(self.young[:4], (keys[some], checks[some], starts, sizes[some]))]
        order = np.argsort(merged[0], kind="stable")
        last = np.append(merged[0][order][1:] != merged[0][order][:-1], True) if len(order) else np.zeros(0, bool)
        self.young = (*[x[order[last]] for x in merged], np.concatenate([self.young[4], own]))


class Merges:
    """The merges of a word vocabulary, applied to many words at once.

    The pair of neighbours with the lowest rank merges first, the leftmost of equals, as in the
    library; a merged token's own pairs rank later, so one merge per word and step is the same.
    """

    #: What a file must say for a word of plain letters to be one pre-token of its lower-case bytes.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LONGEST = 32
    NONE = 1 << 40

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int64)
        keys = np.array([(vocab[x] << 20) | vocab[y] for x, y in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, self.NONE)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)

    @classmethod
    def of(cls, spec: dict) -> Merges | None:
        """None where the file differs from what is said above."""
        model, before, normal = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        steps = before.get("pretokenizers", [])
        fits = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
            and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": cls.PATTERN} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        )
        return cls(spec) if fits else None

    @staticmethod
    def letters(word: str) -> bool:
        """Letters of the Latin blocks only, which are one pre-token, and each a lower-case letter of its own."""
        return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of lower-case words of 1 to LONGEST bytes."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, self.LONGEST)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if not len(rows):
                continue
            n = size[rows]
            raw = np.frombuffer(b"".join([words[i].ljust(high, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, high)
            sym = self.inner[raw]
            each = np.arange(len(rows))
            sym[each, n - 1] = self.final[raw[each, n - 1]]
            rank = np.full(sym.shape, self.NONE)
            rank[:, :-1] = np.where(np.arange(high - 1) < (n - 1)[:, None], self._rank(sym[:, :-1], sym[:, 1:]), self.NONE)
            live = each
            while len(live):
                at = rank[live].argmin(axis=1)
                best = rank[live, at]
                live, at, best = live[best < self.NONE], at[best < self.NONE], best[best < self.NONE]
                if not len(live):
                    break
                place = np.arange(high)
                shift = np.minimum(place + (place > at[:, None]), high - 1)
                s, r = np.take_along_axis(sym[live], shift, 1), np.take_along_axis(rank[live], shift, 1)
                k = np.arange(len(live))
                s[k, at] = self.made[best]
                n[live] -= 1
                m = n[live]
                r[:, -1] = self.NONE
                right = np.minimum(at + 1, high - 1)
                r[k, at] = np.where(at + 1 < m, self._rank(s[k, at], s[k, right]), self.NONE)
                left = np.flatnonzero(at > 0)
                r[left, at[left] - 1] = self._rank(s[left, at[left] - 1], s[left, at[left]])
                sym[live], rank[live] = s, r
            flat = sym.astype("<u4")
            for i, k, m in zip(rows.tolist(), each.tolist(), n.tolist()):
                out[i] = flat[k, :m].tobytes()
        return out


class WordPieces:
    """A `tokenizers` file whose pre-tokeniser never joins what ASCII white space separates."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges.of(json.load(f))
        self.marks: dict[str, bytes] = {}
        self.pieces = Store()

    def forget(self) -> None:
        """Give up all words; the worker lives on while other stages run."""
        self.pieces.clear()
        self.marks.clear()

    def _new(self, new: list[bytes]) -> list[bytes]:
        """Words of letters, with or without marks behind them, by merges; all others by the library."""
        out: list[bytes | None] = [None] * len(new)
        if self.merges:
            easy, words, tails = [], [], []
            for i, w in enumerate(new):
                if len(w) <= Merges.LONGEST:
                    text = w.decode()
                    word = text.rstrip(MARKS)
                    if Merges.letters(word):
                        lower = word.lower().encode()
                        if len(lower) <= Merges.LONGEST:
                            easy.append(i)
                            words.append(lower)
                            tails.append(text[len(word) :])
            for t in set(tails).difference(self.marks):
                self.marks[t] = b"".join(self._joined([t.encode()])) if t else b""
            for i, ids, t in zip(easy, self.merges.encode(words), tails):
                out[i] = ids + self.marks[t]
            if len(self.marks) > CACHED:
                self.marks.clear()
        hard = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(hard, self._joined([new[i] for i in hard]) if hard else []):
            out[i] = ids
        return out

    def _joined(self, new: list[bytes]) -> list[bytes]:
        """The ids of each piece, by one call for all: tokens are told apart by where they begin."""
        words = [w.decode() for w in new]
        begin = np.cumsum([0, *[len(w) + 1 for w in words]])
        e = self.of.encode(" ".join(words), add_special_tokens=False)
        cut = 4 * np.searchsorted([o[0] for o in e.offsets], begin)
        ids = np.array(e.ids, "<u4").tobytes()
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each begin and end.

        Words are found and told apart by numpy (by 64-bit hash, within the texts given), so that
        only distinct words are looked up one by one.
        """
        w = words(texts, lower=False)
        keys, first, of = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        start, size = w.start[first], w.size[first]
        data = memoryview(w.text)

        def encode(some: np.ndarray) -> list[bytes]:
            return self._new([bytes(data[a : a + n]) for a, n in zip(start[some].tolist(), size[some].tolist())])

        ids, counts = self.pieces.get(keys, xxh64(w.text, start, size, 1), encode)
        place, counts = (np.cumsum(counts) - counts)[of], counts[of]
        ends = np.cumsum(counts)
        return ids[spread(place, counts)], np.concatenate([[0], ends])[w.first]


class BytePieces:
    """A rank file as the tiktoken library reads it, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = self.of.encode_ordinary
        self.pieces = Pieces(lambda new: [np.array(encode(" " + w), "<u4").tobytes() for w in new])
        n = max(ranks.values()) + 1
        raw = [b""] * n
        for token, rank in ranks.items():
            raw[rank] = token
        self.size = np.array([len(x) for x in raw], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        A space before a character that is no white space always begins a match of the pattern
        (white space matches leave their last space to what follows), so texts are cut there.
        """
        split = [(_CUT.split(t) if ODD_SPACE.search(t) or _RUN.search(t) else t.split(" ")) for t in texts]
        heads = [np.array(self.of.encode_ordinary(p[0]), "<u4").tobytes() for p in split]
        return [head + b"".join(rest) for head, rest in zip(heads, self.pieces.of([p[1:] for p in split]))]

    def decode(self, ids: bytes, at_once: int = 1 << 20) -> list[bytes]:
        """The raw bytes of the ids, concatenated; in parts that bound the memory."""
        numbers = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(numbers), at_once):
            part = numbers[at : at + at_once].astype(np.int64)
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.raw[np.arange(ends[-1]) + np.repeat(self.place[part] - ends + size, size)].tobytes())
        return out


#: A space that stands before white space, or at the end.
_RUN = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


@cache
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)


@cache
def byte_pieces(path: str, pattern: str) -> BytePieces:
    return BytePieces(path, pattern)
