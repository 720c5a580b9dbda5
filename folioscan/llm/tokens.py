"""Whole texts to token ids with the tokenizers library, at the price of the distinct units only.

Such a tokenizer splits a text into units before it merges, and never across the place between a non-space character
and a single following space. A text is cut at those places into words, a word into the units that the tokenizer's own
splitting pattern gives, and every distinct unit is encoded by the library once in a worker's memory; a text's ids are
its units' ids in a row. Where the argument doesn't hold, the library gets more: a word with characters outside
Latin-1, or with a special token's text, is encoded whole; a text with a word that is empty or begins or ends with
white space is encoded whole; under a tokenizer of unknown splitting, words are the units.
"""

from __future__ import annotations

import ctypes
import itertools
import json
import os
import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Units remembered by a worker; the memory is emptied beyond it, and after so many idle seconds.
UNITS, IDLE = 1_000_000, 1.5
_C = ctypes.CDLL(None)
#: Stands between words while they are split; white space to the patterns, and words that have it are encoded whole.
SEPARATOR = "\v"
#: Fixed value: the splitting pattern of byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Words that can't be encoded by themselves: empty, or white space at either end.
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_APART = f"^$|^{_SPACES}|{_SPACES}$"


class _Units(dict):
    """Numbers distinct units; the separator is -1."""

    def __init__(self):
        super().__init__({SEPARATOR: -1})
        self.fresh = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self) - 1
        self.fresh.append(unit)
        return n


class _Ranges:
    """Numbered sequences of integers, one after the other in one array."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(counts) > len(self.start):
            self.start, self.count = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.count))
        self.flat[self.used : self.used + len(values)] = values
        self.start[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(counts)] = counts
        self.used, self.n = self.used + len(values), self.n + len(counts)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the sequences of these numbers in a row, their lengths)."""
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[numbers] - (ends - counts), counts) + np.arange(total)], counts


def _splitting(spec: dict) -> tuple[regex.Pattern | None, bool]:
    """(the pattern of a tokenizer's units, whether it lower-cases first), or (None, False)."""
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    if norm is None and len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex", True) and not steps[0].get("add_prefix_space"):
        return regex.compile(BYTE_LEVEL), False
    kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and not steps[1].get("use_regex", True):
        return regex.compile(steps[0]["pattern"]["Regex"]), True
    return None, False


class Encoder:
    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # units come once; the library's own memory of them only costs
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern, self.lower = _splitting(spec)
        self.splitter = pattern and regex.compile(f"{SEPARATOR}|{pattern.pattern}")
        self.special = regex.compile("|".join(regex.escape(x["content"].lower()) for x in spec.get("added_tokens", [])) or "(?!)")
        self.plain = regex.compile(f"[\\t\\n\\r{SEPARATOR} -~¡-ÿ]*")
        suffix, vocab = spec.get("model", {}).get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a unit, where the vocabulary tells
        self.last[[n for token, n in vocab.items() if suffix and token.endswith(suffix)]] = True
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if not suffix and len(line) == 1 else None
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.busy, self.timer = threading.Lock(), None
        self._forget()

    def _rest(self) -> None:
        """An idle worker of a later stage shouldn't hold what only this one needs."""
        with self.busy:
            self._forget()
        pa.default_memory_pool().release_unused()
        if hasattr(_C, "malloc_trim"):
            _C.malloc_trim(0)  # what the units took goes back to the system

    def _forget(self) -> None:
        self.units, self.unit_ids = _Units(), _Ranges()

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's own ids: (all in a row, how many of each text)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _bulk(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As raw, for units: many in one text, where their ends can be told again from the ids."""
        cut = [] if self.splitter is None or self.line is None and not self.last.any() else [i for i, u in enumerate(units) if not u.isspace() and not self.special.search(u.lower())]
        if len(cut) < 50:
            return self.raw(units)
        by = " " if self.line is None else "\n"
        flat, _ = self.raw([by.join(units[i] for i in cut[k : k + 1000]) + by * (self.line is not None) for k in range(0, len(cut), 1000)])
        mark = np.flatnonzero(self.last[flat] if self.line is None else flat == self.line)
        if len(mark) != len(cut):
            return self.raw(units)
        counts = np.diff(mark, prepend=-1) - (self.line is not None)
        if self.line is not None:
            flat = flat[flat != self.line]
        if len(cut) == len(units):
            return flat, counts
        parts = np.empty(len(units), object)
        rest = np.setdiff1d(np.arange(len(units)), cut)
        for at, (ids, n) in ((cut, (flat, counts)), (rest, self.raw([units[i] for i in rest]))):
            for i, x in zip(at, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = x
        return np.concatenate(list(parts)), np.fromiter(map(len, parts), np.int64, len(parts))

    def _split(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(words whose units the pattern gives, words that are units themselves)."""
        if self.splitter is None:
            return [], words
        text = SEPARATOR.join(words)
        if self.plain.fullmatch(text) and text.count(SEPARATOR) == len(words) - 1 and not self.special.search(text.lower()):
            return words, []
        good = [SEPARATOR not in w and bool(self.plain.fullmatch(w)) and not self.special.search(w.lower()) for w in words]
        return list(itertools.compress(words, good)), [w for w, g in zip(words, good, strict=True) if not g]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words in a row, how many of each)."""
        split, whole = self._split(words)
        numbers, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if split:
            text = SEPARATOR.join(split)
            units = self.splitter.findall(text.lower() if self.lower else text)
            n = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
            ends = np.append(np.flatnonzero(n < 0), len(n))
            numbers.append(n[n >= 0])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        if whole:
            numbers.append(np.fromiter(map(self.units.__getitem__, whole), np.int64, len(whole)))
            sizes.append(np.ones(len(whole), np.int64))
        if self.units.fresh:
            self.unit_ids.add(*self._bulk(self.units.fresh))
            self.units.fresh = []
        ids, counts = self.unit_ids.take(np.concatenate(numbers))
        sizes = np.concatenate(sizes)
        total, ends = np.concatenate(([0], np.cumsum(counts))), np.cumsum(sizes)
        counts = total[ends] - total[ends - sizes]
        if split and whole:  # back to the words' own order
            at = {w: i for i, w in enumerate(split + whole)}
            order = np.array([at[w] for w in words])
            starts = np.cumsum(counts) - counts
            ids = np.concatenate([ids[starts[i] : starts[i] + counts[i]] for i in order])
            counts = counts[order]
        return ids, counts

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many of each), the end id behind each text if there is one. None counts as empty."""
        if self.timer:
            self.timer.cancel()
        with self.busy:
            found = self._encode(texts)
        self.timer = threading.Timer(IDLE, self._rest)
        self.timer.daemon = True
        self.timer.start()
        return found

    def _encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > UNITS:
            self._forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        stops = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        words = cut.flatten()
        # numbers 0: the end of a text, 1: nothing, then the distinct words with a space before them, then the texts' first words
        table, number = _Ranges(), np.zeros(0, np.int64)
        table.add(self.end, np.array([len(self.end), 0]))
        for some, lead in ((words, " "), (words.take(pa.array(stops[:-1])), "")):
            coded = some.dictionary_encode()
            apart = pc.match_substring_regex(coded.dictionary, _APART).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(~apart)
            of = np.full(len(apart), -1, np.int64)
            of[good] = table.n + np.arange(len(good))
            if len(good):
                table.add(*self._ids_of([lead + w for w in coded.dictionary.take(pa.array(good)).to_pylist()]))
            if lead:
                number = of[coded.indices.to_numpy()]
            else:
                of[pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)] = 1  # a text that is empty or begins with one space
                number[stops[:-1]] = of[coded.indices.to_numpy()]
        number = np.insert(number, stops[1:], 0)
        ends = stops[1:] + np.arange(1, len(texts) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        alone = number < 0
        number[alone] = 1
        ids, counts = table.take(number)
        total = np.concatenate(([0], np.cumsum(counts)))
        at, n = total[begins], total[ends] - total[begins]
        if alone.any():
            bad = np.unique(np.searchsorted(ends, np.flatnonzero(alone), "right"))
            flat, k = self.raw([texts[i].as_py() for i in bad])
            out = np.split(ids, at[1:])
            for i, x in zip(bad.tolist(), np.split(flat, np.cumsum(k)[:-1]), strict=True):
                out[i] = np.concatenate((x, self.end))
            n[bad] = k + len(self.end)
            ids = np.concatenate(out)
        return ids, n


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One encoder per tokenizer file and worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to at most `most`, or of one larger item."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def text_sizes(texts: pa.Array) -> list[int]:
    """Bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()
