"""Text to token ids with a tokenizer file, each distinct word encoded once per worker.

The tokenizer library spends its time per word, and words repeat.  A text is cut where the
tokenizer itself always separates, the distinct cuttings of a batch are looked up in a
memory that outlives the task, and only new ones go through the library.  The ids are the
same as for the whole text:

* byte-level tokenizers (blanks kept): no token reaches across a single blank between two
  non-blank characters, so the text is cut before such a blank;
* word tokenizers (blanks dropped): nothing reaches across a blank at all.

Any other kind of tokenizer encodes whole texts, and so does each kind a text that holds the
string of a token added to the vocabulary, which the library finds before it cuts.
"""

from __future__ import annotations

import gc
import json
import re
import string
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .util import CACHES

#: Distinct cuttings remembered per worker; beyond it the memory starts anew.
REMEMBER = 600_000
#: Characters of one text, and of one batch, that are cut at once.
SEGMENT = 1 << 22
#: ASCII characters that are neither letter, digit nor blank.
_TAIL = string.punctuation
#: Words of letters that go through the library as one text.
_JOINED = 256
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SAFE = re.compile(r"[A-Za-z0-9] (?=[A-Za-z0-9])")
#: RE2: a text whose blanks are not all single ones between other characters.
_ODD = r"(^[\s\p{Z}\x0b\x1c-\x1f\x{85}])|([\s\p{Z}\x0b\x1c-\x1f\x{85}]$)|([\s\p{Z}\x0b\x1c-\x1f\x{85}]{2})"


def _kind(spec: dict) -> str:
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
            and not pre.get("add_prefix_space"):
        return "kept"
    steps = pre.get("pretokenizers") or [{}]
    if steps[0].get("type") == "Split" and steps[0].get("invert") \
            and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]" in str((steps[0].get("pattern") or {}).get("Regex")):
        return "dropped"
    return "whole"


class Encoder:
    """Encodes lists of texts; ``Encoder.of(path)`` gives the worker's own for a file."""

    _here: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._here:
            cls._here[path] = cls(path)
        return cls._here[path]

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        self.lib = Tokenizer.from_file(path)
        # A text that holds an added token's string is left to the library whole.
        added = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.added = "|".join(added)
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.remember = remember
        letters = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
        self.letters = f"^ {letters}$" if self.kind == "kept" else f"^{letters}$"
        # Ids whose token begins with the blank, or ends a word.
        vocab = self.lib.get_vocab()
        self.mark = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.mark[i] = token.startswith("\u0120") if self.kind == "kept" else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        # Entry k has the ids pool[ends[k]:ends[k + 1]]; entry 0 is empty.
        self.index: dict[str, int] = {"": 0}
        self.ends = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)

    def _store(self, words: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        k, n = len(self.index), len(words)
        used = int(self.ends[k])
        while k + n + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[used:used + len(ids)] = ids
        self.ends[k + 1:k + n + 1] = used + np.cumsum(lens)
        self.index.update(zip(words, range(k, k + n)))

    def _take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and concatenated ids of the entries at ``places``."""
        n = len(self.index)
        entries = pa.ListArray.from_arrays(pa.array(self.ends[:n + 1]), pa.array(self.pool[:self.ends[n]]))
        return np.diff(self.ends)[places], entries.take(pa.array(places)).flatten().to_numpy()

    def _library(self, words: list[str]) -> None:
        """Encode ``words`` and remember them.

        Words of letters only are one token group each, whose first id (blanks kept: it has
        the blank) or last id (blanks dropped: it has the word end) shows where the word is;
        many of them go through the library as one text.
        """
        array = pa.array(words, pa.large_string())
        whole = pc.match_substring_regex(array, self.letters).to_numpy(zero_copy_only=False)
        plain = [words[i] for i in np.flatnonzero(whole).tolist()]
        for at in range(0, len(plain), _JOINED):
            part = plain[at:at + _JOINED]
            text = ("" if self.kind == "kept" else " ").join(part)
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(self.mark[ids])
            lens = np.diff(np.append(marks, len(ids)) if self.kind == "kept" else np.insert(marks, 0, -1))
            if len(lens) != len(part):
                raise AssertionError("word boundaries are not where the vocabulary has them")
            self._store(part, lens, ids)
        rest = [w for w in words if w not in self.index]
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            coded = [e.ids for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            self._store(part, lens, np.fromiter(chain.from_iterable(coded), np.uint32, int(lens.sum())))

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Places of ``words`` in the memory, encoding those it lacks."""
        index = self.index
        found = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(found < 0)
        if not len(lacking):
            return found
        new = [words[i] for i in lacking.tolist()]
        bases, tails = self._parts(new)
        self._library([w for w in dict.fromkeys(chain(bases, tails)) if w not in index])
        made = [m for m in zip(new, bases, tails) if m[0] not in index]
        if made:
            places = np.fromiter((index[x] for m in made for x in m[1:]), np.int64, 2 * len(made))
            lens, ids = self._take(places)
            self._store([m[0] for m in made], lens.reshape(-1, 2).sum(axis=1), ids)
        found[lacking] = np.fromiter(map(index.__getitem__, new), np.int64, len(new))
        return found

    def _parts(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Every word as a base and a tail whose ids follow each other.

        A run of signs after a letter or digit is a token of its own for either kind, and
        where case is dropped the lower-case form of an ASCII word has the same ids.
        """
        array = pa.array(words, pa.large_string())
        stem = pc.utf8_rtrim(array, characters=_TAIL)
        bases, tails = list(words), [""] * len(words)
        for i in np.flatnonzero(pc.not_equal(array, stem).to_numpy(zero_copy_only=False)).tolist():
            word = words[i]
            base = word.rstrip(_TAIL)
            if base and base[-1].lower().isalnum():
                bases[i], tails[i] = base, word[len(base):]
        if self.kind == "dropped":
            array = pa.array(bases, pa.large_string())
            low = pc.if_else(pc.string_is_ascii(array), pc.ascii_lower(array), array)
            bases = low.to_numpy(zero_copy_only=False).tolist()
        return bases, tails

    def _cuttings(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All cuttings of ``texts`` in order, and how many each text has."""
        array = pa.array(texts, pa.large_string())
        # Where blanks are dropped a line break is one of them.
        parts = pc.split_pattern(pc.replace_substring(array, "\n", " ") if self.kind == "dropped" else array, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        if self.kind == "dropped":
            return flat, counts
        # Blanks are kept: every cutting but a text's first starts with its blank.
        odd = pc.match_substring_regex(array, _ODD).to_numpy(zero_copy_only=False)
        lead = np.ones(len(flat), bool)
        lead[np.cumsum(counts) - counts] = False
        flat = pc.binary_join_element_wise(
            pc.if_else(pa.array(lead), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())),
            flat, pa.scalar("", pa.large_string()))
        if not odd.any():
            return flat, counts
        pieces, ends = [], np.cumsum(counts)
        for i, is_odd in enumerate(odd):
            if is_odd:
                own = pa.array(_CUT.split(texts[i]), pa.large_string())
                counts[i] = len(own)
                pieces.append(own)
            else:
                pieces.append(flat.slice(ends[i] - counts[i], counts[i]))
        return pa.concat_arrays(pieces), counts

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, counts = self._cuttings(texts)
        coded = flat.dictionary_encode()
        if len(self.index) > self.remember:
            self._forget()
        # Millions of small objects and no cycles: a collection would only walk them.
        collecting = gc.isenabled()
        gc.disable()
        try:
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            places = self._lookup(words)[coded.indices.to_numpy()]
        finally:
            if collecting:
                gc.enable()
        lens, ids = self._take(places)
        last = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(counts)]
        return np.split(ids, last[:-1])

    def _segments(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > SEGMENT:
            cut = _SAFE.search(text, at + SEGMENT)
            if cut is None:
                break
            out.append(text[at:cut.start() + 1])
            at = cut.start() + 1
        out.append(text[at:])
        return out

    def _whole(self, texts: list[str]) -> np.ndarray:
        """Which texts the library must see whole."""
        if self.kind == "whole" or not self.added:
            return np.full(len(texts), self.kind == "whole")
        found = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.added, ignore_case=True)
        return found.to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of every text (null: none) as unsigned 32-bit numbers."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray] = [None] * len(texts)
        batch: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal batch, owners, held
            if batch:
                for i, ids in zip(owners, self._encode(batch)):
                    out[i] = ids if out[i] is None else np.concatenate((out[i], ids))
            batch, owners, held = [], [], 0

        for i, whole in enumerate(self._whole(texts).tolist()):
            if whole:
                out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                continue
            for part in self._segments(texts[i]):
                batch.append(part)
                owners.append(i)
                held += len(part)
                if held >= SEGMENT:
                    flush()
        flush()
        return out


CACHES["encode"] = Encoder._here.clear
