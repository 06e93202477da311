"""Token ids of whole texts by a tokenizer file, with a bounded memory of chunks.

A chunk (what lies between spaces, tabs and line ends) is tokenised on its own,
which gives the ids of the whole text where the tokenizer drops white space and
its normaliser looks at single characters and what combines with them; the
tests compare with whole texts.  Chunks repeat, so each Python worker keeps the
ids of those that it met lately, and the rest of a batch is numpy.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are tokenised at once, and chunks after which the memory starts a new generation.
SLICE_BYTES, GENERATION = 8 << 20, 100_000
#: The tokenizer always parts an ASCII letter from these marks, so that a chunk can be cut before its last ones.
TAIL = '.,;:!?*$%&#"()[]-'
#: Chunks that normalising leaves as they are and the tokenizer does not cut into words.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words as they are: no normaliser, and of the cuts only the bytes' letters
        parts = json.loads(self.tokenizer.to_str())
        steps = parts["pre_tokenizer"] or {}
        steps = [x for x in steps.get("pretokenizers", [steps]) if x.get("type") == "ByteLevel"]
        self.words = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": steps[0] if steps else None}))
        # ids that end a word, if the model marks them
        suffix, vocabulary = parts["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.agree = None if suffix else False
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of plain words, all in one call."""
        ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends, flat = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()], ids.tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, chunks: list[str]) -> None:
        """The ids of new chunks."""
        plain = [c for c in chunks if _PLAIN.fullmatch(c)]
        if plain and self.agree is None:  # does this file's tokenizer leave plain words alone?
            self.agree = self._word_ids(plain[:2000]) == self._ids(plain[:2000])
        if plain and self.agree and len(found := self._word_ids(plain)) == len(plain):
            self.young.update(zip(plain, found))
        rest = [c for c in chunks if c not in self.young]
        self.young.update(zip(rest, self._ids(rest)))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks, remembered or learnt."""
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, chunks))
        missing = [i for i, ids in enumerate(out) if ids is None]
        fresh = [chunks[i] for i in missing]
        young.update((c, old[c]) for c in fresh if c in old)
        self._learn([c for c in fresh if c not in young])
        for i, c in zip(missing, fresh):
            out[i] = young[c]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin (one more entry at the end).
        A null text has none."""
        flat = pc.fill_null(texts.cast(pa.large_string()), "")
        for space in "\n\r\t":
            flat = pc.replace_substring(flat, space, " ")
        split = pc.split_pattern(flat, " ")
        coded = pc.dictionary_encode(split.flatten())
        # a chunk is a stem and the marks after it, so that fewer chunks are new
        chunks = coded.dictionary
        stems = pc.utf8_rtrim(chunks, TAIL)
        cut = pc.match_substring_regex(stems, "[A-Za-z]$")
        tails = pc.if_else(cut, pc.replace_substring_regex(chunks, r"(?s)^.*[A-Za-z]", ""), "")
        stems, tails = (pc.dictionary_encode(x) for x in (pc.ascii_lower(pc.if_else(cut, stems, chunks)), tails))
        known = self._known(stems.dictionary.to_pylist())
        first_tail = len(known)
        known += self._known(tails.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        units = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + first_tail], 1)
        ids, _ = _picked(np.frombuffer(b"".join(known), "<u4"), sizes, units.ravel())
        ids, ends = _picked(ids, sizes[units].sum(1, dtype=np.int32), coded.indices.to_numpy())
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.concatenate([np.zeros(1, np.int32), ends])[offsets]


def _picked(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids``, which are of ``sizes`` in a row, as ``codes`` name them, and where each ends."""
    starts, lengths = (np.cumsum(sizes, dtype=np.int32) - sizes)[codes], sizes[codes]
    ends = np.cumsum(lengths, dtype=np.int32)
    # the place of each id: steps of one, and a jump where a run begins
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends


_open: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """This worker's tokenizer of the file."""
    if path not in _open:
        _open[path] = Tokens(path)
    return _open[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts that hold ``most`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)
