"""Whole-text encoding with a public tokenizer, at the cost of the distinct words rather than of all text.

The tokenizer's pre-tokens never span white space, so a text's ids are those of its white-space-separated chunks
in turn. Each slice of texts is dictionary-encoded by Arrow, only chunks not met before go to the tokenizers
library, and the ids are gathered back with numpy; nothing is done word by word in Python except for the few that are
not plain. Memory: a bounded store of words and their ids, plus one slice.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stepweave.llm.common import text_bytes, words_of

#: Distinct stems that a worker remembers; beyond them it keeps those of its last slice.
CACHE_STEMS = 400_000
_TAIL = ".,;:!?"
_CHARS = np.array([chr(b) for b in range(128)], object)
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_ENCODERS: dict[str, "Encoder"] = {}


def _joined(strings: pa.Array) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings), pa.scalar("\n", pa.large_string()))[0].as_py()


def _gathered(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``pool[first : first + count]`` of each pair, one after the other."""
    ends = np.cumsum(count)
    return pool[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode`` equals ``tokenizers.Tokenizer.encode(text, add_special_tokens=False).ids`` for every text.

    Holds for tokenizers whose pre-tokenizer drops white space and splits letters from ASCII punctuation, as
    ``word_bpe_49k.json`` does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # what is known: stems, where the ids of each begin in the pool, how many they are, and the slice that last had it
        self.names = pa.array([], pa.large_string())
        self.pool = np.zeros(0, np.uint32)
        self.first, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.turn = 0
        # the same model for words that normalisation and pre-tokenisation leave as they are, many to a call
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.spelled = {c: "".join(self.byte_letters[b] for b in chr(c).encode()) for c in range(128, 256)}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    @staticmethod
    def parts(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Chunks as stems and trailing punctuation, so that ``word`` and ``Word,`` share one encoding."""
        special = pc.match_substring(chunks, "<|")  # may hold a special token, which is matched before any normalisation
        chunks = pc.if_else(pc.and_not(pc.string_is_ascii(chunks), special), pc.ascii_lower(chunks), chunks)
        stems = pc.ascii_rtrim(chunks, characters=_TAIL)
        size, whole = (pc.binary_length(x).to_numpy() for x in (stems, chunks))
        cut = (size > 0) & (size < whole) & ~special.to_numpy(zero_copy_only=False)
        raw, at = text_bytes(chunks)
        raw = np.frombuffer(raw, np.uint8)
        ends = (at[:-1] + size - 1)[cut]
        alnum = _ALNUM[raw[ends]]
        unclear = np.flatnonzero(cut)[raw[ends] > 127]
        alnum[raw[ends] > 127] = [x[-1].isalnum() for x in stems.take(pa.array(unclear)).to_pylist()]
        cut[cut] = alnum
        tails = np.full(len(chunks), "", object)
        one = cut & (whole - size == 1)
        tails[one] = _CHARS[raw[at[1:][one] - 1]]
        more = np.flatnonzero(cut & ~one)
        tails[more] = [x[len(x.rstrip(_TAIL)) :] for x in chunks.take(pa.array(more)).to_pylist()]
        return pc.if_else(pa.array(cut), stems, chunks), pa.array(tails, pa.large_string())

    def _plain(self, block: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ends and ids of words of lower-case letters that are spelled in byte letters; None if they can't be told apart."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (np.diff(stops, prepend=0), ids) if len(stops) == len(block) else None

    def _whole(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [e.ids for e in self.tokenizer.encode_batch_fast(block, add_special_tokens=False)]
        return np.fromiter(map(len, own), np.int64, len(own)), np.array([x for ids in own for x in ids], np.uint32)

    def _learn(self, missing: pa.Array) -> np.ndarray:
        """Encode unknown stems and return their places. Plain words, i.e. Latin-1 letters only, are their own normal form once in lower case."""
        plain = pc.ascii_is_alpha(missing).to_numpy(zero_copy_only=False)  # in lower case already, as all of ASCII is
        rest = np.flatnonzero(~plain)
        strings = _joined(missing.take(pa.array(rest))).split("\n") if len(rest) else []
        latin = np.array([stem.isalpha() and max(stem) <= "\xff" for stem in strings], bool)
        order = np.concatenate([np.flatnonzero(plain), rest[latin], rest[~latin]])
        kinds = [
            (_joined(missing.filter(pa.array(plain))).split("\n") if plain.any() else [], 8000, self._plain),
            ([x for x, is_latin in zip(strings, latin) if is_latin], 8000, lambda block: self._plain(" ".join(block).lower().translate(self.spelled).split(" "))),
            ([x for x, is_latin in zip(strings, latin) if not is_latin], 3000, self._whole),
        ]
        counts, pools = [self.count], [self.pool]
        for words, step, encoded in kinds:
            for start in range(0, len(words), step):
                block = words[start : start + step]
                count, ids = encoded(block) or self._whole(block)
                counts.append(count)
                pools.append(ids)
        base = len(self.names)
        self.names = pa.concat_arrays([self.names, missing.take(pa.array(order))])
        self.count, self.pool = np.concatenate(counts), np.concatenate(pools)
        self.first = np.cumsum(self.count) - self.count
        self.used = np.concatenate([self.used, np.full(len(order), self.turn)])
        places = np.empty(len(order), np.int64)
        places[order] = base + np.arange(len(order))
        return places

    def _places(self, stems: pa.Array) -> np.ndarray:
        """Where each of the distinct stems is in the store."""
        if len(self.names) > CACHE_STEMS:
            kept = self.used == self.turn
            self.names, self.pool = self.names.filter(pa.array(kept)), _gathered(self.pool, self.first[kept], self.count[kept])
            self.count, self.used = self.count[kept], self.used[kept]
            self.first = np.cumsum(self.count) - self.count
        self.turn += 1
        places = pc.index_in(stems, value_set=self.names)
        unknown = pc.is_null(places).to_numpy(zero_copy_only=False)
        places = pc.fill_null(places, 0).to_numpy().astype(np.int64)
        self.used[places[~unknown]] = self.turn
        if unknown.any():
            places[unknown] = self._learn(stems.filter(pa.array(unknown)))
        return places

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n+1 offsets, ids) of the texts; null is empty."""
        starts, flat = words_of(column, bytes(range(256)))
        if not len(flat):
            return np.zeros(len(starts), np.int64), np.zeros(0, np.uint32)
        coded = flat.dictionary_encode()
        both = pa.concat_arrays(self.parts(coded.dictionary)).dictionary_encode()
        places = self._places(both.dictionary)[both.indices.to_numpy()].reshape(2, -1).T  # each chunk's stem and tail
        count = self.count[places]
        pool = _gathered(self.pool, self.first[places].ravel(), count.ravel())
        lengths = count.sum(axis=1)
        index = coded.indices.to_numpy()
        each = lengths[index]
        out = _gathered(pool, (np.cumsum(lengths) - lengths)[index], each)
        return np.concatenate([[0], np.cumsum(each)])[starts], out
