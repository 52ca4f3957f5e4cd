"""Token ids of whole texts, by word: equal words are encoded once per Python worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quartergrid.llm.words import factorize, gather, sums

# A word of Latin-1 letters and closing marks takes the model alone; its normal form is its lower case.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,!?;:]*)")
CACHED_WORDS = 600_000
CACHED_LENGTH = 40


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """Letters of the byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
    return [chr(other.get(b, b)) for b in range(256)]


class WordTokens:
    """Encode texts with a tokenizer whose pre-tokens never hold white space.

    For such tokenizers a text's ids are those of its words in turn. At most
    ``CACHED_WORDS`` short words are remembered; others are encoded again. Words are encoded
    on one thread: a task has one core, and every further thread would keep memory of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _many(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _plain(self, letters: str) -> bytes:
        alphabet = _byte_letters()
        text = letters if letters.isascii() else "".join(alphabet[b] for b in letters.encode())
        return np.array([t.id for t in self.tokenizer.model.tokenize(text)], "<u4").tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        known, out, late = self.known, [b""] * len(words), []
        for i, word in enumerate(words):
            found = known.get(word)
            if found is None:
                plain = PLAIN.fullmatch(word.lower())
                if plain is None:
                    late.append(i)
                    continue
                letters, marks = plain.groups()
                found = known.get(letters)
                if found is None:
                    found = self._keep(letters, self._plain(letters))
                if marks:
                    tail = known.get(marks)
                    if tail is None:
                        tail = self._keep(marks, self._many([marks])[0])
                    found += tail
            out[i] = found
        for i, ids in zip(late, self._many([words[i] for i in late])):
            out[i] = self._keep(words[i], ids)
        return out

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.known) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self.known[word] = ids
        return ids

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        codes, counts, words = factorize(texts)
        blobs = self._encode(words.to_pylist())
        lengths = np.array([len(b) >> 2 for b in blobs], np.int64)
        pool = np.frombuffer(b"".join(blobs), "<u4")
        each = lengths[codes]
        starts = (np.cumsum(lengths) - lengths)[codes]
        return gather(pool, starts, each), sums(each, counts)


@lru_cache(maxsize=2)
def worker_tokens(path: str) -> WordTokens:
    """The encoder of this Python worker; later tasks find its words again."""
    return WordTokens(path)


def release_words() -> None:
    """Forget this worker's encoders and their words, for tasks of other operators that need the memory."""
    worker_tokens.cache_clear()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind each text's ids."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id), counts + 1
