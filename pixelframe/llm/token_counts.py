"""Token counts as the tokenizers library gives them.

A huge document is encoded in overlapping chunks with offsets. Two neighbours are spliced at a place in
their overlap where words are sure to part, with the same tokens around it in both; where there
is none the overlap is widened, at last to both chunks whole. Words are sure to part at ASCII white space and at ASCII digits, each of
which is a word of its own to this kind of model. A chunk ends where such places are; a run without any is in one chunk whole. Shorter texts are spliced at every run of
ASCII white space, which this kind of model (white space dropped before words are cut) makes a boundary,
so each distinct word is encoded once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelframe.llm.common import small_batches

TOKENIZER = "word_bpe_49k.json"
CACHED = 500_000
SPACES, DIGITS = " \t\n\x0b\x0c\r", "0123456789"
PARTING = re.compile(f"[{SPACES}{DIGITS}]")


@dataclass(frozen=True)
class Chunks:
    """Texts of more than size code points are encoded in chunks of that size; neighbours overlap by overlap at first, and agree on agree tokens on each side of a splice."""

    size: int = 32_768
    overlap: int = 256
    agree: int = 3


class TokenCounter:
    """Counts without begin, end or added special tokens; special strings inside a text count as the library takes them."""

    def __init__(self, path: str, chunks: Chunks = Chunks()):
        self.tokenizer, self.chunks, self.known = Tokenizer.from_file(path), chunks, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = ["An  odd́\tprobe's", "1 é ", "ΣΑΣ x", "ΑΣ 1 Σa 2 ́b 1 2"]
        apart = [sum(len(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in p.split()) for p in probe]
        if [len(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in probe] != apart:
            raise ValueError(f"{path}: only tokenizers that drop white space and cut at it are supported")

    def _tokens(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens of a part of text, in places of the whole."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return [(a + start, b + start, i) for (a, b), i in zip(e.offsets, e.ids)]

    @staticmethod
    def _parts(text: str, at: int) -> bool:
        """Whether words are sure to part before this place."""
        return text[at - 1] in SPACES or text[at - 1] in DIGITS or text[at] in DIGITS

    def _end(self, text: str, end: int) -> int:
        """Where a chunk ends that has all up to end at least: places where words part are shortly before."""
        if end >= len(text):
            return len(text)
        m = PARTING.search(text, end - self.chunks.overlap)
        return end if m and m.end() < end else min(len(text), m.end() + self.chunks.size // 2) if m else len(text)

    def _low(self, text: str, left: list, end: int) -> int:
        """Where an overlap with left begins: as many places where words part are in it as a splice may need."""
        need, k = 4 * self.chunks.agree, len(left)
        while k > 1 and need:
            k -= 1
            need -= self._parts(text, left[k][0])
        return 0 if need else min(end - self.chunks.overlap, left[k][0])

    def _splice(self, text: str, left: list, right: list, low: int, high: int) -> tuple[int, int] | None:
        """How many tokens of left, and from which of right on, make one encoding; low to high: the overlap."""
        a = next((k for k, t in enumerate(left) if t[0] > low), len(left))
        at = {t: k for k, t in enumerate(right) if t[0] < high}
        n = self.chunks.agree
        for k in range(a + n, len(left) - n + 1):
            j = at.get(left[k])
            if j is not None and j >= n and left[k - n : k + n] == right[j - n : j + n] and left[k - 1][1] <= left[k][0] and self._parts(text, left[k][0]):
                return k, j
        return None

    def count_chunked(self, text: str) -> int:
        size, total = self.chunks.size, 0
        begin, end = 0, self._end(text, size)
        left = self._tokens(text, begin, end)
        while end < len(text):
            overlap = end - self._low(text, left, end)
            upto = self._end(text, end + size)
            while True:
                low = max(begin, end - overlap)
                right = self._tokens(text, low, upto)
                if low == begin:  # the overlap is all of the left chunk: right has both
                    left = right
                    break
                found = self._splice(text, left, right, low, end)
                if found:
                    total += found[0]
                    left, begin = right[found[1] :], right[found[1]][0]
                    break
                overlap *= 2
            end = upto
        return total + len(left)

    def count(self, texts: list[str | None]) -> list[int]:
        known, out, want = self.known, [], []
        if len(known) > CACHED:
            known.clear()
        for t in texts:
            if not t or len(t) > self.chunks.size:
                out.append(self.count_chunked(t) if t else 0)
                continue
            words = t.encode("utf-8", "surrogatepass").split()
            got = list(map(known.get, words))
            if None in got:
                want.append((len(out), Counter(w for w, g in zip(words, got) if g is None)))
                got = [g for g in got if g is not None]
            out.append(sum(got))
        new = list(dict.fromkeys(w for _, c in want for w in c))
        counts = {w: len(e.ids) for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False))}
        for k, c in want:
            out[k] += sum(n * counts[w] for w, n in c.items())
        known.update((w, n) for w, n in counts.items() if len(w) <= 64)
        return out


_counters: dict[tuple[str, Chunks], TokenCounter] = {}


def _counted(path: str, chunks: Chunks):
    def run(texts: pd.Series) -> pd.Series:
        if (path, chunks) not in _counters:
            _counters[path, chunks] = TokenCounter(path, chunks)
        return pd.Series(_counters[path, chunks].count(list(texts)), dtype="int64")

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, chunks: Chunks = Chunks(), limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per row of docs.

    Null counts as the empty text: 0 bytes and tokens. Repeated rows are counted each; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _counted(path or tokenizer_path(), chunks)("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
