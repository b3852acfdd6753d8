"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text once. For every boundary it keeps the one piece that may end there: a piece
survives if it follows the survivor at its start, that is if merging the two together gives back the same
two pieces (for a model of merges, a sequence is the encoding when each adjacent pair is). New pieces can
only start within the last max_piece boundaries, so as soon as the backpointer paths from all of these meet
in one boundary, the ids before it are final: they are committed and forgotten.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import small_batches

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Encoded parts, of up to 64 characters, and pairs of pieces that a worker remembers at most; some 100 MB in all.
CACHED = 400_000
PAIRS = 600_000


class Codec:
    """A merge model with byte fallback, a leading space and no other normalisation; others are refused."""

    def __init__(self, model_file: str):
        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes_of, self.id_of, self.score, self.byte_id = [], {}, {}, [0] * 256
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            elif p.is_control(i):
                self.bytes_of.append(b"")
            else:
                self.id_of[piece], self.score[piece] = i, p.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        probe = " a  ﬁ ½\tb "
        if p.encode(probe, out_type=str)[0][0] != SPACE or p.decode(p.encode(probe)) != probe or not any(self.byte_id):
            raise ValueError(f"{model_file}: only models with byte fallback, a leading space and no normalisation are supported")
        self.max_piece = max(map(len, self.id_of))
        # No piece goes on after a space that follows something else: every path has a boundary there.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.id_of)
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}  # those of the last time that known was full
        self.halves = {x: h for x in self.id_of if len(x) > 1 and (h := self._last_merge(x))}
        # By piece of several characters: whether it may follow a piece, as far as that has come up.
        self.follows: dict[str, dict[str, bool]] = {x: {"": True} for x in self.halves}
        self.pairs = 0
        # By the three characters that end a longer piece: the lengths it can have, longest first.
        ends: dict[str, set[int]] = {}
        self.lengths: dict[str, tuple[int, ...]] = {}
        for x in self.halves:
            if len(x) > 2:
                ends.setdefault(x[-3:], set()).add(len(x))
            else:
                self.lengths[x] = (2,)
        for k, v in ends.items():
            self.lengths[k] = (*sorted(v, reverse=True), *self.lengths.get(k[1:], ()))

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None if the merges of its characters don't give it.

        Merges go best score first, leftmost on ties.
        """
        parts, score = list(piece), self.score
        while len(parts) > 2:
            found = [(-s, k) for k in range(len(parts) - 1) if (s := score.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return None
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0], parts[1]

    def _follows(self, left: str, right: str) -> bool:
        """Whether no merge joins left's end to right's beginning before each is complete.

        The merges of both are taken back, latest first; at each step, the parts that touch must not be
        mergeable with a better score than what was undone last.
        """
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 1
            for known in self.follows.values():
                known.clear()
                known[""] = True
        a, b, score, halves = left, right, self.score, self.halves
        ok, undone, last = True, None, 0  # score of the last merge taken back; last: 1 if it was left's, which goes first on ties
        while True:
            s = score.get(a + b)
            if s is not None and (undone is None or s > undone or s == undone and not last):
                ok = False
                break
            x, y = halves.get(a), halves.get(b)
            if x and (not y or score[a] < score[b]):
                undone, last, a = score[a], 1, x[1]
            elif y:
                undone, last, b = score[b], 0, y[0]
            else:
                break
        self.follows[right][left] = ok
        return ok

    def _ids(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")] if i is None else [i]

    def stream(self, text: str):
        """Lists of final ids, as the search commits them."""
        last: list[str] = [""]  # by boundary from base on: the piece that ends there
        base, every, lengths, follows = 0, 4 * self.max_piece, self.lengths.get, self.follows.get
        for end in range(1, len(text) + 1):
            for size in lengths(text[end - 3 : end] if end > 2 else text[:end]) or lengths(text[end - 2 : end], ()):
                start = end - size
                if start < base or (known := follows(text[start:end])) is None:
                    continue
                left = last[start - base]
                ok = known.get(left)
                if self._follows(left, text[start:end]) if ok is None else ok:
                    last.append(text[start:end])
                    break
            else:
                last.append(text[end - 1])
            if end - base >= every and end % self.max_piece == 0:
                ends = set(range(max(base, end - self.max_piece + 1), end + 1))
                while len(ends) > 1:
                    far = max(ends)
                    ends.discard(far)
                    ends.add(far - len(last[far - base]))
                meet = ends.pop()
                if meet > base:
                    yield self._path(last, meet - base)
                    last = last[meet - base :]  # its first piece stays, for what follows it
                    base = meet
        yield self._path(last, len(last) - 1)

    def _path(self, last: list[str], at: int) -> list[int]:
        pieces = []
        while at > 0:
            pieces.append(last[at])
            at -= len(last[at])
        return [i for p in reversed(pieces) for i in self._ids(p)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and for the empty text."""
        if not text:
            return []
        text, ids = SPACE + text.replace(" ", SPACE), []
        for part in self.segment.findall(text) if self.cuts else [text]:
            ids += self.known.get(part) or self._part(part)
        return ids

    def _part(self, part: str) -> tuple[int, ...]:
        found = self.before.get(part) or tuple(i for some in self.stream(part) for i in some)
        if len(part) <= 64:
            if 2 * len(self.known) >= CACHED:
                self.before, self.known = self.known, {}
            self.known[part] = found
        return found

    def decode(self, ids) -> str:
        """The text of ids; those outside the model raise IndexError."""
        if len(ids) and min(ids) < 0:
            raise IndexError("negative id")
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The worker's codec for a model file."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(model_file: str):
    """Column function: text to ids. Null and empty texts give no ids."""

    def run(texts: pd.Series) -> pd.Series:
        c = codec(model_file)
        return pd.Series([np.array(c.encode(t), np.int32) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR)


def decoder(model_file: str):
    """Column function: ids to text; null to null. Ids outside the model raise."""

    def run(each: pd.Series) -> pd.Series:
        c = codec(model_file)
        return pd.Series([None if ids is None else c.decode(ids.tolist()) for ids in each], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """docs with ids array<int> and n_ids long in place of columns of these names, one row per row of docs.

    Null and empty texts have no ids. Texts may be of any length: the search keeps a window of them only, besides
    the ids. Repeated rows are encoded each; an empty table gives none; other columns may have any name.
    """
    small_batches(docs.sparkSession)
    out = docs.drop("ids", "n_ids").withColumn("ids", encoder(model_file or model_path())("text"))
    return out.withColumn("n_ids", F.size("ids").cast("long"))


def digester(model_file: str):
    """Column function: text to the number of ids, the SHA-256 of the ids joined by commas, and whether decoding them gives the text back."""

    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(model_file), []
        for t in texts:
            ids = c.encode(t)
            shown = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            rows.append((len(ids), shown, c.decode(ids) == (t or "").replace(SPACE, " ")))
        return pd.DataFrame(rows, columns=["n_ids", "ids_sha256", "round_trip"])

    return F.pandas_udf(run, "n_ids long, ids_sha256 string, round_trip boolean", F.PandasUDFType.SCALAR)


def code_digest(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids joined by commas), round_trip: per row of docs, whether decoding gives the text back.

    The model writes a space as U+2581, so that character comes back as a space; null counts as the empty text.
    Texts may be of any length; repeated rows are encoded each; an empty table gives none; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", digester(model_file or model_path())("text").alias("r")).select("doc_id", "r.*")
