"""Exact SentencePiece BPE encoding by backtracking.

A sequence of pieces is what the merges make of its text exactly if every two
neighbours are: merging the text of the two again must give the same two. So a
text is encoded from the left with the longest vocabulary match at each place
(an Aho-Corasick automaton lists the matches), keeping a piece only if it goes
with the one before; where no piece does, the last one is taken back and its
next shorter prefix tried, and a bitfield remembers the places from which
nothing led on. The merges of each piece are remembered, so merging two pieces
again only steps through both; pairs are remembered too.

Texts are cut before white space marks and around line ends, where the
vocabulary proves that no piece crosses, and the ids of each cut are kept in a
bounded memo, so the automaton sees every distinct word about once per task.
A worker lives as long as its executor and shares the executor's memory, so
what is remembered is packed: cuts with blanks, not marks (one byte a character
in most texts), ids as 32-bit numbers, pairs of pieces by the pieces' numbers.
The vocabulary's path is a parameter; the model is loaded once per worker and
decodes the ids.

Defined results: a null or empty text has no ids and decodes to an empty text;
characters outside the vocabulary become their bytes' pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space inside pieces
MEMO = 1 << 18  # cuts, pieces and pairs remembered per worker, each
NONE = float("-inf")  # the score of what is no piece


class PieceCodec:
    """Encoder for one SentencePiece BPE model with byte fallback and without
    text normalisation."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(m.get_piece_size()):
            if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i):
                continue
            self.ids[m.id_to_piece(i)] = i
            self.scores[m.id_to_piece(i)] = m.get_score(i)
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if m.is_unknown(self.byte_ids[0]):
            raise ValueError("the model has no byte pieces")
        if m.encode(" a  a ") != m.encode(" a  a ".replace(" ", MARK)):
            raise ValueError("the model normalises white space")
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross the cuts")
        self.cuts = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
        self.shown = [str(i) for i in range(m.get_piece_size())]
        # Two generations: what is used of the old one moves to the young one,
        # which takes its place when it is half of the memo.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[bool, list[float], list[str], list[str], int]] = {}
        self.numbers = 0  # of the pieces in ``known``, never dealt twice

    # -- merging two neighbours again ---------------------------------------
    def merges(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The pieces of a short text by its merges, the best score first, the
        leftmost of equals; the merges' scores in their order, and the first
        and the last part before each of them and at the end."""
        get, parts = self.scores.get, list(text)
        scores = [get(x + y, NONE) for x, y in zip(parts, parts[1:])]
        done, firsts, lasts = [], parts[:1], parts[-1:]
        while scores:
            best = max(scores)
            if best == NONE:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], NONE)
            done.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return parts, done, firsts, lasts

    def history(self, piece: str) -> tuple[bool, list[float], list[str], list[str], int]:
        """Whether the merges of a piece's characters reach it, the scores and
        outer parts on the way (see ``merges``), and its number, remembered."""
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            parts, *rest = self.merges(piece)
            self.numbers += 1
            found = self.known[piece] = (parts == [piece], *rest, self.numbers)
        return found

    def compatible(self, left: tuple, right: tuple) -> bool:
        """Whether merging the text of two pieces again gives both, from their
        histories, remembered."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        found = self.pairs[left[4] << 32 | right[4]] = self.stay_apart(left, right)
        return found

    def stay_apart(self, left: tuple, right: tuple) -> bool:
        """Each side merges as it does alone, the better next merge first,
        until the parts that meet in the middle would merge before either."""
        get, a, lasts, b, firsts = self.scores.get, left[1], left[3], right[1], right[2]
        i, j, n_a, n_b = 0, 0, len(a), len(b)
        while True:
            next_a = a[i] if i < n_a else NONE
            next_b = b[j] if j < n_b else NONE
            middle = get(lasts[i] + firsts[j])
            if middle is not None and middle > next_a and middle >= next_b:
                return False
            if next_a >= next_b:
                if i == n_a:
                    return True
                i += 1
            else:
                j += 1

    # -- one cut -------------------------------------------------------------
    def lengths(self, text: str) -> list[list[int]]:
        """For each place the lengths of the pieces that start there, shortest
        first; a character stands for itself, in the vocabulary or not."""
        at: list[list[int]] = [[1] for _ in text]
        for end, n in self.matches.iter(text):  # by their ends, so ascending at a start
            at[end - n + 1].append(n)
        return at

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text``, by longest matches and backtracking."""
        size, lengths = len(text), self.lengths(text)
        pairs, known = self.pairs, self.known
        failed = 0  # bit i: no way on from place i after what led there
        pieces: list[str] = []
        choice: list[tuple[int, tuple]] = []  # which of the lengths each piece took, its history
        at, pick, before = 0, len(lengths[0]) - 1, None
        while at < size:
            own, step = lengths[at], None
            while pick >= 0:
                n = own[pick]
                if not failed >> (at + n) & 1:
                    piece = text[at : at + n]
                    now = known.get(piece) or self.history(piece)
                    if now[0]:
                        fits = before is None or pairs.get(before[4] << 32 | now[4])
                        if fits is None:
                            fits = self.compatible(before, now)
                        if fits:
                            step = piece
                            break
                pick -= 1
            if step is None:
                if not pieces:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                at -= len(pieces.pop())
                pick = choice.pop()[0] - 1
                before = choice[-1][1] if choice else None
                continue
            pieces.append(step)
            choice.append((pick, now))
            before = now
            at += n
            pick = len(lengths[at]) - 1 if at < size else -1
        return pieces

    def cut_ids(self, cut: str) -> bytes:
        """The ids of a cut as 32-bit numbers."""
        out: list[int] = []
        for piece in self.pieces(cut.replace(" ", MARK)):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in piece.encode()]
        return np.array(out, np.int32).tobytes()

    def remembered(self, cut: str) -> bytes:
        """``cut_ids`` of a cut that the young generation lacks."""
        found = self.old.get(cut)
        if found is None:
            found = self.cut_ids(cut)
        if len(cut) <= 64:
            if 2 * len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            self.memo[cut] = found
        return found

    # -- whole texts -----------------------------------------------------------
    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """The ids and their decimal form joined by commas."""
        if not text:
            return [], ""
        packed = [self.memo.get(cut) or self.remembered(cut) for cut in self.cuts.findall(" " + text)]
        ids = np.frombuffer(b"".join(packed), np.int32).tolist()
        return ids, ",".join([self.shown[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return self.encode_with_text(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Every row of ``docs`` as ``(id, n_tokens, ids, decoded, ids_sha256,
    decoded_sha256)``; without ``with_ids`` the ids and the decoded text stay
    out and only their digests are returned."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, all_ids, texts, marks, text_marks = [], [], [], [], []
                for text in part.column(1):
                    ids, shown = own.encode_with_text(text.as_py() or "")
                    decoded = own.decode(ids)
                    n.append(len(ids))
                    marks.append(hashlib.sha256(shown.encode()).hexdigest())
                    text_marks.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        texts.append(decoded)
                columns = [part.column(0), pa.array(n, pa.int64())]
                names = ["id", "n_tokens"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                columns += [pa.array(marks, pa.string()), pa.array(text_marks, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids_sha256", "decoded_sha256"])

    both = "ids array<int>, decoded string, " if with_ids else ""
    schema = f"id long, n_tokens long, {both}ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, schema)
