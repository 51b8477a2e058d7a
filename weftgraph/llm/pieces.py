"""SentencePiece encoding and decoding by streaming Viterbi.

Characters come one at a time. For the text up to each position the best segmentation ends in one piece, to
which a backpointer is kept; a window of the last positions, as many as the longest piece has characters, is
all that later pieces can start from. Whenever the paths back from every position of the window meet in one
border, the pieces before it are committed and forgotten, so memory does not grow with the text.

What "best" is follows the model's kind. In a unigram model it is the largest sum of scores. In a model of
merged pairs a segmentation is the library's exactly when each two neighbours in it, on their own, are left
apart by the merges; each prefix of a text has one such segmentation, so the search keeps the one piece that
agrees with its predecessor.

Characters outside the vocabulary become byte pieces, where the model has them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, small_batches
from .word_memo import WordMemo

SPACE = "▁"
UNIGRAM, MERGES = 1, 2
#: The longest word, in characters, that is searched beside its neighbours in order; longer ones come as a stream.
SHORT = 1000


class Pieces(WordMemo):
    """A SentencePiece model without normalisation rules (identity, spaces kept, one space put in front)."""

    def __init__(self, path: str | None = None, *, proto: bytes | None = None, memo: int = 1_500_000):
        super().__init__({}, memo)
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        sp = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = model.ModelProto()
        spec.ParseFromString(sp.serialized_model_proto())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is are supported")
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        self.unknown = sp.unk_id()
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_of = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.worst = min(self.score.values()) - 10.0
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that join words are not supported")
        backwards = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.raw = [backwards.get(i) or (names[i].replace(SPACE, " ").encode() if names[i] in self.id_of else b" \xe2\x81\x87 " if i == self.unknown else b"") for i in range(n)]
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, n)
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size
        self.raw_pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.apart: dict[tuple[str, str], bool] = {}
        self.trees: dict[str, tuple[float, str, str]] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        self.names, self.apart_ids = names, {}
        ends: dict[str, set[int]] = {}
        for p in self.id_of:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: how long the pieces are that end in two characters, longest first
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}

    # -- which pieces may stand side by side in a merge model --------------------------------------

    def merge_tree(self, piece: str) -> tuple[float, str, str]:
        """When the merges have made a piece (its worst rank on the way), and the two halves of the last merge.

        A piece that the merges never make of its own characters is never ready.
        """
        found = self.trees.get(piece)
        if found is None:
            symbols, time, halves = list(piece), -1.0, ("", "")
            while len(symbols) > 1:
                scores = [self.score.get(x + y, -np.inf) for x, y in zip(symbols, symbols[1:])]
                best = max(scores)
                if best == -np.inf:
                    break
                at = scores.index(best)
                halves, time = (symbols[at], symbols[at + 1]), max(time, -best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            found = self.trees[piece] = (time if len(symbols) == 1 else np.inf, *halves)
        return found

    def _edge(self, piece: str, half: int) -> list[tuple[str, float, float]]:
        """The parts of a piece that lie at one of its ends, largest first: text, when made, when used up."""
        key = piece, half
        found = self.edges.get(key)
        if found is None:
            found, used = [], np.inf
            while piece:
                made, *halves = self.merge_tree(piece)
                found.append((piece, made, used))
                piece, used = halves[half], made
            self.edges[key] = found
        return found

    def _agree(self, left: str, right: str) -> bool:
        """Whether the merges leave two neighbours apart: no part at the end of the one is ever merged with a
        part at the begin of the other while both are there. Between equal ranks the left place goes first."""
        key = left, right
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            found = self.apart[key] = self._agrees(left, right)
        return found

    def _agrees(self, left: str, right: str) -> bool:
        if self.merge_tree(right)[0] == np.inf:
            return False
        if not left:
            return True
        ends, begins, i, j, joined = self._edge(left, 1), self._edge(right, 0), 0, 0, self.score
        while True:
            a, a_made, a_used = ends[i]
            b, b_made, b_used = begins[j]
            s = joined.get(a + b)
            if s is not None:
                time = max(-s, a_made, b_made)
                if time < a_used and time <= b_used:
                    return False
            if i + 1 < len(ends) and (a_made > b_made or j + 1 == len(begins)):
                i += 1
            elif j + 1 < len(begins):
                j += 1
            else:
                return True

    # -- the search --------------------------------------------------------------------------------

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of a text, each as soon as it is certain; characters outside the vocabulary alone."""
        window = ""  # characters since the last committed border
        last: list[str] = [""]  # the piece that ends at each border since then; the first is committed
        total: list[float] = [0.0]
        known, longest, merges = self.id_of, self.longest, self.kind == MERGES
        checked = 0
        for c in chars:
            window += c
            end = len(window)
            piece, best = "", None
            for size in range(min(longest, end), 0, -1):
                p = window[end - size :]
                if p not in known:
                    continue
                if merges:
                    before = last[end - size]
                    if before not in known:
                        before = ""
                    if self._agree(before, p):
                        piece = p
                        break
                else:
                    s = total[end - size] + self.score[p]
                    if best is None or s > best:
                        piece, best = p, s
            if not merges and c not in known:
                s = total[end - 1] + self.worst
                if best is None or s > best:
                    piece, best = c, s
            last.append(piece or c)
            total.append(best or 0.0)
            checked += 1
            # paths from all borders that a later piece can start from: do they meet?
            if checked >= 2 * longest:
                checked, low = 0, max(0, end - longest + 1)
                live = set(range(low, end + 1))
                while len(live) > 1:
                    far = max(live)
                    live.remove(far)
                    live.add(far - len(last[far]))
                meet = live.pop()
                if meet > 0:
                    yield from self._back(last, meet)
                    window = window[meet:]
                    del last[1 : meet + 1], total[1 : meet + 1]
                    last[0] = self.tail
        yield from self._back(last, len(window))

    def _back(self, last: list[str], at: int) -> list[str]:
        """Pieces from the committed border to border ``at``; remembers the last."""
        self.tail, out = last[at] if at else last[0], []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.id_of:
            return [self.id_of[piece]]
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in piece.encode()]

    # -- texts ---------------------------------------------------------------------------------------

    def _learn(self, words: Iterable[str], known: dict, lead: str) -> None:
        of, as_ids, words = self.piece_ids, known is self.ids_first or known is self.ids_next, set(words)
        short = sorted(w for w in words if self.kind == MERGES and len(w) <= SHORT)
        for w, ids in zip(short, self._short(short)):
            known[w] = np.array(ids, "<u4").tobytes() if as_ids else len(ids)
        for w in words.difference(short):
            ids = [i for p in self.stream((SPACE + w).replace(" ", SPACE)) for i in of(p)]
            known[w] = np.array(ids, "<u4").tobytes() if as_ids else len(ids)

    def _short(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of words in order, by the search of :meth:`stream` in a merge model.

        The piece that ends at a border depends on the characters before it alone, so a word takes over the
        backpointers of what it begins with as the one before it does. One character that is no piece is ``none``.
        """
        id_of, sizes, apart, names, none = self.id_of, self.sizes, self.apart_ids, self.names, len(self.names)
        text, size_at, id_at = "", [0], [none]  # of the piece that ends at each border
        for w in words:
            before, text = text, (SPACE + w).replace(" ", SPACE)
            n, most = 0, min(len(before), len(text))
            while n < most and before[n] == text[n]:
                n += 1
            del size_at[n + 1 :], id_at[n + 1 :]
            for end in range(n + 1, len(text) + 1):
                for size in sizes.get(text[end - 2 : end], ()) if end > 1 else ():
                    if size > end:
                        continue
                    right = id_of.get(text[end - size : end])
                    if right is None:
                        continue
                    key = id_at[end - size] << 32 | right
                    agree = apart.get(key)
                    if agree is None:
                        if len(apart) > 500_000:
                            apart.clear()
                        left = key >> 32
                        agree = apart[key] = self._agrees("" if left == none else names[left], names[right])
                    if agree:
                        size_at.append(size)
                        id_at.append(right)
                        break
                else:
                    size_at.append(1)
                    id_at.append(id_of.get(text[end - 1], none))
            out, at = [], len(text)
            while at:
                if id_at[at] == none:
                    out += self.piece_ids(text[at - 1])[::-1]
                else:
                    out.append(id_at[at])
                at -= size_at[at]
            out.reverse()
            yield out

    @staticmethod
    def words(text: str) -> list[str]:
        """Cut before each space that follows something else; a run of spaces stays with the word after it."""
        parts, out = text.split(" "), []
        spaces = ""
        for k, p in enumerate(parts):
            if p or k == len(parts) - 1:
                out.append(spaces + p)
                spaces = ""
            else:
                spaces += " "
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids: the pieces' bytes, without the space put in front."""
        size = self.raw_size[ids]
        upto = np.cumsum(size)
        flat = self.raw_pool[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.raw_begin[ids] - upto + size, size)].tobytes()
        return flat[1:] if flat[:1] == b" " else flat


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


KEPT.append(model.cache_clear)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_pieces, ids_crc32, round_trip[, ids]``.

    Ids are those of the sentencepiece library without begin or end. ``ids_crc32`` is of the ids as unsigned
    little-endian 32-bit integers; ``round_trip`` says whether decoding gives the text back (a text that holds
    the mark U+2581 itself does not). A null or empty text has no pieces; repeated rows give repeated rows; an
    empty table gives an empty one; other columns are not read. One narrow pass without a shuffle.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        for batch in batches:
            texts = batch.column(1)
            rows = []
            for doc, text, ids in zip(batch.column(0).to_pylist(), texts.cast(pa.large_binary()).to_pylist(), sp.ids(texts)):
                row = (doc, len(ids), zlib.crc32(ids.tobytes()), sp.decode(ids) == (text or b""))
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [f for f, _ in fields])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(work, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; a null list gives a null text; bytes that are no UTF-8 are replaced."""
    small_batches(encoded.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        for batch in batches:
            texts = [None if x is None else sp.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    narrow = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(work, "doc_id long, text string")
