"""Operator 3, SentencePiece encoding and decoding: a max-plus parallel scan.

A text, with one space put before it, is cut into vocabulary pieces so that the sum of piece scores is largest (the
unigram rule; on equal sums the longer last piece). The file holds merge ranks, not probabilities, and a max-plus scan
needs scores that add up: a piece's score is the logarithm of its Zipf-Mandelbrot frequency at that rank, in thousandths,
so that sums are exact. These ids are therefore not those of the file's own merges. With ``file_ids`` a second column
holds those, as the sentencepiece library gives them with the file; words are merged on their own, since no piece goes
over a cut. A character of no piece is written as its bytes' pieces, so that decoding gives every text back exactly. No piece goes over a cut: a space after something else, or
a side of a line break. Words between cuts are therefore independent, and their pieces are kept in a bounded table; the
words that are new in a slice of texts are solved together, each step of the recurrence for all of them at once.

Giant texts, over ``giant`` characters, are split into chunks, whose rows spread over the cluster. A chunk yields a
transfer matrix: entry [s, t] is the best score of going from a piece boundary s characters before the chunk to one
t characters before its end. Matrices combine associatively in the max-plus semiring, in two levels of bounded
groups; the scan gives each chunk the best scores of its entry states. From these each chunk knows which entry every exit
state comes from; these maps, combined from the end, fix the states at all borders, ties included, and each chunk is then
backtraced on its own, to the same ids as the whole text. Spans of chunks are joined again by text. A chunk's matrix
costs its first and last words, and the sum of the words between.

Defined results: null and empty texts have no pieces and decode to the empty text; equal rows give equal rows; rows
are told apart by their place in the input, not by id; extra columns stay where the operator keeps the input's.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.llm.common import stage, trim, with_row_id
from setloom.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEVER = -1e18
#: Chunks whose matrices are multiplied in one group.
GROUP = 256
#: Words remembered, twice: those in use and those used before.
CACHE = 60_000
#: Words in a table of words before it's cut to the half that came most.
WORDS = 120_000
#: Characters of the longest words that are remembered, and that are solved together.
SHORT = 64


class Memo(dict):
    """A bounded memory of a function of short strings: what was used since the memory last filled stays."""

    def __init__(self, f) -> None:
        self.f = f
        self.old: dict = {}

    def __missing__(self, u: str):
        out = self.old.get(u)
        if out is None:
            out = self.f(u)
        if len(u) <= SHORT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[u] = out
        return out


class Words:
    """Ids of words by functions of many words, each distinct word once, in a table that is cut to the words that came most when it's full."""

    def __init__(self, *solvers) -> None:
        self.solvers = solvers
        self.slots = defaultdict(count().__next__)  # a new word takes the next slot
        self.uses = np.zeros(0, np.int64)
        self.flat = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in solvers]

    def ids_of(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each function the ids of the words in a row, and the n + 1 places where words begin and end."""
        if len(self.slots) > WORDS or any(len(ids) > 16 * WORDS for ids, _ in self.flat):
            self._shrink()
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        new = list(islice(self.slots, len(self.uses), None))
        if new:
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            for k, solve in enumerate(self.solvers):
                (ids, ends), (more, to) = self.flat[k], solve(new)
                self.flat[k] = np.concatenate([ids, more]), np.concatenate([ends, to[1:] + ends[-1]])
        self.uses += np.bincount(at, minlength=len(self.uses))
        return [_taken(ids, ends, at) for ids, ends in self.flat]

    def _shrink(self) -> None:
        names = list(self.slots)
        short = np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) <= SHORT)
        keep = np.sort(short[np.argsort(-self.uses[short], kind="stable")[: WORDS // 2]])
        self.slots = defaultdict(count(len(keep)).__next__, {names[i]: k for k, i in enumerate(keep.tolist())})
        self.uses = self.uses[keep] // 2
        self.flat = [_taken(ids, ends, keep) for ids, ends in self.flat]


def _taken(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at these slots, in this order, and the places where they begin and end."""
    size = ends[at + 1] - ends[at]
    bounds = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(ends[at] - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def zipf(rank: float) -> float:
    """Thousandths of the log frequency of the piece at a rank, 0 first: 1 / (10.4 * (rank + 2.7))."""
    return -float(round(1000 * (math.log(rank + 2.7) + math.log(10.4))))


def _frozen(node: dict) -> tuple:
    return ({c: _frozen(x) for c, x in node.items() if c} or _NOTHING, *node.get("", (-1, None)))


_NOTHING: dict = {}


class Pieces:
    """A vocabulary with scores, read from a SentencePiece model file's bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [sp.unk_id()] * 256
        self.vocab: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own = piece.replace("▁", " ")
                self.vocab[own] = (i, zipf(-sp.get_score(i)))
                self.bytes_of[i] = own.encode()
        self.longest = max(map(len, self.vocab))
        self.unknown = min(s for _, s in self.vocab.values()) - 10_000.0
        tree: dict = {}
        for w, hit in self.vocab.items():
            node = tree
            for c in w:
                node = node.setdefault(c, {})
            node[""] = hit
        #: The vocabulary's tree: from a character to (tree below, piece's id, its score), the score None where no piece ends.
        self.tree = _frozen(tree)[0]
        self.model = model
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.vocab):
            raise ValueError("pieces that go over a space or a line break aren't supported")
        self.units = Memo(lambda u: self.solve(u)[0])
        self.merged = Memo(lambda u: array("i", self.library.encode(u)).tobytes())
        self.scores = Memo(lambda u: self.solve(u)[1])

    @cached_property
    def library(self):
        """The file's own merges, of words with their space. A message field that comes again is merged: normalizer_spec (3) with add_dummy_prefix (3) off."""
        import sentencepiece

        words = sentencepiece.SentencePieceProcessor()
        words.LoadFromSerializedProto(self.model + bytes([3 << 3 | 2, 2, 3 << 3, 0]))
        return words

    _UNITS = re.compile(r" +[^ \n]*|\n+|[^ \n]+")

    def best(self, t: str, starts: dict[int, float], end: int, first_to: int = 0) -> tuple[list[float], list[int]]:
        """Best scores of boundaries at 0 .. end, and where their last pieces begin, given those at ``starts``.

        A piece from a start before ``first_to`` has to end after it.
        """
        score, back = [NEVER] * (end + 1), [-1] * (end + 1)
        for s, x in starts.items():
            score[s] = x
        vocab, longest = self.vocab, self.longest
        for i in range(end):
            x = score[i]
            if x <= NEVER:
                continue
            least = first_to + 1 if i < first_to else i + 1
            if least == i + 1 and t[i] not in vocab and x + self.unknown > score[i + 1]:
                score[i + 1], back[i + 1] = x + self.unknown, i
            below, j = self.tree, i
            for c in t[i : min(end, i + longest)]:
                node = below.get(c)
                if node is None:
                    break
                below, _, own = node
                j += 1
                if j >= least and own is not None and x + own > score[j]:
                    score[j], back[j] = x + own, i
        return score, back

    def solve(self, u: str) -> tuple[bytes, float]:
        """Ids (32-bit integers) and score of a stretch that no piece leaves."""
        n, tree, longest = len(u), self.tree, self.longest
        score, back, last = [0.0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        vocab, unknown = self.vocab, self.unknown
        for i in range(n):
            x, below, j = score[i], tree, i
            if u[i] not in vocab and x + unknown > score[i + 1]:
                score[i + 1], back[i + 1], last[i + 1] = x + unknown, i, -1
            for c in u[i : i + longest]:
                node = below.get(c)
                if node is None:
                    break
                below, piece, own = node
                j += 1
                if own is not None:
                    own += x
                    if own > score[j]:
                        score[j], back[j], last[j] = own, i, piece
        ids, j = array("i"), n
        while j:
            if last[j] >= 0:
                ids.append(last[j])
            else:
                ids.extend([self.byte_ids[x] for x in reversed(u[back[j] : j].encode())])
            j = back[j]
        ids.reverse()
        return ids.tobytes(), score[n]

    @cached_property
    def steps(self) -> tuple[np.ndarray, ...]:
        """The tree in arrays: by character (one more for all others) the node it leads to from the root, 0 where it is no piece, and its
        column, 0 where no piece has it after its first; by node times columns plus column the next node, 0 where there is none; by
        node its score (-inf where no piece ends) and piece; the last node that has others below. These come first."""
        inner: list[tuple] = []
        leaves: list[tuple] = []
        below = [(-1, c, node) for c, node in self.tree.items()]
        while below:
            after = []
            for up, c, node in below:
                if node[0]:
                    inner.append((up, c, node))
                    after.extend((len(inner), d, x) for d, x in node[0].items())
                else:
                    leaves.append((up, c, node))
            below = after
        nodes = [*inner, *leaves]
        columns = {c: k for k, c in enumerate(sorted({c for up, c, _ in nodes if up > 0}), 1)}
        n = max(map(ord, {c for _, c, _ in nodes})) + 2
        first, column = np.zeros(n, np.int64), np.zeros(n, np.int64)
        column[[ord(c) for c in columns]] = list(columns.values())
        step = np.zeros((len(inner) + 1, len(columns) + 1), np.min_scalar_type(len(nodes)))
        score, piece = np.full(len(nodes) + 1, -np.inf), np.full(len(nodes) + 1, -1, np.int32)
        for k, (up, c, (_, i, own)) in enumerate(nodes, 1):
            if up > 0:
                step[up, columns[c]] = k
            elif own is not None:
                first[ord(c)] = k
            if own is not None:
                score[k], piece[k] = own, i
        return first, column, step.ravel(), score, piece, len(inner)

    def solve_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``solve`` of each word, in a row, and the n + 1 places where words begin and end.

        Words go side by side through the steps of ``solve``, in its order, so ties fall alike. Long words and those with characters
        of no piece go through ``solve``.
        """
        n = len(words)
        first, column, step, own, piece_of, inner = self.steps
        size = np.fromiter(map(len, words), np.int64, n)
        code = np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), len(first) - 1)
        begin = np.cumsum(size) - size
        node_of = first[code]
        odd = np.zeros(n, bool)
        odd[np.repeat(np.arange(n), size)[node_of == 0]] = True
        odd |= (size > SHORT) | (size == 0)
        alone = {i: np.frombuffer(self.solve(words[i])[0], np.int32) for i in np.flatnonzero(odd).tolist()}
        order = np.flatnonzero(~odd)
        order = order[np.argsort(-size[order], kind="stable")]
        length = size[order]
        at = np.cumsum(length + 1) - (length + 1)  # each word has a place for every boundary; the last has no character
        ends = at + length
        place = np.arange(length.sum()) + np.repeat(np.arange(len(order)), length)
        own_code = code[np.repeat(begin[order] - (np.cumsum(length) - length), length) + np.arange(len(place))]
        total = int(length.sum()) + len(order)
        start_node, kind = np.zeros(total, np.int64), np.zeros(total, np.int64)
        start_node[place], kind[place] = first[own_code], column[own_code]
        score, back, last = np.full(total, -np.inf), np.zeros(total, np.int64), np.zeros(total, np.int32)
        score[at] = 0.0
        columns = len(step) // (inner + 1)
        for i in range(int(length[0]) if len(length) else 0):
            here = at[: np.searchsorted(-length, -i)] + i
            x, node, to = score[here], start_node[here], here + 1
            while len(here):
                sums = x + own[node]
                better = np.flatnonzero(sums > score[to])
                hit = to[better]
                score[hit], back[hit], last[hit] = sums[better], here[better], piece_of[node[better]]
                node = step[np.where(node <= inner, node, 0) * columns + kind[to]]
                go = np.flatnonzero(node)
                here, x, node, to = here[go], x[go], node[go].astype(np.int64), to[go] + 1
        found, w, j = [], np.arange(len(order)), ends
        while len(w):
            found.append((order[w], last[j]))
            j = back[j]
            go = np.flatnonzero(j > at[w])
            w, j = w[go], j[go]
        many = np.zeros(n + 1, np.int64)
        for k, _ in found:
            many[k + 1] += 1
        for i, x in alone.items():
            many[i + 1] = len(x)
        bounds = np.cumsum(many)
        out = np.empty(bounds[-1], np.int32)
        for r, (k, piece) in enumerate(found, 1):
            out[bounds[k + 1] - r] = piece
        for i, x in alone.items():
            out[bounds[i] : bounds[i + 1]] = x
        return out, bounds

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The file's own merges of each word, in a row, and the n + 1 places where words begin and end."""
        rows = self.library.encode(words, num_threads=1)
        bounds = np.cumsum([0, *map(len, rows)])
        return np.fromiter(chain.from_iterable(rows), np.int32, bounds[-1]), bounds

    @cached_property
    def words(self) -> Words:
        return Words(self.solve_all)

    @cached_property
    def words_merged(self) -> Words:
        return Words(self.solve_all, self.merge_all)

    def encode_texts(self, texts: list[str | None], file_ids: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts in a row, with the n + 1 places where texts begin and end; with ``file_ids`` also those of the file's own merges."""
        rows = [self._UNITS.findall(" " + t) if t else [] for t in texts]
        bounds = np.cumsum([0, *map(len, rows)])
        return [(ids, ends[bounds]) for ids, ends in (self.words_merged if file_ids else self.words).ids_of([*chain.from_iterable(rows)])]

    def encode_part(self, t: str) -> bytes:
        return b"".join(map(self.units.__getitem__, self._UNITS.findall(t)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as 32-bit integers in a row."""
        return self.encode_part(" " + text) if text else b""

    def merge(self, text: str | None) -> bytes:
        """The ids that the file's own merges give, as 32-bit integers in a row."""
        return b"".join(map(self.merged.__getitem__, self._UNITS.findall(" " + text))) if text else b""

    def decode(self, ids: bytes | list[int]) -> str:
        ids = np.frombuffer(ids, np.int32).tolist() if isinstance(ids, bytes) else ids
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def score(self, ids) -> float:
        """The sum of scores of an encoding (a run of byte pieces of one character counts as one unknown)."""
        total, known = 0.0, {i: s for i, s in self.vocab.values()}
        for i in ids:
            if i in known:
                total += known[i]
            elif (self.bytes_of[i][0] & 0xC0) != 0x80:
                total += self.unknown
        return total

    def matrix(self, before: str, chunk: str) -> np.ndarray:
        """The chunk's transfer matrix; ``before`` holds the characters ahead of it (longest - 1, or all there are)."""
        k, t, a = self.longest, before + chunk, len(before)
        b = len(t)
        out = np.full((k, k), NEVER)
        cuts = (m for m in range(a, b + 1) if self._is_cut(t, m))
        first = next(cuts, None)
        if first is None:
            for s in range(min(a, k - 1) + 1):
                score, _ = self.best(t, {a - s: 0.0}, b, a)
                for e in range(min(k, b - a + s + 1)):
                    if b - e > a or (b - e == a and s == 0) or (s == e + (a - b) and b - e == a - s):
                        out[s, e] = score[b - e]
            return out
        last = next(m for m in range(b, first - 1, -1) if self._is_cut(t, m))
        head = np.full(k, NEVER)
        for s in range(min(a, k - 1) + 1):
            if first == a:
                head[s] = 0.0 if s == 0 else NEVER
            else:
                head[s] = self.best(t[:first], {a - s: 0.0}, first, a)[0][first]
        mid = sum(map(self.scores.__getitem__, self._UNITS.findall(t[first:last])))
        score, _ = self.best(t[last:], {0: 0.0}, b - last)
        tail = np.full(k, NEVER)
        for e in range(min(k, b - last + 1)):
            tail[e] = score[b - last - e]
        return np.maximum(head[:, None] + mid + tail[None, :], NEVER)

    def origins(self, before: str, chunk: str, alpha: np.ndarray) -> np.ndarray:
        """For each exit state of the chunk the entry state that the best way to it comes from, given the best scores of the entry states."""
        t, a = before + chunk, len(before)
        b = len(t)
        starts = {a - s: float(x) for s, x in enumerate(alpha[: a + 1]) if x > NEVER}
        end = next((m for m in range(a, b + 1) if self._is_cut(t, m)), b)
        if end == a:
            return np.zeros(self.longest, np.int32)
        _, back = self.best(t[:end], starts, end, a)

        def entry(j: int) -> int:
            while j > a:
                j = back[j]
            return max(a - j, 0) if j >= 0 else 0

        if end < b:
            return np.full(self.longest, entry(end), np.int32)
        return np.array([entry(b - e) if b - e > a else 0 for e in range(self.longest)], np.int32)

    def _is_cut(self, t: str, m: int) -> bool:
        """No piece can go over position m."""
        return 0 < m < len(t) and ((t[m] == " " and t[m - 1] != " ") or t[m] == "\n" != t[m - 1] or t[m - 1] == "\n" != t[m])


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.maximum((x[:, :, None] + y[None, :, :]).max(1), NEVER)


def forward(mats: list[np.ndarray], alpha: np.ndarray | None = None) -> list[np.ndarray]:
    """The best scores of the states at the n + 1 borders; from a text's begin if ``alpha`` isn't given."""
    if alpha is None:
        alpha = np.full(len(mats[0]), NEVER)
        alpha[0] = 0.0
    out = [alpha]
    for m in mats:
        out.append(np.maximum((out[-1][:, None] + m).max(0), NEVER))
    return out


def joined(maps: list[np.ndarray]) -> np.ndarray:
    """The map from exit to entry states of chunks in a row."""
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = m[out]
    return out


def borders(maps: list[np.ndarray], end: int = 0) -> list[int]:
    """The states at the n + 1 borders of the way that ends in ``end``."""
    out = [end]
    for m in reversed(maps):
        out.append(int(m[out[-1]]))
    return out[::-1]


#: Vocabularies of this Python worker by model file; a worker that is used again keeps its words.
_LOADED: dict[int, Pieces] = {}


class Shared:
    """Makes the vocabulary once in each Python worker, from the broadcast bytes."""

    def __init__(self, spark, model: str) -> None:
        with open(model, "rb") as f:
            raw = f.read()
        self.raw, self.key = spark.sparkContext.broadcast(raw), hash(raw)

    def get(self) -> Pieces:
        if self.key not in _LOADED:
            _LOADED.clear()
            _LOADED[self.key] = Pieces(self.raw.value)
        return _LOADED[self.key]


_ROW = "_sl_row"


def _id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and characters (a longer text is a slice of its own)."""
    size = pc.fill_null(pc.utf8_length(b.column("text").cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < b.num_rows:
        to = int(np.searchsorted(ends, ends[at] - size[at] + SLICE_CHARS, side="right"))
        to = min(max(to, at + 1), at + SLICE, b.num_rows)
        yield b.slice(at, to - at)
        at = to


def _encode_rows(batches: Iterator[pa.RecordBatch], shared: Shared, keep: list[str], digest: bool, file_ids: bool) -> Iterator[pa.RecordBatch]:
    p = shared.get()
    for b in (x for y in batches for x in _slices(y)):
        found = p.encode_texts(b.column("text").to_pylist(), file_ids)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)) for ids, ends in found]
        ids, ends = found[0]
        more = _digests(p, [ids[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]) if digest else []
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *lists, *more], [*keep, "ids", *["file_ids"] * file_ids, *(_DIGESTS if digest else [])])
    trim()


def _merge_rows(batches: Iterator[pa.RecordBatch], shared: Shared) -> Iterator[pa.RecordBatch]:
    p = shared.get()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(_ROW), _id_lists([p.merge(t.as_py()) for t in b.column("text")])], [_ROW, "file_ids"])


#: Rows of an Arrow batch, and characters of their texts, that are encoded at once.
SLICE = 1000
SLICE_CHARS = 1_000_000
_DIGESTS = ("n_pieces", "n_chars", "decoded_sha256")


def _digests(p: Pieces, rows: list) -> list[pa.Array]:
    """Number of pieces, and of the decoded text its characters and hash."""
    back = [p.decode(x) for x in rows]
    size = [len(x) // 4 if isinstance(x, bytes) else len(x) for x in rows]
    return [pa.array(size, pa.int64()), pa.array(list(map(len, back)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]


def _digest_rows(batches: Iterator[pa.RecordBatch], shared: Shared) -> Iterator[pa.RecordBatch]:
    p = shared.get()
    for b in batches:
        rows = [x.as_py() for x in b.column("ids")]
        yield pa.RecordBatch.from_arrays([*b.columns, *_digests(p, rows)], [*b.schema.names, *_DIGESTS])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, reach: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, text in zip(b.column(_ROW).to_pylist(), b.column("text"), strict=True):
            t = " " + text.as_py()
            for k, a in enumerate(range(0, len(t), chunk)):
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k], pa.int64()), pa.array([t[max(0, a - reach) : a]]), pa.array([t[a : a + chunk]])], [_ROW, "k", "before", "chunk"])


def _matrices(batches: Iterator[pa.RecordBatch], shared: Shared) -> Iterator[pa.RecordBatch]:
    p = shared.get()
    for b in batches:
        m = [p.matrix(x.as_py(), y.as_py()).tobytes() for x, y in zip(b.column("before"), b.column("chunk"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(_ROW), b.column("k"), pa.array(m, pa.binary())], [_ROW, "k", "m"])


def _load(m: bytes) -> np.ndarray:
    x = np.frombuffer(m)
    n = int(len(x) ** 0.5)
    return x.reshape(n, n)


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    out = _load(pdf["m"].iloc[0])
    for m in pdf["m"].iloc[1:]:
        out = times(out, _load(m))
    return pd.DataFrame({_ROW: [pdf[_ROW].iloc[0]], "g": [pdf["g"].iloc[0]], "m": [out.tobytes()]})


def _group_alphas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("g")
    alphas = forward([_load(m) for m in pdf["m"]])
    return pd.DataFrame({_ROW: pdf[_ROW].to_numpy(), "g": pdf["g"].to_numpy(), "alpha": [x.tobytes() for x in alphas[:-1]]})


def _alphas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    alphas = forward([_load(m) for m in pdf["m"]], np.frombuffer(pdf["alpha"].iloc[0]))
    return pd.DataFrame({_ROW: pdf[_ROW].to_numpy(), "k": pdf["k"].to_numpy(), "alpha": [x.tobytes() for x in alphas[:-1]]})


def _origins(batches: Iterator[pa.RecordBatch], shared: Shared) -> Iterator[pa.RecordBatch]:
    p = shared.get()
    for b in batches:
        maps = [p.origins(x, y, np.frombuffer(z)).tobytes() for x, y, z in zip(*(b.column(c).to_pylist() for c in ("before", "chunk", "alpha")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(_ROW), b.column("k"), pa.array(maps, pa.binary())], [_ROW, "k", "f"])


def _maps(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(f, np.int32) for f in pdf["f"]]


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    f = joined(_maps(pdf.sort_values("k")))
    return pd.DataFrame({_ROW: [pdf[_ROW].iloc[0]], "g": [pdf["g"].iloc[0]], "f": [f.tobytes()]})


def _group_borders(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("g")
    return pd.DataFrame({_ROW: pdf[_ROW].to_numpy(), "g": pdf["g"].to_numpy(), "end": borders(_maps(pdf))[1:]})


def _inner(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    s = borders(_maps(pdf), int(pdf["end"].iloc[0]))
    return pd.DataFrame({_ROW: pdf[_ROW].to_numpy(), "k": pdf["k"].to_numpy(), "enter": s[:-1], "leave": s[1:]})


def _backtrace(batches: Iterator[pa.RecordBatch], shared: Shared) -> Iterator[pa.RecordBatch]:
    p = shared.get()
    for b in batches:
        ids = []
        for before, chunk, enter, leave in zip(*(b.column(c).to_pylist() for c in ("before", "chunk", "enter", "leave")), strict=True):
            t = before[len(before) - enter :] + chunk
            ids.append(np.frombuffer(p.encode_part(t[: len(t) - leave]), np.int32))
        yield pa.RecordBatch.from_arrays([b.column(_ROW), b.column("k"), pa.array(ids, pa.list_(pa.int32()))], [_ROW, "k", "ids"])


def encode_giants(rows: DataFrame, shared: Shared, *, chunk: int, reach: int) -> DataFrame:
    """(_sl_row, ids) of rows (_sl_row, text) through the parallel scan."""
    cut = rows.where("text <> ''").mapInArrow(lambda it: _chunks(it, chunk, reach), f"{_ROW} long, k long, before string, chunk string")
    cut = stage(cut.repartition(F.col(_ROW), F.col("k")), "pieces-chunks")
    mats = cut.mapInArrow(lambda it: _matrices(it, shared), f"{_ROW} long, k long, m binary").withColumn("g", F.floor(F.col("k") / GROUP))
    mats = stage(mats, "pieces-matrices")
    products = mats.groupBy(_ROW, "g").applyInPandas(_product, f"{_ROW} long, g long, m binary")
    starts = products.groupBy(_ROW).applyInPandas(_group_alphas, f"{_ROW} long, g long, alpha binary")
    alphas = mats.join(starts, [_ROW, "g"]).groupBy(_ROW, "g").applyInPandas(_alphas, f"{_ROW} long, k long, alpha binary")
    maps = cut.join(alphas, [_ROW, "k"]).select(_ROW, "k", "before", "chunk", "alpha").mapInArrow(lambda it: _origins(it, shared), f"{_ROW} long, k long, f binary")
    maps = stage(maps.withColumn("g", F.floor(F.col("k") / GROUP)), "pieces-maps")
    ends = maps.groupBy(_ROW, "g").applyInPandas(_joined, f"{_ROW} long, g long, f binary").groupBy(_ROW).applyInPandas(_group_borders, f"{_ROW} long, g long, end int")
    inner = maps.join(ends, [_ROW, "g"]).groupBy(_ROW, "g").applyInPandas(_inner, f"{_ROW} long, k long, enter int, leave int")
    parts = cut.join(inner, [_ROW, "k"]).select(_ROW, "k", "before", "chunk", "enter", "leave").mapInArrow(lambda it: _backtrace(it, shared), f"{_ROW} long, k long, ids array<int>")
    joined = parts.groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"))
    return joined.select(_ROW, F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"))


_DIGEST_FIELDS = [T.StructField("n_pieces", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, keep: list[str], *, model: str = MODEL, giant: int = 65_536, chunk: int = 16_384, digest: bool = False, file_ids: bool = False) -> DataFrame:
    """The columns ``keep`` and ids of every row, with ``file_ids`` also those of the file's own merges, with ``digest`` also what the ids decode to.

    Only giant texts move between tasks.
    """
    shared = Shared(docs.sparkSession, model)
    reach = shared.get().longest - 1
    rows = with_row_id(docs.select(*keep, *({"text"} - set(keep))))
    small = rows.where(F.coalesce(F.length("text") <= giant, F.lit(True)))
    large = rows.where(F.length("text") > giant)
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", *["file_ids"] * file_ids)]
    plain = T.StructType([*rows.select(*keep).schema.fields, *lists])
    schema = T.StructType([*plain.fields, *_DIGEST_FIELDS]) if digest else plain
    out = small.mapInArrow(lambda it: _encode_rows(it, shared, keep, digest, file_ids), schema)
    ids = encode_giants(large.select(_ROW, "text"), shared, chunk=max(chunk, 2 * reach), reach=reach)
    giants = large.select(*keep, _ROW).join(ids, _ROW)
    if file_ids:
        giants = giants.join(large.select(_ROW, "text").mapInArrow(lambda it: _merge_rows(it, shared), f"{_ROW} long, file_ids array<int>"), _ROW)
    giants = giants.select(*keep, *(f.name for f in lists))
    return out.unionByName(giants.mapInArrow(lambda it: _digest_rows(it, shared), schema) if digest else giants)


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of each row's ``ids``; null ids decode to null."""
    shared = Shared(encoded.sparkSession, model)
    ship(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.get()
        for b in batches:
            col = b.column("ids")
            flat, offs, ok = col.values.to_numpy(zero_copy_only=False), col.offsets.to_pylist(), col.is_valid().to_pylist()
            out = [p.decode(flat[x:y].tolist()) if v else None for x, y, v in zip(offs, offs[1:], ok, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def tokenize(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep``, ids (with ``file_ids`` both kinds), n_pieces, n_chars and decoded_sha256 (of the decoded text's bytes) of every row."""
    return encode(docs, list(keep), digest=True, **options)


def as_unigram(model: bytes) -> bytes:
    """The same model file as a unigram model with this module's scores, for tests against the library.

    In the file, field 1 is a piece (its field 2 the score, a float), field 2 the trainer's (its field 3 the type).
    """

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (model[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not model[at - 1] & 128:
                return x, at

    at, out = 0, bytearray()
    while at < len(model):
        tag, to = varint(at)
        n, body = varint(to)
        if tag == (2 << 3 | 2):  # a repeated field's last value holds: appended
            spec = model[body : body + n] + b"\x18\x01"
            size, enc = len(spec), bytearray()
            while size > 127:
                enc.append(size & 127 | 128)
                size >>= 7
            enc.append(size)
            out += bytes([tag]) + enc + spec
        elif tag == (1 << 3 | 2):
            piece = bytearray(model[at : body + n])
            _, own = varint(body + 1)  # its text comes first
            to = own - body + varint(body + 1)[0]
            x = body - at + to
            if piece[x] == 0x15 and (old := struct.unpack("<f", piece[x + 1 : x + 5])[0]) <= 0 and piece[x + 5 :] in (b"", b"\x18\x01"):
                piece[x + 1 : x + 5] = struct.pack("<f", zipf(-old))
            out += piece
        else:
            out += model[at : body + n]
        at = body + n
    return bytes(out)
