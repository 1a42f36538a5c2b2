"""Operator 1, suffix-array dedup: threshold-bounded interval expansion over Burrows-Wheeler shards.

Two rules, together or alone: ``length``: a byte goes if a string of ``length`` bytes that covers it starts at another
place too, in any document; ``passage``: strings of ``passage`` bytes that stand in another document too, joined,
are a passage if they hold over ``words`` whole words.

Sharding. A window is a string of the smaller threshold's bytes. Consecutive windows whose least ``gram``-byte hash is
the same form a segment; equal windows have equal least hashes, so equal windows meet in the group of that hash,
wherever they stand. Segments whose hash stands once leave first, by the hash alone. A segment's context is the text
that strings of the larger threshold from its windows cover. Equal contexts (both hashes, 128 bits) are joined by an
aggregation: all their windows repeat, and one stands for all in what follows. Groups of several contexts, about
a sixth of the text's bytes on the test data, are concatenated into shards.

Shards. The suffixes are sorted as deep as the larger threshold needs (rank tripling), which gives the transform and
its last-to-first map. Intervals of strings are then extended to the left, breadth first: level l finds all places
where neighbouring suffixes share just l bytes, in increasing l, and stops at the threshold. Neighbours that no level
below it divided share a window; a window is in another document if its interval has suffixes of two.

A group with over ``max_group`` distinct contexts takes another exact way: digests of its single windows are counted
(combined before the shuffle) and joined back. No group, row set or list of a whole corpus is gathered anywhere; the
lists of spans that are gathered belong to one document and are bounded by its length. Texts are compressed when they
are shuffled.

Defined results: null and short texts lose nothing; every copy of a repeated passage goes, the first too; repeated
rows are repeats of each other; rows are told apart by their place in the input, never by doc_id. Bytes are judged
as UTF-8; where ``dedup`` has to give text again, a character that lost a part of its bytes goes as a whole. Passages
are cut from their first whole word to their last. Empty tables give empty results; extra columns stay in ``dedup``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.llm.common import mix64, packed_rows, powers, prefix_hash, stage, text_blocks, trim, with_row_id

LENGTH = 400
#: Bytes of the strings that passages are joined from: fewer than PASSAGE_WORDS words of running text have.
PASSAGE = 240
PASSAGE_WORDS = 50
#: Windows of a segment at most; over length - gram, so that only true repeats of a hash split a segment.
SEGMENT = 512
#: Bytes of one text that are cut into segments at once; below 2**24.
PIECE = 1 << 22
SHARD = 1 << 18
STOP = 0xFF  # never a byte of UTF-8
_NONE = np.zeros(0, np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of a block: row, start in the row, windows, context bytes, hash, context hash and whether the hash may recur inside, by segment."""
    parts = []
    for a in range(0, max(1, len(data)), PIECE):
        piece = data[a : a + PIECE + reach - 1]
        parts.append(_segments(piece, np.clip(offsets - a, 0, len(piece)), window, gram, reach, offsets, a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, reach: int, whole: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    n, width = len(data), window - gram + 1
    nw = min(n - window + 1, PIECE)
    if nw <= 0:
        return _NONE, _NONE, _NONE, _NONE, _NONE.astype(np.uint64), _NONE.astype(np.uint64), _NONE.astype(bool)
    p = prefix_hash(data)
    _, down = powers(n + 1)
    m = n - gram + 1
    h = mix64((p[gram:] - p[:m]) * down[:m])
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    # Least key in each run of ``width`` grams: suffix minima of a block and prefix minima of the next.
    x = np.concatenate([key, np.full(-m % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).reshape(-1)
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
    at = (np.minimum(behind[:nw], ahead[width - 1 : width - 1 + nw]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    least = h[at]
    starts = np.arange(nw)
    row = np.searchsorted(offsets, starts, side="right") - 1
    ok = starts + window <= offsets[row + 1]
    new = np.ones(nw, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, nw])
    good = ok[first]
    first, size = first[good], size[good]
    pieces = -(-size // SEGMENT)
    if (pieces > 1).any():
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, left = np.repeat(first, pieces) + inner * SEGMENT, np.repeat(size, pieces) - inner * SEGMENT
        size = np.minimum(left, SEGMENT)
    own = row[first]
    end = np.minimum(first + size + reach - 1, offsets[own + 1])
    length = end - first
    context = mix64((p[end] - p[first]) * down[first] + (size.astype(np.uint64) << np.uint64(32)) + length.astype(np.uint64))
    return own, first + base - whole[own], size, length, least[first], context, at[first] != at[first + size - 1]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first ``depth`` bytes (ties in any order)."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, STOP, np.uint8)]).astype(np.uint64)
    key = padded[:n].copy()
    for j in range(1, 8):
        key <<= np.uint64(8)
        key |= padded[j : n + j]
    order = np.argsort(key)
    key = key[order]
    start = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank[n] = n
    width, factor = 8, 3 if n < (1 << 21) - 1 else 2
    bits = np.uint64(21 if factor == 3 else 31)
    while width < depth:
        alone = start & np.r_[start[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        key = rank[at].astype(np.uint64)
        for j in range(1, factor):
            key <<= bits
            key |= rank[np.minimum(at + j * width, n)].astype(np.uint64)
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        split = np.r_[True, key[1:] != key[:-1]]
        start[slots] = split
        rank[at] = slots[np.maximum.accumulate(np.where(split, np.arange(len(slots)), 0))]
        width *= factor
    return order


def boundaries(text: np.ndarray, order: np.ndarray, levels: list[int]) -> list[np.ndarray]:
    """For each of the increasing ``levels``: for each slot 0 .. n whether the suffixes on its two sides share fewer bytes.

    Strings with STOP are never extended, so places that only they divide stay undivided.
    """
    n = len(text)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    before = order - 1
    last, to = text[before], slot[before]  # the transform, and last-to-first
    first = text[order]
    divided = np.zeros(n + 1, bool)
    divided[0] = divided[n] = True
    lo, hi = np.array([0]), np.array([n])
    out = []
    for level in range(1, levels[-1] + 1):
        size = hi - lo
        total = int(size.sum())
        if total:
            ends = np.cumsum(size)
            at = np.arange(total) + np.repeat(lo - ends + size, size)
            q = np.repeat(np.arange(len(lo)), size)
            ok = last[at] != STOP
            x = np.sort((to[at[ok]].astype(np.uint64) << np.uint64(32)) | q[ok].astype(np.uint64))
            lo = hi = _NONE
            if len(x):
                s, own = (x >> np.uint64(32)).astype(np.int64), x & np.uint64(0xFFFFFFFF)
                cut = np.r_[True, (s[1:] != s[:-1] + 1) | (own[1:] != own[:-1]) | (first[s[1:]] != first[s[:-1]])]
                lo = s[cut]
                hi = s[np.r_[np.flatnonzero(cut)[1:] - 1, len(s) - 1]] + 1
                fresh = ~divided[hi]
                lo, hi = lo[fresh], hi[fresh]
                divided[hi] = True
        if level in levels:
            out.append(divided.copy())
    return out


def repeated(contexts: list[bytes], windows: list[int], length: int | None, passage: int | None = None, owners: list[tuple[int, int]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context: which strings of ``length`` bytes from its first windows stand elsewhere in the shard too, and which of ``passage`` bytes in another row.

    ``owners`` has the least and the largest row that a context stands for.
    """
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"".join(c + bytes([STOP]) for c in contexts), np.uint8)
    levels = sorted({k for k in (length, passage) if k})
    order = suffix_order(text, levels[-1])
    divided = dict(zip(levels, boundaries(text, order, levels), strict=True))
    starts = np.cumsum(sizes) - sizes
    elsewhere, far = np.zeros(len(text), bool), np.zeros(len(text), bool)
    if length:
        elsewhere[order] = ~divided[length][:-1] | ~divided[length][1:]
    if passage:
        at = np.flatnonzero(divided[passage][:-1])
        lo, hi = (np.repeat(np.array(x, np.int64), sizes)[order] for x in zip(*owners, strict=True))
        two = np.minimum.reduceat(lo, at) != np.maximum.reduceat(hi, at)
        far[order] = np.repeat(two, np.diff(np.r_[at, len(text)]))
    cut = lambda flags, a, w, n, k: flags[a : a + max(0, min(w, n - k))] if k else flags[:0]
    return [(cut(elsewhere, a, w, n, length), cut(far, a, w, n, passage)) for a, w, n in zip(starts.tolist(), windows, sizes.tolist(), strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


#: A segment: its group, its context's hash, place, windows, context bytes, and 2 if its group's hash may recur in it.
_SEGMENT = "h long, c long, _sl_row long, start long, size int, len int, n int"
_WANTED = ("h", "c", "start", "size", "len", "many", "far", "hot")
_CONTEXT = "h long, c long, _sl_row long, size int, many boolean, far boolean, bytes binary"
#: Of a context: a span of repeated strings of ``length`` bytes (to any_end), of ``passage`` bytes in another row (to far_end).
_MARK = "h long, c long, a long, any_end long, far_end long"


def _segment_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int, reach: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("_sl_row").to_numpy(zero_copy_only=False)
        for a, to, data, offsets in text_blocks(b.column("text")):
            row, start, size, length, h, c, again = segments(data, offsets, window, gram, reach)
            cols = [h.view(np.int64), c.view(np.int64), ids[a:to][row], start, size.astype(np.int32), length.astype(np.int32), 1 + again.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "_sl_row", "start", "size", "len", "n"])
    trim()


def zipped(rows: DataFrame) -> DataFrame:
    """The text compressed, as ``_sl_blob``: texts cross the network in this form."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            blobs = [z.compress(x.as_buffer()) if x.is_valid else None for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(blobs, pa.binary())], [*names, "_sl_blob"])
        trim()

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("_sl_blob", T.BinaryType())]))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context bytes of each wanted segment of a document."""
    names = ["h", "c", "_sl_row", "size", "many", "far", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
    z = zstandard.ZstdDecompressor()
    for b in batches:
        out: dict[str, list] = {k: [] for k in names}
        for row, blob, wanted in zip(b.column("_sl_row").to_pylist(), b.column("_sl_blob"), b.column("wanted").to_pylist(), strict=True):
            raw = z.decompress(blob.as_buffer())
            for w in wanted:
                for k in ("h", "c", "size", "many", "far"):
                    out[k].append(w[k])
                out["_sl_row"].append(row)
                out["bytes"].append(raw[w["start"] : w["start"] + w["len"]])
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds, strict=True)], names)
    trim()


def _owner(row: int, far: bool) -> tuple[int, int]:
    return (-1, 1 << 62) if far else (row, row)


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], ["h", "c", "a", "any_end", "far_end"])


def _shards(batches: Iterator[pa.RecordBatch], length: int | None, passage: int | None) -> Iterator[pa.RecordBatch]:
    """Marks of the contexts of a partition sorted by group, a shard of whole groups at a time."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        out = []
        found = repeated([x[6] for x in held], [x[3] for x in held], length, passage, [_owner(x[2], x[5]) for x in held])
        for (h, c, _, _, many, far, _), (elsewhere, other) in zip(held, found, strict=True):
            if length and not many:
                out += [(h, c, a, b + length - 1, None) for a, b in runs(elsewhere)]
            if passage and not far:
                out += [(h, c, a, None, b + passage - 1) for a, b in runs(other)]
        trim()
        return _marks(out)

    for b in batches:
        for x in zip(*(b.column(c).to_pylist() for c in ("h", "c", "_sl_row", "size", "many", "far", "bytes")), strict=True):
            if held and size >= SHARD and x[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(x)
            size += len(x[6]) + 1
    if held:
        yield flush()


_DIGEST = "k int, d1 long, d2 long, h long, c long, a long, many boolean, far boolean, low long, high long, n int"


def _window_digests(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Two independent 64-bit digests of every string of each length from a context's windows."""
    for b in batches:
        for h, c, row, size, many, far, raw in zip(*(b.column(x).to_pylist() for x in ("h", "c", "_sl_row", "size", "many", "far", "bytes")), strict=True):
            data = np.frombuffer(raw, np.uint8)
            _, down = powers(len(data) + 1)
            low, high = _owner(row, far)
            for k in lengths:
                w = min(size, len(data) - k + 1)
                if w <= 0:
                    continue
                d = []
                # The second digest is over pairs of bytes, mixed first, so that the two fail on different strings.
                for x in (data, mix64(data.astype(np.uint64) << np.uint64(8) | np.r_[data[1:], data[:1]])):
                    p = prefix_hash(x)
                    to = k - len(d)
                    d.append(mix64((p[to : to + w] - p[:w]) * down[:w]).view(np.int64))
                full = lambda v, t: np.full(w, v, t)  # noqa: E731, B023
                cols = [full(k, np.int32), *d, full(h, np.int64), full(c, np.int64), np.arange(w), full(many, bool), full(far, bool), full(low, np.int64), full(high, np.int64), full(2 if many else 1, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [x.split()[0] for x in _DIGEST.split(", ")])


def spans(rows: DataFrame, *, length: int | None = LENGTH, passage: int | None = None, gram: int | None = None, max_group: int = 4096) -> DataFrame:
    """(_sl_row, start, any_end, far_end): byte spans, which may overlap. Reads _sl_row and text.

    The union of start .. any_end is what strings of ``length`` bytes that stand elsewhere too cover; the union of
    start .. far_end what strings of ``passage`` bytes that stand in another row cover.
    """
    if length and passage and passage > length:
        # A context reaches over its own windows; what lies there is no other place, but always the same row.
        raise ValueError("passage has to be at most length")
    window, reach = min(k for k in (length, passage) if k), max(length or 0, passage or 0)
    gram = gram or max(1, 3 * window // 10)
    rows = rows.select("_sl_row", "text").where(F.octet_length("text") >= window)
    found = stage(rows.mapInArrow(lambda it: _segment_rows(it, window, gram, reach), _SEGMENT), "suffix-segments")
    often = found.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
    live = stage(found.join(often, "h", "left_semi"), "suffix-live")
    # One row for each distinct context, with one place of it; then what each group holds.
    contexts = live.groupBy("h", "c").agg((F.count(F.lit(1)) > 1).alias("many"), (F.min("_sl_row") < F.max("_sl_row")).alias("far"), F.max("n").alias("n"), F.min(F.struct("_sl_row", "start", "size", "len")).alias("at"))
    groups = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("recurs")).where("distinct > 1 or recurs > 1")
    open_ = stage(contexts.join(groups, "h").select("h", "c", "at.*", "many", "far", (F.col("distinct") > max_group).alias("hot")), "suffix-contexts")
    none = F.lit(None).cast("long")
    any_end = F.when(F.col("at.len") >= length, F.col("at.len").cast("long")) if length else none
    far_end = F.when(F.col("far"), (F.col("at.size") + passage - 1).cast("long")) if passage else none
    marks = contexts.where("many").select("h", "c", F.lit(0).cast("long").alias("a"), any_end.alias("any_end"), far_end.alias("far_end")).where("any_end is not null or far_end is not null")
    wanted = open_.groupBy("_sl_row").agg(F.collect_list(F.struct(*_WANTED)).alias("wanted"))

    def bytes_of(hot: bool) -> DataFrame:
        own = wanted.withColumn("wanted", F.filter("wanted", lambda w: w["hot"] if hot else ~w["hot"])).where(F.size("wanted") > 0)
        return zipped(rows).join(own, "_sl_row").mapInArrow(_contexts, _CONTEXT)

    calm = bytes_of(False).repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(lambda it: _shards(it, length, passage), _MARK)
    marks = marks.unionByName(calm)
    if open_.where("hot").limit(1).count():
        digests = bytes_of(True).mapInArrow(lambda it: _window_digests(it, sorted({k for k in (length, passage) if k})), _DIGEST)
        seen = digests.groupBy("k", "d1", "d2").agg((F.sum("n") > 1).alias("again"), (F.min("low") < F.max("high")).alias("apart")).where("again or apart")
        back = digests.join(seen, ["k", "d1", "d2"])
        own_any = F.when((F.col("k") == length) & F.col("again") & ~F.col("many"), F.col("a") + F.col("k")) if length else none
        own_far = F.when((F.col("k") == passage) & F.col("apart") & ~F.col("far"), F.col("a") + F.col("k")) if passage else none
        marks = marks.unionByName(back.select("h", "c", "a", own_any.alias("any_end"), own_far.alias("far_end")).where("any_end is not null or far_end is not null"))
    return live.select("h", "c", "_sl_row", "start").join(marks, ["h", "c"]).select("_sl_row", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("any_end")).alias("any_end"), (F.col("start") + F.col("far_end")).alias("far_end"))


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def passages(raw: bytes, found: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The joined spans with over ``words`` whole words, from the first such word to the last."""
    out = []
    for a, b in merge(found):
        own = [m.span() for m in _WORD.finditer(raw, a, b)]
        if own and a and raw[a - 1] not in _SPACES and own[0][0] == a:
            own = own[1:]
        if own and b < len(raw) and raw[b] not in _SPACES and own[-1][1] == b:
            own = own[:-1]
        if len(own) > words:
            out.append((own[0][0], own[-1][1]))
    return out


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for span in gone for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    rows = with_row_id(docs)
    found = spans(rows, **options).groupBy("_sl_row").agg(F.collect_list(F.struct("start", "any_end", "far_end")).alias("_sl_gone"))
    return zipped(rows).join(found, "_sl_row", "left")


def _texts(b: pa.RecordBatch) -> Iterator[tuple[bytes | None, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Of each row its bytes, the joined spans of strings that stand elsewhere, and those that stand in another row."""
    z = zstandard.ZstdDecompressor()
    for blob, gone in zip(b.column("_sl_blob"), b.column("_sl_gone").to_pylist(), strict=True):
        raw = z.decompress(blob.as_buffer()) if blob.is_valid and len(blob.as_buffer()) else None
        pick = lambda end: [(x["start"], x[end]) for x in gone or [] if x[end] is not None]  # noqa: E731, B023
        yield raw, merge(pick("any_end")), pick("far_end")


def report(docs: DataFrame, *, words: int = PASSAGE_WORDS, passage: int = PASSAGE, **options) -> DataFrame:
    """The op1 result: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and n_passages and passage_bytes, what passages of
    over ``words`` words that stand in another document there are."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, s, far in _texts(b):
                raw = raw or b""
                own = passages(raw, far, words)
                out.append((len(raw), sum(y - x for x, y in s), len(s), hashlib.sha256(_kept(raw, s)).hexdigest(), len(own), sum(y - x for x, y in own)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _with_spans(docs.select("doc_id", "text"), passage=passage, **options).drop("_sl_row")
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


def dedup(docs: DataFrame, *, words: int = PASSAGE_WORDS, **options) -> DataFrame:
    """All rows and columns of ``docs``, with what the rules of ``options`` (``length``, ``passage``) name cut from ``text``.

    ``n_chars``, if there, is made to fit.
    """
    packed, unpack = packed_rows(docs)
    schema = packed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if raw is None else _kept(raw, merge([*s, *passages(raw, far, words)])).decode("utf-8", "ignore") for raw, s, far in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("_sl_doc"), pa.array(texts, pa.string())], ["_sl_doc", "text"])
        trim()

    out = _with_spans(packed, **options).select("_sl_doc", "_sl_blob", "_sl_gone").mapInArrow(run, schema).select(*unpack)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """Plain Python, for tests: n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            k = r[i : i + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r in raw:
        s = merge([(i, i + length) for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1])
        out.append((len(r), sum(b - a for a, b in s), len(s), hashlib.sha256(_kept(r, s)).hexdigest()))
    return out


def brute_passages(texts: list[str | None], passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> list[tuple[int, int, str | None]]:
    """Plain Python, for tests: n_passages, passage_bytes and what is left of each text."""
    raw = [None if t is None else t.encode() for t in texts]
    homes: dict[bytes, set[int]] = {}
    for d, r in enumerate(raw):
        for i in range(len(r or b"") - passage + 1):
            homes.setdefault(r[i : i + passage], set()).add(d)
    out: list[tuple[int, int, str | None]] = []
    for r in raw:
        if r is None:
            out.append((0, 0, None))
            continue
        inside = bytearray(len(r))
        for i in range(len(r) - passage + 1):
            if len(homes[r[i : i + passage]]) > 1:
                inside[i : i + passage] = b"\x01" * passage
        gone = []
        for run in re.finditer(rb"\x01+", bytes(inside)):
            own = [w.span() for w in _WORD.finditer(r) if run.start() <= w.start() and w.end() <= run.end()]
            if len(own) > words:
                gone.append((own[0][0], own[-1][1]))
        out.append((len(gone), sum(b - a for a, b in gone), _kept(r, gone).decode()))
    return out


#: The same rows in DuckDB, over all windows of all texts (in hexadecimal).
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT r, i, md5(substr(hx, 2 * i + 1, 800)) AS m FROM (SELECT r, hx, unnest(range(0, CAST(length(hx) / 2 - 399 AS BIGINT))) AS i FROM d WHERE length(hx) >= 800)),
m AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
rep AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w WHERE m IN (SELECT m FROM m)),
sp AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM rep) GROUP BY r, g),
gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS s, a AS e FROM sp UNION ALL SELECT r, max(b), NULL FROM sp GROUP BY r),
kept AS (SELECT g.r, string_agg(CASE WHEN e IS NULL THEN substr(hx, 2 * s + 1) ELSE substr(hx, 2 * s + 1, 2 * (e - s)) END, '' ORDER BY s) AS hx FROM gap g JOIN d ON g.r = d.r GROUP BY g.r),
n AS (SELECT r, sum(b - a) AS gone, count(*) AS spans FROM sp GROUP BY r),
pw AS (SELECT r, i, md5(substr(hx, 2 * i + 1, 480)) AS m FROM (SELECT r, hx, unnest(range(0, CAST(length(hx) / 2 - 239 AS BIGINT))) AS i FROM d WHERE length(hx) >= 480)),
pm AS (SELECT m FROM pw GROUP BY m HAVING min(r) <> max(r)),
prep AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 240 THEN 0 ELSE 1 END AS fresh FROM pw WHERE m IN (SELECT m FROM pm)),
psp AS (SELECT r, min(i) AS a, max(i) + 240 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM prep) GROUP BY r, g),
run AS (SELECT psp.r, array_to_string(list_transform(regexp_extract_all(substr(hx, 2 * a + 1, 2 * (b - a)), '..'), lambda c: CASE WHEN c IN ('20', '09', '0A', '0B', '0C', '0D') THEN ' ' ELSE 'w' END), '') AS f,
 a > 0 AND substr(hx, 2 * a - 1, 2) NOT IN ('20', '09', '0A', '0B', '0C', '0D') AS cut_first, 2 * b < length(hx) AND substr(hx, 2 * b + 1, 2) NOT IN ('20', '09', '0A', '0B', '0C', '0D') AS cut_last FROM psp JOIN d ON psp.r = d.r),
whole AS (SELECT r, trim(CASE WHEN cut_last THEN regexp_replace(g, 'w+$', '') ELSE g END) AS g FROM (SELECT r, cut_last, CASE WHEN cut_first THEN regexp_replace(f, '^w+', '') ELSE f END AS g FROM run)),
p AS (SELECT r, count(*) AS n, sum(length(g)) AS size FROM whole WHERE len(regexp_extract_all(g, 'w+')) > 50 GROUP BY r)
SELECT doc_id, CAST(length(d.hx) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.hx, d.hx))) AS kept_sha256,
 coalesce(p.n, 0) AS n_passages, CAST(coalesce(p.size, 0) AS BIGINT) AS passage_bytes
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN kept ON d.r = kept.r LEFT JOIN p ON d.r = p.r
"""
