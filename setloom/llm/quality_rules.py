"""Operator 5, quality rules: a ledger of rule bits, policies over bit masks, ablations by bitwise aggregation.

``ledger`` evaluates every rule once for every row and stores the measurements and ``fail_bits`` (bit i: rule i
failed). A policy is a version name and a mask; ``apply_policy`` keeps the rows with no failed bit under it.
``ablate`` says in one aggregation what each rule of a policy does: rows that fail it, rows that fail nothing
else, rows kept without it. Measuring is a vectorised map over Arrow batches; everything after is built-in
functions; nothing but the ablation's counts is shuffled.

Words are ``[^\\x20\\x09-\\x0D]+``. Words, windows and lines are judged equal by their bytes: a block's distinct words and
lines get numbers, and windows the numbers of their halves' pairs; no hash stands for them. Defined results: a null text has no words, hence too few; equal rows are
measured equally; null ids stay; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import SPACE_SEP, per_row, separators, text_blocks, words_of
from setloom.shipping import ship

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim", "n_stutter")
REPEAT_WINDOW = 8
_SYMBOL = separators(b"#*$%&|<>")
_UPPER = separators(range(65, 91))
_ASCII_LETTER = _UPPER | separators(range(97, 123))
_BANG = separators(b"!")
#: Bytes that begin a character.
_LEAD = ~separators(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # a condition over the measurements


#: The position is the bit; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 5 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("capitals", "2 * n_upper > n_letters"),
    Rule("exclamations", "5 * n_exclaim > n_words"),
    Rule("no_letters", "n_letters = 0"),
    Rule("stuttered_words", "5 * n_stutter > n_words"),
)
BASE_MASK = 0b11
#: By version: all rules; or without those on the shape of words and capitals.
POLICIES = {"base": BASE_MASK, "v1": 0b1111111111, "lean": 0b1100001111}


def block_measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, counts, _ = words_of(data, offsets, SPACE_SEP, hashes=False)
    n = np.diff(counts)
    inside = ~SPACE_SEP[data]
    h = numbers(data[inside], ends - starts)
    out = {"n_words": n, "word_chars": per_row(inside & _LEAD[data], offsets)}
    for name, chars in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_exclaim", _BANG)):
        out[name] = per_row(chars[data], offsets)
    # Letters: ASCII ones and characters beyond ASCII.
    out["n_letters"] = per_row((_ASCII_LETTER[data] | (data >= 0xC0)), offsets)
    out["n_stutter"] = _stutters(h, counts)
    out["n_repeat_words"] = _repeats(h, counts)
    out["n_dup_lines"], out["n_lines"] = _dup_lines(data, offsets, starts)
    return out


def numbers(own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of a block's stretches, given their bytes in a row and their sizes: equal for equal bytes, and only then."""
    offs = np.concatenate([[0], np.cumsum(size)])
    col = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(own)])
    return col.dictionary_encode().indices.to_numpy().astype(np.int64)


def _stutters(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words equal to the word before them."""
    same = np.zeros(len(h) + 1, np.int64)
    same[1:-1] = h[1:] == h[:-1]
    same[counts] = 0
    c = np.concatenate([[0], np.cumsum(same)])
    return c[counts[1:]] - c[counts[:-1]]


def _repeats(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words in windows of REPEAT_WINDOW words that the row has twice or more."""
    m = max(0, len(h) - REPEAT_WINDOW + 1)
    covered = np.zeros(len(h) + 1, np.int64)
    if m:
        g, width = h, 1
        while width < REPEAT_WINDOW:  # a power of two: a window's number is that of its halves' pair
            g, width = np.unique(g[:-width] << 32 | g[width:], return_inverse=True)[1], 2 * width
        row = np.searchsorted(counts, np.arange(m), side="right") - 1
        ok = np.flatnonzero(np.arange(m) + REPEAT_WINDOW <= counts[row + 1])
        key = row[ok] << 32 | g[ok]
        order = np.argsort(key)
        s = key[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        at = ok[order[same]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + REPEAT_WINDOW, -1)
    hit = np.cumsum(covered)[:-1] > 0
    c = np.concatenate([[0], np.cumsum(hit)])
    return c[counts[1:]] - c[counts[:-1]]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the row, and lines with a word."""
    cut = separators(b"\n")
    # Lines are the "words" between newlines; empty ones have no word anyhow.
    s, e, counts, _ = words_of(data, offsets, cut, hashes=False)
    has = np.searchsorted(starts, e) > np.searchsorted(starts, s)
    row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))[has]
    key = row << 32 | numbers(data[~cut[data]], e - s)[has]
    order = np.argsort(key)
    later = np.zeros(len(order), bool)
    if len(order):
        later[1:] = key[order][1:] == key[order][:-1]
    n = len(counts) - 1
    return np.bincount(row[order[later]], minlength=n), np.bincount(row, minlength=n)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [block_measures(data, offsets) for _, _, data, offsets in text_blocks(b.column("text"))]
            cols = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols)], ["doc_id", *MEASURES])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def fail_bits() -> Column:
    return sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and the failure bits, policy-free."""
    return measure(docs).withColumn("fail_bits", fail_bits())


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    return book.withColumn("base_failed", failed("base")).withColumn("kept", ~failed(policy) & ~failed("base"))


def ablate(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, fail only it, and would be kept without it; all in one pass."""
    bits, mask = F.col("fail_bits"), POLICIES[policy]
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_or(bits), F.lit(0)).alias("any"), F.count_if(~failed(policy)).alias("kept")]
    own = [i for i in range(len(RULES)) if mask >> i & 1]
    for i in own:
        aggs += [F.count_if(bits.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}"), F.count_if((F.bit_count(bits.bitwiseAND(F.lit(mask))) == 1) & (bits.bitwiseAND(F.lit(1 << i)) != 0)).alias(f"o{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(RULES[i].name).alias("rule"), F.col(f"f{i}").alias("n_fail"), F.col(f"o{i}").alias("n_only"), (F.col("kept") + F.col(f"o{i}")).alias("n_kept_without"), (F.col("any").bitwiseAND(F.lit(1 << i)) != 0).alias("ever_fails")) for i in own]))
    return book.agg(*aggs).select(rows.alias("x")).select(F.lit(policy).alias("policy"), "x.*")


def rules_report(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The op5 result, with the ledger's bits, the verdict of the policy ``lean``, and ``only_rule``: the one rule of the policy that a row fails, so that its ablation would keep the row."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    name = F.coalesce(*[F.when(bits == 1 << i, F.lit(r.name)) for i, r in enumerate(RULES)])
    book = apply_policy(ledger(docs), policy).withColumn("kept_lean", ~failed("lean"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "kept_lean", name.alias("only_rule"))


def brute_force(text: str | None) -> dict[str, int]:
    """Plain Python, for tests."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(words[i : i + REPEAT_WINDOW]) for i in range(len(words) - REPEAT_WINDOW + 1))
    hit = {j for i in range(len(words) - REPEAT_WINDOW + 1) if seen[tuple(words[i : i + REPEAT_WINDOW])] > 1 for j in range(i, i + REPEAT_WINDOW)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
rw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
li AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(l) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
 FROM w LEFT JOIN rw USING (r) LEFT JOIN li USING (r)),
b AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
 + CASE WHEN n_dup_lines > 5 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
 + CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END + CASE WHEN 5 * n_exclaim > n_words THEN 128 ELSE 0 END + CASE WHEN n_letters = 0 THEN 256 ELSE 0 END + CASE WHEN 5 * n_stutter > n_words THEN 512 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, (fail_bits & 783) = 0 AS kept_lean,
 CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' WHEN 64 THEN 'capitals' WHEN 128 THEN 'exclamations'
 WHEN 256 THEN 'no_letters' WHEN 512 THEN 'stuttered_words' END AS only_rule FROM b
"""
