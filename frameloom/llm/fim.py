"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text's units are runs of ASCII letters and single other code points. One byte stands for each code point, and
bytes.translate turns these into the digits of a class mask: bit i says that code point i is a letter. A unit begins
where no letter follows a letter, so `~(L & L << 1)` marks all first code points at once, and its bit_count is the number
of units. The place where a prefix ends is that of a ranked bit, found by halving the integer and counting the lower
half. All steps are linear in the text, whatever it holds.

The cut, the form and the order of parts follow from a hash of the document's key alone, so a lost task gives the
same rows again. Texts are cut where they are read (no shuffle); the original is rebuilt by column expressions
from the output and the form alone.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null key hashes like an
empty one; keys that repeat give the same cut shares; very long texts are cut whole; an empty table gives an
empty result; extra columns are ignored; keys named as results are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.common import need

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of these the percent with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of text that one Arrow batch of results is made of.
SLICE = 8_000_000
#: The digit of every byte in the mask of letters.
_LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
#: Below so many bits the ranked one is found by clearing those before it.
_SMALL = 64


def unit_starts(text: str) -> int:
    """A bit for every code point, the first lowest: whether a unit begins there."""
    if not text:
        return 0
    # Every code point becomes one byte; those beyond Latin-1 become a question mark, which is no letter either.
    letters = int(text.encode("latin-1", "replace").translate(_LETTERS)[::-1], 2)
    return ((1 << len(text)) - 1) & ~(letters & (letters << 1))


def ranked_bit(bits: int, width: int, rank: int) -> int:
    """Place of the set bit that has `rank` set bits below it, by halving."""
    if width <= _SMALL:
        for _ in range(rank):
            bits &= bits - 1
        return (bits & -bits).bit_length() - 1
    half = width // 2
    low = bits & ((1 << half) - 1)
    below = low.bit_count()
    if rank < below:
        return ranked_bit(low, half, rank)
    return half + ranked_bit(bits >> half, width - half, rank - below)


def transform(text: str, key: str, seed: str = "1") -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain), and the output of one text."""
    starts = unit_starts(text)
    n = starts.bit_count()
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or h[2] % 100 >= TRANSFORMED or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = (ranked_bit(starts, len(text), k) if k < n else len(text) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h[3] % 100 < SUFFIX_FIRST:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output of every row."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    if key in names:
        raise ValueError(f"the key {key} is named as a result")
    rows = need(docs, key, text).withColumns({text: F.coalesce(text, F.lit("")), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))}).select(key, "_key", text)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            for i in range(batch.num_rows):
                held.append(transform(batch[2][i].as_py(), batch[1][i].as_py(), seed))
                size += len(held[-1][4])
                if size >= SLICE or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch[0].slice(begin, len(held)), *(pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True))], [key, *names])
                    held, size, begin = [], 0, i + 1

    shape = T.StructType([rows.schema[key], *(T.StructField(a, b) for a, b in zip(names, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True))])
    return rows.mapInArrow(run, shape)


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text, from the output and its form.

    No part holds a sentinel, and no sentinel begins inside another, so the first place of each is the right one.
    """
    whole = F.col(output)
    p, s, m = (F.locate(x, whole) for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring(whole, m + 3, F.length(whole))
    psm = F.concat(F.substring(whole, F.lit(4), s - 4), middle, F.substring(whole, s + 3, m - s - 3))
    spm = F.concat(F.substring(whole, p + 3, m - p - 3), middle, F.substring(whole, F.lit(4), p - 4))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)


#: The same rows in DuckDB.
DIGESTS_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
