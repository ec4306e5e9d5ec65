"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Base counts come from each whole text. Derived measures (mean word length, symbols and letters per
word, share of repeated lines and words) are integers in thousandths. A sketch is a log-linear
histogram in row form: (language, source, measure, bucket) -> count, where a bucket keeps a value's
seven leading bits, so a quantile is off by less than 1 in 64. Sketches merge by adding counts: those of
(language, source) give those of a language, and these the one of all rows.

Thresholds. RULES names for each measure two quantiles and a factor: the fence lies the factor times their
distance beyond the upper one (and the lower one, for word length), so what a sketch says of a group alone decides;
nothing is added to it. Of symbols most sound documents have none, so their quantiles are taken among the documents that
have any (SPARSE). A group's fence is then drawn towards that of its language, and this towards that of all
rows, by the weights rows : SHRINK, which leaves groups of many thousand rows as they are and lends small ones what
they lack, without a size at which the rule changes. A document is judged by its measure with one occurrence
less, so that a single symbol, capital or repeated line condemns none. The rows join the thresholds.

Skew: a hot source costs one row for each measure, bucket and task, as counts are combined before the
shuffle. The thresholds have a row for each (language, source), and Spark measures that table when it
chooses how to join; the rows carry counts but no texts.

Defined cases: a null or empty text has no words and fails the base rule; null language or source is a
group like any other; very long texts are counted whole; repeated rows are judged alike and all returned; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, need

#: The white space that parts words, and the symbols that count (fixed values of the contract).
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: measure -> (upper and lower quantile in thousandths, distances that the fence lies beyond, whether low values fail too).
#: Where most documents have none at all, the quartiles say nothing of how far the rest may go, so repetition takes high quantiles.
RULES = {
    "word_length": (750, 250, 5, True),
    "symbol_share": (750, 250, 5, False),
    "upper_share": (750, 250, 8, False),
    "dup_line_share": (980, 500, 2, False),
    "repeat_share": (980, 500, 2, False),
}
#: Measures that most sound documents have none of. Where the upper quantile is 0 it says nothing of how much is too much, so the
#: documents that have any are looked at alone (STEPS are quantiles of these, in thousandths). From what a single occurrence makes
#: in the shortest document judged, the widest gap between two steps parts a little from a lot, if one is GAP times
#: the other or more (in thousandths), and the fence lies in its midst; else it lies as far beyond the upper quartile as that is from the lower one, by ratio.
SPARSE, STEPS, GAP, LEAST = ("symbol_share",), tuple(range(50, 1000, 50)), 3000, 1000 // MIN_WORDS
#: Rows of the coarser level that a group's own rows are weighed against.
SHRINK = 200


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Those that occur once are let go after one sort of the bare
    hashes; where some repeat, (hash, position) pairs are sorted to find their places.
    """

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, x: F.struct(
            (a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")), lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        full = _let(_let(pairs, places), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(full)

    def hashes(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return _let(words, lambda w: _let(hashes(w), count))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_counts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, the counts of the base rule, n_upper (capital letters) and n_lines (lines with a word)."""
    rows = need(docs, *keys, text).withColumn(text, F.coalesce(text, F.lit("")))
    bare = F.translate(F.col(text), SPACES, "")
    trimmed = F.btrim(F.col(text), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return rows.select(
        *keys,
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(bare, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("rep"))).alias("words"),
    ).select(
        *keys, F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("words.rep").cast("long").alias("n_repeat_words"), "n_upper", F.col("lines.n").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: measure -> (count, by what it is divided, how many occurrences are forgiven when a document is judged).
SHARES = {
    "word_length": ("word_chars", "n_words", 0), "symbol_share": ("n_symbols", "n_words", 1), "upper_share": ("n_upper", "word_chars", 1),
    "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 1),
}


def measures() -> dict[str, Column]:
    """The measures in thousandths, and as judged (judged_...)."""
    part = lambda a, b, less: F.expr(f"greatest({a} - {less}, 0) * 1000 div greatest({b}, 1)")
    return {k: part(a, b, 0) for k, (a, b, _) in SHARES.items()} | {f"judged_{k}": part(*v) for k, v in SHARES.items()}


def bucket(value: str) -> Column:
    """The value with all but its seven leading bits cleared."""
    return F.expr(f"{value} - {value} % shiftleft(1L, greatest(length(bin({value})) - 7, 0))")


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows that pass the base rule."""
    made = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in RULES))
    long = counted.filter(~F.col("base_failed")).select("lang", "source", F.explode(made).alias("x")).select("lang", "source", "x.*")
    return long.groupBy("lang", "source", "measure", bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *level: str) -> DataFrame:
    """The sketch of a coarser level."""
    return sketch.groupBy(*level, "measure", "bucket").agg(F.sum("n").alias("n"))


def _beyond(k: str) -> str:
    """The upper fence of a measure from its quantiles, in SQL."""
    up, down, far, _ = RULES[k]
    wide = f"q{up} + {far} * (q{up} - q{down})"
    if k not in SPARSE:
        return wide
    return f"CASE WHEN q{up} > 0 THEN {wide} WHEN held750 IS NULL THEN NULL WHEN gap.r < {GAP} THEN held750 * held750 div held250 ELSE CAST(floor(sqrt(gap.a * gap.b)) AS BIGINT) END"


def _beyond_duck(k: str) -> str:
    """The same for DuckDB, which is given no column of gaps."""
    up, down, far, _ = RULES[k]
    wide = f"q{up} + {far} * (q{up} - q{down})"
    if k not in SPARSE:
        return wide
    steps = [str(LEAST), *(f"greatest(held{q}, {LEAST})" for q in STEPS)]
    ratios = [f"({b} * 1000 // {a})" for a, b in zip(steps, steps[1:], strict=False)]
    widest = f"greatest({', '.join(ratios)})"
    midst = " ".join(f"WHEN {r} = {widest} THEN CAST(floor(sqrt({a} * {b})) AS BIGINT)" for r, a, b in zip(ratios, steps, steps[1:], strict=False))
    return f"CASE WHEN q{up} > 0 THEN {wide} WHEN held750 IS NULL OR {widest} < {GAP} THEN held750 * held750 // held250 {midst} END"


def _fences(sketch: DataFrame, *level: str) -> DataFrame:
    """One row for each group of the level: rows, and high (and low) for each measure."""
    w = Window.partitionBy(*level, "measure")
    some = F.when(F.col("bucket") > 0, F.col("n")).otherwise(0)
    ranked = sketch.withColumns({"seen": F.sum("n").over(w.orderBy("bucket")), "rows": F.sum("n").over(w), "seen_held": F.sum(some).over(w.orderBy("bucket")), "held": F.sum(some).over(w)})
    at = sorted({q for rule in RULES.values() for q in rule[:2]})
    quantiles = ranked.groupBy(*level, "measure").agg(F.max("rows").alias("rows"), *(F.min(F.when(1000 * F.col("seen") >= q * F.col("rows"), F.col("bucket"))).alias(f"q{q}") for q in at),
        *(F.min(F.when((F.col("bucket") > 0) & (1000 * F.col("seen_held") >= q * F.col("held")), F.col("bucket"))).alias(f"held{q}") for q in STEPS))
    if SPARSE:
        quantiles = quantiles.withColumn("steps", F.array(F.lit(LEAST).cast("long"), *(F.greatest(f"held{q}", F.lit(LEAST).cast("long")) for q in STEPS)))
        quantiles = quantiles.withColumn("gap", F.expr(f"array_max(transform(sequence(0, {len(STEPS) - 1}), i -> struct(steps[i + 1] * 1000 div steps[i] AS r, -i AS i, steps[i] AS a, steps[i + 1] AS b)))"))
    of = lambda k, e: F.max(F.when(F.col("measure") == k, F.expr(e)))
    out = [F.max("rows").alias("rows")]
    for k, (up, down, far, both) in RULES.items():
        out += [of(k, _beyond(k)).alias(f"{k}_high")] + ([of(k, f"greatest(q{down} - {far} * (q{up} - q{down}), 0)").alias(f"{k}_low")] if both else [])
    return quantiles.groupBy(*level).agg(*out)


def thresholds(sketch: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """Thresholds for each (lang, source) seen."""
    lang = merged(sketch, "lang")
    top = _fences(merged(lang))
    names = [c for c in top.columns if c != "rows"]
    # The one row of all is a struct that every language gets, then every source from its language.
    drawn = lambda c, own, coarse: F.expr(f"coalesce(({own}.rows * {own}.{c} + {shrink} * {coarse}.{c}) div ({own}.rows + {shrink}), {coarse}.{c})").alias(c)
    every = top.select(F.lit(1).alias("one"), F.struct(*top.columns).alias("t"))
    mid = _fences(lang, "lang").withColumn("one", F.lit(1)).alias("m").join(every, "one").select("m.lang", *(drawn(c, "m", "t") for c in names))
    fine = _fences(sketch, "lang", "source").alias("f").join(mid.alias("m"), F.col("f.lang").eqNullSafe(F.col("m.lang")))
    return fine.select("f.lang", "f.source", *(drawn(c, "f", "m") for c in names))


def judge(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), shrink: int = SHRINK) -> DataFrame:
    """keys, the counts, base_failed and kept."""
    counted = base_counts(docs, text, (*keys, "lang", "source")).withColumn("base_failed", base_failed()).withColumns(measures())
    counted = materialize(counted, "quality")
    fences = thresholds(sketches(counted), shrink)
    joined = counted.alias("d").join(fences.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    inside = [F.col(f"judged_{k}") <= F.coalesce(f"{k}_high", f"judged_{k}") for k in RULES] + [F.col(f"judged_{k}") >= F.coalesce(f"{k}_low", f"judged_{k}") for k, v in RULES.items() if v[3]]
    kept = reduce(lambda a, b: a & b, inside, ~F.col("base_failed"))
    return joined.select(*(f"d.{c}" for c in (*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), kept.alias("kept"))


def judge_sql(shrink: int = SHRINK) -> str:
    """The same in DuckDB's SQL, over documents."""
    space = r"[\x20\x09-\x0D]"
    part = lambda a, b, less: f"greatest({a} - {less}, 0) * 1000 // greatest({b}, 1)"
    scaled = {k: part(a, b, 0) for k, (a, b, _) in SHARES.items()} | {f"judged_{k}": part(*v) for k, v in SHARES.items()}
    longs = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM c WHERE NOT base_failed" for k in RULES)
    at = sorted({q for rule in RULES.values() for q in rule[:2]})

    def fence(k: str) -> str:
        up, down, far, both = RULES[k]
        wide = f"{far} * (q{up} - q{down})"
        return f"max(CASE WHEN measure = '{k}' THEN {_beyond_duck(k)} END) AS {k}_high" + (f", max(CASE WHEN measure = '{k}' THEN greatest(q{down} - {wide}, 0) END) AS {k}_low" if both else "")

    def level(name: str, *by: str) -> str:
        g = "".join(f"{b}, " for b in by)
        return f"""{name}_q AS (SELECT {g}measure, max(total) AS total, {', '.join(f'min(CASE WHEN 1000 * seen >= {q} * total THEN bucket END) AS q{q}' for q in at)}, {', '.join(f'min(CASE WHEN bucket > 0 AND 1000 * seen_held >= {q} * held THEN bucket END) AS held{q}' for q in STEPS)}
          FROM (SELECT {g}measure, bucket, sum(sum(n)) OVER (PARTITION BY {g}measure ORDER BY bucket) AS seen, sum(sum(n)) OVER (PARTITION BY {g}measure) AS total,
            sum(sum(CASE WHEN bucket > 0 THEN n ELSE 0 END)) OVER (PARTITION BY {g}measure ORDER BY bucket) AS seen_held, sum(sum(CASE WHEN bucket > 0 THEN n ELSE 0 END)) OVER (PARTITION BY {g}measure) AS held FROM sk GROUP BY {g}measure, bucket)
          GROUP BY {g}measure),
        {name} AS (SELECT {g}max(total) AS total, {', '.join(map(fence, RULES))} FROM {name}_q {'GROUP BY ' + ', '.join(by) if by else ''})"""

    ends = [f"{k}_high" for k in RULES] + [f"{k}_low" for k, v in RULES.items() if v[3]]
    drawn = lambda own, coarse: ", ".join(f"CAST(coalesce(trunc(({own}.total * {own}.{c} + {shrink} * {coarse}.{c}) // ({own}.total + {shrink})), {coarse}.{c}) AS BIGINT) AS {c}" for c in ends)
    inside = " AND ".join([f"judged_{k} <= coalesce({k}_high, judged_{k})" for k in RULES] + [f"judged_{k} >= coalesce({k}_low, judged_{k})" for k, v in RULES.items() if v[3]])
    return rf"""
      WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
      w AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS ws,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, regexp_replace(text, '{space}', '', 'g') AS bare FROM d),
      tri AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c3) AS n FROM (
              SELECT doc_id, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c3 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w))),
      rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE n > 1) GROUP BY doc_id),
      b AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(bare) AS word_chars, length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
              length(regexp_replace(bare, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
            FROM w LEFT JOIN rep USING (doc_id)),
      c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {', '.join(f'{v} AS {k}' for k, v in scaled.items())} FROM b),
      sk AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS bucket, count(*) AS n FROM ({longs}) GROUP BY ALL),
      {level('fine', 'lang', 'source')}, {level('mid', 'lang')}, {level('top')},
      near AS (SELECT m.lang, {drawn('m', 't')} FROM mid m, top t),
      th AS (SELECT f.lang, f.source, {drawn('f', 'm')} FROM fine f JOIN near m ON f.lang IS NOT DISTINCT FROM m.lang)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
      FROM c LEFT JOIN th ON c.lang IS NOT DISTINCT FROM th.lang AND c.source IS NOT DISTINCT FROM th.source"""
