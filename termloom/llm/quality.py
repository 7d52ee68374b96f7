"""Quality rules with adaptive thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD, fresh, join_groups
from termloom.plans.staging import write_stage

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# The sketch keeps one count for each power of GAMMA: quantiles are right within 1 %.
GAMMA = 1.01 / 0.99
ZERO = -1_000_000
# Groups with fewer documents use the sketch of their language, and that failing the one of all.
MIN_DOCS = 100
# Widths of a fence beyond the quartiles, and the least width of each measure.
REACH = 6.0
SHORT = 20.0
LEAST = {"word_length": 0.4, "symbol_share": 0.005, "dup_line_share": 0.08}


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of five words found twice or more in the text, first ones included.

    Runs are compared by 64-bit hash. Only texts in which some hash occurs twice sort positions.
    """
    count = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def any_twice(h: Column) -> Column:
        return F.size(F.array_distinct(h)) < F.size(h)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.transform(
            F.array(pairs),
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        p,
                        lambda x, k: (x["h"] == F.coalesce(F.get(p, k - 1)["h"], F.bitwise_not(x["h"])))
                        | (x["h"] == F.coalesce(F.get(p, k + 1)["h"], F.bitwise_not(x["h"]))),
                    ),
                    lambda x: x["i"],
                )
            ),
        )[0]

    def length(at: Column) -> Column:
        """Words covered by runs that start at the sorted positions ``at``."""
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def total(h: Column) -> Column:
        spans = F.transform(F.array(covered(h)), length)
        return F.when(any_twice(h), spans[0]).otherwise(F.lit(0).cast("long"))

    return F.when(count > WINDOW, F.transform(F.array(hashes), total)[0]).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] | None = None) -> tuple[DataFrame, dict]:
    """``docs`` (or its columns ``keep``) with base measures and rates; also their column names by measure."""
    kept = docs.columns if keep is None else list(keep)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    rates = tuple(LEAST)
    words, bare, *found = fresh(docs, "words", "bare", *names, *rates)
    at = dict(zip((*names, *rates), found))
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines, = fresh(docs, "text_lines")
    staged = docs.select(
        *kept,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias(words),
        F.translate(text, BLANK, "").alias(bare),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANK, "")) > 0).alias(lines),
    )
    counted = staged.select(
        *kept,
        F.size(words).cast("long").alias(at["n_words"]),
        F.length(bare).cast("long").alias(at["word_chars"]),
        (F.length(bare) - F.length(F.translate(F.col(bare), SYMBOLS, ""))).cast("long").alias(at["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(at["n_dup_lines"]),
        repeated_words(F.col(words)).alias(at["n_repeat_words"]),
        F.size(lines).cast("long").alias(at["n_lines"]),
    )
    rate = lambda a, b: F.col(at[a]).cast("double") / F.greatest(F.col(at[b]), F.lit(1))
    return counted.withColumns(
        {
            at["word_length"]: rate("word_chars", "n_words"),
            at["symbol_share"]: rate("n_symbols", "word_chars"),
            at["dup_line_share"]: rate("n_dup_lines", "n_lines"),
        }
    ), at


def base_failed(at: dict) -> Column:
    return (F.col(at["n_words"]) < 10) | (100 * F.col(at["n_repeat_words"]) > 20 * F.col(at["n_words"]))


def fences(measured: DataFrame, at: dict, lang: str = "lang", source: str = "source") -> DataFrame:
    """Quartiles of each rate for every language and source, from mergeable sketches.

    A sketch counts values by logarithmic bucket, so sketches of tasks, sources and languages merge
    by addition, in any order, with the same result. Documents without words are not counted.
    """
    values = F.explode(
        F.array(*[F.struct(F.lit(m).alias("rate"), F.col(at[m]).alias("value")) for m in LEAST])
    ).alias("m")
    bucket = F.when(F.col("m.value") <= 0, F.lit(ZERO)).otherwise(
        F.ceil(F.log(F.col("m.value")) / F.log(F.lit(GAMMA)))
    )
    sketch = (
        measured.filter(F.col(at["n_words"]) > 0)
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), values)
        .groupBy("lang", "source", F.col("m.rate").alias("rate"), bucket.cast("long").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    sketch = write_stage(sketch, "sketch")

    def quartiles(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "rate")
        upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ranked = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
        value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(
            2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1)
        )
        past = lambda q: F.min(F.when(F.col("upto") > q * (F.col("total") - 1), value))
        return ranked.groupBy(*keys, "rate").agg(
            F.max("total").alias("total"), past(0.25).alias("low"), past(0.75).alias("high")
        )

    own, by_lang, everything = quartiles(["lang", "source"]), quartiles(["lang"]), quartiles([])
    a, b, c = own.alias("a"), by_lang.alias("b"), everything.alias("c")
    joined = a.join(b, [F.col("a.lang").eqNullSafe(F.col("b.lang")), F.col("a.rate") == F.col("b.rate")]).join(
        F.broadcast(c), F.col("a.rate") == F.col("c.rate")  # one row for each rate
    )
    pick = lambda f: (
        F.when(F.col("a.total") >= MIN_DOCS, F.col(f"a.{f}"))
        .when(F.col("b.total") >= MIN_DOCS, F.col(f"b.{f}"))
        .otherwise(F.col(f"c.{f}"))
    )
    picked = joined.select("a.lang", "a.source", "a.rate", pick("low").alias("low"), pick("high").alias("high"))
    one = lambda m, f: F.max(F.when(F.col("rate") == m, F.col(f))).alias(f"{m}_{f}")
    return picked.groupBy("lang", "source").agg(*[one(m, f) for m in LEAST for f in ("low", "high")])


def judge(measured: DataFrame, at: dict, limits: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, Column]:
    """``measured`` joined to its limits, and the verdict: inside every fence and not failed."""
    given = [c for c in limits.columns if c not in ("lang", "source")]
    names = fresh(measured, *given)
    limits = limits.select(F.col("lang").alias(lang), F.col("source").alias(source), *[F.col(g).alias(n) for g, n in zip(given, names)])
    of = dict(zip(given, names))
    joined = join_groups(measured, limits, [lang, source])

    def width(m: str) -> Column:
        return REACH * F.greatest(F.col(of[f"{m}_high"]) - F.col(of[f"{m}_low"]), F.lit(LEAST[m]))

    # The mean of few words strays further.
    stray = width("word_length") * (1 + F.sqrt(SHORT / F.greatest(F.col(at["n_words"]), F.lit(1))))
    inside = (
        (F.col(at["word_length"]) <= F.col(of["word_length_high"]) + stray)
        & (F.col(at["word_length"]) >= F.col(of["word_length_low"]) - stray)
        & (F.col(at["symbol_share"]) <= F.col(of["symbol_share_high"]) + width("symbol_share"))
        & (F.col(at["dup_line_share"]) <= F.col(of["dup_line_share_high"]) + width("dup_line_share"))
    )
    return joined, F.coalesce(~base_failed(at) & inside, F.lit(False))


def quality_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base measures and verdict of every document.

    Thresholds are fences around the quartiles of a document's language and source: a document is
    kept if its mean word length, symbol share and share of repeated lines lie within them and it
    did not fail the base rules. Result: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``.

    A null or blank text has no words and fails. Null languages and sources are groups like others;
    repeated rows each count; an empty table gives no rows; other columns may have any name.
    """
    measured, at = measure(docs, text_column, (id_column, "lang", "source"))
    measured = write_stage(measured, "measures")
    joined, kept = judge(measured, at, fences(measured, at))
    return joined.select(
        id_column,
        *[F.col(at[m]).alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(at).alias("base_failed"),
        kept.alias("kept"),
    )


def filter_quality(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that ``quality_report`` keeps, with their own columns.

    Texts are measured twice, for the sketches and for the verdict, and never shuffled while the
    limits are few enough to broadcast.
    """
    measured, at = measure(docs, text_column)
    thin, thin_at = measure(docs, text_column, ("lang", "source"))
    joined, kept = judge(measured, at, fences(thin, thin_at))
    return joined.filter(kept).select(*docs.columns)
