"""How far the word use of every source of a language lies from that of its other sources.

Counts of (language, source, term) are made in Arrow and summed in one shuffle. Divergences of pairs of
sources are sums over all kept terms, so they are cut into a cube: a cell is a pair of source blocks
and a block of terms. Each cell gets the two slices of the counts that it needs, the slices are
repeated over the blocks they meet, and the partial sums of the cells are added along the term axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import indexed_words, join_groups
from termloom.plans.staging import write_stage

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# A cell holds up to two blocks of about this many sources by one block of about this many terms.
SOURCES_A_BLOCK = 16
TERMS_A_BLOCK = 16_384

# ASCII letters in lower case and bytes above 0x7F belong to terms; any other byte ends one.
_LETTERS = bytes(b if b > 0x7F else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def _terms_only(texts: pa.Array) -> pa.Array:
    """The texts with blanks for all that is no part of a term, and A to Z in small letters."""
    texts = texts.cast(pa.string())
    start, data = texts.offset, texts.buffers()[2]
    plain = pa.py_buffer(data.to_pybytes().translate(_LETTERS) if data else b"")
    whole = pa.Array.from_buffers(pa.string(), start + len(texts), [texts.buffers()[0], texts.buffers()[1], plain])
    return whole[start:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (language, source, term) of runs of about 16 MB."""
    for batch in batches:
        langs, sources = (batch.column(c).dictionary_encode() for c in (0, 1))
        names = langs.dictionary, sources.dictionary
        lang_of, source_of = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (langs, sources))
        group_of = lang_of * len(names[1]) + source_of
        done = 0
        for words, places, ends in indexed_words(_terms_only(batch.column(2)), 16 << 20):
            n_docs = len(ends) - 1
            docs = np.repeat(np.arange(n_docs), np.diff(ends))
            blank = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))
            real = ~np.isin(places, blank)
            # A document's terms once each, with their number, then the same of a group.
            of_doc, times = np.unique(docs[real] * len(words) + places[real], return_counts=True)
            term = of_doc % len(words) if len(words) else of_doc
            group = group_of[done + (of_doc // len(words) if len(words) else of_doc)]
            found, place = np.unique(group * max(len(words), 1) + term, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, place, times)
            terms, groups = found % max(len(words), 1), found // max(len(words), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    names[0].take(pa.array(groups // len(names[1]))),
                    names[1].take(pa.array(groups % len(names[1]))),
                    words.take(pa.array(terms)).cast(pa.string()),
                    pa.array(total),
                    pa.array(np.bincount(place, minlength=len(found)).astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "n_docs"],
            )
            done += n_docs


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (lang, source, term, n) of the terms in at least ``min_docs`` documents of a language.

    ``n_lang`` is the term's count in the whole language; ``first`` is true on one row of each (lang, term).
    """
    found = docs.mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    # Dealt by (lang, term), so that the sums of a source and those of the language need no other shuffle.
    sums = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("d"))
    same = Window.partitionBy("lang", "term")
    return (
        sums.withColumn("docs_lang", F.sum("d").over(same))
        .withColumn("n_lang", F.sum("n").over(same))
        .withColumn("first", F.col("source") == F.min("source").over(same))
        .filter(F.col("docs_lang") >= min_docs)
        .select("lang", "source", "term", "n", "n_lang", "first")
    )


def _share(n: Column | str, total: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + vocab)), in whole numbers of 38 digits; 1 without terms."""
    n = F.col(n) if isinstance(n, str) else n
    over = F.col(total) + F.col("vocab")
    top = (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    whole = F.call_function("div", top, F.when(over > 0, over).cast("decimal(19,0)"))
    return 1 + F.coalesce(whole, F.lit(0)).cast("long")


def _far(p: str, q: str) -> Column:
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial divergences of all ordered pairs of sources that meet in a cell.

    Rows without a term state a source's share of a term it does not hold, and the kept terms of the block.
    """
    rows = rows.combine_chunks()
    x, y = key[1].as_py(), key[2].as_py()
    sources = rows["source"].combine_chunks().dictionary_encode()
    names, code = sources.dictionary, sources.indices.to_numpy(zero_copy_only=False)
    share = rows["p"].to_numpy()
    terms = rows["term"].combine_chunks().dictionary_encode()
    stated = terms.indices.is_null().to_numpy(zero_copy_only=False)
    absent, block = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    absent[code[stated]], block[code[stated]] = share[stated], rows["block"].to_numpy()[stated]
    held = np.repeat(absent[:, None], len(terms.dictionary), axis=1)
    at = terms.indices.drop_null().to_numpy(zero_copy_only=False)
    held[code[~stated], at] = share[~stated]
    rest = pc.max(rows["block_terms"]).as_py() - held.shape[1]
    froms, tos, values = [], [], []
    for a in range(len(names)):
        others = np.flatnonzero((block != block[a]) if x != y else (np.arange(len(names)) != a))
        apart, q = held[a] - held[others], held[others]
        gap = absent[a] - absent[others]
        froms.append(np.full(len(others), a))
        tos.append(others)
        values.append((apart * apart // q).sum(axis=1) + rest * (gap * gap // absent[others]))
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * sum(map(len, tos)), pa.string()),
            "source": names.take(pa.array(np.concatenate(froms), pa.int64())),
            "item": names.take(pa.array(np.concatenate(tos), pa.int64())),
            "value": pa.array(np.concatenate(values), pa.int64()),
        }
    )


def pair_divergences(kept: DataFrame, groups: DataFrame, scale: int, group_block: int, term_block: int) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of different sources of a language."""
    n_terms = F.greatest(F.ceil(F.col("vocab") / term_block), F.lit(1)).cast("long")
    n_blocks = F.ceil(F.col("n_sources") / group_block).cast("long")
    blocked = (
        F.pmod(F.xxhash64("source"), n_blocks).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("other"),
    )
    counted = join_groups(kept, groups, ["lang", "source"])
    shared = counted.select(
        "lang", "source", "term", _share("n", "n_source", scale).alias("p"), F.pmod(F.xxhash64("term"), n_terms).alias("terms"),
        F.lit(None).cast("long").alias("block_terms"), *blocked,
    )
    sizes = (
        join_groups(kept.filter("first"), groups.select("lang", "vocab").distinct(), ["lang"])
        .groupBy("lang", F.pmod(F.xxhash64("term"), n_terms).alias("terms"))
        .agg(F.count("*").alias("block_terms"))
    )
    absent = groups.withColumn("terms", F.explode(F.sequence(F.lit(0).cast("long"), n_terms - 1)))
    absent = join_groups(absent, sizes, ["lang", "terms"]).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), _share(F.lit(0), "n_source", scale).alias("p"), "terms",
        F.coalesce("block_terms", F.lit(0)).alias("block_terms"), *blocked,
    )
    cells = shared.unionByName(absent)
    cells = cells.select(
        "lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "terms",
        "source", "term", "p", "block", "block_terms",
    )
    parts = cells.groupBy("lang", "x", "y", "terms").applyInArrow(_cell, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    scale: int = SCALE,
    top: int = TOP_TERMS,
    group_block: int = SOURCES_A_BLOCK,
    term_block: int = TERMS_A_BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: sources by divergence (``pair``), telling terms (``term``).

    Null text, lang and source are read as empty. A group whose documents hold no kept term still has its
    pairs, of value 0 if its language keeps no term. A language of one source has no pairs. Repeated rows
    are documents of their own. Equal values rank by the bytes of the item. An empty table gives no rows.
    Only text, lang and source are read, so other columns may have any name.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = write_stage(kept_counts(docs, min_docs), "term_counts")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.sum(F.col("first").cast("long")).alias("new"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    groups = write_stage(groups.join(held, ["lang", "source"], "left").na.fill(0, ["n_source", "new"]), "source_sums")
    langs = groups.groupBy("lang").agg(
        F.sum("n_source").alias("n_all"), F.sum("new").alias("vocab"), F.count("*").alias("n_sources")
    )
    groups = write_stage(join_groups(groups, langs, ["lang"]).drop("new", "n_docs"), "source_sums")

    shares = join_groups(kept, groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "n_source", scale).alias("p"), _share("n_lang", "n_all", scale).alias("q")
    )
    telling = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    pairs = pair_divergences(kept, groups, scale, group_block, term_block)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(telling)
