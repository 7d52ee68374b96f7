"""Repeated passages by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import gram_codes, join_groups, word_codes
from termloom.plans.staging import salted_join, write_stage

# Words of a passage and of the grams among which positions are selected.
PASSAGE = 50
GRAM = 10
SALTS = 8


def minimisers(codes: np.ndarray, passage: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes): the smallest gram of every run of ``passage`` words.

    Two passages with the same words select the same place in both, whatever stands around them.
    """
    if len(codes) < passage:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_codes(codes, gram)
    span = passage - gram + 1
    low = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1)
    at = np.unique(low + np.arange(len(low)))
    return at, hashes[at]


def _equal_ahead(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Equal leading words of the rows of ``a`` and ``b``, which hold ``na`` and ``nb`` words."""
    if a.shape[1] == 0:
        return np.zeros(len(a), np.int64)
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


class Neighbours:
    """Goes through sorted suffixes and compares each with its neighbours from other texts.

    ``reached`` collects (key, position, gram, ``most``, ``span``) of the suffixes whose match does not
    fill both sides: the most words that any other text repeats on the side that is sorted by (to the
    right, or to the left with ``backward``), and the longest span found.
    """

    def __init__(self, passage: int, gram: int, backward: bool = False) -> None:
        self.passage, self.gram, self.backward = passage, gram, backward
        self.reached: list[tuple] = []
        self._held: list[tuple] = []
        self._fresh = 0
        self._first = True

    def _spans(self, rows: list[tuple], start: int, stop: int) -> list[tuple]:
        """Spans of ``rows[start:stop]``; the neighbours of all of them are in ``rows`` if there are any."""
        if start >= stop:
            return []
        n, reach = len(rows), self.passage - self.gram
        keys = [r[0] for r in rows]
        change = np.array([True] + [a != b for a, b in zip(keys, keys[1:])])
        run = np.cumsum(change) - 1
        begins = np.flatnonzero(change)
        ends = np.append(begins[1:], n)
        ahead = np.frombuffer(b"".join(r[2].ljust(4 * self.passage, b"\0") for r in rows), ">u4").reshape(n, -1)
        behind = np.frombuffer(b"".join(r[3].ljust(4 * reach, b"\0") for r in rows), ">u4").reshape(n, reach)
        n_ahead = np.array([len(r[2]) // 4 for r in rows])
        n_behind = np.array([len(r[3]) // 4 for r in rows])
        found = []
        me = np.arange(start, stop)
        most, span = np.full(n, -1), np.zeros(n, np.int64)
        for other in (begins[run[me]] - 1, ends[run[me]]):
            real = (other >= 0) & (other < n)
            i, j = me[real], other[real]
            right = _equal_ahead(ahead[i], ahead[j], n_ahead[i], n_ahead[j])
            left = _equal_ahead(behind[i], behind[j], n_behind[i], n_behind[j])
            met = right >= self.gram
            good = met & (left + right >= self.passage)
            most[i] = np.maximum(most[i], np.where(met, left if self.backward else right, -1))
            span[i] = np.maximum(span[i], np.where(good, left + right, 0))
            found += [(keys[k], rows[k][1] - int(a), rows[k][1] + int(b)) for k, a, b in zip(i[good], left[good], right[good])]
        some = np.flatnonzero((most >= 0) & (span < self.passage + reach))
        self.reached += [(keys[k], rows[k][1], rows[k][4], int(most[k]), int(span[k])) for k in some]
        return found

    def add(self, rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(spans, edge rows) of the (key, position, words ahead, words behind, gram) given in order.

        The last run of one text waits for what follows it. The first rows of a task are edges, as
        their neighbour may be in the task before.
        """
        edges = []
        rows = self._held + rows
        if not rows:
            return [], []
        last = len(rows) - 1
        while last > 0 and rows[last - 1][0] == rows[-1][0]:
            last -= 1
        spans = self._spans(rows, self._fresh, last)
        if self._first and last:
            stop = 1
            while rows[stop][0] == rows[0][0]:
                stop += 1
            edges, self._first = rows[: stop + 1], False
        keep = max(0, last - 1)
        self._fresh = last - keep
        self._held = rows[keep:]
        return spans, edges

    def finish(self) -> tuple[list[tuple], list[tuple]]:
        return self._spans(self._held, self._fresh, len(self._held)), self._held


_SPAN = "key binary, start bigint, stop bigint, pos bigint, ahead binary, behind binary, gram bigint, most int, span int"


def _gram(gram: int) -> Column:
    return F.xxhash64(F.substring("ahead", 1, 4 * gram))


def _compare(sorted_rows: DataFrame, passage: int, gram: int, backward: bool) -> DataFrame:
    """Spans of sorted suffixes (``start`` set), the edge rows of each task (``ahead`` set), and what
    suffixes reach (``most`` set)."""
    schema = pa.schema(
        [("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("pos", pa.int64()), ("ahead", pa.binary()),
         ("behind", pa.binary()), ("gram", pa.int64()), ("most", pa.int32()), ("span", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Neighbours(passage, gram, backward)

        def batch(spans: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            rows = [(k, a, b, *[None] * 6) for k, a, b in spans]
            rows += [(k, None, None, pos, ahead, behind, g, None, None) for k, pos, ahead, behind, g in edges]
            rows += [(k, None, None, pos, None, None, g, most, span) for k, pos, g, most, span in walk.reached]
            walk.reached.clear()
            columns = zip(*rows) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for b in batches:
            yield batch(*walk.add(list(zip(*(c.to_pylist() for c in b.columns)))))
        yield batch(*walk.finish())

    return sorted_rows.select("key", "pos", "ahead", "behind", _gram(gram).alias("gram")).mapInArrow(run, _SPAN)


def _spans_in_order(
    suffixes: DataFrame, order: list[Column], passage: int, gram: int, backward: bool
) -> tuple[DataFrame, DataFrame]:
    """Spans (key, start, stop) found by sorting in ``order`` and comparing neighbours, also across
    tasks, and (key, pos, gram, most, span) of what the suffixes reach."""
    width = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("key"), F.col("pos")]
    ranged = suffixes.repartitionByRange(width, *order).sortWithinPartitions(*order)
    found = write_stage(_compare(ranged, passage, gram, backward), "backward" if backward else "forward")
    # Each task leaves its first and last runs, so this side grows with the tasks, not with the rows.
    edges = found.filter("ahead is not null").select("key", "pos", "ahead", "behind").distinct()
    across = _compare(edges.repartition(1).sortWithinPartitions(*order), passage, gram, backward)
    both = found.union(across)
    return (
        both.filter("start is not null").select("key", "start", "stop"),
        both.filter("most is not null").select("key", "pos", "gram", "most", "span"),
    )


def _unsettled(suffixes: DataFrame, right: DataFrame, left: DataFrame, passage: int, gram: int) -> DataFrame:
    """Spans that neighbours may miss: an exact look at the grams of suffixes that they do not settle.

    No match of a suffix goes further right than its best neighbour in forward order, or further left
    than its best in backward order. If one span reaches both, it holds all others. Where none does and
    both together are long enough, the suffix is open, and its passages are looked for by hash among those of all
    suffixes of its gram. Of each suffix only the passages within its own two bounds are made, as one that two
    texts share lies within the bounds of both; a suffix without bounds fills both sides. Suffixes with equal words
    on both sides, such as those of many copies, make their passages once.
    """
    none = F.lit(None).cast("int")
    reached = right.select("key", "pos", "gram", F.col("most").alias("right"), none.alias("left"), "span").union(
        left.select("key", "pos", "gram", none.alias("right"), F.col("most").alias("left"), "span")
    )
    most = reached.groupBy("key", "pos", "gram").agg(
        F.max("right").alias("right"), F.max("left").alias("left"), F.max("span").alias("span")
    )
    total = F.col("right") + F.col("left")
    most = write_stage(most.withColumn("open", F.coalesce((total >= passage) & (F.col("span") < total), F.lit(False))), "reached")
    grams = write_stage(most.filter("open").select("gram").distinct().withColumn("looked", F.lit(True)), "open-grams")
    rest = join_groups(suffixes.withColumn("gram", _gram(gram)), grams, ["gram"]).filter("looked").drop("gram", "looked")
    bounds = join_groups(most, grams, ["gram"]).filter("looked").select("key", "pos", "right", "left", "open")
    low = F.greatest(F.lit(0), passage - F.coalesce("right", F.lit(passage)))
    high = F.least(F.lit(passage - gram), F.coalesce("left", F.lit(passage)))
    placed = rest.join(bounds, ["key", "pos"], "left").select(
        "key", "pos", "ahead", "behind", F.coalesce("open", F.lit(False)).alias("open"), low.alias("low"), high.alias("high")
    )
    placed = write_stage(placed.filter("low <= high"), "bounded")

    def windows(rows: DataFrame, *columns: str) -> DataFrame:
        """A row for each passage of ``rows``, with its hash as ``code`` and the words before the suffix as ``back``."""
        parts = rows.withColumn("back", F.explode(F.sequence("low", "high")))
        whole = (F.octet_length("behind") >= 4 * F.col("back")) & (F.octet_length("ahead") >= 4 * (passage - F.col("back")))
        before = F.substring(F.col("behind"), F.lit(1), 4 * F.col("back"))
        after = F.substring(F.col("ahead"), F.lit(1), 4 * (passage - F.col("back")))
        return parts.filter(whole).select(*columns, "back", F.xxhash64("back", before, after).alias("code"))

    hashed = F.xxhash64("key")
    contexts = placed.groupBy("ahead", "behind").agg(
        F.min(hashed).alias("a"), F.max(hashed).alias("b"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    held = windows(contexts, "a", "b").groupBy("code").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    shared = held.filter("a <> b").select("code")
    met = salted_join(windows(placed.filter("open"), "key", "pos"), shared, ["code"], F.col("key"), "left_semi", SALTS)
    start = F.col("pos") - F.col("back")
    return met.select("key", start.alias("start"), (start + passage).alias("stop"))


def repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    passage: int = PASSAGE,
    gram: int = GRAM,
) -> DataFrame:
    """(id, start_word, end_word, n_words) of all spans that another document repeats.

    A span is made of passages of at least ``passage`` words, word for word, that stand in two or
    more documents; spans of a document that touch are one. ``end_word`` is exclusive.

    Method: only suffixes at minimiser positions are kept (about one in twenty). Grams that a single
    text holds are dropped by a count on thin rows. What is left is sorted by the words that follow,
    range-partitioned over all tasks, and again by the words before; each suffix is compared with its
    neighbours from other texts and the match is extended to the right and to the left. Where the two
    orders show that a farther suffix may match more, the passages of that gram are compared exactly.
    A text that
    two documents share as a whole is one span, and is sorted once.

    Null, empty and short texts have no spans. Null ids stay null. Rows equal in id and text are one
    document. Repeats within one document alone do not count. An empty table gives no rows; other
    columns are not read.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    reach = passage - gram

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Thin rows (hash, key, pos), and a row (key, words as pos, doc) for each document."""
        for batch in batches:
            hashes, owners, places, counts = [], [], [], []
            for i, codes in enumerate(word_codes(batch.column(1))):
                at, found = minimisers(codes, passage, gram)
                hashes.append(found.view(np.int64))
                owners.append(np.full(len(at), i))
                places.append(at)
                counts.append(len(codes))
            n, rows = len(counts), sum(map(len, places))
            owner = pa.array(np.concatenate([np.arange(n), *owners]).astype(np.int64))
            own = np.arange(n + rows) >= n
            empty = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([empty, *hashes]), mask=~own),
                 batch.column(2).take(owner),
                 pa.array(np.concatenate([np.array(counts, np.int64), *places]).astype(np.int64)),
                 batch.column(0).take(pa.array(np.arange(n + rows), mask=own))],
                names=["hash", "key", "pos", "doc"],
            )

    key = F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit(""))))
    keyed = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"), key.alias("key"))
    thin = write_stage(keyed.mapInArrow(pick, f"hash bigint, key binary, pos bigint, doc {id_type}"), "minimisers")
    places, documents = thin.filter("hash is not null"), thin.filter("hash is null")
    # A hash of a key stands in for it where keys are only told apart, as it adds up faster.
    hashed = F.xxhash64("key")
    shared = places.groupBy("hash").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).filter("a <> b")
    # A gram may be in a third of all texts, so both sides are dealt over salts too.
    salted = shared.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = places.withColumn("salt", F.pmod(hashed, F.lit(SALTS)).cast("int"))
    marks = held.join(salted, ["hash", "salt"], "left_semi").groupBy("key").agg(F.collect_set("pos").alias("places"))
    texts = documents.groupBy("key").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("doc").alias("ids"),
        F.count("*").alias("rows"), F.max("pos").alias("words"),
    )
    texts = write_stage(texts, "texts")
    marks = marks.join(texts.select("key", F.col("first").alias("doc")), "key")
    same = [keyed["key"] == marks["key"], keyed["doc"].eqNullSafe(marks["doc"])]
    marked = keyed.join(marks, same).select(keyed["key"], keyed["doc"], keyed["text"], marks["places"])
    # One row of each text is left before it becomes suffixes.
    marked = marked.dropDuplicates(["key", "doc"]).select("key", "text", "places")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for k, codes, at in zip(kinds, word_codes(batch.column(1)), batch.column(2)):
                codes = (codes >> np.uint64(32)).astype(">u4")
                back = codes[::-1].tobytes()
                forth, n = codes.tobytes(), len(codes)
                for p in at.as_py():
                    rows.append((k, p, forth[4 * p : 4 * (p + passage)], back[4 * (n - p) : 4 * (n - p + reach)]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(("key", "pos", "ahead", "behind"), r)) for r in rows], schema=flat)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "pos", "ahead", "behind"), r)) for r in rows], schema=flat)

    flat = pa.schema([("key", pa.binary()), ("pos", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary())])
    rows = marked.mapInArrow(suffixes, "key binary, pos bigint, ahead binary, behind binary")
    rows = write_stage(rows, "suffixes")
    # Words that follow begin with the gram itself.
    forward, right = _spans_in_order(rows, [F.col("ahead"), F.col("behind")], passage, gram, False)
    start = F.substring("ahead", 1, 4 * gram)
    backward, left = _spans_in_order(rows, [start, F.col("behind"), F.col("ahead")], passage, gram, True)
    rest = _unsettled(rows, right, left, passage, gram)
    # Two ids, or one id and rows without one.
    copied = (F.col("first") < F.col("last")) | ((F.col("ids") > 0) & (F.col("ids") < F.col("rows")))
    whole = texts.filter(copied & (F.col("words") >= passage))
    spans = merge_spans(
        forward.union(backward).union(rest).union(whole.select("key", F.lit(0).cast("long"), F.col("words").cast("long")))
    )
    return (
        documents.select("doc", "key").distinct()
        .join(spans, "key")
        .select(F.col("doc").alias(id_column), F.col("start").alias("start_word"), F.col("stop").alias("end_word"),
                (F.col("stop") - F.col("start")).alias("n_words"))
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Spans (key, start, stop) of each key, those that touch or overlap as one."""
    order = Window.partitionBy("key").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") > before), F.lit(True)).cast("int")
    numbered = spans.distinct().withColumn("new", begins).withColumn("island", F.sum("new").over(order))
    return numbered.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
