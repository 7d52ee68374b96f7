"""The operators and stages on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.oracle_check import compare

import corpus_pipeline
from termloom.llm import ann, common, jaccard_join, license_scan, line_dedup, mixing, packing, quality, reshard, suffix_dedup
from termloom.llm import training_order as order
from termloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from termloom.plans.staging import write_stage

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, salt int, size long"
LONG = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows():
    plain = " ".join(f"word{i}" for i in range(40))
    texts = [None, "", " \n\t", "one two", LONG, plain, plain, plain + " more", PASSAGE + " tail here", "start " + PASSAGE,
             "### $$$ %%% ||| " * 20, "a line\na line\n\nb", "Released under the MIT License."]
    made = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", 1, "k", 2, 3) for i, t in enumerate(texts)]
    return [*made, made[5], made[5], (None, plain, "en", "s1", 1, "k", 2, 3), (None, "x y z", "en", None, 1, "k", 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return write_stage(spark.createDataFrame(rows(), SCHEMA).repartition(3), "fixture")


@pytest.fixture(scope="module")
def none(spark):
    return write_stage(spark.createDataFrame([], SCHEMA), "fixture")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_oracle(spark, name):
    assert compare(spark, FOLDER, QUERIES[name], ORACLES[name]).startswith("same")


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path()).collect()
    want = Counter(tuple(plain.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows())
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    for held in pieces.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r.start, r.ids) for r in got if r.doc_id == 4)
    assert tuple(np.frombuffer(b"".join(i for _, i in long), "<u4")) in want


def test_packing_query_fills_sequences(spark):
    got = QUERIES["op10_pack_sequences"](spark, FOLDER).toPandas()
    assert got.groupby("doc_id")["length"].sum().eq(got.groupby("doc_id")["doc_tokens"].first()).all()
    assert got["length"].sum() > 0.97 * 2048 * got["sequence_id"].nunique()


def test_training_order_round_trip(spark, docs):
    folder = f"{order.staging_folder(spark)}/order-test"
    manifest = order.materialise(docs, folder, tokenizer_path(), length=64, shard_sequences=16).collect()
    total = len(manifest)
    assert sorted(r.slot for r in manifest) == list(range(total)) == sorted(r.sequence for r in manifest)
    records = list(order.read_slots(folder, 0, total, 64, 16))
    by_sequence = {}
    for r in manifest:
        assert zlib.crc32(records[r.slot].tobytes()) == r.ids_crc32 and r.byte_offset == r.slot % 16 * 128
        by_sequence[r.sequence] = records[r.slot][: r.n_tokens]
    ids = np.concatenate([by_sequence[i] for i in range(total)])
    plain = packing.encoder(tokenizer_path(), 1, "<u2")
    texts = pa.array([r[1] for r in rows()], pa.string())
    assert len(ids) == sum(len(b) // 2 for b in plain.column(texts))
    assert (np.concatenate(list(order.read_slots(folder, 5, 9, 64, 16))) == np.concatenate(records[5:9])).all()
    assert (ids == 1).sum() >= len(rows())


def test_resharding_is_even_and_gapless(spark, docs):
    for frame, shards in ((docs, 4), (docs, 40), (docs, 2)):
        got = reshard.reshard(frame, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), shards).collect()
        counts = Counter(r.shard for r in got)
        assert len(got) == len(rows()) and max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1
        for shard, n in counts.items():
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
        for r in got:
            if r.doc_id is not None:
                text = (rows()[r.doc_id][1] or "").encode()
                assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text)


def test_rewrite_touches_changed_shards_only(spark, docs):
    placed = reshard.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), 4, carry=("text",))
    placed = write_stage(placed, "placed")
    path = f"{order.staging_folder(spark)}/resharded-test"
    reshard.rewrite_affected(placed, path)
    moved = placed.filter("old_shard <> shard").collect()
    touched = {s for r in moved for s in (r.old_shard, r.shard)}
    written = spark.read.parquet(path)
    assert written.count() == placed.filter(F.col("shard").isin(touched)).count()


def test_quality_measures_and_edges(docs):
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[4].n_words == 60_000 and got[4].n_repeat_words == 0
    assert got[10].n_repeat_words == got[10].n_words == 80 and got[10].base_failed
    assert got[11].n_dup_lines == 1
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality_report(docs).filter("kept").count() > 0


@pytest.mark.parametrize(
    "text", ["a b c d e a b c d e", "x x x x x x", "a b c d e f", "a b c d e f g a b c d e z z a b c d e f", ""]
)
def test_repeated_words_by_hand(spark, text):
    words = text.split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    want = len({p for i, g in enumerate(grams) if g in twice for p in range(i, i + 5)})
    df = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)).alias("w"))
    assert df.select(quality.repeated_words(F.col("w"))).first()[0] == want


def test_mixing_targets_and_bounds(docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows())
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix_report(docs).collect()}
    total = sum(r["size"] for r in got)
    by_size = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in by_size) - 1.5 * total) < 1e-6 or len(by_size) < 4
    assert all(t <= 2 * s for s, t in by_size)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)))).first()[0]
    assert words == sum(r.taken for r in got)


def test_passages_across_documents_only(docs):
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == {(8, 0, 60), (9, 1, 61)}


def test_passages_with_many_neighbours(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(f"q{x}" for x in rng.integers(0, 10**6, 55)) for _ in range(6)]
    texts = [" ".join(rng.choice(pool, 2)) if i % 3 else f"u{i} " + str(rng.choice(pool)) + f" v{i}" for i in range(60)]
    texts += [" ".join(f"n{i}_{j}" for j in range(80)) for i in range(20)]
    df = write_stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "fixture")
    got = {(r[0], r[1], r[2]) for r in suffix_dedup.repeated_passages(df).collect()}
    windows = defaultdict(set)
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(d)
    want = set()
    for d, t in enumerate(texts):
        w, spans = t.split(), []
        for i in range(len(w) - 49):
            if len(windows[tuple(w[i : i + 50])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        want |= {(d, a, b) for a, b in spans}
    assert got == want


def test_passage_that_no_order_brings_together(spark, monkeypatch):
    """Longer matches to one side stand between two texts whose shared passage reaches to both."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"z{x}" for x in rng.integers(0, 10**9, n)]
    core = words(130)
    [codes] = common.word_codes(pa.array([" ".join(core)]))
    at, _ = suffix_dedup.minimisers(codes)
    m = int(next(p for p in at if 40 <= p <= 70))
    texts = [words(30) + core[m - 45 : m + 50] + words(30), words(30) + core[m - 25 : m + 27] + words(30)]
    texts += [words(60) + core[m : m + 45] + words(60) for _ in range(60)]
    texts += [words(60) + core[m - 39 : m + 10] + words(60) for _ in range(60)]
    df = write_stage(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "fixture")
    found = []
    exact = suffix_dedup._unsettled
    monkeypatch.setattr(suffix_dedup, "_unsettled", lambda *a: found.append(exact(*a)) or found[0])
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == {(0, 50, 102), (1, 30, 82)}
    assert found[0].count() > 0


def test_similar_documents(docs):
    got = jaccard_join.join_similar(docs).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_links for i in (0, 1, 2)] == [0, 0, 0] and [by_id[i].class_id for i in (0, 1, 2)] == [0, 1, 2]
    # Two texts, four more rows of them and one without an id.
    assert by_id[5].class_id == by_id[6].class_id == by_id[7].class_id == 5
    assert by_id[5].n_links == by_id[7].n_links == 5
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 8, 10, 11, 12]


def test_one_of_each_class_with_clashing_ids(spark):
    """Unrelated texts without ids, and one id on two different texts, are classes of their own."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    made = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (None, text("c")),
            (7, text("d")), (7, text("e")), (8, text("e")), (None, text("e")), (9, "")]
    df = write_stage(spark.createDataFrame(made, "doc_id long, text string").repartition(3), "fixture")
    got = Counter((r.doc_id, r.text.split(" ")[0][:1]) for r in jaccard_join.keep_one_of_each(df).collect())
    assert got == Counter([(None, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (9, "")])


def test_large_near_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base[:90] + [f"e{k}_{j}" for j in range(k % 8)]) for k in range(80)]
    df = write_stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "fixture")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join_similar(df).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for a in sets]
    assert got == {i: (0, n) for i, n in enumerate(links)}


def test_license_rows(docs):
    got = license_scan.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(12, "MIT-notice", 1.0)]


def test_common_lines_of_a_site(spark):
    pages = [(i, f"http://a.org/{i}", f"<p>menu</p><p>text {i}</p>", "x") for i in range(20)]
    pages += [(90, None, None, "x"), (91, "nothing", "", "x"), (92, "http://b.org", "<p>menu</p>", "x"), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, line_site string")
    got = Counter((r.page_id, r.host, r.host_pages, r.n_lines, r.n_kept) for r in line_dedup.page_report(df).collect())
    assert got[(1, "a.org", 21, 2, 1)] == 1 and got[(0, "a.org", 21, 2, 1)] == 2
    assert got[(90, None, 2, 0, 0)] == 1 and got[(92, "b.org", 1, 1, 1)] == 1


def page_rows(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: (r.n_lines, r.n_kept) for r in line_dedup.page_report(df).collect()}


def test_ratio_decides_on_small_hosts(spark):
    pages = [(10 * n + i, f"http://h{n}.org/{i}", f"<p>menu</p><p>own {i}</p>") for n in (1, 2, 4, 9) for i in range(n)]
    got = page_rows(spark, pages)
    assert got == {i: (2, 2) if i == 10 else (2, 1) for i, _, _ in pages}
    assert page_rows(spark, []) == {}
    # 3 of 30 pages are not more than a tenth.
    pages = [(i, "http://h.org", f"<p>own {i}</p>" + "<p>thrice</p>" * (i < 3)) for i in range(30)]
    assert page_rows(spark, pages)[0] == (2, 2)


@pytest.mark.parametrize("unclosed", ["<script ", "<style>x", "<!-- ", "<a href ", "<p ", "</p", "< ", "<"])
def test_pages_of_open_tags_are_read_in_one_pass(spark, unclosed):
    page = "<p>seen</p>\n" + unclosed * (1_000_000 // len(unclosed))
    made = write_stage(spark.createDataFrame([(1, page)], "page_id long, html string"), "fixture")
    begin = time.monotonic()
    found = made.select(line_dedup.html_lines(F.col("html")).alias("lines")).first().lines
    assert time.monotonic() - begin < 5
    assert found == (["seen"] if unclosed.strip() != "<" else ["seen", unclosed * (1_000_000 // len(unclosed))])


def test_lines_of_documents_keep_columns(docs):
    done = line_dedup.drop_lines_of_documents(docs)
    assert done.columns == docs.columns and done.count() == len(rows())
    assert {r.doc_id: r.text for r in done.collect()}[4] == LONG


def test_copies_keep_their_lines_until_near_copies_go(spark):
    copied = "\n".join(f"copied line {i} of one text" for i in range(9))
    made = [(i, copied, "s") for i in range(15)] + [(20 + i, f"menu\nown text {i} of its document", "s") for i in range(30)]
    df = write_stage(spark.createDataFrame(made, "doc_id long, text string, source string"), "fixture")
    done = write_stage(line_dedup.drop_lines_of_documents(df), "lines")
    texts = {r.doc_id: r.text for r in done.collect()}
    assert all(texts[i] == copied for i in range(15)) and texts[20] == "own text 0 of its document"
    assert {r.doc_id for r in jaccard_join.keep_one_of_each(done).collect() if r.doc_id < 20} == {0}


def test_ratio_decides_in_small_sources(spark):
    made = [(i, f"menu\nown text {i}", f"s{n}") for n in (1, 2, 4) for i in range(n)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = {(r.source, r.doc_id): r.text for r in line_dedup.drop_lines_of_documents(df).collect()}
    assert got == {(s, i): t if s == "s1" else f"own text {i}" for i, t, s in made}


def exact_neighbours(vectors, queries, k):
    out = {}
    for q in queries:
        scores = []
        for i, v in vectors.items():
            if i != q:
                a, b = np.array(vectors[q], float), np.array(v, float)
                scores.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i))
        out[q] = sorted(scores)[:k]
    return out


def test_neighbours_edges_and_fallback(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1.0, None]), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (10, [5.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, code string")
    got = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 10, 1.0), (3, None, 1.0), (4, 2, 0.0), (5, 9, -1.0)]
    assert ann.nearest(df.filter("vec_id < 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["double", "float"])
def test_neighbours_of_repeated_rows_and_extreme_vectors(spark, kind):
    """Every row is a candidate of its own; ties at the last rank go to the smaller id."""
    tiny, huge = (1e-200, 1e200) if kind == "double" else (1e-30, 1e30)
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [tiny, tiny]), (3, [huge, huge]), (4, [2.0, 2.0]),
            (5, [-huge, huge]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (0, [3.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], f"vec_id long, embedding array<{kind}>, row long, query string")
    got = ann.nearest(df.repartition(3), F.col("vec_id") == 0).collect()
    near = np.cos(np.arctan(np.float64(np.float32(0.1)) if kind == "float" else 0.1))
    want = [(1, 0, 1.0), (2, 1, near), (3, 1, near), (4, 1, near), (5, 2, np.sqrt(0.5))]
    both = sorted((r.rank, r.vec_id, round(r.score, 12)) for r in got)
    assert both == sorted((n, i, round(float(s), 12)) for n, i, s in want * 2)
    tied = ann.nearest(df.filter("vec_id in (0, 2, 3, 4)").dropDuplicates(["vec_id"]), F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [r.vec_id for r in tied] == [2, 3]
    named = df.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding")
    assert {r.vec_id for r in ann.nearest(named, F.col("vec_id") == "4", k=2).collect()} == {"2", "3"}


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op6_nearest_vectors"](spark, folder).collect()
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()}
    queries = [i for i in table if i % 50 == 0]
    want = exact_neighbours(table, queries, 5)
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.vec_id] = r.score
        a, b = (np.array(table[i], float) for i in (r.query_id, r.vec_id))
        assert abs(r.score - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) < 1e-12
    assert all(len(found[q]) == 5 for q in queries)
    assert sum(i in found[q] for q in queries for _, i in want[q]) >= 0.9 * 5 * len(queries)


def test_salted_join_gives_the_same(docs):
    groups = docs.groupBy("source").agg(F.count("*").alias("in_source"))
    a = common.join_groups(docs.drop("text"), groups, ["source"]).collect()
    b = common.join_groups(docs.drop("text"), groups, ["source"], limit=0).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b)) and all(r.in_source for r in a)


def test_empty_tables(none):
    assert none.count() == 0
    for done in (
        packing.pack(none, tokenizer_path()), reshard.reshard(none, F.lit(0), 4), quality.quality_report(none),
        mixing.mix_report(none), suffix_dedup.repeated_passages(none), jaccard_join.join_similar(none),
        license_scan.scan_licenses(none), order.training_report(none, tokenizer_path()),
    ):
        assert done.count() == 0


def test_stages_on_edges(spark, docs, none):
    for frame in (docs, none):
        held = frame
        for name, stage in corpus_pipeline.STAGES:
            held = write_stage(stage(spark, held, FOLDER), name)
            assert name == "packed" or held.columns == docs.columns


def test_pipeline_against_plain_steps(spark):
    """Stage by stage on the test documents: what goes, what stays."""
    docs = common.table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = write_stage(stages["quality"](spark, docs, FOLDER), "q")
    report = quality.quality_report(docs)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in report.filter("kept").collect()}
    one = write_stage(stages["near_copies"](spark, kept, FOLDER), "n")
    classes = {r.doc_id: r for r in jaccard_join.join_similar(kept).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, r in classes.items() if r.class_id == i or not r.has_words}
    mixed = stages["mixture"](spark, one, FOLDER).groupBy("doc_id").count().collect()
    taken = {r.doc_id: r for r in mixing.mix_report(one).collect()}
    assert all(r["count"] * taken[r.doc_id]["size"] == taken[r.doc_id].taken for r in mixed)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
