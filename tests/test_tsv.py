"""TSV rows wherever Spark cuts the file."""

from __future__ import annotations

import csv
import gzip
import io
import random

import pytest

from termloom.sources.readers import read_tsv_records
from termloom.sources.tsv import cells_of, scan


@pytest.fixture
def tiny_splits(spark):
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def made_text(seed: int, end: str) -> str:
    rng = random.Random(seed)
    parts = ["a", "é", " ", 'say ""x""', "\t", end, "two words", '"" ']
    rows = ["id\tnote\tlast"]
    for i in range(150):
        quoted = '"' + "".join(rng.choice(parts) for _ in range(rng.randrange(25))) + '"'
        rows.append(f"{i}\t{rng.choice([quoted, 'plain', chr(34) * 2, '5 inch' + chr(34), quoted + 'tail'])}\t{rng.choice(['x', '', quoted])}")
        if rng.random() < 0.1:
            rows.append("")
    return end.join(rows) + rng.choice([end, ""])


def plain(text: str) -> list[tuple[str, ...]]:
    """Rows of a plain reader of the whole text."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t") if r]
    return [tuple(r + [""] * (3 - len(r))) for r in rows[1:]]


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_any_cut_gives_the_rows_of_a_plain_reader(spark, tmp_path, tiny_splits, seed, end):
    text = made_text(seed, end)
    (tmp_path / "t.tsv").write_bytes(text.encode())
    want = plain(text)
    df = read_tsv_records(spark, str(tmp_path / "t.tsv"))
    assert df.columns == ["id", "note", "last"]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    first = read_tsv_records(spark, str(tmp_path / "t.tsv"), ["note", "id"], limit=40).collect()
    assert [(r.id, r.note) for r in first] == [r[:2] for r in want[:40]]


def test_several_files_and_gzip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('k\tv\n1\t"a\nb"\n2\tNA\n')
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(b'k\tv\n3\t"c\td"\n4\n   \n'))
    got = sorted(map(tuple, read_tsv_records(spark, str(tmp_path)).collect()))
    assert got == [("1", "a\nb"), ("2", ""), ("3", "c\td"), ("4", "")]


def test_too_many_cells_name_their_line(spark, tmp_path, tiny_splits):
    rows = [f'{i}\t"line\nbreak"' for i in range(100)] + ["1\t2\t3"]
    (tmp_path / "t.tsv").write_text("a\tb\n" + "\n".join(rows))
    with pytest.raises(Exception, match="t.tsv, line 202: 3 cells under a header of 2"):
        read_tsv_records(spark, str(tmp_path / "t.tsv")).collect()


def test_open_quote_at_the_end_fails(spark, tmp_path, tiny_splits):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n" + '3\t"open\n' + "x\ty\n" * 300)
    with pytest.raises(Exception, match="ends inside a quoted cell"):
        read_tsv_records(spark, str(tmp_path / "t.tsv")).collect()


def test_header_alone(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n")
    df = read_tsv_records(spark, str(tmp_path / "t.tsv"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_states_of_lines():
    assert cells_of('a\t"b\tc"d"e\t') == (["a", "b\tcd\"e", ""], False)
    assert cells_of('a\t"b""') == (["a", 'b"'], True)
    assert scan("row", 'x\t"open') == "quoted" and scan("quoted", 'still ""in""') == "quoted"
    assert scan("quoted", 'end"\tmore') == "row" and scan("quoted", 'end"\t"again') == "quoted"
