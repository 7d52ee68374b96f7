"""XML records wherever Spark cuts the file."""

from __future__ import annotations

import gzip
import random
from xml.etree import ElementTree

import pytest

from termloom.sources.xml import read_xml_records

TRICKY = """<?xml version="1.0"?><!DOCTYPE Set [ <!ENTITY x "<Sample>"> ]>
<Set xmlns:n="urn:x"><!-- <Sample accession="no"> </Sample> --><Sample accession="A1"><Title>one</Title></Sample>
<n:Sample accession="A2"><Title><![CDATA[</Sample> <Sample>]]></Title></n:Sample><Sample accession="A3"/>
<Sample accession="A4" note="a > b />"><!-- </Sample> --><Inner><q:Sample accession="A5"><Title>in</Title></q:Sample>after</Inner><Title>four</Title></Sample>
<Samples accession="no"/><Sample accession='A6' note='/'  >x</Sample ><?pi <Sample> ?></Set>"""


def accessions(spark, path, tag="Sample"):
    rows = read_xml_records(spark, str(path), tag).orderBy("source_file", "source_order", "source_suborder").collect()
    return [r.accession for r in rows], rows


def plain(text):
    """Local names read by a whole-file parser, inner records first."""
    return [e.get("accession") for _, e in ElementTree.iterparse(text) if e.tag.rpartition("}")[2] == "Sample"]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("tag", ["Sample", "n:Sample"])
def test_comments_sections_prefixes_and_nesting(spark, tmp_path, packed, tag):
    text = TRICKY.replace("<Set xmlns:n", '<Set xmlns:q="urn:q" xmlns:n')
    path = tmp_path / ("s.xml.gz" if packed else "s.xml")
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    got, rows = accessions(spark, path, tag)
    assert got == ["A1", "A2", "A3", "A5", "A4", "A6"]
    by = {r.accession: r.metadata for r in rows}
    assert by["A2"]["title"] == "</Sample> <Sample>" and by["A4"]["title"] == "four" and by["A4"]["note"] == "a > b />"
    assert by["A5"] == {"accession": "A5", "title": "in"} and "in" not in by["A4"].values()


def test_any_cut_gives_the_same_records(spark, tmp_path):
    rng = random.Random(8)
    parts = ["<!-- <Sample> -->", "<![CDATA[ </Sample><Sample> ]]>", "<Other note='/>' at=\">'\"/>", "text &lt; ", "<a><b>é</b></a>"]
    body = []
    for i in range(120):
        inside = "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
        inner = f'<Sample accession="I{i}">{rng.choice(parts)}</Sample>' if rng.random() < 0.2 else ""
        body.append(rng.choice(["", parts[0], "<x/>"]) + f'<Sample accession="R{i}">{inside}{inner}</Sample>')
    text = "<Set>" + "\n".join(body) + "</Set>"
    path = tmp_path / "cut.xml"
    path.write_text(text)
    want = plain(str(path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (400,):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got, _ = accessions(spark, path)
            assert sorted(got) == sorted(want)
            assert [a for a in got if a[0] == "R"] == [a for a in want if a[0] == "R"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("text", ['<Set><Sample accession="A">x', '<Set><Sample accession="A', "<Set><Sample/></Sample></Set>", "<Set><!-- open <Sample/>"])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "b.xml").write_text(text)
    with pytest.raises(Exception, match="ends inside|without a start"):
        read_xml_records(spark, str(tmp_path / "b.xml"), "Sample").collect()


def test_file_without_records(spark, tmp_path):
    (tmp_path / "e.xml").write_text("<Set></Set>")
    assert read_xml_records(spark, str(tmp_path / "e.xml"), "Sample").count() == 0
