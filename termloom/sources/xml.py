"""XML sample records of any nesting depth, plain or gzip, whatever their namespace prefix.

A plain file is read by many tasks. Whether a split starts in a comment, a CDATA section, a tag or a record is
composed over the splits before it, so record bounds are right wherever Spark cuts the file, and a file
that ends inside a record is an error. Each record is parsed on its own, in Arrow batches, into key/value
entries in document order; merging and sorting are the same column expressions as for every other source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import blank_to_null
from termloom.operators.canonical import canonicalise_entries
from termloom.plans.staging import shuffle_width, write_stage
from termloom.sources.splits import runs, split_pieces, start_states, stitched

# Structural paths and attributes with a name of their own.
TEXT_ALIASES = {
    "Description/Title": "title",
    "Description/Comment/Paragraph": "description",
    "Owner/Name": "owner",
    "Models/Model": "model",
    "Package": "package",
}
ATTRIBUTE_ALIASES = {
    "Description/Organism@taxonomy_name": "organism",
    "Description/Organism@taxonomy_id": "tax_id",
    "Owner/Name@abbreviation": "owner_abbreviation",
    "Package@display_name": "package_display_name",
    "Status@status": "status",
    "Status@when": "status_date",
}
ROOT_ATTRIBUTE_ALIASES = {"id": "biosample_id"}

Entry = tuple[str, str | None]


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _text_of(node: ElementTree.Element) -> str:
    return "".join(node.itertext())


def _other_attributes(node: ElementTree.Element, prefix: str, used: set[str]) -> Iterator[Entry]:
    return ((f"{prefix}.{name}", value) for name, value in node.attrib.items() if name not in used)


def _named_attribute(node: ElementTree.Element) -> Iterator[Entry]:
    given = node.get("attribute_name")
    name = node.get("harmonized_name") or given
    text = _text_of(node)
    yield name or "attributes.unnamed", text
    if given:
        yield f"original_attributes.{given}", text
    yield from _other_attributes(
        node, f"attribute_details.{name or 'unnamed'}", {"attribute_name", "harmonized_name"}
    )


def _identifier(node: ElementTree.Element) -> Iterator[Entry]:
    label = node.get("db_label")
    key = ".".join(["id", node.get("db", "unknown"), *([label] if label else [])])
    yield key, _text_of(node)
    yield from _other_attributes(node, key, {"db", "db_label"})


def _link(node: ElementTree.Element) -> Iterator[Entry]:
    key = ".".join(["link", node.get("type", "unknown"), *filter(None, (node.get("target"), node.get("label")))])
    yield key, _text_of(node)
    yield from _other_attributes(node, key, {"type", "target", "label"})


_SPECIAL = {"Attributes/Attribute": _named_attribute, "Ids/Id": _identifier, "Links/Link": _link}


def _node_entries(node: ElementTree.Element, path: str) -> Iterator[Entry]:
    if path in _SPECIAL:
        yield from _SPECIAL[path](node)
        return
    key = TEXT_ALIASES.get(path, path.replace("/", ".").lower())
    for name, value in node.attrib.items():
        yield ATTRIBUTE_ALIASES.get(f"{path}@{name}", f"{key}.{name}"), value
    if path == "Description/Comment/Paragraph":
        yield key, _text_of(node)
        for inner in node.iterfind(".//*"):
            yield from _other_attributes(inner, f"{key}.{_local(inner.tag).lower()}", set())
        return
    yield key, node.text
    for child in node:
        yield from _node_entries(child, f"{path}/{_local(child.tag)}")
        yield f"{key}.tail", child.tail


def record_entries(record: ElementTree.Element) -> list[Entry]:
    """All (key, value) entries of one record element in document order."""
    entries = [(ROOT_ATTRIBUTE_ALIASES.get(name, name), value) for name, value in record.attrib.items()]
    for child in record:
        entries.extend(_node_entries(child, _local(child.tag)))
    return entries


def _parse(text: str) -> ElementTree.Element:
    # Namespaces are not resolved: a chunk does not see declarations made above its record.
    builder = ElementTree.TreeBuilder()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = builder.start
    parser.EndElementHandler = builder.end
    parser.CharacterDataHandler = builder.data
    parser.Parse(text, True)
    return builder.close()


# Where a scan may be: in text, in markup without elements, or in a tag, which may be inside a quoted value.
_STOPS = {"comment": "-->", "cdata": "]]>", "pi": "?>"}
_TAGS = ("start", "end", "other")
STATES = ("text", *_STOPS, "declaration", "subset", *(f"{t}{q}" for t in _TAGS for q in ("", '"', "'")))
_OPENING = re.compile(r"<!--|<!\[CDATA\[|<\?|<!|<(/?)([^\s/>]+)")
_NAMED = {"<!--": "comment", "<![CDATA[": "cdata", "<?": "pi", "<!": "declaration"}
_BOUNDS = {"declaration": re.compile(r"[\[>]"), "subset": re.compile(r"\]")}
_AFTER = {"[": "subset", ">": "text", "]": "declaration"}
_IN_TAG = re.compile(r"[\"'>]")


def scan(state: str, text: str, local: str) -> tuple[str, list[tuple[int, int]]]:
    """The state after a piece, and (+1 or -1, place) where a ``local`` element begins or has ended."""
    events, at = [], 0
    while at < len(text):
        if state == "text":
            if not (found := _OPENING.search(text, at)):
                break
            state = _NAMED.get(found[0], "other")
            if found[2] and found[2].rpartition(":")[2] == local:
                state = "end" if found[1] else "start"
                if state == "start":
                    events.append((1, found.start()))
            at = found.end()
            continue
        if state in _STOPS or state[-1] in "\"'":
            mark = _STOPS.get(state, state[-1])
            if (place := text.find(mark, at)) < 0:
                break
            at, state = place + len(mark), "text" if state in _STOPS else state[:-1]
            continue
        if not (found := _BOUNDS.get(state, _IN_TAG).search(text, at)):
            break
        at = found.end()
        if state in _BOUNDS:
            state = _AFTER[found[0]]
        elif found[0] != ">":
            state += found[0]
        else:
            if state == "end" or (state == "start" and text[found.start() - 1 : found.start()] == "/"):
                events.append((-1, at))
            state = "text"
    return state, events


_SEPARATOR = "</"
_TEXTS = "source_file string, split long, n long, begins boolean, ends boolean, text string"


def _record_texts(local: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts of the outermost ``local`` elements of each split; those that reach over an end of it in parts."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), rows in runs(batches):
            out, size, n = [], 0, 0
            state = depth = last = None
            held: list[str] | None = None
            begins = True
            for row, (value, first, counts, last) in enumerate(rows):
                if state is None:
                    state, depth = first, counts[0]
                    held, begins = ([], False) if depth else (None, True)
                piece, start = _SEPARATOR + value if row or split else value, 0
                state, events = scan(state, piece, local)
                for change, place in events:
                    if change > 0 and depth == 0:
                        held, begins, start = [], True, place
                    depth += change
                    if depth < 0:
                        raise ValueError(f"{file}: an end tag of {local} without a start")
                    if change < 0 and depth == 0:
                        out.append((file, split, n, begins, True, "".join(held) + piece[start:place]))
                        size, n, held = size + len(out[-1][-1]), n + 1, None
                if held is not None:
                    held.append(piece[start:])
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if held is not None:
                out.append((file, split, n, begins, False, "".join(held)))
            if last and (depth or state != "text"):
                raise ValueError(f"{file} ends inside {f'an element {local}' if depth else 'markup'}")
            yield _batch(out)

    return texts


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [k.split(" ")[0] for k in _TEXTS.split(", ")])


def _records(element: ElementTree.Element, local: str) -> Iterator[ElementTree.Element]:
    """Records inside an element, then the element; an inner record is none of the outer one's entries."""
    for child in list(element):
        yield from (found for found in _records(child, local) if found is not child)
        if _local(child.tag) == local:
            yield child
            element.remove(child)
    yield element


def read_xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Canonical records of every ``tag`` element: source_file, source_order, accession, metadata.

    Elements are found by their local name, so a prefix in ``tag`` or in the file does not matter; tags in comments
    and CDATA sections are text. A record inside a record is one of its own, before the outer one, which
    does not have its entries. ``source_order`` rises within a file, and ``source_suborder`` within an outer
    record. A file that ends inside a record or a tag, or has an end tag too many, fails the job. A gzip file
    cannot be split, so its records are spread after reading.
    """
    local = tag.rpartition(":")[2]

    def transition(state: str, piece: str) -> tuple[str, list[int]]:
        after, events = scan(state, piece, local)
        return after, [sum(change for change, _ in events)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, order, text in zip(pdf["source_file"], pdf["source_order"], pdf["text"]):
                for n, record in enumerate(_records(_parse(text), local)):
                    entries = [{"key": k, "value": v} for k, v in record_entries(record) if v is not None]
                    rows.append((file, order, n, record.get("accession"), entries))
            yield pd.DataFrame(rows, columns=["source_file", "source_order", "n", "given", "raw"])

    pieces = split_pieces(spark, path, _SEPARATOR)
    starts = start_states(pieces, _SEPARATOR, STATES, transition, 1)
    # One row for each split of the input, so the rows of a split stay in order beside it.
    placed = pieces.join(F.broadcast(starts), ["source_file", "split"])
    texts = placed.select("source_file", "split", "value", "state", "counts", "is_last").mapInArrow(_record_texts(local), _TEXTS)
    if starts.filter("split > 0").isEmpty():
        texts = texts.select("source_file", "split", "n", "text")
    else:
        texts = write_stage(texts, "xml-records")
        columns = ["source_file", "split", "n", "text"]
        texts = texts.filter("begins AND ends").select(columns).unionByName(stitched(texts.filter("NOT (begins AND ends)")))
    texts = texts.select("source_file", (F.col("split") + F.col("n")).alias("source_order"), "text")
    if any(file.endswith(".gz") for file in pieces.inputFiles()):  # such a file is one task
        texts = texts.repartition(shuffle_width(spark))
    parsed = texts.mapInPandas(
        parse,
        "source_file string, source_order long, n int, given string, raw array<struct<key:string,value:string>>",
    )
    stripped = F.transform(
        "raw", lambda e: F.struct(e["key"].alias("key"), blank_to_null(e["value"]).alias("value"))
    )
    kept = F.filter(stripped, lambda e: (e["key"] != "") & e["value"].isNotNull())
    staged = parsed.select("source_file", "source_order", "n", blank_to_null(F.col("given")).alias("given"), kept.alias("entries"))
    return canonicalise_entries(
        staged, F.col("entries"), F.col("given"), keep=["source_file", "source_order", "n"]
    ).withColumnRenamed("n", "source_suborder")
