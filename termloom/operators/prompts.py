"""Prompt texts and candidate payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import fixed_values as V
from termloom.functions.text import collapse_spaces
from termloom.operators.canonical import record_to_text


def extraction_prompt(metadata: Column | str = "metadata") -> Column:
    return F.concat(F.lit(V.EXTRACTION_PROMPT_HEAD), record_to_text(metadata))


def _first_definition(candidates: Column) -> Column:
    """0-based place of the first candidate with a definition, -1 if there is none."""
    filled = F.transform(candidates, lambda c: collapse_spaces(F.coalesce(c["definition"], F.lit(""))) != "")
    return F.array_position(filled, F.lit(True)) - 1


def _short_definition(candidate: Column, place: Column, first: Column) -> Column:
    text = F.substring(collapse_spaces(candidate["definition"]), 1, V.PAYLOAD_DEFINITION_CHARS)
    return F.when(place == first, text)


def _synonyms(candidate: Column) -> Column:
    return F.slice(candidate["synonyms"], 1, V.PAYLOAD_SYNONYMS)


def compact_candidates(candidates: Column) -> Column:
    """The first five candidates, numbered from 0, without IDs, one short definition in all."""
    top = F.slice(candidates, 1, V.PAYLOAD_CANDIDATES)
    first = _first_definition(top)
    return F.transform(
        top,
        lambda c, i: F.struct(
            i.alias("index"),
            c["label"].alias("label"),
            _synonyms(c).alias("synonyms"),
            c["score"].alias("score"),
            _short_definition(c, i, first).alias("definition"),
        ),
    )


def compact_candidates_with_id(candidates: Column, k: int) -> Column:
    """The first ``k`` candidates with IDs, as compared in the payload study."""
    top = F.slice(candidates, 1, k)
    first = _first_definition(top)
    return F.transform(
        top,
        lambda c, i: F.struct(
            c["id"].alias("id"),
            c["label"].alias("label"),
            c["score"].alias("score"),
            _synonyms(c).alias("synonyms"),
            _short_definition(c, i, first).alias("definition"),
        ),
    )


def verbose_candidates(candidates: Column, k: int = 8) -> Column:
    """The earlier layout: IDs and full definitions."""
    return F.transform(
        F.slice(candidates, 1, k),
        lambda c: F.struct(
            c["id"].alias("id"),
            c["label"].alias("label"),
            _synonyms(c).alias("synonyms"),
            c["definition"].alias("definition"),
            c["score"].alias("score"),
        ),
    )


def grounding_payload(bundles: Column) -> Column:
    """JSON of all concepts of a record with their compact candidates."""
    return F.to_json(
        F.transform(
            bundles,
            lambda b: F.struct(
                b["concept"].alias("concept"), compact_candidates(b["candidates"]).alias("candidates")
            ),
        )
    )


def grounding_prompt(metadata: Column, bundles: Column) -> Column:
    return F.concat(
        F.lit(V.GROUNDING_PROMPT_HEAD),
        record_to_text(metadata),
        F.lit(V.GROUNDING_PROMPT_MIDDLE),
        grounding_payload(bundles),
    )


def extraction_schema(metadata: Column) -> Column:
    """JSON schema of an extraction response, for responders that constrain their output."""
    return F.concat(
        F.lit('{"type":"object","properties":{"c":{"type":"array","items":{"type":"array","prefixItems":['
              '{"type":"string","enum":'),
        F.to_json(F.map_keys(metadata)),
        F.lit('},{"type":"string","minLength":1},{"type":"string","minLength":1}],"minItems":3,"maxItems":3}}},'
              '"required":["c"],"additionalProperties":false}'),
    )


def grounding_schema(bundles: Column) -> Column:
    """JSON schema of a grounding response: one allowed set of choices per concept."""
    def choices(bundle: Column) -> Column:
        allowed = F.slice(F.lit([str(i) for i in range(V.PAYLOAD_CANDIDATES)]), 1, F.size(bundle["candidates"]))
        return F.concat(
            F.lit('{"enum":['), F.array_join(F.concat(F.array(F.lit("null")), allowed), ","), F.lit("]}")
        )

    count = F.size(bundles).cast("string")
    return F.concat(
        F.lit('{"type":"object","properties":{"s":{"type":"array","prefixItems":['),
        F.array_join(F.transform(bundles, choices), ","),
        F.lit('],"minItems":'), count, F.lit(',"maxItems":'), count,
        F.lit('}},"required":["s"],"additionalProperties":false}'),
    )
