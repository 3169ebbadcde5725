"""Decoding of scorer responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadmerge.functions.text import bind, jtrim

CAPTION_FLAGS = (
    "has_opening_keywords", "has_relocation_keywords", "has_ownership_keywords",
    "has_minor_update_keywords",
)


def verdict_document(response: Column) -> Column:
    """The inner verdict as a variant; null when either layer is not JSON.

    The response wraps the verdict as JSON text in ``content[0].text``, possibly
    inside a Markdown fence. If that is not text the response itself is the
    verdict.
    """
    outer = F.try_parse_json(response)
    wrapped = F.try_variant_get(outer, "$.content[0].text", "variant")
    text = F.try_variant_get(outer, "$.content[0].text", "string")
    text = F.regexp_replace(text, r"(?i)^```json\s*", "")
    text = jtrim(F.regexp_replace(text, r"```\z", ""))
    is_text = F.schema_of_variant(wrapped) == "STRING"
    chosen = F.when(is_text, F.try_parse_json(text)).otherwise(outer)
    return F.when(~F.is_variant_null(chosen), chosen)


def _truthy(document: Column, path: str) -> Column:
    """Any value but false, zero, null and the empty text; texts "false" and "0" count."""

    def counts(value: Column) -> Column:
        kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        return (
            F.when(value.isNull() | (kind == "VOID"), F.lit(False))
            .when(kind == "STRING", text != "")
            .when(kind == "BOOLEAN", text == "true")
            .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
        )

    return bind(F.try_variant_get(document, path, "variant"), counts)


def verdict_fields(document: Column) -> Column:
    """Typed fields of a verdict document as a struct; null for a null document."""
    text = lambda name: F.try_variant_get(document, f"$.{name}", "string")
    many = lambda name: F.try_variant_get(document, f"$.{name}", "array<string>")
    fields = F.struct(
        text("verdict").alias("verdict"),
        text("opportunity_score").alias("opportunity_score"),
        text("confidence").alias("confidence"),
        text("reasoning").alias("reasoning"),
        many("key_factors").alias("key_factors"),
        many("red_flags").alias("red_flags"),
        *[
            _truthy(document, f"$.caption_analysis.{flag}").alias(flag)
            for flag in CAPTION_FLAGS
        ],
    )
    return F.when(document.isNotNull(), fields)


def decode_verdict(response: Column) -> Column:
    """Response text to the verdict struct; null marks a malformed response."""
    return verdict_fields(verdict_document(response))
