"""Classification of inscription contents as mints: not a mint, valid, or invalid with a code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heightline.schema import U32_MAX

# Exact content types that may hold a mint (the stray apostrophe is one of them), the words of the
# protocol, and the codes of invalid mints.
CONTENT_TYPES = ("text/plain;charset=utf-8", "text/plain'", "application/json")
PROTOCOL, OPERATION = "usdb", "mint"
SCHEMA, MAIN, COLLAB, PREV = "INVALID_SCHEMA", "INVALID_ETH_MAIN", "INVALID_ETH_COLLAB", "INVALID_PREV_ID"

_STRING = "STRING"


def allowed_type(content_type: Column) -> Column:
    return content_type.isNull() | F.lower(content_type).isin(*CONTENT_TYPES)


def is_address(text: Column) -> Column:
    return text.rlike("^0x[0-9a-fA-F]{40}$")


def is_inscription_id(text: Column) -> Column:
    """A transaction's hash, the letter i and an index of 32 bits without leading zeros."""
    index = F.coalesce(F.substring(text, 66, 10).try_cast("bigint"), F.lit(0))
    return text.rlike("^[0-9a-fA-F]{64}i(0|[1-9][0-9]{0,9})$") & (index <= U32_MAX)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def classify(content: Column, content_type: Column | None = None) -> Column:
    """struct(kind, code, eth_main, eth_collab, prev). Types are strict; the first failing test names the code.

    With a content type that may not hold a mint it is none, whatever it says.
    """
    value = F.try_parse_json(content if content_type is None else F.when(allowed_type(content_type), content))
    field = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    text = lambda name: F.when(_kind(field(name)) == _STRING, F.try_variant_get(value, f"$.{name}", "string"))
    is_mint = F.coalesce(_kind(value).startswith("OBJECT") & (text("p") == PROTOCOL) & (text("op") == OPERATION), F.lit(False))
    main, collab = text("eth_main"), text("eth_collab")
    prev = F.try_variant_get(value, "$.prev", "array<string>")
    prev_kind = _kind(field("prev"))
    collab_kind = F.coalesce(_kind(field("eth_collab")), F.lit("VOID"))
    schema_ok = main.isNotNull() & collab_kind.isin(_STRING, "VOID") & F.coalesce(prev_kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) & F.coalesce(~F.exists(prev, lambda p: p.isNull()), F.lit(True))
    code = (
        F.when(~F.coalesce(schema_ok, F.lit(False)), SCHEMA)
        .when(~is_address(main), MAIN)
        .when(collab.isNotNull() & ~is_address(collab), COLLAB)
        .when(F.exists(prev, lambda p: ~is_inscription_id(p)), PREV)
    )
    kind = F.when(~is_mint, "not_mint").when(code.isNull(), "valid").otherwise("invalid")
    own = lambda c: F.when(is_mint, c)
    return F.struct(kind.alias("kind"), own(code).alias("code"), own(main).alias("eth_main"), own(collab).alias("eth_collab"), own(prev).alias("prev"))
