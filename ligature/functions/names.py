"""Names of entities and relations as column expressions; dictionaries are literals, so nothing joins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ligature.functions.vocabularies import ENTITY_TYPES, EXTRACTED_TYPES, RELATION_TYPES, SYNONYMS


def _looked_up(words: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*words.items()))), key)


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def canonical_name(x: Column) -> Column:
    """The name that a synonym stands for, looked up without blanks first; other names as they are."""
    spaced = F.regexp_replace(stripped(F.lower(x)), "[-_]", " ")
    return F.coalesce(_looked_up(SYNONYMS, F.replace(spaced, F.lit(" "), F.lit(""))), _looked_up(SYNONYMS, spaced), x)


def lookup_key(x: Column) -> Column:
    """Lower case, without hyphens, underscores and blanks."""
    return F.regexp_replace(stripped(F.lower(x)), "[-_ ]", "")


def relation_type(x: Column) -> Column:
    return F.coalesce(_looked_up(RELATION_TYPES, F.regexp_replace(stripped(F.lower(x)), "[- ]", "_")), F.lit("associated_with"))


def extracted_type(x: Column) -> Column:
    """The type that an extractor names, if it may."""
    return F.when(F.lower(x).isin(*EXTRACTED_TYPES), F.lower(x)).otherwise("associated_with")


def entity_type(x: Column) -> Column:
    plain = stripped(F.lower(x))
    return F.coalesce(_looked_up(ENTITY_TYPES, plain), F.when(plain != "", plain), F.lit("unknown"))
