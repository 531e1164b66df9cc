"""Prompt fingerprints used by campaign detection and verdict joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptwatch.functions.text import first_words, strip


def prompt_hash(prompt: Column) -> Column:
    """Sixteen hex digits of the whole prompt, ignoring case and outer whitespace."""
    return F.substring(F.sha2(F.lower(strip(prompt)), 256), 1, 16)


def prompt_pattern(prompt: Column) -> Column:
    """Twelve hex digits of the first six words, which survives edits further on."""
    return F.substring(F.md5(F.lower(first_words(prompt, 6))), 1, 12)


def campaign_id(hash_: Column) -> Column:
    return F.concat(F.lit("CAMP-"), F.upper(F.substring(hash_, 1, 8)))
