"""Output amplification: how much longer than the prompt could the answer become?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.functions import text as T
from promptwatch.functions.rules import AMPLIFICATION_RULES, flag_array, phrase_flag
from promptwatch.params import Params

# Fixed value: "<n> things each|of <m> words".
PRODUCT_PATTERN = r"(\d+)\s+\w+\s+(?:each\s+(?:containing\s+)?|of\s+)(\d+)\s+\w+"


def prompt_tokens(words: Column) -> Column:
    return F.greatest(words * 1.3, F.lit(1.0))


def explicit_multiplier(folded: Column, words: Column, biggest: Column, bare_numbers: bool = True) -> Column:
    """Multiplier stated in numbers: a product of two, else one large number, else 1."""
    digits = T.ascii_digits(folded)
    pattern = T.text_pattern(PRODUCT_PATTERN)
    possible = (F.contains(folded, F.lit("each")) | F.contains(folded, F.lit("of"))) & digits.rlike("[0-9]")
    first = F.when(possible, F.regexp_extract(digits, pattern, 1)).otherwise("")
    second = F.when(possible, F.regexp_extract(digits, pattern, 2)).otherwise("")
    product = first.try_cast("double") * second.try_cast("double") * 1.3 / prompt_tokens(words)
    single = F.when(biggest > 50, biggest / 10.0) if bare_numbers else F.lit(None).cast("double")
    return F.when(first != "", product).otherwise(F.coalesce(single, F.lit(1.0)))


def with_amplification(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Needs the text forms and ``predicted_tokens``; adds flags, multiplier and verdict."""
    folded, words = F.col("_lower"), F.col("_words")
    raw = {f"_a_{name}": phrase_flag("_lower", rules) for name, rules in AMPLIFICATION_RULES.items()}
    df = df.withColumns({
        **raw,
        "_mult": F.greatest(
            F.col("predicted_tokens") / prompt_tokens(words),
            explicit_multiplier(folded, words, F.col("_biggest"), params.bare_numbers),
        ),
    })
    return df.withColumns({
        "amp_flags": flag_array({n: F.col(f"_a_{n}") for n in AMPLIFICATION_RULES}),
        "multiplier": F.bround("_mult", 2),
        "recursive_detected": (F.col("_mult") > params.amplification_limit)
        | F.col("_a_RECURSIVE_PATTERN") | F.col("_a_SELF_REPLICATION"),
        "amp_input_tokens": F.floor(prompt_tokens(words)).cast("int"),
    }).drop(*raw, "_mult")


def amplification_result(limit: float = Params.amplification_limit) -> Column:
    return F.struct(
        "recursive_detected", "multiplier", F.col("amp_flags").alias("flags"),
        F.col("amp_input_tokens").alias("input_tokens"), "predicted_tokens", F.lit(limit).alias("limit"),
    )
