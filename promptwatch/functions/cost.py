"""Cost signals of one prompt: four features, the token estimate and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.functions import text as T
from promptwatch.functions.entropy import entropy_score, shannon_entropy

# Words that make a number in the prompt an instruction.
INSTRUCTION_WORDS = [
    "generate", "write", "create", "list", "repeat", "produce", "output", "print",
    "describe", "explain", "summarize", "translate", "rewrite", "expand", "continue",
    "give me", "provide", "make", "build", "enumerate",
]

# Amplification words and their weights (a weight counts as weight / 5).
EXPANSION_WEIGHTS = {
    "each": 5.0, "every": 5.0, "all": 3.0, "repeat": 8.0, "recursive": 15.0,
    "infinitely": 100.0, "forever": 100.0, "endless": 50.0, "maximum": 10.0,
    "full": 3.0, "complete": 3.0, "detailed": 4.0, "extensive": 5.0,
}

# Payload shapes and the words looked for in decoded payloads.
BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
HEX_RUN = r"(?:0x)?[0-9a-fA-F]{20,}"
PAYLOAD_WORDS = ["ignore", "system", "prompt", "role"]

# The characters of a token, and those that make it mixed.
TOKEN = "[A-Za-z0-9@$!+]"
LEET = "[013457@$!+]"

FEATURES = ["encoding_score", "expansion_normalized", "obfuscation_score", "entropy_score"]


def has_instruction_verb(norm: str) -> Column:
    return F.expr(T.contains_any(norm, INSTRUCTION_WORDS))


def encoding_score(prompt: Column, long_run: Column) -> Column:
    """+50 for a base64 run, +40 for each of the first three that decodes to a payload, +20 for hex.

    ``long_run`` (is there a run of 20 base64 characters at all?) settles most texts.
    """
    payload = "|".join(PAYLOAD_WORDS)
    decoded = T.decoded_runs(prompt, BASE64_RUN, 3)
    points = F.aggregate(
        decoded, F.when(prompt.rlike(HEX_RUN), 20.0).otherwise(0.0) + F.when(prompt.rlike(BASE64_RUN), 50.0).otherwise(0.0),
        lambda score, text: score + F.when(text.rlike(payload), 40.0).otherwise(0.0),
    )
    return F.when(long_run, F.least(points, F.lit(100.0))).otherwise(F.lit(0.0))


def expansion_factor(norm: str, biggest: Column) -> Column:
    """Largest of the word weights and, under an instruction, the largest number / 20."""
    factor = F.lit(1.0)
    parts = [factor]
    for weight in sorted(set(EXPANSION_WEIGHTS.values())):
        if weight / 5 > 1:
            words = [w for w, x in EXPANSION_WEIGHTS.items() if x == weight]
            parts.append(F.when(F.expr(T.contains_any(norm, words)), weight / 5))
    parts.append(F.when((biggest > 100) & has_instruction_verb(norm), biggest / 20))
    return F.least(F.greatest(*parts), F.lit(50.0))


def obfuscation_score(prompt: Column) -> Column:
    """Share of word tokens that mix letters with look-alike characters."""
    words = F.regexp_count(prompt, F.lit(f"(?<!{TOKEN})[0-9@$!+]*+[A-Za-z]{TOKEN}*+"))
    mixed = F.regexp_count(
        prompt, F.lit(f"(?<!{TOKEN})(?={TOKEN}*{LEET})(?={TOKEN}*[A-Za-z]){TOKEN}++")
    )
    share = F.coalesce(F.try_divide(mixed, words) * 120, F.lit(0.0))  # the words are counted once
    return F.when(prompt.rlike(LEET), F.least(share, F.lit(100.0))).otherwise(F.lit(0.0))


def input_tokens(words: Column) -> Column:
    return F.floor(words * 1.3).cast("int")


def predicted_tokens(tokens: Column, factor: Column) -> Column:
    return F.floor(tokens * factor).cast("long")


def cost_score(encoding: Column, expansion: Column, obfuscation: Column, entropy: Column) -> Column:
    """Half-even rounded mean of the four features: the scorer used without a trained model."""
    mean = (encoding + F.least(expansion * 2, F.lit(100.0)) + obfuscation + entropy) / 4
    return F.bround(mean).cast("int")


def cost_band(score: Column) -> Column:
    return F.when(score > 70, "high").when(score > 40, "medium").otherwise("low")


def with_text_forms(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Add the shared derived texts once, so that later expressions read them as columns."""
    p = F.col(prompt)
    return df.withColumns({
        "_lower": T.fold_case(p),
        "_norm": T.normalize_leet(F.lower(p)),
        "_words": T.word_count(p),
        "_biggest": T.max_number(p),
        "_long_run": T.has_run(p, 20),
    })


TEXT_FORMS = ["_lower", "_norm", "_words", "_biggest", "_long_run"]


def with_cost_signals(df: DataFrame, prompt: str = "prompt", tokens: Column | None = None) -> DataFrame:
    """Needs :func:`with_text_forms`; ``tokens`` lets a real tokenizer replace the word estimate."""
    p = F.col(prompt)
    df = df.withColumns({
        "encoding_score": encoding_score(p, F.col("_long_run")),
        "expansion_factor": expansion_factor("_norm", F.col("_biggest")),
        "obfuscation_score": obfuscation_score(p),
        "_entropy": shannon_entropy(p),
        "input_tokens": tokens if tokens is not None else input_tokens(F.col("_words")),
    })
    df = df.withColumns({
        "entropy_score": entropy_score(F.length(p), F.col("_entropy")),
        "predicted_tokens": predicted_tokens(F.col("input_tokens"), F.col("expansion_factor")),
    }).drop("_entropy")
    return df.withColumn(
        "cost_score",
        cost_score(*[F.col(c) for c in ("encoding_score", "expansion_factor", "obfuscation_score", "entropy_score")]),
    )


def cost_features() -> Column:
    """The feature vector as an array, from the columns of :func:`with_cost_signals`."""
    return F.array(
        F.col("encoding_score"),
        F.least(F.col("expansion_factor") * 2, F.lit(100.0)),
        F.col("obfuscation_score"),
        F.col("entropy_score"),
    )


def cost_result(method: str = "fallback_average") -> Column:
    """All cost signals as one struct, features rounded to two decimals."""
    r2 = {c: F.bround(F.col(c), 2).alias(c) for c in
          ("encoding_score", "expansion_factor", "obfuscation_score", "entropy_score")}
    return F.struct(
        "cost_score", "predicted_tokens", "input_tokens", r2["expansion_factor"],
        F.struct(*r2.values()).alias("breakdown"),
        F.lit(method).alias("scoring_method"),
    )
