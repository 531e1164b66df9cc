"""Phrase and structure rules: ten risk flags and two amplification flags.

Every pattern is listed with a literal that any match must contain. The literal is
searched first (a plain byte search), so the regex engine only runs on texts that can
match at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.functions import text as T

Rule = tuple[str, "str | tuple[str, ...]"]

# Flag -> (pattern, literal every match contains, or the choice of them).
PHRASE_RULES: dict[str, list[Rule]] = {
    "JAILBREAK_ATTEMPT": [
        (r"dan mode", "dan mode"),
        (r"jailbreak", "jailbreak"),
        (r"do anything now", "do anything now"),
        (r"ignore (your|all|previous|prior) (rules|instructions|guidelines|training|constraints)", "ignore "),
        (r"pretend (you are|to be|you're) (not|without|free)", "pretend "),
        (r"as an? (ai|language model) without", " without"),
        (r"you are now (free|unrestricted|without)", "you are now "),
        (r"disable (your|all) (filters|restrictions|safety)", "disable "),
        (r"developer mode", "developer mode"),
        (r"god mode", "god mode"),
        (r"unrestricted mode", "unrestricted mode"),
        (r"without (ethical|moral|safety) (guidelines|constraints|restrictions)", "without "),
    ],
    "ROLE_INJECTION": [
        (r"you are now (a |an )?(system|admin|root|superuser|god|master)", "you are now "),
        (r"act as (a |an )?(system|admin|root|unrestricted|evil|malicious)", "act as "),
        (r"your (new |true )?(role|persona|identity|name) is", "your "),
        (r"switch to (system|admin|developer|unrestricted) mode", "switch to "),
        (r"you are (no longer|not) (an? )?(ai|assistant|language model)", "you are no"),
        (r"from now on (you are|you will be|act as)", "from now on "),
        (r"i (hereby|now) appoint you", " appoint you"),
    ],
    "IGNORE_INSTRUCTIONS": [
        (r"ignore\s+(.+?\s+)?(instructions|prompts|rules|guidelines|context)", "ignore"),
        (r"disregard\s+(everything|all|any|previous|prior)", "disregard"),
        (r"forget\s+(everything|all|your|previous|prior)", "forget"),
        (r"override\s+(your|all|previous)\s*(instructions|settings|rules)", "override"),
        (r"new\s+(instructions|rules|prompt|system prompt)\s*:", "new"),
        (r"actual\s+(instructions|task|goal|objective)\s*:", "actual"),
    ],
    "SYSTEM_OVERRIDE_ATTEMPT": [
        (r"\[system\]", "[system]"),
        (r"<system>", "<system>"),
        (r"###\s*system", "###"),
        (r"system\s*prompt\s*:", "system"),
        (r"\|\s*system\s*\|", "system"),
        (r"<<sys>>", "<<sys>>"),
        (r"\[inst\]", "[inst]"),
        (r"<\|system\|>", "<|system|>"),
        (r"<\|im_start\|>\s*system", "<|im_start|>"),
    ],
    "PROMPT_LEAKING_ATTEMPT": [
        (
            r"(reveal|show|print|output|display|tell me|give me|repeat|leak) (your|the) "
            r"(system |original |initial )?(prompt|instructions|rules|context|setup)",
            ("prompt", "instructions", "rules", "context", "setup"),
        ),
        (r"what (are|were) your (instructions|rules|system prompt|guidelines)", " your "),
        (r"what (is|was) (in )?your (system|context|initial) prompt", " prompt"),
    ],
    "CONTEXT_MANIPULATION": [
        (r"end of (conversation|context|prompt|system)", "end of "),
        (r"new (conversation|context|session) (starts?|begins?|here)", "new "),
        (r"---+\s*(end|start|begin|new)", "---"),
        (r"(above|previous) (text|context|prompt) (is |was )?(a )?(test|example|fake|ignore)",
         ("text ", "context ", "prompt ")),
    ],
}

# Amplification phrases, same form.
AMPLIFICATION_RULES: dict[str, list[Rule]] = {
    "RECURSIVE_PATTERN": [
        (r"repeat\s+(this|the|every|each|all|your)\s*(output|response|answer|text|result)", "repeat"),
        (r"recursiv(e|ely)", "recursive"),
        (r"for\s+each\s+.+\s+generate", "generate"),
        (r"repeat\s+\d+\s+times", "repeat"),
        (r"in\s+an?\s+infinite\s+loop", "infinite"),
        (r"keep\s+(repeating|generating|outputting|going)", "keep"),
        (r"never\s+stop\s+(writing|generating|outputting)", "never"),
        (r"generate\s+.+\s+for\s+each\s+of", "generate"),
        (r"expand\s+(each|every|this)\s+(point|item|entry|line)\s+into", "expand"),
    ],
    "SELF_REPLICATION": [
        (r"copy\s+(this|yourself|your (output|response))\s+(\d+\s+)?times", "copy"),
        (r"duplicate\s+(the\s+)?(output|response|text)\s+\d+", "duplicate"),
        (r"replicate\s+(this|the|your)", "replicate"),
        (r"self.replicate", "replicate"),
        (r"output\s+this\s+message\s+\d+\s+times", "message"),
        (r"print\s+(this|the following)\s+\d+\s+times", "print"),
    ],
}

# Characters that hide text, and words searched in decoded payloads.
INVISIBLE = ["\u200b", "\u200c", "\u200d", "\ufeff", "\u00ad"]
INJECTION_RUN = r"[A-Za-z0-9+/]{30,}={0,2}"
INJECTION_WORDS = ["ignore", "system", "prompt", "role", "jailbreak", "admin", "override", "instructions"]


def phrase_flag(folded: str, rules: list[Rule]) -> Column:
    """True when any rule matches the column; patterns sharing a literal share one regex scan."""
    by_literal: dict[tuple[str, ...], list[str]] = {}
    for pattern, literal in rules:
        key = (literal,) if isinstance(literal, str) else literal
        by_literal.setdefault(key, []).append(pattern)
    tests = []
    for literals, patterns in by_literal.items():
        cond = T.contains_any(folded, list(literals))
        if patterns != list(literals):
            regex = T.sql_text(T.text_pattern("|".join(f"(?:{p})" for p in patterns)))
            cond = f"({cond} AND {folded} RLIKE {regex})"
        tests.append(cond)
    return F.expr(" OR ".join(tests))


def hidden_unicode(prompt: str) -> Column:
    return F.expr(T.contains_any(prompt, INVISIBLE))


def whitespace_stuffing(prompt: str) -> Column:
    return F.col(prompt).rlike(T.text_pattern(r"\s{20,}"))


def html_comment(prompt: str) -> Column:
    return F.contains(F.col(prompt), F.lit("<!--")) & F.col(prompt).rlike(r"(?s)<!--.*?-->")


def base64_injection(prompt: str, long_run: Column | None = None) -> Column:
    """One of the first five base64 runs decodes to text with an injection word."""
    text = F.col(prompt)
    long_run = T.has_run(text, 20) if long_run is None else long_run
    words = "|".join(INJECTION_WORDS)
    hit = F.exists(T.decoded_runs(text, INJECTION_RUN, 5), lambda t: F.coalesce(t.rlike(words), F.lit(False)))
    return F.when(long_run, hit).otherwise(F.lit(False))


def _base64_detector(folded: str, prompt: str) -> Column:
    return base64_injection(prompt)


def detectors() -> dict[str, Callable[[str, str], Column]]:
    """The registry: flag -> function of the column names of the folded and original text.

    Callers may add their own detectors.
    """
    found: dict[str, Callable[[str, str], Column]] = {
        flag: (lambda folded, prompt, rules=rules: phrase_flag(folded, rules))
        for flag, rules in PHRASE_RULES.items()
    }
    found["HIDDEN_UNICODE_PAYLOAD"] = lambda folded, prompt: hidden_unicode(prompt)
    found["WHITESPACE_STUFFING"] = lambda folded, prompt: whitespace_stuffing(prompt)
    found["HTML_COMMENT_INJECTION"] = lambda folded, prompt: html_comment(prompt)
    found["BASE64_INJECTION"] = _base64_detector
    return found


def flag_array(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, sorted; conditions should be plain columns."""
    joined = F.concat_ws(",", *[F.when(conditions[name], F.lit(name)) for name in sorted(conditions)])
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


def with_rule_flags(
    df: DataFrame, prompt: str = "prompt", folded: str = "_lower", registry: dict | None = None
) -> DataFrame:
    """Add ``rule_flags`` and ``rule_score`` (18 points per flag, at most 100)."""
    registry = dict(detectors() if registry is None else registry)
    if "_long_run" in df.columns and registry.get("BASE64_INJECTION") is _base64_detector:
        registry["BASE64_INJECTION"] = lambda folded, text: base64_injection(text, F.col("_long_run"))
    raw = {f"_f_{name}": fn(folded, prompt) for name, fn in registry.items()}
    df = df.withColumns(raw)
    df = df.withColumn("rule_flags", flag_array({n: F.col(f"_f_{n}") for n in registry}))
    return df.drop(*raw).withColumn("rule_score", rule_score(F.col("rule_flags")))


def rule_score(flags: Column) -> Column:
    return F.least(F.size(flags) * 18, F.lit(100))
