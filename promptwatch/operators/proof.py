"""Proof-of-compute submissions: from the request's ``challenge_response`` to the gate's ``proof``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptwatch.functions.policy import proof_audit
from promptwatch.functions.verdicts import strict_object
from promptwatch.operators.gate import BAD_PROOF, GOOD_PROOF, NO_PROOF
from promptwatch.params import SECOND_US, Params

# Why a submission is refused before its nonce is looked at.
BAD_FORMAT, BAD_TOKEN = "invalid submission format", "invalid challenge JWT"


def with_proofs(requests: DataFrame, challenges: DataFrame, params: Params = Params(), ts: str = "ts_us") -> DataFrame:
    """Add ``proof`` and ``proof_reason`` (NULL unless refused).

    ``challenge_response`` is a JSON object of ``jwt`` and ``nonce``; ``challenges`` holds a row
    ``jwt, challenge, issued_us`` for each token that was signed and has not expired. Only
    requests that name a token are joined, so those without one (most) stay where they are.
    """
    sent = F.col("challenge_response")
    fields = F.when(strict_object(sent), F.from_json(sent, "map<string,string>"))
    nonce = F.when(F.map_contains_key("_s", "nonce"), F.coalesce(F.try_element_at("_s", F.lit("nonce")), F.lit("None"))).otherwise("")
    read = requests.withColumn("_s", fields).withColumns({
        "_nonce": nonce, "_jwt": F.coalesce(F.try_element_at("_s", F.lit("jwt")), F.when(F.col("_s").isNotNull(), F.lit(""))),
    })
    known = challenges.select(F.col("jwt").alias("_jwt"), F.col("challenge").alias("_challenge"), F.col("issued_us").alias("_issued"))
    named = read.filter("_jwt <> ''").join(known, "_jwt", "left")
    others = read.filter("_jwt IS NULL OR _jwt = ''").withColumns({
        "_challenge": F.lit(None).cast("string"), "_issued": F.lit(None).cast("bigint"),
    })
    audit = proof_audit(F.col("_challenge"), F.col("_nonce"), (F.col(ts) - F.col("_issued")) / SECOND_US, params)
    reason = (
        F.when(F.coalesce(sent, F.lit("")) == "", None)
        .when(F.col("_s").isNull(), BAD_FORMAT)
        .when(F.col("_issued").isNull(), BAD_TOKEN)
        .otherwise(audit["reason"])
    )
    proof = F.when(F.coalesce(sent, F.lit("")) == "", NO_PROOF).when(F.col("proof_reason").isNull(), GOOD_PROOF).otherwise(BAD_PROOF)
    both = named.unionByName(others).withColumn("proof_reason", reason).withColumn("proof", proof)
    return both.drop("_s", "_nonce", "_jwt", "_challenge", "_issued")
