"""Grants, credentials and domains: who may read what, decided in the plan.

The capability matrix is a small table (actor, domain, capabilities) that the caller
supplies; its size is the number of actors times that of domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .privacy import NEVER

#: Domains, and the capabilities that reading services serve.
DOMAINS = ("finance", "calendar-context", "private-work", "social-circle", "personal-retrospective", "core-engineering")
CORE = "core-engineering"
SERVED = ("read", "report-generation")
ITEM_BOUNDS, BYTE_BOUNDS = (1, 20), (64, 32_768)


def _within(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def validate(grants: DataFrame, matrix: DataFrame, trusted_issuer: str) -> DataFrame:
    """``grants`` with ``refusal``: the first rule that a grant breaks, null if it is valid."""
    grid = matrix.groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("domain", "capabilities"))).alias("_grid"))
    rows = grants.join(grid, "actor", "left")
    allowed = lambda d: F.coalesce(F.try_element_at(F.col("_grid"), d), F.array().cast("array<string>"))
    served = F.array(*map(F.lit, SERVED))
    bounds = F.col("max_items").between(*ITEM_BOUNDS) & F.col("max_bytes").between(*BYTE_BOUNDS) & (F.col("issued_at") < F.col("expires_at"))
    refusal = (
        F.when(~F.coalesce(bounds, F.lit(False)) | (F.size("domains") < 1), "grant-malformed")
        .when(~F.col("issued_by").eqNullSafe(F.lit(trusted_issuer)), "owner-trust-required")
        .when(~_within(F.col("capabilities"), served), "capability-not-served")
        .when(F.array_contains("capabilities", "report-generation") & ~F.array_contains("capabilities", "read"), "report-requires-read")
        .when(F.array_contains("privacy_classes", NEVER), "student-private-scope-denied")
        .when(F.exists("domains", lambda d: ~_within(F.col("capabilities"), allowed(d))), "agent-domain-capability-denied")
        .when(F.array_contains("domains", CORE) & F.array_contains("privacy_classes", "sensitive"), "sensitive-core-routing-denied")
    )
    return rows.withColumn("refusal", refusal).drop("_grid")


def eligibility(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("actor", "domain").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("capabilities")))).alias("capabilities"))


def decide(rows: DataFrame, now: Column, actor: Column, grant_actor: Column, granted: Column, issued: Column, expires: Column, domain: Column, domains: Column, required: Column, capabilities: Column) -> Column:
    """The first denial of a request joined with its grant; null if access is given."""
    return (
        F.when(granted.isNull(), "invalid-credential")
        .when(actor != grant_actor, "wrong-actor")
        .when(now < issued, "scope-not-active")
        .when(now >= expires, "scope-expired")
        .when(~F.array_contains(domains, domain), "domain-denied")
        .when(~_within(required, capabilities), "capability-denied")
    )


def resolve(requests: DataFrame, actors: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests`` (actor_credential, grant_credential, domain, required, at) with ``denial`` and the grant.

    actors: credential_sha256, actor. Credentials are compared as digests, by two equi-joins.
    """
    missing = (F.coalesce(F.col("actor_credential"), F.lit("")) == "") | (F.coalesce(F.col("grant_credential"), F.lit("")) == "")
    rows = requests.withColumns({"_a": F.sha2("actor_credential", 256), "_g": F.sha2("grant_credential", 256)})
    rows = rows.join(actors.select(F.col("credential_sha256").alias("_a"), F.col("actor").alias("_actor")), "_a", "left")
    held = grants.select(F.col("credential_sha256").alias("_g"), F.struct(*[c for c in grants.columns if c != "credential_sha256"]).alias("grant"))
    rows = rows.join(held, "_g", "left")
    denial = decide(rows, F.col("at"), F.col("_actor"), F.col("grant.actor"), F.when(F.col("_actor").isNotNull(), F.col("grant.grant_id")), F.col("grant.issued_at"), F.col("grant.expires_at"), F.col("domain"), F.col("grant.domains"), F.col("required"), F.col("grant.capabilities"))
    return rows.withColumn("denial", F.when(missing, "missing-credential").otherwise(denial)).withColumn("grant", F.when(F.col("denial").isNull(), F.col("grant"))).drop("_a", "_g", "_actor")


def in_domain(entries: DataFrame, bindings: DataFrame, domain: str, key: str = "id") -> DataFrame:
    """Entries bound to the domain; a binding that occurs twice refuses the whole snapshot."""
    if bindings.groupBy("note_id").count().where("count > 1").limit(1).count():
        raise ValueError("a note is bound twice")
    chosen = bindings.where(F.col("domain") == domain).select(F.col("note_id").alias(key))
    return entries.where(F.col(key).isNotNull()).join(chosen, key, "left_semi")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: The shape of request and task ids, and of model ids.
RUNTIME_ID, MODEL_ID = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z", r"\A[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}\z"


def writers(requests: DataFrame, actors: DataFrame) -> DataFrame:
    """``requests`` with ``refusal`` (null if the writer is known and may) and ``rendered``, the actor as a record names it.

    requests: credential, request_id, task_id, mode (generated or captured), model_id.
    actors: credential_sha256, actor, generated, captured (booleans). A person writes
    without a model; anyone else generates with a named one, which becomes part of the name.
    """
    rows = requests.withColumn("_c", F.concat(F.lit("sha256:"), F.sha2("credential", 256)))
    held = actors.select(F.col("credential_sha256").alias("_c"), F.col("actor").alias("_actor"), F.col("generated").alias("_gen"), F.col("captured").alias("_cap"))
    rows = rows.join(held, "_c", "left")
    like = lambda c, p: F.coalesce(F.regexp_like(F.col(c), F.lit(p)), F.lit(False))
    present = (F.coalesce("credential", F.lit("")) != "") & like("request_id", RUNTIME_ID) & like("task_id", RUNTIME_ID)
    made, person = F.col("mode") == "generated", F.col("_actor").startswith("human:")
    model = like("model_id", MODEL_ID) & (F.col("model_id") != "unknown")
    refusal = (
        F.when(~present, "identity-missing").when(F.col("_actor").isNull(), "actor-denied").when(~F.coalesce(F.col("mode").isin("generated", "captured"), F.lit(False)), "identity-missing")
        .when(~F.when(made, F.col("_gen")).otherwise(F.col("_cap")), "actor-denied").when((~made | person) & F.col("model_id").isNotNull(), "actor-denied")
        .when(made & ~person & ~model, "model-identity-missing")
    )
    rendered = F.when(made & ~person, F.concat_ws("/", "_actor", "model_id")).otherwise(F.col("_actor"))
    return rows.withColumn("refusal", refusal).withColumn("rendered", F.when(F.col("refusal").isNull(), rendered)).drop("_c", "_actor", "_gen", "_cap")
