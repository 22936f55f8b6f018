"""The writer: requests judged, rendered and published, each with a receipt.

A request has operation_id, idempotency_key, target_path, frontmatter (map of strings),
body, actor, task_id, provenance_mode and an order (``created_at``). The first rule that it
breaks names its refusal; what breaks none is rendered, bound by digests, and published to
a ``StoredQueue`` from a base that may move, at most twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import PREFIX, framed_sha256
from ..functions.values import canonical_json, quoted, value_digest
from ..sources.tables import stored
from .convert import first_marker, target_refusal
from .outbox import StoredQueue, timestamp_text

#: Fixed values.
OPERATION_ID = r"\A[a-z0-9][a-z0-9._-]{0,63}\z"
KEY_LENGTHS = (16, 256)
PROVENANCE = ("by", "generated", "authored")
_MAP = T.MapType(T.StringType(), T.StringType())


def plain_digest(c: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(c.cast("binary"), 256))


def rendered(frontmatter: Column, body: Column, actor: Column, mode: Column, at: Column) -> Column:
    """A note: its frontmatter with provenance, by sorted keys, then its body, ended by a line break.

    Values are JSON strings, which YAML reads as they are.
    """
    given = F.transform(F.map_entries(frontmatter), lambda e: F.struct(e["key"].alias("k"), F.concat(e["key"], F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("null"))).alias("line")))
    provenance = F.concat(mode, F.lit(':\n  at: '), quoted(timestamp_text(at)), F.lit("\n  by: "), quoted(actor))
    lines = F.transform(F.array_sort(F.array_append(given, F.struct(mode.alias("k"), provenance.alias("line")))), lambda e: e["line"])
    text = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body)
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def payload(operation_id: Column, target_path: Column, frontmatter: Column, body: Column, mode: Column) -> tuple[Column, T.StructType]:
    """What a request asks for, and its type: the value that ``request_hash`` digests."""
    named = {"operation_id": operation_id, "target_path": target_path, "frontmatter": frontmatter, "body": body, "provenance_mode": mode}
    kinds = [T.StructField(k, _MAP if k == "frontmatter" else T.StringType()) for k in named]
    return F.struct(*(c.alias(k) for k, c in named.items())), T.StructType(kinds)


def payload_text(*request: Column) -> Column:
    """The canonical text of a request, as it is kept until it is replayed."""
    return canonical_json(*payload(*request))


def request_hash(*request: Column) -> Column:
    return value_digest(*payload(*request))


def binding(domain: str, *bound: Column) -> Column:
    """Length-framed digest of what a published operation is bound to."""
    return framed_sha256(F.lit(domain), *bound)


def judged(requests: DataFrame, grants: dict[str, tuple[str, ...]], privacy: Column, admissible: tuple[str, ...], markers: list[str], at: str = "created_at") -> DataFrame:
    """Requests with ``code`` (null if admitted), content, content_hash, request_hash, idempotency_hash and task_hash.

    ``privacy``: the class of a request's note, null where it is not classified. ``grants``:
    folders that may be written and the classes that they take.
    """
    c = F.col
    asked = (c("operation_id"), c("target_path"), c("frontmatter"), c("body"), c("provenance_mode"))
    shaped = F.regexp_like(c("operation_id"), F.lit(OPERATION_ID)) & F.length("idempotency_key").between(*KEY_LENGTHS) & c("target_path").isNotNull() & c("body").isNotNull()
    content = rendered(F.coalesce(c("frontmatter"), F.create_map().cast("map<string,string>")), c("body"), c("actor"), c("provenance_mode"), c(at))
    rows = requests.withColumn("content", content)
    code = (
        F.when(~F.coalesce(shaped, F.lit(False)), "request-invalid").when(c("actor").isNull() | c("task_id").isNull() | c("provenance_mode").isNull(), "identity-missing")
        .when(F.coalesce(F.arrays_overlap(F.map_keys("frontmatter"), F.array(*map(F.lit, PROVENANCE))), F.lit(False)), "provenance-forbidden")
        .when(privacy.isNull(), "privacy-unclassified").when(~privacy.isin(*admissible), "privacy-denied")
        .when(target_refusal(c("target_path"), privacy, grants).isNotNull(), target_refusal(c("target_path"), privacy, grants)).when(first_marker(c("content"), markers).isNotNull(), "secret-detected")
    )
    rows = rows.withColumn("code", code)
    ok = lambda x: F.when(F.col("code").isNull(), x)
    return rows.withColumns({
        "content": ok(c("content")), "content_hash": ok(plain_digest(c("content"))), "request_hash": ok(request_hash(*asked)),
        "idempotency_hash": ok(plain_digest(c("idempotency_key"))), "task_hash": ok(plain_digest(c("task_id"))),
    })


def execute(queue: StoredQueue, requests: DataFrame, at: str = "created_at") -> DataFrame:
    """Receipts of ``judged`` requests: operation_id, ``at``, status (accepted, duplicate or refused) and code.

    A request that repeats a published operation in every respect gets its receipt again; one
    that shares its operation or key but differs is a conflict.
    """
    rows = stored(requests)
    good = queue.enqueue(rows.where("code IS NULL"), at)
    known = F.when(F.col("outcome") == "conflict", "idempotency-conflict").when(F.col("outcome") == "base-moved", "base-moved")
    done = good.select("operation_id", at, F.when(known.isNull(), F.col("outcome")).otherwise("refused").alias("status"), known.alias("code"))
    return done.unionByName(rows.where("code IS NOT NULL").select("operation_id", at, F.lit("refused").alias("status"), "code"))
