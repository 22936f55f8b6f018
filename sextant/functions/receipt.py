"""Receipts of a capture tool: lines ``<prefix>key=value`` to a checked struct, the first fault named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BASE = ("path", "status", "surface", "git_mode")
PLANNED = (*BASE, "contract", "concept_id")
COMPLETED = (*PLANNED, "id")
KNOWN = (*COMPLETED, "request_id")
MODES = ("direct", "isolated")
CAPTURE_PATH = r"\ACore/_inbox/agent-captures/[0-9]{4}-[0-9]{2}-[0-9]{2}-([a-z0-9][a-z0-9-]{0,79})\.md\z"
UUID7 = r"\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
#: What ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def receipt(output: Column, slug: Column, dry_run: Column, prefix: str = "capture_") -> Column:
    """fault (null if none), path, status, git_mode, contract, id, concept_id of a tool's output.

    Faults in the order in which they are looked for: line (no ``=``), key (unknown),
    repeated, keys (not those of one form), contract, status, surface, mode, path, id.
    Lines without the prefix are no part of the receipt. The fields of a faulty receipt are null.
    """
    at = len(prefix) + 1
    lines = F.filter(F.split(F.coalesce(output, F.lit("")), LINE_END), lambda x: x.startswith(prefix))
    pairs = F.transform(lines, lambda x: F.struct(
        F.substring(F.substring_index(x, "=", 1), at, 1 << 30).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.lit(1 << 30))).alias("v"),
    ))
    dry, status = F.coalesce(dry_run, F.lit(False)), F.when(F.coalesce(dry_run, F.lit(False)), "planned").otherwise("created")

    def faults(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["k"])
        one = F.transform(pairs, lambda p, i: F.when(p["v"].isNull(), "line").when(~p["k"].isin(*KNOWN), "key").when(F.array_position(keys, p["k"]) <= i, "repeated"))
        form = lambda names: (F.size(keys) == len(names)) & F.forall(keys, lambda k: k.isin(*names))
        value = lambda k: F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"]
        return F.struct(F.get(F.filter(one, lambda x: x.isNotNull()), F.lit(0)).alias("line"), *(form(f).alias(n) for n, f in (("base", BASE), ("planned", PLANNED), ("completed", COMPLETED))), *(value(k).alias(k) for k in COMPLETED))

    def judged(r: Column) -> Column:
        path = r["path"]
        fault = (
            F.when(r["line"].isNotNull(), r["line"]).when(~(r["base"] | r["planned"] | r["completed"]), "keys")
            .when(~r["base"] & (r["contract"] != "3"), "contract").when((dry & r["completed"]) | (r["status"] != status) | (r["planned"] & (r["status"] != "planned")), "status")
            .when(r["surface"] != "core", "surface").when(~r["git_mode"].isin(*MODES), "mode")
            .when(~F.regexp_like(path, F.lit(CAPTURE_PATH)) | ~F.regexp_extract(path, CAPTURE_PATH, 1).eqNullSafe(slug), "path")
            .when(~r["base"] & (r["concept_id"] != F.substring(path, F.lit(1), F.length(path) - 3)), "path")
            .when(r["completed"] & ~F.regexp_like(r["id"], F.lit(UUID7)), "id")
        )
        return _let(fault, lambda f: F.struct(f.alias("fault"), *(F.when(f.isNull(), r[k]).alias(k) for k in ("path", "status", "git_mode", "contract", "id", "concept_id"))))

    return _let(pairs, lambda p: _let(faults(p), judged))


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))
