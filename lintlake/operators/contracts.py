"""API contracts: extraction from OpenAPI documents, diffs, breaking changes, baseline hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

METHODS = ["get", "post", "put", "delete", "patch"]  # fixed values
ENDPOINT = ["service", "method", "endpoint"]

_SCHEMA = "struct<properties:map<string,struct<type:string,format:string>>,required:array<string>>"
_BODY = f"struct<content:map<string,struct<schema:{_SCHEMA}>>>"
_DOC = f"struct<paths:map<string,map<string,struct<summary:string,requestBody:{_BODY},responses:map<string,{_BODY}>>>>>"


def _operations(docs: DataFrame) -> DataFrame:
    parsed = docs.select("service", "version", F.from_json("doc", _DOC).alias("d"))
    paths = parsed.select("service", "version", F.explode("d.paths").alias("endpoint", "methods"))
    ops = paths.select("service", "version", "endpoint", F.explode("methods").alias("m", "op")).filter(F.lower("m").isin(*METHODS))
    ok = F.when(F.col("op.responses").getItem("200").isNotNull(), 200).when(F.col("op.responses").getItem("201").isNotNull(), 201)
    body = F.coalesce(F.col("op.responses").getItem("200"), F.col("op.responses").getItem("201"))
    return ops.select(
        "service", "version", F.upper("m").alias("method"), "endpoint",
        F.coalesce(ok, F.lit(200)).alias("status_code"),
        F.coalesce("op.summary", F.lit("")).alias("summary"),
        F.col("op.requestBody.content").getItem("application/json").getField("schema").alias("request"),
        body.getField("content").getItem("application/json").getField("schema").alias("response"),
    )


def contracts_from_openapi(docs: DataFrame) -> DataFrame:
    """One row per (path, method) of ``docs(service, version, doc)``; success is 200, else 201."""
    return _operations(docs).select(
        "service", "version", "method", "endpoint", "status_code", "summary",
        F.coalesce(F.size("request.properties"), F.lit(0)).alias("request_fields"),
        F.coalesce(F.size("response.properties"), F.lit(0)).alias("response_fields"),
    )


def contract_fields(docs: DataFrame) -> DataFrame:
    """One row per request or response field."""
    ops = _operations(docs)

    def side(name: str) -> DataFrame:
        return ops.select(
            "service", "version", "method", "endpoint", F.lit(name).alias("side"),
            F.explode(f"{name}.properties").alias("field", "spec"), F.col(f"{name}.required").alias("_req"),
        ).select(
            "service", "version", "method", "endpoint", "side", "field", F.col("spec.type").alias("type"),
            F.col("spec.format").alias("format"), F.coalesce(F.array_contains("_req", F.col("field")), F.lit(False)).alias("required"),
        )

    return side("request").unionByName(side("response"))


def field_digest() -> Column:
    """The hash of one field; ``tree_hash`` makes an endpoint's of them."""
    return F.sha2(F.concat_ws("|", "side", "field", F.coalesce("type", F.lit("")), F.coalesce("format", F.lit("")), F.col("required").cast("string")), 256)


def tree_hash(rows: DataFrame, keys: list[str], leaf: str, out: str) -> DataFrame:
    """A hash per key over all its leaf hashes (hex digits, every one of them), whatever their order; a repeated leaf counts.

    Leaves are hashed in order in buckets of their first three digits, then the buckets, so a group holds 1/4096 of a hot key's leaves.
    """
    per_bucket = rows.select(*keys, F.substring(leaf, 1, 3).alias("_b"), F.col(leaf).alias("_h")).groupBy(*keys, "_b").agg(
        F.sha2(F.expr("listagg(_h, '') WITHIN GROUP (ORDER BY _h)"), 256).alias("_h")
    )
    return per_bucket.groupBy(*keys).agg(
        F.substring(F.sha2(F.expr("listagg(_h, '') WITHIN GROUP (ORDER BY _b)"), 256), 1, 16).alias(out)
    )


def baseline_hash(contracts: DataFrame) -> DataFrame:
    """One hash per service over ``contracts(service, method, endpoint, status_code, schema_hash)``."""
    leaf = F.sha2(F.concat_ws("|", "method", "endpoint", F.col("status_code").cast("string"), "schema_hash"), 256)
    return tree_hash(contracts.withColumn("_leaf", leaf), ["service"], "_leaf", "baseline_hash")


def diff_contracts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Endpoints added, removed (breaking) or modified, by hash; (service, method, endpoint) is unique per side."""
    o = old.select(*ENDPOINT, F.col("schema_hash").alias("_o"))
    n = new.select(*ENDPOINT, F.col("schema_hash").alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified")
    return o.join(n, ENDPOINT, "full_outer").select(*ENDPOINT, kind.alias("change_type")).filter("change_type IS NOT NULL")


def contract_breaks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field-level reasons why a kept endpoint breaks, over two ``contract_fields`` versions with ``status_code``."""
    key = [*ENDPOINT, "side", "field"]

    def tagged(df: DataFrame, version: str) -> DataFrame:
        return df.select(*key, F.lit(version).alias("_v"), F.struct("type", "format", "required").alias("_f"), "status_code")

    def newest(version: str, column: str) -> Column:
        return F.max(F.when(F.col("_v") == version, F.col(column)))

    # both versions are read once and meet in one aggregate
    each = tagged(old, "o").unionByName(tagged(new, "n")).groupBy(*key).agg(
        newest("o", "_f").alias("_o"), newest("n", "_f").alias("_n"), newest("o", "status_code").alias("_os"), newest("n", "status_code").alias("_ns")
    )
    here = F.bool_or(F.col("_o").isNotNull()) & F.bool_or(F.col("_n").isNotNull())
    kept = each.groupBy(*ENDPOINT).agg(F.max("_os").alias("_os"), F.max("_ns").alias("_ns"), here.alias("_here")).filter("_here")
    # only old fields can break; a field new on the other side never does
    both = each.filter("_o IS NOT NULL").join(kept, ENDPOINT, "left_semi").select(
        *key, F.col("_n").isNotNull().alias("n_here"),
        *[F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in "on" for c in ("type", "format", "required")],
    )
    request, lost = F.col("side") == "request", ~F.col("n_here")
    typed = (F.col("o_type") != F.col("n_type")) & F.col("o_type").isNotNull() & F.col("n_type").isNotNull()
    formatted = F.col("o_format").isNotNull() & ~F.col("o_format").eqNullSafe(F.col("n_format"))
    reasons = F.array_compact(F.array(
        F.when(lost & request, "request_field_removed"),
        F.when(request & F.col("o_required") & ~F.coalesce("n_required", F.lit(False)), "required_removed"),
        F.when(lost & ~request, "response_field_removed"),
        F.when(~lost & typed & request, "request_type_changed"),
        F.when(~lost & typed & ~request, "response_type_changed"),
        F.when(~lost & formatted & request, "format_changed"),
    ))
    fields = both.select(*ENDPOINT, "field", F.explode(reasons).alias("reason"))

    moved = kept.filter("_os <> _ns").select(*ENDPOINT, F.lit("").alias("field"), F.lit("status_changed").alias("reason"))
    return fields.unionByName(moved)


def removed_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """U4: old request fields missing from the new version, per kept endpoint, as sets."""
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.filter("side = 'request'").groupBy(*ENDPOINT).agg(F.collect_set("field").alias(name))

    pairs = sets(old, "_o").join(sets(new, "_n"), ENDPOINT)
    return pairs.select(*ENDPOINT, F.array_sort(F.array_except("_o", "_n")).alias("removed")).filter(F.size("removed") > 0)
