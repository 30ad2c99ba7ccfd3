"""Compatibility of two versions of schemas, declared breaks, and an audit of URLs against an allowlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import order

# Hosts that are never allowed; * stands for any characters.
DENIED_HOSTS = (
    "api.openai.com", "*.openai.azure.com", "api.anthropic.com", "*.googleapis.com", "bedrock*.amazonaws.com", "api.mistral.ai", "api.cohere.ai", "api.cohere.com", "api.groq.com",
    "api.together.xyz", "api.together.ai", "openrouter.ai", "*.openrouter.ai", "api.fireworks.ai", "api.deepseek.com", "api.x.ai", "api.perplexity.ai", "api.voyageai.com",
)
DEFAULT_PORTS = {"http": 80, "https": 443}


def breaks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking differences. Both sides: subject, path, type, required, vals (the enum's, or null), a row for each field."""
    key = ["subject", "path"]
    side = lambda df, s: df.select(*key, *(F.col(c).alias(f"{c}_{s}") for c in ("type", "required", "vals")), F.lit(True).alias(s))
    both = side(old, "old").join(side(new, "new"), key, "full_outer").join(new.select("subject").distinct().withColumn("there", F.lit(True)), "subject", "left")
    gone = F.col("new").isNull()
    rules = [
        ("removed_subject", gone & F.col("there").isNull()),
        ("removed_field", gone & F.col("there").isNotNull()),
        ("type_changed", F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("type_old") != F.col("type_new"))),
        ("newly_required", F.col("new").isNotNull() & F.col("required_new") & ~F.coalesce("required_old", F.lit(False))),
        ("enum_narrowed", F.col("vals_old").isNotNull() & F.col("vals_new").isNotNull() & (F.size(F.array_except("vals_old", "vals_new")) > 0)),
    ]
    found = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
    return both.select(*key, F.explode(found).alias("problem"))


FACTS = ("type", "required", "vals")


def reachable(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(subject, model): each root and every model that its fields refer to, directly or through others, once each. refs: model, ref; roots: subject.

    A round adds what is one reference further on and new; the rounds end, on circles too, as a subject reaches a model once. Each is written.
    """
    refs = refs.filter("model is not null and ref is not null").distinct()
    found = front = order.staged(roots.select("subject", F.col("subject").alias("model")).distinct(), "models")
    while not front.isEmpty():
        further = front.join(refs, "model").select("subject", F.col("ref").alias("model")).distinct()
        front = order.staged(further.join(found, ["subject", "model"], "left_anti"), "models")
        found = found.unionByName(front)
    return found


def flatten(fields: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows for all fields of each root and of what it refers to: subject, model (null for the root's own), path, type, required, vals. fields: model, field, type, required, vals, ref."""
    held = reachable(fields.select("model", "ref"), roots).join(fields.drop("ref"), "model", "left")
    own = F.col("model") == F.col("subject")
    path = F.when(own, F.concat(F.lit("/properties/"), "field")).otherwise(F.concat(F.lit("/$defs/"), "model", F.lit("/properties/"), "field"))
    return held.select("subject", F.when(~own, F.col("model")).alias("model"), path.alias("path"), *FACTS)  # no path: a model without fields


def nested_breaks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(subject, path, problem) of two flattened versions: as breaks, and a model that is gone is one removed_model at its own path, its fields none."""
    key = ["subject", "model"]
    models = lambda df: df.filter("model is not null").select(*key).distinct()
    kept = new.select("subject").distinct()
    gone = models(old).join(kept, "subject", "left_semi").join(models(new), key, "left_anti")
    removed = gone.select("subject", F.concat(F.lit("/$defs/"), "model").alias("path"), F.lit("removed_model").alias("problem"))
    plain = lambda df: df.filter("path is not null").select("subject", "path", *FACTS)
    return breaks(plain(old.join(gone, key, "left_anti")), plain(new)).unionByName(removed)


def verdicts(old: DataFrame, new: DataFrame, found: DataFrame, declared: DataFrame) -> DataFrame:
    """subject, verdict: breaking if a break is not declared, stale if a declaration has no break, else pass. declared: subject, path, problem."""
    key = ["subject", "path", "problem"]
    open_ = found.join(declared, key, "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("open"))
    idle = declared.join(found, key, "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("idle"))
    subjects = old.select("subject").union(new.select("subject")).union(declared.select("subject")).distinct()
    rows = subjects.join(open_, "subject", "left").join(idle, "subject", "left")
    return rows.select("subject", F.when(F.col("open") > 0, "breaking").when(F.col("idle") > 0, "stale").otherwise("pass").alias("verdict"))


def endpoint(url: Column) -> Column:
    """struct(scheme, host, port, path, problem) of a base URL; problem is null if it is well-formed."""
    text = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = F.lower(F.regexp_extract(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    place = F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.when(F.startswith(place, F.lit("[")), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1)))
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    path = F.rtrim(F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    problem = (
        F.when(text.isNull() | (text == ""), "empty")
        .when(~scheme.isin(*DEFAULT_PORTS), "scheme")
        .when(F.contains(place, F.lit("@")), "credentials")
        .when(text.rlike(r"^[^?#]*\?[^#]|#."), "query")  # an empty query or fragment is none
        .when(F.startswith(place, F.lit("[")) & ~place.rlike(r"^\[[0-9a-fA-F:.]+\](:.*)?$"), "host")
        .when((port != "") & ~(port.rlike(r"^[0-9]{1,5}$") & (F.try_to_number(port, F.lit("99999")) <= 65535)), "port")
        .when(host == "", "host")
    )
    number = F.when(port.rlike(r"^[0-9]{1,5}$") & (F.try_to_number(port, F.lit("99999")) > 0), port.cast("int")).otherwise(F.when(scheme == "https", 443).otherwise(80))
    return F.struct(scheme.alias("scheme"), host.alias("host"), number.alias("port"), path.alias("path"), problem.alias("problem"))


def denied(host: Column) -> Column:
    patterns = [p.replace(".", r"\.").replace("*", ".*") for p in DENIED_HOSTS]
    return host.rlike("^(" + "|".join(patterns) + ")$")


def url_audit(urls: DataFrame, allowed: DataFrame, key: str, url: str = "url") -> DataFrame:
    """key, verdict: malformed, denied, allowed (same scheme, host and port, path below an allowed one) or not_allowed.

    allowed is a deployment's short list of base URLs, well-formed and not denied themselves.
    """
    bases = allowed.select(endpoint(F.col("url")).alias("e")).select("e.*").filter("problem is null").filter(~denied(F.col("host")))
    bases = bases.groupBy("scheme", "host", "port").agg(F.collect_set("path").alias("paths"))
    rows = urls.select(key, endpoint(F.col(url)).alias("e")).select(key, "e.*")
    rows = rows.join(bases, ["scheme", "host", "port"], "left")
    under = F.exists("paths", lambda p: (F.col("path") == p) | F.startswith(F.col("path"), F.concat(p, F.lit("/"))))
    verdict = F.when(F.col("problem").isNotNull(), "malformed").when(denied(F.col("host")), "denied").when(F.coalesce(under, F.lit(False)), "allowed").otherwise("not_allowed")
    return rows.select(key, verdict.alias("verdict"))
