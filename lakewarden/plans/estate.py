"""Registered queries of the estate operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import text
from lakewarden.operators import catalog, history, order, profile, quality
from lakewarden.plans import duck
from lakewarden.plans import inputs as I
from lakewarden.sources import catalog as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns of the tables that profiles compare, in order, with whether the rendering of their type is the same in both engines.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
MASKED = {"customer": ("c_custkey", "c_name"), "pages": ("page_id", "url"), "conversations": ("conv_id", "text"), "documents": ("doc_id", "text"), "orders": ("o_orderkey", "o_orderdate"), "events": ("event_id", "value")}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_inputs(select: str, **given: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in given.items()) + " " + select


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Decimals as doubles, which compare alike in both engines."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# Scans, filters, registration


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.scan({("main", t): table(spark, sf_dir, t) for t in I.TABLES})
    return found.select("schema_name", "name", "asset_type", "column_name", "data_type", F.col("ordinal").cast("int").alias("ordinal"), "nullable")


_TYPES = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"
_SCAN_SQL = f"SELECT 'main' AS schema_name, table_name AS name, 'table' AS asset_type, column_name, {_TYPES} AS data_type, CAST(ordinal_position AS INTEGER) AS ordinal, is_nullable = 'YES' AS nullable FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in I.TABLES) + ")"
add("a1_scan_schemas", _SCAN_SQL)(_scanned)


@add("a2_filter_schemas", with_inputs("SELECT * FROM observed WHERE schema_name IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND schema_name NOT IN ('HOUSEHOLD')", observed=I.OBSERVED))
def _a2(spark, sf_dir):
    return sources.filtered(I.derive(spark, sf_dir, I.OBSERVED), ["BUILDING", "MACHINERY", "HOUSEHOLD"], ["HOUSEHOLD"])


_SOURCES = "SELECT concat('src', o_orderkey) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'postgres' ELSE 'mysql' END AS engine, concat('h', o_custkey % 50) AS host, concat('d', o_custkey % 20) AS database, CASE WHEN o_orderkey % 2 = 0 THEN array['a', 'b', 'a'] ELSE array['b', 'a'] END AS include_schemas, o_orderdate AS requested_at FROM orders"


@add(
    "a4_register_sources",
    with_inputs(
        "SELECT name, engine, host, database, sha256('{\"engine\":\"' || engine || '\",\"host\":\"' || host || '\",\"database\":\"' || database || '\",\"include_schemas\":[\"a\",\"b\"],\"exclude_schemas\":[]}') AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY engine, host, database ORDER BY requested_at, name) AS turn FROM r WHERE (engine, host) NOT IN (SELECT ('postgres', concat('h', n_nationkey)) FROM nation)) WHERE turn = 1", r=_SOURCES
    ),
)
def _a4(spark, sf_dir):
    empty = F.array().cast("array<string>")
    requests = I.derive(spark, sf_dir, _SOURCES).withColumn("exclude_schemas", empty)
    known = I.derive(spark, sf_dir, "SELECT DISTINCT 'postgres' AS engine, concat('h', o_custkey % 50) AS host, concat('d', o_custkey % 20) AS database FROM orders WHERE o_custkey % 50 < 25")
    known = known.withColumn("include_schemas", F.array(F.lit("b"), F.lit("a"))).withColumn("exclude_schemas", empty)
    return sources.register(requests, known).select("name", "engine", "host", "database", "source_id")


_COLS = "SELECT concat('a', c_custkey) AS asset_id, concat('c', c_nationkey) AS column_name FROM customer"


@add("a5_load_state", with_inputs("SELECT a.asset_id, a.schema_name, a.name, c.column_name FROM a JOIN c ON a.asset_id = c.asset_id WHERE a.source_id = 's0'", a=I.ASSETS, c=_COLS))
def _a5(spark, sf_dir):
    found = sources.load_state(I.derive(spark, sf_dir, I.ASSETS), I.derive(spark, sf_dir, _COLS), "s0")
    return found.select("asset_id", "schema_name", "name", "column_name")


@add("b4_qualified_names", with_inputs("SELECT asset_id, concat_ws('.', source_id, schema_name, name) AS full_name FROM a", a=I.ASSETS))
def _b4(spark, sf_dir):
    return I.derive(spark, sf_dir, I.ASSETS).select("asset_id", sources.qualified_name("source_id", "schema_name", "name").alias("full_name"))


@add("b5_asset_page", with_inputs("SELECT asset_id, schema_name, name FROM a WHERE (schema_name, name, asset_id) > ('BUILDING', 'Customer#000000100', 'a100') ORDER BY schema_name, name, asset_id LIMIT 60", a=I.ASSETS))
def _b5(spark, sf_dir):
    return catalog.page(I.derive(spark, sf_dir, I.ASSETS), ("BUILDING", "Customer#000000100", "a100"), 60).select("asset_id", "schema_name", "name")


@add("b6_cursors", with_inputs("SELECT asset_id, replace(replace(base64(encode(concat_ws(chr(31), schema_name, name, asset_id))), '+', '-'), '/', '_') AS cursor FROM a", a=I.ASSETS))
def _b6(spark, sf_dir):
    rows = I.derive(spark, sf_dir, I.ASSETS).withColumn("cursor", catalog.encode_cursor(F.col("schema_name"), F.col("name"), F.col("asset_id")))
    return rows.filter(F.element_at(catalog.decode_cursor(F.col("cursor")), 3) == F.col("asset_id")).select("asset_id", "cursor")


@add("b3_profile_targets", with_inputs("SELECT schema_name, name, column_name, ordinal FROM s WHERE column_lifecycle = 'active'", s=I.STORED))
def _b3(spark, sf_dir):
    return catalog.targets(I.derive(spark, sf_dir, I.STORED)).select("schema_name", "name", "column_name", "ordinal")


@add("b7_lookup_assets", with_inputs("SELECT asset_id, name FROM a WHERE asset_id IN (SELECT concat('a', o_custkey) FROM orders WHERE o_orderstatus = 'P')", a=I.ASSETS))
def _b7(spark, sf_dir):
    keys = I.derive(spark, sf_dir, "SELECT concat('a', o_custkey) AS asset_id FROM orders WHERE o_orderstatus = 'P'")
    return catalog.lookup(I.derive(spark, sf_dir, I.ASSETS), keys).select("asset_id", "name")


_GATE = "SELECT concat('a', o_custkey + o_orderkey % 2 * 700) AS asset_id, o_orderkey % 6 AS profile_version, o_orderkey FROM orders"
_LATEST = "SELECT concat('a', c_custkey) AS asset_id, c_custkey % 6 AS version, c_custkey % 5 AS n_columns FROM customer WHERE c_custkey % 4 <> 0"
_REFUSAL = "CASE WHEN a.asset_id IS NULL THEN 'unknown_asset' WHEN a.lifecycle <> 'active' THEN 'inactive_asset'"


@add("b8_classifiable", with_inputs(f"SELECT r.asset_id, r.profile_version, {_REFUSAL} WHEN l.asset_id IS NULL THEN 'unprofiled_asset' WHEN l.version <> r.profile_version THEN 'stale_profile' WHEN l.n_columns = 0 THEN 'no_columns' END AS refusal FROM r LEFT JOIN a ON a.asset_id = r.asset_id LEFT JOIN l ON l.asset_id = r.asset_id", r=_GATE, a=I.ASSETS, l=_LATEST))
def _b8(spark, sf_dir):
    return catalog.classifiable(*(I.derive(spark, sf_dir, s) for s in (_GATE, I.ASSETS, _LATEST)))


@add("b9_profilable", with_inputs(f"SELECT r.asset_id, r.o_orderkey, {_REFUSAL} END AS refusal FROM r LEFT JOIN a ON a.asset_id = r.asset_id", r=_GATE, a=I.ASSETS))
def _b9(spark, sf_dir):
    return catalog.profilable(I.derive(spark, sf_dir, _GATE), I.derive(spark, sf_dir, I.ASSETS)).select("asset_id", "o_orderkey", "refusal")


# Profiles


_X = "CAST(x AS VARCHAR)"
_DIGITS = f"ltrim(split_part({_X}, '.', 2), '0')"
_MANTISSA = f"ltrim(split_part({_X}, 'e', 1), '-')"
#: A float as the JVM writes it: small and large ones with one digit before the point and an exponent.
_FLOAT = (
    f"CASE WHEN x IS NULL THEN 'null' WHEN x = 0 OR (abs(x) >= 0.001 AND abs(x) < 10000000) THEN {_X} ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN contains({_X}, 'e') "
    f"THEN {_MANTISSA} || CASE WHEN contains({_MANTISSA}, '.') THEN '' ELSE '.0' END || 'E' || CAST(split_part({_X}, 'e', 2) AS INTEGER) "
    f"ELSE {_DIGITS}[1] || '.' || CASE WHEN length({_DIGITS}) > 1 THEN {_DIGITS}[2:] ELSE '0' END || 'E-' || (length(split_part({_X}, '.', 2)) - length({_DIGITS}) + 1) END END"
)


def as_text(column: str, value: str) -> str:
    """A value of a column as text; vectors are written by their components."""
    return f"CASE WHEN {value} IS NOT NULL THEN '[' || array_to_string(list_transform({value}, lambda x: {_FLOAT}), ', ') || ']' END" if column == "embedding" else f"CAST({value} AS VARCHAR)"


def long_sql(name: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS ordinal, {as_text(c, c)} AS v FROM {name}" for i, c in enumerate(COLUMNS[name], 1))


def stats_sql(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {as_text(c, c)}) AS distinct_count, {as_text(c, f'min({c})')} AS low, {as_text(c, f'max({c})')} AS high FROM {name}"
        for i, c in enumerate(COLUMNS[name], 1)
    )


def counts_sql(name: str) -> str:
    return f"WITH s AS ({stats_sql(name)}) SELECT name, row_count, null_count, CAST({duck.ratio('null_count', 'row_count')} AS DOUBLE) AS null_ratio, distinct_count, CAST({duck.ratio('distinct_count', 'row_count')} AS DOUBLE) AS distinct_ratio FROM s"


_JSON_VALUE = """'{"masked":' || to_json(CASE WHEN low2 THEN '***' ELSE masked END) || ',"semantic_type":"' || CASE WHEN low2 THEN semantic ELSE kind END || '","length":' || CASE WHEN low2 OR length IS NULL THEN 'null' ELSE CAST(length AS VARCHAR) END || '}'"""
_JSON_COLUMN = """'{{"ordinal":' || ordinal || ',"name":"' || name || '","data_type":"' || {kinds} || '","null_count":' || null_count || ',"null_ratio":' || {null_ratio} || ',"distinct_count":' || distinct_count || ',"distinct_ratio":' || {distinct_ratio} || ',"min_value":' || coalesce(lo, 'null') || ',"max_value":' || coalesce(hi, 'null') || ',"top_values":[' || coalesce(tops, '') || '],"semantic_type":"' || semantic || '"}}'"""


def digest_sql(name: str, kinds: list[str]) -> str:
    """row_count and the digest of a table's profile, written as the canonical JSON of its document."""
    column = _JSON_COLUMN.format(kinds="[" + ", ".join(f"'{k}'" for k in kinds) + "][ordinal]", null_ratio=duck.ratio("null_count", "row_count"), distinct_ratio=duck.ratio("distinct_count", "row_count"))
    top = """'{"value":' || shown || ',"count":' || n || '}'"""
    return f"""{profile_parts(name, _JSON_VALUE, top, ',')}
SELECT max(row_count) AS row_count, sha256('{{"columns":[' || string_agg({column}, ',' ORDER BY ordinal) || '],"row_count":' || max(row_count) || '}}') AS digest FROM c LEFT JOIN g USING (ordinal)"""


def profile_sql(name: str) -> str:
    shown = "concat_ws('|', CASE WHEN low2 THEN '***' ELSE masked END, CASE WHEN low2 THEN semantic ELSE kind END, CASE WHEN low2 OR length IS NULL THEN '-' ELSE CAST(length AS VARCHAR) END)"
    return f"""{profile_parts(name, shown, "shown || '|' || n", ';')}
SELECT CAST(c.ordinal AS INTEGER) AS ordinal, name, row_count, null_count, CAST({duck.ratio('null_count', 'row_count')} AS DOUBLE) AS null_ratio, distinct_count, CAST({duck.ratio('distinct_count', 'row_count')} AS DOUBLE) AS distinct_ratio,
  lo AS min_value, hi AS max_value, coalesce(tops, '') AS top_values, semantic AS semantic_type FROM c LEFT JOIN g USING (ordinal)"""


def profile_parts(name: str, shown: str, top: str, between: str) -> str:
    """CTE text: c has a column's facts and g its masked extrema and top values, each shown and joined as told."""
    return f"""WITH s AS ({stats_sql(name)}),
f AS (SELECT ordinal, v, count(*) AS n FROM ({long_sql(name)}) WHERE v IS NOT NULL GROUP BY ordinal, v),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, v) AS place FROM f) WHERE place <= 5),
x AS (SELECT ordinal, place, n, v AS x FROM t UNION ALL SELECT ordinal, 100, 0, low FROM s WHERE low IS NOT NULL UNION ALL SELECT ordinal, 101, 0, high FROM s WHERE high IS NOT NULL),
{duck.mask_steps('SELECT * FROM x')},
votes AS (SELECT ordinal, count(DISTINCT CASE WHEN kind <> 'empty' THEN kind END) AS kinds, min(CASE WHEN kind <> 'empty' THEN kind END) AS one, count(*) AS samples FROM masks WHERE place < 100 GROUP BY ordinal),
c AS (SELECT s.*, CASE WHEN coalesce(kinds, 0) = 0 THEN 'unknown' WHEN kinds > 1 THEN 'mixed' ELSE one END AS semantic,
  distinct_count BETWEEN 1 AND 2 OR coalesce(samples, 0) BETWEEN 1 AND 2 AS low2 FROM s LEFT JOIN votes USING (ordinal)),
d AS (SELECT m.ordinal, m.place, m.n, {shown} AS shown FROM masks m JOIN c USING (ordinal)),
g AS (SELECT ordinal, string_agg({top}, '{between}' ORDER BY place) FILTER (WHERE place < 100) AS tops, max(shown) FILTER (WHERE place = 100) AS lo, max(shown) FILTER (WHERE place = 101) AS hi FROM d GROUP BY ordinal)"""


def _profiles() -> None:
    for name in COLUMNS:

        @add(f"c9_profile_{name}", profile_sql(name))
        def _profile(spark, sf_dir, name=name):
            return doubles(profile.flat(profile.profile(table(spark, sf_dir, name))), "null_ratio", "distinct_ratio")

        if name in ("events", "customer", "lineitem", "documents"):

            @add(f"c2_counts_{name}", counts_sql(name))
            def _counts(spark, sf_dir, name=name):
                return doubles(profile.raw_counts(table(spark, sf_dir, name)), "null_ratio", "distinct_ratio")


_profiles()


@add("c1_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in I.TABLES))
def _c1(spark, sf_dir):
    from functools import reduce

    return reduce(DataFrame.unionByName, (profile.row_count(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "row_count") for t in I.TABLES))


@add("c5_typed_extrema", f"SELECT name, low, high FROM ({stats_sql('orders')})")
def _c5(spark, sf_dir):
    return profile.statistics(table(spark, sf_dir, "orders")).select("name", "low", "high")


@add("c6_top_values", f"SELECT CAST(ordinal AS INTEGER) AS ordinal, v AS value, n AS count, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, v) AS place FROM (SELECT ordinal, v, count(*) AS n FROM ({long_sql('documents')}) WHERE v IS NOT NULL GROUP BY ordinal, v)) WHERE place <= 5")
def _c6(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(*COLUMNS["documents"])
    return profile.top_values(df, profile.frequencies(df), 5).select("ordinal", "value", "count", "place")


@add("c10_profile_estate", " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({profile_sql(t)})" for t in COLUMNS))
def _c10(spark, sf_dir):
    return doubles(profile.flat(profile.profile_estate({t: table(spark, sf_dir, t) for t in I.TABLES})), "null_ratio", "distinct_ratio")


@add("c11_profile_digest", digest_sql("customer", ["bigint", "string", "int", "double", "string"]))
def _c11(spark, sf_dir):
    document = profile.table_document(profile.profile(table(spark, sf_dir, "customer")))
    return document.select("row_count", profile.digest("row_count", "columns").alias("digest"))


_ROW = """'{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}'"""
_STATE = f"SELECT CAST(sum(CAST('0x' || substr(md5({_ROW}), 1, 15) AS BIGINT)) AS VARCHAR) FROM customer"


@add("c12_state_digest", f"SELECT (SELECT count(*) FROM customer) AS rows, ({_STATE}) AS digest, ({_STATE}) AS again")
def _c12(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    again = profile.state_digest(df.repartition(7, "c_nationkey"), ("c_nationkey",)).select(F.col("digest").alias("again"))
    return profile.state_digest(df, ("c_nationkey",)).join(F.broadcast(again))


# Masks


def _masks() -> None:
    for name, (key, column) in MASKED.items():
        sql = f"WITH {duck.mask_steps(f'SELECT {key}, CAST({column} AS VARCHAR) AS x FROM {name}')} SELECT {key}, masked, kind AS semantic_type, length FROM masks"

        @add(f"d12_mask_{name}_{column}", sql)
        def _mask(spark, sf_dir, name=name, key=key, column=column):
            df = table(spark, sf_dir, name)
            return df.select(key, text.mask(profile.rendered(column, df.schema[column].dataType)).alias("m")).select(key, "m.*")


_masks()


@add("d1_infer_types", f"SELECT page_id, {duck.semantic_type('url')} AS semantic_type FROM pages")
def _d1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.semantic_type(F.col("url")).alias("semantic_type"))


_CARDS = "SELECT o_orderkey, concat('4', lpad(CAST(o_orderkey * 7919 AS VARCHAR(20)), 15, '0')) AS v FROM orders"


@add("d2_luhn", with_inputs(f"SELECT o_orderkey, {duck.luhn('v')} AS ok FROM c", c=_CARDS))
def _d2(spark, sf_dir):
    return I.derive(spark, sf_dir, _CARDS).select("o_orderkey", F.call_function("luhn_check", F.col("v")).alias("ok"))


_TOKENS = "SELECT DISTINCT c_mktsegment AS token FROM customer UNION SELECT 'Brand#2'"


_LEAKS = " UNION ALL ".join(f"SELECT token, '{t}' AS table_name, count(*) AS rows FROM ({_TOKENS}) k JOIN {t} x ON contains(CAST(x AS VARCHAR), token) GROUP BY token" for t in I.TABLES)


@add("d13_leak_sweep", _LEAKS)
def _d13(spark, sf_dir):
    from functools import reduce

    tokens = I.derive(spark, sf_dir, _TOKENS)
    return reduce(DataFrame.unionByName, (quality.leaks(table(spark, sf_dir, t), tokens, t) for t in I.TABLES))


_BADLY = "CASE WHEN doc_id % 50 = 0 THEN text WHEN doc_id % 50 = 1 THEN substr(text, 1, 20) ELSE {masked} END"  # masks that keep what they should hide, among right ones


@add("d14_residue", f"WITH {duck.mask_steps('SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL')}, bad AS (SELECT doc_id, x, {_BADLY.replace('text', 'x').format(masked='masked')} AS masked FROM masks) SELECT doc_id FROM bad WHERE (masked = x AND {duck.alnums('x')} > 0) OR {duck.alnums('x')} - {duck.alnums('masked')} < least({duck.alnums('x')}, greatest({text.LEAST_HIDDEN}, ({duck.alnums('x')} + 1) // 2))")
def _d14(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", text.mask(F.col("text"))["masked"].alias("masked"))
    df = df.withColumn("masked", F.expr(_BADLY.format(masked="masked")))
    return df.filter((F.col("masked") == F.col("text")) & (text.alnums(F.col("text")) > 0) | ~text.conceals(F.col("text"), F.col("masked"))).select("doc_id")


# Catalog convergence

_OA = "oa AS (SELECT schema_name, name, min(asset_type) AS t FROM o GROUP BY ALL), sa AS (SELECT schema_name, name, min(asset_type) AS t, min(asset_lifecycle) AS l FROM s GROUP BY ALL)"
_E_ASSETS = f"{_OA} SELECT coalesce(oa.schema_name, sa.schema_name) AS schema_name, coalesce(oa.name, sa.name) AS name, CASE WHEN sa.name IS NULL THEN 'insert_asset' WHEN oa.name IS NULL THEN 'missing_asset' ELSE 'update_asset' END AS change, sa.t AS type_before, oa.t AS type_after, sa.l AS lifecycle_before FROM oa FULL JOIN sa ON oa.schema_name = sa.schema_name AND oa.name = sa.name WHERE sa.name IS NULL OR (oa.name IS NULL AND sa.l = 'active') OR (oa.name IS NOT NULL AND (oa.t <> sa.t OR sa.l <> 'active'))"
_FACTS = """CASE WHEN {0}.name IS NOT NULL THEN '{{"data_type":"' || {0}.data_type || '","ordinal":' || {0}.ordinal || ',"nullable":' || {0}.nullable || '}}' END"""
_E_COLUMNS = f"SELECT {_FACTS.format('s')} AS before, {_FACTS.format('o')} AS after, coalesce(o.schema_name, s.schema_name) AS schema_name, coalesce(o.name, s.name) AS name, coalesce(o.column_name, s.column_name) AS column_name, CASE WHEN s.name IS NULL THEN 'insert_column' WHEN o.name IS NULL THEN 'missing_column' ELSE 'update_column' END AS change, s.data_type AS data_type_before, o.data_type AS data_type_after FROM o FULL JOIN s ON o.schema_name = s.schema_name AND o.name = s.name AND o.column_name = s.column_name WHERE s.name IS NULL OR (o.name IS NULL AND s.column_lifecycle = 'active' AND s.asset_lifecycle = 'active') OR (o.name IS NOT NULL AND s.name IS NOT NULL AND (o.data_type <> s.data_type OR o.ordinal <> s.ordinal OR o.nullable IS DISTINCT FROM s.nullable OR s.column_lifecycle <> 'active'))"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return I.derive(spark, sf_dir, I.OBSERVED), I.derive(spark, sf_dir, I.STORED)


@add("e1_asset_changes", f"WITH o AS ({I.OBSERVED}), s AS ({I.STORED}), {_E_ASSETS}")
def _e1(spark, sf_dir):
    return catalog.asset_changes(*snapshots(spark, sf_dir))


@add("e4_column_changes", f"WITH o AS ({I.OBSERVED}), s AS ({I.STORED}) SELECT * EXCLUDE (before, after) FROM ({_E_COLUMNS})")
def _e4(spark, sf_dir):
    return catalog.column_changes(*snapshots(spark, sf_dir)).select("schema_name", "name", "column_name", "change", F.col("before.data_type").alias("data_type_before"), F.col("after.data_type").alias("data_type_after"))


_PLAN = f"""o AS ({I.OBSERVED}), s AS ({I.STORED}), a AS (WITH {_E_ASSETS}), c AS ({_E_COLUMNS}), plan AS (
SELECT schema_name, name, NULL AS column_name, change, '{{"asset_type":"' || type_before || '","lifecycle":"' || lifecycle_before || '"}}' AS before, '{{"asset_type":"' || type_after || '","lifecycle":"active"}}' AS after FROM a
UNION ALL SELECT schema_name, name, column_name, change, before, after FROM c)"""


@add("e7_plan", f"WITH {_PLAN} SELECT * FROM plan")
def _e7(spark, sf_dir):
    return catalog.plan(*snapshots(spark, sf_dir))


@add("e7_plan_order", f"WITH {_PLAN} SELECT row_number() OVER (ORDER BY schema_name, name, column_name NULLS FIRST, change) AS place, schema_name, name, column_name, change FROM plan")
def _e7b(spark, sf_dir):
    """The plan in its stable order; places are read off the order in which the rows come."""
    ordered = order.staged(catalog.stable_order(catalog.plan(*snapshots(spark, sf_dir))).withColumn("at", F.monotonically_increasing_id()), "plan")
    return order.running(ordered.withColumn("one", F.lit(1)), "at", "one").select(F.col("run_one").alias("place"), "schema_name", "name", "column_name", "change")


_IDS = "concat_ws('-', 'a', schema_name, name) AS asset_id, concat_ws('-', 'c', schema_name, name, column_name) AS column_id"


@add("e8_apply", f"WITH o AS ({I.OBSERVED}), s AS (SELECT *, {_IDS} FROM ({I.STORED})), oa AS (SELECT schema_name, name, min(asset_type) AS t FROM o GROUP BY ALL) SELECT coalesce(s.asset_id, sha256(concat_ws(chr(31), o.schema_name, o.name))) AS asset_id, coalesce(s.column_id, sha256(concat_ws(chr(31), o.schema_name, o.name, o.column_name))) AS column_id, CASE WHEN o.name IS NOT NULL THEN o.nullable ELSE s.nullable END AS nullable, coalesce(o.schema_name, s.schema_name) AS schema_name, coalesce(o.name, s.name) AS name, coalesce(o.column_name, s.column_name) AS column_name, coalesce(oa.t, s.asset_type) AS asset_type, coalesce(o.data_type, s.data_type) AS data_type, coalesce(o.ordinal, s.ordinal) AS ordinal, CASE WHEN oa.name IS NOT NULL THEN 'active' WHEN s.asset_lifecycle = 'active' THEN 'missing' ELSE s.asset_lifecycle END AS asset_lifecycle, CASE WHEN o.name IS NOT NULL THEN 'active' WHEN s.column_lifecycle = 'active' AND (oa.name IS NOT NULL OR s.asset_lifecycle = 'active') THEN 'missing' ELSE s.column_lifecycle END AS column_lifecycle FROM o FULL JOIN s ON o.schema_name = s.schema_name AND o.name = s.name AND o.column_name = s.column_name LEFT JOIN oa ON oa.schema_name = coalesce(o.schema_name, s.schema_name) AND oa.name = coalesce(o.name, s.name)")
def _e8(spark, sf_dir):
    observed, stored = snapshots(spark, sf_dir)
    stored = stored.withColumns({"asset_id": F.concat_ws("-", F.lit("a"), "schema_name", "name"), "column_id": F.concat_ws("-", F.lit("c"), "schema_name", "name", "column_name")})
    return catalog.apply(observed, stored)


@add("e9_change_events", f"WITH {_PLAN} SELECT kind || CASE split_part(change, '_', 1) WHEN 'insert' THEN '.discovered' WHEN 'update' THEN '.changed' ELSE '.missing' END AS action, kind AS entity_type, concat_ws('.', schema_name, name, column_name) AS entity_id, before, after FROM (SELECT *, CASE WHEN column_name IS NULL THEN 'asset' ELSE 'column' END AS kind FROM plan)")
def _e9(spark, sf_dir):
    return catalog.events(catalog.plan(*snapshots(spark, sf_dir)))


@add("e10_scan_summary", f"WITH {_PLAN}, n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT schema_name, name FROM o)) AS assets, (SELECT count(*) FROM o) AS columns, (SELECT count(*) FROM plan) AS changes) SELECT *, changes > 0 AS changed FROM n")
def _e10(spark, sf_dir):
    observed, stored = snapshots(spark, sf_dir)
    return catalog.summary(observed, catalog.plan(observed, stored))


@add("e10_unchanged_scan", f"WITH s AS ({I.STORED}), n AS (SELECT count(DISTINCT (schema_name, name)) AS assets, count(*) AS columns, count(*) FILTER (asset_lifecycle <> 'active' OR column_lifecycle <> 'active') AS others FROM (SELECT schema_name, name, 'active' AS asset_lifecycle, 'active' AS column_lifecycle FROM s)) SELECT assets, columns, others AS changes, others > 0 AS changed FROM n")
def _e10b(spark, sf_dir):
    """A scan that sees what is stored, once what was found missing is active: nothing changes."""
    stored = I.derive(spark, sf_dir, I.STORED)
    healed = catalog.apply(stored.drop("asset_lifecycle", "column_lifecycle"), stored)
    return catalog.summary(stored, catalog.plan(stored, healed))


# Versions


@add("f1_latest", with_inputs("SELECT asset_id, version, digest, created_at, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY version DESC) AS r FROM v) WHERE r = 1", v=I.VERSIONS))
def _f1(spark, sf_dir):
    return history.latest(I.derive(spark, sf_dir, I.VERSIONS))


@add("f2_record", with_inputs("SELECT c.asset_id, c.digest, coalesce(l.version, 0) + 1 AS version FROM c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY version DESC) AS r FROM v) WHERE r = 1) l ON c.asset_id = l.asset_id WHERE c.digest IS DISTINCT FROM l.digest", v=I.VERSIONS, c=I.COMPUTED))
def _f2(spark, sf_dir):
    return history.record(I.derive(spark, sf_dir, I.COMPUTED), I.derive(spark, sf_dir, I.VERSIONS)).select("asset_id", "digest", F.col("version").cast("bigint").alias("version"))


@add("f3_all_versions", with_inputs("SELECT asset_id, version, digest FROM v", v=I.VERSIONS))
def _f3(spark, sf_dir):
    return history.in_order(I.derive(spark, sf_dir, I.VERSIONS)).select("asset_id", "version", "digest")


@add("f4_at_version", with_inputs("SELECT asset_id, version, digest FROM v WHERE version = 3", v=I.VERSIONS))
def _f4(spark, sf_dir):
    wanted = I.derive(spark, sf_dir, "SELECT concat('a', c_custkey) AS asset_id, 3 AS version FROM customer")
    return history.at_version(I.derive(spark, sf_dir, I.VERSIONS), wanted).select("asset_id", "version", "digest")


@add("f5_asset_states", with_inputs("SELECT a.asset_id, lifecycle, coalesce(max(version), 0) AS latest_version FROM a LEFT JOIN v ON a.asset_id = v.asset_id GROUP BY a.asset_id, lifecycle", a=I.ASSETS, v=I.VERSIONS))
def _f5(spark, sf_dir):
    return history.asset_states(I.derive(spark, sf_dir, I.ASSETS), I.derive(spark, sf_dir, I.VERSIONS))


@add("f6_as_of", with_inputs("SELECT asset_id, max(version) AS version FROM v WHERE created_at <= TIMESTAMP '1997-06-01 00:00:00' GROUP BY asset_id", v=I.VERSIONS))
def _f6(spark, sf_dir):
    return history.as_of(I.derive(spark, sf_dir, I.VERSIONS), "1997-06-01 00:00:00").select("asset_id", "version")


@add("f6_as_of_each", with_inputs("SELECT r.request_id, (SELECT max(version) FROM v WHERE v.asset_id = r.asset_id AND v.created_at <= r.at) AS version FROM r", v=I.VERSIONS, r="SELECT e.event_id AS request_id, concat('a', e.event_id % 1600) AS asset_id, o.o_orderdate AS at FROM events e JOIN orders o ON o.o_orderkey = e.event_id"))
def _f6b(spark, sf_dir):
    asked = I.derive(spark, sf_dir, "SELECT e.event_id AS request_id, concat('a', e.event_id % 1600) AS asset_id, o.o_orderdate AS at FROM events e JOIN orders o ON o.o_orderkey = e.event_id")
    return history.as_of_each(asked, I.derive(spark, sf_dir, I.VERSIONS)).select("request_id", "version")


def queries() -> dict[str, Query]:
    from lakewarden.plans import estate_depth, estate_more

    return {**QUERIES, **estate_more.QUERIES_MORE, **estate_depth.QUERIES_DEPTH}


def oracle_sql() -> dict[str, str]:
    from lakewarden.plans import estate_depth, estate_more

    return {**SQL, **estate_more.SQL_MORE, **estate_depth.SQL_DEPTH}
