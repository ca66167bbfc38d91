"""The checking SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

from auditloom.functions import numbers
from checks.fixtures import FIXTURES, TABLES

ORACLES: dict[str, str] = {}


def with_fixture(fixture_name: str, body: str, *more: str) -> str:
    parts = [f"fx AS ({FIXTURES[fixture_name]})", *more]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def check(name: str, fixture_name: str, body: str, *more: str) -> None:
    ORACLES[name] = with_fixture(fixture_name, body, *more)


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def rounded(expression: str, digits: int) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits})"


def r6(expression: str) -> str:
    return rounded(expression, 6)


def r5(expression: str) -> str:
    return rounded(expression, 5)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


PLAIN = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
EVALUATOR = [*PLAIN, "?"]
RICH = [
    *PLAIN, "?", "na", "none", " ", "--", "..", "missing", "Missing", "unknown", "Unknown",
    "UNKNOWN", "undefined", "Undefined",
]
DIRTY_TEXT = ["priority_raw", "status_raw", "code_raw"]
DIRTY = ["o_orderkey", *DIRTY_TEXT, "price_raw", "days_raw"]


def cleaned(words: list[str]) -> str:
    """fx_dirty with the words read as null, as a CTE named ``cl``."""
    text = ", ".join(f"CASE WHEN {c} IN ({quoted(words)}) THEN NULL ELSE {c} END AS {c}" for c in DIRTY_TEXT)
    return f"cl AS (SELECT o_orderkey, {text}, price_raw, days_raw FROM fx)"


# ------------------------------------------------------------------ sources, nulls

ORACLES["s1_load_preview"] = """
SELECT (SELECT count(*) FROM orders) AS n_rows, CAST(6 AS BIGINT) AS n_columns, *
FROM orders ORDER BY o_orderkey LIMIT 3"""

for vocabulary, words in (("rich", RICH), ("evaluator", EVALUATOR), ("plain", PLAIN)):
    check(
        f"s2_null_tokens_{vocabulary}", "fx_dirty",
        "SELECT o_orderkey, priority_raw, status_raw, code_raw, round(price_raw, 6) AS price_raw, days_raw FROM cl",
        cleaned(words),
    )

ORACLES["s3_infer_types"] = """
SELECT o_orderkey AS order_txt,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cust_txt,
       CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice, 6) END AS price_txt,
       CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS priority_txt
FROM orders"""

NUM, CAT, TMP, OTH = "numeric", "categorical", "temporal", "other"
SCHEMAS = {
    "region": [("r_regionkey", NUM), ("r_name", CAT)],
    "nation": [("n_nationkey", NUM), ("n_name", CAT), ("n_regionkey", NUM)],
    "customer": [("c_custkey", NUM), ("c_name", CAT), ("c_nationkey", NUM), ("c_acctbal", NUM), ("c_mktsegment", CAT)],
    "supplier": [("s_suppkey", NUM), ("s_name", CAT), ("s_nationkey", NUM), ("s_acctbal", NUM)],
    "part": [("p_partkey", NUM), ("p_name", CAT), ("p_brand", CAT), ("p_type", CAT), ("p_size", NUM), ("p_retailprice", NUM)],
    "orders": [("o_orderkey", NUM), ("o_custkey", NUM), ("o_orderstatus", CAT), ("o_totalprice", NUM), ("o_orderdate", TMP), ("o_orderpriority", CAT)],
    "lineitem": [
        ("l_orderkey", NUM), ("l_partkey", NUM), ("l_suppkey", NUM), ("l_linenumber", NUM), ("l_quantity", NUM),
        ("l_extendedprice", NUM), ("l_discount", NUM), ("l_tax", NUM), ("l_returnflag", CAT), ("l_linestatus", CAT), ("l_shipdate", TMP),
    ],
    "events": [("event_id", NUM), ("ts", TMP), ("user_id", NUM), ("event_type", CAT), ("value", NUM), ("props", CAT)],
    "documents": [("doc_id", NUM), ("text", CAT), ("lang", CAT), ("source", CAT), ("n_chars", NUM)],
    "embeddings": [("vec_id", NUM), ("embedding", OTH), ("label", NUM)],
    "pages": [("page_id", NUM), ("url", CAT), ("html", CAT)],
    "benchmark": [("item_id", NUM), ("text", CAT)],
    "labels": [("doc_id", NUM), ("quality", NUM), ("toxic", NUM)],
    "conversations": [("conv_id", NUM), ("turn", NUM), ("role", CAT), ("text", CAT)],
}

ORACLES["s4_columns"] = union(
    f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS kind, (SELECT count(*) FROM {t}) AS n_rows"
    for t in TABLES
    for i, (c, kind) in enumerate(SCHEMAS[t])
)

HASH_ORDER = "md5(concat_ws('-', {key}, '42'))"


def under(key: str, target: str, columns: str) -> str:
    return f"""
SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {HASH_ORDER.format(key=key)}) AS place,
         (SELECT min(c) FROM (SELECT count(*) AS c FROM fx GROUP BY {target})) AS quota
  FROM fx) WHERE place <= quota"""


DOC_COLUMNS = "doc_id, lang, source, n_chars, toxic, quality"
check("s5_write_mitigated", "fx_docs", under("doc_id", "quality", DOC_COLUMNS))

check(
    "s6_write_findings", "fx_docs",
    """
SELECT 'class_balance' AS operator, concat('label=', quality) AS subject, metric, value_double, value_string,
       'run-1' AS run_id, 'imbalance' AS stage
FROM (
  SELECT quality, 'n' AS metric, CAST(n AS DOUBLE) AS value_double, CAST(NULL AS VARCHAR) AS value_string FROM g
  UNION ALL SELECT quality, 'share', round(n / (SELECT sum(n) FROM g), 6), NULL FROM g
  UNION ALL SELECT quality, 'ratio', round((SELECT max(n) / min(n) FROM g), 6), NULL FROM g
  UNION ALL SELECT quality, 'status', NULL, (SELECT CASE WHEN max(n) < 1.5 * min(n) THEN 'BALANCED'
      WHEN max(n) < 3 * min(n) THEN 'SLIGHTLY_IMBALANCED' WHEN max(n) < 10 * min(n) THEN 'IMBALANCED'
      ELSE 'HIGHLY_IMBALANCED' END FROM g) FROM g)""",
    "g AS (SELECT quality, count(*) AS n FROM fx GROUP BY quality)",
)

# ------------------------------------------------------- projections and predicates

check(
    "q5_blank_to_null", "fx_dirty",
    "SELECT o_orderkey, " + ", ".join(f"CASE WHEN regexp_full_match({c}, '\\s*') THEN NULL ELSE {c} END AS {c}" for c in DIRTY_TEXT)
    + ", round(price_raw, 6) AS price_raw, days_raw FROM fx",
)
check(
    "q16a_complete_cases", "fx_dirty",
    "SELECT * REPLACE (round(price_raw, 6) AS price_raw) FROM fx WHERE NOT (status_raw IS NULL OR price_raw IS NULL)",
)
check("q16b_drop_null_target", "fx_dirty", "SELECT * REPLACE (round(price_raw, 6) AS price_raw) FROM fx WHERE status_raw IS NOT NULL")
check(
    "g1_combine_columns", "fx_dirty",
    "SELECT priority_raw || '_' || coalesce(status_raw, 'nan') AS combined_group, count(*) AS n FROM fx GROUP BY 1",
)


def proportions(columns: list[str], value="value") -> str:
    return union(
        f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS {value}, count(*) AS n, {r6('100.0 * count(*) / (SELECT count(*) FROM fx)')} AS pct FROM fx WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


check("g2_exclude_target", "fx_docs", proportions(["lang", "source"]))

# --------------------------------------------------------------------------- profile

ORACLES["p1_basic_info"] = union(
    f"SELECT 'orders' AS table_name, {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS kind, (SELECT count(*) FROM orders) AS n_rows, CAST(6 AS BIGINT) AS n_columns, CAST(5 AS BIGINT) AS n_features"
    for i, (c, kind) in enumerate(SCHEMAS["orders"])
)


def vc(columns: list[str]) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM fx) AS pct FROM fx WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


def vc_cte(columns: list[str]) -> str:
    return f"vc AS ({vc(columns)})"


check(
    "pvc_value_counts", "fx_dirty", f"SELECT \"column\", value, n, {r6('pct')} AS pct FROM vc",
    vc_cte(DIRTY),
)

NUM_COLUMNS = ["l_orderkey", "rare", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "qty_null", "const_col"]
check(
    "p2_column_preview", "fx_num",
    union(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_null, {r5(f'min({c})')} AS min, {r5(f'max({c})')} AS max, {r5(f'avg({c})')} AS mean FROM fx"
        for c in NUM_COLUMNS
    ),
)
ORDER_COLUMNS = ["o_orderkey", "region", "nation", "segment", "priority", "o_totalprice", "c_acctbal", "o_orderstatus", "big"]
ORDER_TEXT = ["region", "nation", "segment", "priority", "o_orderstatus"]
check(
    "p2_sample_values", "fx_orders",
    union(
        f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT {c} AS v FROM fx) QUALIFY rank <= 5"
        for c in ORDER_COLUMNS
    ),
)
TOP = "SELECT \"column\", CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS rank, value, n, {pct} AS pct FROM vc QUALIFY rank <= {k}"
check("p2_top_text_values", "fx_orders", TOP.format(pct=r6("pct"), k=3), vc_cte(ORDER_TEXT))
check(
    "p3_sensitive_column", "fx_docs",
    f"SELECT value, n, {r6('pct')} AS pct, {r6('(SELECT max(round(pct, 2)) / nullif(min(round(pct, 2)), 0) FROM vc)')} AS imbalance_ratio FROM vc ORDER BY n DESC, value LIMIT 20",
    vc_cte(["source"]),
)
check(
    "p3_sensitive_column_numeric", "fx_orders",
    f"SELECT {r6('min(o_totalprice)')} AS min, {r6('max(o_totalprice)')} AS max, {r6('avg(o_totalprice)')} AS mean, {r6('stddev_samp(o_totalprice)')} AS std FROM fx",
)
MANY = ["o_orderkey", "o_totalprice", "c_acctbal"]
check(
    "p4_column_catalog", "fx_orders",
    union(
        [
            f"SELECT t.\"column\", d.n_unique, CAST(0 AS BIGINT) AS n_null, rank, value, n, pct FROM ({TOP.format(pct=r6('pct'), k=5)}) t JOIN d ON t.\"column\" = d.\"column\"",
            *[f"SELECT '{c}', count(DISTINCT {c}), CAST(0 AS BIGINT), NULL, NULL, NULL, NULL FROM fx" for c in MANY],
        ]
    ),
    vc_cte([*ORDER_TEXT, "big"]),
    "d AS (SELECT \"column\", count(*) AS n_unique FROM vc GROUP BY 1)",
)
check(
    "p4b_column_summary", "fx_docs",
    """SELECT "column", (SELECT count(*) FROM vc v WHERE v."column" = t."column") AS n_unique,
       string_agg(printf('%s(%.2f%%)', value, pct), ', ' ORDER BY rank) AS summary
FROM (""" + TOP.format(pct="pct", k=3) + ") t GROUP BY \"column\"\nUNION ALL\n" + union(
        f"SELECT '{c}', count(DISTINCT {c}), (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM fx ORDER BY v LIMIT 5)) FROM fx"
        for c in ("doc_id", "n_chars")
    ),
    vc_cte(["lang", "source", "toxic", "quality"]),
)


def numeric_row(c: str, r=r6) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median, "
        f"{r(f'skewness({c})')} AS skew, {r(f'kurtosis({c})')} AS kurt, count(DISTINCT {c}) AS n_unique FROM fx"
    )


def constant_row(c: str, v: int) -> str:
    return (
        f"SELECT '{c}', count(*), {v}.0, 0.0, {v}.0, {v}.0, {v}.0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(1 AS BIGINT) FROM fx"
    )


check("p5_numeric_stats", "fx_num", union([*[numeric_row(c, r5) for c in NUM_COLUMNS if c not in ("l_orderkey", "const_col")], constant_row("const_col", 7)]))
check("p5_numeric_stats_events", "fx_events", union(numeric_row(c) for c in ("event_id", "value", "user_id")))
check(
    "p6_categorical_stats", "fx_text",
    f"SELECT \"column\", count(*) AS n_unique, {r6('-sum(p * ln(p))')} AS entropy FROM (SELECT \"column\", n / sum(n) OVER (PARTITION BY \"column\") AS p FROM vc) GROUP BY 1",
    vc_cte(["c_name", "c_mktsegment", "skewed"]),
)


def profile_row(c: str, numeric: bool) -> str:
    shared = (
        f"SELECT '{c}' AS \"column\", '{'Numeric' if numeric else 'Categorical'}' AS type, count(*) - count({c}) AS n_missing, "
        f"{r6(f'(count(*) - count({c})) / count(*)')} AS p_missing, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = count({c}) AS is_unique, "
    )
    if numeric:
        return shared + (
            f"{r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, "
            f"count(*) FILTER ({c} = 0) AS n_zeros, CAST(NULL AS BIGINT) AS n_categories FROM fx"
        )
    single = f"(SELECT count(*) FROM (SELECT {c} FROM fx WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1))"
    return shared + f"NULL AS mean, NULL AS std, NULL AS min, NULL AS max, NULL AS n_zeros, {single} AS n_categories FROM fx"


check("p7_auto_profile", "fx_dirty", union(profile_row(c, c not in DIRTY_TEXT) for c in DIRTY))

TABLE_PROFILE = """SELECT CAST({k} AS BIGINT) AS n_variables, n AS n_observations, CAST(m AS BIGINT) AS missing_cells,
  {pm} AS missing_cells_pct, n - d AS duplicate_rows, {pd} AS duplicate_rows_pct
FROM (SELECT count(*) AS n, sum({nulls}) AS m, (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)) AS d FROM fx)"""


def table_profile(columns: list[str]) -> str:
    nulls = " + ".join(f"({c} IS NULL)::INT" for c in columns)
    return TABLE_PROFILE.format(k=len(columns), nulls=nulls, pm=r6(f"100.0 * m / (n * {len(columns)})"), pd=r6("100.0 * (n - d) / n"))


def first_values(source: str, columns: list[str], k: int) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL) QUALIFY rank <= {k}"
        for c in columns
    )


check("p7_table_profile", "fx_dirty", table_profile(DIRTY))
check("p7_table_profile_repeats", "fx_dup", table_profile(["l_returnflag", "l_linestatus", "l_quantity"]))
check("p4_first_values", "fx_docs", first_values("fx", ["doc_id", "lang", "source", "n_chars", "toxic", "quality"], 10))
ORACLES["p2_first_texts"] = union([first_values("documents", ["text"], 6), first_values("pages", ["url", "html"], 6)])


def table_counts(name: str, columns: list[str]) -> str:
    return vc(columns).replace("FROM fx", f"FROM {name}")


DOC_TEXTS, PAGE_TEXTS = table_counts("documents", ["text", "lang", "source"]), table_counts("pages", ["url", "html"])
ORACLES["p2_top_texts"] = union(f"SELECT * FROM ({TOP.format(pct=r6('pct'), k=4).replace('FROM vc', f'FROM ({t})')})" for t in (DOC_TEXTS, PAGE_TEXTS))
ORACLES["p6_texts"] = union(
    f"SELECT \"column\", count(*) AS n_unique, {r6('-sum(p * ln(p))')} AS entropy FROM (SELECT \"column\", n / sum(n) OVER (PARTITION BY \"column\") AS p FROM ({t})) GROUP BY 1"
    for t in (DOC_TEXTS, PAGE_TEXTS)
)


def spearman_pair(a: str, b: str) -> str:
    complete = f"SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM fx WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r{s}" for s in ("a", "b")
    )
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6('corr(ra, rb)')} AS value FROM (SELECT {ranks} FROM ({complete}))"


def name_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


NUM_COLUMNS = ["l_orderkey", "rare", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "qty_null", "const_col"]
check("p8a_spearman", "fx_num", union(spearman_pair(a, b) for a, b in name_pairs(NUM_COLUMNS)))
FEW = "(SELECT *, CASE WHEN days_raw < 50 THEN o_orderkey % 7 END AS few FROM fx)"
check(
    "p8a_spearman_nulls", "fx_dirty",
    union(spearman_pair(a, b).replace("FROM fx ", f"FROM {FEW} ") for a, b in name_pairs(["o_orderkey", "price_raw", "days_raw", "few"])),
)


def cramer_pair(a: str, b: str) -> str:
    """From the full grid of expected counts, empty cells included."""
    return f"""
SELECT '{a}' AS column_a, '{b}' AS column_b,
       {r6('sqrt(sum((o - e) * (o - e) / e) / (SELECT count(*) FROM fx) / (least(count(DISTINCT va), count(DISTINCT vb)) - 1))')} AS value
FROM (SELECT x.{a} AS va, y.{b} AS vb, x.n * y.n / (SELECT count(*) FROM fx) AS e, coalesce(z.n, 0) AS o
      FROM (SELECT {a}, count(*) AS n FROM fx GROUP BY 1) x CROSS JOIN (SELECT {b}, count(*) AS n FROM fx GROUP BY 1) y
      LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM fx GROUP BY 1, 2) z ON z.{a} = x.{a} AND z.{b} = y.{b})"""


check("p8b_cramers_v", "fx_orders", union(cramer_pair(a, b) for a, b in name_pairs(["region", "nation", "segment", "priority", "o_orderstatus"])))

# --------------------------------------------------------------------------- quality


def missing_rows(source: str, where: str = "") -> str:
    return f"SELECT * FROM ({union(f'''SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, {r6(f'100.0 * (count(*) - count({c})) / count(*)')} AS pct_missing FROM {source}''' for c in DIRTY)}) {where}"


check("q1_missing_by_column", "fx_dirty", missing_rows("fx"))
check("q1_missing_only", "fx_dirty", missing_rows("cl", "WHERE n_missing > 0"), cleaned(EVALUATOR))
NULLS = " + ".join(f"({c} IS NULL)::INT" for c in DIRTY)
check(
    "q2_missing_overall", "fx_dirty",
    f"SELECT count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS n_cells_missing, {r6('100.0 * sum(k) / (count(*) * 6)')} AS pct_missing, count(*) FILTER (k = 0) AS n_complete, count(*) FILTER (k > 0) AS n_incomplete FROM (SELECT {NULLS} AS k FROM cl)",
    cleaned(RICH),
)


def pattern(source: str, columns: list[str]) -> str:
    mask = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in columns)
    return f"SELECT {mask} AS pattern, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10"


check("q3_missing_pattern", "fx_dirty", pattern("cl", DIRTY), cleaned(RICH))
check("q3_missing_pattern_dup", "fx_dup", pattern("fx", ["l_returnflag", "l_linestatus", "l_quantity"]))
TOKENS = union(
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS token FROM fx WHERE {c} IN ({quoted(w for w in RICH if w)})" for c in DIRTY_TEXT
)
check("q4_na_tokens_found", "fx_dirty", TOKENS)

# one point and one dash may be taken away, wherever they are
DIGITS = "(length({c}) - length(replace({c}, '.', '')) <= 1 AND length({c}) - length(replace({c}, '-', '')) <= 1 AND regexp_full_match(replace(replace({c}, '.', ''), '-', ''), '[0-9]+'))"


def type_row(c: str, source: str = "fx") -> str:
    test = DIGITS.format(c=c)
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({test}) AS n_numeric, count(*) FILTER (NOT {test}) AS n_string, "
        f"count(*) FILTER ({test}) > 0 AND count(*) FILTER (NOT {test}) > 0 AS mixed FROM {source}"
    )


check("q6_type_inconsistency", "fx_dirty", union(type_row(c) for c in DIRTY_TEXT))
check(
    "q6_mixed_samples", "fx_dirty",
    f"SELECT 'code_raw' AS \"column\", CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank, v AS value FROM (SELECT DISTINCT code_raw AS v FROM fx WHERE NOT {DIGITS.format(c='code_raw')}) QUALIFY rank <= 5",
)


def single_chars(source: str, columns: list[str] = DIRTY_TEXT) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", 'Single character ''' || {c} || '''' AS pattern, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM fx) AS pct FROM {source} WHERE length(trim({c})) = 1 GROUP BY {c} HAVING count(*) > 1"
        for c in columns
    )


def sentinels(columns: list[str]) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", 'Suspicious numeric value {s}' AS pattern, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM fx) AS pct FROM fx WHERE {c} = {s} HAVING count(*) > 0"
        for c in columns
        for s in (-999, -99, -9, 999, 9999, 99999, -1)
    )


DIRTY_NUMBERS = ["o_orderkey", "price_raw", "days_raw"]
check("q7a_single_char_values", "fx_dirty", f"SELECT \"column\", pattern, n, {r6('pct')} AS pct FROM ({single_chars('fx')})")
check(
    "q7b_blank_strings", "fx_dirty",
    f"SELECT * FROM ({union(f'''SELECT '{c}' AS \"column\", 'Whitespace/empty strings' AS pattern, count(*) FILTER (trim({c}) = '') AS n, {r6(f'''100.0 * count(*) FILTER (trim({c}) = '') / count(*)''')} AS pct FROM fx''' for c in DIRTY_TEXT)}) WHERE n > 0",
)
check("q7c_sentinel_numbers", "fx_dirty", f"SELECT \"column\", pattern, n, {r6('pct')} AS pct FROM ({sentinels(DIRTY_NUMBERS)})")

BLANKED = "bl AS (SELECT o_orderkey, " + ", ".join(f"CASE WHEN trim({c}) = '' THEN NULL ELSE {c} END AS {c}" for c in DIRTY_TEXT) + ", price_raw, days_raw FROM cl)"
ISSUES = f"""
SELECT m."column", n_missing, {r6('pct_missing')} AS pct_missing, coalesce(mixed, false) AS mixed, coalesce(k, 0) AS n_patterns,
  concat_ws(' | ',
    CASE WHEN mixed THEN printf('Mixed types: %d numeric, %d string', n_numeric, n_string) END,
    patterns,
    CASE WHEN n_missing > 0 THEN printf('Missing values: %d (%.2f%%)', n_missing, pct_missing)
         || CASE WHEN tokens IS NULL THEN '' ELSE ' - Detected as NA: [' || tokens || ']' END END) AS issues
FROM ({missing_rows('bl').replace('round(CAST(', '(CAST(').replace(' AS DOUBLE), 6)', ' AS DOUBLE))')}) m
LEFT JOIN ({union(type_row(c, 'bl') for c in DIRTY_TEXT)}) t ON t."column" = m."column"
LEFT JOIN (SELECT "column", count(*) AS k, string_agg(printf('%s: %d occurrences (%.2f%%)', pattern, n, pct), ' | ' ORDER BY pattern) AS patterns
           FROM ({single_chars('bl')} UNION ALL {sentinels(DIRTY_NUMBERS)}) GROUP BY 1) p ON p."column" = m."column"
LEFT JOIN (SELECT "column", string_agg(token, ', ' ORDER BY token) AS tokens FROM ({TOKENS}) GROUP BY 1) f ON f."column" = m."column"
WHERE n_missing > 0 OR coalesce(mixed, false) OR k > 0"""
check("q8_column_issue_report", "fx_dirty", ISSUES, cleaned(RICH), BLANKED)

DUPLICATES = "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS n_duplicates, {pct} AS pct FROM fx"
DUP_PCT = "100.0 * (count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_quantity))) / count(*)"
check("q9_duplicates", "fx_dup", DUPLICATES.format(pct=r6(DUP_PCT)))
check("q9_repeated_rows", "fx_dup", "SELECT l_returnflag, l_linestatus, round(l_quantity, 6) AS l_quantity, count(*) AS n_copies FROM fx GROUP BY ALL HAVING count(*) > 1")
ORACLES["q9_duplicates_lineitem"] = f"""
SELECT n AS n_rows, n - d AS n_duplicates, {r6('100.0 * (n - d) / n')} AS pct
FROM (SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS d)"""
check(
    "q10_constant_columns", "fx_num",
    "SELECT * FROM (" + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM fx" for c in NUM_COLUMNS) + ") WHERE n_unique = 1",
)
check(
    "q11_high_cardinality", "fx_text",
    "SELECT * FROM (" + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM fx" for c in ("c_name", "c_mktsegment", "skewed")) + ") WHERE 2 * n_unique > (SELECT count(*) FROM fx)",
)
check(
    "q12_iqr_outliers", "fx_num",
    "SELECT * FROM (" + union(
        f"""SELECT '{c}' AS "column", {r6('any_value(q1)')} AS q1, {r6('any_value(q3)')} AS q3,
        count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
        {r6('100.0 * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*)')} AS pct
        FROM (SELECT CAST({c} AS DOUBLE) AS v, quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER () AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER () AS q3 FROM fx)"""
        for c in NUM_COLUMNS
    ) + ") WHERE n_outliers > 0",
)
check(
    "q13_missing_recommendation", "fx_dirty",
    f"""SELECT CASE WHEN max(pct_missing) = 0 THEN 'No missing data detected. Dataset is complete.'
  WHEN max(pct_missing) > 50 THEN 'CRITICAL: Some columns have >50% missing data. Consider removing these columns.'
  WHEN max(pct_missing) > 20 THEN 'WARNING: Significant missing data detected. Use imputation or consider impact on model.'
  ELSE 'Minor missing data detected. Simple imputation should suffice.' END AS recommendation FROM ({missing_rows('cl')})""",
    cleaned(RICH),
)
check(
    "q14_quality_flag", "fx_num",
    """SELECT CASE WHEN dup + const = 0 THEN 'GOOD' ELSE 'NEEDS_ATTENTION' END AS flag, CAST(dup + const AS BIGINT) AS n_issues
FROM (SELECT ((SELECT count(*) FROM fx) > (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)))::INT AS dup,
             (SELECT """ + " OR ".join(f"count(DISTINCT {c}) = 1" for c in NUM_COLUMNS) + " FROM fx)::INT AS const)",
)


def score(fixture_name: str, name: str, missing: str, dup: str, target: str) -> None:
    check(
        name, fixture_name,
        f"""
SELECT {r6('s')} AS score, CASE WHEN s >= 90 THEN 'A - EXCELLENT' WHEN s >= 80 THEN 'B - GOOD' WHEN s >= 70 THEN 'C - ACCEPTABLE'
       WHEN s >= 60 THEN 'D - POOR' ELSE 'F - UNACCEPTABLE' END AS grade, s >= 70 AS ready,
       {r6('pm')} AS penalty_missing, {r6('pd')} AS penalty_dup, {r6('pi')} AS penalty_imbalance, {r6('ps')} AS penalty_size
FROM (SELECT *, greatest(0, 100 - pm - pd - pi - ps) AS s FROM (
  SELECT least(0.5 * ({missing}), 30) AS pm, least(0.3 * ({dup}), 15) AS pd,
    CASE WHEN ratio > 3 THEN least(2 * (ratio - 3), 20) ELSE 0 END AS pi,
    CASE WHEN (SELECT count(*) FROM fx) < 1000 THEN 10 ELSE 0 END AS ps
  FROM (SELECT max(n) / min(n) AS ratio FROM (SELECT count(*) AS n FROM fx GROUP BY {target}))))""",
    )


DISTINCT_PCT = "SELECT 100.0 * ((SELECT count(*) FROM fx) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx))) / (SELECT count(*) FROM fx)"
score("fx_docs", "q15_quality_score", "0.0", DISTINCT_PCT, "quality")
score("fx_dup", "q15_quality_score_dup", "SELECT 100.0 * (2 * count(*) - count(l_linestatus) - count(l_quantity)) / (3 * count(*)) FROM fx", DISTINCT_PCT, "l_returnflag")

# --------------------------------------------------------------------------- balance


def balance_rows(name: str, fixture_name: str, target: str) -> None:
    check(
        name, fixture_name,
        f"""
SELECT label, n, {r6('n / t')} AS share, {r6('ratio')} AS ratio, s[1] AS status, s[2] AS advice
FROM (SELECT *, CASE WHEN ratio < 1.5 THEN ['BALANCED', 'Classes are well balanced.']
  WHEN ratio < 3 THEN ['SLIGHTLY_IMBALANCED', 'Minor imbalance. Consider stratified sampling.']
  WHEN ratio < 10 THEN ['IMBALANCED', 'Significant imbalance. Use SMOTE, class weights, or oversampling.']
  ELSE ['HIGHLY_IMBALANCED', 'CRITICAL: Severe class imbalance. Use advanced techniques (ADASYN, focal loss).'] END AS s
  FROM (SELECT CAST({target} AS VARCHAR) AS label, count(*) AS n, sum(count(*)) OVER () AS t,
               max(count(*)) OVER () / min(count(*)) OVER () AS ratio FROM fx GROUP BY {target}))""",
    )


balance_rows("b1_class_balance", "fx_docs", "quality")
balance_rows("b1_class_balance_multiclass", "fx_orders", "o_orderstatus")
DOMINANT = """
SELECT "column", rank, value, round(pct, 2) AS pct
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank,
             max(round(pct, 2)) OVER (PARTITION BY "column") AS lead FROM vc)
WHERE rank <= 5 AND lead > 65"""
check("b2_dominant_values", "fx_text", DOMINANT, vc_cte(["c_name", "c_mktsegment", "skewed"]))
ORACLES["b2_dominant_texts"] = union(
    DOMINANT.replace("FROM vc", f"FROM ({t})") for t in (DOC_TEXTS, table_counts("conversations", ["role", "text"]))
)
check("b2_dominant_sensitive", "fx_docs", DOMINANT, vc_cte(["lang", "source"]))

# --------------------------------------------------------------------------- catalog


def facts(table: str, column: str, extra: str = "") -> str:
    return f"SELECT '{table}' AS table_name, '{column}' AS \"column\"{extra}, count(*) AS n_rows, count(*) - count({column}) AS n_null, count(DISTINCT {column}) AS n_unique FROM {table}"


# worked out by hand from the column names
TARGETS = {
    "region": "r_name", "nation": "n_regionkey", "customer": "c_mktsegment", "supplier": "s_acctbal",
    "part": "p_retailprice", "orders": "o_orderpriority", "lineitem": "l_shipdate", "events": "props",
    "documents": "n_chars", "embeddings": "label", "pages": "html", "benchmark": "text", "labels": "toxic",
    "conversations": "text",
}
ORACLES["a1_guess_target"] = union(facts(t, c) for t, c in TARGETS.items())
ORACLES["a2_sensitive_by_keyword"] = facts("pages", "page_id")
IDENTIFIERS = [
    ("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"),
    ("events", "event_id"), ("events", "user_id"), ("documents", "doc_id"), ("embeddings", "vec_id"),
    ("pages", "page_id"), ("benchmark", "item_id"), ("labels", "doc_id"), ("conversations", "conv_id"),
]
ORACLES["a3_sensitive_by_category"] = union(
    [facts(t, c, ", 'personal_identifiers' AS category") for t, c in IDENTIFIERS]
    + [facts("pages", "page_id", ", 'protected_attributes' AS category")]
)
ORACLES["a4_temporal_columns"] = union(facts(t, c) for t, c in [("orders", "o_orderdate"), ("lineitem", "l_shipdate")])
ORACLES["a4_temporal_columns_by_type"] = union(
    facts(t, c) for t, c in [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]
)

# ---------------------------------------------------------------- data-level fairness

check("f1_target_distribution", "fx_docs", proportions(["quality"]))
check("f2_group_proportions", "fx_orders", proportions(["region", "segment", "priority"]))


def rates(groups: list[tuple[str, str]], target: str) -> str:
    """groups: (attribute name, SQL of the group's label)."""
    return union(
        f"""SELECT '{attr}' AS attr, {grp} AS grp, CAST({target} AS VARCHAR) AS label, count(*) AS n,
        CAST(sum(count(*)) OVER (PARTITION BY {grp}) AS BIGINT) AS n_group,
        {r6(f'100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {grp})')} AS pct FROM fx GROUP BY {grp}, {target}"""
        for attr, grp in groups
    )


def pair_groups(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(f"{a}_{b}", f"CAST({a} AS VARCHAR) || '_' || CAST({b} AS VARCHAR)") for a, b in pairs]


SENS = ["region", "segment", "priority"]
PAIRS = [("region", "segment"), ("region", "priority"), ("segment", "priority")]
check("f3_target_rates_by_group", "fx_docs", rates([("lang", "lang"), ("source", "source")], "quality"))
check("f3_target_rates_orders", "fx_orders", rates([(c, c) for c in SENS], "o_orderstatus"))
check("f4_intersectional_rates", "fx_orders", rates(pair_groups(PAIRS), "o_orderstatus"))
check(
    "f4_pair_proportions", "fx_orders",
    union(
        f"SELECT '{attr}' AS attr, {grp} AS value, count(*) AS n, {r6('100.0 * count(*) / (SELECT count(*) FROM fx)')} AS pct FROM fx GROUP BY {grp}"
        for attr, grp in pair_groups(PAIRS)
    ),
)
check("f5_pairs", "fx_docs", rates(pair_groups([("lang", "toxic")]), "quality"))
DOC_PAIRS = pair_groups([("lang", "source"), ("lang", "toxic"), ("source", "toxic")])
BUCKETS = union(
    f"""SELECT '{attr}' AS attr, grp, n, CASE WHEN 10 * n >= m THEN 'high' WHEN 100 * n >= m THEN 'medium' ELSE 'low' END AS bucket
    FROM (SELECT {grp} AS grp, count(*) AS n, max(count(*)) OVER () AS m FROM fx GROUP BY 1)"""
    for attr, grp in DOC_PAIRS
)
check("f6_scale_buckets", "fx_docs", BUCKETS)
check("f6_bucket_ranges", "fx_docs", f"SELECT attr, bucket, count(*) AS n_groups, min(n) || '-' || max(n) AS range FROM ({BUCKETS}) GROUP BY 1, 2")
check(
    "f7_top_combinations", "fx_orders",
    f"SELECT * EXCLUDE (place) FROM (SELECT *, dense_rank() OVER (PARTITION BY attr ORDER BY n_group DESC, grp) AS place FROM ({rates(pair_groups([('nation', 'segment'), ('nation', 'priority')]), 'o_orderstatus')})) WHERE place <= 50",
)


def modal(columns: list[str], target: str) -> str:
    groups = union(
        f"SELECT '{c}' AS attr, {c} AS grp, max(n) / sum(n) AS rate FROM (SELECT {c}, {target}, count(*) AS n FROM fx WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY {c}"
        for c in columns
    )
    return f"""SELECT attr, count(*) AS n_groups, {r6('max(rate)')} AS max_rate, {r6('min(rate)')} AS min_rate, {r6('max(rate) - min(rate)')} AS disparity,
  CASE WHEN max(rate) - min(rate) < 0.1 THEN 'FAIR' WHEN max(rate) - min(rate) < 0.2 THEN 'MINOR_DISPARITY' ELSE 'SIGNIFICANT_DISPARITY' END AS level
FROM ({groups}) GROUP BY attr HAVING count(*) >= 2"""


check("f8_modal_rate_parity", "fx_docs", modal(["lang", "source"], "quality"))
check("f8_modal_rate_parity_nulls", "fx_groupnull", modal(["priority", "status"], "y"))


def parity(column: str, target: str, priv: str, unpriv: str) -> str:
    group = f"coalesce(CAST({column} AS VARCHAR), 'Unknown')"
    return f"""
SELECT '{column}' AS attr, priv, unpriv, {r6('bp')} AS base_priv, {r6('bu')} AS base_unpriv, {r6('bu / bp')} AS di, {r6('bu - bp')} AS spd,
  CASE WHEN bu / bp BETWEEN 0.8 AND 1.25 THEN 'ACCEPTABLE (80% rule satisfied)' ELSE 'CONCERNING (violates 80% rule)' END AS status
FROM (SELECT priv, unpriv, (SELECT avg({target}) FROM fx WHERE {group} = priv) AS bp, (SELECT avg({target}) FROM fx WHERE {group} = unpriv) AS bu
      FROM (SELECT ({priv}) AS priv, ({unpriv}) AS unpriv))"""


def nth(column: str, n: int) -> str:
    return f"SELECT CAST({column} AS VARCHAR) FROM (SELECT DISTINCT {column} FROM fx) ORDER BY {column} LIMIT 1 OFFSET {n}"


check("f9_binary_parity", "fx_docs", union(parity(c, "quality", nth(c, 1), nth(c, 0)) for c in ("lang", "source", "toxic")))
check(
    "f9_binary_parity_nulls", "fx_groupnull",
    union([parity("priority", "y", "'1-URGENT'", "'Unknown'"), parity("status", "y", nth("status", 1), nth("status", 0))]),
)

DISTANCE = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
ALL_NEAR = f"""near AS (SELECT a.vec_id, a.y, b.vec_id AS neighbour, b.y AS y_near, {DISTANCE} AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE}, b.vec_id) AS rank FROM fx a, fx b WHERE {{test}})"""
check(
    "f10_knn_consistency", "fx_emb",
    f"SELECT 5 AS k, {r6('1 - avg(abs(y - m))')} AS consistency FROM (SELECT vec_id, any_value(y) AS y, avg(y_near) AS m FROM near WHERE rank <= 5 GROUP BY vec_id)",
    ALL_NEAR.format(test="true"),
)
check(
    "f10_nearest_neighbours", "fx_emb",
    f"SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, {r6('sqrt(d)')} AS distance FROM near WHERE rank <= 5",
    ALL_NEAR.format(test="a.y = b.y AND a.vec_id <> b.vec_id"),
)
check(
    "f10_nearest_of_all", "fx_emb",
    f"SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, {r6('sqrt(d)')} AS distance FROM near WHERE rank <= 7",
    ALL_NEAR.format(test="a.vec_id <> b.vec_id"),
)

# ------------------------------------------------------------------ the proxy's metrics

check(
    "m1_encode_features", "fx_groupnull",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(priority, 'Missing')) - 1 AS DOUBLE) AS priority,
       CAST(y AS DOUBLE) AS y, status, CAST(dense_rank() OVER (ORDER BY status) - 1 AS DOUBLE) AS target_code FROM fx""",
)
check(
    "m2_hash_split", "fx_docs",
    f"SELECT doc_id, quality, concat('0x', substr({HASH_ORDER.format(key='doc_id')}, 1, 8))::UBIGINT / 4294967296.0 < 0.25 AS is_test FROM fx",
)
check(
    "m2_exact_split", "fx_orders",
    f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH_ORDER.format(key='o_orderkey')})
        <= round(0.25 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test FROM fx""",
)


TESTED = f"(SELECT * FROM fx WHERE concat('0x', substr({HASH_ORDER.format(key='o_orderkey')}, 1, 8))::UBIGINT / 4294967296.0 < 0.25)"
for m3 in ("random_forest", "gradient_boosting", "logistic_regression", "linear_svm"):
    check(
        f"m3_{m3}", "fx_orders",
        union(
            f"SELECT '{c}' AS attr, {c} AS grp, count(*) AS n, {r6('avg(big)')} AS base_rate, CAST(sum(big) AS BIGINT) AS n_pos, CAST(sum(1 - big) AS BIGINT) AS n_neg, true AS adds_up, true AS learns FROM {TESTED} GROUP BY {c}"
            for c in ("region", "segment", "priority")
        ),
    )
TESTED_LINES = TESTED.replace("o_orderkey", "l_orderkey")
for m3 in ("kernel_svm", "random_forest_lines"):
    check(
        f"m3_{m3}", "fx_lines",
        f"SELECT 'priority' AS attr, priority AS grp, count(*) AS n, {r6('avg(middling)')} AS base_rate, CAST(sum(middling) AS BIGINT) AS n_pos, CAST(sum(1 - middling) AS BIGINT) AS n_neg, true AS adds_up, true AS learns FROM {TESTED_LINES} GROUP BY priority",
    )
check(
    "m3_svm_probability", "fx_lines",
    f"SELECT CAST(middling AS VARCHAR) AS y, count(*) AS n, count(*) AS n_between, true AS calibrated FROM {TESTED_LINES} GROUP BY middling",
)


def per_label(source: str, group: str | None = None) -> str:
    """(group,) label, precision, recall, f1, support by comparing rows with each label."""
    by = f"{group}, " if group else ""
    same = f" AND f.{group} = l.{group}" if group else ""
    return f"""
SELECT {by.replace(group or '', 'l.' + group) if group else ''}l.label, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(ap, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + (pp - tp) + (ap - tp), 0), 0) AS f1, ap AS support
FROM (SELECT DISTINCT {by}CAST(y AS VARCHAR) AS label FROM {source} UNION SELECT DISTINCT {by}CAST(yhat AS VARCHAR) FROM {source}) l,
LATERAL (SELECT count(*) FILTER (f.y = l.label AND f.yhat = l.label) AS tp, count(*) FILTER (f.yhat = l.label) AS pp, count(*) FILTER (f.y = l.label) AS ap
         FROM {source} f WHERE true{same}) m"""


check(
    "m4_classification_report", "fx_pred3",
    f"SELECT label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM ({per_label('fx')})",
)
check(
    "m4_classification_summary", "fx_pred3",
    f"SELECT {r6('(SELECT avg((y = yhat)::INT) FROM fx)')} AS accuracy, {r6('avg(f1)')} AS f1_macro, {r6('sum(f1 * support) / sum(support)')} AS f1_weighted FROM ({per_label('fx')})",
)
check("m4_confusion_matrix", "fx_pred3", "SELECT y AS actual, yhat AS predicted, count(*) AS n FROM fx GROUP BY 1, 2")


def group_rows(attr: str, group: str, positive: str, source: str = "fx", predicted: str = "yhat") -> str:
    """Unrounded group metrics of one attribute."""
    src = f"(SELECT {group} AS g, CAST(y AS VARCHAR) AS y, CAST({predicted} AS VARCHAR) AS yhat FROM {source})"
    return f"""
SELECT '{attr}' AS attr, c.g AS grp, n, accuracy, f1_macro, (tp + fp) / n AS selection_rate, (tp + fn) / n AS base_rate, tp, fp, tn, fn,
  coalesce(tp / nullif(tp + fn, 0), 0) AS tpr, coalesce(tn / nullif(tn + fp, 0), 0) AS tnr,
  coalesce(fp / nullif(tn + fp, 0), 0) AS fpr, coalesce(fn / nullif(tp + fn, 0), 0) AS fnr
FROM (SELECT g, count(*) AS n, avg((y = yhat)::INT) AS accuracy,
        count(*) FILTER (y = '{positive}' AND yhat = '{positive}') AS tp, count(*) FILTER (y <> '{positive}' AND yhat = '{positive}') AS fp,
        count(*) FILTER (y <> '{positive}' AND yhat <> '{positive}') AS tn, count(*) FILTER (y = '{positive}' AND yhat <> '{positive}') AS fn
      FROM {src} GROUP BY g) c
JOIN (SELECT g, avg(f1) AS f1_macro FROM ({per_label(src, 'g')}) GROUP BY g) s ON s.g = c.g"""


RATES = ["accuracy", "f1_macro", "selection_rate", "base_rate", "tpr", "tnr", "fpr", "fnr"]
ROUND_RATES = "SELECT * REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in RATES) + ") FROM ({rows})"
PRED_GROUPS = union(group_rows(c, c, "1") for c in ("segment", "region"))
check("m5_group_metrics", "fx_pred", ROUND_RATES.format(rows=PRED_GROUPS))
check("m5_group_metrics_multiclass", "fx_pred3", ROUND_RATES.format(rows=group_rows("segment", "segment", "O")))
PARITY = """SELECT attr, max(selection_rate) - min(selection_rate) AS spd,
  coalesce(min(selection_rate) FILTER (selection_rate > 0) / nullif(max(selection_rate), 0), 0) AS di,
  first(grp ORDER BY selection_rate DESC, grp) AS max_grp, first(grp ORDER BY selection_rate, grp) AS min_grp FROM ({rows}) GROUP BY attr"""
check("m6_prediction_parity", "fx_pred", f"SELECT attr, {r6('spd')} AS spd, {r6('di')} AS di, max_grp, min_grp FROM ({PARITY.format(rows=PRED_GROUPS)})")
check("m7_intersectional_metrics", "fx_pred", ROUND_RATES.format(rows=group_rows("segment_region", "segment || '_' || region", "1")))
check(
    "m8_error_rate_ratios", "fx_pred",
    f"""SELECT attr, {r6('max(fnr) / nullif(min(fnr), 0)')} AS fnr_ratio, {r6('min(f1_macro)')} AS f1_min, {r6('max(f1_macro)')} AS f1_max,
    {r6('max(f1_macro) / nullif(min(f1_macro), 0)')} AS f1_ratio, coalesce(max(fnr) / nullif(min(fnr), 0) > 1.25, false) AS significant FROM ({PRED_GROUPS}) GROUP BY attr""",
)

# ------------------------------------------------------------------------- mitigation


def weights(group: str, target: str) -> str:
    """fx with sample_weight, as a CTE named ``rw``."""
    return f"""rw AS (SELECT *, CASE WHEN {group} IS NULL OR {target} IS NULL THEN 1.0 ELSE
      CAST(count(*) OVER (PARTITION BY {group}) AS DOUBLE) / (SELECT count(DISTINCT {target}) FROM fx) / count(*) OVER (PARTITION BY {group}, {target}) END AS sample_weight FROM fx)"""


W = r6("sample_weight") + " AS sample_weight"
check("f10_lsh_recall", "fx_emb", "SELECT 5 * count(*) AS n_pairs, true AS recalled FROM fx")
check("r1_reweight", "fx_docs", f"SELECT {DOC_COLUMNS}, {W} FROM rw", weights("lang", "quality"))
PAIR_GROUP = "coalesce(priority, 'nan') || '_' || status"
check("r1_reweight_pair", "fx_groupnull", f"SELECT o_orderkey, priority, status, y, {PAIR_GROUP} AS combined_group, {W} FROM rw", weights(PAIR_GROUP, "y"))
check("r1_reweight_null_group", "fx_groupnull", f"SELECT o_orderkey, priority, status, y, {W} FROM rw", weights("priority", "y"))
BIG = weights("region || '_' || segment", "big")
check(
    "r1b_weight_stats", "fx_orders",
    "SELECT " + ", ".join(f"{r6(f'{f}')} AS {n}" for n, f in [
        ("min", "min(sample_weight)"), ("max", "max(sample_weight)"), ("mean", "avg(sample_weight)"),
        ("median", "quantile_cont(CAST(sample_weight AS DOUBLE), 0.5)"), ("std_pop", "stddev_pop(sample_weight)")]) + " FROM rw",
    BIG,
)
check(
    "r1b_weighted_distribution", "fx_orders",
    f"SELECT CAST(big AS VARCHAR) AS label, {r6('w')} AS weighted_n, round((SELECT max(w) / min(w) FROM wd), 2) AS weighted_ratio FROM wd",
    BIG, "wd AS (SELECT big, sum(sample_weight) AS w FROM rw GROUP BY big)",
)
check(
    "r5_sampling_plan", "fx_orders",
    "SELECT o_orderstatus AS label, count(*) AS n, max(count(*)) OVER () AS target_n FROM fx GROUP BY 1",
)
check(
    "r5_sampling_plan_under", "fx_orders",
    "SELECT o_orderstatus AS label, count(*) AS n, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) = 1 THEN min(count(*)) OVER () ELSE count(*) END AS target_n FROM fx GROUP BY 1",
)


def raised(key: str, target: str, source: str = "fx") -> list[str]:
    """CTEs: class sizes with the rows they need, numbered rows, and draws."""
    return [
        f"sizes AS (SELECT {target} AS label, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM {source} GROUP BY 1)",
        f"numbered AS (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {HASH_ORDER.format(key=key)}) - 1 AS rn FROM {source})",
        "drawn AS (SELECT label, n, unnest(range(need)) AS draw FROM sizes WHERE need > 0)",
    ]


def drawn_number(purpose: str, size: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('-', '42', '{purpose}', label, draw)), 1, 12))::UBIGINT % {size} AS BIGINT)"


def oversampled(key: str, target: str, columns: str) -> str:
    return f"""
SELECT {columns}, CAST(NULL AS BIGINT) AS draw FROM fx
UNION ALL
SELECT {columns}, draw FROM (SELECT *, {drawn_number('row', 'n')} AS pick FROM drawn) d JOIN numbered r ON r.{target} = d.label AND r.rn = d.pick"""


check("r3_oversample", "fx_docs", oversampled("doc_id", "quality", DOC_COLUMNS), *raised("doc_id", "quality"))
check("r3_oversample_multiclass", "fx_orders", oversampled("o_orderkey", "o_orderstatus", "o_orderkey, o_orderstatus"), *raised("o_orderkey", "o_orderstatus"))
check("r4_undersample", "fx_docs", under("doc_id", "quality", DOC_COLUMNS))
check("r4_undersample_multiclass", "fx_orders", under("o_orderkey", "o_orderstatus", "o_orderkey, o_orderstatus"))
check(
    "r2_smote_vectors", "fx_emb",
    f"""
SELECT base_key, neighbour_key, draw, label, {r6('x[1]')} AS x_first, {r6('x[64]')} AS x_last, {r6('list_sum(x)')} AS x_sum
FROM (SELECT r.vec_id AS base_key, b.vec_id AS neighbour_key, d.draw, CAST(label AS VARCHAR) AS label,
        list_transform(list_zip(CAST(r.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: p[1] + u * (p[2] - p[1])) AS x
      FROM (SELECT *, {drawn_number('row', 'n')} AS pick, {drawn_number('neighbour', '5')} + 1 AS place,
                   concat('0x', substr(md5(concat_ws('-', '42', 'place', label, draw)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM drawn) d
      JOIN numbered r ON r.y = d.label AND r.rn = d.pick
      JOIN near ON near.vec_id = r.vec_id AND near.rank = d.place
      JOIN fx b ON b.vec_id = near.neighbour)""",
    *raised("vec_id", "y"), ALL_NEAR.format(test="a.y = b.y AND a.vec_id <> b.vec_id"),
)
check(
    "r2_smote_rows", "fx_docs",
    """SELECT quality, false AS synthetic, n, CAST(0 AS BIGINT) AS n_origins, n AS n_keys, CAST(0 AS BIGINT) AS n_unknown, true AS bounded, t AS most_toxic FROM s
    UNION ALL SELECT quality, true, m - n, m - n, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, t FROM s WHERE m > n""",
    "s AS (SELECT quality, count(*) AS n, max(toxic) AS t, max(count(*)) OVER () AS m FROM fx GROUP BY quality)",
)
check(
    "r6_mitigation_summary", "fx_docs",
    f"SELECT CAST(quality AS VARCHAR) AS label, n AS n_before, {r6('100.0 * n / t')} AS pct_before, m AS n_after, {r6('100.0 / k')} AS pct_after, m - n AS change FROM s",
    "s AS (SELECT quality, count(*) AS n, max(count(*)) OVER () AS m, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM fx GROUP BY quality)",
)

# ------------------------------------------------------------------------- comparison

BIG_SIZES = "s AS (SELECT CAST(big AS VARCHAR) AS label, count(*) AS n, min(count(*)) OVER () AS m, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM fx GROUP BY big)"
check(
    "c1_compare_size", "fx_orders",
    f"SELECT n_orig, n_mit, n_mit - n_orig AS difference, {r6('100.0 * (n_mit - n_orig) / n_orig')} AS pct_change FROM (SELECT CAST(any_value(t) AS BIGINT) AS n_orig, CAST(any_value(k * m) AS BIGINT) AS n_mit FROM s)",
    BIG_SIZES,
)
check(
    "c2_compare_target", "fx_orders",
    f"SELECT label, n AS n_orig, {r6('100.0 * n / t')} AS pct_orig, m AS n_mit, {r6('100.0 / k')} AS pct_mit, m - n AS change, {r6('100.0 / k - 100.0 * n / t')} AS pp_change FROM s",
    BIG_SIZES,
)
check(
    "c3_compare_target_weighted", "fx_orders",
    f"SELECT CAST(big AS VARCHAR) AS label, n AS n_orig, {r6('100.0 * n / t')} AS pct_orig, {r6('w')} AS n_mit, {r6('100.0 * w / tw')} AS pct_mit, {r6('w - n')} AS change, {r6('100.0 * w / tw - 100.0 * n / t')} AS pp_change FROM s",
    weights("region", "big"),
    "s AS (SELECT big, count(*) AS n, sum(count(*)) OVER () AS t, sum(sample_weight) AS w, sum(sum(sample_weight)) OVER () AS tw FROM rw GROUP BY big)",
)
UNDER_DOCS = f"un AS ({under('doc_id', 'quality', DOC_COLUMNS)})"
check(
    "c4_compare_sensitive", "fx_docs",
    union(
        f"""SELECT '{c}' AS attr, o.v AS value, o.n AS n_orig, {r6('100.0 * o.n / (SELECT count(*) FROM fx)')} AS pct_orig, coalesce(m.n, 0) AS n_mit,
        {r6('100.0 * coalesce(m.n, 0) / (SELECT count(*) FROM un)')} AS pct_mit, coalesce(m.n, 0) - o.n AS change
        FROM (SELECT {c} AS v, count(*) AS n FROM fx GROUP BY 1) o LEFT JOIN (SELECT {c} AS v, count(*) AS n FROM un GROUP BY 1) m ON m.v = o.v"""
        for c in ("lang", "source")
    ),
    UNDER_DOCS,
)
METHOD_ROWS = """m AS (
  SELECT 0 AS place, 'reweighted' AS method, t AS rows_orig, t AS rows_mit, a / b AS ratio_orig, wa / wb AS ratio_mit FROM k
  UNION ALL SELECT 1, 'oversampled', t, 2 * a, a / b, 1.0 FROM k
  UNION ALL SELECT 2, 'undersampled', t, 2 * b, a / b, 1.0 FROM k)"""
METHOD_SIZES = """k AS (SELECT CAST(sum(n) AS BIGINT) AS t, max(n) AS a, min(n) AS b, max(w) AS wa, min(w) AS wb
  FROM (SELECT quality, count(*) AS n, sum(sample_weight) AS w FROM rw GROUP BY quality))"""
METHOD_COLUMNS = f"method, rows_orig, rows_mit, {r6('ratio_orig')} AS ratio_orig, {r6('ratio_mit')} AS ratio_mit, ratio_mit < ratio_orig AS improved"
check("c5_compare_imbalance", "fx_docs", f"SELECT {METHOD_COLUMNS} FROM m WHERE place = 0", weights("lang", "quality"), METHOD_SIZES, METHOD_ROWS)
check(
    "c7_rank_methods", "fx_docs",
    f"SELECT {METHOD_COLUMNS}, CAST(row_number() OVER (ORDER BY ratio_mit, place) AS INTEGER) AS rank FROM m",
    weights("lang", "quality"), METHOD_SIZES, METHOD_ROWS,
)
SIDES = [
    f"base AS ({PARITY.format(rows=PRED_GROUPS)})",
    f"mit AS ({PARITY.format(rows=union(group_rows(c, c, '1', predicted='yhat2') for c in ('segment', 'region')))})",
    """cmp AS (SELECT b.attr, b.spd AS spd_base, m.spd AS spd_mit, b.spd - m.spd AS spd_change, abs(m.spd) < abs(b.spd) AS spd_improved,
      b.di AS di_base, m.di AS di_mit, m.di - b.di AS di_change, abs(m.di - 1) < abs(b.di - 1) AS di_improved FROM base b JOIN mit m ON b.attr = m.attr)""",
]
check(
    "c6_compare_fairness", "fx_pred",
    "SELECT * REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in ("spd_base", "spd_mit", "spd_change", "di_base", "di_mit", "di_change")) + ") FROM cmp",
    *SIDES,
)
EFFECT = "SELECT CAST(k AS BIGINT) AS n_improved, CASE WHEN k / t > 0.6 THEN 'Significant' WHEN k / t > 0.3 THEN 'Moderate' WHEN k > 0 THEN 'Minor' ELSE 'None or Negative' END AS overall FROM (SELECT sum({what}) AS k, 2 * count(*) AS t FROM cmp)"
check("c6_fairness_effect", "fx_pred", EFFECT.format(what="(spd_improved OR di_improved)::INT"), *SIDES)
check("c6_fairness_effect_metrics", "fx_pred", EFFECT.format(what="spd_improved::INT + di_improved::INT"), *SIDES)
check(
    "c8_inventory_outputs", "fx_docs",
    """SELECT 'reweighted' AS method, count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, true AS has_weights FROM fx
UNION ALL SELECT 'undersampled', 2 * min(n), CAST(6 AS BIGINT), false FROM (SELECT count(*) AS n FROM fx GROUP BY quality)""",
)

# ------------------------------------------------------------------------- statistics


def pearson(columns: list[str]) -> str:
    return union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS value FROM fx" for a, b in name_pairs(columns))


VARYING = [c for c in NUM_COLUMNS if c != "const_col"]
check("t1_high_correlations", "fx_num", f"SELECT * FROM ({pearson(VARYING)}) WHERE abs(value) > 0.8")
check("t1_pearson", "fx_num", pearson(VARYING))
check(
    "t2_normality_screen", "fx_num",
    "SELECT \"column\", n, " + f"{rounded('jb', 3)} AS jb, {rounded('exp(-jb / 2)', 3)} AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM (" + union(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count({c}) / 6 * (pow(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 2) + pow(kurtosis_pop({c}), 2) / 4) AS jb FROM fx"
        for c in VARYING
    ) + ")",
)

def horner(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def francia(fixture_name: str, columns: list[str]) -> None:
    """Every row ranked by itself, its score by the published approximation."""
    cells = union(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM fx WHERE {c} IS NOT NULL" for c in columns)
    tail = f"({horner(numbers.TAIL_TOP, 'far')} / {horner(numbers.TAIL_BOTTOM, 'far')})"
    centre = f"((p - 0.5) * {horner(numbers.CENTRE_TOP, 'qq')} / {horner(numbers.CENTRE_BOTTOM, 'qq')})"
    z_tail = f"(exp(-z * z / 2) / sqrt(2 * pi()) * {horner(numbers.TAIL_SERIES, f'(1 / (1 + {numbers.TAIL_STEP} * abs(z)))')})"
    name = "t2_shapiro_francia" + ("" if fixture_name == "fx_num" else "_events")
    check(
        name, fixture_name,
        f"""SELECT "column", n, {r6('w')} AS w, {r6('p_value')} AS p_value, p_value > 0.05 AS is_normal
        FROM (SELECT *, CASE WHEN z >= 0 THEN {z_tail} ELSE 1 - {z_tail} END AS p_value FROM zs)""",
        f"cells AS ({cells})",
        """ps AS (SELECT "column", x - avg(x) OVER (PARTITION BY "column") AS d,
          (row_number() OVER (PARTITION BY "column" ORDER BY x) - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY "column") + 0.25::DOUBLE) AS p FROM cells)""",
        "qs AS (SELECT *, (p - 0.5) * (p - 0.5) AS qq, sqrt(-2 * ln(least(p, 1 - p))) AS far FROM ps)",
        f"ms AS (SELECT \"column\", d, CASE WHEN p < {numbers.TAIL} THEN {tail} WHEN p > 1 - {numbers.TAIL} THEN -{tail} ELSE {centre} END AS m FROM qs)",
        """ws AS (SELECT "column", count(*) AS n, pow(sum(d * m), 2) / (sum(d * d) * sum(m * m)) AS w FROM ms GROUP BY 1 HAVING sum(d * d) > 0)""",
        "zs AS (SELECT *, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM ws)",
    )


francia("fx_num", VARYING)
francia("fx_events", ["event_id", "user_id", "value"])
RISK = union(
    f"SELECT '{c}' AS \"column\", stddev_samp({c}) / (avg({c}) + 1e-10) AS cv FROM fx" for c in NUM_COLUMNS
)
check("t3_variation_risk", "fx_num", f"SELECT \"column\", {r6('cv')} AS cv, cv > 2 AS risky FROM ({RISK})")
check(
    "t3_drift_recommendation", "fx_num",
    f"""SELECT count(*) FILTER (cv > 2) + 1 AS n_risks, 'Address identified risks before deployment' AS recommendation,
    'No temporal columns detected - cannot assess temporal drift risk' AS notice FROM ({RISK})""",
)

DOC_JSON = "concat('{\"doc_id\":', doc_id, ',\"lang\":\"', lang, '\",\"source\":\"', source, '\",\"n_chars\":', n_chars, ',\"toxic\":', toxic, ',\"quality\":', quality, '}')"
check(
    "c8_preview_outputs", "fx_docs",
    union(
        f"SELECT '{m}' AS method, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank, {DOC_JSON} AS \"row\" FROM {t} QUALIFY rank <= 5"
        for m, t in (("given", "fx"), ("undersampled", "un"))
    ),
    UNDER_DOCS,
)

# ------------------------------------------------------------------------ whole audits


def found(stage: str, operator: str, sql: str, subject: list[str], numbers: list[str], texts: list[str] = ()) -> str:
    """A result in long form: one row per metric."""
    about = "concat_ws(' / ', " + ", ".join(f"'{c}=' || coalesce(CAST(\"{c}\" AS VARCHAR), 'null')" for c in subject) + ")" if subject else "''"
    head = f"SELECT '{stage}' AS stage, '{operator}' AS operator, {about} AS subject"
    return union(
        [f"{head}, '{m}' AS metric, {r6(m)} AS value_double, CAST(NULL AS VARCHAR) AS value_string FROM ({sql})" for m in numbers]
        + [f"{head}, '{m}' AS metric, CAST(NULL AS DOUBLE) AS value_double, CAST({m} AS VARCHAR) AS value_string FROM ({sql})" for m in texts]
    )


AUDIT_PAIR = pair_groups([("region", "segment")])
AUDIT_BUCKETS = f"""SELECT '{AUDIT_PAIR[0][0]}' AS attr, grp, n, CASE WHEN 10 * n >= m THEN 'high' WHEN 100 * n >= m THEN 'medium' ELSE 'low' END AS bucket
FROM (SELECT {AUDIT_PAIR[0][1]} AS grp, count(*) AS n, max(count(*)) OVER () AS m FROM fx GROUP BY 1)"""
TWO_SIZES = "SELECT {a} AS n_orig, {b} AS n_mit, {b} - {a} AS difference, 100.0 * ({b} - {a}) / {a} AS pct_change"
FX_ROWS, UN_ROWS = "(SELECT count(*) FROM fx)", "(SELECT count(*) FROM un)"
CLASSES = """SELECT CAST(o.big AS VARCHAR) AS label, o.n AS n_orig, 100.0 * o.n / (SELECT count(*) FROM fx) AS pct_orig, m.w AS n_mit,
  100.0 * m.w / (SELECT sum(w) FROM {after}) AS pct_mit, m.w - o.n AS change,
  100.0 * m.w / (SELECT sum(w) FROM {after}) - 100.0 * o.n / (SELECT count(*) FROM fx) AS pp_change
FROM (SELECT big, count(*) AS n FROM fx GROUP BY big) o JOIN {after} m ON m.big = o.big"""
CLASS_METRICS = ["n_orig", "pct_orig", "n_mit", "pct_mit", "change", "pp_change"]


def groups_compared(after: str) -> str:
    return union(
        f"""SELECT '{c}' AS attr, o.v AS value, o.n AS n_orig, 100.0 * o.n / (SELECT count(*) FROM fx) AS pct_orig, coalesce(m.n, 0) AS n_mit,
        100.0 * coalesce(m.n, 0) / (SELECT count(*) FROM {after}) AS pct_mit, coalesce(m.n, 0) - o.n AS change
        FROM (SELECT {c} AS v, count(*) AS n FROM fx GROUP BY 1) o LEFT JOIN (SELECT {c} AS v, count(*) AS n FROM {after} GROUP BY 1) m ON m.v = o.v"""
        for c in ("region", "segment")
    )


def classes_changed(after: str) -> str:
    return f"""SELECT CAST(o.big AS VARCHAR) AS label, o.n AS n_before, 100.0 * o.n / (SELECT count(*) FROM fx) AS pct_before, m.n AS n_after,
      100.0 * m.n / (SELECT count(*) FROM {after}) AS pct_after, m.n - o.n AS change
    FROM (SELECT big, count(*) AS n FROM fx GROUP BY big) o JOIN (SELECT big, count(*) AS n FROM {after} GROUP BY big) m ON m.big = o.big"""


CHANGES = ["n_before", "pct_before", "n_after", "pct_after", "change"]
WEIGHTS_SEEN = """SELECT min(sample_weight) AS min, max(sample_weight) AS max, avg(sample_weight) AS mean,
  quantile_cont(CAST(sample_weight AS DOUBLE), 0.5) AS median, stddev_pop(sample_weight) AS std_pop FROM rw"""
WEIGHTED = "SELECT CAST(big AS VARCHAR) AS label, w AS weighted_n, round((SELECT max(w) / min(w) FROM wr), 2) AS weighted_ratio FROM wr"
PAIR_SHARES = f"SELECT '{AUDIT_PAIR[0][0]}' AS attr, {AUDIT_PAIR[0][1]} AS value, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM fx) AS pct FROM fx GROUP BY 2"

AUDIT_METHODS = f"""SELECT *, ratio_mit < ratio_orig AS improved, row_number() OVER (ORDER BY ratio_mit, place) AS rank FROM (
  SELECT 0 AS place, 'reweighted' AS method, {FX_ROWS} AS rows_orig, {FX_ROWS} AS rows_mit, (SELECT max(n) / min(n) FROM b) AS ratio_orig, (SELECT max(w) / min(w) FROM wr) AS ratio_mit
  UNION ALL SELECT 1, 'undersampled', {FX_ROWS}, {UN_ROWS}, (SELECT max(n) / min(n) FROM b), (SELECT max(w) / min(w) FROM wu))"""


def catalog_rows(p4: str, types: dict[str, str]) -> str:
    """The catalogue with the columns' types."""
    listed = ", ".join(f"('{c}', '{t}')" for c, t in types.items())
    return found(
        "attributes", "column_catalog", f"SELECT p.*, t.dtype FROM ({p4}) p JOIN (VALUES {listed}) t(c, dtype) ON t.c = p.\"column\"",
        ["column", "rank"], ["n_unique", "n_null", "n", "pct"], ["dtype", "value"],
    )


ORDER_TYPES = {c: "string" for c in ORDER_TEXT} | {"o_orderkey": "bigint", "o_totalprice": "double", "c_acctbal": "double", "big": "int"}
ORDER_ISSUES = f"""SELECT "column", 0 AS n_missing, 0.0 AS pct_missing, false AS mixed, count(*) AS n_patterns,
  string_agg(printf('%s: %d occurrences (%.2f%%)', pattern, n, pct), ' | ' ORDER BY pattern) AS issues
FROM ({single_chars('fx', ORDER_TEXT)} UNION ALL {sentinels(['o_orderkey', 'o_totalprice', 'c_acctbal', 'big'])}) GROUP BY 1"""
ISSUE_METRICS = (["n_missing", "pct_missing", "n_patterns"], ["mixed", "issues"])
check(
    "o1_audit", "fx_orders",
    union(
        [
            found("load", "size", "SELECT count(*) AS n_rows, 9 AS n_columns FROM fx", [], ["n_rows", "n_columns"]),
            found("quality", "column_issue_report", ORDER_ISSUES, ["column"], *ISSUE_METRICS),
            catalog_rows(ORACLES["p4_column_catalog"], ORDER_TYPES),
            found("attributes", "sample_values", first_values("fx", ORDER_COLUMNS, 10), ["column", "rank"], [], ["value"]),
            found("imbalance", "dominant_values", "WITH " + vc_cte(["region", "segment"]) + DOMINANT, ["column", "rank"], ["pct"], ["value"]),
            found("target_fairness", "target_distribution", proportions(["big"]), ["attr", "value"], ["n", "pct"]),
            found("target_fairness", "group_proportions", proportions(["region", "segment"]), ["attr", "value"], ["n", "pct"]),
            found("target_fairness", "target_rates_by_group", rates([("region", "region"), ("segment", "segment")], "big"), ["attr", "grp", "label"], ["n", "n_group", "pct"]),
            found("target_fairness", "intersectional_rates", rates(AUDIT_PAIR, "big"), ["attr", "grp", "label"], ["n", "n_group", "pct"]),
            found("target_fairness", "scale_buckets", AUDIT_BUCKETS, ["attr", "grp"], ["n"], ["bucket"]),
            found("target_fairness", "pair_proportions", PAIR_SHARES, ["attr", "value"], ["n", "pct"]),
            found("target_fairness", "top_combinations", rates(AUDIT_PAIR, "big"), ["attr", "grp", "label"], ["n", "n_group", "pct"]),
            found("comparison_reweighted", "mitigation_summary", classes_changed("fx"), ["label"], CHANGES),
            found("comparison_reweighted", "weight_stats", WEIGHTS_SEEN, [], ["min", "max", "mean", "median", "std_pop"]),
            found("comparison_reweighted", "weighted_distribution", WEIGHTED, ["label"], ["weighted_n", "weighted_ratio"]),
            found("comparison_undersampled", "mitigation_summary", classes_changed("un"), ["label"], CHANGES),
            found("comparison_reweighted", "compare_size", TWO_SIZES.format(a=FX_ROWS, b=FX_ROWS), [], ["n_orig", "n_mit", "difference", "pct_change"]),
            found("comparison_reweighted", "compare_target", CLASSES.format(after="wr"), ["label"], CLASS_METRICS),
            found("comparison_reweighted", "compare_sensitive", groups_compared("fx"), ["attr", "value"], CLASS_METRICS[:-1]),
            found("comparison_undersampled", "compare_size", TWO_SIZES.format(a=FX_ROWS, b=UN_ROWS), [], ["n_orig", "n_mit", "difference", "pct_change"]),
            found("comparison_undersampled", "compare_target", CLASSES.format(after="wu"), ["label"], CLASS_METRICS),
            found("comparison_undersampled", "compare_sensitive", groups_compared("un"), ["attr", "value"], CLASS_METRICS[:-1]),
            found("comparison", "rank_methods", AUDIT_METHODS, ["method"], ["rows_orig", "rows_mit", "ratio_orig", "ratio_mit", "rank"], ["improved"]),
        ]
    ),
    weights("region || '_' || segment", "big"),
    f"un AS ({under('o_orderkey', 'big', 'o_orderkey, region, segment, big')})",
    "b AS (SELECT count(*) AS n FROM fx GROUP BY big)",
    "wr AS (SELECT big, sum(sample_weight) AS w FROM rw GROUP BY big)",
    "wu AS (SELECT big, CAST(count(*) AS DOUBLE) AS w FROM un GROUP BY big)",
)
DIRTY_TYPES = {c: "string" for c in DIRTY_TEXT} | {"o_orderkey": "bigint", "price_raw": "double", "days_raw": "bigint"}
DIRTY_CATALOG = with_fixture(
    "fx_dirty",
    union(
        [
            f"SELECT t.\"column\", d.n_unique, d.n_null, rank, value, n, pct FROM ({TOP.format(pct='pct', k=5)}) t JOIN d ON t.\"column\" = d.\"column\"",
            *[f"SELECT '{c}', count(DISTINCT {c}), count(*) - count({c}), NULL, NULL, NULL, NULL FROM fx" for c in DIRTY_NUMBERS],
        ]
    ),
    vc_cte(DIRTY_TEXT),
    "d AS (" + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_null FROM fx" for c in DIRTY_TEXT) + ")",
)
check(
    "o1_audit_quality", "fx_dirty",
    union(
        [
            found("load", "size", "SELECT count(*) AS n_rows, 6 AS n_columns FROM fx", [], ["n_rows", "n_columns"]),
            found("quality", "column_issue_report", ORACLES["q8_column_issue_report"], ["column"], *ISSUE_METRICS),
            catalog_rows(DIRTY_CATALOG, DIRTY_TYPES),
            found("attributes", "sample_values", first_values("fx", DIRTY, 10), ["column", "rank"], [], ["value"]),
            found("imbalance", "dominant_values", "WITH " + vc_cte(["priority_raw"]) + DOMINANT, ["column", "rank"], ["pct"], ["value"]),
            *[
                part.replace("FROM fx", "FROM cc")
                for part in (
                    found("target_fairness", "target_distribution", proportions(["status_raw"]), ["attr", "value"], ["n", "pct"]),
                    found("target_fairness", "group_proportions", proportions(["priority_raw"]), ["attr", "value"], ["n", "pct"]),
                    found("target_fairness", "target_rates_by_group", rates([("priority_raw", "priority_raw")], "status_raw"), ["attr", "grp", "label"], ["n", "n_group", "pct"]),
                )
            ],
        ]
    ),
    cleaned(RICH),
    "cc AS (SELECT * FROM cl WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in DIRTY) + ")",
)


def outliers(columns: list[str]) -> str:
    return "SELECT * FROM (" + union(
        f"""SELECT '{c}' AS "column", any_value(q1) AS q1, any_value(q3) AS q3,
        count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
        100.0 * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*) AS pct
        FROM (SELECT CAST({c} AS DOUBLE) AS v, quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER () AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER () AS q3 FROM fx)"""
        for c in columns
    ) + ") WHERE n_outliers > 0"


def normality(columns: list[str]) -> str:
    return "SELECT \"column\", n, jb, exp(-jb / 2) AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM (" + union(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count({c}) / 6 * (pow(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 2) + pow(kurtosis_pop({c}), 2) / 4) AS jb FROM fx"
        for c in columns
    ) + ")"


DOC_RISK = union(f"SELECT '{c}' AS \"column\", stddev_samp({c}) / (avg({c}) + 1e-10) AS cv FROM fx" for c in ("doc_id", "n_chars", "toxic", "quality"))
PARITY_COLUMNS = ["base_priv", "base_unpriv", "di", "spd"]
DOC_TYPES = [("doc_id", "bigint", "numeric"), ("lang", "string", "categorical"), ("source", "string", "categorical"), ("n_chars", "bigint", "numeric"), ("toxic", "int", "numeric"), ("quality", "int", "numeric")]
DOC_NUMBERS, DOC_FEATURES = ["doc_id", "n_chars", "toxic", "quality"], ["doc_id", "n_chars", "toxic"]
ANY_DUPLICATE = "(SELECT count(*) FROM fx) > (SELECT count(*) FROM (SELECT DISTINCT * FROM fx))"
check(
    "o2_full_evaluation", "fx_docs",
    union(
        [
            found(
                "basic_info", "basic_info",
                union(
                    f"SELECT '{c}' AS \"column\", 'docs' AS table_name, {i} AS ordinal, '{t}' AS dtype, '{k}' AS kind, (SELECT count(*) FROM fx) AS n_rows, 6 AS n_columns, 5 AS n_features"
                    for i, (c, t, k) in enumerate(DOC_TYPES)
                ),
                ["column"], ["ordinal", "n_rows", "n_columns", "n_features"], ["table_name", "dtype", "kind"],
            ),
            found("data_quality", "duplicates", "SELECT n AS n_rows, n - d AS n_duplicates, 100.0 * (n - d) / n AS pct FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)) AS d FROM fx)", [], ["n_rows", "n_duplicates", "pct"]),
            found("data_quality", "constant_columns", "SELECT * FROM (" + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM fx" for c, *_ in DOC_TYPES) + ") WHERE n_unique = 1", ["column"], ["n_unique"]),
            found("data_quality", "high_cardinality", "SELECT * FROM (" + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM fx" for c in ("lang", "source")) + ") WHERE 2 * n_unique > (SELECT count(*) FROM fx)", ["column"], ["n_unique"]),
            found("data_quality", "iqr_outliers", outliers(DOC_NUMBERS), ["column"], ["q1", "q3", "n_outliers", "pct"]),
            found(
                "data_quality", "quality_flag",
                f"""SELECT CASE WHEN k = 0 THEN 'GOOD' ELSE 'NEEDS_ATTENTION' END AS flag, k AS n_issues FROM (SELECT ({ANY_DUPLICATE})::INT
                + (least({', '.join(f'count(DISTINCT {c})' for c, *_ in DOC_TYPES)}) = 1)::INT + (2 * greatest(count(DISTINCT lang), count(DISTINCT source)) > count(*))::INT AS k FROM fx)""",
                [], ["n_issues"], ["flag"],
            ),
            found("feature_analysis", "numeric_stats", union(numeric_row(c) for c in DOC_FEATURES), ["column"], ["n", "mean", "std", "min", "max", "median", "skew", "kurt", "n_unique"]),
            found("feature_analysis", "categorical_stats", "WITH " + vc_cte(["lang", "source"]) + " SELECT \"column\", count(*) AS n_unique, -sum(p * ln(p)) AS entropy FROM (SELECT \"column\", n / sum(n) OVER (PARTITION BY \"column\") AS p FROM vc) GROUP BY 1", ["column"], ["n_unique", "entropy"]),
            found("feature_analysis", "top_text_values", "WITH " + vc_cte(["lang", "source"]) + " " + TOP.format(pct="pct", k=3), ["column", "rank"], ["n", "pct"], ["value"]),
            found("sensitive_labels", "sensitive_by_category", "SELECT 'docs' AS table_name, 'doc_id' AS \"column\", 'personal_identifiers' AS category", ["table_name", "column"], [], ["category"]),
            found("sensitive_labels", "privacy_warning", "SELECT 'docs' AS table_name, 1 AS n_columns, 'PRIVACY WARNING: Sensitive attributes detected. Ensure proper anonymization and compliance with regulations (GDPR, HIPAA, etc.)' AS warning", ["table_name"], ["n_columns"], ["warning"]),
            found("statistical_tests", "normality_screen", normality(DOC_NUMBERS), ["column"], ["n", "jb", "p_value"], ["is_normal"]),
            found("statistical_tests", "high_correlations", f"SELECT * FROM ({pearson(DOC_NUMBERS)}) WHERE abs(value) > 0.8", ["column_a", "column_b"], ["value"]),
            found("automated_profiling", "table_profile", table_profile(["doc_id", "lang", "source", "n_chars", "toxic", "quality"]), [], ["n_variables", "n_observations", "missing_cells", "missing_cells_pct", "duplicate_rows", "duplicate_rows_pct"]),
            found(
                "automated_profiling", "auto_profile", union(profile_row(c, c in DOC_NUMBERS) for c, *_ in DOC_TYPES), ["column"],
                ["n_missing", "p_missing", "n_distinct", "mean", "std", "min", "max", "n_zeros", "n_categories"], ["type", "is_unique"],
            ),
            found("missing_data", "missing_overall", "SELECT count(*) AS n_rows, 0 AS n_cells_missing, 0.0 AS pct_missing, count(*) AS n_complete, 0 AS n_incomplete FROM fx", [], ["n_rows", "n_cells_missing", "pct_missing", "n_complete", "n_incomplete"]),
            found("missing_data", "missing_pattern", "SELECT '000000' AS pattern, count(*) AS n FROM fx", ["pattern"], ["n"]),
            found("missing_data", "missing_recommendation", "SELECT 'No missing data detected. Dataset is complete.' AS recommendation", [], [], ["recommendation"]),
            found("class_balance", "class_balance", ORACLES["b1_class_balance"], ["label"], ["n", "share", "ratio"], ["status", "advice"]),
            found("fairness_analysis", "modal_rate_parity", modal(["lang", "source"], "quality"), ["attr"], ["n_groups", "max_rate", "min_rate", "disparity"], ["level"]),
            found("fairness_analysis", "binary_parity", union(parity(c, "quality", nth(c, 1), nth(c, 0)) for c in ("lang", "source")), ["attr"], PARITY_COLUMNS, ["priv", "unpriv", "status"]),
            found(
                "fairness_analysis", "modal_group_rates",
                union(
                    f"SELECT '{c}' AS attr, {c} AS grp, sum(n) AS n_group, max(n) / sum(n) AS rate FROM (SELECT {c}, quality, count(*) AS n FROM fx GROUP BY ALL) GROUP BY {c}"
                    for c in ("lang", "source")
                ),
                ["attr", "grp"], ["n_group", "rate"],
            ),
            found("drift_risk", "variation_risk", f"SELECT \"column\", cv, cv > 2 AS risky FROM ({DOC_RISK})", ["column"], ["cv"], ["risky"]),
            found(
                "drift_risk", "drift_recommendation",
                f"SELECT count(*) FILTER (cv > 2) + 1 AS n_risks, 'Address identified risks before deployment' AS recommendation, 'No temporal columns detected - cannot assess temporal drift risk' AS notice FROM ({DOC_RISK})",
                [], ["n_risks"], ["recommendation", "notice"],
            ),
            found("overall_quality_score", "quality_score", ORACLES["q15_quality_score"], [], ["score", "penalty_missing", "penalty_dup", "penalty_imbalance", "penalty_size"], ["grade", "ready"]),
        ]
    ),
)

def proxy_rows(stage: str, operator: str, sql: str, subject: list[str], values: list[str], shares: list[str]) -> str:
    """As ``found``: values that do not hang on the model, and names of shares that do."""
    about = "concat_ws(' / ', " + ", ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in subject) + ")" if subject else "''"
    head = f"SELECT '{stage}' AS stage, '{operator}' AS operator, {about} AS subject"
    return union(
        [f"{head}, '{m}' AS metric, {r6(m)} AS value, CAST(NULL AS BOOLEAN) AS is_share FROM ({sql})" for m in values]
        + [f"{head}, '{m}' AS metric, CAST(NULL AS DOUBLE) AS value, true AS is_share FROM ({sql})" for m in shares]
    )


def tested_groups(pairs: list[tuple[str, str]]) -> str:
    return union(f"SELECT '{a}' AS attr, {g} AS grp, count(*) AS n, avg(big) AS base_rate FROM te GROUP BY 2" for a, g in pairs)


GROUP_SHARES = ["accuracy", "f1_macro", "selection_rate", "tpr", "tnr", "fpr", "fnr"]
check(
    "o1_audit_proxy", "fx_orders",
    union(
        [
            proxy_rows("imbalance", "classification_report", "SELECT big AS label, count(*) AS support FROM te GROUP BY 1", ["label"], ["support"], ["precision", "recall", "f1"]),
            proxy_rows("imbalance", "classification_summary", "SELECT 1", [], [], ["accuracy", "f1_macro", "f1_weighted"]),
            proxy_rows("imbalance", "group_metrics", tested_groups([("region", "region"), ("segment", "segment")]), ["attr", "grp"], ["n", "base_rate"], GROUP_SHARES),
            proxy_rows("imbalance", "prediction_parity", "SELECT unnest(['region', 'segment']) AS attr", ["attr"], [], ["spd"]),
            proxy_rows("target_fairness", "intersectional_group_metrics", tested_groups(AUDIT_PAIR), ["attr", "grp"], ["n", "base_rate"], GROUP_SHARES),
        ]
    ),
    f"""te AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY big ORDER BY {HASH_ORDER.format(key='o_orderkey')})
        <= round(0.25 * count(*) OVER (PARTITION BY big)))""",
)
ORACLES["o1_audit_resumed"] = ORACLES["o1_audit"]
