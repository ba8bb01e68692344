"""The given tables seen as the engine's tables, in Spark and as SQL text.

Each adapter exists twice: a function for Spark and a common table expression of the same
name and columns for the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import Rule
from ..functions import scoring
from ..operators.skew import share_out, spread

# Frequent words of the given texts as a second rule table: they exercise every part of
# the detector on prose, which real rules hardly hit.
WORD_RULES = (
    Rule("the", "CWE-78: OS Command Injection"), Rule("and", "CWE-89: SQL Injection"),
    Rule("le", "CWE-502: Insecure Deserialization"), Rule("un", "CWE-798: Hard-coded Credentials"),
    Rule("der", "CWE-327: Insecure Cryptographic Implementation"),
    Rule("que", "CWE-79: Cross-Site Scripting"), Rule("of", "CWE-22: Path Traversal"),
    Rule("Des", "CWE-330: Weak Random"), Rule("with", "CWE-200: Information Exposure"),
    Rule("Anés", "CWE-Other"), Rule("from", "CWE-89: SQL Injection"),
)
CATEGORIES = tuple(dict.fromkeys(r.cwe for r in fixed.DEFAULT_RULES))
DIFF_NAMES = (*fixed.DIFF_CATEGORIES, "plain_unknown")
TIME = "yyyy-MM-dd HH:mm:ss"
# Positions of `findings` come in stretches of this length, one per line number.
FINDING_CHUNK = 10 ** 18


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def source_files(spark: SparkSession, base: str) -> DataFrame:
    return spread(load(spark, base, "documents").select(
        "doc_id", F.col("text").alias("code"), F.col("lang").alias("language"),
        F.col("source").alias("repo")))


def parity_labelled(spark: SparkSession, base: str) -> DataFrame:
    """Every document, labelled by the parity of its id: copies contradict each other."""
    odd = F.pmod("doc_id", F.lit(2)) == 1
    return source_files(spark, base).select(
        F.col("doc_id").alias("ord"), "code", "language",
        F.when(odd, " Vulnerable").otherwise("SAFE ").alias("safety"))


def rated_labelled(spark: SparkSession, base: str) -> DataFrame:
    """Documents labelled by their quality; some have no label, some no language."""
    files, labels = source_files(spark, base), load(spark, base, "labels")
    return files.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ord"), "code",
        F.when(F.col("language") != "es", F.concat(F.lit(" "), F.upper("language")))
        .alias("language"),
        F.when(F.col("quality") == 1, "Safe ").when(F.col("quality") == 0, " VULNERABLE")
        .alias("safety"))


def _after(day: str, seconds: Column) -> Column:
    return F.lit(day).cast("timestamp") + F.make_dt_interval(secs=seconds)


def users(spark: SparkSession, base: str) -> DataFrame:
    name = F.replace(F.lower("c_name"), F.lit("#"), F.lit("."))
    return load(spark, base, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
        F.when(F.col("c_nationkey") == 3, F.concat(name, F.lit(" at example"))).otherwise(
            F.concat(name, F.lit("@example.com"))).alias("email"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"),
        _after("2020-01-01", F.col("c_custkey") * 3600).alias("created_at"),
        F.when(F.col("c_nationkey") != 0, _after("2024-01-01", F.col("c_custkey") * 61))
        .alias("last_login"),
        (F.col("c_acctbal") >= 0).cast("int").alias("is_active"))


def _scan_columns() -> list[Column]:
    return [F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
            F.concat("o_orderpriority", F.lit(" batch "), F.col("o_orderkey").cast("string"),
                     F.lit(".py")).alias("filename"),
            F.col("o_orderdate").cast("timestamp").alias("scan_time"),
            (F.col("o_orderstatus") == "P").cast("int").alias("is_deleted")]


def scan_rows(spark: SparkSession, base: str) -> DataFrame:
    """Scans without their counters."""
    return load(spark, base, "orders").select(*_scan_columns())


def scan_history(spark: SparkSession, base: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = load(spark, base, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    shares = share_out(rows, ["o_orderkey"], ["l_suppkey"]).groupBy("o_orderkey", "_salt").agg(
        F.count("*").alias("total_functions"),
        F.count_if(flag.isin("R", "A")).alias("vulnerable_count"),
        F.count_if(flag == "N").alias("safe_count"),
        F.count_if(flag == "R").alias("high_risk_count"),
        F.count_distinct("l_suppkey").alias("files_scanned"))
    names = shares.columns[2:]
    counts = shares.groupBy("o_orderkey").agg(*[F.sum(c).alias(c) for c in names])
    # The names of scans are made after the join: texts need not move.
    return load(spark, base, "orders").join(counts, "o_orderkey", "left").select(
        *_scan_columns(), *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def findings(spark: SparkSession, base: str) -> DataFrame:
    bad = F.col("l_returnflag").isin("R", "A")
    place = F.col("l_linenumber").cast("bigint")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                            (F.pmod("l_suppkey", F.lit(len(CATEGORIES))) + 1).cast("int"))
    whole = (F.col("l_quantity") + 50).cast("int")
    return load(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        (place * FINDING_CHUNK + F.col("l_partkey") * 10 ** 8 + F.pmod("l_suppkey", F.lit(10 ** 6))
         * 100 + F.col("l_quantity").cast("int")).alias("ord"),
        F.concat(F.lit("src/file_"), "l_suppkey", F.lit(".py")).alias("filename"),
        F.concat(F.lit("part_"), "l_partkey").alias("function_name"),
        (F.col("l_linenumber") * 10).alias("start_line"), bad.alias("is_vulnerable"),
        F.when(F.col("l_returnflag") == "R", "HIGH").when(bad, "MEDIUM").otherwise("SAFE")
        .alias("risk_level"),
        (whole / 100).alias("confidence"), whole.alias("confidence_percent"),
        F.when(bad, category).otherwise(fixed.NO_CWE).alias("cwe_category"),
        F.array(F.concat(F.lit("tok_"), "l_linestatus"),
                F.concat(F.lit("size_"), "l_linenumber")).alias("suspicious_tokens"),
        F.when(F.col("l_discount") == 0, 0).otherwise(F.col("l_linenumber") * 11)
        .alias("vulnerable_line_no"),
        F.concat(F.lit("call("), "l_partkey", F.lit(")")).alias("vulnerable_line_text"))


def audit_log(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.concat(F.lit("USER_"), F.upper("event_type")).alias("action"),
        F.when(F.col("event_type") == "view", "").otherwise(
            F.format_string("10.0.0.%d", "user_id")).alias("ip_address"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("details"))


def attempts(spark: SparkSession, base: str) -> DataFrame:
    """Events as login attempts of a user; an error is a failure."""
    return load(spark, base, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("failed"))


def scores(spark: SparkSession, base: str, dim: int = 1) -> DataFrame:
    """A logit of all components, as whole millionths with small whole weights, so that sums are exact."""
    parts = F.transform("embedding", lambda x, i: F.floor(x.cast("double") * 1_000_000 + 0.5)
                        * (F.pmod((i + 1) * (2 * dim + 1), F.lit(7)) - 3))
    logit = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x) / 1_000_000
    return load(spark, base, "embeddings").select(
        F.col("vec_id").alias("id"), F.bround(scoring.sigmoid(logit), 6).alias("prob"),
        (F.col("label") >= 5).cast("int").alias("label"))


def uploads(spark: SparkSession, base: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    return load(spark, base, "pages").select("page_id", bare.alias("path"))


def diff_rows(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", "bad").when(F.col("role") == "assistant", "good")
        .alias("side"),
        F.element_at(F.array(*[F.lit(c) for c in DIFF_NAMES]),
                     (F.pmod("conv_id", F.lit(len(DIFF_NAMES))) + 1).cast("int"))
        .alias("source_category"), F.col("text").alias("code"))


def scan_requests(spark: SparkSession, base: str) -> DataFrame:
    """Requests for a scan: urgent ones by the owner, low ones by somebody else."""
    asked = load(spark, base, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return asked.select(F.col("o_orderkey").alias("id"), F.when(
        F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).otherwise(
        F.col("o_custkey") + 1).alias("user_id"))


def registrations(spark: SparkSession, base: str) -> DataFrame:
    """Sign-ups: users of small events use taken names, the others a name of their own."""
    known = F.col("value") < 20
    name = F.format_string("Customer#%09d", "user_id")
    return load(spark, base, "events").where("event_type = 'signup'").select(
        F.col("event_id").alias("ord"),
        F.when(known, name).otherwise(F.format_string("new_%d", "user_id")).alias("username"),
        F.when(F.col("value") < 30, F.format_string("customer.%09d@example.com", "user_id"))
        .otherwise(F.format_string("new%d@example.com", "user_id")).alias("email"))


# The same adapters as SQL ------------------------------------------------------------

def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CTE = {
    "source_files": "SELECT doc_id, text AS code, lang AS language, source AS repo "
                    "FROM documents",
    "parity_labelled": "SELECT doc_id AS ord, text AS code, lang AS language, "
                       "CASE WHEN doc_id % 2 = 1 THEN ' Vulnerable' ELSE 'SAFE ' END AS safety "
                       "FROM documents",
    "rated_labelled": "SELECT d.doc_id AS ord, text AS code, "
                      "CASE WHEN lang <> 'es' THEN ' ' || upper(lang) END AS language, "
                      "CASE quality WHEN 1 THEN 'Safe ' WHEN 0 THEN ' VULNERABLE' END AS safety "
                      "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "users": "SELECT c_custkey AS id, c_name AS username, replace(lower(c_name), '#', '.') || "
             "CASE WHEN c_nationkey = 3 THEN ' at example' ELSE '@example.com' END AS email, "
             "CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role, "
             "make_timestamp((1577836800 + c_custkey * 3600) * 1000000) AS created_at, "
             "CASE WHEN c_nationkey <> 0 THEN make_timestamp((1704067200 + c_custkey * 61) "
             "* 1000000) END AS last_login, CAST(c_acctbal >= 0 AS INT) AS is_active "
             "FROM customer",
    "scan_rows": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority || ' batch ' "
                 "|| o_orderkey || '.py' AS filename, o_orderdate AS scan_time, "
                 "CAST(o_orderstatus = 'P' AS INT) AS is_deleted FROM orders",
    "scan_history": "SELECT s.*, coalesce(total, 0) AS total_functions, coalesce(bad, 0) AS "
                    "vulnerable_count, coalesce(good, 0) AS safe_count, coalesce(high, 0) AS "
                    "high_risk_count, coalesce(files, 0) AS files_scanned FROM scan_rows s "
                    "LEFT JOIN (SELECT l_orderkey, count(*) AS total, "
                    "count(*) FILTER (l_returnflag IN ('R', 'A')) AS bad, "
                    "count(*) FILTER (l_returnflag = 'N') AS good, "
                    "count(*) FILTER (l_returnflag = 'R') AS high, "
                    "count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1) c "
                    "ON s.id = c.l_orderkey",
    "findings": f"SELECT l_orderkey AS scan_id, l_linenumber::BIGINT * {FINDING_CHUNK} + l_partkey "
                "* 100000000 + l_suppkey % 1000000 * 100 + l_quantity::INT AS ord, 'src/file_' || l_suppkey || '.py' AS "
                "filename, 'part_' || l_partkey AS function_name, l_linenumber * 10 AS "
                "start_line, l_returnflag IN ('R', 'A') AS is_vulnerable, CASE l_returnflag "
                "WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'SAFE' END AS risk_level, "
                "(l_quantity + 50)::INT AS confidence_percent, "
                "(l_quantity + 50)::INT / 100::DOUBLE AS confidence, "
                "CASE WHEN l_returnflag IN ('R', 'A') THEN "
                f"({_listed(CATEGORIES)})[(l_suppkey % {len(CATEGORIES)} + 1)::INT] "
                "ELSE 'N/A' END AS cwe_category, ['tok_' || l_linestatus, 'size_' || "
                "l_linenumber] AS suspicious_tokens, CASE WHEN l_discount = 0 THEN 0 ELSE "
                "l_linenumber * 11 END AS vulnerable_line_no, 'call(' || l_partkey || ')' AS "
                "vulnerable_line_text FROM lineitem",
    "audit_log": "SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN user_id END AS "
                 "user_id, 'USER_' || upper(event_type) AS action, CASE WHEN event_type = "
                 "'view' THEN '' ELSE '10.0.0.' || user_id END AS ip_address, ts AS "
                 "\"timestamp\", props AS details FROM events",
    "attempts": "SELECT event_id, user_id, ts, epoch_us(ts) AS us, event_type = 'error' AS "
                "failed FROM events",
    "uploads": "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), "
               "'[?#].*$', '') AS path FROM pages",
    "diff_rows": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'bad' WHEN 'assistant' THEN "
                 f"'good' END AS side, ({_listed(DIFF_NAMES)})[(conv_id % {len(DIFF_NAMES)} + 1)"
                 "::INT] AS source_category, text AS code FROM conversations",
    "scan_requests": "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN "
                     "o_custkey ELSE o_custkey + 1 END AS user_id FROM orders WHERE "
                     "o_orderpriority IN ('1-URGENT', '5-LOW')",
    "registrations": "SELECT event_id AS ord, CASE WHEN value < 20 THEN 'Customer#' || "
                     "lpad(user_id::VARCHAR, 9, '0') ELSE 'new_' || user_id END AS username, "
                     "CASE WHEN value < 30 THEN 'customer.' || lpad(user_id::VARCHAR, 9, '0') "
                     "ELSE 'new' || user_id END || '@example.com' AS email FROM events WHERE "
                     "event_type = 'signup'",
}


def scores_cte(dim: int = 1) -> str:
    parts = ("list_transform(embedding, lambda x, i: floor(x::DOUBLE * 1000000 + 0.5)::BIGINT * "
             f"((i * {2 * dim + 1}) % 7 - 3))")
    return (f"SELECT vec_id AS id, round_even(1::DOUBLE / (1::DOUBLE + exp(-(list_sum({parts})::BIGINT::DOUBLE "
            "/ 1000000::DOUBLE))), 6) AS prob, CAST(label >= 5 AS INT) AS label FROM embeddings")


CTE["scores"] = scores_cte()
NEEDS = {"scan_history": ("scan_rows",)}


def with_ctes(needs, body: str, **more: str) -> str:
    """`WITH` clause from adapter names and further named steps, then the body."""
    names: dict[str, str] = {}
    for need in needs:
        for name in (*NEEDS.get(need, ()), need):
            names[name] = CTE[name]
    names |= more
    if not names:
        return body
    recursive = "RECURSIVE " if any("UNION ALL" in s and f"FROM {n}" in s
                                    for n, s in more.items()) else ""
    return ("WITH " + recursive + ", ".join(
        f"{n} AS {'MATERIALIZED ' if n == 'low' else ''}({s})" for n, s in names.items())
            + " " + body)


def rule_ctes(rules=fixed.DEFAULT_RULES) -> dict[str, str]:
    """Rule table and hits as SQL steps; word ends are spelled out in constant patterns."""
    word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    rows, hits = [], []
    for i, rule in enumerate(rules):
        token = rule.token.lower()
        body = "".join("\\" + c if c in ".(" else c for c in token)
        end = token[-1].isalnum() or token[-1] == "_"
        pattern = f"(^|{other}){body}" + (f"($|{other})" if end else word)
        rows.append(f"({i}, '{rule.token}', '{rule.cwe}')")
        hits.append(f"SELECT doc_id, {i} AS rank FROM low WHERE CASE WHEN contains(low, "
                    f"'{token}') THEN regexp_matches(low, '{pattern}') ELSE false END")
    return {
        "rules": "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(rank, token, cwe)",
        "low": "SELECT doc_id, lower(text) AS low FROM documents",
        "hits": "SELECT h.doc_id, r.* FROM (" + " UNION ALL ".join(hits)
                + ") h JOIN rules r ON h.rank = r.rank"}


VERDICT = ("SELECT d.doc_id, d.source AS repo, d.lang, d.text AS code, "
           "coalesce(n_hits, 0) AS n_hits, coalesce(n_hits, 0) > 0 AS is_vulnerable, "
           "coalesce(cwe, 'N/A') AS cwe_category, first_token, hits, "
           "CASE WHEN n_hits > 0 THEN 'HIGH' ELSE 'SAFE' END AS risk_level FROM documents d "
           "LEFT JOIN (SELECT doc_id, count(*) AS n_hits, arg_min(cwe, rank) AS cwe, "
           "arg_min(token, rank) AS first_token, string_agg(token, ',' ORDER BY rank) AS hits "
           "FROM hits GROUP BY doc_id) h ON d.doc_id = h.doc_id")

_WS = r"[\s\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def clean_sql(x: str) -> str:
    unified = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    return strip_sql(f"regexp_replace({unified}, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')")


def no_blank_sql(x: str) -> str:
    return (f"list_filter(string_split({x}, chr(10)), lambda l: "
            r"regexp_matches(l, '[^\s\p{Z}]'))")


def hash_comments_sql(x: str) -> str:
    return f"array_to_string({no_blank_sql(f'''regexp_replace({x}, '#[^\\n]*', '', 'g')''')}, chr(10))"


STRINGS_SQL = (r'"""[\s\S]*?"""|' + r"''''''[\s\S]*?''''''|" + r'"[^\n"\\]*(?:\\.[^\n"\\]*)*"|'
               + r"''[^\n''\\]*(?:\\.[^\n''\\]*)*''")
NUMBERS_SQL = r"\b\d+(\.\d+)?([eE][+-]?\d+)?\b"


def mask_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '{STRINGS_SQL}', '<STR>', 'g'), "
            f"'{NUMBERS_SQL}', '<NUM>', 'g')")


TOKENS_SQL = r"<[A-Z_]+>|[\p{L}\p{N}_]+|[^\s\p{Z}\p{L}\p{N}_]"


def normal_sql(x: str = "text") -> str:
    return mask_sql(hash_comments_sql(clean_sql(x)))


CLEANED = ("SELECT ord, CASE trim(lower(safety)) WHEN 'vulnerable' THEN 1 ELSE 0 END AS label, "
           f"lower(trim(coalesce(language, 'Other'))) AS language, {clean_sql('code')} AS c "
           "FROM {src} WHERE code IS NOT NULL AND safety IS NOT NULL AND "
           "trim(lower(safety)) IN ('vulnerable', 'safe')")
HASHED = "SELECT ord, label, language, c, sha256(c) AS code_hash FROM cleaned WHERE length(c) > 10"


def clean_ctes(src: str) -> dict[str, str]:
    return {"cleaned": CLEANED.replace("{src}", src), "hashed": HASHED}


RESOLVED = ("SELECT * FROM hashed WHERE ord IN (SELECT min(ord) FROM hashed GROUP BY code_hash "
            "HAVING min(label) = max(label))")
