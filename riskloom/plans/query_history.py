"""Registered queries: history, audit, maintenance, limiter, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import checks, scoring, text
from ..operators import history, limits, maintain
from . import tables as t
from .registry import query

# Limits scaled to the given events, which are hours apart per user, not seconds.
LIMIT_SECONDS = EXPIRY_SECONDS = 12 * 3600
LIMIT_FAILURES = 2


def _at(column, pattern=t.TIME):
    return F.date_format(column, pattern)


def _at_sql(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


@query("users_scan_count", t.with_ctes(("users", "scan_rows"), (
    "SELECT u.id, u.username, count(s.id) AS scan_count FROM users u LEFT JOIN scan_rows s ON "
    "s.user_id = u.id AND s.is_deleted = 0 GROUP BY u.id, u.username")))
def users_scan_count(spark, base):
    return history.users_with_scan_count(t.users(spark, base), t.scan_rows(spark, base)).select(
        "id", "username", "scan_count")


NEWEST = ("SELECT a.*, u.username FROM audit_log a LEFT JOIN users u ON u.id = a.user_id "
          "ORDER BY \"timestamp\" DESC, a.id DESC LIMIT 50")


@query("recent_audit", t.with_ctes(("audit_log", "users"), (
    f"SELECT id, action, username, {_at_sql('\"timestamp\"')} AS ts FROM newest"), newest=NEWEST))
def recent_audit(spark, base):
    return history.audit_with_user(t.audit_log(spark, base), t.users(spark, base)).select(
        "id", "action", "username", _at("timestamp").alias("ts"))


@query("audit_display", t.with_ctes(("audit_log", "users"), (
    f"SELECT id, {_at_sql('\"timestamp\"')}[:16] AS at, coalesce(nullif(username, ''), "
    "'Anonymous') AS username, action, replace(lower(action), '_', '-') AS slug, "
    "coalesce(nullif(ip_address, ''), 'N/A') AS ip_address, coalesce(nullif(details, ''), '--') "
    "AS details FROM newest"), newest=NEWEST))
def audit_display(spark, base):
    return history.audit_display(t.audit_log(spark, base), t.users(spark, base))


@query("users_display", t.with_ctes(("users",), (
    "SELECT id, upper(role[1]) || role[2:] AS role_title, coalesce("
    f"{_at_sql('last_login')}[:16], 'Never') AS last_seen FROM users")))
def users_display(spark, base):
    return history.users_display(t.users(spark, base)).select("id", "role_title", "last_seen")


@query("system_stats", t.with_ctes(("users", "scan_history"), (
    "SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM scan_history WHERE "
    "is_deleted = 0) AS total_scans, (SELECT sum(vulnerable_count)::BIGINT FROM scan_history "
    "WHERE is_deleted = 0) AS total_vulnerabilities")))
def system_stats(spark, base):
    return history.system_stats(t.users(spark, base), t.scan_history(spark, base))


@query("user_scan_stats", t.with_ctes(("scan_history",), (
    "SELECT user_id, count(*) AS total_scans, sum(vulnerable_count)::BIGINT AS total_vulns, "
    f"{_at_sql('max(scan_time)')} AS last_scan_date FROM scan_history WHERE is_deleted = 0 "
    "GROUP BY 1")))
def user_scan_stats(spark, base):
    return history.user_scan_stats(t.scan_history(spark, base)).withColumn(
        "last_scan_date", _at("last_scan_date"))


@query("recent_scans", t.with_ctes(("scan_rows",), (
    f"SELECT user_id, rn::INT AS rn, id, {_at_sql('scan_time')} AS scan_time FROM (SELECT *, "
    "row_number() OVER (PARTITION BY user_id ORDER BY scan_time DESC, id DESC) AS rn FROM "
    "scan_rows WHERE is_deleted = 0) WHERE rn <= 10")))
def recent_scans(spark, base):
    return history.recent_scans(t.scan_rows(spark, base)).select(
        "user_id", "rn", "id", _at("scan_time").alias("scan_time"))


@query("recent_user_audit", t.with_ctes(("audit_log",), (
    "SELECT user_id, rn::INT AS rn, id, action FROM (SELECT *, row_number() OVER (PARTITION BY "
    "user_id ORDER BY \"timestamp\" DESC, id DESC) AS rn FROM audit_log WHERE user_id IS NOT NULL"
    ") WHERE rn <= 10")))
def recent_user_audit(spark, base):
    return history.recent_user_audit(t.audit_log(spark, base)).select(
        "user_id", "rn", "id", "action")


@query("scan_trend", t.with_ctes(("scan_history",), (
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS point, CASE "
    "WHEN length(filename) > 20 THEN filename[:20] || '...' ELSE filename END AS name, "
    "vulnerable_count, greatest(total_functions, 1) AS total_functions, round_even("
    "vulnerable_count / greatest(total_functions, 1)::DOUBLE * 100, 4) AS percent FROM (SELECT *, "
    "row_number() OVER (PARTITION BY user_id ORDER BY scan_time DESC, id DESC) AS rn FROM "
    "scan_history WHERE is_deleted = 0) WHERE rn <= 5")))
def scan_trend(spark, base):
    return history.scan_trend(t.scan_history(spark, base))


@query("scan_badge", t.with_ctes(("scan_history",), (
    "SELECT id, CASE WHEN high_risk_count > 0 THEN 'HIGH' WHEN vulnerable_count > 0 THEN 'MEDIUM' "
    "ELSE 'CLEAN' END AS badge FROM scan_history")))
def scan_badge(spark, base):
    return t.scan_history(spark, base).select("id", scoring.scan_badge(
        F.col("high_risk_count"), F.col("vulnerable_count")).alias("badge"))


@query("owned_scans", t.with_ctes(("scan_rows", "scan_requests"), (
    "SELECT s.id, s.user_id, s.filename FROM scan_rows s JOIN scan_requests r ON r.id = s.id AND "
    "r.user_id = s.user_id WHERE s.is_deleted = 0")))
def owned_scans(spark, base):
    return history.owned_scans(t.scan_rows(spark, base), t.scan_requests(spark, base)).select(
        "id", "user_id", "filename")


@query("users_by_key", t.with_ctes(("users",), (
    "SELECT id, username, email FROM users WHERE email IN (SELECT 'customer.' || "
    "lpad(user_id::VARCHAR, 9, '0') || '@example.com' FROM events)")))
def users_by_key(spark, base):
    keys = t.load(spark, base, "events").select(
        F.format_string("customer.%09d@example.com", "user_id").alias("email")).distinct()
    return history.rows_by_key(t.users(spark, base), keys, ["email"]).select(
        "id", "username", "email")


@query("action_counts", t.with_ctes(("audit_log",), (
    "SELECT coalesce(day, 'all') AS day, coalesce(action, 'all') AS action, count(*) AS n FROM "
    "(SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, action FROM audit_log) "
    "GROUP BY ROLLUP (day, action)")))
def action_counts(spark, base):
    return history.action_counts(t.audit_log(spark, base))


@query("unique_violations", t.with_ctes(("registrations", "users"), (
    "SELECT id, username, taken, repeated FROM (SELECT r.ord AS id, r.username, coalesce(u.id <> "
    "r.ord, false) AS taken, n > 1 AS repeated FROM registrations r LEFT JOIN users u ON "
    "u.username = r.username JOIN (SELECT username, count(*) AS n FROM registrations GROUP BY 1) c "
    "ON c.username = r.username) WHERE taken OR repeated")))
def unique_violations(spark, base):
    batch = t.registrations(spark, base).select(F.col("ord").alias("id"), "username")
    return history.unique_violations(batch, t.users(spark, base), "username").select(
        "id", "username", "taken", "repeated")


# Maintenance -------------------------------------------------------------------------

@query("new_users", t.with_ctes(("registrations", "users"), (
    "SELECT ord, username, email, 'user' AS role, 1 AS is_active FROM named WHERE ord IN (SELECT "
    "min(ord) FROM named GROUP BY email)"),
    free="SELECT * FROM registrations WHERE username NOT IN (SELECT username FROM users) AND email "
         "NOT IN (SELECT email FROM users)",
    named="SELECT * FROM free WHERE ord IN (SELECT min(ord) FROM free GROUP BY username)"))
def new_users(spark, base):
    return maintain.new_users(t.registrations(spark, base), t.users(spark, base)).select(
        "ord", "username", "email", "role", "is_active")


@query("apply_updates", t.with_ctes(("users",), (
    f"SELECT u.id, coalesce(n, u.username) AS username, {_at_sql('coalesce(l, u.last_login)')} AS "
    "last_login FROM users u LEFT JOIN (SELECT user_id, arg_max('renamed_' || event_id, event_id) "
    "FILTER (event_type = 'signup') AS n, arg_max(ts, event_id) FILTER (event_type = 'view') AS l "
    "FROM events GROUP BY 1) c ON c.user_id = u.id")))
def apply_updates(spark, base):
    kind = F.col("event_type")
    changes = t.load(spark, base, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.concat(F.lit("renamed_"), "event_id")).alias("username"),
        F.when(kind == "view", F.col("ts").cast("timestamp")).alias("last_login"))
    out = maintain.apply_updates(t.users(spark, base), changes, ["username", "last_login"])
    return out.select("id", "username", _at("last_login").alias("last_login"))


@query("toggle_flag", t.with_ctes(("users",), (
    "SELECT u.id, ((u.is_active + coalesce(n, 0)) % 2)::INT AS is_active FROM users u LEFT JOIN "
    "(SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND user_id <> 7 GROUP "
    "BY 1) c ON c.user_id = u.id")))
def toggle_flag(spark, base):
    asked = t.load(spark, base, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("id"), F.lit(7).alias("admin_id"))
    return maintain.toggle_flag(t.users(spark, base), asked).select("id", "is_active")


@query("soft_delete", t.with_ctes(("scan_rows", "scan_requests"), (
    "SELECT s.id, CASE WHEN r.id IS NOT NULL THEN 1 ELSE is_deleted END AS is_deleted, r.id IS NOT "
    "NULL AS matched FROM scan_rows s LEFT JOIN scan_requests r ON r.id = s.id AND r.user_id = "
    "s.user_id")))
def soft_delete(spark, base):
    return maintain.soft_delete(t.scan_rows(spark, base), t.scan_requests(spark, base)).select(
        "id", "is_deleted", "matched")


# Time --------------------------------------------------------------------------------

@query("trailing_count", t.with_ctes(("attempts",), (
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN "
    f"{LIMIT_SECONDS * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n_recent FROM attempts")))
def trailing_count(spark, base):
    return limits.trailing_count(t.attempts(spark, base), "user_id", "ts", LIMIT_SECONDS).select(
        "event_id", "n_recent")


@query("rate_limit", t.with_ctes(("attempts",), (
    "SELECT event_id, user_id, blocked, remaining FROM steps WHERE rn > 0"),
    numbered="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM "
             "attempts",
    steps="SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, false AS blocked, "
          "0 AS remaining, []::BIGINT[] AS recent FROM (SELECT DISTINCT user_id FROM attempts) UNION ALL SELECT "
          "user_id, rn, event_id, len(kept) >= "
          f"{LIMIT_FAILURES}, ({LIMIT_FAILURES} - len(kept))::INT, CASE WHEN failed AND len(kept) < {LIMIT_FAILURES} THEN "
          "list_append(kept, us) ELSE kept END FROM (SELECT n.user_id, n.rn, n.event_id, n.failed, "
          "n.us, list_filter(s.recent, lambda x: n.us - x < "
          f"{LIMIT_SECONDS * 1_000_000}) AS kept FROM steps s JOIN numbered n ON n.user_id = "
          "s.user_id AND n.rn = s.rn + 1)"))
def rate_limit(spark, base):
    return limits.rate_limit(t.attempts(spark, base), "user_id", "ts", "failed", "event_id",
                             LIMIT_SECONDS, LIMIT_FAILURES).select(
        "event_id", "user_id", "blocked", "remaining")


@query("action_windows", t.with_ctes(("audit_log",), (
    f"SELECT {_at_sql('time_bucket(INTERVAL 15 MINUTES, \"timestamp\")')} AS window_start, action, "
    "count(*) AS n FROM audit_log GROUP BY 1, 2")))
def action_windows(spark, base):
    return limits.action_windows(t.audit_log(spark, base), "timestamp", "action").withColumn(
        "window_start", _at("window_start"))


@query("idle_sessions", t.with_ctes(("attempts",), (
    "SELECT user_id, session::BIGINT AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "
    "session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS "
    f"n_events, coalesce(bool_or(gap < {fixed.SESSION_SECONDS * 1_000_000} AND gap >= "
    f"{fixed.SESSION_WARNING_SECONDS * 1_000_000}), false) AS warned FROM (SELECT *, sum(CASE WHEN "
    f"gap IS NULL OR gap >= {fixed.SESSION_SECONDS * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION "
    "BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps) "
    "GROUP BY 1, 2"),
    gaps="SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM "
         "attempts"))
def idle_sessions(spark, base):
    fine = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    out = limits.idle_sessions(t.attempts(spark, base), "user_id", "ts")
    return out.withColumns({c: _at(c, fine) for c in ("session_start", "session_end")})


@query("token_expiry", t.with_ctes((), (
    "SELECT u.event_id, u.user_id, coalesce(epoch_us(u.ts) - max(epoch_us(r.ts)) < "
    f"{EXPIRY_SECONDS * 1_000_000}, false) AS is_valid, CASE WHEN epoch_us(u.ts) - "
    f"max(epoch_us(r.ts)) < {EXPIRY_SECONDS * 1_000_000} THEN (epoch_us(u.ts) - "
    "max(epoch_us(r.ts))) // 1000000 END AS age_seconds FROM (SELECT * FROM events WHERE "
    "event_type = 'purchase') u LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON "
    "r.user_id = u.user_id AND r.ts <= u.ts GROUP BY u.event_id, u.user_id, u.ts")))
def token_expiry(spark, base):
    events = t.load(spark, base, "events").select("event_id", "user_id", "event_type", "ts")
    return limits.token_expiry(events.where("event_type = 'signup'"),
                               events.where("event_type = 'purchase'"), "user_id", "ts",
                               "event_id", EXPIRY_SECONDS)


# Checks ------------------------------------------------------------------------------

CANDIDATES = ("SELECT p_partkey, kind, v FROM (SELECT p_partkey, p_name AS a, p_type || p_size AS "
              "b, p_name || p_brand AS c FROM part) UNPIVOT (v FOR kind IN (a, b, c))")


def _candidates(spark, base):
    wide = t.load(spark, base, "part").select(
        "p_partkey", F.col("p_name").alias("a"), F.concat("p_type", "p_size").alias("b"),
        F.concat("p_name", "p_brand").alias("c"))
    return wide.unpivot(["p_partkey"], ["a", "b", "c"], "kind", "v")


SPECIAL = "[!@#$%^&*()_+\\-=\\[\\]{};'':\",.<>?/|`~]"
TESTS = ("length(v) >= 8", "regexp_matches(v, '[A-Z]')", "regexp_matches(v, '[a-z]')",
         "regexp_matches(v, '[0-9]')", f"regexp_matches(v, '{SPECIAL}')")


@query("rule_validation", t.with_ctes((), (
    "SELECT p_partkey, kind, " + " AND ".join(TESTS) + " AS is_valid, CASE " + " ".join(
        f"WHEN NOT {test} THEN '{message}'"
        for test, (_, message) in zip(TESTS, fixed.PASSWORD_RULES))
    + f" ELSE '{fixed.PASSWORD_OK}' END AS message FROM candidates"), candidates=CANDIDATES))
def rule_validation(spark, base):
    failure = checks.first_failure(F.col("v"))
    return _candidates(spark, base).select(
        "p_partkey", "kind", failure.isNull().alias("is_valid"),
        F.coalesce(failure, F.lit(fixed.PASSWORD_OK)).alias("message"))


@query("rule_score", t.with_ctes((), (
    "SELECT p_partkey, kind, score, ['Very Weak', 'Very Weak', 'Weak', 'Fair', 'Strong', "
    "'Very Strong'][score + 1] AS strength FROM (SELECT *, (" + " + ".join(
        f"CAST({test} AS INT)" for test in TESTS) + ")::INT AS score FROM candidates)"),
    candidates=CANDIDATES))
def rule_score(spark, base):
    scored = _candidates(spark, base).withColumn("score", checks.rules_met(F.col("v")))
    return scored.select("p_partkey", "kind", "score",
                         checks.strength_label(F.col("score")).alias("strength"))


@query("format_checks", t.with_ctes(("users",), (
    "SELECT id, regexp_matches(n, '^[A-Za-z0-9_]+$') AND length(n) BETWEEN 3 AND 20 AS valid_name, "
    r"regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS valid_email FROM (SELECT id, email, "
    "CASE WHEN role = 'admin' THEN username ELSE replace(username, '#', '_') END AS n FROM users)")
))
def format_checks(spark, base):
    people = t.users(spark, base)
    name = F.when(F.col("role") == "admin", F.col("username")).otherwise(
        F.replace("username", F.lit("#"), F.lit("_")))
    return people.select("id", checks.valid_username(name).alias("valid_name"),
                         checks.valid_email(F.col("email")).alias("valid_email"))


@query("client_address", (
    "SELECT event_id, CASE event_type WHEN 'click' THEN '10.0.0.' || user_id WHEN 'view' THEN "
    "'127.0.0.1' ELSE '192.168.0.' || user_id END AS address FROM events"))
def client_address(spark, base):
    kind = F.col("event_type")
    forwarded = F.when(kind == "click", F.format_string(" 10.0.0.%d , 172.16.0.1", "user_id"))
    remote = F.when(kind != "view", F.format_string("192.168.0.%d", "user_id")).otherwise("")
    return t.load(spark, base, "events").select(
        "event_id", text.client_address(forwarded, remote).alias("address"))
