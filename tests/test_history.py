"""History analytics and maintenance on small tables."""

from pyspark.sql import functions as F

from riskloom.operators import history, maintain


def people(spark):
    return spark.createDataFrame(
        [(1, "ann", "a@x.y", "user", "2024-01-01", None, 1),
         (2, "bob", "b@x.y", "admin", "2024-01-02", "2024-03-01 10:11:12", 0)],
        "id long, username string, email string, role string, created_at string, "
        "last_login string, is_active int")


def scans(spark):
    return spark.createDataFrame(
        [(1, 1, "a.py", "2024-01-01", 4, 2, 1, 0), (2, 1, "b.py", "2024-01-02", 0, 0, 0, 0),
         (3, 1, "c.py", "2024-01-02", 5, 1, 0, 1)],
        "id long, user_id long, filename string, scan_time string, total_functions int, "
        "vulnerable_count int, high_risk_count int, is_deleted int")


def test_counts_keep_users_without_scans(spark):
    rows = history.users_with_scan_count(people(spark), scans(spark)).collect()
    assert [(r["username"], r["scan_count"]) for r in rows] == [("bob", 0), ("ann", 2)]


def test_stats_and_recent(spark):
    assert history.user_scan_stats(scans(spark)).first()["total_vulns"] == 2
    assert history.system_stats(people(spark), scans(spark)).first().asDict() == {
        "total_users": 2, "total_scans": 2, "total_vulnerabilities": 2}
    assert history.system_stats(people(spark), scans(spark).where("id > 9")).first()[2] == 0
    assert [r["id"] for r in history.recent_scans(scans(spark), 1).collect()] == [2]
    trend = history.scan_trend(scans(spark)).orderBy("point").collect()
    assert [(r["name"], r["total_functions"], r["percent"]) for r in trend] == [
        ("a.py", 4, 50.0), ("b.py", 1, 0.0)]
    board = history.user_dashboard(scans(spark))
    assert {r["id"]: r["badge"] for r in board["recent"].collect()} == {1: "HIGH", 2: "CLEAN"}


def test_owned(spark):
    asked = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (3, 1)], "id long, user_id long")
    assert [r["id"] for r in history.owned_scans(scans(spark), asked).collect()] == [1]
    gone = maintain.soft_delete(scans(spark), asked).orderBy("id").collect()
    assert [(r["is_deleted"], r["matched"]) for r in gone] == [(1, True), (0, False), (1, True)]


def test_audit_display(spark):
    log = spark.createDataFrame(
        [(1, None, "LOGIN_FAILURE", "", "2024-01-01 10:00:00", None),
         (2, 2, "SCAN", "1.1.1.1", "2024-01-01 10:00:00", "x")],
        "id long, user_id long, action string, ip_address string, timestamp string, "
        "details string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    rows = history.audit_display(log, people(spark)).collect()
    assert [tuple(r) for r in rows] == [
        (2, "2024-01-01 10:00", "bob", "SCAN", "scan", "1.1.1.1", "x"),
        (1, "2024-01-01 10:00", "Anonymous", "LOGIN_FAILURE", "login-failure", "N/A", "--")]
    totals = {(r["day"], r["action"]): r["n"] for r in history.action_counts(log).collect()}
    assert totals[("all", "all")] == 2 and totals[("2024-01-01", "SCAN")] == 1
    unknown = log.withColumns({"action": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("timestamp")})
    rows = [tuple(r) for r in history.action_counts(log.unionByName(unknown)).collect()]
    assert sorted(rows, key=repr) == sorted([
        ("all", "all", 4), ("2024-01-01", "all", 2), (None, "all", 2), ("2024-01-01", "SCAN", 1),
        ("2024-01-01", "LOGIN_FAILURE", 1), (None, None, 2)], key=repr)


def test_new_users_and_violations(spark):
    batch = spark.createDataFrame(
        [(1, "ann", "n1@x.y"), (2, "cy", "b@x.y"), (3, "cy", "c@x.y"), (4, "dee", "c@x.y"),
         (5, "cy", "z@x.y"), (6, "eve", "e@x.y")], "ord long, username string, email string")
    rows = maintain.new_users(batch, people(spark)).orderBy("ord").collect()
    assert [(r["ord"], r["role"], r["is_active"]) for r in rows] == [(3, "user", 1), (6, "user", 1)]
    asked = spark.createDataFrame([(1, "ann"), (3, "ann"), (4, "cy"), (5, "cy"), (6, "dee"),
                                   (2, "bob")], "id long, username string")
    bad = history.unique_violations(asked, people(spark), "username").orderBy("id").collect()
    assert [(r["id"], r["taken"], r["repeated"]) for r in bad] == [
        (1, False, True), (3, True, True), (4, False, True), (5, False, True)]


def test_updates_and_toggle(spark):
    changes = spark.createDataFrame([(1, 1, "x", None), (1, 2, "y", None), (2, 1, None, "t")],
                                    "id long, seq long, username string, last_login string")
    rows = maintain.apply_updates(people(spark), changes, ["username", "last_login"])
    assert [(r["username"], r["last_login"]) for r in rows.orderBy("id").collect()] == [
        ("y", None), ("bob", "t")]
    asked = spark.createDataFrame([(1, 2), (1, 2), (1, 2), (2, 2), (9, 2)],
                                  "id long, admin_id long")
    got = maintain.toggle_flag(people(spark), asked).orderBy("id").collect()
    assert [r["is_active"] for r in got] == [0, 0]
