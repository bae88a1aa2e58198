"""SQL statements as text."""

import datetime

import pytest


from palimpsest import RepeatedSourceKey, Table, UnknownStatement, UnknownVersion, create_or_replace, history, run_sql

from .conftest import rows

STAFF = [(1, "Ana", "DevOps", 100.0), (2, "Bia", "Produto", 200.0), (3, None, "DevOps", None), (4, "Caio", None, 50.0)]


@pytest.fixture
def run(spark, root):
    staff = spark.createDataFrame(STAFF, "id bigint, name string, dept string, pay double")
    create_or_replace(staff, Table(spark, root, "lake", "staff"), partition_by=["dept"])
    other = spark.createDataFrame([(1, "x", 5.0), (2, "y", None)], "id bigint, name string, bonus double")
    create_or_replace(other, Table(spark, root, "side", "extra"))
    return lambda text: run_sql(spark, root, "lake", text)


def now(run, text="SELECT id, name, dept, pay FROM staff"):
    return rows(run(text))


def test_update_and_delete(run):
    assert rows(run("UPDATE lake.staff AS f SET f.pay = pay * 2, name = upper(f.name) WHERE f.dept = 'DevOps'")) == [(2,)]
    assert now(run) == rows_of((1, "ANA", "DevOps", 200.0), STAFF[1], (3, None, "DevOps", None), STAFF[3])
    run("update staff set pay = DEFAULT, dept = 'none' where staff.dept is null -- the rest stays")
    assert (4, "Caio", "none", None) in now(run)
    run("DELETE FROM staff WHERE pay > 150")
    assert [r[0] for r in now(run)] == [3, 4]
    run("DELETE FROM any_catalog.lake.staff")
    assert now(run) == []


def rows_of(*wanted):
    return sorted(wanted, key=repr)


def test_conditions_with_subqueries(run):
    run("UPDATE staff SET pay = 0 WHERE id IN (SELECT id FROM side.extra WHERE bonus IS NULL)")
    assert (2, "Bia", "Produto", 0.0) in now(run)
    run("UPDATE staff SET pay = (SELECT max(bonus) FROM side.extra) WHERE EXISTS (SELECT 1 FROM side.extra e WHERE e.id = staff.id)")
    assert {(r[0], r[3]) for r in now(run)} == {(1, 5.0), (2, 5.0), (3, None), (4, 50.0)}
    run("DELETE FROM staff s WHERE s.id NOT IN (SELECT id FROM staff VERSION AS OF 1 WHERE dept = 'DevOps')")
    assert [r[0] for r in now(run)] == [1, 3]


def test_time_travel(run, spark, root):
    run("DELETE FROM staff WHERE id = 1")
    run("UPDATE staff SET pay = 1 WHERE id = 2")
    assert now(run, "SELECT count(*) FROM staff VERSION AS OF 1") == [(4,)]
    assert now(run, "SELECT staff.id FROM lake.staff FOR SYSTEM_VERSION AS OF 2 WHERE staff.pay > 100") == [(2,)]
    both = "WITH staff AS (SELECT * FROM staff VERSION AS OF 1) SELECT o.id, n.id FROM staff o LEFT JOIN lake.staff AS n ON o.id = n.id"
    assert now(run, both) == rows_of((1, None), (2, 2), (3, 3), (4, 4))
    made = {r["version"]: r["made_current_at"] for r in history(Table(spark, root, "lake", "staff")).collect()}
    after_two = made[2] + datetime.timedelta(microseconds=1)
    assert now(run, f"SELECT count(*), max(pay) FROM staff TIMESTAMP AS OF '{after_two}'") == [(3, 200.0)]
    with pytest.raises(UnknownVersion):
        run("SELECT * FROM staff TIMESTAMP AS OF '2001-01-01'")
    with pytest.raises(UnknownVersion):
        run("SELECT * FROM staff VERSION AS OF 9")


def test_names_in_texts_are_left_alone(run):
    text = "SELECT 'staff VERSION AS OF 1 🙂' AS a, x.staff FROM (SELECT id AS staff FROM staff /* staff */ WHERE id = 1) x"
    assert now(run, text) == [("staff VERSION AS OF 1 🙂", 1)]
    assert now(run, "SELECT a.id FROM staff a JOIN staff b ON a.id = b.id + 3") == [(4,)]
    assert now(run, "SELECT id FROM staff TABLESAMPLE (100 PERCENT) WHERE id = 4") == [(4,)]


def test_merge(run):
    run(
        "MERGE INTO staff AS s USING (SELECT id, name, bonus FROM side.extra UNION ALL SELECT 9, 'new', 7.0) AS t ON t.id = s.id "
        "WHEN MATCHED AND t.bonus IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET s.pay = s.pay + t.bonus, name = concat(s.name, t.name) "
        "WHEN NOT MATCHED THEN INSERT (id, name, pay) VALUES (t.id, t.name, t.bonus) "
        "WHEN NOT MATCHED BY SOURCE AND s.dept IS NULL THEN UPDATE SET dept = 'left'"
    )
    assert now(run) == rows_of((1, "Anax", "DevOps", 105.0), (3, None, "DevOps", None), (4, "Caio", "left", 50.0), (9, "new", None, 7.0))
    run("MERGE INTO staff USING (SELECT * FROM lake.staff VERSION AS OF 1) AS old ON staff.id = old.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    assert now(run) == rows_of(*STAFF, (9, "new", None, 7.0))


def test_merge_on_a_range(run):
    run(
        "MERGE INTO staff USING (SELECT 60.0 AS low, 150.0 AS high, 'mid' AS grade UNION ALL SELECT 150.5, 1000, 'top') g "
        "ON staff.pay BETWEEN g.low AND g.high AND staff.dept <> g.grade WHEN MATCHED THEN UPDATE SET name = g.grade"
    )
    assert {(r[0], r[1]) for r in now(run)} == {(1, "mid"), (2, "top"), (3, None), (4, "Caio")}
    with pytest.raises(RepeatedSourceKey):
        run("MERGE INTO staff USING side.extra e ON staff.pay > e.id WHEN MATCHED THEN UPDATE SET name = e.name")
    with pytest.raises(ValueError, match="equality or a range"):
        run("MERGE INTO staff USING side.extra e ON staff.pay <> e.id WHEN MATCHED THEN DELETE")


def test_insert_and_columns(run):
    run("INSERT INTO staff VALUES (5, 'Davi', 'Ops', 1.5)")
    run("INSERT INTO staff (pay, id) SELECT bonus, id + 10 FROM side.extra")
    assert {(5, "Davi", "Ops", 1.5), (11, None, None, 5.0), (12, None, None, None)} <= set(now(run))
    run("ALTER TABLE staff ADD COLUMNS (since date, level int)")
    run("ALTER TABLE staff RENAME COLUMN level TO grade")
    run("ALTER TABLE staff DROP COLUMN since")
    run("INSERT INTO staff BY NAME SELECT 20 AS id, 3 AS grade")
    assert now(run, "SELECT id, grade FROM staff WHERE grade IS NOT NULL") == [(20, 3)]
    with pytest.raises(ValueError, match="3 values for"):
        run("INSERT INTO staff VALUES (1, 2, 3)")


@pytest.mark.parametrize(
    "text",
    ["SHOW TABLES", "DROP TABLE staff", "INSERT OVERWRITE staff VALUES (1, 'a', 'b', 2.0)", "TRUNCATE TABLE staff", "CREATE TABLE x AS SELECT * FROM staff"],
)
def test_other_statements_are_refused(run, text):
    with pytest.raises(UnknownStatement):
        run(text)
    assert len(now(run)) == 4


def test_unknown_tables_and_conditions_that_change(run):
    with pytest.raises(LookupError):
        run("DELETE FROM nothing")
    with pytest.raises(ValueError, match="clock"):
        run("DELETE FROM staff WHERE now() > timestamp'2001-01-01'")
    with pytest.raises(ValueError, match="same answer"):
        run("DELETE FROM staff WHERE rand() < 0.5 OR id IN (SELECT id FROM side.extra)")
    assert now(run, "SELECT count(*) FROM range(7)") == [(7,)]


def test_views_do_not_stay(run, spark):
    run("SELECT * FROM staff").collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("palimpsest_")]
