"""DDL texts with quotes, comments, brackets and references on literal rows, and from files."""

from pyspark.sql import functions as F

from rippleset.operators import ddl

TEXT = """-- first; CREATE TABLE no (x INT);
CREATE TABLE IF NOT EXISTS `bank`.`Accounts` (
  id VARCHAR(36) PRIMARY KEY,  -- CHECKING, SAVINGS
  amount DECIMAL(15, 2) NOT NULL DEFAULT 0.00,
  note TEXT DEFAULT 'a, (b; it''s', /* x, */
  "owner" INT REFERENCES people (id),
  index_no INT,
  INDEX by_amount (amount, note), KEY (note),
  CONSTRAINT k FOREIGN KEY (a, b) REFERENCES public.other(x, y),
  PRIMARY KEY (id, amount), CHECK (amount > 0)
) ENGINE=InnoDB;
create temporary table People (id int, boss int, foreign key (boss) references people(id));
/* CREATE TABLE gone (x INT); */ ALTER TABLE People ADD COLUMN x INT; CREATE TABLE other (x INT)"""


def test_definitions(spark):
    df = spark.createDataFrame([("a.sql", TEXT), ("b.sql", None), ("c.sql", ""), ("d.sql", "CREATE TABLE broken (x INT")], "path string, content string")
    got = {r["table_name"]: r for r in ddl.table_definitions(df).collect()}
    assert set(got) == {"Accounts", "People", "other"}
    assert [tuple(c) for c in got["Accounts"]["columns"]] == [
        ("id", "VARCHAR(36)", True, None, True), ("amount", "DECIMAL(15, 2)", False, "0.00", False), ("note", "TEXT", True, "'a, (b; it'", False), ("owner", "INT", True, None, False), ("index_no", "INT", True, None, False)]
    assert got["Accounts"]["indexes"] == ["by_amount(amount, note)", "unnamed(note)"]
    assert [tuple(k) for k in got["Accounts"]["foreign_keys"]] == [("owner", "people", "id"), ("a", "other", "x"), ("b", "other", "y")]
    links = {tuple(r) for r in ddl.table_relationships(ddl.table_definitions(df)).collect()}
    assert links == {
        ("accounts", "FOREIGN_KEY", "people", "owner", "id"), ("accounts", "FOREIGN_KEY", "other", "a", "x"), ("accounts", "FOREIGN_KEY", "other", "b", "y"), ("people", "FOREIGN_KEY", "people", "boss", "id"),
        ("people", "REFERENCED_BY", "accounts", "owner", "id"), ("other", "REFERENCED_BY", "accounts", "a", "x"), ("other", "REFERENCED_BY", "accounts", "b", "y")}


def test_split(spark):
    df = spark.createDataFrame([("a, b(c, d(e, f)), 'g, h' , ,i",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(ddl.split_top_level(F.col("t"))).collect()] == [["a", "b(c, d(e, f))", "'g, h'", "i"], None, []]


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.sql").write_text(TEXT)
    (tmp_path / "b.txt").write_text("CREATE TABLE b (x INT)")
    got = ddl.table_definitions(ddl.read_ddl(spark, str(tmp_path))).collect()
    assert sorted(r["table_name"] for r in got) == ["Accounts", "People", "other"] and all(r["path"].endswith("deep/a.sql") for r in got)
