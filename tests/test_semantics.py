"""What the oracle cannot say: NULL logic, errors, changes, constraints, JSON details."""

import pytest
from pyspark.sql import functions as F

from brindle import Engine
from brindle.dialect.lexer import SQLSyntaxError
from brindle.dialect.parser import parse
from brindle.plans.lower import SQLError


@pytest.fixture
def e(spark, tmp_path):
    engine = Engine(spark, warehouse=f"file://{tmp_path}/tables", log=str(tmp_path / "log"))
    engine.sql("CREATE TABLE users (id INT PRIMARY KEY, name TEXT, age INT DEFAULT 7)")
    engine.sql("INSERT INTO users (id, name) VALUES (1, 'alice'), (2, NULL), (3, 'bob')")
    return engine


def values(df):
    return [tuple(r) for r in df.collect()]


def test_null_logic(e):
    assert values(e.sql("SELECT id FROM users WHERE NOT (name = 'bob') ORDER BY id")) == [(1,), (2,)]
    assert values(e.sql("SELECT id FROM users WHERE name NOT IN ('bob', NULL)")) == [(1,)]
    assert values(e.sql("SELECT name FROM users ORDER BY name")) == [("alice",), ("bob",), (None,)]
    assert values(e.sql("SELECT name FROM users ORDER BY name DESC")) == [("bob",), ("alice",), (None,)]
    assert values(e.sql("SELECT 1 NOT IN (2, NULL) AS t, NULL = 1 AS f")) == [(True, False)]


def test_changes(e):
    assert values(e.sql("UPDATE users SET age = age + 1 WHERE id >= 2 ORDER BY id DESC LIMIT 1")) == [("1 rows updated",)]
    assert values(e.sql("SELECT id, age FROM users ORDER BY id")) == [(1, 7), (2, 7), (3, 8)]
    assert values(e.sql("DELETE FROM users WHERE name IS NULL")) == [("1 rows deleted",)]
    e.sql("INSERT INTO users SELECT id + 10 AS id, name, age FROM users")
    assert values(e.sql("SELECT COUNT(*) AS n FROM users")) == [(4,)]
    e.sql("ALTER TABLE users ADD COLUMN score FLOAT DEFAULT 1.5")
    assert values(e.sql("SELECT SUM(score) AS s FROM users")) == [(6.0,)]
    e.sql("TRUNCATE TABLE users")
    assert values(e.sql("SELECT COUNT(*) AS n FROM users")) == [(0,)]


def test_constraints_leave_the_table_as_it_was(e):
    for bad in ("INSERT INTO users VALUES (9, 'x', 1), (1, 'y', 1)", "INSERT INTO users VALUES (NULL, 'x', 1)", "INSERT INTO users VALUES ('z', 'x', 1)", "ALTER TABLE users DROP COLUMN id"):
        with pytest.raises(SQLError):
            e.sql(bad)
    assert values(e.sql("SELECT COUNT(*) AS n FROM users")) == [(3,)]


def test_json(e):
    e.sql("CREATE TABLE docs (id INT, data JSON, bin JSONB)")
    doc = '{"b":{"z":1,"a":[1,2]},"n":9.99,"i":30,"t":true,"x":null,"e":1e3}'
    e.sql(f"INSERT INTO docs VALUES (1, '{doc}', '{doc}')")
    for col in ("data", "bin"):
        got = e.sql(f"SELECT JSON_VALUE({col}, '$.n') AS a, JSON_VALUE({col}, '$.i') AS b, JSON_VALUE({col}, '$.t') AS c, JSON_VALUE({col}, '$.x') AS d, JSON_VALUE({col}, '$.b') AS f, JSON_VALUE({col}, '$.e') AS g, JSON_QUERY({col}, '$.b') AS h, JSON_EXISTS({col}, '$.x') AS k, JSON_VALUE({col}, '$.b.a[1]') AS m FROM docs")
        assert values(got) == [("9.99", "30", "true", None, None, "1000", '{"a":[1,2],"z":1}', True, "2")]
    assert values(e.sql("""SELECT '{"a":1} x' IS JSON AS a, '' IS JSON AS b, '"s"' IS JSON AS c, '1],[2' IS JSON AS d""")) == [(False, False, True, False)]
    assert values(e.sql("SELECT JSON_OBJECT('a', '30', 'b', 'x', 'c', NULL) AS j, JSON_ARRAY() AS k")) == [('{"a":30,"b":"x","c":null}', "[]")]
    with pytest.raises(Exception):
        e.sql("INSERT INTO docs VALUES (2, 'nope', NULL)")


def test_casts_and_functions(e):
    assert values(e.sql("SELECT CAST(3.9 AS INT) AS a, CAST(20.0 AS TEXT) AS b, CAST('12' AS INT) AS c, 7 / 2 AS d, ROUND(2.5) AS f, SUBSTRING('hello', 0, 2) AS g, TRIM('\t x ') AS h")) == [(3, "20", 12, 3, 3.0, "he", "x")]
    with pytest.raises(Exception):
        e.sql("SELECT CAST('abc' AS INT) AS a").collect()


def test_recursion_windows_and_full_text(e):
    assert values(e.sql("WITH RECURSIVE s AS (SELECT 1 AS n UNION SELECT MOD(n, 3) + 1 AS n FROM s) SELECT n FROM s ORDER BY n")) == [(1,), (2,), (3,)]
    assert values(e.sql("SELECT id, SUM(id) OVER (ORDER BY id) AS s FROM users ORDER BY id")) == [(1, 1), (2, 3), (3, 6)]
    assert values(e.sql("SELECT id FROM users WHERE name @@ 'lic'")) == []
    e.sql("CREATE INDEX g ON users (name) USING GIN WITH (tokenizer='bigram')")
    assert values(e.sql("SELECT id FROM users WHERE name @@ 'LIC'")) == [(1,)]
    row = values(e.sql("EXPLAIN SELECT id FROM users WHERE id = 1"))[0]
    assert row[3:6] == ("const", "PRIMARY, g", "PRIMARY")


def test_joins_and_names(e):
    e.sql("CREATE TABLE orders (id INT, product TEXT)")
    e.sql("INSERT INTO orders VALUES (3, 'pen'), (4, 'ink')")
    assert values(e.sql("SELECT * FROM users RIGHT JOIN orders USING (id) ORDER BY product")) == [(None, None, None, "ink"), (3, "bob", 7, "pen")]
    with pytest.raises(SQLError):
        e.sql("SELECT id FROM users JOIN orders ON users.id = orders.id")
    with pytest.raises(SQLError):
        e.sql("SELECT 1 AS a UNION SELECT 1.5 AS a")


def test_databases_and_log(spark, e):
    e.sql("CREATE DATABASE other")
    e.sql("USE other")
    e.sql("CREATE TABLE t (a INT)")
    assert values(e.sql("SHOW TABLES")) == [("t",)]
    assert values(e.sql("SELECT COUNT(*) AS n FROM default.users")) == [(3,)]
    with pytest.raises(SQLError):
        e.sql("DROP DATABASE other")
    again = Engine(spark, log=e.log.path)
    assert again.replay() == 5
    assert values(again.sql("SELECT COUNT(*) AS n FROM default.users")) == [(3,)]


def test_syntax():
    for bad in ("SELECT", "SELECT 1 AS a garbage more", "SELECT * FROM (SELECT 1 AS a)", "CREATE TABLE t (a VARCHAR)"):
        with pytest.raises(SQLSyntaxError):
            parse(bad)


def test_streaming(spark, tmp_path):
    from brindle.streaming import stream_query

    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, k long").parquet(f"{tmp_path}/in")
    out = stream_query(spark, "SELECT k, COUNT(*) AS n FROM events WHERE id > 0 GROUP BY k", events=stream)
    q = out.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("counts"))) == [(0, 3), (1, 3), (2, 3)]


def test_numbers(e):
    """Plain digits whatever the size, types of the branch that is taken, division by branch."""
    got = e.sql("SELECT CAST(12345678.5 AS TEXT) AS a, CAST(0.00001 AS TEXT) AS b, CAST(1234567890123456789012.0 AS TEXT) AS c, CAST(-0.000000125 AS TEXT) AS d, CAST(0.1 AS TEXT) AS f, CAST(-25000000.0 AS TEXT) AS g")
    assert values(got) == [("12345678.5", "0.00001", "1234567890123456800000", "-0.000000125", "0.1", "-25000000")]
    assert values(e.sql("SELECT CASE WHEN 1 = 2 THEN 1 ELSE 2.5 END / 2 AS a, CASE WHEN 1 = 1 THEN 1 ELSE 2.5 END / 2 AS b, COALESCE(NULL, 5) / 2 AS c, 5 / CASE WHEN 1 = 1 THEN 2 ELSE 0.5 END AS d")) == [(1.25, 0.0, 2, 2.0)]
    assert values(e.sql("SELECT (SELECT COUNT(*) FROM users) / 2 AS a, (SELECT AVG(id) FROM users) / 4 AS b, (SELECT MAX(id) FROM users UNION SELECT 3) / 2 AS c")) == [(1, 0.5, 1)]
    with pytest.raises(SQLError):
        e.sql("SELECT id FROM users WHERE id IN (SELECT id FROM users UNION SELECT name FROM users)")


def test_correlated_in(e):
    e.sql("CREATE TABLE buys (buyer INT, item INT)")
    e.sql("INSERT INTO buys VALUES (1, 1), (1, 5), (2, 3), (3, 3), (3, 3)")
    for inner in ("SELECT item FROM buys WHERE buyer = users.id GROUP BY item", "SELECT DISTINCT item FROM buys WHERE buyer = users.id", "SELECT item FROM buys WHERE buyer = users.id UNION SELECT item FROM buys WHERE buyer = users.id + 10"):
        assert values(e.sql(f"SELECT id FROM users WHERE id IN ({inner}) ORDER BY id")) == [(1,), (3,)]
        assert values(e.sql(f"SELECT id FROM users WHERE id NOT IN ({inner}) ORDER BY id")) == [(2,)]
    with pytest.raises(SQLError):
        e.sql("SELECT id FROM users WHERE id IN (SELECT nothing FROM buys GROUP BY nothing)")


def test_json_numbers_and_word_match(e):
    assert values(e.sql("""SELECT CAST(JSON_VALUE('{"a":"12"}', '$.a') AS INT) AS a, CAST(JSON_VALUE('{"a":1e3}', '$.a') AS INT) AS b, CAST(JSON_VALUE('{"a":{}}', '$.a') AS INT) AS c, CAST(JSON_VALUE('{"a":2.50}', '$.a') AS FLOAT) AS d""")) == [(12, 1000, None, 2.5)]
    with pytest.raises(Exception):
        e.sql("""SELECT CAST(JSON_VALUE('{"a":"x"}', '$.a') AS INT) AS a""").collect()
    got = e.sql("SELECT 'The cat, sat' @@ 'CAT' AS a, 'concatenate' @@ 'cat' AS b, 'cat' @@ 'cat' AS c, 'a.b' @@ 'a.b' AS d, 'über cat' @@ 'ÜBER' AS f, 'x' @@ 'caterpillar' AS g, 'scat cat' @@ 'cat' AS h")
    assert values(got) == [(True, False, True, False, True, False, True)]


def test_explain_rows(e):
    e.sql("CREATE INDEX by_age ON users (age)")
    rows = values(e.sql("EXPLAIN SELECT name FROM users WHERE age > 3 OR id = 1"))
    assert rows[0][:7] == (1, "SELECT", "users", "index merge", "PRIMARY, by_age", "by_age, PRIMARY", "") and "Scan parquet" in rows[0][7]
    assert [r[1:4] for r in values(e.sql("EXPLAIN WITH t AS (SELECT id FROM users) SELECT id FROM t WHERE EXISTS (SELECT 1 FROM users u WHERE u.id = t.id)"))] == [("CTE", "t", ""), ("SELECT", "users", "full scan"), ("SELECT", "t", "full scan"), ("SUBQUERY", "users", "full scan")]
    assert [r[1:7] for r in values(e.sql("EXPLAIN UPDATE users SET age = 1 WHERE id = 2"))] == [("UPDATE", "users", "const", "PRIMARY, by_age", "PRIMARY", "")]
    assert values(e.sql("EXPLAIN INSERT INTO users (id) VALUES (7), (8)"))[0][1:7] == ("INSERT", "users", "", "", "", "2 row(s)")


def test_versions_are_removed(spark, e, tmp_path):
    for i in range(8):
        e.sql(f"INSERT INTO users (id) VALUES ({100 + i})")
    left = [p for p in (tmp_path / "tables").glob("brindle-users-*/v*") if p.is_dir()]
    assert len(left) <= 3 and values(e.sql("SELECT COUNT(*) AS n FROM users")) == [(11,)]
    e.sql("DROP TABLE users")
    assert not [p for p in (tmp_path / "tables").glob("brindle-users-*/v*") if p.is_dir()]


def test_long_recursion(e):
    assert values(e.sql("WITH RECURSIVE s AS (SELECT 1 AS n UNION SELECT n + 1 FROM s WHERE n < 40) SELECT COUNT(*) AS c, MAX(n) AS m FROM s")) == [(40, 40)]


def test_prompt(e):
    from brindle.cli import show, shown

    assert [shown(x) for x in (20.0, 1e21, 1e-7, -2.5, 3, None, True, "x")] == ["20.0", "1000000000000000000000.0", "0.0000001", "-2.5", "3", "<nil>", "true", "x"]
    assert show(e.sql("SELECT id, name FROM users WHERE id < 3 ORDER BY id")) == "id\tname\n" + "-" * 15 + "\n1\talice\n2\t<nil>\n(2 rows)"
    assert show(e.sql("DELETE FROM users WHERE id = 3")) == "1 rows deleted"


def test_other_formats(spark, tmp_path):
    """Any format that Spark reads is a table."""
    from brindle.sources.files import register_folder

    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.json(f"{tmp_path}/t.json")
    spark.createDataFrame([(2, 0.5)], "k int, w double").write.option("header", True).csv(f"{tmp_path}/u.csv")
    engine = register_folder(Engine(spark), str(tmp_path), ["t"], "json")
    register_folder(engine, str(tmp_path), ["u"], "csv", header="true", inferSchema="true")
    assert values(engine.sql("SELECT t.v, u.w FROM t JOIN u ON t.k = u.k")) == [("b", 0.5)]


def test_posting_tables(spark, e):
    """Searches with an index give what they give without one, and read its postings."""
    rows = "(1, 'Red cat', '{\"a\":{\"b\":[1,\"x\"]},\"a.b\":2}'), (2, 'concatenated', '{\"a\":{\"b\":2}}'), (3, NULL, NULL), (4, 'cat-red ÜBER 東京タワー', '[{\"a\":null}]')"
    searches = ["body @@ 'cat'", "body @@ 'CAT' AND body @@ 'red'", "body LIKE '%at%'", "body LIKE 'R_d c%'", "body = 'Red cat'", "body IN ('Red cat', 'x y')", "body @@ 'über'", "body @@ '京タ'", "body LIKE '%京タワ%'", "NOT body @@ 'cat'", "body @@ 'c'", "body @@ 'red cat'"]
    documents = ["JSON_VALUE(doc, '$.a.b') = '2'", "JSON_VALUE(doc, '$.a.b[1]') = 'x'", "JSON_VALUE(doc, '$[0].a') = 'x'", "JSON_VALUE(doc, '$.a.b[0]') IN ('1', '3')"]
    for i, tokenizer in enumerate(("word", "bigram")):
        for name in (f"plain{i}", f"found{i}"):
            e.sql(f"CREATE TABLE {name} (id INT, body TEXT, doc JSONB)")
            e.sql(f"INSERT INTO {name} VALUES {rows}")
        e.sql(f"CREATE INDEX w ON found{i} (body) USING GIN WITH (tokenizer='{tokenizer}')")
        e.sql(f"CREATE INDEX j ON found{i} (doc) USING GIN")
        e.catalog.table(None, f"plain{i}").indexes["w"] = type("I", (), {"columns": ("body",), "method": "GIN", "tokenizer": tokenizer, "view": None, "unique": False})()
        for where in searches + documents:
            want = values(e.sql(f"SELECT id FROM plain{i} WHERE {where} ORDER BY id"))
            assert values(e.sql(f"SELECT id FROM found{i} WHERE {where} ORDER BY id")) == want, (tokenizer, where)
    plan = values(e.sql("EXPLAIN SELECT id FROM found0 WHERE body @@ 'cat'"))[0]
    assert plan[3] == "fulltext" and "EqualTo(token,cat)" in plan[7] and "body" not in plan[7].split("ReadSchema: struct<")[1]


ODD_TEXTS = ["The cat, the CAT", None, "", "a", "ab", "İstanbul ẞtraße ÜBER", "naïve 😀😀 x\ty\nz_1", "a.b--c'd", "京都タワー 東京", "".join(chr(c) for c in range(0x4E00, 0x5000)), "İ K ﬀ", "x" * 5000, "one one two"]


def test_postings_of_texts(spark, e):
    """A text index has each word or pair of a text once, a row for many texts, whatever the text."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS * 40)], "id long, body string").repartition(2).cache()
    e.register("given", rows)
    for tokenizer in ("word", "bigram"):
        e.sql(f"CREATE TABLE {tokenizer}s (id INT, body TEXT)")
        e.sql(f"INSERT INTO {tokenizer}s SELECT id, body FROM given")
        e.sql(f"CREATE INDEX g ON {tokenizer}s (body) USING GIN WITH (tokenizer='{tokenizer}')")
        table = e.catalog.table(None, f"{tokenizer}s")
        parts = spark.sql(r"SELECT __rowid AS id, explode(split(lower(body), '[^a-z0-9\\x{80}-\\x{10FFFF}]+')) AS token FROM " + table.view).where("token <> ''")
        if tokenizer == "bigram":
            parts = spark.sql(f"SELECT __rowid AS id, explode(transform(sequence(1, greatest(length(lower(body)) - 1, 1)), i -> substring(lower(body), i, 2))) AS token FROM {table.view}").where("length(token) = 2")
        want = sorted(values(parts.select("token", "id").distinct()))
        assert sorted(values(spark.table(table.indexes["g"].view))) == want
        written = spark.read.parquet(*table.indexes["g"].parts)
        assert written.count() <= 2 * len({t for t, _ in want}) < len(want)


def test_pieces_of_postings(monkeypatch):
    """A task that is full writes a piece and goes on; nothing is lost or doubled."""
    import pyarrow as pa

    from brindle.catalog import postings as P

    texts = [f"{chr(97 + i % 26)}b cd é{i} cd".encode() for i in range(100)]
    batch = pa.record_batch([pa.array(texts, pa.binary()), pa.array(range(100), pa.int64())], ["text", "id"])
    for kind in (P.Words, P.Bigrams):
        found = []
        for piece in (1 << 30, 7, 1):
            monkeypatch.setattr(P, "PIECE", piece)
            out = list(P.pieces(kind)(iter([batch, batch.slice(0, 0)])))
            found.append(sorted((t, i) for b in out for t, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in ids))
            assert (len(out) == 1) == (piece > 7)
        assert found[0] == found[1] == found[2] and len(set(found[0])) == len(found[0])


def test_postings_kept_by_changes(spark, e, tmp_path):
    """A change leaves the postings of rows it does not touch: new rows add a part, gone ones are found no more."""
    e.sql("CREATE TABLE notes (id INT PRIMARY KEY, body TEXT, n INT, doc JSONB)")
    e.sql("""INSERT INTO notes VALUES (1, 'red cat', 0, '{"a":1}'), (2, 'red dog', 0, '{"a":2}'), (3, 'blue cat', 0, '{"a":1}')""")
    e.sql("CREATE INDEX w ON notes (body) USING GIN")
    e.sql("CREATE INDEX j ON notes (doc) USING GIN")
    indexes = lambda: e.catalog.table(None, "notes").indexes
    found = lambda where: [r[0] for r in values(e.sql(f"SELECT id FROM notes WHERE {where} ORDER BY id"))]
    first = {n: list(i.parts) for n, i in indexes().items()}
    before = e.sql("SELECT id FROM notes WHERE body @@ 'cat'")
    e.sql("DELETE FROM notes WHERE id = 3")
    e.sql("UPDATE notes SET n = 5 WHERE id = 1")
    assert sorted(values(before)) == [(1,), (3,)]  # read late
    e.sql("ALTER TABLE notes ADD COLUMN more TEXT")
    assert {n: i.parts for n, i in indexes().items()} == first
    e.sql("""INSERT INTO notes (id, body, doc) VALUES (4, 'green bird', '{"a":3}'), (5, NULL, NULL)""")
    assert [i.parts[:-1] for i in indexes().values()] == list(first.values())
    assert [r[0] for r in values(spark.read.parquet(indexes()["w"].parts[-1]).select("token").orderBy("token"))] == ["bird", "green"]
    assert found("body @@ 'cat'") == [1] and found("body @@ 'blue'") == [] and found("body @@ 'bird' OR body @@ 'dog'") == [2, 4] and found("JSON_VALUE(doc, '$.a') IN ('1', '3')") == [1, 4]
    e.sql("UPDATE notes SET body = 'white cat' WHERE id = 2")
    assert len(indexes()["w"].parts) == 1 and len(indexes()["j"].parts) == 2
    assert found("body @@ 'dog'") == [] and found("body @@ 'cat'") == [1, 2] and found("NOT body @@ 'cat'") == [4, 5]
    for i in range(6, 17):
        e.sql(f"INSERT INTO notes (id, body) VALUES ({i}, 'cat {i}')")
        assert len(indexes()["w"].parts) <= 8
    assert found("body @@ 'cat' AND id > 5") == list(range(6, 17)) and found("body @@ '11'") == [11]
    e.sql("TRUNCATE TABLE notes")
    e.sql("INSERT INTO notes (id, body) VALUES (1, 'other')")
    assert found("body @@ 'cat'") == [] and found("body @@ 'other'") == [1]
    e.sql("DROP TABLE notes")
    assert not [p for p in (tmp_path / "tables").glob("brindle-notes-*/*") if p.is_dir()]


def test_like_by_pairs(spark, e):
    """LIKE looks its pairs up in (token, ids) rows, of all parts."""
    e.sql("CREATE TABLE pairs (id INT, body TEXT)")
    e.sql("INSERT INTO pairs VALUES (1, 'A License'), (2, 'a license'), (3, 'Lic ense'), (4, NULL)")
    e.sql("CREATE INDEX g ON pairs (body) USING GIN WITH (tokenizer='bigram')")
    e.sql("INSERT INTO pairs VALUES (5, 'Licenses')")
    assert values(e.sql("SELECT id FROM pairs WHERE body LIKE '%License%' ORDER BY id")) == [(1,), (5,)]
    parts = e.catalog.table(None, "pairs").indexes["g"].parts
    assert values(spark.read.parquet(parts[0]).where("token = 'li'").select(F.sum(F.size("ids")))) == [(3,)] and len(parts) == 2


def test_equal_by_words(spark, e):
    """= and IN look their words up in the parts of an index; new rows are written there alone."""
    e.sql("CREATE TABLE said (id INT, body TEXT)")
    e.sql("INSERT INTO said VALUES (1, 'one two'), (2, 'three')")
    e.sql("CREATE INDEX g ON said (body) USING GIN")
    e.sql("INSERT INTO said VALUES (3, 'one two'), (4, 'two one'), (5, 'One Two')")
    assert values(e.sql("SELECT id FROM said WHERE body = 'one two' OR body IN ('One Two', 'three') ORDER BY id")) == [(1,), (2,), (3,), (5,)]
    new = spark.read.parquet(e.catalog.table(None, "said").indexes["g"].parts[1]).selectExpr("token", "explode(ids)")
    assert sorted(r[0] for r in values(new)) == ["one"] * 3 + ["two"] * 3
