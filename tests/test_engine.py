"""Statements on small tables with results reasoned by hand."""

import re

import pytest

from tessera.operators import joins
from tessera.plans.rewrite import rewrite
from tessera.plans.statements import STATEMENTS, Engine, calc


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def ok(engine, *statements):
    for s in statements:
        r = engine.execute(s)
        assert r.ok, f"{s}: {r.error}"
    return r


def lines(engine, sql):
    return sorted(engine.execute(sql).text().splitlines()[1:])


@pytest.fixture()
def scores(engine):
    ok(engine, "create table t(id int, score float, name char)",
       "insert into t values (3,1.0,'a'),(1,2.0,'b'),(4,3.0,'c'),(3,2.0,'c'),(3,4.0,'c'),(3,3.0,'d'),(3,2.0,'f')")
    return engine


@pytest.mark.parametrize("text,value", [("3/2", 1.5), ("20/0", 3.4028234663852886e38), ("13.2/0.0", 3.4028234663852886e38), ('"123"+4', 127), ('"abc"+4', 4), ("-(1+2)*3", -9), ("1+2*3-4", 3), ('"12ab"+1', 13)])
def test_calc(text, value):
    assert calc(text) == value


def test_calc_statement(engine):
    assert engine.execute("calc 3/2, 1+1").text() == "3/2 | 1+1\n1.5 | 2"
    assert engine.execute("calc 1+").text() == "FAILURE"


def test_group_having(scores):
    assert lines(scores, "select id, avg(score) from t group by id") == ["1 | 2", "3 | 2.4", "4 | 3"]
    assert lines(scores, "select name, min(id), max(score) from t group by name") == ["a | 3 | 1", "b | 1 | 2", "c | 3 | 4", "d | 3 | 3", "f | 3 | 2"]
    assert lines(scores, "select id, score, count(*) from t group by id, score having count(*) > 1") == ["3 | 2 | 2"]
    assert lines(scores, "select id from t group by id having sum(score) > 3") == ["3"]


@pytest.mark.parametrize("bad", ["min(*)", "count(*, id)", "min(id, score)", "count()", "count(nothing)", "sum(name)"])
def test_bad_aggregates(scores, bad):
    assert scores.execute(f"select {bad} from t").text() == "FAILURE"


def test_group_expressions(scores):
    assert lines(scores, "select id+1, sum(score)+sum(score) from t group by id+1") == ["2 | 4", "4 | 24", "5 | 6"]
    assert scores.execute("select id+score+id from t group by id+score").text() == "FAILURE"
    assert scores.execute("select name, score from t group by name").text() == "FAILURE"


def test_division(scores):
    assert lines(scores, "select id/(id-3) from t where name = 'b'") == ["-0.5"]
    assert lines(scores, "select count(*) from t where id/(id-3) > 0") == ["1"]
    assert lines(scores, "select id/(id-1) from t where id = 1") == ["340282346638528859811704183484516925440"]


def test_rewrite_leaves_the_rest():
    for sql in ("select count(*), t.* from t where a = 'x/y'", "select a || 'it''s', 1e0, `a b` , a <=> b from t -- x/y", "select  x->x+1, date '2020-1-1' from t where a between 1 and 2"):
        assert rewrite(sql) == sql


def test_joins_and_subqueries(engine):
    ok(engine, "create table a(id int, name char(4))", "create table b(id int, num int)", "create table e(id int, n int)",
       "insert into a values (1,'a'),(2,'b'),(3,'c')", "insert into b values (1,2),(2,15)")
    assert lines(engine, "select a.name, b.num from a inner join b on a.id = b.id") == ["a | 2", "b | 15"]
    assert lines(engine, "select a.id, b.id from a, b where a.id > b.id") == ["2 | 1", "3 | 1", "3 | 2"]
    assert lines(engine, "select a.id from a inner join e on a.id = e.id") == []
    assert lines(engine, "select id from a where id in (select id from b)") == ["1", "2"]
    assert lines(engine, "select id from a where id not in (select id from b)") == ["3"]
    assert lines(engine, "select id from a where id not in (select id from e)") == ["1", "2", "3"]
    assert lines(engine, "select id from a where id > (select max(n) from e)") == []
    assert engine.execute("select id from a where id = (select id from b)").text() == "FAILURE"
    assert engine.execute("select id from a where id = (select * from b)").text() == "FAILURE"
    ok(engine, "set hash_join = 1")
    assert lines(engine, "select a.name, b.num from a inner join b on a.id = b.id") == ["a | 2", "b | 15"]


def test_nulls(engine):
    ok(engine, "create table n(id int not null, num int null, price float not null, day date null)",
       "insert into n values (1,18,10.0,'2020-01-01'),(2,null,20.0,'2010-01-11'),(3,12,30.0,null)")
    assert not engine.execute("insert into n values (null,1,1.0,null)").ok
    assert lines(engine, "select id from n where num is null") == ["2"]
    assert lines(engine, "select id from n where num <> 18") == ["3"]
    assert lines(engine, "select count(*), count(num), avg(num) from n") == ["3 | 2 | 15"]
    assert lines(engine, "select id from n where null = null") == []
    assert lines(engine, "select id, day from n where id = 3") == ["3 | NULL"]


def test_types(engine):
    ok(engine, "create table d(id int, day date, c char(3), t text)", "insert into d values (1,'2016-2-29','abcdef','x')")
    assert lines(engine, "select day, c from d") == ["2016-02-29 | abc"]
    for bad in ("(2,'2017-2-29','a','b')", "(2,'2017-11-31','a','b')", "(1.5,'2017-1-1','a','b')", "('x','2017-1-1','a','b')", "(1,'2017-1-1','a')"):
        assert not engine.execute(f"insert into d values {bad}").ok
    ok(engine, f"insert into d values (2,'2020-1-1','a','{'y' * 5000}')")
    assert lines(engine, "select id from d where day > '2017-1-1'") == ["2"]
    assert engine.execute("select id from d where day > '2017-2-30'").text() == "FAILURE"
    assert engine.query("select length(t) from d where id = 2").first()[0] == 4096


def test_update_delete(engine):
    ok(engine, "create table u(id int, name char(4), c1 int, c2 int)", "insert into u values (1,'N1',1,1),(2,'N2',1,1),(3,'N3',2,1)")
    ok(engine, "update u set name = 'N01' where id = 1", "update u set c1 = c1 + 5 where c1 = 1 and id = 2", "update u set c2 = 9 where id = 77")
    assert lines(engine, "select * from u") == ["1 | N01 | 1 | 1", "2 | N2 | 6 | 1", "3 | N3 | 2 | 1"]
    for bad in ("update nope set c1 = 1", "update u set nope = 1", "update u set c1 = 1 where nope = 1", "update u set c1 = 'x'"):
        assert not engine.execute(bad).ok
    ok(engine, "delete from u where c1 > 1 and id < 3")
    assert lines(engine, "select id from u") == ["1", "3"]
    ok(engine, "delete from u")
    assert lines(engine, "select id from u") == []


def test_indexes(engine):
    ok(engine, "create table i(id int, a int, b int)", "insert into i values (1,1,1),(2,1,1)", "create unique index x on i(id)", "create index y on i(a, b)")
    assert not engine.execute("insert into i values (1,2,3)").ok
    assert not engine.execute("create unique index z on i(a)").ok
    assert not engine.execute("create index x on i(a)").ok
    assert not engine.execute("create index w on i(nope)").ok
    ok(engine, "insert into i values (3,1,1)", "drop index y on i")
    assert not engine.execute("drop index y on i").ok
    assert lines(engine, "select id from i where id = 2") == ["2"]


def test_transactions(engine, spark):
    ok(engine, "create table t(id int)", "begin", "insert into t values (1)")
    other = Engine(spark, engine.catalog.path)
    assert lines(other, "select id from t") == []
    assert lines(engine, "select id from t") == ["1"]
    ok(engine, "rollback")
    assert lines(engine, "select id from t") == []
    ok(engine, "begin", "insert into t values (2)")
    ok(other, "insert into t values (3)")
    assert not engine.execute("commit").ok
    assert lines(engine, "select id from t") == ["3"]


def test_utilities(engine, tmp_path):
    ok(engine, "create table t(id int, name char(8), v vector(3)) storage format=pax", "sync", "analyze table t", "help", "set use_cascade = 1", "set execution_mode = 'chunk_iterator'")
    assert engine.version("t").rows == 0
    assert engine.execute("show tables").text() == "Tables_in_SYS\nt"
    assert lines(engine, "desc t") == ["id | int | 4", "name | char | 8", "v | vector | 12"]
    assert not engine.execute("set nope = 1").ok and not engine.execute("create table t(id int)").ok and not engine.execute("drop table nope").ok
    ok(engine, "insert into t values (1, 'x', '[1,2,3]')")
    assert not engine.execute("insert into t values (1, 'x', '[1,2]')").ok
    assert lines(engine, "select * from t") == ["1 | x | [1,2,3]"]
    (tmp_path / "in.txt").write_text("7|seven\n8|eight\n")
    ok(engine, "create table l(id int, name char(8))", f"load data infile '{tmp_path}/in.txt' into table l")
    assert lines(engine, "select * from l") == ["7 | seven", "8 | eight"]
    (tmp_path / "bad.txt").write_text("9|nine\nx|ten\n")
    bad = engine.execute(f"load data infile '{tmp_path}/bad.txt' into table l")
    assert not bad.ok and "1 of 2 line(s)" in bad.error
    assert engine.execute(f"load data infile '{tmp_path}/in.txt' into table l").message == "2 record(s) loaded"
    ok(engine, "delete from l where id = 8 or id = 7", f"load data infile '{tmp_path}/in.txt' into table l")
    assert "Scan" in engine.execute("explain select id from l where id = 7").text()
    assert engine.execute("nonsense").text() == "FAILURE"
    ok(engine, "drop table l")
    assert engine.execute("select * from l").text() == "FAILURE"


@pytest.fixture()
def vectors(engine):
    ok(engine, "create table items(id int, c1 vector(3) null, c2 vector(3) null, name char(8))",
       "insert into items values (1,'[1,1,1]','[1,2,3]','a'),(2,[2,0,1],[0,0,0],'b'),(3,'[9,9,9]',[9,9,8.5],'c'),(4,null,'[1,0,0]','d')")
    return engine


def test_vector_expressions(vectors):
    assert lines(vectors, "select c1 + '[1.5,2.3,3.3]', '[3,3,3]' - c2, c2 * c1 from items where id = 1") == ["[2.5,3.3,4.3] | [2,1,0] | [1,2,3]"]
    assert lines(vectors, "select [1,2,3] + [1,1,1], '[1,2]' * '[1,3]', (c1 + c2) * c1 from items where id = 1") == ["[2,3,4] | [1,6] | [2,3,4]"]
    assert lines(vectors, "select id from items where c1 > [1,1,0] and c1 < '[2,1,0]'") == ["1", "2"]
    assert lines(vectors, "select id from items where c1 = '[9,9,9]'") == ["3"]
    assert lines(vectors, "select id, L2_DISTANCE(c1, c2), inner_product(c1, '[1,2,3]'), cosine_distance(c1, [1,1,1]) from items where id < 3") == ["1 | 2.24 | 6 | 0", "2 | 2.24 | 5 | 0.23"]
    assert lines(vectors, "select l2_distance('[1,1,1]', '[1,2,3]'), cosine_distance('[1,1,1]', c2) from items where id = 2") == ["2.24 | NULL"]
    assert lines(vectors, "select l2_distance(c1, '[0,0,0]') from items where id = 4") == ["NULL"]
    assert vectors.execute("select l2_distance(c1, '[1,2]') from items").text() == "FAILURE"
    ok(vectors, "update items set c1 = '[5,5,5]' where id = 4", "update items set c2 = c1 + c2 where id = 1")
    assert lines(vectors, "select c1, c2 from items where id = 4 or id = 1") == ["[1,1,1] | [2,3,4]", "[5,5,5] | [1,0,0]"]
    assert not vectors.execute("update items set c1 = '[1,2]'").ok


def test_vector_index(vectors, spark):
    order = "select id from items where c1 is not null order by l2_distance(c1, '[9,9,8]') limit 2"
    near = order.replace(" where c1 is not null", "")
    assert vectors.execute(order).text() == vectors.execute(near).text() == "id\n3\n1"
    ok(vectors, "create vector index v_i on items(c1) with (type=ivfflat, distance=l2_distance, lists=3, probes=3)")
    plan = vectors.execute("explain " + near).text().splitlines()
    assert plan[:4] == ["Query Plan", "OPERATOR(NAME)", "PROJECT", "└─VECTOR_INDEX_SCAN(v_i ON items)"]
    assert vectors.execute(near).text() == "id\n3\n1"
    # Neither another order nor another distance uses it.
    for other in (near.replace("l2_distance", "inner_product"), order, "select id from items order by id limit 2"):
        assert "VECTOR_INDEX_SCAN" not in vectors.execute("explain " + other).text()
    # Changes after it was built are seen, also by another session.
    ok(vectors, "insert into items values (5,'[9,9,8]',null,'e')", "delete from items where id = 3")
    for e in (vectors, Engine(spark, vectors.catalog.path)):
        assert "VECTOR_INDEX_SCAN" in e.execute("explain " + near).text()
        assert e.execute(near).text() == "id\n5\n1"
    assert not vectors.execute("create vector index v_i on items(c2) with (lists=2)").ok
    assert not vectors.execute("create vector index w on items(name) with (lists=2)").ok
    ok(vectors, "create vector index one on items(c2) with (lists=1, probes=1, distance=cosine_distance)")
    assert vectors.execute("select id from items order by cosine_distance([0,0,9], c2) limit 1").text() == "id\n1"
    ok(vectors, "drop index v_i on items")
    assert "VECTOR_INDEX_SCAN" not in vectors.execute("explain " + near).text()


def test_text_as_number(engine):
    ok(engine, "create table c(id int, name char(6))", "insert into c values (1,'12ab'),(2,'x'),(3,'4')")
    assert lines(engine, "select id, name + 1, '12ab' + 4 from c") == ["1 | 13 | 16", "2 | 1 | 16", "3 | 5 | 16"]
    assert lines(engine, "select id from c where name < 5") == ["2", "3"]
    assert lines(engine, "select id from c where name = '4'") == ["3"]
    for bad in ("sum(name)", "avg(name)", "sum('1')"):
        assert engine.execute(f"select {bad} from c").text() == "FAILURE"
    assert lines(engine, "select max(name), count(name) from c") == ["x | 3"]


def test_quotes_and_keywords_in_text(engine):
    ok(engine, "create table q(id int, name char(30))", "insert into q values (1, 'it''s'), (2, 'b')", "update q set name = 'x where y, z = 1' where id = 2")
    assert lines(engine, "select id, name from q") == ["1 | it's", "2 | x where y, z = 1"]
    assert lines(engine, "select id || '/' || name from q where name = 'it''s'") == ["1/it's"]
    ok(engine, "delete from q where name = 'x where y, z = 1'")
    assert lines(engine, "select id from q") == ["1"]


def test_primary_key(engine):
    ok(engine, "create table k(id int, a int, primary key(id))", "insert into k values (1,1),(2,2)")
    for bad in ("insert into k values (1,9)", "insert into k values (5,1),(5,2)", "insert into k values (null,1)", "update k set id = 2 where id = 1"):
        assert not engine.execute(bad).ok
    ok(engine, "update k set a = 7", "update k set id = 3 where id = 1", "insert into k values (1,1)")
    assert lines(engine, "select id, a from k") == ["1 | 1", "2 | 7", "3 | 7"]


def test_explain_of_changes(scores):
    assert scores.execute("explain delete from t where id = 3").text().splitlines()[1:4] == ["OPERATOR(NAME)", "DELETE(t)", "└─PREDICATE"]
    assert "UPDATE(t)" in scores.execute("explain update t set score = 1.0 where id = 3").text()
    assert "INSERT(t)" in scores.execute("explain insert into t values (1,1.0,'x')").text()
    assert scores.execute("explain delete from nope").text() == "FAILURE"
    plan = scores.execute("explain select id, count(*) from t group by id").text()
    assert "HASH_GROUP_BY" in plan and "TABLE_SCAN(t)" in plan
    assert lines(scores, "select count(*) from t") == ["7"]


def test_definitions_in_transactions(engine, spark):
    ok(engine, "create table old(id int)", "begin", "create table new(id int)", "insert into new values (1)", "drop table old")
    other = Engine(spark, engine.catalog.path)
    assert engine.execute("show tables").text() == "Tables_in_SYS\nnew" and other.execute("show tables").text() == "Tables_in_SYS\nold"
    assert lines(engine, "select id from new") == ["1"]
    ok(engine, "rollback")
    assert engine.execute("show tables").text() == "Tables_in_SYS\nold"
    ok(engine, "begin", "create table new(id int)", "insert into new values (1)", "drop table old", "commit")
    assert other.execute("show tables").text() == "Tables_in_SYS\nnew" and lines(other, "select id from new") == ["1"]


def test_two_level_not_in(engine):
    ok(engine, "create table a(id int, x int)", "create table b(id int, y int)", "create table c(id int, z int)",
       "insert into a values (1,4),(2,2),(3,3)", "insert into b values (1,2),(2,7),(3,3)", "insert into c values (1,2),(3,6),(5,5)")
    assert lines(engine, "select * from a where x not in (select b.y from b where b.id in (select c.id from c where a.id = c.id))") == ["1 | 4", "2 | 2"]


def test_cost_choice_from_statistics(engine):
    ok(engine, "create table l(id int)", "create table r(id int)", "insert into l values (1)", "insert into r values (1)", "set use_cascade = 1", "analyze table l", "analyze table r")
    sql = "select * from l, r where l.id = r.id"
    assert "NESTED_LOOP_JOIN" in engine.execute("explain " + sql).text() and lines(engine, sql) == ["1 | 1"]
    ok(engine, "insert into l values (2),(3)", "insert into r values " + ",".join(f"({k})" for k in range(2, 9)), "analyze table l", "analyze table r")
    plan = engine.execute("explain " + sql).text()
    assert "HASH_JOIN" in plan and "NESTED_LOOP_JOIN" not in plan and "BuildLeft" in plan and lines(engine, sql) == ["1 | 1", "2 | 2", "3 | 3"]
    assert "NESTED_LOOP_JOIN" in engine.execute("explain select * from l, r where l.id > r.id").text()


def test_long_logs(engine):
    ok(engine, "create table g(id int)", *(f"insert into g values ({k})" for k in range(40)), "delete from g where id < 37")
    v = engine.version("g")
    assert v.number == 41 and len(v.files) <= 4 and len(engine.catalog._log("g")) < 40
    assert lines(engine, "select id from g") == ["37", "38", "39"]


def test_help_lists_every_statement(engine):
    assert len(lines(engine, "help")) == len(STATEMENTS)


def test_join_choice(spark):
    assert joins.choose(1, 1) == "nested_loop" and joins.choose(3, 8) == "hash" and joins.choose(3, 8, equi=False) == "nested_loop"
    a, b = spark.range(100).toDF("x"), spark.range(100).toDF("y")
    from pyspark.sql import functions as F

    assert joins.count_joins(joins.join(a, b, F.col("x") == F.col("y"), rows=(100, 100)))["hash"] == 1
    assert joins.count_joins(joins.join(a, b, F.col("x") > F.col("y")))["nested_loop"] == 1


def test_streaming_ingest(engine, spark, tmp_path):
    from tessera.streaming.ingest import follow

    ok(engine, "create table s(id int, name char(8))")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1|a\n2|b\n")
    q = follow(spark, engine.catalog, "s", f"file://{tmp_path}/in", f"file://{tmp_path}/cp")
    q.awaitTermination()
    assert lines(engine, "select * from s") == ["1 | a", "2 | b"]
    # A batch that is replayed, as after a failure between the write and the checkpoint, adds nothing.
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    follow(spark, engine.catalog, "s", f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    assert lines(engine, "select * from s") == ["1 | a", "2 | b"]


def test_not_in_joins_by_key(engine):
    """Correlated NOT IN is joined by the compared columns, and nulls on either side count as in NOT IN."""
    ok(engine, "create table o(k int, cust int null)", "create table c(id int null, nat int)", "create table n(nk int, reg int)",
       "insert into n values (0,0),(1,1),(2,2)", "insert into c values (1,0),(2,1),(3,1),(4,2)", "insert into o values (0,1),(1,1),(2,2),(3,2),(4,3),(5,4),(6,9)")
    one = "select k from o where cust not in (select id from c where nat = o.k % 3)"
    two = "select k from o where cust not in (select c.id from c where c.nat in (select n.nk from n where n.reg = o.k % 3))"
    either = "select k from o where k > 100 or cust not in (select id from c where nat = k % 3) order by k"

    def brute(orders, customers):
        out = []
        for k, cust in orders:
            seen = [i for i, nat in customers if nat == k % 3]
            if not seen or (cust is not None and None not in seen and cust not in seen):
                out.append(str(k))
        return sorted(out)

    orders, customers = [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 9)], [(1, 0), (2, 1), (3, 1), (4, 2)]
    for sql in (one, two, either):
        plan = engine.execute("explain " + sql).text()
        assert re.search(r"Join.*\[[^\]]*cust#", plan) and "isnull" not in plan.split("== Physical Plan ==")[1], plan
        assert lines(engine, sql) == brute(orders, customers) == ["1", "2", "3", "6"]
    for change, rows, row in (("insert into o values (7,null),(8,null)", orders, [(7, None), (8, None)]), ("insert into c values (null,2)", customers, [(None, 2)]), ("delete from c where nat = 1", None, None)):
        ok(engine, change)
        if rows is None:
            customers = [c for c in customers if c[1] != 1]
        else:
            rows += row
        for sql in (one, two, either):
            assert lines(engine, sql) == brute(orders, customers), (change, sql)
    assert lines(engine, "select k from o where not cust not in (select id from c where nat = o.k % 3)") == ["0", "5"]
