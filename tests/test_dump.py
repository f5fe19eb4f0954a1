"""Dumps: statements found whatever strings hold and wherever a file is split, and tables read back as they were."""

import random
from datetime import datetime
from decimal import Decimal

import pytest

from silvan.sources import dump

NASTY = ["it's", 'say "x"', "a;\nSET x;\nb", "back`tick", "COMMENT 'c'", "\\", "\\'", "-- no\n# no", "/* no */", "", "ä\t\r\n;", "); INSERT INTO `t` VALUES (9", "tail\\"]


def plain_cut(text):
    """One walk over all characters of a dump."""
    out, held, at, state = [], [], 0, None
    while at < len(text):
        c, two = text[at], text[at : at + 2]
        if state in ("'", '"', "`"):
            n = 2 if c == "\\" and state != "`" else 1
            held.append(text[at : at + n])
            at += n
            state = None if c == state else state
        elif two == "/*":
            end = text.find("*/", at + 2)
            at = len(text) if end < 0 else end + 2
            held.append(" ")
        elif c == "#" or two == "--" and (at + 2 == len(text) or text[at + 2].isspace()):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif c == ";":
            out.append("".join(held).strip())
            held, at = [], at + 1
        else:
            state = c if c in "'\"`" else None
            held.append(c)
            at += 1
    return [x for x in [*out, "".join(held).strip()] if x]


def test_lines_against_a_walk_over_characters():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["'", '"', "`", ";", "\n", "\\", "/*", "*/", "--", " ", "#", "a", "b;"]) for _ in range(rng.randint(0, 25)))
        if text.endswith("\\"):
            text += "x"
        state, open_, got = dump.CODE, "", []
        for nth, line in enumerate(text.split("\n")):
            parts, state = dump.cut(line, state)
            open_ += ("\n" if nth else "") + parts[0]
            for part in parts[1:]:
                got.append(open_)
                open_ = part
        squeeze = lambda xs: [" ".join(x.split()) for x in xs if x.strip()]
        assert squeeze([*got, open_]) == squeeze(plain_cut(text))


def test_lines_at_once_from_every_state():
    """Whole lines give the parts of a walk line by line; what is passed from each state is what the parts say."""
    rng = random.Random(6)
    for _ in range(3000):
        lines = ["".join(rng.choice(["'", '"', "`", ";", "\\", "\\'", "/*", "*/", "--", " ", "#", "a", "b;"]) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 5))]
        want = []
        for start in range(dump.STATES):
            state, parts = start, [""]
            for nth, line in enumerate(lines):
                more, state = dump.cut(line, state)
                parts = [*parts[:-1], parts[-1] + ("\n" if nth else "") + more[0], *more[1:]]
            got, end = dump.cut("\n".join(lines), start)
            assert end == state and [x.split() for x in got] == [x.split() for x in parts]
            want.append((state, len(parts) - 1))
        assert dump.passed("\n".join(lines)) == want


def test_a_dump_is_gone_through_once(spark, tmp_path, rows):
    """What reads statements reads their written parts: no second walk over the dump for each use."""
    (tmp_path / "d.sql").write_text("CREATE TABLE t (a int, b text);\n" + "".join(f"INSERT INTO t VALUES ({i},{quoted(v)});\n" for i, v in rows))
    found = dump.statements(spark, str(tmp_path / "d.sql"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan text" not in plan
    assert {int(r["row"][0]): r["row"][1] for r in dump.insert_rows(found).collect()} == dict(rows)


def quoted(value):
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n" if len(value) % 2 else "\n") + "'"


@pytest.fixture()
def rows():
    rng = random.Random(8)
    return [(k, rng.choice([None, *NASTY]) if k % 3 else "".join(rng.choice(NASTY) for _ in range(4))) for k in range(400)]


def test_tables_of_a_dump_in_many_splits(spark, tmp_path, rows):
    head = "-- MySQL dump; 'x\n/*!40101 SET NAMES utf8 */;\n/* a ' comment;\nover lines */\nCREATE TABLE `t` (\n  `id` int(11) unsigned NOT NULL AUTO_INCREMENT COMMENT 'a, (b',\n  `v;x` varchar(9) DEFAULT ',',\n  PRIMARY KEY (`id`),\n  KEY `k` (`v;x`)\n) ENGINE=InnoDB;\nLOCK TABLES `t` WRITE;\n"
    inserts = "".join(f"INSERT INTO `t` VALUES {','.join(f'({i},{quoted(v)})' for i, v in rows[a : a + 7])};\n" for a in range(0, 400, 7))
    (tmp_path / "d.sql").write_text(head + inserts + "UNLOCK TABLES;\nselect 1")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        path = str(tmp_path / "d.sql")
        lines = dump._lines(spark, path)
        assert lines.select("split").distinct().count() > 5 and dump.split_starts(lines).filter("state > 0").count() > 2
        found = [r["statement"] for r in dump.statements(spark, path).orderBy("n").collect()]
        assert len(found) == 58 + 4 and found[-1] == "select 1" and found[0].startswith("CREATE TABLE `t`")
        got = dump.read_table(spark, path, "t")
        assert got.dtypes == [("id", "bigint"), ("v;x", "string")] and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == rows
        monkey = dump.BROADCAST_SPLITS
        dump.BROADCAST_SPLITS = 1
        try:
            assert dump.read_table(spark, path, "t").count() == 400
        finally:
            dump.BROADCAST_SPLITS = monkey
        with pytest.raises(LookupError):
            dump.read_table(spark, path, "none")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_kinds_of_values_and_definitions():
    assert dump.inserted("insert ignore into db.`a``b` (`y`, x) values (1,NULL),\n(-2.5e3, _binary 'q''\\0\\%'), (0xFF,\"d\"\"\")") == ("a`b", ["y", "x"], [["1", None], ["-2.5e3", "q'\0%"], ["0xFF", 'd"']])
    assert dump.inserted("REPLACE INTO t VALUES ('(a),')") == ("t", None, [["(a),"]]) and dump.inserted("SET x = 'INSERT INTO t VALUES (1)'") is None
    for broken in ("INSERT INTO t VALUES (1", "INSERT INTO t VALUES ('a), (2)", "INSERT INTO t VALUES ()x"):
        with pytest.raises(ValueError, match="no "):
            dump.inserted(broken)
    body = "`a` bigint(20) unsigned, b decimal(8, 2) not null default '1,0', `key` datetime, c enum('x','y)'), d tinyint(1) comment 'unsigned', e double, unique key `u` (`a`), constraint z foreign key (a) references q (b)"
    assert dump.created(f"CREATE TABLE IF NOT EXISTS x.`t` ({body}) engine=q comment='(z)'") == (
        "t", [("a", "decimal(20,0)"), ("b", "decimal(8,2)"), ("key", "timestamp_ntz"), ("c", "string"), ("d", "int"), ("e", "double")]
    )


def test_several_files_wrong_inserts_and_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make = "CREATE TABLE t (a int, b decimal(5,2), c datetime);\n"
    (tmp_path / "in" / "1.sql").write_text(make + "INSERT INTO t VALUES (1, 2.5, '2020-01-02 03:04:05');\nINSERT INTO u VALUES (7);")
    (tmp_path / "in" / "2.sql").write_text(make + "INSERT INTO t (c, a) VALUES (NULL, 2);\nINSERT INTO t VALUES (3, 1")
    (tmp_path / "in" / "3.sql").write_text("")
    path = str(tmp_path / "in")
    assert sorted(map(tuple, dump.read_table(spark, path, "t", strict=False).collect())) == [(1, Decimal("2.50"), datetime(2020, 1, 2, 3, 4, 5)), (2, None, None)]
    with pytest.raises(Exception, match="no value"):
        dump.read_table(spark, path, "t").collect()
    assert dump.statements(spark, f"{path}/3.sql").count() == 0 and dump.tables(dump.statements(spark, f"{path}/3.sql")) == {}


def test_written_dump_reads_back(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "id bigint, v string, d double").withColumnRenamed("id", "i`d").repartition(3)
    dump.write_dump(df, str(tmp_path / "out"), "na`me", rows=20)
    assert sorted(map(tuple, dump.read_table(spark, str(tmp_path / "out"), "na`me").collect()), key=lambda r: r[0]) == [(*r, 1.5) for r in rows]
