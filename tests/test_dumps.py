import random

import pytest

from gridwright.sources import dumps


def plain_statements(text):
    """Statements by a walk over all characters."""
    out, now, inside, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if not inside and text.startswith("--", i):
            while i < len(text) and text[i] != "\n":
                i += 1
            continue
        if c == "'":
            inside = not inside
        if c == ";" and not inside:
            out.append((now.strip(), True))
            now = ""
        else:
            now += c
        i += 1
    out.append((now.strip(), False))
    return [x for x in out if x[0]]


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few lines."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("96b", "1b", "64"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_statements_match_a_walk(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    marks = ["'", "''", ";", "--", "\n", "\r\n", "a", " b ", "(", ",", "\x01", "\x01\x02", "\n\n", "é"]
    for k in range(12):
        text = "".join(rng.choice(marks) for _ in range(300))
        (tmp_path / f"{k}.sql").write_bytes(text.encode())
        found = dumps.statements(spark, str(tmp_path / f"{k}.sql")).orderBy("number").collect()
        assert [(r["statement"], r["ended"]) for r in found] == plain_statements(text), k


def test_rows(spark, tmp_path, small_blocks):
    text = """-- it's a dump
CREATE TABLE w (a int, b text);\r
INSERT INTO w (a, b) VALUES (1, 'x'';
 y'), (2, NULL);
insert into w VALUES (3,'(z), ''q'''),
  ( 4 , '' ); INSERT INTO other VALUES (4, 'INSERT INTO w VALUES (9, 9);');
INSERT INTO "s"."w" ("b", "a") VALUES ('line\r
;', 5);\r
INSERT INTO w (b) VALUES ('-- no comment'); -- ; '
INSERT INTO w2 VALUES (7, 'n');
"""
    (tmp_path / "d.sql").write_bytes(text.encode())
    got = dumps.sql_dump(spark, str(tmp_path / "d.sql"), "w", "a int, b string").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "x';\n y"), (2, None), (3, "(z), 'q'"), (4, ""), (5, "line\r\n;"), (None, "-- no comment")], key=str)


@pytest.mark.parametrize("text, said", [("INSERT INTO w VALUES ('x', 'y');", "no int"), ("INSERT INTO w VALUES (1);", "1 cells"), ("INSERT INTO w VALUES (1, 'x'", "without its end"), ("INSERT INTO w VALUES (1, 'x;\n", "without its end")])
def test_malformed_rows_raise(spark, tmp_path, text, said):
    (tmp_path / "d.sql").write_text(text)
    with pytest.raises(Exception, match=said):
        dumps.sql_dump(spark, str(tmp_path / "d.sql"), "w", "a int, b string").collect()


def test_empty_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("")
    assert dumps.sql_dump(spark, str(tmp_path / "d.sql"), "w", "a int").count() == 0
