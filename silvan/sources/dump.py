"""Dumps of a MySQL database: statements, and the rows of their inserts as typed tables.

A dump is read as lines by Spark's text source, so a large file is many tasks. Whether a line begins inside a string or a
comment depends on all lines before it. Each split of a file therefore gives, for each state that it may begin in, the state
that it ends in and how many statements end on the way; these functions, one narrow row a split, are composed in a prefix
scan over the file's splits, and the second pass over the lines knows how each split begins and numbers its parts. These are
written once, to the shared folder. A statement ends at a semicolon that is neither in a string, a quoted name nor a comment;
the parts of one that goes over splits are joined by its number.

Comments (also those that a server of some version would run) are left out; strings, quoted names and what they hold stay
as they are: semicolons, line ends, back-ticks, escapes, words that look like statements. DELIMITER, a command of the
client, isn't known: routines in a dump are not read.

Values are NULL, numbers, strings with backslash escapes or doubled quotes, hexadecimal strings and bare words; a string's
character-set introducer is passed over. A column's type follows its definition, and what has no counterpart is a string.
An insert without a column list has the table's order. An insert that can't be read is an error, or is left out
(`strict=False`).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.functions.arrays import scan
from silvan.session import cut as checkpoint
from silvan.session import scratch_path

CODE, SINGLE, DOUBLE, NAME, COMMENT = range(5)
STATES = 5
#: What code looks out for, and all up to what ends another state.
_MARK = re.compile(r"['\"`;#]|/\*|--(?=\s|$)")
_CLOSE = {
    SINGLE: re.compile(r"[^'\\]*+(?:\\.[^'\\]*+)*+'", re.S),
    DOUBLE: re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S),
    NAME: re.compile("[^`]*+`"),
    COMMENT: re.compile(r".*?\*/", re.S),
}
_OPENS = {"'": SINGLE, '"': DOUBLE, "`": NAME, "/*": COMMENT}
#: Splits whose starts are handed to all tasks; with more of them, lines are dealt by split.
BROADCAST_SPLITS = 100_000


def _after(text: str, mark: re.Match) -> int:
    """Where code goes on after a mark that opens nothing: a comment to the end of its line goes up to the line's end."""
    if mark.group() == ";":
        return mark.end()
    end = text.find("\n", mark.end())
    return len(text) if end < 0 else end


def cut(text: str, state: int) -> tuple[list[str], int]:
    """Whole lines from a state on: their parts between ends of statements without comments, and the state they leave.

    A doubled quote closes a string and opens it again, which comes to the same.
    """
    parts, held, begin, at = [], [], 0, 0
    while True:
        if state != CODE:
            if not (closed := _CLOSE[state].match(text, at)):
                break
            at = closed.end()
            if state == COMMENT:
                held.append(" ")
                begin = at
            state = CODE
        if not (mark := _MARK.search(text, at)):
            break
        state = _OPENS.get(mark.group(), CODE)
        at = mark.end() if state else _after(text, mark)
        if state in (CODE, COMMENT):
            held.append(text[begin : mark.start()])
            begin = at
        if mark.group() == ";":
            parts.append("".join(held))
            held = []
    if state != COMMENT:
        held.append(text[begin:])
    return [*parts, "".join(held)], state


def passed(text: str) -> list[tuple[int, int]]:
    """For each state that whole lines may begin in the one that they leave, and how many statements end in them. Ways that
    meet in code go on as one: in a dump's own strings that is soon."""
    known, out = {}, []
    for state in range(STATES):
        at, n, way = 0, 0, []
        while True:
            if state != CODE:
                if not (closed := _CLOSE[state].match(text, at)):
                    break
                state, at = CODE, closed.end()
            if at in known:
                state, n = known[at][0], n + known[at][1]
                break
            way.append((at, n))
            if not (mark := _MARK.search(text, at)):
                break
            state = _OPENS.get(mark.group(), CODE)
            at = mark.end() if state else _after(text, mark)
            n += mark.group() == ";"
        out.append((state, n))
        known.update((place, (state, n - before)) for place, before in way)
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), line; a task has the lines of a split one after another, in order."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[pa.RecordBatch]]]:
    """file, split and its rows in stretches, for each split in turn."""

    def stretches() -> Iterator[pa.RecordBatch]:
        for batch in filter(lambda b: b.num_rows, batches):
            file, split = batch.column("file"), batch.column("split")
            other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(split[1:], split[:-1]))
            edges = [0, *(k + 1 for k in pc.indices_nonzero(other).to_pylist()), batch.num_rows]
            yield from (batch.slice(lo, hi - lo) for lo, hi in itertools.pairwise(edges))

    for (file, split), mine in itertools.groupby(stretches(), lambda b: (b.column("file")[0].as_py(), b.column("split")[0].as_py())):
        yield file, split, mine


def _text(rows: pa.RecordBatch) -> str:
    return "\n".join(rows.column("line").to_pylist())


def _split_ends(lines: DataFrame) -> DataFrame:
    """file, split, ends, counts: for each state that the split may begin in the one that it ends in, and the ends of statements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, rows in _by_split(batches):
            now = [(s, 0) for s in range(STATES)]
            for text in map(_text, rows):
                after = passed(text)
                now = [(after[s][0], n + after[s][1]) for s, n in now]
            ends, counts = pa.array([[s for s, _ in now]], pa.list_(pa.int32())), pa.array([[n for _, n in now]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), ends, counts], ["file", "split", "ends", "counts"])

    return lines.mapInArrow(run, "file string, split long, ends array<int>, counts array<long>")


def split_starts(lines: DataFrame) -> DataFrame:
    """file, split, state that it begins in, base (the file's statements that end before it): the functions of a file's
    splits composed in order."""
    files = _split_ends(lines).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "ends", "counts"))).alias("s"))
    begin = F.struct(F.lit(CODE).alias("state"), F.lit(0).cast("long").alias("base"))

    def step(now: Column, x: Column) -> tuple[Column, Column]:
        return F.struct(F.get(x["ends"], now["state"]).alias("state"), (now["base"] + F.get(x["counts"], now["state"])).alias("base")), now

    states = scan(F.col("s"), begin, "struct<state:int,base:bigint>", step)
    both = F.explode(F.arrays_zip(F.col("s.split").alias("split"), states.alias("at"))).alias("x")
    return files.select("file", both).select("file", "x.split", "x.at.state", "x.at.base")


def _parts(lines: DataFrame) -> DataFrame:
    """file, split, n (its statement's number), nth part in the split, text, ends (a semicolon follows) of lines (file, split,
    line, state and base of the split's start)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, split, rows in _by_split(batches):
            state, nth, open_ = None, 0, []
            for some in rows:
                if state is None:
                    state, base = (some.column(c)[0].as_py() for c in ("state", "base"))
                parts, state = cut(_text(some), state)
                open_.append(parts[0])
                for part in parts[1:]:
                    yield file, split, base + nth, nth, "\n".join(open_), True
                    nth, open_ = nth + 1, [part]
            yield file, split, base + nth, nth, "\n".join(open_), False

    names = ["file", "split", "n", "nth", "text", "ends"]
    return lines.mapInArrow(lambda batches: _batched(found(batches), names, 4), "file string, split long, n long, nth long, text string, ends boolean")


def _batched(rows: Iterator[tuple], names: list[str], text: int, types: dict[str, pa.DataType] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of many small ones or a few large ones, by the length of one column."""
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, (types or {}).get(n)) for n, c in zip(names, zip(*held, strict=True), strict=True)], names)
    for row in rows:
        held.append(row)
        size += len(row[text])
        if len(held) >= 10_000 or size >= 1 << 23:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, n, statement of the dumps at path, without the semicolon, numbered in order but not without gaps.

    A split's last part goes on in the first part of the next; only these two meet in a group, all others stay where they
    are. What is left after a file's last semicolon is a statement too.
    """
    lines = _lines(spark, path)
    starts = checkpoint(split_starts(lines))
    if starts.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        known = lines.join(F.broadcast(starts), ["file", "split"]).select("file", "split", "line", "state", "base")
    else:
        numbered = lines.withColumn("nr", F.monotonically_increasing_id())
        known = numbered.join(starts, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "nr").select("file", "split", "line", "state", "base")
    where = scratch_path(spark, "statements")
    _parts(known).write.parquet(where)
    parts = spark.read.parquet(where)
    whole = parts.filter("ends and nth > 0").select("file", "n", F.col("text").alias("statement"))
    meet = parts.filter("not ends or nth = 0").groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("p"))
    joined = meet.select("file", "n", F.array_join("p.text", "\n").alias("statement"))
    trimmed = F.btrim("statement", F.lit(" \t\n\x0b\f\r"))
    return whole.unionByName(joined).withColumn("statement", trimmed).filter("statement != ''")


_NAMES = r"`(?:[^`]|``)+`|[\w$]+"
_INSERT = re.compile(rf"\s*(?:insert|replace)\b[^`'\"(]*?(?:into\s+)?({_NAMES})(?:\s*\.\s*({_NAMES}))?\s*(\([^)]*\))?\s*values?\s*", re.I)
_VALUE = re.compile(r"\s*(?:_\w+\s*)?('[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|\"[^\"\\]*+(?:(?:\\.|\"\")[^\"\\]*+)*+\"|[^\s,()'\"]+)\s*([,)])", re.S)
#: Escapes of a string that stand for another character: fixed values of the dump's format. Any other stands for itself.
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def _name(quoted: str) -> str:
    return quoted[1:-1].replace("``", "`") if quoted.startswith("`") else quoted


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _value(raw: str) -> str | None:
    if raw[0] in "'\"":
        q = raw[0]
        if "\\" not in raw and raw.find(q, 1) == len(raw) - 1:
            return raw[1:-1]
        return re.sub(rf"\\(.)|{q}{q}", lambda m: _ESCAPES.get(m[1], m[1]) if m[1] else q, raw[1:-1], flags=re.S)
    return None if raw.upper() == "NULL" else raw


def inserted(statement: str) -> tuple[str, list[str] | None, list[list[str | None]]] | None:
    """Table, columns if they are named, and tuples of an insert; None for any other statement, ValueError for one that breaks off."""
    head = _INSERT.match(statement)
    if not head:
        return None
    at, rows = head.end(), []
    names = [_name(x) for x in re.findall(_NAMES, head[3])] if head[3] else None
    while True:
        if statement[at : at + 1] != "(":
            raise ValueError(f"no tuple at {at}")
        row, at = [], at + 1
        while True:
            value = _VALUE.match(statement, at)
            if not value:
                raise ValueError(f"no value at {at}")
            row.append(_value(value[1]))
            at = value.end()
            if value[2] == ")":
                break
        rows.append(row)
        rest = re.compile(r"\s*,\s*|\s*").match(statement, at)
        at = rest.end()
        if at == len(statement) or "," not in rest.group():
            break
    return _name(head[2] or head[1]), names, rows


def insert_rows(found: DataFrame, strict: bool = True) -> DataFrame:
    """table, names (null if the insert has none), row (array of strings) of the inserts among statements."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for statement in batch.column("statement").to_pylist():
                try:
                    got = inserted(statement)
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{e}: {statement[:80]}") from e
                    continue
                if got:
                    yield from ((got[0], got[1], row) for row in got[2])

    names = ["table", "names", "row"]
    kinds = {"names": pa.list_(pa.string()), "row": pa.list_(pa.string())}
    return found.select("statement").mapInArrow(lambda batches: _batched(rows(batches), names, 2, kinds), "table string, names array<string>, row array<string>")


_CREATE = re.compile(rf"\s*create\s+(?:temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?(?:(?:{_NAMES})\s*\.\s*)?({_NAMES})\s*\((.*)\)", re.I | re.S)
#: What a definition without a column begins with: fixed values of the dump's format.
_NO_COLUMN = re.compile(r"(?:primary|unique|key|index|fulltext|spatial|constraint|foreign|check)\b", re.I)
#: Counterparts of column types: fixed values.
_TYPES = {
    "tinyint": "int", "smallint": "int", "mediumint": "int", "int": "int", "integer": "int", "year": "int", "bool": "int", "boolean": "int",
    "bigint": "bigint", "float": "double", "double": "double", "real": "double", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
}
_WIDER = {"int": "bigint", "bigint": "decimal(20,0)"}


def _definitions(body: str) -> list[str]:
    """The parts of a table's body between commas outside brackets, strings and quoted names."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)+`|[(),]", body, re.S):
        depth += {"(": 1, ")": -1}.get(m.group(), 0)
        if m.group() == "," and not depth:
            out.append(body[begin : m.start()].strip())
            begin = m.end()
    return [*out, body[begin:].strip()]


def created(statement: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Table, and name and Spark type of its columns; None for any other statement."""
    head = _CREATE.match(statement)
    if not head:
        return None
    columns = []
    for d in _definitions(head[2]):
        m = re.match(rf"({_NAMES})\s+(\w+)\s*(\(\s*\d+\s*(?:,\s*\d+\s*)?\))?([^'\"]*)", d)
        if not m or d[0] != "`" and _NO_COLUMN.match(d):
            continue
        kind = m[2].lower()
        if kind in ("decimal", "numeric", "dec"):
            mine = "decimal" + (re.sub(r"\s", "", m[3]) if m[3] else "(10,0)")
        else:
            mine = _TYPES.get(kind, "string")
            mine = _WIDER.get(mine, mine) if "unsigned" in m[4].lower() else mine
        columns.append((_name(m[1]), mine))
    return _name(head[1]), columns


def tables(found: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Columns of the tables that statements create; of a table created twice, those of the last. One small row a table."""
    rows = found.filter(F.lower(F.left("statement", F.lit(6))) == "create").orderBy("file", "n").toLocalIterator()
    return dict(filter(None, (created(r["statement"]) for r in rows)))


def _at(columns: list[str], name: str) -> Column:
    """The value of a column: by the insert's own list, or by place."""
    place = F.coalesce(F.array_position("names", name).cast("int"), F.when(F.col("names").isNull(), columns.index(name) + 1).otherwise(0))
    return F.get("row", place - 1)


def read_table(spark: SparkSession, path: str, table: str, strict: bool = True) -> DataFrame:
    """A table of the dumps at path with its columns' types; LookupError if no statement creates it."""
    found = statements(spark, path)
    columns = tables(found).get(table)
    if columns is None:
        raise LookupError(table)
    names = [c for c, _ in columns]
    rows = insert_rows(found, strict).filter(F.col("table") == table)
    return rows.select(*(_at(names, c).cast(kind).alias(c) for c, kind in columns))


def write_dump(df: DataFrame, path: str, table: str, rows: int = 500) -> None:
    """df's rows as inserts of at most `rows` tuples, one file for each task, each with the table's definition."""
    kinds = {"int": "int", "bigint": "bigint", "double": "double", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    body = ",\n".join(f"  {_quoted(c)} {kinds.get(k, k if k.startswith('decimal') else 'longtext')}" for c, k in df.dtypes)
    name = _quoted(table)
    head = f"DROP TABLE IF EXISTS {name};\nCREATE TABLE {name} (\n{body}\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;"

    def literal(c: str) -> Column:
        text = F.replace(F.replace(F.col(_quoted(c)).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))

    tuples = df.select(F.concat(F.lit("("), F.concat_ws(",", *(literal(c) for c in df.columns)), F.lit(")")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays([pa.array([f"INSERT INTO {name} VALUES {','.join(batch.column(0).slice(at, rows).to_pylist())};"])], ["value"])

    tuples.mapInArrow(run, "value string").write.text(path)
