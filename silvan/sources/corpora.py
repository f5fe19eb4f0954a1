"""The corpora: for each one how its files become units.

A binding gives rows of `UNIT`: key, parent_key, depth, label, text, uncleaned_text, author, metadata (JSON) and position,
parents before children. Plain texts are lines with their numbers: a heading's value is filled forward to the lines below
it, so each binding is its headings, what it leaves out and how its lines are joined. Names, headings and number ranges
that texts and labels must have are marked as fixed values. What differs between files of one corpus is a parameter.

A null or blank text makes no leaf, and a heading with nothing below it no unit, unless the binding says so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.sources import documents as D
from silvan.sources import tabular

#: A Roman numeral, as a part of a pattern.
NUMERAL = "[IVXLCDM]+"
UNIT = ("key", "parent_key", "depth", "label", "text", "uncleaned_text", "author", "metadata", "position")


@dataclass(frozen=True)
class Level:
    """A level's key (null: the row has no unit there), label, metadata and author."""

    key: Column
    label: Column
    metadata: Column | None = None
    author: Column | None = None


def tree_of(rows: DataFrame, levels: Sequence[Level], text: Column, position: Column, uncleaned: Column | None = None) -> DataFrame:
    """Units of rows, of which each is a leaf and names the levels above it, from the top down; a parent stands where its
    first row does. A row whose last key is null only makes the parents that it names."""
    none, out = F.lit(None).cast("string"), None
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        up = levels[depth - 1].key if depth else none
        unit = rows.select(
            level.key.cast("string").alias("key"), up.cast("string").alias("parent_key"), F.lit(depth).alias("depth"), level.label.cast("string").alias("label"), (text if leaf else none).alias("text"),
            (uncleaned if leaf and uncleaned is not None else none).alias("uncleaned_text"), (none if level.author is None else level.author).alias("author"), (none if level.metadata is None else level.metadata).alias("metadata"), position.cast("long").alias("position"),
        ).filter("key is not null")
        if not leaf:
            first = F.min_by(F.struct("label", "author", "metadata"), "position").alias("u")
            unit = unit.groupBy("key", "parent_key", "depth").agg(first, F.min("position").alias("position")).select("key", "parent_key", "depth", "u.label", none.alias("text"), none.alias("uncleaned_text"), "u.author", "u.metadata", "position")
        out = unit if out is None else out.unionByName(unit)
    return out.select(*UNIT)


def _json(**fields: Column | str) -> Column:
    """Fields that are null are left out; nothing at all is null."""
    made = F.to_json(F.struct(*((F.lit(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items())))
    return F.when(made != "{}", made)


def _text(value: Column) -> Column:
    return T.blank_to_null(value)


def _part(pattern: str, group: int = 1, line: str = "line") -> Column:
    """What a pattern's group holds, null where it doesn't match."""
    return F.when(F.col(line).rlike(pattern), F.regexp_extract(line, pattern, group))


def _rows(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def _file_order(df: DataFrame) -> DataFrame:
    """df with position in file order: rows of a text file are numbered within partitions that follow the file."""
    return df.withColumn("position", F.monotonically_increasing_id())


# ---- tables ----
#: Books of the two testaments, and the editions' names and translators.
TESTAMENTS = {"Old Testament": (1, 39), "New Testament": (40, 66)}
EDITIONS = {
    "KJV": ("King James Version", "Various (royal commission)"),
    "ACV": ("A Conservative Version", "Walter L. Porter"),
    "YLT": ("Young's Literal Translation", "Robert Young"),
    "BBE": ("Bible in Basic English", "S. H. Hooke"),
}


def bible(spark: SparkSession, path: str, edition: str = "KJV", testament: str = "Old Testament") -> DataFrame:
    """Book, chapter, verse of one testament from a SQLite file with the edition's tables of books and verses."""
    t, (low, high) = edition.upper(), TESTAMENTS[testament]
    sql = f"select b.id, b.name, v.chapter, v.verse, v.text from {t}_verses v join {t}_books b on v.book_id = b.id order by b.id, v.chapter, v.verse"
    df = tabular.read_sqlite(spark, path, sql, "book_id int, name string, chapter int, verse int, text string")
    df = df.filter(F.col("book_id").between(low, high) & _text(F.col("text")).isNotNull())
    chapter = F.concat_ws(" ", "name", F.col("chapter").cast("string"))
    verse = F.concat_ws(":", chapter, F.col("verse").cast("string"))
    levels = [Level(F.col("name"), F.col("name")), Level(chapter, chapter), Level(verse, verse)]
    return tree_of(df, levels, F.regexp_replace("text", r"^\s+|\s+$", ""), F.expr("book_id * 1000000000L + chapter * 100000L + verse * 10L"), F.col("text"))


def quran(spark: SparkSession, path: str) -> DataFrame:
    names = ["surah_no", "surah_name_en", "surah_name_roman", "ayah_no_surah", "ayah_ar", "ayah_en"]
    df = _file_order(tabular.read_csv(spark, path, names)).filter(_text(F.col("ayah_en")).isNotNull())
    surah, ayah = F.col("surah_no").cast("int"), F.col("ayah_no_surah").cast("int")
    label = F.concat(surah, F.lit(". "), "surah_name_en", F.lit(" ("), "surah_name_roman", F.lit(")"))
    place = F.concat_ws(":", surah, ayah)
    return tree_of(df, [Level(F.concat(F.lit("Surah "), surah), label), Level(F.concat(F.lit("Surah "), place), place)], F.col("ayah_en"), F.col("position"), F.col("ayah_ar"))


def gita(spark: SparkSession, path: str) -> DataFrame:
    df = _file_order(tabular.read_csv(spark, path, ["chapter_number", "chapter_title", "chapter_verse", "translation"]))
    chapter = T.first_integer(F.col("chapter_number"))
    df = df.filter(_text(F.col("translation")).isNotNull() & chapter.isNotNull())
    verse = F.concat_ws(".", chapter, F.trim(F.split(F.substring_index("chapter_verse", ".", -1), "–")[0]))
    key = F.concat(F.lit("Chapter "), chapter)
    return tree_of(df, [Level(key, F.concat(key, F.lit(": "), "chapter_title")), Level(verse, F.col("chapter_verse"))], F.col("translation"), F.col("position"))


def bhagavatam(spark: SparkSession, path: str) -> DataFrame:
    """Verses are numbered within a chapter in file order."""
    df = _file_order(tabular.read_csv(spark, path, ["canto_number", "canto_title", "chapter_number", "chapter_title", "translation"]))
    df = df.withColumns({"canto": T.first_integer(F.col("canto_number")), "chapter": T.first_integer(F.col("chapter_number"))})
    df = df.filter(_text(F.col("translation")).isNotNull() & F.col("canto").isNotNull() & F.col("chapter").isNotNull())
    df = tabular.running_number(df, ["canto", "chapter"], "position", "verse")
    canto = F.concat(F.lit("Canto "), "canto")
    chapter, place = F.concat(canto, F.lit(" Chapter "), "chapter"), F.concat_ws(".", "canto", "chapter")
    levels = [
        Level(canto, F.concat(canto, F.lit(": "), "canto_title")),
        Level(chapter, F.concat(place, F.lit(": "), "chapter_title")),
        Level(F.concat(chapter, F.lit(" Text "), "verse"), F.concat_ws(".", place, "verse")),
    ]
    return tree_of(df, levels, F.col("translation"), F.col("position"))


#: Books in their order.
KANDAS = ("BalaKanda", "AyodhyaKanda", "AranyaKanda", "KishkindhaKanda", "SundaraKanda", "YuddhaKanda")


def ramayana(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array for each book; items that are no objects, or lack a chapter, verse or translation, are left out."""
    fields = "chapter string, verse string, translation string, wordDictionary string"
    df = spark.read.schema(fields).json(path, multiLine=True, mode="PERMISSIVE").withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    df = df.select("file", *(_text(F.col(c)).alias(c) for c in ("chapter", "verse", "translation", "wordDictionary"))).withColumn("position", F.monotonically_increasing_id())
    order = F.array_position(F.array(*map(F.lit, KANDAS)), F.col("file"))
    df = df.dropna(subset=["chapter", "verse", "translation"]).withColumn("book", order).filter("book > 0")
    # Within a file the reader's order is the file's; books follow one another.
    nth = F.row_number().over(Window.partitionBy("file").orderBy("position"))
    df = df.withColumn("position", F.col("book") * 10_000_000 + nth)
    chapter = F.concat("file", F.lit(":ch"), "chapter")
    levels = [
        Level(F.col("file"), F.col("file")),
        Level(chapter, F.concat("file", F.lit(" Chapter "), "chapter")),
        Level(F.concat(chapter, F.lit(":v"), "verse"), F.concat_ws(".", "chapter", "verse"), _json(word_dictionary=F.col("wordDictionary"))),
    ]
    return tree_of(df, levels, F.col("translation"), F.col("position"))


#: What ends a stanza, what stands over one, and the names of its forms.
STANZA_END = "॥[੦-੯]+॥"
FORMS = {"ਪਉੜੀ": "Pauree", "ਛੰਤੁ": "Chhant", "ਸਲੋਕੁ": "Shalok", "ਸਲੋਕ": "Shalok", "ਭਗਤ": "Bhagat", "ਸਵਯੇ": "Savaiye", "ਦੁਤੁਕੇ": "Dutuke"}
FORM_IN_ENGLISH = r"(?i)^(?:Pauree|Chhant|Shalok|Salok|Swaiyas?|Couplet):\s*$"
#: The number that English translations have.
ENGLISH = 13


def sggs(spark: SparkSession, path: str) -> DataFrame:
    """Raag, section, hymn, stanza. A stanza ends with the line that holds the end mark; what is left after the last is one too."""
    sql = f"""select s.id, s.hymn, s.text, s.section, s.page, t.text as translation, a.author from scriptures s
        left join translations t on t.scripture_id = s.id and t.language_id = {ENGLISH} left join authors a on a.id = s.author_id order by s.id"""
    df = tabular.read_sqlite(spark, path, sql, "n long, hymn int, text string, section string, page int, translation string, author string")
    hymn = Window.partitionBy("hymn").orderBy("n")
    so_far, before, whole = hymn.rowsBetween(Window.unboundedPreceding, 0), hymn.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("hymn")
    first = lambda c: F.first(c).over(hymn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    line = F.coalesce("text", F.lit(""))
    page = F.when(F.col("page") != 0, F.struct("n", "page"))
    raag, section = T.section_parts(F.coalesce(first("section"), F.lit("")))
    named = F.when(F.lower(F.trim("author")) != "none", F.nullif("author", F.lit("")))
    df = df.withColumns({"line": line, "raag": raag, "part": section, "singer": first(named), "raw": first("section"), "start": F.min(page).over(whole)["page"], "end": F.max(page).over(whole)["page"], "row": F.row_number().over(hymn)})
    header = (F.col("row") == 1) & F.col("line").rlike(r"॥\s*$") & ~F.col("line").rlike(STANZA_END)
    form = F.regexp_extract(F.trim("line"), f"^({'|'.join(FORMS)})\\s*॥\\s*$", 1)
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv)), form)
    ends = F.col("line").rlike(STANZA_END) & F.col("name").isNull()
    df = df.withColumn("name", F.when(~header, name)).withColumn("skip", header | F.col("name").isNotNull())
    df = df.withColumns({"stanza": F.coalesce(F.sum((ends & ~F.col("skip")).cast("int")).over(before), F.lit(0)), "form": F.last("name", True).over(so_far)})
    clean = F.regexp_replace(F.regexp_replace("translation", r"\s*\|\|[^\n]*$", ""), r"^\s+|\s+$", "")
    english = F.when(~F.col("skip") & ~F.trim("translation").rlike(FORM_IN_ENGLISH) & (clean != ""), clean)
    in_order = lambda c: F.nullif(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct("n", c.alias("v"))))), lambda x: x["v"]), "\n")), F.lit(""))
    keys = ["hymn", "raag", "part", "singer", "raw", "start", "end"]
    stanzas = df.groupBy(*keys, "stanza").agg(F.min("n").alias("n"), in_order(english).alias("text"), in_order(F.when(~F.col("skip"), F.col("line"))).alias("original"), F.max_by("form", "n").alias("form"), F.sum((~F.col("skip")).cast("int")).alias("lines"))
    stanzas = stanzas.withColumn("nth", F.sum((F.col("lines") > 0).cast("int")).over(hymn.rowsBetween(Window.unboundedPreceding, 0)))
    shabad = F.concat(F.lit("Shabad "), "hymn")
    real = (F.col("lines") > 0) & (F.col("text").isNotNull() | F.col("original").isNotNull())
    place = F.concat(shabad, F.lit(":"), "nth")
    levels = [
        Level(F.col("raag"), F.col("raag")),
        Level(F.concat("raag", F.lit("::"), "part"), F.col("part"), _json(raag=F.col("raag"))),
        Level(shabad, shabad, _json(hymn=F.col("hymn"), ang_start=F.col("start"), ang_end=F.col("end"), section=F.col("raw")), F.col("singer")),
        Level(F.when(real, place), place, _json(format=F.col("form"))),
    ]
    return tree_of(stanzas, levels, F.col("text"), F.col("n"), F.col("original"))


# ---- plain texts ----
def _body(df: DataFrame, *marks: str) -> DataFrame:
    """Lines below a mark of the last level, without the lines of marks."""
    df = df.filter(F.col(f"{marks[-1]}_at").isNotNull())
    for m in marks:
        df = df.filter(F.col("n") != F.col(f"{m}_at"))
    return df


def _rest(df: DataFrame, mark: str, pattern: str) -> DataFrame:
    """Lines from a mark's own on, which keeps what stands behind the mark."""
    df = df.filter(F.col(f"{mark}_at").isNotNull())
    return df.withColumn("line", F.when(F.col("n") == F.col(f"{mark}_at"), F.regexp_replace("line", pattern, "")).otherwise(F.col("line")))


def upanishads(texts: DataFrame) -> DataFrame:
    """The first occurrence of each heading counts; lines that are a Roman numeral begin a mantra; texts under 20 characters go."""
    name = _part(r"^\s{5,}((?:Isa|Katha|Kena)-Upanishad)\s*$")
    df = D.lines(texts).withColumn("name", name)
    first = F.row_number().over(Window.partitionBy("file", "name").orderBy("n")) == 1
    df = df.withColumn("book", F.when(first, F.translate("name", "-", " ")))
    number = T.roman_to_int(_part(rf"^\s*({NUMERAL})\s*$"))
    df = D.headed(df, {"book": F.col("book"), "mark": F.when(number <= 30, number)})
    items = D.joined(_body(df, "book", "mark"), ["file", "book", "book_at", "mark", "mark_at"]).withColumn("text", T.collapse_spaces(F.col("text"))).filter("length(text) >= 20")
    place = F.concat_ws(" ", "book", "mark")
    return tree_of(items, [Level(F.col("book"), F.col("book")), Level(place, place)], F.col("text"), F.col("n"))


def yoga_sutras(texts: DataFrame) -> DataFrame:
    """Books in Roman numerals; a sutra is its number's first paragraph, comments after a blank line go."""
    df = D.headed(D.lines(texts), {"book": _part(r"^BOOK\s+(I{1,3}V?|IV)$"), "mark": _part(r"^(\d+)\.\s+\S").cast("int")})
    blank = F.max(F.when(F.trim("line") == "", F.col("n"))).over(_rows(["file"]))
    df = _rest(df.withColumn("blank", blank), "mark", r"^\d+\.\s+").filter(F.coalesce("blank", F.lit(-1)) < F.col("mark_at"))
    items = D.joined(df, ["file", "book", "book_at", "mark", "mark_at"]).withColumn("text", _text(F.col("text"))).dropna(subset=["text"])
    book, place = F.concat(F.lit("Book "), "book"), F.concat_ws(".", T.roman_to_int(F.col("book")), "mark")
    return tree_of(items, [Level(book, book), Level(F.concat_ws(".", book, "mark"), place)], F.col("text"), F.col("n"))


def dhammapada(texts: DataFrame) -> DataFrame:
    chapter = rf"^Chapter\s+({NUMERAL})[:.]?\s+(.+)$"
    df = D.lines(texts)
    both = F.when(F.col("line").rlike(chapter), F.struct(T.roman_to_int(F.regexp_extract("line", chapter, 1)).alias("number"), F.trim(F.regexp_extract("line", chapter, 2)).alias("title")))
    df = D.headed(df, {"chapter": both, "mark": _part(r"^(\d+)\.").cast("int")})
    items = D.joined(_rest(df, "mark", r"^\d+\."), ["file", "chapter", "chapter_at", "mark", "mark_at"], separator="\n")
    items = items.withColumn("text", _text(F.col("text"))).dropna(subset=["text"])
    key, place = F.concat(F.lit("Chapter "), "chapter.number"), F.concat_ws(".", "chapter.number", "mark")
    return tree_of(items, [Level(key, F.concat(key, F.lit(": "), "chapter.title")), Level(place, place)], F.col("text"), F.col("n"))


def diamond_sutra(texts: DataFrame) -> DataFrame:
    """Chapters are leaves; numbers in brackets are footnotes."""
    df = _rest(D.headed(D.lines(texts), {"chapter": _part(r"^\[Chapter\s+(.+?)\]")}), "chapter", r"^\[Chapter\s+.+?\]")
    items = D.joined(df, ["file", "chapter", "chapter_at"]).withColumn("text", _text(F.regexp_replace("text", r"\[\d+\]", ""))).dropna(subset=["text"])
    key = F.concat(F.lit("Chapter "), F.trim("chapter"))
    return tree_of(items, [Level(key, key)], F.col("text"), F.col("n"))


def jataka(texts: DataFrame) -> DataFrame:
    """A tale's name is a line in capitals, its title the line before; the story begins after the catalogue's number and ends at stars."""
    df = D.lines(texts)
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    title = F.last(F.when(F.trim("line") != "", F.trim("line")), True).over(before)
    name = _part(r"^((?:[\p{Lu}][\p{Lu}\-\s]+)J[ĀA]TAKA)\.$")
    df = df.withColumn("title", title)
    df = D.headed(df, {"tale": F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce("title", name).alias("title")))})
    number = r"^\(Fausböll,\s*No\.\s*(\d+)\.?\)"
    tale = Window.partitionBy("file", "tale_at")
    df = _body(df, "tale").withColumn("number_at", F.min(F.when(F.col("line").rlike(number), F.col("n"))).over(tale))
    df = df.withColumn("number", F.max(F.when(F.col("n") == F.col("number_at"), _part(number).cast("int"))).over(tale))
    df = df.filter(F.col("n") >= F.coalesce("number_at", F.lit(-1))).withColumn("line", F.when(F.col("n") == F.col("number_at"), F.regexp_replace("line", number, "")).otherwise(F.col("line")))
    df = df.withColumn("stars", F.min(F.when(F.col("line").rlike(r"^\s*\*\s*\*\s*\*"), F.col("n"))).over(tale)).filter("stars is null or n < stars")
    items = D.joined(df, ["file", "tale", "tale_at", "number"]).withColumn("text", _text(F.col("text"))).dropna(subset=["text"])
    return tree_of(items, [Level(F.col("tale.name"), F.col("tale.title"), _json(pali_name=F.col("tale.name"), fausboll_no=F.col("number")))], F.col("text"), F.col("n"))


def analects(texts: DataFrame) -> DataFrame:
    """Chapters may begin inside a line; a numeral above thirty stands for its place."""
    chapter = rf"CHAP(?:TER)?\.\s+({NUMERAL})\."
    df = D.lines(texts.withColumn("text", F.regexp_replace("text", chapter, "\n$0")))
    book = rf"^BOOK\s+({NUMERAL})\.\s+(.+)$"
    both = F.when(F.col("line").rlike(book), F.struct(F.regexp_extract("line", book, 1).alias("roman"), F.regexp_replace(F.trim(F.regexp_extract("line", book, 2)), r"\.+$", "").alias("title")))
    df = D.headed(df, {"book": both, "mark": _part("^" + chapter)})
    items = D.joined(_rest(df, "mark", "^" + chapter), ["file", "book", "book_at", "mark", "mark_at"])
    nth = F.row_number().over(Window.partitionBy("file", "book_at").orderBy("mark_at"))
    number = T.roman_to_int(F.col("mark"))
    items = items.withColumn("number", F.when(number <= 30, number).otherwise(nth)).withColumn("text", _text(F.col("text"))).dropna(subset=["text"])
    key = F.concat(F.lit("Book "), "book.roman")
    place = F.concat_ws(".", T.roman_to_int(F.col("book.roman")), "number")
    return tree_of(items, [Level(key, key, _json(title=F.col("book.title"))), Level(F.concat_ws(".", key, "mark"), place)], F.col("text"), F.col("n"))


def chuang_tzu(texts: DataFrame) -> DataFrame:
    """Chapters are leaves in the order of their numerals. The first line of a chapter is its title; an argument, up to the next
    blank line, and lines indented by four go; marks of footnotes and italics too."""
    df = D.headed(D.lines(texts), {"chapter": _part(rf"^CHAPTER\s+({NUMERAL})\.\s*$")})
    df = _body(df, "chapter")
    rows = _rows(["file", "chapter_at"])
    blank = F.trim("line") == ""
    title_at = F.min(F.when(~blank, F.col("n"))).over(Window.partitionBy("file", "chapter_at"))
    df = df.withColumn("title_at", title_at).withColumn("title", F.regexp_replace(F.trim(F.max(F.when(F.col("n") == F.col("title_at"), F.col("line"))).over(Window.partitionBy("file", "chapter_at"))), r"\.+$", ""))
    df = df.filter("n > title_at")
    opened = F.ltrim("line").startswith("_Argument_")
    # Inside an argument from its first line; the blank line that ends it still belongs to it.
    state = F.last(F.when(opened, 1).when(F.trim("line") == "", 0), True)
    before = Window.partitionBy("file", "chapter_at").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"inside": F.coalesce(state.over(rows), F.lit(0)), "was": F.coalesce(state.over(before), F.lit(0))})
    df = df.filter("inside = 0 and was = 0").filter(~(F.col("line").startswith("    ") & (F.trim("line") != "")))
    items = D.joined(df.withColumn("line", F.rtrim("line")), ["file", "chapter", "chapter_at", "title"], separator="\n")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("text"), r"\n{3,}", "\n\n"), r"\[\d+\]", ""), r"_([^_]+)_", "$1")
    items = items.withColumn("text", F.regexp_replace(text, r"^\s+|\s+$", "")).filter("text != ''")
    return tree_of(items, [Level(F.concat(F.lit("Chapter "), "chapter"), F.concat_ws(" — ", "chapter", "title"))], F.col("text"), T.roman_to_int(F.col("chapter")))


def _paragraphs(df: DataFrame, keys: list[str], breaks: Column) -> DataFrame:
    """keys, n, nth, text: runs of lines between breaks, numbered within the last key's heading."""
    rows = _rows(["file"])
    df = df.withColumn("stop", breaks).withColumn("run", F.sum(F.col("stop").cast("int")).over(rows)).filter("not stop")
    items = D.joined(df.filter(F.col(keys[-1]).isNotNull()), ["file", *keys, "run"]).withColumn("text", _text(F.col("text"))).dropna(subset=["text"])
    return items.withColumn("nth", F.row_number().over(Window.partitionBy("file", *keys).orderBy("n")))


def _next_line(df: DataFrame, at: str, name: str) -> DataFrame:
    """df with the first line that isn't blank after the heading at `at`, and its number in name_at."""
    w = Window.partitionBy("file", at)
    df = df.withColumn(f"{name}_at", F.min(F.when((F.trim("line") != "") & (F.col("n") > F.col(at)), F.col("n"))).over(w))
    return df.withColumn(name, F.max(F.when(F.col("n") == F.col(f"{name}_at"), F.trim("line"))).over(w))


def _headings(df: DataFrame, *names: str) -> DataFrame:
    """One row for each heading line, for units that stay without leaves."""
    at = F.lit(False)
    for name in names:
        at = at | (F.col("n") == F.col(f"{name}_at"))
    return df.filter(at).withColumns({"text": F.lit(None).cast("string"), "nth": F.lit(None).cast("int")})


def mahabharata(texts: DataFrame) -> DataFrame:
    """Book, parva, section, paragraph; what stands before the title goes. Headings without text are units too."""
    df = D.lines(texts).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    begins = F.coalesce(F.min(F.when(F.upper("line") == "THE MAHABHARATA", F.col("n"))).over(Window.partitionBy("file")), F.lit(0))
    df = df.withColumn("begins", begins).filter("n >= begins")
    df = D.headed(df, {"book": _part(r"(?i)^BOOK\s+([0-9IVXLC]+)\s*$"), "section": _part(r"(?i)^SECTION\s+([A-Z0-9]+)\s*$")})
    df = _next_line(df, "book_at", "follows")
    is_parva = F.upper(F.col("follows")).contains("PARVA")
    df = df.withColumns({"parva": F.when(is_parva, F.initcap("follows")).otherwise("Parva"), "heading": (F.col("n") == F.col("book_at")) | (F.col("n") == F.col("section_at")) | (is_parva & (F.col("n") == F.col("follows_at")))})
    df = df.filter("book_at is not null")
    keys = ["book", "book_at", "parva", "section", "section_at"]
    items = _paragraphs(df, keys, (F.col("line") == "") | F.upper("line").startswith("FOOTNOTES") | F.coalesce("heading", F.lit(False)))
    items = items.select("n", *keys, "nth", "text").unionByName(_headings(df, "book", "section").select("n", *keys, "nth", "text"))
    book = F.concat(F.lit("Book "), "book")
    parva = F.concat_ws(":", book, "parva")
    section = F.when(F.col("section").isNotNull(), F.concat(parva, F.lit(":Section "), "section"))
    return tree_of(items, [Level(book, book), Level(parva, F.col("parva")), Level(section, F.concat(F.lit("Section "), "section")), Level(F.concat(section, F.lit(":p"), "nth"), F.concat(F.lit("§"), "nth"))], F.col("text"), F.col("n"))


def prose_edda(texts: DataFrame, toc_lines: int = 500, least: int = 100) -> DataFrame:
    """Part, chapter, paragraph. Begins at the first part's heading after the table of contents (its first toc_lines lines), ends at the notes."""
    df = D.lines(texts).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    file = Window.partitionBy("file")
    begins = F.coalesce(F.min(F.when((F.upper("line") == "THE FOOLING OF GYLFE.") & (F.col("n") > toc_lines), F.col("n"))).over(file), F.lit(0))
    df = df.withColumn("begins", begins).filter("n >= begins")
    df = df.withColumn("ends", F.min(F.when((F.upper("line") == "NOTES.") & (F.col("n") > F.col("begins") + least), F.col("n"))).over(file)).filter("ends is null or n < ends")
    part = _part(r"(?i)^(THE FOOLING OF GYLFE|BRAGE’S TALK|EXTRACTS FROM THE POETICAL DICTION)\.$")
    df = D.headed(df, {"part": F.initcap(part), "chapter": F.upper(_part(rf"(?i)^CHAPTER\s+({NUMERAL})\.?$"))})
    df = _next_line(df, "chapter_at", "title")
    heading = F.lit(False)
    for c in ("part_at", "chapter_at", "title_at"):
        heading = heading | F.coalesce(F.col("n") == F.col(c), F.lit(False))
    keys = ["part", "part_at", "title", "chapter", "chapter_at"]
    items = _paragraphs(df, keys, (F.col("line") == "") | heading)
    titled = df.filter((F.col("n") == F.col("part_at")) | (F.col("n") == F.col("title_at"))).withColumns({"text": F.lit(None).cast("string"), "nth": F.lit(None).cast("int")})
    items = items.select("n", *keys, "nth", "text").unionByName(titled.select("n", *keys, "nth", "text"))
    chapter = F.when(F.col("title").isNotNull(), F.concat("part", F.lit(":Chapter "), "chapter"))
    label = F.concat(F.lit("Chapter "), "chapter", F.lit(": "), F.initcap("title"))
    return tree_of(items, [Level(F.col("part"), F.col("part")), Level(chapter, label), Level(F.concat(chapter, F.lit(":p"), "nth"), F.concat(F.lit("¶"), "nth"))], F.col("text"), F.col("n"))


#: Headings of the poems, their Norse and their English names, in the book's order.
POEMS = (
    ("VOLUSPO", "Völuspá", "The Wise-Woman's Prophecy"),
    ("HOVAMOL", "Hávamál", "Sayings of the High One"),
    ("VAFTHRUTHNISMOL", "Vafþrúðnismál", "The Ballad of Vafthruthnir"),
    ("GRIMNISMOL", "Grímnismál", "The Ballad of Grimnir"),
    ("SKIRNISMOL", "Skírnismál", "The Ballad of Skirnir"),
    ("HARBARTHSLJOTH", "Hárbarðsljóð", "The Poem of Harbarth"),
    ("HYMISKVITHA", "Hymiskviða", "The Lay of Hymir"),
    ("LOKASENNA", "Lokasenna", "Loki's Wrangling"),
    ("THRYMSKVITHA", "Þrymskviða", "The Lay of Thrym"),
    ("ALVISSMOL", "Álvíssmál", "The Ballad of Alvis"),
    ("RIGSTHULA", "Rígsþula", "The Song of Rig"),
    ("HYNDLULJOTH", "Hyndluljóð", "The Poem of Hyndla"),
    ("FRAGMENT OF “THE SHORT VOLUSPO”", "Grógaldr", "The Spell of Groa"),
    ("II. FJOLSVINNSMOL", "Fjölsvinnsmál", "The Lay of Fjolsvith"),
    ("VÖLUNDARKVITHA", "Völundarkviða", "The Lay of Völund"),
    ("HELGAKVITHA HJORVARTHSSONAR", "Helgakviða Hjörvarðssonar", "The Lay of Helgi Hjorvarthsson"),
    ("HELGAKVITHA HUNDINGSBANA I", "Helgakviða Hundingsbana I", "The First Lay of Helgi Hundingsbane"),
    ("HELGAKVITHA HUNDINGSBANA II", "Helgakviða Hundingsbana II", "The Second Lay of Helgi Hundingsbane"),
    ("REGINSMOL", "Reginsmál", "The Ballad of Regin"),
    ("FAFNISMOL", "Fáfnismál", "The Ballad of Fafnir"),
    ("SIGRDRIFUMOL", "Sigrdrífumál", "The Ballad of the Victory-Bringer"),
    ("BROT AF SIGURTHARKVITHU", "Brot af Sigurðarkviðu", "Fragment of a Sigurd Lay"),
    ("GUTHRUNARKVITHA I", "Guðrúnarkviða I", "The First Lay of Guthrun"),
    ("SIGURTHARKVITHA EN SKAMMA", "Sigurðarkviða in skamma", "The Short Lay of Sigurd"),
    ("GUTHRUNARKVITHA II, EN FORNA", "Guðrúnarkviða II", "The Second Lay of Guthrun"),
    ("GUTHRUNARKVITHA III", "Guðrúnarkviða III", "The Third Lay of Guthrun"),
    ("ODDRUNARGRATR", "Oddrúnargrátr", "The Lament of Oddrun"),
    ("ATLAKVITHA EN GRÖNLENZKA", "Atlakviða", "The Greenland Lay of Atli"),
    ("ATLAMOL EN GRÖNLENZKU", "Atlamál", "The Greenland Ballad of Atli"),
    ("HAMTHESMOL", "Hamðismál", "The Ballad of Hamther"),
)


def poetic_edda(texts: DataFrame) -> DataFrame:
    """Poems by their known headings; a numbered block up to a blank line is a stanza if its first line has the bar of a half-line."""
    known = F.create_map(*(x for heading, norse, english in POEMS for x in (F.lit(heading), F.struct(F.lit(norse).alias("norse"), F.lit(english).alias("english")))))
    start = r"^(\d+)\.\s+(?=\S)"
    df = D.headed(D.lines(texts), {"poem": F.try_element_at(known, F.trim("line")), "mark": _part(start).cast("int")})
    blank = F.max(F.when(F.trim("line") == "", F.col("n"))).over(_rows(["file"]))
    df = _rest(df.withColumn("blank", blank), "mark", start).filter(F.coalesce("blank", F.lit(-1)) < F.col("mark_at"))
    verse = F.trim(F.regexp_replace("line", r"\s+\|\s+", " "))
    first = F.max((F.col("line").contains("|") & (F.col("n") == F.col("mark_at"))).cast("int")).over(Window.partitionBy("file", "mark_at"))
    df = df.withColumn("barred", first).filter("barred = 1").withColumn("line", verse)
    items = D.joined(df, ["file", "poem", "poem_at", "mark", "mark_at"], separator="\n")
    place = F.concat_ws(" ", "poem.norse", "mark")
    return tree_of(items, [Level(F.col("poem.norse"), F.col("poem.norse"), _json(english_title=F.col("poem.english"))), Level(place, place)], F.col("text"), F.col("n"))


def gilgamesh(texts: DataFrame) -> DataFrame:
    """Tablets from the text of the pages (`pdf.read_pdf`): a heading may stand on two lines; page numbers go."""
    df = texts.select("file", F.posexplode(F.split("text", r"\n|\f")).alias("n", "line")).withColumn("line", T.collapse_spaces(F.col("line")))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    word = F.lower("line") == "tablet"
    df = df.withColumn("last", F.last(F.when(F.col("line") != "", F.col("line")), True).over(before))
    alone = F.when(F.lower("last") == "tablet", F.upper(F.regexp_extract(F.regexp_replace("line", r"^[\[\]()]+|[\[\]()]+$", ""), rf"(?i)^\s*({NUMERAL})\s*\.?\s*$", 1)))
    roman = F.coalesce(F.upper(_part(rf"(?i)^\s*Tablet\s+({NUMERAL})\s*\.?\s*$")), F.nullif(alone, F.lit("")))
    df = D.headed(df, {"tablet": T.roman_to_int(roman)})
    keys = ["tablet", "tablet_at"]
    items = _paragraphs(df.filter(~F.col("line").rlike(r"^\d+$")), keys, (F.col("line") == "") | word | F.coalesce(F.col("n") == F.col("tablet_at"), F.lit(False)))
    items = items.filter(~F.col("text").rlike(r"^\d+$")).select("n", *keys, "nth", "text").unionByName(_headings(df, "tablet").select("n", *keys, "nth", "text"))
    tablet = F.concat(F.lit("Tablet "), "tablet")
    return tree_of(items, [Level(tablet, tablet), Level(F.concat(tablet, F.lit(":p"), "nth"), F.concat(tablet, F.lit(" ¶"), "nth"))], F.col("text"), F.col("n"))


# ---- pages ----
def dao_de_jing(pages: DataFrame) -> DataFrame:
    """Chapters by headings in words; the text is the second cell after each; the first book has 37 chapters."""
    heading = r'font-size:14\.0pt">Chapter ([A-Za-z\-\s]+?)<'
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(heading), F.lit(1)).alias("name"), F.slice(F.split("text", heading), 2, 1_000_000).alias("block"))
    df = pages.select(F.posexplode(both).alias("n", "c")).select("n", T.ordinal_word_to_int(F.col("c.name")).alias("number"), F.col("c.block").alias("block")).filter("number is not null")
    cell = F.try_element_at(F.regexp_extract_all("block", F.lit(r"(?is)<td\s[^>]*>(.*?)(?:</td>|$)"), F.lit(1)), F.lit(2))
    df = df.withColumn("text", _text(F.regexp_replace(cell, "<[^>]+>", ""))).dropna(subset=["text"])
    book, place = F.when(F.col("number") <= 37, "Tao Ching").otherwise("Te Ching"), F.concat(F.lit("DDJ "), "number")
    return tree_of(df, [Level(book, book), Level(place, place)], F.col("text"), F.col("n"))


#: Labels of the volumes, and the files that hold sections: the number of a file is authoritative.
VOLUMES = {"I": "Volume I — Age of the Gods", "II": "Volume II — Age of the Early Emperors", "III": "Volume III — Age of the Later Emperors"}
FIRST_FILE, LAST_FILE = 8, 187
_SECTION = rf"(?i)SECT(?:ION)?\.?\s+{NUMERAL}"


def _note_link(tag: str, attrs: dict) -> bool:
    return tag == "a" and "#fn_" in attrs.get("href", "")


def heading_title(heading: Column) -> Column:
    """Without brackets and the section's number; in title case if it was in capitals."""
    bare = F.regexp_replace(F.trim(heading), r"^[\[\]]+|[\[\]]+$", "")
    bare = F.regexp_replace(F.trim(bare), rf"(?i)^SECT(?:ION)?\.?\s+{NUMERAL}\.?\s*[—–-]+\s*", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"[.\]]+$", ""))
    return F.when((bare == F.upper(bare)) & (bare != F.lower(bare)), F.initcap(bare)).otherwise(bare)


def kojiki(pages: DataFrame) -> DataFrame:
    """Sections from one page each (file, text); the volume from the page's title. From the section's heading to the
    footnotes, paragraphs of 20 characters or more without page numbers and links; the volumes are units in any case."""
    number = F.regexp_extract("file", r"^kj(\d+)\.htm$", 1)
    df = pages.filter(F.col("file").rlike(r"^kj\d+\.htm$")).withColumn("number", number.cast("int")).filter(F.col("number").between(FIRST_FILE, LAST_FILE))
    df = D.parse_html(df, "number", "text", _note_link)
    page = Window.partitionBy("number")
    is_heading = F.col("tag").isin("h2", "h3", "h4")
    volume = F.max(F.when(F.col("tag") == "title", F.upper(F.regexp_extract("text", r"(?i)Volume\s+(I{1,3}V?|IV|VI{0,3})", 1)))).over(page)
    df = df.withColumns({"volume": F.nullif(volume, F.lit("")), "section_at": F.min(F.when(is_heading & F.col("text").rlike(_SECTION), F.col("n"))).over(page)})
    df = df.withColumn("title", F.max(F.when(F.col("n") == F.col("section_at"), F.col("text"))).over(page)).filter("volume is not null and n > section_at")
    df = df.withColumn("notes", F.min(F.when(is_heading & F.lower("text").contains("footnote"), F.col("n"))).over(page)).filter("tag = 'p' and (notes is null or n < notes)")
    df = df.filter(~F.col("text").rlike(r"^(p\.\s*\d+\s*)+$|(?i)^(Next:|Sacred Texts\s*\|)"))
    clean = T.collapse_spaces(F.regexp_replace(F.regexp_replace("text", r"^\[paragraph continues\]\s*", ""), r"\[\d+\]", ""))
    df = df.withColumn("line", clean).filter(F.length("line") >= 20)
    items = D.joined(df, ["number", "volume", "title"]).select("number", "volume", "title", "text")
    names = F.create_map(*(F.lit(x) for kv in VOLUMES.items() for x in kv))
    all_volumes = pages.sparkSession.createDataFrame([(-len(VOLUMES) + k, v) for k, v in enumerate(VOLUMES)], "number int, volume string")
    items = items.unionByName(all_volumes, allowMissingColumns=True)
    label, order = F.try_element_at(names, F.col("volume")), F.col("number")
    place = F.when(F.col("text").isNotNull(), F.concat(F.lit("Kojiki "), F.col("number") - (FIRST_FILE - 1)))
    return tree_of(items, [Level(label, label, _json(volume=F.col("volume"))), Level(place, place, _json(title=heading_title(F.col("title")), volume=F.col("volume")))], F.col("text"), order)


def enuma_elish(pages: DataFrame, anchor: str = "The Text of Enuma Elish") -> DataFrame:
    """Tablets and numbered lines from the anchor's heading to the next one; nothing without it."""
    df = D.parse_html(pages, "file", "text")
    file = Window.partitionBy("file")
    df = df.withColumn("begins", F.min(F.when((F.col("tag") == "h3") & F.col("text").contains(anchor), F.col("n"))).over(file)).filter("n > begins")
    df = df.withColumn("ends", F.min(F.when(F.col("tag") == "h3", F.col("n"))).over(file)).filter("(ends is null or n < ends) and tag = 'p'")
    df = D.headed(df, {"tablet": T.roman_to_int(_part(rf"(?i)^Tablet\s+({NUMERAL})$", 1, "text"))}).filter("tablet_at is not null")
    lines = df.filter("n != tablet_at").select("tablet", "n", F.posexplode("lines").alias("k", "line")).withColumn("number", _part(r"^(\d+)\s+\S").cast("int")).filter("number is not null")
    lines = lines.select("tablet", "number", F.regexp_replace("line", r"^\d+\s+", "").alias("text"), (F.col("n") * 10_000 + F.col("k") + 1).alias("position"))
    heads = df.filter("n = tablet_at").select("tablet", F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("text"), (F.col("n") * 10_000).alias("position"))
    key = F.concat(F.lit("Tablet "), "tablet")
    place = F.when(F.col("number").isNotNull(), F.concat(key, F.lit(":"), "number"))
    return tree_of(lines.unionByName(heads), [Level(key, key), Level(place, F.concat_ws(".", "tablet", "number"))], F.col("text"), F.col("position"))


#: Chapters that are Gathas.
GATHAS = (*range(28, 35), *range(43, 52), 53)


def _note(tag: str, attrs: dict) -> bool:
    href = attrs.get("href", "")
    return tag == "sup" or tag == "a" and ("#fn" in href or "foot" in href.lower())


def yasna(pages: DataFrame) -> DataFrame:
    """Chapters by headings with an id of y and a number, but for y0; verses are paragraphs that begin with a number. Pages are Latin-1."""
    df = D.parse_html(pages, "file", "text", _note)
    head = F.when((F.col("tag") == "h2") & F.col("element_id").rlike(r"^y\d+$"), F.struct(F.regexp_extract("element_id", r"(\d+)", 1).cast("int").alias("number"), _part(r"^\d+\.\s+(.+)", 1, "text").alias("title")))
    df = D.headed(df, {"chapter": head}).filter("chapter.number > 0 and tag = 'p'").withColumn("verse", _part(r"^(\d+)\.\s+\S", 1, "text").cast("int")).filter("verse is not null")
    gatha = F.col("chapter.number").isin(*GATHAS)
    key = F.concat(F.lit("Yasna "), "chapter.number")
    place = F.concat_ws(":", key, "verse")
    return tree_of(df, [Level(key, key, _json(is_gatha=gatha, title=F.col("chapter.title"))), Level(place, place, _json(is_gatha=gatha))], F.regexp_replace("text", r"^\d+\.\s+", ""), F.col("n"))


# ---- EPUB ----
#: Pages that are no text.
FRONT_MATTER = "titlepage_main titlepage introduction acknowledgements acknowledgments copyright cover abbreviations quotation glossary bibliography foreword preface nav".split()
_SKIPPED = rf"(?i)^(?:{'|'.join(FRONT_MATTER)})\.x?html$|^app|(?<!\.html)$"
#: Sub-books of the minor collection in their order.
SUB_BOOKS = {"Khp": "Khuddakapatha", "Dhp": "Dhammapada", "Ud": "Udana", "Iti": "Itivuttaka", "StNp": "Sutta Nipata", "Thag": "Theragatha", "Thig": "Therigatha"}
NIKAYAS = {"DN": "Digha Nikaya", "MN": "Majjhima Nikaya", "SN": "Samyutta Nikaya", "AN": "Anguttara Nikaya"}


def _footnote(tag: str, attrs: dict) -> bool:
    return "fn" in attrs.get("class", "").lower().replace("-", " ").split()


def _sutta_pages(blocks: DataFrame) -> DataFrame:
    """item, index (from 1 in natural order), label, n, nth, text of each paragraph; an item without any is one row without text."""
    page = Window.partitionBy("file", "item")
    rank = F.when(F.col("tag").isin("h2", "h3") & F.array_contains("classes", "h1"), F.when(F.col("tag") == "h2", 0).otherwise(1)).when(F.col("tag").isin("h1", "h2", "h3"), F.substring("tag", 2, 1).cast("int") + 1)
    heading = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "n", "text"))).over(page)["text"]
    # The text is in one division if there is one, else in another, else anywhere.
    place = F.when(F.array_contains("within", "sutta"), 0).when(F.array_contains("within", "content"), 1).otherwise(2)
    df = blocks.withColumns({"heading": heading, "place": F.coalesce(place, F.lit(2))})
    df = df.withColumn("best", F.min("place").over(page))
    stem = F.regexp_extract("item", r"([^/]+)\.[^.]+$", 1)
    number = F.regexp_extract(stem, r"(\d+)", 1)
    label = F.coalesce("heading", F.when(number != "", F.concat(F.lit("Section "), number)), stem)
    good = (F.col("tag") == "p") & (F.col("place") == F.col("best")) & ~F.arrays_overlap("classes", F.array(*map(F.lit, ("notetitle", "seealso", "translations")))) & ~F.lower("text").isin("note", "notes", "see also:")
    df = df.withColumns({"label": label, "stem": stem, "good": F.coalesce(good, F.lit(False)), "natural": T.natural_key(F.col("item"))})
    texts = df.filter("good").withColumn("nth", F.row_number().over(page.orderBy("n"))).select("file", "item", "stem", "natural", "label", "n", "nth", "text")
    empty = df.groupBy("file", "item", "stem", "natural", "label").agg(F.max("good").alias("any")).filter("not any").drop("any")
    return texts.unionByName(empty, allowMissingColumns=True)


def nikaya(spark: SparkSession, path: str, code: str = "DN") -> DataFrame:
    """Collection, sutta, paragraph of one standard collection; suttas without text are not counted."""
    df = _sutta_pages(D.read_epub(spark, path, skip=_SKIPPED, folder=f"{code}/", drop=_footnote)).filter("text is not null")
    df = df.withColumn("index", F.dense_rank().over(Window.partitionBy("file").orderBy("natural", "item")))
    section = F.concat(F.lit(f"{code}:"), "stem")
    levels = [
        Level(F.lit(NIKAYAS[code]), F.lit(NIKAYAS[code])),
        Level(section, F.col("label"), _json(source_file=F.col("item"), section_index=F.col("index"))),
        Level(F.concat(section, F.lit(":p"), "nth"), F.concat("label", F.lit(" ¶"), "nth")),
    ]
    return tree_of(df, levels, F.col("text"), F.col("index").cast("long") * 1_000_000 + F.col("nth"))


def khuddaka(spark: SparkSession, path: str) -> DataFrame:
    """Sub-book, section, paragraph of the minor collection; a section's index counts pages without text too."""
    df = _sutta_pages(D.read_epub(spark, path, skip=_SKIPPED, folder="KN/", drop=_footnote)).withColumn("sub", F.split("item", "/")[1])
    order = F.array_position(F.array(*map(F.lit, SUB_BOOKS)), F.col("sub"))
    df = df.withColumn("book", order).filter("book > 0 and size(split(item, '/')) >= 3")
    df = df.withColumn("index", F.dense_rank().over(Window.partitionBy("file", "sub").orderBy("natural", "item")))
    chapter = F.when(F.col("sub") == "Dhp", F.nullif(F.regexp_extract("stem", r"(?i)ch\s*0*(\d+)", 1), F.lit("")).cast("int"))
    label = F.when(chapter.isNotNull(), F.concat(F.lit("Chapter "), chapter, F.lit(": "), "label")).otherwise(F.col("label"))
    sub, has = F.concat(F.lit("KN:"), "sub"), F.col("text").isNotNull()
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in SUB_BOOKS.items() for x in kv)), F.col("sub"))
    section = F.when(has, F.concat_ws(":", sub, "stem"))
    levels = [
        Level(sub, name, _json(subbook_code=F.col("sub"))),
        Level(section, label, _json(source_file=F.col("item"), section_index=F.col("index"), chapter_number=chapter)),
        Level(F.concat(section, F.lit(":p"), "nth"), F.concat(label, F.lit(" ¶"), "nth")),
    ]
    return tree_of(df, levels, F.col("text"), (F.col("book") * 10_000 + F.col("index")) * 1_000_000 + F.coalesce("nth", F.lit(0)))


def vendidad(spark: SparkSession, path: str) -> DataFrame:
    """Fargards, one a page; verses are paragraphs that begin with a number."""
    df = D.read_epub(spark, path, prefix="content", folder="text/", drop=lambda tag, attrs: tag == "sup").filter("tag is not null")
    page = Window.partitionBy("file", "item")
    head = F.min_by("text", "n").over(page)
    number = r"(?i)^FARGARD\s+(\d+)\.\s*"
    df = df.filter("tag != 'title'").withColumn("head", head).filter(F.col("head").rlike(number))
    rest = F.regexp_replace("head", number, "")
    title = F.nullif(F.regexp_replace(F.trim(F.split(rest, r"(?i)\s+(?:Introduction|Synopsis)\b")[0]), r"[.,]+$", ""), F.lit(""))
    df = df.withColumns({"fargard": F.regexp_extract("head", number, 1).cast("int"), "title": title, "verse": _part(r"^(\d+)\.\s+\S", 1, "text").cast("int")}).filter("tag = 'p' and verse is not null")
    key = F.concat(F.lit("Vendidad "), "fargard")
    place = F.concat_ws(":", key, "verse")
    return tree_of(df, [Level(key, key, _json(title=F.col("title"))), Level(place, place)], F.regexp_replace("text", r"^\d+\.\s+", ""), F.col("fargard").cast("long") * 100_000 + F.col("n"))


# ---- the list ----
@dataclass(frozen=True)
class Corpus:
    """What a version is called, its levels from the top, its places in the taxonomy, and its units from a path."""

    name: str
    translation: str
    translator: str
    origin: str
    levels: tuple[str, ...]
    taxonomy: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    language: str = "en"


def _of_texts(f: Callable[[DataFrame], DataFrame], encoding: str = "UTF-8") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: f(D.read_texts(spark, path, encoding))


def _list() -> list[Corpus]:
    rao, tb = "Valmiki Ramayana Project Translation", "Thanissaro Bhikkhu"
    leaves = f"{tb} Translation (Handful of Leaves)"
    out = []
    for testament, origin, where in (("Old Testament", "Hebrew / Aramaic", ("Judaism", "Christianity")), ("New Testament", "Greek (Koine)", ("Christianity",))):
        for edition, (full, by) in EDITIONS.items():
            out.append(Corpus(testament, full, by, origin, ("Book", "Chapter", "Verse"), where, lambda s, p, e=edition, t=testament: bible(s, p, e, t)))
    out += [
        Corpus("Quran", "Clear Quran", "Dr. Mustafa Khattab", "Arabic", ("Surah", "Ayah"), ("Islam",), quran),
        Corpus("Bhagavad Gita", "Swami Mukundananda Translation", "Swami Mukundananda", "Sanskrit", ("Chapter", "Verse"), ("Hinduism",), gita),
        Corpus("Srimad Bhagavatam", "Prabhupada Translation", "A.C. Bhaktivedanta Swami Prabhupada", "Sanskrit", ("Canto", "Chapter", "Text"), ("Hinduism",), bhagavatam),
        Corpus("Ramayana", rao, "ValmikiRamayan.net", "Sanskrit", ("Kanda", "Chapter", "Verse"), ("Hinduism",), ramayana),
        Corpus("Upanishads", "Swami Paramananda Translation", "Swami Paramananda", "Sanskrit", ("Upanishad", "Mantra"), ("Hinduism",), _of_texts(upanishads)),
        Corpus("Yoga Sutras of Patanjali", "Charles Johnston Translation", "Charles Johnston", "Sanskrit", ("Book", "Sutra"), ("Hinduism",), _of_texts(yoga_sutras)),
        Corpus("Mahabharata", "Kisari Mohan Ganguli Translation", "Kisari Mohan Ganguli", "Sanskrit", ("Book", "Parva", "Section", "Paragraph"), ("Hinduism",), _of_texts(mahabharata)),
        Corpus("Guru Granth Sahib Ji", "GurbaniDB English Translation", "Multiple (GurbaniDB)", "Punjabi (Gurmukhi)", ("Raag", "Section", "Shabad", "Stanza"), ("Sikhism",), sggs),
        Corpus("Dhammapada", "F. Max Müller Translation", "F. Max Müller", "Pali", ("Chapter", "Verse"), ("Buddhism",), _of_texts(dhammapada)),
        Corpus("Diamond Sutra", "William Gemmell Translation", "William Gemmell", "Sanskrit", ("Chapter",), ("Buddhism",), _of_texts(diamond_sutra)),
        Corpus("Jataka Tales", "T.W. Rhys Davids Translation (Volume 1)", "T.W. Rhys Davids", "Pali", ("Tale",), ("Buddhism",), _of_texts(jataka)),
    ]
    out += [Corpus(name, leaves, tb, "Pali", ("Nikaya", "Sutta", "Paragraph"), ("Buddhism",), lambda s, p, c=code: nikaya(s, p, c)) for code, name in NIKAYAS.items()]
    return out + [
        Corpus("Khuddaka Nikaya", leaves, tb, "Pali", ("Sub-book", "Section", "Paragraph"), ("Buddhism",), khuddaka),
        Corpus("Analects of Confucius", "James Legge Translation", "James Legge", "Classical Chinese", ("Book", "Chapter"), ("Confucianism",), _of_texts(analects)),
        Corpus("Dao De Jing", "Bruce Linnell Translation", "Bruce Linnell", "Classical Chinese", ("Book", "Zhang"), ("Taoism",), _of_texts(dao_de_jing)),
        Corpus("Chuang Tzu", "Herbert Allen Giles Translation", "Herbert Allen Giles", "Classical Chinese", ("Chapter",), ("Taoism",), _of_texts(chuang_tzu)),
        Corpus("Kojiki", "Basil Hall Chamberlain Translation", "Basil Hall Chamberlain", "Old Japanese", ("Volume", "Section"), ("Shinto",), _of_texts(kojiki)),
        Corpus("Yasna", "Lawrence Mills Translation", "Lawrence Mills", "Avestan", ("Chapter", "Verse"), ("Zoroastrianism",), _of_texts(yasna, "ISO-8859-1")),
        Corpus("Vendidad", "James Darmesteter Translation", "James Darmesteter", "Avestan", ("Fargard", "Verse"), ("Zoroastrianism",), vendidad),
        Corpus("Enuma Elish", "W.G. Lambert Translation", "W.G. Lambert", "Akkadian", ("Tablet", "Line"), ("Mesopotamian",), _of_texts(enuma_elish)),
        Corpus("Epic of Gilgamesh", "Maureen Gallery Kovacs Translation", "Maureen Gallery Kovacs", "Akkadian", ("Tablet", "Paragraph"), ("Mesopotamian",), _of_texts(gilgamesh)),
        Corpus("Poetic Edda", "Henry Adams Bellows Translation", "Henry Adams Bellows", "Old Norse", ("Poem", "Stanza"), ("Norse / Germanic",), _of_texts(poetic_edda)),
        Corpus("Prose Edda", "Rasmus B. Anderson Translation", "Rasmus B. Anderson", "Old Norse", ("Part", "Chapter", "Paragraph"), ("Norse / Germanic",), _of_texts(prose_edda)),
    ]


CORPORA = _list()


def corpus(name: str, translation: str | None = None) -> Corpus:
    """The entry of that name and translation; KeyError if there is none."""
    for c in CORPORA:
        if c.name == name and translation in (None, c.translation):
            return c
    raise KeyError(name)
