"""Each corpus binding on a small file of its shape."""

import json
import sqlite3
import zipfile

import pytest

from silvan.sources import corpora, documents

START, END = "front\n*** START OF THE PROJECT ***\n", "\n*** END OF THE PROJECT ***\nlicence\n"


def shape(df, *more):
    rows = df.orderBy("position", "depth").collect()
    assert len({r["key"] for r in rows}) == len(rows)
    keys = {r["key"]: r["depth"] for r in rows}
    assert all((r["parent_key"] is None) == (r["depth"] == 0) and (r["depth"] == 0 or keys[r["parent_key"]] == r["depth"] - 1) for r in rows)
    return [(r["key"], r["label"], r["text"], *(json.loads(r[m]) if m == "metadata" and r[m] else r[m] for m in more)) for r in rows]


@pytest.fixture()
def text(spark, tmp_path):
    def make(content, encoding="utf-8", name="t.txt", read="UTF-8"):
        (tmp_path / name).write_bytes(content.encode(encoding))
        return documents.read_texts(spark, str(tmp_path / name), read)

    return make


def test_bible(spark, tmp_path):
    with sqlite3.connect(tmp_path / "b.db") as con:
        con.execute("create table KJV_books(id, name)")
        con.execute("create table KJV_verses(book_id, chapter, verse, text)")
        con.executemany("insert into KJV_books values (?, ?)", [(1, "Genesis"), (40, "Matthew")])
        con.executemany("insert into KJV_verses values (?, ?, ?, ?)", [(1, 2, 1, " Thus "), (1, 1, 2, "And"), (1, 1, 1, "In"), (1, 1, 3, "  "), (40, 1, 1, "The book")])
    old = shape(corpora.bible(spark, str(tmp_path / "b.db")), "uncleaned_text")
    assert old == [
        ("Genesis", "Genesis", None, None), ("Genesis 1", "Genesis 1", None, None), ("Genesis 1:1", "Genesis 1:1", "In", "In"), ("Genesis 1:2", "Genesis 1:2", "And", "And"),
        ("Genesis 2", "Genesis 2", None, None), ("Genesis 2:1", "Genesis 2:1", "Thus", " Thus "),
    ]
    assert [r[0] for r in shape(corpora.bible(spark, str(tmp_path / "b.db"), "kjv", "New Testament"))] == ["Matthew", "Matthew 1", "Matthew 1:1"]


def test_csv_corpora(spark, tmp_path):
    (tmp_path / "q.csv").write_text('surah_no,surah_name_en,surah_name_roman,ayah_no_surah,ayah_ar,ayah_en\n1,The Opening,Al-Fatiha,1,ar," In ""x"" "\n1,The Opening,Al-Fatiha,2,ar, \n', encoding="utf-8")
    assert shape(corpora.quran(spark, str(tmp_path / "q.csv")), "uncleaned_text") == [("Surah 1", "1. The Opening (Al-Fatiha)", None, None), ("Surah 1:1", "1:1", 'In "x"', "ar")]
    (tmp_path / "g.csv").write_text("chapter_number,chapter_title,chapter_verse,translation\nChapter 1,Grief,1.1,a\nChapter 1,Grief,1.4 – 1.6,b\nnone,x,1.1,c\n", encoding="utf-8")
    assert shape(corpora.gita(spark, str(tmp_path / "g.csv"))) == [("Chapter 1", "Chapter 1: Grief", None), ("1.1", "1.1", "a"), ("1.6", "1.4 – 1.6", "b")]
    (tmp_path / "s.csv").write_text("canto_number,canto_title,chapter_number,chapter_title,translation\nCanto 1,C,Chapter 1,T,a\nCanto 1,C,Chapter 1,T,\nCanto 1,C,Chapter 1,T,b\nCanto 1,C,Chapter 2,U,c\n")
    got = shape(corpora.bhagavatam(spark, str(tmp_path / "s.csv")))
    assert [r[:2] for r in got if r[2]] == [("Canto 1 Chapter 1 Text 1", "1.1.1"), ("Canto 1 Chapter 1 Text 2", "1.1.2"), ("Canto 1 Chapter 2 Text 1", "1.2.1")]
    assert ("Canto 1 Chapter 2", "1.2: U", None) in got and got[0] == ("Canto 1", "Canto 1: C", None)


def test_ramayana(spark, tmp_path):
    rows = [{"chapter": 1, "verse": 1, "translation": "a  b", "wordDictionary": "w"}, {"chapter": 1, "verse": 2}, {"chapter": 2, "verse": 1, "translation": "c"}]
    for name in ("AranyaKanda", "BalaKanda", "Other"):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = shape(corpora.ramayana(spark, str(tmp_path)), "metadata")
    assert [r[0] for r in got] == [f"{k}{x}" for k in ("BalaKanda", "AranyaKanda") for x in ("", ":ch1", ":ch1:v1", ":ch2", ":ch2:v1")]
    assert got[2] == ("BalaKanda:ch1:v1", "1.1", "a b", {"word_dictionary": "w"}) and got[1][1] == "BalaKanda Chapter 1"


def test_sggs(spark, tmp_path):
    rows = [
        (1, 1, "ਰਾਗੁ ॥", "Aasaa - Vaar", 1, 8, "Raag"), (2, 1, "ਸਲੋਕ ॥", "Aasaa - Vaar", 1, 8, "Shalok:"), (3, 1, "one", "Aasaa - Vaar", 1, 8, "first || 1 ||"), (4, 1, "two ॥੧॥", "Aasaa - Vaar", 1, 9, "second"),
        (5, 1, "ਪਉੜੀ ॥", "Aasaa - Vaar", 1, 9, None), (6, 1, "three", "Aasaa - Vaar", 1, 9, None), (7, 2, "four ॥੧॥", "Jap", 2, 0, "fourth"),
    ]
    with sqlite3.connect(tmp_path / "g.db") as con:
        con.execute("create table scriptures(id, hymn, text, section, author_id, page)")
        con.execute("create table translations(scripture_id, language_id, text)")
        con.execute("create table authors(id, author)")
        con.executemany("insert into scriptures values (?, ?, ?, ?, ?, ?)", [r[:6] for r in rows])
        con.executemany("insert into translations values (?, ?, ?)", [(r[0], 13, r[6]) for r in rows] + [(1, 9, "other")])
        con.executemany("insert into authors values (?, ?)", [(1, "Guru"), (2, "None")])
    got = {r[0]: r[1:] for r in shape(corpora.sggs(spark, str(tmp_path / "g.db")), "uncleaned_text", "author", "metadata")}
    assert got["Aasaa::Vaar"] == ("Vaar", None, None, None, {"raag": "Aasaa"}) and got["Jap::Main"][0] == "Main"
    assert got["Shabad 1"] == ("Shabad 1", None, None, "Guru", {"hymn": 1, "ang_start": 8, "ang_end": 9, "section": "Aasaa - Vaar"})
    assert got["Shabad 1:1"] == ("Shabad 1:1", "first\nsecond", "one\ntwo ॥੧॥", None, {"format": "Shalok"})
    assert got["Shabad 1:2"] == ("Shabad 1:2", None, "three", None, {"format": "Pauree"})
    assert got["Shabad 2"][3] is None and got["Shabad 2"][4] == {"hymn": 2, "section": "Jap"} and got["Shabad 2:1"][1] == "fourth"


def test_numbered_plain_texts(text):
    mantra = "All this whatsoever moves on earth"
    up = f"{START}      Isa-Upanishad\n\nI\n\n{mantra}\nII\nshort\n      Isa-Upanishad\nIII\n{mantra} too\n      Kena-Upanishad\nI\n{mantra}{END}"
    assert [r[0] for r in shape(corpora.upanishads(text(up)))] == ["Isa Upanishad", "Isa Upanishad 1", "Isa Upanishad 3", "Kena Upanishad", "Kena Upanishad 1"]
    yoga = f"{START}BOOK I\n1. OM: here follows\ninstruction.\n\nA comment.\n2. Union is.\n\nBOOK II\n1. The practices.\n\n{END}"
    assert [(r[1], r[2]) for r in shape(corpora.yoga_sutras(text(yoga))) if r[2]] == [("1.1", "OM: here follows instruction."), ("1.2", "Union is."), ("2.1", "The practices.")]
    dh = f"{START}Chapter I: The Twin-Verses\n1. All that\nwe are\n2. If\n\nChapter II. On Earnestness\n21. Path{END}"
    assert shape(corpora.dhammapada(text(dh))) == [("Chapter 1", "Chapter 1: The Twin-Verses", None), ("1.1", "1.1", "All that we are"), ("1.2", "1.2", "If"), ("Chapter 2", "Chapter 2: On Earnestness", None), ("2.21", "2.21", "Path")]
    dia = f"{START}[Chapter 1] Thus[2] have\nI heard\n[Chapter 3 and 4]\nUpon{END}"
    assert shape(corpora.diamond_sutra(text(dia))) == [("Chapter 1", "Chapter 1", "Thus have I heard"), ("Chapter 3 and 4", "Chapter 3 and 4", "Upon")]
    an = f"﻿{START}BOOK I. HSIO R.\nCHAPTER. I. 1. The Master. CHAP. II. The\nphilosopher\nBOOK II. WEI.\nCHAP. I. He{END}"
    got = shape(corpora.analects(text(an)), "metadata")
    assert got[0] == ("Book I", "Book I", None, {"title": "HSIO R"}) and [r[:3] for r in got if r[2]] == [("Book I.I", "1.1", "1. The Master."), ("Book I.II", "1.2", "The philosopher"), ("Book II.I", "2.1", "He")]


def test_tales_and_chapters(text):
    ja = f"{START}Holding Fast to Truth\n\nAPAṆṆAKA JĀTAKA.\n(Fausböll, No. 1.)\n\nThis was told\nby him.\n  * * *\nnotes\nThe Sandy Road\nVAṆṆUPATHA JĀTAKA.\nUntiring{END}"
    assert shape(corpora.jataka(text(ja)), "metadata") == [
        ("APAṆṆAKA JĀTAKA", "Holding Fast to Truth", "This was told by him.", {"pali_name": "APAṆṆAKA JĀTAKA", "fausboll_no": 1}), ("VAṆṆUPATHA JĀTAKA", "The Sandy Road", "Untiring", {"pali_name": "VAṆṆUPATHA JĀTAKA"}),
    ]
    ch = f"{START}CHAPTER II.\n\nTHE IDENTITY.\n\n_Argument_:--Contraries\nspring\n\nTzu Ch'i[1] sat\n    a note\nlooking _up_\n\n\n\nand\nCHAPTER I.\nBLISS.\nIn the north{END}"
    assert shape(corpora.chuang_tzu(text(ch))) == [("Chapter I", "I — BLISS", "In the north"), ("Chapter II", "II — THE IDENTITY", "Tzu Ch'i sat\nlooking up\n\nand")]


def test_mahabharata(text):
    raw = "BOOK 9\nignored\nTHE MAHABHARATA\nBOOK 1\n\nADI PARVA\nSECTION I\n\nOm! Having\nbowed\n\nsecond\nFOOTNOTES\nmore\nSECTION II\nBOOK 2\nno title\nSECTION I\nlast\n"
    got = shape(corpora.mahabharata(text(raw)))
    assert [(r[0], r[2]) for r in got] == [
        ("Book 1", None), ("Book 1:Adi Parva", None), ("Book 1:Adi Parva:Section I", None), ("Book 1:Adi Parva:Section I:p1", "Om! Having bowed"), ("Book 1:Adi Parva:Section I:p2", "second"), ("Book 1:Adi Parva:Section I:p3", "more"),
        ("Book 1:Adi Parva:Section II", None), ("Book 2", None), ("Book 2:Parva", None), ("Book 2:Parva:Section I", None), ("Book 2:Parva:Section I:p1", "last"),
    ]
    assert got[3][1] == "§1"


def test_eddas(text):
    pe = f"{START}VOLUSPO\n\n1. Hearing I ask | from the holy races,\nFrom Heimdall's sons, | both high\n\n2. a note without a bar\n| here\n\nHOVAMOL\n1. Within the gates | ere{END}"
    assert shape(corpora.poetic_edda(text(pe)), "metadata") == [
        ("Völuspá", "Völuspá", None, {"english_title": "The Wise-Woman's Prophecy"}), ("Völuspá 1", "Völuspá 1", "Hearing I ask from the holy races,\nFrom Heimdall's sons, both high", None),
        ("Hávamál", "Hávamál", None, {"english_title": "Sayings of the High One"}), ("Hávamál 1", "Hávamál 1", "Within the gates ere", None),
    ]
    pr = "THE FOOLING OF GYLFE.\nCHAPTER I.\ntoc\n" + "x\n" * 5 + "THE FOOLING OF GYLFE.\n\nCHAPTER I.\n\nGEFJUN’S PLOWING.\n\nKing Gylfe ruled\nthe lands.\n\nsecond\nCHAPTER II.\nGYLFE.\nthird\n\nBRAGE’S TALK.\nNOTES.\nno\n"
    got = shape(corpora.prose_edda(text(pr), toc_lines=3, least=5))
    assert [(r[0], r[2]) for r in got] == [
        ("The Fooling Of Gylfe", None), ("The Fooling Of Gylfe:Chapter I", None), ("The Fooling Of Gylfe:Chapter I:p1", "King Gylfe ruled the lands."), ("The Fooling Of Gylfe:Chapter I:p2", "second"),
        ("The Fooling Of Gylfe:Chapter II", None), ("The Fooling Of Gylfe:Chapter II:p1", "third"), ("Brage’s Talk", None),
    ]
    assert got[1][1].startswith("Chapter I: Gefjun")


def test_gilgamesh(text):
    raw = "intro\nTablet I\n\nHe who has seen\neverything\n\n12\n\nAnu granted\nTABLET\n[II]\n7\nthe harlot\n"
    assert [(r[0], r[1], r[2]) for r in shape(corpora.gilgamesh(text(raw)))] == [
        ("Tablet 1", "Tablet 1", None), ("Tablet 1:p1", "Tablet 1 ¶1", "He who has seen everything"), ("Tablet 1:p2", "Tablet 1 ¶2", "Anu granted"), ("Tablet 2", "Tablet 2", None), ("Tablet 2:p1", "Tablet 2 ¶1", "the harlot"),
    ]


def test_pages(text, tmp_path, spark):
    cell = lambda n, t: f'<p style="font-size:14.0pt">Chapter {n}</p><table><tr><td w=1>道</td><td w=2><b>{t}</b>\n x</td></tr></table>'
    assert shape(corpora.dao_de_jing(text(cell("One", "The Tao") + cell("Thirty Eight", "High") + cell("Nonsense", "no")))) == [
        ("Tao Ching", "Tao Ching", None), ("DDJ 1", "DDJ 1", "The Tao x"), ("Te Ching", "Te Ching", None), ("DDJ 38", "DDJ 38", "High x"),
    ]
    page = '<title>The Kojiki: Volume I: Section I.</title><h3>p. 15</h3><h3><a href="x">[SECT. I.—THE BEGINNING OF HEAVEN.]</a></h3><p>p. 15</p><p>The names of the Deities<a href="#fn_12">1</a> that were born[2] here</p><p>too short</p><p>[paragraph continues] And the names of the next ones</p><p>Next: Section II. of this long work</p><h3>Footnotes</h3><p>A footnote that is long enough to stay</p>'
    (tmp_path / "k").mkdir()
    for name in ("kj008.htm", "kj007.htm", "index.htm"):
        (tmp_path / "k" / name).write_text(page, encoding="utf-8")
    got = shape(corpora.kojiki(documents.read_texts(spark, str(tmp_path / "k"))), "metadata")
    assert [r[0] for r in got] == [*corpora.VOLUMES.values(), "Kojiki 1"]
    assert got[3][2:] == ("The names of the Deities that were born here And the names of the next ones", {"title": "The Beginning Of Heaven", "volume": "I"})
    en = "<h3>Intro</h3><p>Tablet I</p><h3>The Text of Enuma Elish</h3><p>0 before</p><p>Tablet I</p><p>1 When on high<br>2 had not\nno number</p><p>Tablet II</p><h3>End</h3><p>9 after</p>"
    assert shape(corpora.enuma_elish(text(en))) == [("Tablet 1", "Tablet 1", None), ("Tablet 1:1", "1.1", "When on high"), ("Tablet 1:2", "1.2", "had not"), ("Tablet 2", "Tablet 2", None)]
    assert corpora.enuma_elish(text("<p>Tablet I</p><p>1 x</p>")).count() == 0
    ya = '<h2 id="y0">Introduction.</h2><p>1. no</p><h2 id="y12">12. The Creed.</h2><p>1. I dri\xe9ve<sup>4</sup> off <a href="#fn3">x</a></p><p>none</p><h2 id="y28">28.</h2><p>2. And now</p>'
    got = shape(corpora.yasna(text(ya, "latin-1", read="ISO-8859-1")), "metadata")
    assert got == [
        ("Yasna 12", "Yasna 12", None, {"is_gatha": False, "title": "The Creed."}), ("Yasna 12:1", "Yasna 12:1", "I driéve off", {"is_gatha": False}),
        ("Yasna 28", "Yasna 28", None, {"is_gatha": True}), ("Yasna 28:2", "Yasna 28:2", "And now", {"is_gatha": True}),
    ]


def test_epubs(spark, tmp_path):
    sutta = lambda h, *ps: f'<h1>Site</h1><div id="sutta"><h2 class="h1">{h}</h2>' + "".join(ps) + "</div><p>outside</p>"
    with zipfile.ZipFile(tmp_path / "s.epub", "w") as z:
        z.writestr("DN/DN10.html", sutta("Ten", "<p>x</p>"))
        z.writestr("DN/DN2.html", sutta("Two", '<p>a<span class="fn">1</span> b</p>', '<p class="seealso">no</p>', "<p>Notes</p>", "<p>c</p>"))
        z.writestr("DN/DN1.html", "<p></p>")
        z.writestr("DN/cover.html", "<p>no</p>")
        z.writestr("DN/app1.html", "<p>no</p>")
        z.writestr("MN/MN1.html", sutta("M", "<p>m</p>"))
        for sub, name in (("Ud", "ud1"), ("Dhp", "Ch02"), ("Dhp", "Ch01"), ("Xyz", "x")):
            z.writestr(f"KN/{sub}/{name}.html", "<div></div>" if name == "Ch01" else sutta(f"H {name}", "<p>p</p>"))
    got = shape(corpora.nikaya(spark, str(tmp_path / "s.epub")), "metadata")
    assert [(r[0], r[1], r[2]) for r in got] == [("Digha Nikaya", "Digha Nikaya", None), ("DN:DN2", "Two", None), ("DN:DN2:p1", "Two ¶1", "a b"), ("DN:DN2:p2", "Two ¶2", "c"), ("DN:DN10", "Ten", None), ("DN:DN10:p1", "Ten ¶1", "x")]
    assert got[1][3] == {"source_file": "DN/DN2.html", "section_index": 1}
    got = shape(corpora.khuddaka(spark, str(tmp_path / "s.epub")), "metadata")
    assert [r[0] for r in got] == ["KN:Dhp", "KN:Dhp:Ch02", "KN:Dhp:Ch02:p1", "KN:Ud", "KN:Ud:ud1", "KN:Ud:ud1:p1"]
    assert got[1][1:] == ("Chapter 2: H Ch02", None, {"source_file": "KN/Dhp/Ch02.html", "section_index": 2, "chapter_number": 2}) and got[0][1] == "Dhammapada"
    with zipfile.ZipFile(tmp_path / "v.epub", "w") as z:
        z.writestr("text/content0005.html", "<h2>FARGARD 2. Yima (Jamshed). Introduction follows</h2><p>1. Zarathushtra<sup>1</sup> asked</p><p>no</p>")
        z.writestr("text/content0004.html", "<h2>FARGARD 1.</h2><p>3. Ahura</p>")
        z.writestr("text/content0001.html", "<p>1. not a fargard</p>")
    got = shape(corpora.vendidad(spark, str(tmp_path / "v.epub")), "metadata")
    assert [(r[0], r[2]) for r in got] == [("Vendidad 1", None), ("Vendidad 1:3", "Ahura"), ("Vendidad 2", None), ("Vendidad 2:1", "Zarathushtra asked")] and got[2][3] == {"title": "Yima (Jamshed)"}


def test_list():
    names = [(c.name, c.translation) for c in corpora.CORPORA]
    assert len(names) == len(set(names)) and corpora.corpus("Old Testament", "Bible in Basic English").translator == "S. H. Hooke"
    assert all(c.levels and c.taxonomy for c in corpora.CORPORA)
    with pytest.raises(KeyError):
        corpora.corpus("none")
