"""Quirks of excerpts, cells, paths and names."""

import csv
import io
from random import Random

import pytest
from pyspark.sql import functions as F

from sijill.functions.dating import Words, century, century_label, date_line, life_century, life_short
from sijill.functions.names import display_name, university_name, work_slug
from sijill.functions.text import csv_cell, excerpt, fold, has_text, in_language, known_language, list_cell, snippet, words


def values(spark, column, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_only_the_first_bold_part_goes(spark):
    assert values(spark, excerpt(F.col("a")), [("**H**\n\nbir **iki** üç",), ("x **H** y",), ("*a* **",), (None,)]) == [
        "bir **iki** üç", "x y", "*a* **", ""]


def test_browser_white_space(spark):
    odd = "a  ﻿b　 c\u0085d"
    # U+0085 is no white space to a browser.
    assert values(spark, excerpt(F.col("a")), [(odd,), ("﻿ x\n",)]) == ["a b c\u0085d", "x"]


def test_the_last_word_goes_even_when_complete(spark):
    text = "aaaa bbbb cccc"
    assert values(spark, excerpt(F.col("a"), 9), [(text,)]) == ["aaaa…"]
    assert values(spark, excerpt(F.col("a"), 10), [(text,)]) == ["aaaa bbbb…"]
    assert values(spark, excerpt(F.col("a"), 14), [(text,)]) == [text]
    assert values(spark, excerpt(F.col("a"), 5), [("abcdefgh",)]) == ["abcde…"]


def test_snippet_limits(spark):
    just, over = "x" * 260, "y" * 250 + " zzzzzzzzzzz"
    assert values(spark, snippet(F.col("a")), [(just,), (over,), (None,), ("a " + "b" * 300,)]) == [
        just, "y" * 250 + "…", "", "a…"]


def test_cells(spark):
    cells = values(spark, csv_cell(F.col("a")), [("a",), ("a;b",), ('a"b',), ("a,b",), ("a\nb",), ("a\rb",), (None,), ("",)])
    assert cells == ["a", '"a;b"', '"a""b"', '"a,b"', '"a\nb"', "a\rb", "", ""]
    assert values(spark, list_cell(F.col("a")), [(["x"],), (["x", "y"],), ([],)], "a array<string>") == ["x", '"x; y"', ""]


def test_cells_read_back_by_a_csv_reader(spark):
    random = Random(7)
    texts = ["".join(random.choice('ab;,"\n é\'') for _ in range(random.randint(0, 12))) for _ in range(400)]
    line = ",".join(values(spark, csv_cell(F.col("a")), [(t,) for t in texts]))
    assert next(csv.reader(io.StringIO(line, newline=""))) == texts


def test_flags(spark):
    assert values(spark, has_text(F.col("a")), [("x",), ("",), (None,)]) == [1, 0, 0]


@pytest.mark.parametrize("base,path,to,expected", [
    ("", "/en/posts/x/", "ar", "/ar/posts/x/"), ("", "/entries/", "tr", "/tr/entries/"), ("", "/en", "tr", "/tr/"),
    ("", "/", "en", "/en/"), ("/site/", "/site/tr/about/", "en", "/site/en/about/"), ("/site", "/site/", "ar", "/site/ar/"),
    ("/site", "/site", "ar", "/site/ar/")])
def test_same_page_in_another_language(spark, base, path, to, expected):
    assert values(spark, in_language(F.col("a"), to, base), [(path,)]) == [expected]


def test_languages(spark):
    assert values(spark, known_language(F.col("a")), [("ar",), ("fr",), (None,), ("",)]) == ["ar", "tr", "tr", "tr"]


def test_folding(spark):
    assert values(spark, fold(F.col("a")), [("İSLAM",), ("ISPARTA ılık",), ("Ünal",)]) == ["islam", "isparta ilik", "ünal"]
    assert values(spark, words(F.col("a")), [("Fıkıh-usulü, (2. cilt)  فقه!",), (None,)]) == [["fikih", "usulü", "2", "cilt", "فقه"], []]


def test_names(spark):
    assert values(spark, display_name(F.col("a")), [("Kaya, Ali",), ("Tek",), ("Bir, İki, Üç",)]) == ["Ali Kaya", "Tek", "İki, Üç Bir"]
    assert values(spark, university_name(F.col("a")), [("U, E",), ("Tek",)]) == ["U", "Tek"]


def test_slugs(spark):
    made = values(spark, work_slug(F.col("a"), F.col("t"), F.col("y")), [
        ("Şahin Çelik, Ayşe", "İslam ve Hukuk Üzerine", 2020), ("Az", "Bir İki Üç", None)], "a string, t string, y int")
    assert made == ["sahin-celik-islam-hukuk-2020", "az-nodate"]


def test_centuries(spark):
    assert values(spark, century(F.col("a")), [(1,), (100,), (101,), (972,)], "a int") == [1, 1, 2, 10]
    assert values(spark, life_century(F.col("d"), F.col("b")), [(534, 1), (None, 493), (None, None), (0, 493), (None, 0)],
                  "d int, b int") == [6, 6, None, None, None]


def test_century_labels(spark):
    numbers = [(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 111)]
    assert values(spark, century_label(F.col("a"), "en"), numbers, "a int") == [
        f"{x} c. AH" for x in ("1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111st")]
    assert values(spark, century_label(F.col("a"), "ar"), [(14,), (15,)], "a int") == ["القرن الرابع عشر", "القرن 15"]
    assert values(spark, century_label(F.col("a"), "tr", ". yy"), [(5,)], "a int") == ["5. yy"]


DATE = "d struct<hijri:int,month:int,day:int,approx:boolean,alt:array<int>,place:string>"


def test_date_lines(spark):
    words_en = Words("d.", "c.", "other reports")
    dates = [((833, 3, None, None, [863], None),), ((735, 7, 30, True, [], None),), ((None, 3, 1, None, [], None),), ((0, None, None, None, None, None),)]
    assert values(spark, life_short(F.col("d"), words_en), dates, DATE) == ["d. 833/1429", "d. c. 735/1335", "", ""]
    assert values(spark, date_line(F.col("d"), "en", words_en), dates, DATE) == [
        "Rabi I 833/1429 (other reports: 863/1458-59)", "c. 30 Rajab 735/1335", None, None]
