import unicodedata

import pytest
from pyspark.sql import functions as F

from linkmill.functions import romanise, text

SPELLED = {
    "Хлебозавод Южный": "khlebozavod yuzhnyy", "ЧАЙ": "chay", "щётка": "shchyotka", "Київ": "kiyiv", "Ђорђе Љубић": "djordje ljubic",
    "Θάλασσα": "thalassa", "Ψυχή": "psuche", "ΟΔΟΣ": "odos", "Երևան": "erevan", "თბილისი": "tbilisi", "מגדל": "mgdl", "شمس": "shms", "خبز": "khbz",
    "नमक": "namak", "कृष्ण": "krishn", "मुंबई": "mumbai", "कंपनी लिमिटेड": "kampani limited", "ज़मीन": "jamin", "व": "va", "দোকান": "dokan", "ಅಂಗಡಿ": "angadi", "சென்னை": "chennai", "కృష్ణా": "krishna",
    "さくら": "sakura", "しゃしん": "shashin", "ちゃ": "cha", "きって": "kitte", "カフェ": "kafe", "コーヒー": "kohi", "ﾊﾟﾝ": "pan", "ﾃﾞﾝﾜ": "denwa", "ｼﾞｬｽﾞ": "jazu",
    "서울": "seoul", "부산": "busan", "茶": "u8336", "茶屋": "u8336 u5c4b", "ไทย": "ue44 ue17 ue22",
    "ＡＢＣ９": "abc9", "𝓑𝓪𝓴𝓮𝓻": "baker", "ﬂour ﬃx": "flour ffix", "Ⅷ": "viii", "Salt™": "salttm", "5½": "51 2", "m²": "m2", "Nº7": "no7", "٤٢": "42", "४२": "42",
    "кот ~ пёс!": "kot pyos", "foo_бар < x >": "foo bar x", "x^y да": "x y da",
    "e\u0301cole": "ecole", "и\u0306од": "yod", "İzmir": "izmir", "Žluťoučký": "zlutoucky", "Ĳssel": "ijssel", "": "",
}


def test_spellings(spark):
    df = spark.createDataFrame(list(SPELLED.items()), "c string, want string")
    got = {r.c: r.v for r in df.select("c", text.norm_name(F.col("c")).alias("v")).collect()}
    assert got == SPELLED


def test_long_texts(spark):
    """A very long text is spelled as its parts are."""
    df = spark.createDataFrame([(1, "plain words, Кафе\nмир \x0e ok " * 40000), (2, "хлеб" * 100000), (3, "x" * 2000000 + "я")], "i int, c string")
    got = {r.i: r.v for r in df.select("i", text.latin(F.col("c")).alias("v")).collect()}
    assert got == {1: "plain words, kafe\nmir   ok " * 40000, 2: "khleb" * 100000, 3: "x" * 2000000 + "ya"}


def test_every_letter_gets_ascii_and_every_table_is_whole(spark):
    """No character breaks a pattern or stays foreign; a spelling never holds the separator of cells."""
    assert all(len(c) == 1 and s and "," not in s for c, s in romanise.letters().items())
    rows = [(i, chr(i)) for i in (*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800), *range(0x20000, 0x20100))]
    read = spark.createDataFrame(rows, "i int, c string").repartition(8).select("i", text.latin(F.col("c")).alias("v"), F.col("c").rlike(r"\p{L}").alias("known")).collect()
    got = {r.i: r.v for r in read}
    assert all(v is not None and v.isascii() for v in got.values())
    # Of the letters that this Java's Unicode knows only these are silent: hard and soft signs, the small tsu by itself, lengthening, viramas.
    assert {chr(r.i) for r in read if r.known and not r.v.strip() and romanise.plain(chr(r.i)).strip()} == set("ЪЬъьꚜꚝっッｯーｰꣳꣴ")
    # Letters that Unicode takes apart into one Latin letter and marks are that letter.
    for i, v in ((r.i, r.v) for r in read if r.known):
        base = romanise.plain(chr(i)).lower()
        if len(base) == 1 and base.isascii() and base.isalpha():
            assert v == base, (hex(i), v, base)


def test_compatibility_form_over_the_basic_plane(spark):
    rows = [(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    rows += [(-1, "e\u0301\u0323 ﾊﾟ \u1100\u1161\u11a8"), (-2, "q\u0307\u0323"), (-3, ""), (-4, "plain")]
    got = spark.createDataFrame(rows, "i int, c string").repartition(8).select("c", text.nfkc(F.col("c")).alias("v")).collect()
    assert all(r.v == unicodedata.normalize("NFKC", r.c) for r in got) and len(got) == len(rows)
    assert spark.createDataFrame([(None,)], "c string").select(text.nfkc(F.col("c")).alias("v")).first().v is None


@pytest.mark.parametrize("raw, want", [("ＮＯＲＤ　７", ["NORD", "7"]), ("ｶﾌﾞ（株）", ["カブ", "株"]), ("  ", []), (None, None), ("a/b|c", ["a", "b", "c"])])
def test_raw_tokens_take_the_compatibility_form(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(text.raw_tokens(F.col("c")).alias("v")).first().v == want
    assert [r.t for r in df.select(F.explode(text.raw_tokens(F.col("c"))).alias("t")).collect()] == (want or [])
