from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import cut_text
from lexivane.functions import chunking as C
from lexivane.functions import text as T

# Words with their syllables.
SYLLABLES = """casa ca-sa
porta por-ta
chave cha-ve
palha pa-lha
ninho ni-nho
rainha rai-nha
quente quen-te
aquilo a-qui-lo
guerra guer-ra
linguiça lin-gui-ça
água á-gua
aguentar a-guen-tar
muito mui-to
herói he-rói
poeta po-e-ta
aeroporto a-e-ro-por-to
saúde sa-ú-de
egoísta e-go-ís-ta
prato pra-to
abstrato abs-tra-to
transporte trans-por-te
perspectiva pers-pec-ti-va
história his-tó-ria
português por-tu-guês
oásis o-á-sis
coração co-ra-çã-o
psicologia psi-co-lo-gia
atleta a-tle-ta
père père"""


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_syllables(spark):
    rows = [line.split(" ") for line in SYLLABLES.splitlines()]
    df = spark.createDataFrame(rows, "word string, expected string")
    wrong = df.where(F.array_join(T.syllabify(F.col("word")), "-") != F.col("expected")).collect()
    assert wrong == []


def test_syllables_join_back_to_words(spark):
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    assert words.where(F.array_join(T.syllabify(F.col("w")), "") != F.col("w")).count() == 0


def test_words_split_at_foreign_letters(spark):
    assert one(spark, T.words, "Größe, Ñandú 3x") == ["gr", "e", "andú", "x"]


def test_normalize_and_soundex(spark):
    assert one(spark, T.normalize, "ÇÃÉñ") == "caen"
    assert one(spark, T.soundex, "Aslan") == one(spark, T.soundex, "Aslam") == "A245"
    assert one(spark, T.soundex, "123") == ""


def test_needles(spark):
    assert one(spark, T.alnum_needles, "see OE-6016, RFC1918 and oe-6016 or plain 7") == ["oe-6016", "rfc1918"]


def test_names(spark):
    assert one(spark, T.derive_base_name, "./a/b/file.py") == "a__b__file_py"
    assert one(spark, T.safe_name, "..  ") == "base"
    assert one(spark, T.file_extension, "x/.txt") is None
    assert one(spark, T.file_extension, "x/A.TXT") == ".txt"
    assert one(spark, lambda c: T.hit_path(c, F.lit("f.py")), "a__b__f_py") == "a/b/f.py"
    assert one(spark, T.driver_language, "tokens_Python_PTBR.drv") == "Python"
    assert one(spark, T.driver_language, "tokens_PTBR.drv") == "PTBR"


def test_small_parsers(spark):
    assert one(spark, T.parse_str_array, 'text ```["a ", "", "b"]``` end') == ["a", "b"]
    assert one(spark, T.parse_str_array, "nothing") == []
    assert one(spark, T.mask_key, "abcdefghijklmnop") == "abcdef…mnop"
    assert one(spark, T.mask_key, "short") == "•••••"
    assert one(spark, T.percent_decode, "a%20b+c") == "a b c"
    assert one(spark, T.normalize_query, "  A \t b ") == "a b"
    assert one(spark, T.word_key, "a|pa|re|ceu") == "a\u0001pa"


def test_cleaning(spark):
    assert one(spark, T.clean_corpus, "B ilbo ﬁm fami-\nlias A b") == "Bilbo fim familias A b"


def test_histogram(spark):
    row = one(spark, lambda c: T.histogram(T.syllable_seq(c)), "casa casado a aa")
    assert {r["token"]: r["tf"] for r in row} == {"a": 3, "ca": 2, "do": 1, "sa": 2}
    assert one(spark, lambda c: T.histogram(T.syllable_seq(c)), "123") == []


def test_histogram_survives_long_runs(spark):
    row = one(spark, lambda c: T.histogram(T.syllable_seq(c)), "la " * 200_000)
    assert [(r["token"], r["tf"]) for r in row] == [("la", 200_000)]


def test_chunks_match_plain_python(spark):
    pieces = st.text(alphabet="ab \n\té", min_size=0, max_size=60)

    @settings(max_examples=15, deadline=None)
    @given(st.lists(pieces, min_size=1, max_size=20))
    def check(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
        got = C.with_chunks(df, ["doc"], 7).where("piece is not null").collect()
        got = sorted((r["doc"], r["piece"], r["start"], r["text"]) for r in got)
        want = [(d, i, at, piece) for d, t in enumerate(texts) for i, (at, piece) in enumerate(cut_text(t, 7))]
        assert got == sorted(want)

    check()


def test_offsets_of_many_pieces(spark):
    text = "word " * 2000
    df = spark.createDataFrame([(0, text)], "doc int, text string")
    got = C.with_chunks(df, ["doc"], 8).where("piece is not null").orderBy("piece").collect()
    assert [(r["start"], r["text"]) for r in got] == list(cut_text(text, 8))


def test_blank_text_keeps_its_bytes(spark):
    df = spark.createDataFrame([(0, " \n ")], "doc int, text string")
    row = C.with_chunks(df, ["doc"], 8).first()
    assert row["piece"] is None and row["doc_bytes"] == 3
