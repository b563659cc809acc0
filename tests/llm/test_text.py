"""Garbled text, encoding, look-alikes and truncation."""

import os
import random

import pytest

from kollate.llm import encode, lookalike, mojibake, truncation

PATH = encode.vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@needs_vocabulary
def test_encoding_equals_the_merges():
    tiktoken = pytest.importorskip("tiktoken")
    data = open(PATH, "rb").read()
    ranks = {t: i for i, t in enumerate(encode.read_ranks(data))}
    other = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = encode.encoder(data)
    rng = random.Random(4)
    texts = ["", " ", "hello world", "a" * 3000, " " * 500 + "x", "日本語のテキスト", "🙂👩‍🔬", "<|endoftext|>", "\n\n\t x"] + ["".join(rng.choice("abcde THE in'g 12é́日\n") for _ in range(rng.randrange(80))) for _ in range(800)]
    for text in texts:
        assert bpe.encode(text) == other.encode_ordinary(text), text


@needs_vocabulary
def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (2, None, "y"), (3, "", "z"), (1, "hello", "x")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, encode.encode(df).collect()), key=str)
    assert [g for g in got if g[0] != 1] == [(2, []), (3, [])] and len(got) == 4 and got[0][1] == got[1][1] != []
    assert encode.encode(df.limit(0)).count() == 0
    assert {r.n_tokens for r in encode.token_counts(df).collect()} == {0, len(got[0][1])}


@pytest.mark.parametrize("true", ["Größe und café – “now”", "Почва и вода", "における言語"])
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
def test_utf8_read_wrongly_comes_back(true, read):
    upper = mojibake.one_byte(read)
    garbled = "".join(chr(b) if b < 0x80 else upper[b] for b in true.encode())
    found, text, kinds = mojibake.repair("Before " + garbled + " after", {})
    assert found and text == "Before " + true + " after" and "lost" not in kinds


def test_twice_garbled_and_partly():
    once = "é".encode().decode("cp1252")
    assert mojibake.repair("caf" + once.encode().decode("cp1252") + " naïve", {})[:2] == (True, "café naïve")
    assert mojibake.repair("Ïî÷âà è âîäà (Basin)", {})[:2] == (True, "Почва и вода (Basin)")
    assert mojibake.repair("MOD&#195;&#136;LE", {})[1] == "MODÈLE"


@pytest.mark.parametrize("text", ["", "plain", "Größe café – “now”", "GESTÃO DA ÁGUA – EDUCAÇÃO", "Почва и вода", "What now? and then", "Really?", "cut off at the en�", "α-helix and χ² → ∞", "L’économie “lente”"])
def test_right_text_is_no_case(text):
    assert mojibake.repair(text, {})[0] is False


@pytest.mark.parametrize("garbled,right", [("Ïî÷âà è âîäà by Müller and José", "Почва и вода by Müller and José"), ("Çàäà÷à FÊTE", "Задача FÊTE"), ("“ú–{Œê‚Ì–{ (Tokyo)", "日本語の本 (Tokyo)"), ("Ã…rhalm moorings", "Århalm moorings")])
def test_only_matched_words_are_put_back(garbled, right):
    assert mojibake.repair(garbled, {})[:2] == (True, right)


@pytest.mark.parametrize("text", ["ÉÈÀ COLLÈGE", "ÜÖÄ ÀÈÌ", "see example.org/file.php?id=3 there", "AMANHÃ – TARDE", "ÑÁÉÍ"])
def test_accents_are_no_other_alphabet(text):
    assert mojibake.repair(text, {}) == (False, text, [])


def test_places_decide_for_polish(spark):
    good = [("Łódź i żółw " + x,) for x in "abcdefghijkl"]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(good + [("£ódŸ i ¿ó³w",)])], "row_id long, title string")
    got = {r.row_id: r.restored for r in mojibake.restore(df, "row_id", "title").collect()}
    assert got == {12: "Łódź i żółw"}


@pytest.mark.parametrize("text", ["sa�de agr�cola", "1909?1942", "Educa???o tropical", "ï¿½ lost"])
def test_lost_signs_are_cases(text):
    found, _, kinds = mojibake.repair(text, {})
    assert found and "lost" in kinds


def test_one_byte_pairs_need_neighbours(spark):
    good = [("educación histórica",)] * 40
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(good + [("educaciÛn histÛrica",), (None,), ("",), ("x" * 20000 + "é",)])], "row_id long, title string")
    got = {r.row_id: r.restored for r in mojibake.restore(df, "row_id", "title").collect()}
    assert got == {40: "educación histórica"}
    assert mojibake.restore(df.limit(0), "row_id", "title").count() == 0


ALIKE = [("été", "été"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("Mοnԁor", "Mondor"), ("οικoνομια", "οικονομια"), ("культyра", "культура"), ("ﬁsh", "fish"), ("co­op", "coop"), ("a​b", "ab"), ("ｶﾞ", "ガ"), ("Å", "Å"), ("non‑break", "non-break"), ("ạ̇", "ạ̇"), ("x y", "x y"), ("☃︎", "☃"), ("한국어", "한국어"), ("ӏoan", "loan"), ("ρerson", "person"), ("υsage", "usage"), ("ϲode", "code"), ("ѕսn", "sun"), ("𝐛𝐨𝐥𝐝", "bold"), ("ᎪᏟ", "AC"), ("ο texto", "o texto")]
APART = [("α-diversity", "a-diversity"), ("x²", "x2"), ("½", "1/2"), ("–", "-"), ("’", "'"), ("é", "e"), ("A", "a"), ("٣", "3"), ("H₂O", "H2O"), ("👩‍🔬", "👩🔬"), ("a b", "a  b"), ("ρ-value", "p-value"), ("ν", "v"), ("한", "하"), ("ı", "i")]


def test_look_alikes(spark):
    rows = [(i, t) for i, t in enumerate(t for pair in ALIKE + APART for t in pair)]
    form = {r.doc_id: r.form for r in lookalike.canonical(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (a, b) in enumerate(ALIKE + APART):
        assert (form[2 * k] == form[2 * k + 1]) is (k < len(ALIKE)), (a, b, form[2 * k], form[2 * k + 1])


def test_pairs_that_read_alike(spark):
    rows = [(1, "the Kasvelbur text", 9), (2, "the Kаsvelbur text", 9), (3, "the Kasvelbur text", 9), (4, None, 9), (5, "", 9), (6, "​", 9), (7, " ", 9), (8, " ", 9), (9, "another", 9), (10, "word " * 20000 + "é", 9), (11, "word " * 20000 + "é", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    assert sorted(map(tuple, lookalike.read_alike(df).collect())) == [(1, 2), (2, 3), (10, 11)]
    assert lookalike.read_alike(df.limit(0)).count() == 0


def test_safe_signs_are_left_as_they_are():
    written, composed = dict(lookalike.mapping_rows()), dict(lookalike.composition_rows())
    twins = set("".join(own for own, _ in lookalike.TWINS.values()))
    for low, high in lookalike.SAFE:
        for sign in map(chr, range(low, high + 1)):
            to = written.get(sign, sign)
            assert (to == sign or composed.get(to) == sign) and sign not in twins, hex(ord(sign))


def test_classes_of_texts_that_read_alike(spark):
    rows = [(1, "the Kasvelbur text"), (2, "the Kаsvelbur text"), (3, "the Kasvelbur text"), (4, None), (5, "alone"), (6, " "), (2, "the Kаsvelbur text"), (7, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lookalike.classes(df).collect())) == [(1, 1, 4, 2), (2, 1, 4, 2), (2, 1, 4, 2), (3, 1, 4, 2)]
    assert sorted(r.form for r in lookalike.canonical(df).collect() if r.doc_id == 2) == ["the Kasvelbur text"] * 2


def corpus():
    titles = [f"A study of {a} {b} in the {p} District: a case for shared stewardship" for a in ("rural", "urban", "coastal") for b in ("water quality", "soil salinity", "bridge fatigue") for p in ("Nimvar", "Kosho", "Velmon", "Tornga")]
    return titles * 3 + [t.split(":")[0] for t in titles]


def test_truncation(spark):
    cases = ["A study of rural water quality in the Kosho District: a case for", "A study of rural water quality in the", "A study of urban soil sal", "A study of coastal bridge fatigue in the Nimvar Dis", "A study of rural water quality in …", "A study of rural water quality in the Kosho District: &am"]
    whole = ["A study of rural water quality in the Velmon District", "Stud. Rur. Wat. Qual.", "Preface", None, "", "   ", "...", "A study of rural water quality in the Tornga District: a case for shared stewardship"]
    rows = [(i, "s", t, i) for i, t in enumerate(corpus() + cases + whole)]
    n = len(corpus())
    df = spark.createDataFrame(rows, "row_id long, src string, title string, field int")
    got = sorted(r.row_id - n for r in truncation.truncated(df, "row_id", "src", ["title"]).collect())
    assert got == list(range(len(cases)))
    shares = truncation.shares(df, "row_id", "src", ["title"]).head()
    assert shares.n_cut == len(cases)
    assert truncation.truncated(df.limit(0), "row_id", "src", ["title"]).count() == 0


def test_single_words_and_long_words_are_judged(spark):
    long_ = "https://repository.example.org/records/of/a/kind/" + "abc" * 30
    values = ["Elsevier"] * 400 + ["Springer"] * 300 + [f"{long_}{k}" for k in range(40)] + [long_] * 1
    cases = ["Elsev", "Sprin"]
    whole = ["Elsevier", "Wiley", "Sage", "x" * 100_000]
    rows = [(i, "s", v) for i, v in enumerate(values + cases + whole)]
    df = spark.createDataFrame(rows, "row_id long, src string, publisher string")
    n = len(values)
    got = sorted(r.row_id - n for r in truncation.truncated(df, "row_id", "src", ["publisher"]).collect())
    assert got == [-1, 0, 1]


def test_a_limit_shows_by_different_values(spark):
    popular = [(i, "s", "Popular Press") for i in range(500)]
    df = spark.createDataFrame(popular + [(1000 + i, "s", f"title {i} {'x' * (20 + i % 60)}") for i in range(300)], "key long, source string, value string").selectExpr("key", "source", "'f' AS field", "value")
    assert truncation.limits(df).count() == 0
