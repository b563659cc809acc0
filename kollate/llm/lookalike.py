"""Visually identical text with different characters (problem 8).

Texts are brought to one form. Words of a text that hold a sign which may be written otherwise are taken out; every different word
once, however often the corpus has it, is exploded to positioned code points. These are joined with broadcast mappings
(canonical and width decompositions, joined letters, kinds of blank and hyphen, invisible signs, look-alike letters), combining
marks are put in the order of their class and recomposed with their base, and the words are rebuilt; those that changed go
back to their places in the texts.

Look-alike letters are settled run by run: a run of letters that holds a letter only one alphabet has is written in that alphabet,
any other in Latin letters where it can be. A small Greek letter on its own that serves as a symbol stays.

Signs of other width, composition, joining or alphabet become equal; case, accents, digits, raised and lowered signs, fractions,
dashes, quotation marks and Greek letters among Greek letters stay apart. Null stays null, empty stays empty.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kollate.operators.skew import spread_join
from kollate.session import cut

#: Look-alike letters of each alphabet, each string beside its Latin twins; the first letter of a twin is its usual one.
TWINS = {
    "CYRILLIC": ("аеорсухіѕјһԁԛԝѵӏүқАВЕЅІЈКМНОРСТУХҮԌԚԜӀ", "aeopcyxisjhdqwvlykABESIJKMHOPCTYXYGQWI"),
    "GREEK": ("ονιρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovipucjABEZHIKMNOPTYXCJ"),
    "ARMENIAN": ("օոսհցքզյՕՍՏԼ", "onuhgpqjOUSL"),
    "CHEROKEE": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎵᎷᎻᎽᏀᏃᏎᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWPMHYGZ4RWSVSLCPKJGB"),
    "OTHER": ("ɑɡⲟⲥⲞⲤⲢⲔⲚⲦⲘⲎ", "agocOCPKNTMH"),
}
#: Small Greek letters with a twin that are symbols where they stand alone.
SYMBOLS = "νρυ"
#: Blocks of letters in other styles, which are written in the plain style of their kind.
STYLED = (0x1D400, 0x1D800)
#: Signs that show nothing.
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0x206A, 0x206F, 0x3164, 0xFE00, 0xFE0E, 0xFE0F, 0xFEFF, 0xFFA0)
#: Hyphens, all written as the one of ASCII.
HYPHENS = "‐‑﹣－⁃"
#: Kinds of compatibility decomposition that change only width or joining.
KEPT_KINDS = ("<wide>", "<narrow>", "<small>")
_JOINED = (0xFB00, 0xFB07), (0xFB13, 0xFB18), (0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x2160, 0x2180), (0x02A3, 0x02AC)


def _to(sign: str) -> str:
    """What a sign is written as: its canonical decomposition, after width, joining, blank and hyphen."""
    code = ord(sign)
    if code in INVISIBLE or 0xE0000 <= code <= 0xE007F or 0xFE01 <= code <= 0xFE0D:
        return ""
    if sign in HYPHENS:
        return "-"
    if unicodedata.category(sign) == "Zs":
        return " "
    kind = unicodedata.decomposition(sign).split(" ")[0]
    styled = STYLED[0] <= code < STYLED[1] and unicodedata.category(sign)[0] == "L"
    if kind in KEPT_KINDS or any(a <= code < b for a, b in _JOINED) or code == 0x00B5 or styled:
        plain = unicodedata.normalize("NFKD", sign)
        return plain if sign in plain else "".join(map(_to, plain))
    return unicodedata.normalize("NFD", sign)


def mapping_rows() -> list[tuple[str, str]]:
    """(sign, what it is written as) of every sign that changes."""
    rows = []
    for code in range(0x80, 0x110000):
        sign = chr(code)
        if unicodedata.category(sign) in ("Cn", "Cs", "Co", "Lo") and not unicodedata.decomposition(sign) and code not in INVISIBLE and not 0xAC00 <= code < 0xD7A4:
            continue
        out = _to(sign)
        if out != sign:
            rows.append((sign, out))
    return rows


def composition_rows() -> list[tuple[str, str]]:
    """(canonical decomposition, composed sign) for every sign that may be composed, Hangul syllables among them."""
    rows = []
    for code in range(0xA0, 0x30000):
        sign = chr(code)
        if not 0xAC00 <= code < 0xD7A4 and (not unicodedata.decomposition(sign) or unicodedata.decomposition(sign)[0] == "<"):
            continue
        apart = unicodedata.normalize("NFD", sign)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == sign:
            rows.append((apart, sign))
    return rows


def letter_rows() -> list[tuple[str, str, str]]:
    """(letter, alphabet, Latin twin or null) of the letters of the alphabets that have twins, and of Latin, whose twin is the letter itself."""
    twins = {a: (alphabet, b) for alphabet, (own, latin) in TWINS.items() for a, b in zip(own, latin)}
    rows = [(a, alphabet, b) for a, (alphabet, b) in twins.items()]
    for code in [*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530), *range(0x1F00, 0x2000), *range(0x531, 0x588), *range(0x13A0, 0x13FE), *range(0x2C80, 0x2CF0)]:
        sign = chr(code)
        if sign.isalpha() and sign not in twins:
            alphabet = unicodedata.name(sign, "OTHER").split(" ")[0]
            rows.append((sign, alphabet, sign if alphabet == "LATIN" else None))
    return rows


def turned_rows() -> list[tuple[str, str, str]]:
    """(Latin letter, alphabet, its twin there): of several the first."""
    found = {}
    for alphabet in ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE"):
        for own, latin in zip(*TWINS[alphabet]):
            found.setdefault((latin, alphabet), own)
    return [(latin, alphabet, own) for (latin, alphabet), own in found.items()]


def class_rows() -> list[tuple[str, int]]:
    """(mark, combining class) of every combining mark."""
    return [(chr(c), unicodedata.combining(chr(c))) for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c))]


def _small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a few thousand rows, whatever the corpus


#: Signs that are written as they are, whatever stands beside them: ASCII, Latin letters with accents, the usual punctuation, kana,
#: Han and Hangul syllables. A word of these alone is left as it is.
SAFE = ((0x00, 0x7F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAC), (0xAE, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x130), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x2013, 0x2014), (0x2018, 0x201D), (0x2020, 0x2022), (0x2026, 0x2026), (0x2032, 0x2033), (0x2190, 0x2194), (0x2200, 0x2203), (0x2212, 0x2212), (0x2248, 0x2248), (0x2264, 0x2265), (0x3001, 0x3002), (0x300C, 0x300F), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_SAFE_ODD = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SAFE[1:])
#: A sign that may be written otherwise; ASCII is told apart first.
_MAY_CHANGE = rf"[[^\x00-\x7f]&&[^{_SAFE_ODD}]]"
#: A stretch of safe words with their blanks, or one word without ASCII blanks. Possessive: linear in the text.
_PIECE = rf"(?:[!-~[{_SAFE_ODD}]]*+[\x00-\x20\x7f])++|[^\x00-\x20\x7f]++"
_ODD = r"[^\x00-\x7f]"
_JOINER, _ASIDE = "\u200d", "\ue000"
_PICTURES = r"([☀-➿\x{1F000}-\x{1FAFF}]\x{FE0F}?)\x{200D}(?=[☀-➿\x{1F000}-\x{1FAFF}])"
#: A base with its marks, or the jamo of a syllable.
_CLUSTER = r"(?s)[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|\P{M}\p{M}*+|\p{M}++"


def _joined(order, value: str) -> F.Column:
    """The values of a group put together in their order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.transform(listed, lambda x: x["v"]), "")


def word_forms(words: DataFrame) -> DataFrame:
    """(word, form) of every different word of ``words`` (word)."""
    spark = words.sparkSession
    key = words.select("word").distinct()
    points = key.select("word", F.posexplode(F.split("word", "")).alias("i", "sign"))
    mapped = points.join(_small(spark, mapping_rows(), "sign string, written string"), "sign", "left").withColumn("sign", F.coalesce("written", "sign"))
    rebuilt = mapped.groupBy("word").agg(_joined("i", "sign").alias("form"))
    # Marks: order by class, recompose with the base.
    clusters = rebuilt.select("word", F.posexplode(F.regexp_extract_all("form", F.lit(_CLUSTER), F.lit(0))).alias("i", "cluster"))
    signs = clusters.select("word", "i", F.posexplode(F.when(F.length("cluster") > 2, F.split("cluster", "")).otherwise(F.array("cluster"))).alias("j", "sign"))
    signs = signs.join(_small(spark, class_rows(), "sign string, class int"), "sign", "left")
    ordered = signs.groupBy("word", "i").agg(_joined(F.struct(F.coalesce("class", F.lit(-1)), "j"), "sign").alias("cluster"))
    composed = ordered.join(_small(spark, composition_rows(), "cluster string, composed string"), "cluster", "left").withColumn("cluster", F.coalesce("composed", "cluster"))
    letters = composed.withColumn("sign", F.substring("cluster", 1, 1)).join(_small(spark, letter_rows(), "sign string, alphabet string, twin string"), "sign", "left")
    # Runs of letters: a run begins wherever letters and other signs meet.
    order = Window.partitionBy("word").orderBy("i")
    kind = letters.withColumn("letter", F.col("cluster").rlike(r"^[\p{L}\p{M}]"))
    begins = (F.col("letter") != F.lag("letter", 1, False).over(order)).cast("int")
    placed = kind.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).drop("begins", "letter")
    # What a run shows: letters without a twin name their alphabet, and how many letters it has.
    alone = F.when(F.col("twin").isNull(), F.col("alphabet"))
    latin = F.when((F.col("alphabet") == "LATIN") & ~F.col("sign").isin(*sorted(set("".join(b for _, b in TWINS.values())))), True)
    shown = placed.groupBy("word", "run").agg(F.min(alone).alias("own"), F.bool_or(latin).alias("latin"), F.count("alphabet").alias("n"),
                                              F.array_sort(F.collect_list(F.struct("i", "cluster", "sign", "alphabet", "twin"))).alias("letters"))
    target = F.when(F.col("latin"), "LATIN").otherwise(F.coalesce("own", F.lit("LATIN")))
    back = shown.select("word", "n", "own", target.alias("target"), F.inline("letters"))
    back = back.join(_small(spark, turned_rows(), "twin string, target string, turned string"), ["twin", "target"], "left")
    symbol = (F.col("n") == 1) & F.col("sign").isin(*SYMBOLS)
    written = F.when(F.col("twin").isNull() | symbol | (F.col("alphabet") == F.col("target")), F.col("sign")).when(F.col("target") == "LATIN", F.col("twin")).otherwise(F.coalesce("turned", "sign"))
    settled = back.select("word", "i", F.concat(written, F.expr("substring(cluster, 2)")).alias("cluster"))
    # A letter that was turned may be composed with its marks now.
    settled = settled.join(_small(spark, composition_rows(), "cluster string, composed string"), "cluster", "left").withColumn("cluster", F.coalesce("composed", "cluster"))
    return settled.groupBy("word").agg(_joined("i", "cluster").alias("form"))


def canonical(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): the consistent form of every text; repeated keys and rows stay repeated. Other columns are ignored.

    Equal texts are taken apart once, by their MD5; a text or word that many rows have is dealt out.
    """
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    # A joiner that makes one picture of two is seen, and set aside until the end.
    plain = plain.withColumn("text", F.when(F.contains("text", F.lit(_JOINER)), F.regexp_replace("text", _PICTURES, "$1" + _ASIDE)).otherwise(F.col("text")))
    may = F.coalesce((F.length("text") < F.octet_length("text")) & F.col("text").rlike(_MAY_CHANGE), F.lit(False))
    same = plain.filter(~may).select("key", F.col("text").alias("form"))
    odd = cut(plain.filter(may).withColumn("h", F.unhex(F.md5("text"))), "odd")
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))
    words = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("at"), p.alias("word"))), lambda x: (F.length(x["word"]) < F.octet_length(x["word"])) & x["word"].rlike(_MAY_CHANGE))
    places = cut(odd.select("h", F.inline(words)).distinct(), "places")
    forms = cut(word_forms(places.select("word")).filter("word <> form"), "words")
    changes = spread_join(places, forms, ["word"]).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("at", "form"))).alias("changes"))
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.coalesce(F.try_element_at(F.col("changes"), i), p)), "")
    form = F.when(F.col("changes").isNotNull(), rebuilt).otherwise(F.col("text"))
    form = F.translate(form, _ASIDE, _JOINER)
    # Computed once: the planner would copy the expression into every use.
    done = spread_join(odd, changes, ["h"], "left").select("key", F.inline(F.array(F.struct(form.alias("form")))))
    return same.unionByName(done).withColumnRenamed("key", key)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_members, n_links) of the texts that read like another one: the smallest id of those that read the same,
    how many rows do, and how many of them are other strings. No pairs are made.

    Null, empty and blank texts and texts of invisible signs alone belong to no class. Forms are compared by their SHA-256 and length.
    """
    members = _members(docs, key, text)
    counted = members.groupBy("hash", "size", "raw").agg(F.count("*").alias("own"), F.min("id").alias("least"))
    whole = counted.groupBy("hash", "size").agg(F.sum("own").alias("n_members"), F.count("*").alias("ways"), F.min("least").alias("class_id")).filter("ways > 1")
    linked = counted.join(whole, ["hash", "size"]).select("hash", "size", "raw", "class_id", "n_members", (F.col("n_members") - F.col("own")).alias("n_links"))
    return spread_join(members, linked, ["hash", "size", "raw"]).select(F.col("id").alias(key), "class_id", "n_members", "n_links")


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, raw, hash, size) of every text that shows anything: of the string and of its form."""
    marked = docs.select(F.struct(docs[key].alias("id"), F.unhex(F.sha2(docs[text], 256)).alias("raw")).alias("key"), docs[text].alias("text"))
    forms = canonical(marked, "key", "text").filter(F.col("form").rlike(r"(?U)\S"))
    return cut(forms.select(F.col("key.id").alias("id"), F.col("key.raw").alias("raw"), F.unhex(F.sha2("form", 256)).alias("hash"), F.length("form").alias("size")), "forms")


def read_alike(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of texts that are equal in form but not as strings; see ``classes`` for the same without pairs.

    Only forms written in two ways at least are joined with themselves.
    """
    members = _members(docs, key, text)
    several = members.groupBy("hash", "size").agg(F.min("raw").alias("one"), F.max("raw").alias("other")).filter("one <> other")
    members = cut(spread_join(members, several.select("hash", "size"), ["hash", "size"]), "alike", members)
    other = members.withColumnsRenamed({"id": "id_b", "raw": "raw_b"})
    pairs = spread_join(members, other, ["hash", "size"]).filter((F.col("id") < F.col("id_b")) & (F.col("raw") != F.col("raw_b")))
    return pairs.select(F.col("id").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))
