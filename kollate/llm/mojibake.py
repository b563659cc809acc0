"""Garbled text from wrong character encodings (problem 5).

The garbled sequences of all encoding pairs are precomputed and matched by a multi-pattern automaton;
only matched spans are replaced, so correct text beside them stays as it is.

Three kinds of pairs give patterns:

* UTF-8 read in a one-byte encoding. Each character of a fixed repertoire becomes a sequence of two or
  three signs that no language writes; the patterns need no data.
* One Latin one-byte encoding read as another. Each sign becomes one other sign, which may be right elsewhere.
  Its neighbours decide: over all texts the signs are counted together with the class of the sign before
  and after, and a pattern is kept where the repaired sign is far more usual in that place. The table
  is bounded by the encodings' upper signs and the neighbour classes, whatever the corpus.
* Another alphabet, or Japanese, read as Latin signs. Whole words of such signs are put back, and no others, where all of
  them are words of that alphabet by their build and by the pairs of letters that the corpus writes in it.

Control signs of the C1 range and replacement signs count as well; the latter can't be restored. One
replacement sign at the very end of a text is what a cut leaves and is no case. A question mark inside a word or before one
stands for lost signs, unless it opens the query of an address.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kollate.session import cut, release

#: Encodings in which UTF-8 was read.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "iso8859-15")
#: Fixed values: (true encoding, encoding it was read in) of the one-byte pairs of Latin letters.
ONE_BYTE = (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("iso8859-2", "cp1252"), ("cp1252", "iso8859-2"), ("cp1254", "cp1252"), ("cp1257", "cp1252"))
#: The same for whole words of another alphabet.
ALPHABETS = (("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("iso8859-5", "cp1252"), ("cp866", "cp1252"), ("cp1253", "cp1252"), ("iso8859-7", "cp1252"), ("cp1251", "mac_roman"))
#: Japanese encodings whose bytes were read as ``cp1252``.
JAPANESE = ("shift_jis", "euc_jp")
#: Vowels of those alphabets, and letters no word begins with.
VOWELS, NEVER_FIRST = set("аеёиоуыэюяіїєαεηιουωάέήίόύώϊϋΐΰ"), set("ьъыς")
#: Accented letters of which a Greek word has one.
STRESSED = set("άέήίόύώΐΰ")
#: The most common letters of those alphabets.
COMMON = set("оеаинтсрвлαοιετσνηυρκπ")
#: Letters by which words show an alphabet where the corpus says nothing, and with its counts; the share of their pairs of letters
#: that it must know, and without counts that of common letters.
LETTERS, LETTERS_COUNTED, KNOWN_PAIRS, COMMON_LETTERS = 6, 3, 0.8, 0.45
#: Code points whose UTF-8 is looked for; Han is given by rule with the rest.
REPERTOIRE = ((0x80, 0x180), (0x370, 0x400), (0x401, 0x402), (0x410, 0x450), (0x451, 0x452), (0x1E00, 0x1F00), (0x2010, 0x2040), (0x2070, 0x20A0), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2300), (0x3000, 0x3100), (0x4E00, 0xA000), (0xFB00, 0xFB05), (0xFEFF, 0xFF00), (0xFFFD, 0xFFFE))
LOST = "�"
#: A repaired sign must be so many times as usual in its place.
RATIO, LEAST = 8, 8
#: What may rightly follow a word, and what may rightly come before one.
_AFTER_WORD, _BEFORE_WORD = set("–—’”…"), set("–—")


def one_byte(encoding: str) -> dict[int, str]:
    """Signs of the upper half by byte; bytes without one are read as C1 controls, as browsers do."""
    return {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(0x80, 0x100)}


def utf8_patterns(encoding: str) -> dict[str, tuple[str, bool]]:
    """Garbled sequence -> (original, whether one hit alone proves nothing) of UTF-8 read in ``encoding``."""
    upper = one_byte(encoding)
    found: dict[str, tuple[str, bool]] = {}
    for lo, hi in REPERTOIRE:
        for sign in map(chr, range(lo, hi)):
            if unicodedata.category(sign) not in ("Cn", "Co", "Cs"):
                seen = "".join(upper[b] for b in sign.encode())
                found[seen] = (sign, len(seen) == 2 and (seen[0].isalpha() and seen[1] in _AFTER_WORD or seen[0] in _BEFORE_WORD and seen[1].isalpha()))
    return found


class Automaton:
    """Longest matches from the left, without overlaps."""

    def __init__(self, patterns: dict):
        self._find = ahocorasick.Automaton()
        for seen, value in patterns.items():
            self._find.add_word(seen, (len(seen), value))
        self._find.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, tuple]]:
        return [(end - n + 1, end + 1, value) for end, (n, value) in self._find.iter_long(text)]


_automata: dict[str, Automaton] = {}


def _utf8(encoding: str) -> Automaton:
    """The automaton of one encoding, or of all of them for "": built once per process."""
    if encoding not in _automata:
        names = [encoding] if encoding else READ_AS
        _automata[encoding] = Automaton({k: v for n in reversed(names) for k, v in utf8_patterns(n).items()})
    return _automata[encoding]


def _class(c: str) -> str:
    """The class of a neighbour: ASCII letters stand for themselves, digits and the rest for their kind."""
    if c in ("", "\0"):
        return ""
    if c == " " or c.isascii() and c.isalpha():
        return c
    if c.isdigit():
        return "0"
    return ("À" if c.isupper() else "à") if c.isalpha() else "." if c.isascii() else "–"


_classes: list[np.ndarray] = []


def _class_codes() -> np.ndarray:
    """The class of every code point of the first plane as a number; built once per process."""
    if not _classes:
        _classes.append(np.array([ord(_class(chr(i)) or "\0") for i in range(0x10000)], np.int64))
    return _classes[0]


def count_places(texts: list[str], wanted: np.ndarray) -> dict[tuple[str, str, str], int]:
    """How often the wanted signs stand in each place (class before, sign, class after), and how often two letters of a
    Greek or Cyrillic word follow each other, as ("", pair in lower case, "pair"). All texts are counted at once."""
    signs = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = np.zeros(0x110000, bool)
    known[wanted] = True
    at = np.flatnonzero(known[signs])
    kind = _class_codes()
    near = lambda i: kind[np.where(signs[i] < 0x10000, signs[i], 0x2013)]
    places, n = np.unique((near(at - 1) << 42) | (signs[at] << 21) | near(at + 1), return_counts=True)
    sign = lambda code: chr(code) if code else ""
    out = {(sign(k >> 42), chr((k >> 21) & 0x1FFFFF), sign(k & 0x1FFFFF)): int(c) for k, c in zip(places.tolist(), n.tolist())}
    other = (signs >= 0x370) & (signs < 0x530)
    at = np.flatnonzero(other[:-1] & other[1:])
    pairs, n = np.unique((signs[at] << 21) | signs[at + 1], return_counts=True)
    for k, c in zip(pairs.tolist(), n.tolist()):
        pair = ("", (chr(k >> 21) + chr(k & 0x1FFFFF)).lower(), "pair")
        out[pair] = out.get(pair, 0) + int(c)
    return out


def _turn(pair: str) -> dict[str, str]:
    """Sign as read -> sign as meant, for a pair's name."""
    true, read = (one_byte(e) for e in pair.split(">"))
    return {read[b]: true[b] for b in true if read[b] != true[b] and true[b].isprintable()}


def turns() -> list[tuple[str, str, str, int]]:
    """(sign as read, sign as meant, pair, order) of all one-byte pairs; of equally good ones the first holds."""
    return [(seen, meant, f"{true}>{read}", -k) for k, (true, read) in enumerate(ONE_BYTE) for seen, meant in _turn(f"{true}>{read}").items()]


_c1 = regex.compile(r"[\x80-\x9f]")
_entity = regex.compile(r"&#(1[2-9]\d|2[0-4]\d|25[0-5]);")
#: A question mark inside a word or before one, or several in a row: where signs were lost to ASCII.
_asked = regex.compile(r"[^\W_]\?+[^\W_]|(?:^|[\s(])\?+[^\W_]|(?:^|\s)\?+\s|[^\W_]\?{2,}(?=[^\s?])")
_question = regex.compile(r"(?i)(how|what|why|who|whose|which|when|where|is|are|do|does|can|should)\b")
#: The query of an address has its question mark by right.
_address = regex.compile(r"\S*(?:://|\.[a-z]{2,5})\S*\?\S*=\S*", regex.I)


def _rough(word: str) -> bool:
    """Whether a word has other signs than letters within, or a capital after a small letter."""
    bare = word.strip(".,:;?!()[]‘’“”-–—")
    return not bare.replace("-", "").isalpha() or any(a.islower() and b.isupper() for a, b in zip(bare, bare[1:]))


class _Reading:
    """Words of another alphabet as they look when read in a Latin encoding."""

    def __init__(self, true: str, read: str):
        upper, seen = one_byte(true), one_byte(read)
        letters = {seen[b]: upper[b] for b in upper if upper[b].isalpha() and "LATIN" not in unicodedata.name(upper[b], "LATIN")}
        self.name, self.turn = f"{true}>{read}", str.maketrans(letters)
        signs = regex.escape("".join(letters), special_only=False)
        self.words = regex.compile(rf"(?<![^\W_])[{signs}]+(?![^\W_])")


_readings: list[_Reading] = []
_any_reading: list = []


def _word_like(word: str) -> bool:
    """Whether a word of another alphabet is built like one: vowels, no long run of either kind, capitals where they may stand."""
    low = word.lower()
    vowel = [c in VOWELS for c in low]
    runs = "".join("v" if v else "c" for v in vowel)
    return any(vowel) and low[0] not in NEVER_FIRST and "ccccc" not in runs and "vvvv" not in runs and sum(c in STRESSED for c in low) <= 1 and (word == low or word[1:] == low[1:] or word.isupper())


def _common_share(words: list[str]) -> float:
    """The share of common letters, accents aside."""
    letters = [unicodedata.normalize("NFD", c)[0] for c in "".join(words).lower()]
    return sum(c in COMMON for c in letters) / len(letters)


def _whole_words(text: str, pairs: dict[str, int]) -> tuple[int, str, str]:
    """Words of another alphabet read as Latin letters, put back: (signs covered, text, name of the pair).

    Every word of three letters or more in such signs must be built like a word of the alphabet and be made of pairs of letters that
    the corpus writes; shorter ones are put back between those. Words with any other letter stay as they are. Of several
    readings the one with most known pairs wins.
    """
    if not _readings:
        _readings.extend(_Reading(*pair) for pair in ALPHABETS)
        _any_reading.append(regex.compile("[" + regex.escape("".join(sorted({chr(c) for r in _readings for c in r.turn})), special_only=False) + "]{3}"))
    if not _any_reading[0].search(text):
        return 0, text, ""
    best, most = (0, text, ""), -1.0
    for reading in _readings:
        found = [(m.start(), m.end(), m[0].translate(reading.turn)) for m in reading.words.finditer(text)]
        long_ = [w for a, b, w in found if b - a >= 3]
        if not long_ or not all(map(_word_like, long_)):
            continue
        script = unicodedata.name(long_[0][0]).split(" ")[0]
        two = [w.lower()[i : i + 2] for w in long_ for i in range(len(w) - 1)]
        counted = any(unicodedata.name(p[0], "").startswith(script) for p in pairs)
        known = sum(p in pairs for p in two) / len(two) if counted else _common_share(long_)
        if sum(map(len, long_)) < (LETTERS_COUNTED if counted else LETTERS) or known < (KNOWN_PAIRS if counted else COMMON_LETTERS) or known <= most:
            continue
        sure = {a for a, b, _ in found if b - a >= 3}
        out, at, covered = [], 0, 0
        for i, (a, b, word) in enumerate(found):
            # A short word counts where the words of the same kind beside it do, with nothing else between.
            beside = [found[j] for j in (i - 1, i + 1) if 0 <= j < len(found)]
            near = [x for x in beside if x[0] in sure and not regex.search(r"[\p{L}\p{N}]", text[min(b, x[1]) : max(a, x[0])])]
            if a in sure or len(near) == 2 or near and (not text[b:].strip() or not text[:a].strip()):
                out += [text[at:a], word]
                at, covered = b, covered + b - a
        best, most = (covered, "".join(out) + text[at:], reading.name), known
    return best


#: The first bytes of kana, as they look.
_lead_bytes = set("‚ƒ¤¥")
_japanese_run = regex.compile(r"\S*[^\x00-\x7f]\S*")


def _japanese(text: str) -> tuple[int, str, str]:
    """Japanese read byte by byte: runs of signs that turn into Japanese letters with kana among them, and no others."""
    best = (0, text, "")
    if _lead_bytes.isdisjoint(text):
        return best
    for true in JAPANESE:
        covered, out, at = 0, [], 0
        for m in _japanese_run.finditer(text):
            raw = bytearray()
            try:
                for c in m[0]:
                    raw += bytes([ord(c)]) if ord(c) < 0x100 else c.encode("cp1252")
                right = raw.decode(true)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            odd = [c for c in right if c > "\x7f"]
            kana = sum("\u3041" <= c <= "\u30fe" for c in odd)
            if kana and len(odd) >= 2 and all("\u3000" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in odd):
                out += [text[at : m.start()], right]
                at, covered = m.end(), covered + len(m[0])
        if covered > best[0]:
            best = (covered, "".join(out) + text[at:], f"{true}>cp1252")
    return best


def _proof(spans: list, text: str) -> bool:
    """Whether the hits show a wrong reading: a sure one, or different ones, not all of them cut off at the end."""
    if any(not weak or text[b - 1] == "…" and text[b : b + 1].isalpha() for _, b, (_, weak) in spans):
        return True
    return len({text[a:b] for a, b, _ in spans}) > 1 and any(b < len(text) for _, b, _ in spans)


def _unread(text: str) -> tuple[int, str, str]:
    """UTF-8 put back, by the encoding whose sequences cover most of the text."""
    best = (0, text, "")
    if not _utf8("").spans(text):
        return best
    for name in READ_AS:
        spans = _utf8(name).spans(text)
        covered = sum(b - a for a, b, _ in spans)
        if covered > best[0] and _proof(spans, text):
            out, at = [], 0
            for a, b, (sign, _) in spans:
                out += [text[at:a], sign]
                at = b
            best = (covered, "".join(out) + text[at:], f"utf-8>{name}")
    return best


class Places(dict):
    """Patterns by place -> (sign as meant, name of the pair); their signs, and the pairs of letters of other alphabets that the corpus has."""

    def __init__(self, patterns: dict, pairs: dict[str, int] | None = None):
        super().__init__(patterns)
        self.pairs = pairs or {}
        signs = regex.escape("".join(sorted({sign for _, sign, _ in patterns})), special_only=False)
        self.find = regex.compile(f"[{signs}]") if patterns else None

    def hits(self, text: str) -> list[tuple[int, str, str]]:
        """(position, sign as meant, pair) of every place that has a pattern."""
        if not self.find:
            return []
        found = []
        for m in self.find.finditer(text):
            i = m.start()
            hit = self.get((_class(text[i - 1]) if i else "", m[0], _class(text[i + 1 : i + 2])))
            if hit:
                found.append((i, *hit))
        return found


_NO_PLACES = Places({})


def _in_places(text: str, hits: list[tuple[int, str, str]]) -> tuple[str, str]:
    """The text with its matched places put right, by the pair with most of them: (text, pair). A word with a match is read by the
    pair as a whole where only that makes it a clean word; words without one stay."""
    names = [name for _, _, name in hits]
    pair = max(sorted(set(names)), key=names.count)
    right = {i: sign for i, sign, name in hits if name == pair}
    turn = str.maketrans(_turn(pair))
    out, at = [], 0
    for m in regex.finditer(r"\S+", text):
        if not any(i in right for i in range(m.start(), m.end())):
            continue
        word = "".join(right.get(m.start() + k, c) for k, c in enumerate(m[0]))
        whole = m[0].translate(turn)
        out += [text[at : m.start()], whole if _rough(word) and not _rough(whole) else word]
        at = m.end()
    return "".join(out) + text[at:], pair


def repair(text: str, patterns: Places | None = None) -> tuple[bool, str, list[str]]:
    """(garbled, text with the matched spans restored, pairs involved, with "lost" where signs are gone)."""
    if not isinstance(patterns, Places):
        patterns = Places(patterns) if patterns else _NO_PLACES
    kinds: list[str] = []
    signs = _entity.sub(lambda m: chr(int(m[1])), text) if "&#" in text else text
    if signs != text and _unread(signs)[0]:
        text = signs
    for _ in range(3):  # text garbled twice is repaired twice
        best = max(_unread(text), _whole_words(text, patterns.pairs), _japanese(text))
        if not best[0]:
            break
        text = best[1]
        kinds.append(best[2])
    if _c1.search(text):
        kinds.append("cp1252>latin-1")
        text = _c1.sub(lambda m: bytes([ord(m[0])]).decode("cp1252", "replace"), text)
    if not kinds and (hits := patterns.hits(text)):
        text, pair = _in_places(text, hits)
        kinds.append(pair)
    # A question has its mark; a blank left out after it is no lost sign.
    question = text.count("?") == 1 and bool(_question.match(text))
    lost = LOST in text.rstrip(" .…")[:-1] or bool("?" in text and not question and _asked.search(_address.sub("", text)))
    return bool(kinds) or lost, text, sorted(set(kinds)) + ["lost"] * lost


def suspect(text) -> Column:
    """Texts that need a look: other signs than ASCII, entities, or question marks inside words or before them.

    The dear tests run only where a cheap one holds.
    """
    asked = F.contains(text, F.lit("?")) & text.rlike(r"[A-Za-z0-9]\?+[A-Za-z0-9]|(^|[\s(])\?")
    return (F.length(text) < F.octet_length(text)) | F.contains(text, F.lit("&#")) | asked


def _patterns(texts: DataFrame):
    """The one-byte patterns that hold for these texts, on every worker; ``texts``: text.

    Places are added up in each batch before the shuffle; only winning places and the pairs of letters, at most a few
    thousand of either, come to the driver.
    """
    wanted = np.array(sorted({ord(c) for pair in ONE_BYTE for e in pair for c in one_byte(e).values()}))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for place, n in count_places(batch["text"].tolist(), wanted).items():
                total[place] = total.get(place, 0) + n
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["b", "s", "a", "n"])

    spark = texts.sparkSession
    counts = cut(texts.mapInPandas(count, "b string, s string, a string, n long").groupBy("b", "s", "a").agg(F.sum("n").alias("n")), "places")
    single = counts.filter("length(s) = 1")
    turn = F.broadcast(spark.createDataFrame(turns(), "s string, meant string, pair string, first int"))  # a fixed table of under 2,000 rows
    usual = single.select("b", F.col("s").alias("meant"), "a", F.col("n").alias("usual")).filter(F.col("usual") >= LEAST)
    met = single.join(turn, "s").join(usual, ["b", "meant", "a"]).filter(F.col("usual") >= RATIO * F.col("n"))
    won = met.groupBy("b", "s", "a").agg(F.max_by(F.struct("meant", "pair"), F.struct("usual", "first")).alias("w")).select("b", "s", "a", "w.*")
    places = {(r.b, r.s, r.a): (r.meant, r.pair) for r in won.collect()}
    pairs = {r.s: r.n for r in counts.filter("length(s) = 2").filter(F.col("n") >= LEAST).collect()}
    release(counts)
    return spark.sparkContext.broadcast(Places(places, pairs))


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, restored, kinds) of each row whose text is garbled.

    ``restored`` is null where signs were lost for good. Null, empty and plain ASCII texts are never garbled;
    repeated rows come out as often as they go in; other columns are ignored.
    """
    plain = df.select(df[key].alias("key"), df[text].alias("text")).filter(suspect(F.col("text")))
    patterns = _patterns(plain.select("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [repair(t, patterns.value) for t in batch["text"]]
            batch["restored"] = [None if "lost" in kinds else out for _, out, kinds in done]
            batch["kinds"] = [kinds for _, _, kinds in done]
            yield batch[[found for found, _, _ in done]]

    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInPandas(run, f"key {kind}, text string, restored string, kinds array<string>").withColumnRenamed("key", key).withColumnRenamed("text", text)


def mend(df: DataFrame, text: str) -> DataFrame:
    """All rows and columns, the text restored where it was garbled and can be; no row is shuffled for it."""
    odd = suspect(F.col(text))
    patterns = _patterns(df.filter(odd).select(F.col(text).alias("text")))

    def one(t: str) -> str | None:
        found, out, kinds = repair(t, patterns.value)
        return out if found and "lost" not in kinds else None

    @F.pandas_udf(T.StringType())
    def mended(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return df.withColumn(text, F.coalesce(mended(F.when(odd, F.col(text))), F.col(text)))


def garbled(texts: DataFrame):
    """A function of a text column that tells whether each text is garbled, by the patterns of ``texts`` (text)."""
    patterns = _patterns(texts.filter(suspect(F.col("text"))))

    @F.pandas_udf(T.BooleanType())
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t is not None and repair(t, patterns.value)[0]).astype(bool)

    return lambda text: found(F.when(suspect(text), text))
