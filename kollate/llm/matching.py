"""Matching entities across sources without keys (problem 3).

Candidates come from MinHash blocks over character shingles of several attributes: the whole title, its main part (for
catalogue titles without the subtitle) and, for a work's title that may have been cut, the longest of several openings that
it fills; a shared ISBN is a block as well. A band agrees with a probability of similarity to the power of its rows. Equal
titles are one record in the blocks, however many rows share them. Title pairs turn into pairs of works whose years don't
forbid it: the years are part of the join.

Each candidate pair gets similarity features; a logistic classifier turns them into probabilities, calibrated by isotonic
regression on pairs kept back from the fit. The weak labels come from evidence that is no feature: of the pairs in which both
sides carry an ISBN, those that share one are taken for the same work and the others for other works. The fit is a maximum a
posteriori one around ``PRIOR``, so that few labels, or none, give the same steps with less to learn from. It uses at most
``SAMPLE`` pairs of either label, chosen by hash; everything else covers all rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kollate.llm import mojibake
from kollate.operators.skew import spread_join
from kollate import session

#: Signs of a shingle.
SHINGLE = 3
#: (bands, rows of a band) of the whole title, of its main part and of each opening. An opening only has to be found again.
WHOLE, MAIN, OPENING = (14, 8), (8, 8), (2, 10)
#: Letters and digits of the openings by whose bands a cut title meets the whole one; shorter titles meet by the whole alone.
OPENINGS = (12, 16, 24, 32, 48, 64, 96)
#: Bits of a block key, the upper ones.
KEY_BITS = 40
#: Keys of a title, about; keys that are sorted and packed at once, and those of a part, that are joined at once; pairs given on at once.
KEYS, PACKED, PART, GIVEN = 25, 1_000_000, 300_000, 500_000
#: Pairs of either weak label used; a third of them only to calibrate.
SAMPLE = 10_000
#: Works of one title issued further apart are different works.
YEARS_APART, BUCKET = 3, 8
THRESHOLD = 0.5
#: Share of titles that must have a word for it to count as one.
KNOWN_SHARE = 3e-4
#: Letters of a word that can't be another's slip.
WORD = 4
#: Signs of what a cut took, by which the works it may have been are told apart.
REST = 60
#: Signs of the openings by which titles of one work are held against each other.
STEMS = (6, 12, 32)
#: Edits by which titles of one work may differ, as a share of their length, and at least.
EDITS, EDITS_LEAST = 0.08, 3


def cut(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``session.cut``, and the shuffle files behind the table go as soon as it is written; else they stay until the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return session.cut(df, name, *done)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _folding() -> tuple[str, str]:
    """Accented letters and their bases, by rule, for a translation inside the JVM."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x600) if unicodedata.category(chr(c)) == "Ll" and len(unicodedata.normalize("NFKD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD = _folding()
#: What cataloguers add after a title.
_RESPONSIBILITY = r"\s*/\s.*$"
_MEDIUM = r"(?i)\s*(\[[^\]]*\]|\((microform|electronic resource|online|computer file|text|microfiche|sound recording|large print)\))"
#: Openings and endings that make another work of a title.
OTHER_WORK = r"^(review of|book review|reviews? on|(teachers?|students?|instructors?)'?s? (companion|guide|manual|handbook)( to)?|companion to|study guide( to)?|index to|supplement to|abstracts? of|notes on|summary of|commentary on)\b|\b(volume|vol|part|band|tome|tomo|book|pt|series|teil|том|τόμος)\.? ?([0-9]+|[ivx]+)\W*$"
#: One of these begins every title that the first half of ``OTHER_WORK`` finds, and one of the others is in every one that the second half does.
STARTS = ("review", "book review", "teacher", "student", "instructor", "companion to", "study guide", "index to", "supplement to", "abstract", "notes on", "summary of", "commentary on")
PARTS = ("vol", "part", "band", "tom", "book", "pt", "series", "teil", "том", "τόμος")


def _where(text: Column, signs: str | tuple[str, ...], pattern: str, to: str = "") -> Column:
    """Replaces a pattern where one of the signs occurs; elsewhere the text isn't searched."""
    return F.when(_has(text, signs), F.regexp_replace(text, pattern, to)).otherwise(text)


def _has(text: Column, signs: str | tuple[str, ...]) -> Column:
    """Whether one of the signs occurs."""
    has = F.contains(text, F.lit(signs[0]))
    for sign in signs[1:]:
        has = has | F.contains(text, F.lit(sign))
    return has


def plain_title(column: Column, catalogue: bool) -> Column:
    """Lower-case title without accents, and without a cataloguer's additions."""
    text = _where(_where(column, "/", _RESPONSIBILITY), "[(", _MEDIUM) if catalogue else column
    text = F.when(F.right(text, F.lit(4)).rlike(r"\.\.|…|�"), F.regexp_replace(text, r"\s*(\.\.+|…|�)\s*$", "")).otherwise(text)
    low = F.lower(text)
    low = F.when(_has(low, "\t\n\x0b\x0c\r"), F.translate(low, "\t\n\x0b\x0c\r", "     ")).otherwise(low)
    low = F.when(F.length(low) < F.octet_length(low), F.translate(low, *FOLD)).otherwise(low)
    return F.trim(_where(low, ("  ",), r"  +", " "))


def squeezed(column: Column) -> Column:
    """Letters and digits alone, single blanks between."""
    return F.trim(F.regexp_replace(column, r"[^\p{L}\p{N}]+", " "))


#: What stands between a title and its subtitle, and what does so for certain.
SURE_BREAKS, OTHER_BREAKS = (": ", "; ", " - ", " – ", " — "), ("? ", ". ")


def main_part(column: Column, breaks: tuple[str, ...]) -> Column:
    """What stands before the first break."""
    for sign in breaks[1:]:
        column = F.replace(column, F.lit(sign), F.lit(breaks[0]))
    return F.substring_index(column, breaks[0], 1)


def isbn_core(column: Column) -> Column:
    """The nine digits that an ISBN-10 and its ISBN-13 share; null if it is neither."""
    digits = F.regexp_replace(F.regexp_replace(F.upper(column), r"\(.*?\)", ""), r"[^0-9X]", "")
    return F.when(F.length(digits) == 13, F.substring(digits, 4, 9)).when(F.length(digits) == 10, F.substring(digits, 1, 9))


KEY_MASK = np.uint64((1 << 64) - (1 << (64 - KEY_BITS)))


def band_keys(texts: list[str], bands: int, rows: int, seed: int) -> np.ndarray:
    """Band keys, one row per text: of each band, ``rows`` smallest hashes, each under a permutation of its own.

    All texts of a batch are hashed at once; the smallest of each text are found by segments.
    """
    padded = [t.replace(" ", "").ljust(SHINGLE, "\x01") for t in texts]
    signs = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    base = np.zeros(len(signs) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        base = base * np.uint64(0x9E3779B97F4A7C15) + signs[k : k + len(base)]
    inside = np.ones(len(signs), bool)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        inside[ends - k] = False  # no shingle begins in the last signs of a text
    base = base[inside[: len(base)]]
    base = ((base ^ (base >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    rng = np.random.default_rng(seed)
    keys, hashed = np.empty((len(texts), bands), np.int64), np.empty_like(base)
    for band in range(bands):
        key = np.full(len(texts), band, np.uint64)
        for _ in range(rows):
            mult, add = rng.integers(0, 2**32, 2, dtype=np.uint32)
            np.multiply(base, mult | np.uint32(1), out=hashed)
            np.add(hashed, add, out=hashed)
            key = (key ^ np.minimum.reduceat(hashed, starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, band] = (key & KEY_MASK).astype(np.int64)
    return keys


def _sign(batches: Iterator[pd.DataFrame], side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, titles) of titles signed in batches: the whole of each, the part that may stand alone, and openings.

    Of works the part is the main one of a title with a subtitle, of the catalogue a title without one, so that titles
    which only share their main part don't meet. A work's title may be cut, so it is signed by the longest opening
    it fills, and one of the catalogue by all it exceeds. The marks of another work are part of the keys, since titles that
    differ in them are never paired.
    """

    for batch in batches:
        t, whole = batch["t"].to_numpy(), batch["whole"].tolist()
        odd = np.array([zlib.crc32(x.encode()) << 32 if x else 0 for x in batch["odd"]], np.uint64).astype(np.int64)
        main, head = [a[:n] for a, n in zip(whole, batch["main"])], [a[:n] for a, n in zip(whole, batch["head"])]
        parted = np.array([len(a) > len(b) + 3 for a, b in zip(whole, main)])
        alone = parted if side == "works" else ~parted
        tight = [a.replace(" ", "") for a in whole]
        fills = np.searchsorted(OPENINGS, [len(a) for a in tight], side="right")
        signed = [(np.ones(len(t), bool), whole, 1, WHOLE), (alone, main if side == "works" else whole, 2, MAIN)]
        if side == "works":  # what stands before a sure break, where an earlier break may be none
            signed.append((np.array([len(b) + 3 < len(h) < len(a) - 3 for a, b, h in zip(whole, main, head)]), head, 2, MAIN))
        for i, n in enumerate(OPENINGS):
            signed.append((fills == i + 1 if side == "works" else fills > i, [a[:n] for a in tight], 3 + i, OPENING))
        for mask, texts, kind, (bands, rows) in signed:
            if mask.any():
                keys = band_keys([x for x, m in zip(texts, mask) if m], bands, rows, kind)
                yield (keys ^ odd[mask][:, None]).ravel(), np.repeat(t[mask], bands)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, of which as many are kept as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


PACKED_ROW = "part int, side int, n int, key long, t long, keys binary, titles binary"


def pack(keys: np.ndarray, titles: np.ndarray, side: int, parts: int) -> pd.DataFrame:
    """Rows of many keys and titles each. A part is a range of keys; its keys are sorted, and the steps between them are kept."""
    keys = keys.view(np.uint64) >> np.uint64(64 - KEY_BITS)
    order = np.argsort(keys)
    keys, titles = keys[order], titles[order]
    edges = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.uint64) << np.uint64(KEY_BITS)) // np.uint64(parts))
    rows = []
    for part in np.flatnonzero(np.diff(edges)):
        k, t = keys[edges[part] : edges[part + 1]], titles[edges[part] : edges[part + 1]]
        rows.append((part, side, len(k), int(k[0]), int(t.min()), _planes(np.diff(k, prepend=k[:1])), _planes(t - t.min())))
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PACKED_ROW.split(", ")])


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    """Keys in rising order, and titles, of a packed row."""
    return np.cumsum(_numbers(row.keys, row.n)) + np.uint64(row.key), _numbers(row.titles, row.n).astype(np.int64) + row.t


def _packed(side: str, parts: int):
    """Signs titles and packs what came of many batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for signed in _sign(batches, side):
            held.append(signed)
            if sum(len(k) for k, _ in held) >= PACKED:
                yield pack(*map(np.concatenate, zip(*held)), int(side == "works"), parts)
                held = []
        if held:
            yield pack(*map(np.concatenate, zip(*held)), int(side == "works"), parts)

    return run


def _met(left: list, right: list, given: int) -> Iterator[pd.DataFrame]:
    """(l, r) of the keys that packed rows of the two sides share, ``given`` at once, or as many as one title meets."""
    if not left or not right:
        return
    (lk, lt), (rk, rt) = (map(np.concatenate, zip(*map(unpack, rows))) for rows in (left, right))
    order = np.argsort(rk)
    rt = rt[order]
    known, starts, counts = np.unique(rk[order], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(known, lk), len(known) - 1)
    hit = known[at] == lk
    l, starts, counts = lt[hit], starts[at[hit]], counts[at[hit]]
    ends, i = np.cumsum(counts), 0
    while i < len(l):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + given, side="right")))
        n = counts[i:j]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pd.DataFrame({"l": np.repeat(l[i:j], n), "r": rt[np.repeat(starts[i:j], n) + inside]})
        i = j


def meet(batches: Iterator[pd.DataFrame], most: int = PART, given: int = GIVEN) -> Iterator[pd.DataFrame]:
    """(l, r) of packed rows in the order of part and side: the catalogue's rows of a part are held, the works' pass by,
    ``most`` keys or one row at once."""
    part, left, right = None, [], []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.part != part or sum(x.n for x in left) >= most:
                yield from _met(left, right, given)
                part, left, right = row.part, [], right if row.part == part else []
            (left if row.side else right).append(row)
    yield from _met(left, right, given)


def _once(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, each computed once: the planner would copy them into every use."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _bare(plain: str) -> Column:
    """A plain title without its article."""
    return F.when(F.substring_index(plain, " ", 1).isin("the", "a", "an"), F.regexp_replace(plain, r"^(the|a|an) ", "")).otherwise(F.col(plain))


def _titles(records: DataFrame, name: str) -> DataFrame:
    """(t, p, coded, whole, main, head, odd) of every different plain title; ``p`` is its hash, ``coded`` tells whether a record with
    it is (false where records don't say), ``main`` and ``head`` are how much of the whole stands before a break and before a
    sure one, ``odd`` marks signs of another work."""
    coded = F.coalesce("coded", F.lit(False)) if "coded" in records.columns else F.lit(False)
    distinct = records.groupBy("plain").agg(F.max(coded).alias("coded")).withColumn("t", F.monotonically_increasing_id())
    may = F.right("plain", F.lit(3)).rlike("[0-9ivx]") & _has(F.col("plain"), PARTS)
    for start in STARTS:
        may = may | F.startswith(F.col("plain"), F.lit(start))
    first = _once(distinct, ["t", "coded", "plain"], bare=_bare("plain"), odd=F.when(may, F.regexp_extract("plain", OTHER_WORK, 0)).otherwise(""))
    # A break is no letter, so the pieces that the first breaks divide are squeezed each by itself.
    kept = ["t", "coded", "plain", "odd"]
    first = _once(first, [*kept, "bare"], h=main_part(F.col("bare"), SURE_BREAKS))
    first = _once(first, [*kept, "bare", "h"], m=main_part(F.col("h"), OTHER_BREAKS))
    after = lambda c, part: F.substring(c, F.length(part) + 1, F.length(c))
    tidy = lambda c: F.when(c == "", "").otherwise(squeezed(c))
    first = _once(first, kept, x=tidy(F.col("m")), y=tidy(after(F.col("h"), F.col("m"))), z=tidy(after(F.col("bare"), F.col("h"))))
    joined = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" "), b))
    first = _once(first, [*kept, "x", "z"], xy=joined(F.col("x"), F.col("y")))
    first = first.select("t", F.xxhash64("plain").alias("p"), "coded", joined(F.col("xy"), F.col("z")).alias("whole"), F.length("x").alias("main"), F.length("xy").alias("head"), "odd")
    return cut(first.filter("whole <> ''"), name)  # written once: the numbers must not change


def candidate_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r), with repeats: different titles of the two sides that share a block. Equal titles are one; parts are as many as titles ask for.

    Keys are sorted and joined in bulk; rows of one key each would be twice as large in the shuffle."""
    parts = 1 + KEYS * (left.count() + right.count()) // PART
    a, b = (df.select("t", "whole", "main", "head", "odd").mapInPandas(_packed(side, parts), PACKED_ROW) for df, side in ((left, "works"), (right, "catalogue")))
    return a.unionByName(b).repartition("part").sortWithinPartitions("part", "side").mapInPandas(meet, "l long, r long")


def isbn_titles(w: DataFrame, c: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): titles of works and catalogue rows that share an ISBN; only titles with one are looked up."""
    a = w.filter("core is not null").select("core", "p").distinct()
    b = c.filter("size(isbns) > 0").select("p", F.explode("isbns").alias("isbn")).select("p", isbn_core(F.col("isbn")).alias("core")).dropna().distinct()
    met = spread_join(a.withColumnRenamed("p", "pl"), b.withColumnRenamed("p", "pr"), ["core"]).select("pl", "pr").distinct()
    left, right = left.filter("coded"), right.filter("coded")
    return met.join(left.select(F.col("t").alias("l"), F.col("p").alias("pl")), "pl").join(right.select(F.col("t").alias("r"), F.col("p").alias("pr")), "pr").select("l", "r")


def _tokens(titles: DataFrame) -> DataFrame:
    """(token, known): words that a share of titles has, so that they are no slips."""
    total = titles.count()
    words = titles.select(F.explode(F.split("whole", " ")).alias("token")).filter(F.length("token") >= WORD)
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= max(4, KNOWN_SHARE * total)).select("token")


def title_features(pairs: DataFrame, left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """What sets the titles of each candidate pair apart. Pairs with more edits than slips make are no matches and are left out.

    The catalogue may give the title without its subtitle (``dropped``), and the work's title may be cut off
    (``cut_off``); then the part that both have is compared, and ``rest`` is what the cut took. A catalogue title that adds a
    subtitle is ``longer``, unless the work's title ends inside a word of it. Pairs with another volume's, review's or companion's
    marks on one side, and pairs with words of the vocabulary in place of each other (another place, another subject), are
    other works by definition, even under one ISBN, and are left out.
    """
    l = left.select(F.col("t").alias("l"), *(F.col(c).alias(f"{c}_l") for c in ("p", "whole", "main", "head", "odd")))
    r = right.select(F.col("t").alias("r"), *(F.col(c).alias(f"{c}_r") for c in ("p", "whole", "main", "head", "odd")))
    ids = ["l", "r", "p_l", "p_r"]
    size = lambda c: F.length(F.col(c))
    near = lambda a, b: F.abs(a - b) <= 3
    both = pairs.join(l, "l").join(r, "r").filter("odd_l = odd_r")
    nl, nr = size("whole_l"), size("whole_r")
    length_l = F.when(near(nl, nr), nl).when(near(F.col("head_l"), nr), F.col("head_l")).when(near(F.col("main_l"), nr), F.col("main_l")).otherwise(nl)
    inside = F.startswith(F.col("whole_r"), F.col("whole_l")) & (F.substring(F.col("whole_r"), nl + 1, F.lit(1)) != " ")
    longer = ~near(nl, nr) & (nr > nl) & (near(F.col("head_r"), nl) | near(F.col("main_r"), nl)) & ~inside
    part_l = F.left("whole_l", length_l)
    both = _once(both, [*ids, "whole_l", "whole_r"], part_l=part_l, longer=longer)
    cut_off = ~F.col("longer") & (size("whole_r") > size("whole_l") + 3)
    # A cut leaves the last word in doubt.
    part_r = F.when(cut_off | F.col("longer"), F.substring(F.col("whole_r"), F.lit(1), size("whole_l"))).otherwise(F.col("whole_r"))
    rest = F.when(cut_off, F.substring(F.col("whole_r"), size("whole_l") + 1, F.lit(REST)))
    both = _once(both, [*ids, "part_l", "longer"], part_r=part_r, cut_off=cut_off, rest=rest, dropped=size("part_l") < size("whole_l"))
    tight = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    flags = ["dropped", "longer", "cut_off"]
    both = _once(both, [*ids, "part_l", "part_r", "rest", *flags], a=tight("part_l"), b=tight("part_r"))
    han = (F.octet_length("a") > 2 * size("a")) & F.col("a").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    limit = F.when(han, 2).otherwise(F.greatest(F.lit(EDITS_LEAST), F.ceil(EDITS * F.greatest(size("a"), size("b")))))
    both = _once(both, [*ids, "part_l", "part_r", "rest", "a", "b", *flags], edits=limit.cast("int"), han=han)
    both = both.filter(F.abs(size("a") - size("b")) <= F.col("edits"))
    both = _once(both, [*ids, "part_l", "part_r", "rest", "a", "b", "han", *flags], d=F.when(F.col("a") == F.col("b"), 0).otherwise(F.expr("levenshtein(a, b, edits)")))
    # Where words aren't divided, two signs in the place of two others are a word.
    both = both.filter((F.col("d") >= 0) & ~(F.col("han") & (F.col("d") == 2) & (size("a") == size("b"))))
    words = lambda c: F.split(F.col(c), " ")
    both = both.select(*ids, "d", "rest", *[F.col(c).cast("double").alias(c) for c in flags], (F.col("d") / F.greatest(size("a"), size("b"), F.lit(1))).alias("apart"),
                       F.array_except(words("part_l"), words("part_r")).alias("lone_l"), F.array_except(words("part_r"), words("part_l")).alias("lone_r"))
    both = cut(both, "pairs", pairs)
    # Only pairs with words of their own on both sides are held against the vocabulary.
    lonely = F.col("d").between(2, 2**30) & (F.size("lone_l") > 0) & (F.size("lone_r") > 0)
    kept = ["p_l", "p_r", "d", "rest", "apart", "dropped", "cut_off", "longer"]
    lone = both.filter(lonely).select("l", "r", F.inline(F.concat(
        F.transform("lone_l", lambda w: F.struct(F.lit(1).alias("left"), w.alias("token"))),
        F.transform("lone_r", lambda w: F.struct(F.lit(0).alias("left"), w.alias("token"))))))
    real = lone.filter(F.length("token") >= WORD).join(known, "token", "left_semi").groupBy("l", "r").agg(F.max("left").alias("on_l"), F.min("left").alias("on_r"))
    swapped = real.filter("on_l = 1 AND on_r = 0").select("l", "r")
    told = both.filter(lonely).select("l", "r", *kept).join(swapped, ["l", "r"], "left_anti").select(*kept)
    return both.filter(~lonely).select(*kept).unionByName(told).withColumnsRenamed({"p_l": "pl", "p_r": "pr"})


#: What the classifier weighs. ISBNs are the evidence its labels come from and no feature.
FEATURES = ["apart", "dropped", "cut_off", "longer", "several", "gap", "undated"]
#: Where the fit starts from and is drawn to: an intercept and a weight for each feature, in logits.
PRIOR = (3.0, -30.0, 0.0, 0.0, -6.0, -5.0, -0.3, 0.0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.5, prior: tuple[float, ...] | None = None) -> np.ndarray:
    """Weights of a logistic regression with an intercept in front, by Newton's method; ``ridge`` draws them to ``prior``, or to 0."""
    x = np.column_stack([np.ones(len(x)), x])
    start = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, float)
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - start)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (mean score, probability) of the rising function closest to the labels, by pooling neighbours."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, n in zip(score[order], y[order], weight[order]):
        blocks.append([s * n, float(v) * n, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _year(column: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({column}, '(1[5-9]|20)[0-9][0-9]', 0) AS INT)")


def calibrator(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the isotonic fit to the pairs kept back, with one pseudo-pair for each whole logit from -8 to 8,
    so that a calibration exists whatever was kept back."""
    grid = np.arange(-8.0, 9.0)
    share = 1 / (1 + np.exp(-grid))
    scores = np.concatenate([score, grid, grid])
    labels, weights = np.concatenate([y, np.ones(17), np.zeros(17)]), np.concatenate([np.ones(len(y)), share, 1 - share])
    return isotonic(scores, labels, weights)


#: The lower half of a long.
LOWER = (1 << 32) - 1


def _openings(column: Column) -> list[Column]:
    """The length of a title and hashes of its openings of ``STEMS`` signs, two to a long."""
    n, hashes = F.length(column).cast("long"), [F.hash(F.left(column, F.lit(k))).cast("long") for k in STEMS]
    lower = lambda c: c.bitwiseAND(F.lit(LOWER))
    return [F.shiftleft(hashes[0], 32).bitwiseOR(n).alias("opening"), F.shiftleft(hashes[1], 32).bitwiseOR(lower(hashes[2])).alias("openings")]


def _known_whole(cuts: DataFrame, mine: DataFrame) -> DataFrame:
    """(canonical_id, pl) of the cut titles where a longer title of the work with the same opening shows how it goes on. ``cuts``:
    canonical_id, p; ``mine``: the works' rows with their titles' lengths and openings, of which the longest that is at most half as
    long as the cut title must agree."""
    lower, upper = (lambda c: F.col(c).bitwiseAND(F.lit(LOWER))), (lambda c: F.shiftright(c, 32))
    names = ["n", *[f"o{k}" for k in STEMS]]
    parts = [lower("opening"), upper("opening"), upper("openings"), lower("openings")]
    rows = mine.join(cuts.select("canonical_id").distinct(), "canonical_id", "left_semi").select("canonical_id", "p", *[c.alias(n) for c, n in zip(parts, names)]).distinct()
    stems = rows.join(cuts, ["canonical_id", "p"])
    others = rows.select("canonical_id", *[F.col(c).alias(f"other_{c}") for c in names])
    same = F.lit(True)
    for k in STEMS:
        same = F.when(F.col("n") >= 2 * k, F.col(f"o{k}") == F.col(f"other_o{k}")).otherwise(same)
    known = stems.join(others, "canonical_id").filter((F.col("other_n") > F.col("n") + 3) & same)
    return known.select("canonical_id", F.col("p").alias("pl")).distinct()


def _several(best: DataFrame) -> DataFrame:
    """Marks pairs by a cut title that goes on in different ways in the titles it may be paired with: nothing in the title says
    which. Rests are told apart by the first and the last of them."""
    rests = best.filter("cut_off = 1 AND longer = 0").groupBy("canonical_id").agg(F.min("rest").alias("a"), F.max("rest").alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    several = rests.filter(F.levenshtein(F.left("a", n), F.left("b", n)) > EDITS_LEAST).select("canonical_id", F.lit(1.0).alias("s"))
    return best.join(several, "canonical_id", "left").withColumn("several", F.col("cut_off") * F.coalesce("s", F.lit(0.0))).drop("s", "rest")


def _buckets(years: str, work: bool) -> Column:
    """Keys under which years of a work and a catalogue work meet if any two of them are ``YEARS_APART`` apart at most.

    Buckets hold ``BUCKET`` years; a year of a work is entered under every bucket it reaches. Under -1 the undated of the catalogue meet dated
    works, under -2 the undated works meet all of the catalogue."""
    if not work:
        own = F.transform(years, lambda y: F.floor(y / BUCKET).cast("int"))
        return F.array_distinct(F.array_append(F.when(F.size(years) == 0, F.array(F.lit(-1))).otherwise(own), -2))
    near = F.flatten(F.transform(years, lambda y: F.transform(F.sequence(F.floor((y - YEARS_APART) / BUCKET), F.floor((y + YEARS_APART) / BUCKET)), lambda b: b.cast("int"))))
    return F.when(F.size(years) == 0, F.array(F.lit(-2))).otherwise(F.array_distinct(F.array_append(near, -1)))


def paired_works(features: DataFrame, w: DataFrame, c: DataFrame) -> DataFrame:
    """(canonical_id, trove_work_id, features): the best pair of titles for each pair of works whose years are ``YEARS_APART`` apart at most.

    Works under one common title meet by title and year, so neither all works of a title nor all years of it come together.
    """
    # Each title's works once, however many rows say so, and only of titles that are paired.
    titled = w.select("canonical_id", "p").join(features.select(F.col("pl").alias("p")).distinct(), "p", "left_semi").distinct()
    wt = cut(titled.withColumnRenamed("p", "pl"), "titled")
    mine = cut(w.join(wt.select("canonical_id").distinct(), "canonical_id", "left_semi"), "rows")
    # Sets of years have 600 members at most.
    years = mine.groupBy("canonical_id").agg(F.collect_set("year").alias("years"), F.bool_or(F.col("core").isNotNull()).alias("has_w"))
    # A title that was cut says nothing where the work has it whole.
    cuts = wt.join(features.filter("cut_off = 1").select("pl").distinct(), "pl", "left_semi").select("canonical_id", F.col("pl").alias("p"))
    known = _known_whole(cuts, mine).withColumn("known", F.lit(True))
    wt = wt.join(known, ["canonical_id", "pl"], "left").withColumn("known", F.coalesce("known", F.lit(False))).join(years, "canonical_id")
    issued = c.groupBy("trove_work_id").agg(F.collect_set("year").alias("issued"), F.bool_or(F.size("isbns") > 0).alias("has_c"))
    ct = c.join(features.select(F.col("pr").alias("p")).distinct(), "p", "left_semi").select("trove_work_id", F.col("p").alias("pr")).distinct().join(issued, "trove_work_id")
    met = cut(spread_join(wt, features, ["pl"]).filter(~(F.col("known") & (F.col("cut_off") == 1))).drop("known"), "works-by-title")
    met = met.withColumn("bucket", F.explode(_buckets("years", True)))
    ct = ct.withColumn("bucket", F.explode(_buckets("issued", False)))
    both = spread_join(met, ct, ["pr", "bucket"])
    gap = F.array_min(F.transform("years", lambda a: F.array_min(F.transform("issued", lambda b: F.abs(a - b)))))
    both = both.withColumn("gap", gap).filter(F.coalesce(F.col("gap") <= YEARS_APART, F.lit(True)))
    best = F.min_by(F.struct("d", "rest", *FEATURES[:4], "gap", (F.col("has_w") & F.col("has_c")).alias("both_isbn")), F.col("d") + 50 * F.col("longer"))
    best = both.groupBy("canonical_id", "trove_work_id").agg(best.alias("f")).select("canonical_id", "trove_work_id", "f.*")
    return best.withColumn("undated", F.col("gap").isNull().cast("double")).withColumn("gap", F.coalesce(F.col("gap").cast("double"), F.lit(0.0)))


def scored_pairs(works: DataFrame, candidates: DataFrame) -> tuple[DataFrame, dict]:
    """(canonical_id, trove_work_id, confidence) of all candidate pairs, and how the classifier did on the labelled pairs kept back.

    The report holds the number of labelled and kept-back pairs, the Brier score, that of the plain base rate, and for
    each tenth of confidence the mean confidence, the share of matches and the number of pairs.
    """
    w = mojibake.mend(works.filter("canonical_id is not null").select("canonical_id", "title", "reference_year", "isbn"), "title")
    w = cut(w.select("canonical_id", plain_title(F.col("title"), False).alias("plain"), F.when(F.col("reference_year").between(1500, 2100), F.col("reference_year")).alias("year"), isbn_core(F.col("isbn")).alias("core")).withColumn("p", F.xxhash64("plain")).select("*", *_openings(F.col("plain"))), "works")
    c = candidates.select("trove_work_id", plain_title(F.col("trove_title"), True).alias("plain"), _year("trove_issued").alias("year"), F.col("trove_isbns").alias("isbns")).filter("trove_work_id is not null").withColumn("p", F.xxhash64("plain"))
    c = cut(c, "candidates")
    titled = lambda df, coded: df.filter("plain is not null").select("plain", F.expr(coded).alias("coded"))
    left, right = _titles(titled(w, "core is not null"), "left"), _titles(titled(c, "size(isbns) > 0"), "right")
    w, c = w.drop("plain"), c.drop("plain")
    pairs = cut(candidate_titles(left, right).unionByName(isbn_titles(w, c, left, right)).distinct(), "blocks")
    features = cut(title_features(pairs, left, right, _tokens(left)), "title-pairs")
    best = cut(_several(cut(paired_works(features, w, c), "best")), "features")
    # Which of the pairs whose sides both carry an ISBN share one.
    wi = w.filter("core is not null").select("canonical_id", "core").distinct()
    ci = c.filter("size(isbns) > 0").select("trove_work_id", F.explode("isbns").alias("isbn")).select("trove_work_id", isbn_core(F.col("isbn")).alias("core")).dropna().distinct()
    told = best.filter("both_isbn").select("canonical_id", "trove_work_id")
    shared = told.join(ci, "trove_work_id").join(wi, ["canonical_id", "core"]).select("canonical_id", "trove_work_id").distinct().withColumn("same_isbn", F.lit(True))
    best = cut(best.join(shared, ["canonical_id", "trove_work_id"], "left").withColumn("same_isbn", F.coalesce("same_isbn", F.lit(False))), "labelled", best)
    labelled = best.filter("both_isbn").withColumn("h", F.xxhash64("canonical_id", "trove_work_id"))
    sample = pd.concat([labelled.filter(F.col("same_isbn") == v).orderBy("h").limit(SAMPLE).select("h", "same_isbn", *FEATURES).toPandas() for v in (True, False)])
    x, y, held = sample[FEATURES].to_numpy(float), sample["same_isbn"].to_numpy(float), (sample["h"].to_numpy() % 3) == 0
    weights = fit(x[~held], y[~held], prior=PRIOR)
    held_scores = np.column_stack([np.ones(held.sum()), x[held]]) @ weights
    steps, levels = calibrator(held_scores, y[held])
    # A shared ISBN settles which of several titles was cut, and nothing else.
    column = {name: F.col(name) for name in FEATURES} | {"several": F.when(F.col("same_isbn"), 0.0).otherwise(F.col("several"))}
    score = F.lit(float(weights[0]))
    for name, weight in zip(FEATURES, weights[1:]):
        score = score + float(weight) * column[name]
    # Between two points the probability rises evenly.
    between = F.lit(float(levels[-1]))
    for i in range(len(steps) - 1, 0, -1):
        low, high, p, q = (float(v) for v in (steps[i - 1], steps[i], levels[i - 1], levels[i]))
        rise = F.lit(p) + (F.col("score") - low) * ((q - p) / max(high - low, 1e-9))
        between = F.when(F.col("score") < high, rise).otherwise(between)
    below = F.when(F.col("score") <= float(steps[0]), float(levels[0])).otherwise(between)
    scored = best.withColumn("score", score).withColumn("confidence", F.round(below, 6))
    return scored.select("canonical_id", "trove_work_id", "confidence", *FEATURES, "d"), quality(np.interp(held_scores, steps, levels), y[held], len(sample), dict(zip(["intercept", *FEATURES], weights.round(2))))


def quality(confidence: np.ndarray, y: np.ndarray, labelled: int, weights: dict) -> dict:
    """Brier score and reliability by tenths of confidence."""
    bins = np.minimum((confidence * 10).astype(int), 9)
    rows = [(float(confidence[bins == b].mean()), float(y[bins == b].mean()), int((bins == b).sum())) for b in range(10) if (bins == b).any()]
    brier, base = (float(((confidence - y) ** 2).mean()), float(y.mean() * (1 - y.mean()))) if len(y) else (float("nan"), float("nan"))
    return {"labelled": labelled, "held": len(y), "brier": brier, "brier of the base rate": base, "reliability": rows, "weights": weights}


def matched(works: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(canonical_id, trove_work_id, confidence) of the pairs that are the same work.

    Rows without a title can't be matched by it and give nothing; titles of any length and any number of
    rows of one work or one title count; empty tables give an empty result. Works issued more than ``YEARS_APART`` years apart
    are never paired.
    """
    return scored_pairs(works, candidates)[0].filter(F.col("confidence") >= threshold).select("canonical_id", "trove_work_id", "confidence")
