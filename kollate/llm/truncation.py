"""Text cut off by field limits (problem 1), in pure SQL.

Word trigrams are counted over all values of a field, apart for trigrams inside a value and at its end. The final trigram of each value is joined with these counts: one that is frequent inside values
and almost never ends one shows a cut. Where a trigram is too rare to tell, the final pair of words and
then the last word decide in the same way. A cut inside a word leaves a fragment: it hardly occurs after
the word before it, while longer words that begin with it do.

Punctuation stays on its word, so "the District:" and "the District" are different ends, and digits
count as one sign. Dots, a replacement sign or half an entity left by the transfer are taken as a cut. A source's own
limit shows as a length that far more of its values have than neighbouring lengths; a value of that
length needs less evidence. Lengths are counted by different values, so that one popular value makes none. A value of one word is
judged by what begins values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kollate.operators.skew import spread_join
from kollate.session import cut

#: An n-gram seen so often tells whether it ends values; a trigram that ended so many has shown that it may.
ENOUGH, SHOWN = 12, 3
#: Share of ends among all places of an n-gram below which it "almost never" ends a value; the same at a source's limit,
#: and where the last word by itself, seen often, almost never ends one.
RARE_END, RARE_END_AT_LIMIT, RARE_END_OF_OPEN = 0.025, 0.35, 0.15
OPEN_WORD, OPEN_SEEN = 0.02, 200
#: Longer words must be so many times as usual as the fragment, or so many times if the trigram is usual itself.
FRAGMENT_RATIO, FRAGMENT_RATIO_USUAL = 4, 10
#: Signs up to which all beginnings of a word are counted; of longer words those that are as long as a final word with the same start.
PREFIX = 40
#: Different values of one length and source, and times the mean of the ten lengths before and after, that show a limit.
LIMIT_ROWS, LIMIT_RATIO = 12, 5

_MARK = r"(\\.\\.+|…|�|&(a|am|amp|l|lt|g|gt|q|qu|quo|quot|#\\d*)?)"

#: A value in lower case, without marks of a cut at the end.
_LOWER = rf"""lower(CASE WHEN right(value, 24) RLIKE '{_MARK}\\s*$' THEN regexp_replace(value, '(\\s*{_MARK})+\\s*$', '') ELSE value END)"""
#: The same with one sign for all digits and one for all blanks; most values have neither and are left as they are.
_PLAIN = r"trim(CASE WHEN low RLIKE '[1-9\\t\\n\\r]' THEN translate(low, '123456789\t\n\r', '000000000   ') ELSE low END)"
#: The words of such a body, or of its end.
_SPLIT = "split(CASE WHEN contains({0}, '  ') THEN regexp_replace({0}, ' +', ' ') ELSE {1} END, ' ')"


def _steps(source: str, columns: str, words: str) -> str:
    """SQL that takes values apart in steps, each form computed once."""
    return rf"""
SELECT {columns}, t.w FROM (
  SELECT {columns}, b.body FROM (
    SELECT {columns}, a.low FROM (SELECT * FROM {source}) LATERAL VIEW inline(array(named_struct('low', {_LOWER}))) a AS low)
  LATERAL VIEW inline(array(named_struct('body', {_PLAIN}))) b AS body)
LATERAL VIEW inline(array(named_struct('w', {words}))) t AS w"""


VALUES = r"""
SELECT {key} AS key, {source} AS source, f.field, f.value FROM {{table}}
LATERAL VIEW inline(array({fields})) f AS field, value
WHERE f.value RLIKE '[^\\s.…�]'
"""

GRAMS = f"""
SELECT field, g.a, g.b, g.c, sum(if(g.last, 0, n)) AS inside, sum(if(g.last, n, 0)) AS ends FROM (
  SELECT field, n, explode(transform(w, (c, i) -> struct(
    CASE WHEN i >= 2 THEN w[i - 2] ELSE '' END AS a, CASE WHEN i >= 1 THEN w[i - 1] ELSE '' END AS b, c,
    i = size(w) - 1 AS last))) AS g
  FROM ({_steps("(SELECT field, value, count(*) AS n FROM {rows} GROUP BY field, value)", "field, n", _SPLIT.format("body", "body"))}) WHERE w[0] <> '')
GROUP BY field, g.a, g.b, g.c
"""

PAIRS = "SELECT field, b, c, sum(inside) AS inside, sum(ends) AS ends FROM {grams} GROUP BY field, b, c"

SINGLES = "SELECT field, c, sum(inside) AS inside, sum(ends) AS ends FROM {pairs} GROUP BY field, c"

#: How often a longer word begins with a fragment: after the word before it (``by`` field and b), or anywhere (by field).
LONGER = """
WITH words AS (SELECT {by}, c, inside + ends AS n, ends FROM {{counts}}),
lengths AS (SELECT {by}, left(c, {prefix}) AS start, collect_set(length(c)) AS found FROM words WHERE ends > 0 AND length(c) > {prefix} GROUP BY {by}, left(c, {prefix}))
SELECT h, sum(n) AS longer FROM (
  SELECT explode(transform(sequence(1, least({prefix}, length(c) - 1)), k -> xxhash64({by}, left(c, k)))) AS h, n FROM words WHERE length(c) > 1
  UNION ALL
  SELECT explode(transform(filter(found, k -> k < length(c)), k -> xxhash64({by}, left(c, k)))) AS h, n
  FROM (SELECT *, left(c, {prefix}) AS start FROM words WHERE length(c) > {prefix}) JOIN lengths USING ({by}, start))
GROUP BY h
"""

LIMITS = """
SELECT source, field, len FROM (
  SELECT source, field, len, n,
    (sum(n) OVER (PARTITION BY source, field ORDER BY len RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - n) / 20.0 AS near
  FROM (SELECT source, field, len, count(*) AS n FROM (SELECT source, field, length(value) AS len, xxhash64(value) AS v FROM {rows} GROUP BY ALL) GROUP BY ALL))
WHERE n >= {limit_rows} AND n >= {limit_ratio} * near
"""

#: Every final trigram with its counts, those of its last pair and last word, and of longer words.
ENDS = """
SELECT xxhash64(field, a, b, c) AS h, g.inside AS inside3, g.ends - 1 AS ends3, p.inside AS inside2, p.ends - 1 AS ends2, s.inside AS inside1, s.ends - 1 AS ends1,
  coalesce(l.longer, 0) AS longer2, coalesce(lw.longer, 0) AS longer1
FROM (SELECT * FROM {grams} WHERE ends > 0) g
JOIN {pairs} p USING (field, b, c)
JOIN {singles} s USING (field, c)
LEFT JOIN {longer} l ON l.h = xxhash64(g.field, g.b, g.c)
LEFT JOIN {longer_words} lw ON lw.h = xxhash64(g.field, g.c)
"""

#: Adds the length, the mark of a cut and the hash of the final trigram to rows with field and value. The last words are
#: taken from the end of the value, unless it has blanks in a row.
TAILS = rf"""
SELECT {{columns}}, len, marked,
  xxhash64(field, CASE WHEN size(w) >= 3 THEN w[size(w) - 3] ELSE '' END, CASE WHEN size(w) >= 2 THEN w[size(w) - 2] ELSE '' END, w[size(w) - 1]) AS h
FROM ({_steps("(SELECT *, length(value) AS len, right(value, 24) RLIKE '" + _MARK + chr(92) * 2 + "s*$' AS marked FROM {{rows}})", "{columns}, len, marked", _SPLIT.format("body", "substring_index(body, ' ', -3)"))})
"""


def _run(df: DataFrame, sql: str, **views) -> DataFrame:
    return df.sparkSession.sql(sql, **views)


def final_trigrams(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, counts) of every different final trigram, by its hash, and (h, n): how many values end so."""
    grams = cut(_run(rows, GRAMS, rows=rows), "grams")
    pairs = cut(_run(rows, PAIRS, grams=grams), "pairs")
    singles = cut(_run(rows, SINGLES, pairs=pairs), "singles")
    longer = _run(rows, LONGER.format(by="field, b", prefix=PREFIX), counts=pairs)
    longer_words = _run(rows, LONGER.format(by="field", prefix=PREFIX), counts=singles)
    ends = _run(rows, ENDS, grams=grams, pairs=pairs, singles=singles, longer=longer, longer_words=longer_words)
    return ends, _run(rows, "SELECT xxhash64(field, a, b, c) AS h, ends AS n FROM {grams} WHERE ends > 0", grams=grams)


def field_rows(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    listed = ", ".join(f"named_struct('field', '{f}', 'value', `{f}`)" for f in fields)
    plain = df.select(key, source, *fields)
    return _run(df, VALUES.format(key=f"`{key}`", source=f"`{source}`", fields=listed), table=plain)


def never_ends(least: float) -> F.Column:
    """Whether the final words say that the value goes on, by the longest n-gram seen often enough."""
    seen = [F.col(f"inside{n}") + F.col(f"ends{n}") for n in (1, 2, 3)]
    open_word = (seen[0] >= OPEN_SEEN) & (F.col("ends1") < OPEN_WORD * seen[0])
    below = F.when(open_word, max(least, RARE_END_OF_OPEN)).otherwise(least)
    rare = [F.col(f"ends{n}") < below * (0.5 if n < 3 else 1.0) * seen[n - 1] for n in (1, 2, 3)]
    enough = [n >= ENOUGH for n in seen]
    fragment = (F.col("longer2") >= SHOWN) & (F.col("longer2") >= F.when(enough[2], FRAGMENT_RATIO_USUAL).otherwise(FRAGMENT_RATIO) * (seen[1] + 1))
    unknown = (F.col("longer1") >= ENOUGH) & (F.col("longer1") >= 2 * FRAGMENT_RATIO_USUAL * (seen[0] + 1))
    may_end = (F.col("ends3") >= SHOWN) & ~rare[2]
    return F.when(fragment, True).when(enough[2], rare[2]).when(may_end, False).when(enough[1], rare[1]).otherwise(unknown)


def tails(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns of rows with field and value, with len, marked and h."""
    return _run(rows, TAILS.format(columns=", ".join(kept)), rows=rows)


def verdicts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, short, short_at_limit) of the final trigrams that show a cut, at any length or at a source's limit; (h, n) of all."""
    ends, counted = final_trigrams(rows)
    found = ends.select("h", never_ends(RARE_END).alias("short"), never_ends(RARE_END_AT_LIMIT).alias("short_at_limit"))
    return found.filter("short OR short_at_limit"), counted


def limits(rows: DataFrame) -> DataFrame:
    """(source, field, len, limited) of the lengths that are limits of a source."""
    return _run(rows, LIMITS.format(rows="{rows}", limit_rows=LIMIT_ROWS, limit_ratio=LIMIT_RATIO), rows=rows).withColumn("limited", F.lit(True))


def truncated(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(key, source, field) of each value that stops short.

    Null and blank values and values of dots alone are never cut; repeated rows come out as often as they
    go in; the words of very long values all count. An empty table gives an empty result. Only hashes of
    final trigrams travel with the rows, and only the trigrams that show a cut with them; a popular ending is dealt out.
    """
    rows = field_rows(df, key, source, fields)
    short, counted = verdicts(rows)
    found = spread_join(tails(rows, ["key", "source", "field"]), short, ["h"], "left", counted=counted).filter("marked OR short OR short_at_limit")
    found = found.join(limits(rows), ["source", "field", "len"], "left").filter("marked OR short OR limited AND short_at_limit")
    return found.select(F.col("key").alias(key), F.col("source").alias(source), "field")


def shares(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(source, field, n_values, n_cut, cut_share): how often each source truncates each field."""
    total = field_rows(df, key, source, fields).groupBy("source", "field").agg(F.count("*").alias("n_values"))
    cuts = truncated(df, key, source, fields).groupBy(F.col(source).alias("source"), "field").agg(F.count("*").alias("n_cut"))
    joined = total.join(cuts, (total.source.eqNullSafe(cuts.source)) & (total.field == cuts.field), "left")
    n = F.coalesce("n_cut", F.lit(0))
    return joined.select(total.source.alias(source), total.field, "n_values", n.alias("n_cut"), F.round(n / F.col("n_values"), 6).alias("cut_share"))
