"""Best representative of each duplicate group (problem 4).

Each field of a group gets the existing value closest to a token-level consensus. The usable values are
aligned progressively, heaviest first; each column of the alignment is decided by a weighted vote of
the tokens and gaps in it, and the value whose alignment agrees most with the decided columns survives.

A value weighs by its rank by time of delivery, by its rank by trust, and by the number of rows that hold it: a rank is worth
a third of the one before, and rows count up to twice one. So a value that is first in both ranks has more than half of all votes,
and where none is, the tokens decide. Values that are missing, blank, filler, malformed, cut or garbled don't vote. One that another
value with a vote merely continues abstains beyond its end and can't survive.

Weights are whole numbers, so votes add up alike in any order, and end at 0: beyond the first ``VOTERS`` of both ranks no
vote is left. That makes the decision the same for groups of any size: the voters, found rank by rank in parts of bounded size, build
the columns; all other values of a large group are held against the decided columns where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kollate.llm import mojibake, truncation
from kollate.session import cut

#: Different values of one group and field that come together in one task.
CHUNK = 512
#: Ranks that have a vote: the weight of a rank is ``UNIT`` over a power of three, and below 1 from there on.
VOTERS, UNIT = 32, 3**31
#: Rounds in which the voters of a group are found; each leaves an eighth, so this is enough for any table.
ROUNDS = 40
#: Words that stand where a value is missing.
FILLER = ("", "untitled", "no title", "title unknown", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "tba", "tbc", "tbd", "to be advised", "to be announced", "to be confirmed", "not available", "not applicable", "not known", "pending", "in press", "forthcoming", "various", "test", "-", "--", "?", ".", "...", "x", "xx", "xxx")
_AROUND = "[]() \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Years a work may bear; 0 and 9999 stand for unknown ones.
YEARS = (1500, 2100)


def align(columns: list[dict[str, int]], tokens: list[str], total: int) -> list[tuple[int, int]]:
    """Pairs (column, token) of the best alignment, -1 where a side has a gap. A column holds the weight of each of its tokens."""
    n, m = len(columns), len(tokens)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                score[i][j] = -0.5 * (i + j)
            else:
                hit = columns[i - 1].get(tokens[j - 1], 0) / total
                score[i][j] = max(score[i - 1][j - 1] + 2 * hit - 0.6 * (hit == 0), score[i - 1][j] - 0.5, score[i][j - 1] - 0.5)
    out, i, j = [], n, m
    while i or j:
        if i and j:
            hit = columns[i - 1].get(tokens[j - 1], 0) / total
            if score[i][j] == score[i - 1][j - 1] + 2 * hit - 0.6 * (hit == 0):
                i, j = i - 1, j - 1
                out.append((i, j))
                continue
        if i and (j == 0 or score[i][j] == score[i - 1][j] - 0.5):
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def ranked(values: list[dict]) -> tuple[list[int], list[int]]:
    """Places of the values by time of delivery and by trust; ties of one go by the other, then by length and text."""
    text = lambda v: (-len(v["value"]), v["value"])
    orders = []
    for first, then in (("delivered", "trust"), ("trust", "delivered")):
        order = sorted(range(len(values)), key=lambda i: (-values[i][first], -values[i][then], *text(values[i])))
        place = [0] * len(values)
        for k, i in enumerate(order):
            place[i] = k
        orders.append(place)
    return orders[0], orders[1]


def weight(recency: int, trust: int, rows: int) -> int:
    """The votes of a value: up to twice the sum of what its two ranks are worth."""
    worth = UNIT // 3**recency + UNIT // 3**trust
    return 2 * worth - worth // max(1, rows)


def continued(values: list[str]) -> list[bool]:
    """Whether another of the values goes on where each ends, case and final dots aside."""
    folded = [v.casefold().rstrip(" .") for v in values]
    order = sorted(set(folded))
    goes_on = {a for a, b in zip(order, order[1:]) if b.startswith(a)}
    return [f in goes_on for f in folded]


def consensus(values: list[list[str]], weights: list[int], open_ended: list[bool]) -> list[dict[str | None, int]]:
    """The columns of the progressive alignment with the votes in each; None is a gap. ``values`` are lists of tokens, heaviest first."""
    columns: list[dict] = []
    voted = 0
    for tokens, weight_, open_end in zip(values, weights, open_ended):
        pairs = align(columns, tokens, max(1, voted))
        grown = [dict(columns[i]) if i >= 0 else {None: voted} for i, _ in pairs]
        last = max((k for k, (_, j) in enumerate(pairs) if j >= 0), default=-1)
        for k, (column, (_, j)) in enumerate(zip(grown, pairs)):
            if j >= 0 or not open_end or k < last:
                token = tokens[j] if j >= 0 else None
                column[token] = column.get(token, 0) + weight_
        columns, voted = grown, voted + weight_
    return columns


def decided(columns: list[dict[str | None, int]]) -> list[str | None]:
    """What each column's vote decides: the heaviest token, before a gap; of equal ones the first in order."""
    return [min(c, key=lambda t: (-c[t], t is None, t or "")) for c in columns]


def agreement(tokens: list[str], decision: list[str | None]) -> int:
    """Columns of the decision that a value's alignment with it agrees with, less its tokens that no column has."""
    wanted = [t for t in decision if t is not None]
    n, m = len(wanted), len(tokens)
    row = [0] * (m + 1)
    for i in range(n):
        before = row
        row = [0] * (m + 1)
        for j in range(m):
            row[j + 1] = before[j] + 1 if wanted[i] == tokens[j] else max(before[j + 1], row[j])
    return 2 * row[m] - m


def decide(voters: list[dict]) -> tuple[list[str | None], list[int]]:
    """What the columns of some values' alignment decide, and the values' weights."""
    recency, trust = ranked(voters)
    weights = [weight(r, t, v["rows"]) for r, t, v in zip(recency, trust, voters)]
    order = sorted(range(len(voters)), key=lambda i: (-weights[i], -len(voters[i]["value"]), voters[i]["value"]))
    open_ended = continued([v["value"] for v in voters])
    order = [i for i in order if weights[i] > 0]
    columns = consensus([voters[i]["value"].split() for i in order], [weights[i] for i in order], [open_ended[i] for i in order])
    return decided(columns), weights


def voting(values: list[dict]) -> list[int]:
    """The values that are among the first ``VOTERS`` by either rank."""
    return [i for i, places in enumerate(zip(*ranked(values))) if min(places) < VOTERS]


def survivor(candidates: list[dict]) -> dict:
    """Of candidates with value, trust, delivered and rows (each different in value), the one that survives."""
    candidates = [{"rows": 1, **c} for c in candidates]
    voters = voting(candidates)
    decision, weights = decide([candidates[i] for i in voters])
    weight_of = dict(zip(voters, weights))
    goes_on = dict(zip(voters, continued([candidates[i]["value"] for i in voters])))
    folded = [candidates[i]["value"].casefold().rstrip(" .") for i in voters]

    def able(i: int) -> bool:
        if i in goes_on:
            return not goes_on[i]
        own = candidates[i]["value"].casefold().rstrip(" .")
        return not any(f != own and f.startswith(own) for f in folded)

    return candidates[min(filter(able, range(len(candidates))), key=lambda i: (-agreement(candidates[i]["value"].split(), decision), -weight_of.get(i, 0), -len(candidates[i]["value"]), candidates[i]["value"]))]


_FIELDS = ("value", "first", "delivered", "trust", "rows")


def _lists(batch: pa.RecordBatch) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The columns of the gathered candidates of a batch, flat, and where each group's begin."""
    lists = batch.column("found")
    flat = lists.flatten()
    return {name: flat.field(name) for name in _FIELDS}, np.asarray(lists.offsets) - lists.offsets[0].as_py()


def _opened(fields: dict[str, pa.Array], start: int, end: int) -> list[dict]:
    part = {name: column.slice(start, end - start).to_pylist() for name, column in fields.items()}
    return [dict(zip(part, row)) for row in zip(*part.values())]


def _survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The survivor of each list of candidates. Only lists of several are opened; what survives is picked by place."""
    for batch in batches:
        fields, ends = _lists(batch)
        picked = ends[:-1].copy()
        for i in np.flatnonzero(np.diff(ends) > 1):
            several = [dict(c, place=k) for k, c in enumerate(_opened(fields, ends[i], ends[i + 1]))]
            picked[i] += survivor(several)["place"]
        columns = [batch.column(n) for n in ("work", "field")] + [fields[n].take(pa.array(picked)) for n in ("value", "first")]
        yield pa.RecordBatch.from_arrays(columns, names=["work", "field", "value", "first"])


def _voters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list the candidates that are among the first ``VOTERS`` of it by either rank."""
    for batch in batches:
        fields, ends = _lists(batch)
        kept, owner = [], []
        for i in range(len(ends) - 1):
            here = voting(_opened(fields, ends[i], ends[i + 1]))
            kept += [ends[i] + k for k in here]
            owner += [i] * len(here)
        columns = [batch.column(n).take(pa.array(owner, pa.int64())) for n in ("work", "field")] + [fields[n].take(pa.array(kept, pa.int64())) for n in _FIELDS]
        yield pa.RecordBatch.from_arrays(columns, names=["work", "field", *_FIELDS])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list of voters the decided columns, and the voters with their weights."""
    for batch in batches:
        fields, ends = _lists(batch)
        out = []
        for i in range(len(ends) - 1):
            some = _opened(fields, ends[i], ends[i + 1])
            decision, weights = decide(some)
            out.append(([t for t in decision if t is not None], [s["value"] for s in some], weights))
        kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))
        columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("work"), batch.column("field"), *columns], names=["work", "field", "decision", "voters", "weights"])


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value with how far it agrees with its group's decision, its weight, and whether a voter continues it."""
    for batch in batches:
        rows = batch.select(["value", "decision", "voters", "weights"]).to_pylist()
        agreed = [agreement(r["value"].split(), r["decision"]) for r in rows]
        weights = [dict(zip(r["voters"], r["weights"])).get(r["value"], 0) for r in rows]
        goes_on = [continued([*{r["value"], *r["voters"]}]) for r in rows]
        able = [not flags[[*{r["value"], *r["voters"]}].index(r["value"])] for r, flags in zip(rows, goes_on)]
        columns = [batch.column(n) for n in ("work", "field", "value", "first")] + [pa.array(agreed, pa.int64()), pa.array(weights, pa.int64()), pa.array(able)]
        yield pa.RecordBatch.from_arrays(columns, names=["work", "field", "value", "first", "agreed", "weight", "able"])


def _gathered(values: DataFrame, part) -> DataFrame:
    return values.groupBy("work", "field", part.alias("part")).agg(F.collect_list(F.struct(*_FIELDS)).alias("found")).select("work", "field", "found")


def survivors(values: DataFrame, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """(work, field, value, first) of ``values``: work, field, value, first (row), delivered (long), trust, rows and n, each usable value of a work once.

    ``n`` is how many rows the work has, so at least how many different values; it only says where the work is done: the values of works
    with more than ``chunk`` rows never come together in one task. ``most`` is the largest n if it is known. An empty table gives an empty result.
    """
    kind = "work long, field string, value string, first long"
    if chunk < 4 * VOTERS:
        raise ValueError("a chunk must hold twice the voters of a group")
    if most is None or most > chunk:
        values = cut(values, "usable")
    small = _gathered(values.filter(F.col("n") <= chunk), F.lit(0)).mapInArrow(_survive, kind)
    large = values.filter(F.col("n") > chunk).select("work", "field", *_FIELDS)
    if most is not None and most <= chunk or large.isEmpty():
        return small
    voters = large
    listed = "work long, field string, value string, first long, delivered long, trust int, rows long"
    for number in range(ROUNDS):
        counts = voters.groupBy("work", "field").agg(F.ceil(F.count("*") / chunk).alias("parts"))
        parts = counts.agg(F.max("parts")).head()[0]
        parted = voters.join(F.broadcast(counts), ["work", "field"])  # groups of more than ``chunk`` values, so few against the rows
        voters = cut(_gathered(parted, F.pmod(F.xxhash64("value", F.lit(number)), F.col("parts"))).mapInArrow(_voters, listed), "voters", *([voters] if number else []))
        if parts == 1:
            break
    else:
        raise RuntimeError(f"the voters of a group were not found in {ROUNDS} rounds")
    decisions = cut(_gathered(voters, F.lit(0)).mapInArrow(_decisions, "work long, field string, decision array<string>, voters array<string>, weights array<long>"), "decisions", voters)
    held = large.select("work", "field", "value", "first").join(F.broadcast(decisions), ["work", "field"])
    kinds = kind + ", agreed long, weight long, able boolean"
    held = held.select("work", "field", "value", "first", "decision", "voters", "weights").mapInArrow(_agreements, kinds).filter("able")
    best = F.min_by(F.struct("value", "first"), F.struct(-F.col("agreed"), -F.col("weight"), -F.length("value"), "value"))
    return small.unionByName(held.groupBy("work", "field").agg(best.alias("b")).select("work", "field", "b.*"))


def filler(column) -> Column:
    """Whether a value only fills its place, whatever blanks and brackets are around it."""
    bare = F.btrim(column, F.lit(_AROUND))
    return (F.length(bare) <= max(map(len, FILLER))) & F.lower(bare).isin(*FILLER)


def usable_values(works: DataFrame, institutions: DataFrame) -> DataFrame:
    """(work, field, value, first, delivered, trust, rows, n) of the different values of works in two rows at least that can be used.

    A title or outlet is no filler, neither cut nor garbled; a DOI is well-formed; a year is a year. What shows a cut or a
    wrong encoding is counted over all rows; the values of works in several rows are then held against it.
    """
    needed = works.select("canonical_id", "row_id", "title", "doi", "doi_wellformed", "reference_year", "outlet", "delivered_by", "delivered_at")
    texts = truncation.field_rows(needed, "row_id", "delivered_by", ["title", "outlet"])
    again = needed.groupBy("canonical_id").agg(F.count("*").alias("n")).filter("n > 1")
    trust = institutions.select(F.col("institution").alias("delivered_by"), F.col("trust_level").alias("trust")).groupBy("delivered_by").agg(F.max("trust").alias("trust"))
    delivered = F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(-(2**62)))
    rows = needed.join(again, "canonical_id").join(trust, "delivered_by", "left")

    def different(fields: dict[str, Column], *more: Column) -> DataFrame:
        """Each different value of each work, with its first row, last delivery and highest trust."""
        listed = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in fields.items()])
        flat = rows.select(F.col("canonical_id").alias("work"), F.col("row_id").alias("first"), F.col("delivered_by").alias("source"), delivered.alias("delivered"), F.coalesce("trust", F.lit(0)).alias("trust"), "n", F.inline(listed)).filter("value is not null")
        if more:
            flat = flat.filter(~filler(F.col("value"))).withColumn("len", F.length("value")).join(truncation.limits(texts), ["source", "field", "len"], "left")
        return flat.groupBy("work", "field", "value").agg(F.min("first").alias("first"), F.max("delivered").alias("delivered"), F.max("trust").alias("trust"), F.count("*").alias("rows"), F.max("n").alias("n"), *more)

    year = F.when(F.col("reference_year").between(*YEARS), F.col("reference_year").cast("string"))
    values = different({"title": F.col("title"), "outlet": F.col("outlet")}, F.max(F.coalesce("limited", F.lit(False))).alias("limited"))
    plain = different({"doi": F.when(F.col("doi_wellformed"), F.col("doi")), "reference_year": year})
    kept = ["work", "field", "value", "first", "delivered", "trust", "rows", "n"]
    held = truncation.tails(values, [*kept, "limited"]).join(truncation.verdicts(texts)[0], "h", "left")
    whole = held.filter(~(F.col("marked") | F.coalesce("short", F.lit(False)) | (F.col("limited") & F.coalesce("short_at_limit", F.lit(False)))))
    garbled = mojibake.garbled(needed.select(F.col("title").alias("text")).unionByName(needed.select(F.col("outlet").alias("text"))).filter("text is not null"))
    right = whole.withColumn("bad", garbled(F.col("value"))).filter(~F.col("bad")).select(*kept)
    return right.unionByName(plain.select(*kept))


def surviving(works: DataFrame, institutions: DataFrame) -> DataFrame:
    """(work, field, value, first) of each work in two rows at least."""
    works = works.filter("canonical_id is not null")
    most = works.groupBy("canonical_id").count().agg(F.max("count")).head()[0] or 0
    return survivors(usable_values(works, institutions), most=most)


def best_values(works: DataFrame, institutions: DataFrame) -> DataFrame:
    """(canonical_id, field, row_id): of each work in two rows at least, the lowest row that holds each field's surviving value."""
    return surviving(works, institutions).select(F.col("work").alias("canonical_id"), "field", F.col("first").alias("row_id"))
