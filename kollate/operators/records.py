"""Raw submissions to processed rows: every field with its presence, clean value, well-formedness and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kollate.functions import text
from kollate.operators import clean, detect



def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _kept(present: Column, found: Column, name: str, kind: str) -> Column:
    return F.when(present, found[name].cast(kind))


def processed(rows: DataFrame, fields: list[str], kind: str = "research_output_type", doi: str = "doi", title: str = "title") -> DataFrame:
    """``rows`` with, for the DOI, the title and each of ``fields``: <f>_presence, <f>, <f>_wellformed and <f>_provenance.

    A missing value has a null value and null verdict and no codes. DOI and title count as missing where they are blank, other
    fields also where they only say so ("unknown"). A field has the cleaner that ``clean.cleaner`` gives for its record's type, or for all; one
    without is free text. Titles also get their structural signs, taken from the raw value. All other columns stay.
    """
    out = rows
    types = sorted({k for _, k in clean.REGISTRY if k})
    for field in [doi, title, *fields]:
        own = [k for k in types if (field, k) in clean.REGISTRY]
        general = clean.cleaner(field)
        if field in (doi, title):
            present = F.coalesce(F.length(text.strip(field)) > 0, F.lit(False))
        else:
            present = text.presence(F.col(field).cast("string")) == "present"
        if general is None and not own:
            out = clean.free_text(out, field, f"_{field}_clean")
        else:
            value = F.col(field).cast("string")
            # Of a field with cleaners for some types only, the other types are taken as they are.
            plain = F.struct(value.alias("value"), _none("boolean").alias("wellformed"), F.array().cast("array<string>").alias("codes"))
            found = general.clean(value) if general else plain
            for k in own:
                found = F.when(F.col(kind) == k, clean.cleaner(field, k).clean(value)).otherwise(found)
            out = out.withColumn(f"_{field}_clean", found)
        out = out.withColumn(f"_{field}_there", present)
    raw = F.col(title)
    signs = {
        f"{title}_has_html": detect.html_tag(raw), f"{title}_has_tex": detect.tex_command(raw), f"{title}_has_non_latin": detect.non_latin(raw), f"{title}_has_mojibake": detect.read_as_latin(raw),
        f"{title}_has_daterange": detect.year_range(raw).isNotNull(), f"{title}_daterange_status": detect.year_range(raw), f"{title}_has_en_us": detect.dialect(raw)["us"], f"{title}_has_en_gb": detect.dialect(raw)["gb"],
    }
    there = F.col(f"_{title}_there")
    out = out.withColumns({name: F.when(there, sign) for name, sign in signs.items()})
    columns = {}
    for field in [doi, title, *fields]:
        found, there = F.col(f"_{field}_clean"), F.col(f"_{field}_there")
        columns |= {f"{field}_presence": F.when(there, "present").otherwise("missing"), f"{field}_wellformed": _kept(there, found, "wellformed", "boolean"),
                    f"{field}_provenance": F.coalesce(_kept(there, found, "codes", "array<string>"), F.array().cast("array<string>")), field: _kept(there, found, "value", "string")}
    return out.withColumns(columns).drop(*[f"_{f}_{x}" for f in [doi, title, *fields] for x in ("clean", "there")])


def classify_match(a: Column, b: Column, cleaner: clean.Cleaner) -> Column:
    """struct(value, wellformed, codes): whether two values are the same once each is cleaned. Equal ones have both sides' codes, each
    once; others have no value and no codes, as have pairs with a null."""
    x, y = cleaner.clean(a), cleaner.clean(b)
    same = F.coalesce(x["value"] == y["value"], F.lit(False))
    no_codes = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(x["codes"], no_codes), F.coalesce(y["codes"], no_codes))
    return F.struct(F.when(same, x["value"]).alias("value"), same.alias("wellformed"), F.when(same, both).otherwise(no_codes).alias("codes"))


def _collapsed(column: Column) -> Column:
    return F.lower(text.strip(F.regexp_replace(column, r"(?U)\s+", " ")))


def listed_title(df: DataFrame, value: str, key: str, titles: DataFrame, out: str) -> DataFrame:
    """Adds struct(value, wellformed): whether a journal's title is the one a list has for the record's own id, case and blanks aside.

    ``titles``: key, title. Without an id, an entry, or a title in it there is nothing to check: well-formed is null. Of several entries of
    one id the smallest title counts.
    """
    known = titles.groupBy(F.col(titles.columns[0]).cast("string").alias("_k")).agg(F.min(titles.columns[1]).alias("_t"))
    joined = df.join(known, df[key].cast("string") == F.col("_k"), "left")
    verdict = F.when(F.length("_t") > 0, _collapsed(F.col(value)) == _collapsed(F.col("_t")))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.struct(text.strip(value).alias("value"), verdict.alias("wellformed")))).drop("_k", "_t")


def agreed_name(df: DataFrame, value: str, key: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Adds struct(value, wellformed, codes): a conference's name cleaned as free text, and well-formed only if it is also the name that
    its id has by agreement of all records (``clean.consensus_vocabulary``: key, value). Without an agreed name the text alone decides."""
    cleaned = clean.free_text(df, value, "_free")
    agreed = vocabulary.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    joined = cleaned.join(agreed, cleaned[key] == F.col("_k"), "left")
    # The vocabulary's values have lost their full stop, as the cleaned ones have.
    same = _collapsed(F.col("_free.value")) == _collapsed(F.col("_v"))
    verdict = F.col("_free.wellformed") & F.coalesce(same, F.lit(True))
    return joined.withColumn(out, F.when(F.col("_free").isNotNull(), F.struct(F.col("_free.value").alias("value"), verdict.alias("wellformed"), F.col("_free.codes").alias("codes")))).drop("_free", "_k", "_v")
