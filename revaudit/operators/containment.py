"""Which hidden values occur in which prompts: a join on containment by an inverted index of q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Length of the grams; shorter values are one gram of their own length.
Q = 8


def grams(text: str | Column, n: int) -> Column:
    """The distinct substrings of ``n`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contained(prompts: DataFrame, key: str, text: str, values: DataFrame, value_key: str, value: str, q: int = Q) -> DataFrame:
    """(``key``, ``value_key``) of each prompt and hidden value that it holds, exactly, each pair of rows once.

    A value is looked for only in the prompts that hold its rarest gram, rarity being the number of prompts; a gram that no
    prompt has rules its value out. Equal prompts are one text and equal values one entry, so copies cost a row. Null and
    empty values are in nothing, null prompts hold nothing. The grams of all prompts are made once, and only those that
    a value has are kept.
    """
    texts = prompts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("tid"), F.col(text).alias("t"))
    texts = kept(texts.groupBy("tid").agg(F.first("t").alias("t")))
    wanted = kept(values.filter(F.col(value) != "").select(F.col(value).alias("v")).distinct())
    sizes = [r[0] for r in wanted.select(F.least(F.length("v"), F.lit(q)).alias("n")).distinct().collect()]  # ``q`` at most
    if not sizes:
        return prompts.select(key).limit(0).withColumn(value_key, F.lit(None).cast(values.schema[value_key].dataType))
    own = F.coalesce(*(F.when(F.least(F.length("v"), F.lit(q)) == n, grams("v", n)) for n in sorted(sizes)))
    of_values = kept(wanted.select("v", F.explode(own).alias("g")))
    every = F.concat(*(grams("t", n) for n in sorted(sizes)))
    of_texts = kept(texts.select("tid", F.explode(every).alias("g")).join(of_values.select("g").distinct(), "g", "left_semi"))
    counts = of_texts.groupBy("g").agg(F.count("*").alias("n"))
    rarest = of_values.join(counts, "g", "left").groupBy("v").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0").select("v", "r.g")
    found = of_texts.join(rarest, "g").select("tid", "v").join(texts, "tid").filter(F.contains("t", "v")).select("tid", "v")
    named = values.select(F.col(value_key), F.col(value).alias("v"))
    return prompts.select(key, F.sha2(text, 256).alias("tid")).join(found, "tid").join(named, "v").select(key, value_key)
