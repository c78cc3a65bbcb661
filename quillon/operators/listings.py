"""Listings, checks and turn lists of the application: filters, searches and small joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import citations, embed, embed_input, fir_type, place_hint, section_order


def contains(search: str, *columns: str) -> Column:
    """Whether one of the columns contains the text, whatever the case; % and _ in it are signs like others."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(search.lower())), F.lit(False))
    return out


def act_like(sections: DataFrame, pattern: str) -> DataFrame:
    """Sections whose act matches the pattern, whatever the case; its wildcards count."""
    return sections.where(F.ilike("act_code", F.lit(pattern)))


def page(df: DataFrame, order: Sequence[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def browse(sections: DataFrame, act: str | None = None, search: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """One page of the open sections of an act in natural order of their numbers, by a text in any of four columns."""
    out = sections.where(F.col("valid_to").isNull())
    if act:
        out = out.where(F.lower("act_code") == act.lower())
    if search:
        out = out.where(contains(search, "section_number", "marginal_note", "section_text", "category"))
    return page(out, ["act_code", *section_order("section_number")], number, size)


def feed(items: DataFrame, featured: bool | None = None, language: str | None = None, search: str | None = None, key: str = "id", most: int = 20) -> DataFrame:
    """The newest items (published, featured, language, title, summary) that pass the filters given."""
    out = items
    if featured is not None:
        out = out.where(F.col("featured") == featured)
    if language:
        out = out.where(F.col("language") == language)
    if search:
        out = out.where(contains(search, "title", "summary"))
    return out.orderBy(F.col("published").desc_nulls_last(), key).limit(most)


def check_citations(cited: DataFrame, sections: DataFrame) -> DataFrame:
    """cited(act, number, ...) with `found`: whether a section of that act (whatever the case) has exactly that number."""
    known = sections.select(F.lower("act_code").alias("_act"), F.col("section_number").alias("_number")).distinct().withColumn("_hit", F.lit(True))
    out = cited.join(known, (F.lower("act") == F.col("_act")) & (F.col("number") == F.col("_number")), "left")
    return out.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_act", "_number", "_hit")


def history(turns: DataFrame, session: str, order: str, done: Column) -> DataFrame:
    """Each session's turns that are done, numbered in order."""
    return turns.where(done).withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def with_response(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Each query (role user) and the response to it: the next turn if that is an assistant's, else NULL."""
    w = Window.partitionBy(session).orderBy(order)
    out = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return out.where("role = 'user'").withColumn("response", F.when(F.col("_role") == "assistant", F.col("_text"))).drop("_role", "_text")


def user_turns(turns: DataFrame, session: str) -> DataFrame:
    return turns.groupBy(session).agg(F.count_if(F.col("role") == "user").alias("turns"))


def with_parent(categories: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Each category with its parent's name, one level up."""
    up = categories.select(F.col(key).alias("_key"), F.col(name).alias("parent_name"))
    return categories.join(up, F.col(parent) == F.col("_key"), "left").drop("_key")


def highest_number(sections: DataFrame) -> DataFrame:
    """act_code, highest: the greatest number that a section's number begins with."""
    return sections.groupBy("act_code").agg(F.max(F.regexp_extract("section_number", r"^(\d+)", 1).try_cast("int")).alias("highest"))


def backfill(sections: DataFrame, dim: int = 768) -> DataFrame:
    """The sections without an embedding get one of their title and text."""
    return sections.withColumn("embedding", F.coalesce("embedding", embed(embed_input(F.coalesce("marginal_note", F.lit("")), "section_text"), dim)))


# Fixed values.
DATE = r"\b(\d{1,2}[\s/-]\w+[\s/-]\d{2,4}|\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})\b"
DATE_FORMATS = ("yyyy MM dd", "M d yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")
LONGEST_DESCRIPTION = 800


def first_date(text: Column | str) -> Column:
    """The first date of a text, as year-month-day; NULL if there is none or the first is no day of the calendar."""
    plain = F.regexp_replace(F.regexp_extract(text, DATE, 1), r"[\s/,-]+", " ")
    return F.coalesce(*[F.try_to_date(plain, f) for f in DATE_FORMATS]).cast("string")


def complaint(turns: DataFrame, session: str, order: str) -> DataFrame:
    """session, description (the user's words, 800 characters), incident_date (the first date as year-month-day, if it is one),
    place, sections (first three citations of the answers), fir_type, messages."""
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(F.col(order), F.col("text"))))), lambda x: x["text"])
    by = turns.groupBy(session).agg(said("user").alias("user"), said("assistant").alias("answers"))
    by = by.select(session, F.array_join("user", " ").alias("u"), F.array_join("answers", " ").alias("a"), F.size("user").alias("messages"))
    return by.select(session, F.substring("u", 1, LONGEST_DESCRIPTION).alias("description"), first_date("u").alias("incident_date"), place_hint("u").alias("place"), citations("a").alias("sections"), fir_type("a").alias("fir_type"), "messages")
