"""Queries over what is said and answered: places, cleaned responses, prompt contexts, rejected changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import corpus
from quillon.plans.catalog import _ALIVE, _NEW, _S, AS_OF, _new_sections, query, sections, statuses
from quillon.sources.tables import table

_SAID = ("It was near the Old Bridge, at night", "We met inside MG Road station. Then", "location: Sector 21 market! Help", "Place: at X, in a lane behind the school?", "He came from home", "No word of it")


def _place_sql(t: str) -> str:
    words = lambda w: f"trim(regexp_extract(substr({t}, instr(lower({t}), ' {w} ') + {len(w) + 2}, 38), '^[^,.!?]*'))"
    return "coalesce(" + ", ".join(f"case when instr(lower({t}), ' {w} ') > 0 and length({words(w)}) between 4 and 59 then {words(w)} end" for w in X.PLACES) + ", '')"


@query("place_hints", f"""with t as (select conv_id, turn, ' ' || [{', '.join(f"'{s}'" for s in _SAID)}][1 + (conv_id + turn) % {len(_SAID)}] || ' ' || coalesce(text, '') as t from conversations)
    select conv_id, turn, {_place_sql('t')} as place from t""")
def place_hints(spark, sf):
    """Where it happened, as a turn says it: the first place word that is followed by enough."""
    said = F.get(F.array(*map(F.lit, _SAID)), ((F.col("conv_id") + F.col("turn")) % len(_SAID)).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.place_hint(F.concat(F.lit(" "), said, F.lit(" "), F.coalesce("text", F.lit("")))).alias("place"))


@query("response_clean", """with t as (select conv_id, turn, (conv_id + turn) % 6 as k, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', 'x', 'g')) as t from conversations)
    select conv_id, turn, md5(case k when 0 then 'said ' || t || ' end' when 1 then 'a ⚠️ b' when 4 then '{"other": 1}' when 5 then '' else trim(case k when 2 then 'Here: ```json' || chr(10) || '{"n": ' || conv_id || '}' || chr(10) || '``` done' else t end) end) as clean,
        case k when 2 then '{"n": ' || conv_id || '}' when 3 then t when 4 then '{"other": 1}' end as fenced from t""")
def response_clean(spark, sf):
    """Answers that are wrapped, warn twice, carry JSON between fences, or are plain."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "x"))
    n = F.concat(F.lit('{"n": '), F.col("conv_id").cast("string"), F.lit("}"))
    said = (
        F.when(k == 0, F.concat(F.lit('{"filtered_text": "said '), t, F.lit(' end "}'))).when(k == 1, "a ⚠️ b ⚠️ c").when(k == 2, F.concat(F.lit("Here: ```json\n"), n, F.lit("\n``` done")))
        .when(k == 3, t).when(k == 4, '{"other": 1}')
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.clean_response(said).cast("binary")).alias("clean"), F.when(k.between(2, 4), X.fenced_json(said)).alias("fenced"))


@query("prompt_context", f"""{_S}, {_ALIVE}, l as (select act_code, section_number, act_code || ' Section ' || section_number || ' — ' || coalesce(marginal_note, '') || ':' || chr(10) || substr(section_text, 1, 300) ||
        case when status = 'read_down' then chr(10) || '[JUDICIAL NOTE: read down by None (None) -- None]' else '' end as line from live where section_text is not null)
    select md5(case when count(*) = 0 then '' else '--- RETRIEVED LEGAL SECTIONS (authoritative reference) ---' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by act_code, section_number, line) || chr(10) || chr(10) || '--- END RETRIEVED SECTIONS ---' end) as context,
        count(*) as sections, count(*) filter (contains(line, '[JUDICIAL NOTE')) > 0 as notes from l""")
def prompt_context(spark, sf):
    """All sections in force as the text block of a prompt."""
    live = corpus.standing(sections(spark, sf), statuses(spark, sf), AS_OF).where("section_text is not null")
    found = live.select("act_code", "section_number", F.coalesce("marginal_note", F.lit("")).alias("marginal_note"), F.substring("section_text", 1, 300).alias("snippet"), "status", F.lit(None).cast("double").alias("similarity"))
    text = corpus.context(found)
    count = found.agg(F.count("*")).scalar()
    return text.select(F.md5(F.col("context").cast("binary")).alias("context"), count.alias("sections"), F.contains("context", F.lit("[JUDICIAL NOTE")).alias("notes"))


@query("review_rejects", f"""{_S}, c as (select s.act_code, s.section_number from s join {_NEW} n using (act_code, section_number) where valid_to is null and t <> section_text)
    select act_code, section_number, case when section_number::int % 4 = 0 then 'rejected' else 'pending' end as status, case when section_number::int % 4 = 0 then 'not in the gazette' end as reason from c""")
def review_rejects(spark, sf):
    """Pending changes of every fourth number are rejected, with a reason; a second rejection changes nothing."""
    staged = corpus.stage_changes(sections(spark, sf), _new_sections(spark, sf))
    no = staged.where("cast(section_number as int) % 4 = 0").select("act_code", "section_number", F.lit("not in the gazette").alias("reason"))
    return corpus.reject_changes(staged, no).select("act_code", "section_number", "status", "reason")
