"""Histories and checks of question-and-answer transcripts."""

from __future__ import annotations

from joblode import constants as K
from joblode.operators import transcripts as T
from workload.registry import case
from workload.texts import sql_contains_any, sql_strip
from workload.views import TRANSCRIPTS, transcripts

_LAST = "answers AS (SELECT conv_id, max_by(text, turn) AS answer FROM transcripts GROUP BY conv_id)"


@case("history", """SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT DISTINCT conv_id, -1, 'system', 'You answer from the table.' FROM conversations""")
def _(spark, sf):
    return T.history(transcripts(spark, sf), "You answer from the table.")


@case("final_answer", f"WITH {TRANSCRIPTS}, {_LAST} SELECT conv_id, answer FROM answers")
def _(spark, sf):
    return T.final_answer(transcripts(spark, sf))


@case("tool_call_list", f"""WITH {TRANSCRIPTS} SELECT conv_id, turn,
    CAST(generate_subscripts(tool_calls, 1) - 1 AS INTEGER) AS call, unnest(tool_calls) AS tool
  FROM transcripts WHERE tool_calls IS NOT NULL""")
def _(spark, sf):
    return T.tool_calls(transcripts(spark, sf))


@case("transcript_checks", f"""WITH {TRANSCRIPTS}, {_LAST}, calls AS (SELECT conv_id,
    bool_or(coalesce(list_contains(tool_calls, 'top_skills'), false)) AS called_tool,
    bool_or(coalesce(list_has_any(tool_calls, ['semantic_search_jobs', 'search_jobs_by_criteria']), false))
      AS called_any FROM transcripts GROUP BY conv_id)
  SELECT conv_id, called_tool, called_any, {sql_strip('answer')} <> '' AS answered,
    {sql_contains_any('lower(answer)', (*K.REFUSALS, 'der '))} AS refused
  FROM calls JOIN answers USING (conv_id)""")
def _(spark, sf):
    return T.transcript_checks(transcripts(spark, sf), "top_skills",
                               ("semantic_search_jobs", "search_jobs_by_criteria"),
                               (*K.REFUSALS, "der "))
